"""Frame graphs: edge generation, selection, expansion over views and pruning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.operators.greedy import greedy_keep
from reelframe.operators.ordered import range_rank


def new_edges(cand: DataFrame, active: DataFrame, inactive: DataFrame, on: list[str] = ("i", "j")) -> DataFrame:
    """Candidates that are in neither set."""
    return cand.join(active.select(*on).unionByName(inactive.select(*on)), list(on), "left_anti")


def band_edges(nodes: DataFrame, r: int, keys: list[str] = (), self_edges: bool = False) -> DataFrame:
    """All ordered pairs of nodes at most r apart."""
    n = nodes.select(*keys, "i").distinct()
    d = n.withColumn("j", F.explode(F.sequence(F.col("i") - r, F.col("i") + r)))
    if not self_edges:
        d = d.filter(F.col("i") != F.col("j"))
    return d.join(n.select(*keys, F.col("i").alias("j")), [*keys, "j"], "left_semi").select(*keys, "i", "j")


def bidirectional(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Edges and their reverses; `keys` name the graph."""
    e = edges.select(*keys, "i", "j")
    return e.unionByName(e.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"))).distinct()


def edge_difference(cand: DataFrame, existing: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return cand.select(*keys, "i", "j").subtract(existing.select(*keys, "i", "j"))


def _diamond(edges: DataFrame, nms: int) -> DataFrame:
    """Cells an edge suppresses: |di| + |dj| <= max(min(|i - j| - 2, nms), 0)."""
    off = F.sequence(F.lit(-nms), F.lit(nms))
    d = edges.withColumn("di", F.explode(off)).withColumn("dj", F.explode(off))
    reach = F.greatest(F.least(F.abs(F.col("i") - F.col("j")) - 2, F.lit(nms)), F.lit(0))
    return d.filter(F.abs("di") + F.abs("dj") <= reach).withColumn("si", F.col("i") + F.col("di")) \
        .withColumn("sj", F.col("j") + F.col("dj")).drop("di", "dj")


def proximity_edges(dist: DataFrame, nodes: DataFrame, existing: DataFrame, rad: int = 2, nms: int = 2, thresh: float = 16.0,
                    cap: int = 0, keys: Sequence[str] = (), self_edges: bool = False) -> DataFrame:
    """Neighbour edges of every node plus near pairs picked by growing distance (ties by i, j), each picked pair
    suppressing a diamond of cells around it; both directions, one graph per value of `keys`. With `self_edges` every node also has an edge to
    itself, for graphs over several views. `cap` stops the picking of a graph once its edge list is longer than it (0 = no cap).

    Picking goes by rounds over the conflicts of all graphs together; a graph without conflicts left takes no part. Ranks within a graph for `cap` come
    from ranges of (keys, distance).
    """
    keys = list(keys)
    n = nodes.select(*keys, "i").distinct()
    near = n.withColumn("j", F.explode(F.sequence(F.col("i") - rad - 1, F.col("i") - 1))).filter("j >= 0") \
        .join(n.select(*keys, F.col("i").alias("j")), [*keys, "j"], "left_semi").select(*keys, "i", "j")
    selves = n.select(*keys, "i", F.col("i").alias("j"))
    blocked = _diamond(existing.select(*keys, "i", "j"), nms).select(*keys, F.col("si").alias("i"), F.col("sj").alias("j")).unionByName(near)
    if self_edges:
        blocked = blocked.unionByName(selves)
    cand = dist.filter((F.col("i") - rad >= F.col("j")) & (F.col("dist") <= thresh)).select(*keys, "i", "j", "dist") \
        .join(blocked.distinct(), [*keys, "i", "j"], "left_anti").withColumn("__key", F.struct(*keys, "i", "j"))
    a = _diamond(cand, nms).select(*keys, F.col("__key").alias("strong"), F.col("dist").alias("da"), F.col("si").alias("i"), F.col("sj").alias("j"))
    conf = a.join(cand.select(*keys, "i", "j", F.col("__key").alias("weak"), F.col("dist").alias("db")), [*keys, "i", "j"]).filter(
        F.struct("da", "strong") < F.struct("db", "weak"))
    kept = greedy_keep(cand, conf, "__key").select(*keys, "i", "j", "dist")
    if cap > 0:
        listed = near.select(*keys, F.lit(2).alias("__n"))
        if self_edges:
            listed = listed.unionByName(selves.select(*keys, F.lit(1).alias("__n")))
        kept = range_rank(kept, [*keys, "dist", "i", "j"], "__r")
        first = kept.groupBy(*keys).agg(F.min("__r").alias("__first"))
        base = listed.groupBy(*keys).agg(F.sum("__n").alias("__base"))
        on = list(keys) or F.lit(True)
        kept = kept.join(first, on).join(base, on, "left").filter(F.coalesce("__base", F.lit(0)) + (F.col("__r") - F.col("__first")) * 2 <= cap)
    out = bidirectional(kept.select(*keys, "i", "j").unionByName(near), keys)
    return out.unionByName(selves) if self_edges else out


def expand_views(edges: DataFrame, n_views: int, cross_view: DataFrame | None = None, offset: int = 0) -> DataFrame:
    """One edge per view: (pi, qi, di, pj, qj, dj). Same-frame edges take their target from the cross-view
    table (frame, view, t, v)."""
    d = edges.select(F.col("i").alias("pi"), F.col("j").alias("pj"), F.explode(F.sequence(F.lit(0), F.lit(n_views - 1))).alias("qi"))
    d = d.withColumn("qj", F.col("qi"))
    if cross_view is not None:
        x = cross_view.select(F.col("frame").alias("pi"), F.col("view").alias("qi"), "t", "v")
        d = d.join(x, ["pi", "qi"], "left")
        same = (F.col("pi") == F.col("pj")) & F.col("t").isNotNull()
        d = d.withColumn("qj", F.when(same, F.col("v")).otherwise(F.col("qj"))) \
            .withColumn("pj", F.when(same, F.col("t")).otherwise(F.col("pj"))).drop("t", "v")
    d = d.withColumn("qj", F.pmod(F.col("qj") + offset, F.lit(n_views)))
    return d.withColumn("di", F.col("pi") * n_views + F.col("qi")).withColumn("dj", F.col("pj") * n_views + F.col("qj"))


def track_edges(nodes: DataFrame, length: int, n_frames: Column | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Edges from each frame to its length - 1 predecessors inside the range; `keys` name the clip."""
    d = nodes.select(*keys, "i").distinct().withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(length - 2))))
    d = d.select(*keys, "i", (F.col("i") - F.col("m") - 1).alias("j")).filter("i >= 0 AND j >= 0")
    return d if n_frames is None else d.filter((F.col("i") < n_frames) & (F.col("j") < n_frames))


def best_cross_view(dist: DataFrame, old: DataFrame, limit: float = 400.0, keys: Sequence[str] = ()) -> DataFrame:
    """Nearest frame of another view per (frame, view); the old choice stays when nothing is nearer than the limit."""
    g = dist.groupBy(*keys, "frame", "view").agg(F.min_by(F.struct("t", "v"), F.struct("d", "t", "v")).alias("b"), F.min("d").alias("d"))
    o = old.select(*keys, "frame", "view", F.col("t").alias("ot"), F.col("v").alias("ov"))
    take = F.col("d") < limit
    return g.join(o, [*keys, "frame", "view"], "left").select(
        *keys, "frame", "view", F.when(take, F.col("b.t")).otherwise(F.col("ot")).alias("t"),
        F.when(take, F.col("b.v")).otherwise(F.col("ov")).alias("v"))


def age_evict(edges: DataFrame, cap: int, max_age: int, keys: Sequence[str] = (), room: int = 0) -> DataFrame:
    """Keep the newest active edges of each graph (by age, then i, j), `cap` less `room` for new ones, that are not over-age; the others turn inactive."""
    keys = list(keys)
    act = range_rank(edges.filter("active").select(*keys, "age", "i", "j"), [*keys, "age", "i", "j"], "__r")
    first = act.groupBy(*keys).agg(F.min("__r").alias("__first"))
    act = act.join(first, keys or F.lit(True)).filter((F.col("__r") - F.col("__first") < cap - room) & (F.col("age") <= max_age))
    keep = act.select(*keys, "i", "j", F.lit(True).alias("__k"))
    return edges.join(keep, [*keys, "i", "j"], "left").withColumn("active", F.coalesce("__k", F.lit(False))).drop("__k")


def prune_keyframe(edges: DataFrame, thresh: float) -> DataFrame:
    """Drop the second newest keyframe when it is nearer than `thresh` to the one before it: its edges go,
    later indices move down by one."""
    last = edges.select(F.max(F.greatest("i", "j"))).scalar()
    gap = edges.filter((F.least("i", "j") == last - 2) & (F.greatest("i", "j") == last - 1)).select(F.max("dist")).scalar()
    ix, drop = last - 1, F.coalesce(gap < thresh, F.lit(False))
    move = lambda c: F.when(drop & (F.col(c) > ix), F.col(c) - 1).otherwise(F.col(c)).alias(c)
    return edges.filter(~drop | ((F.col("i") != ix) & (F.col("j") != ix))).select(
        move("i"), move("j"), *[c for c in edges.columns if c not in ("i", "j")])


def refresh_dirty(derived: DataFrame, source: DataFrame, changed: DataFrame, key: str, recompute) -> DataFrame:
    """Recompute the derived rows of changed keys only and keep the others."""
    c = changed.select(key).distinct()
    fresh = recompute(source.join(c, key, "left_semi"))
    return derived.join(c, key, "left_anti").unionByName(fresh)
