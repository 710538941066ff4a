"""Point operators: exact nearest neighbours, splatting, z-buffers, rasters and robust extents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.operators.ordered import exact_percentiles, top_k
from reelframe.session import cut

#: a node of the split tree is divided into FAN parts while it holds more than twice LEAF points
LEAF, FAN = 256, 8


def _box(coords: list[str]) -> list[Column]:
    return [F.min(c).alias(f"lo_{i}") for i, c in enumerate(coords)] + [F.max(c).alias(f"hi_{i}") for i, c in enumerate(coords)]


def _norm(parts: list[Column]) -> Column:
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return F.sqrt(total)


def split_tree(points: DataFrame, keys: list[str], coords: list[str], leaf: int = LEAF) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """A tree of bounding boxes balanced by counts: (roots, kids, leaves, depth). points: keys, `pid`, coords, few of them at one position.

    A node of over 2 x `leaf` points is cut along its widest side at FAN - 1 quantiles and at its middle, which parts even heavily repeated values; the quantiles come from
    mergeable sketches, so a node may be any share of the table. roots: keys, n and box; kids: keys, node, kids (a struct per child);
    leaves: keys, node, points. Each level is one pass.
    """
    stat = lambda d, *by: d.groupBy(*by).agg(F.count("*").alias("n"), *_box(coords))
    active = points.withColumn("node", F.lit(""))
    roots, kids, leaves, depth = None, None, None, 0
    spans = [F.col(f"hi_{i}") - F.col(f"lo_{i}") for i in range(len(coords))]
    while True:
        st = cut(stat(active, *keys, "node"))
        if roots is None:
            roots = st
        else:
            child = F.struct("node", "n", *[c for c in st.columns if c[:3] in ("lo_", "hi_")], (F.col("n") > 2 * leaf).alias("inner")).alias("kid")
            new = st.select(*keys, F.regexp_replace("node", "/[^/]*$", "").alias("node"), child).groupBy(*keys, "node").agg(F.collect_list("kid").alias("kids"))
            kids = new if kids is None else kids.unionByName(new)
        ended = active.join(st.filter(F.col("n") <= 2 * leaf).select(*keys, "node"), [*keys, "node"])
        ended = ended.groupBy(*keys, "node").agg(F.collect_list(F.struct("pid", *coords)).alias("points"))
        leaves = ended if leaves is None else leaves.unionByName(ended)
        big = st.filter(F.col("n") > 2 * leaf)
        if big.isEmpty():
            return roots, kids, cut(leaves), depth
        side = F.greatest(*spans) if len(spans) > 1 else spans[0]
        axis, middle = F.lit(0), (F.col("lo_0") + F.col("hi_0")) / 2
        for i in range(len(coords) - 1, -1, -1):
            axis = F.when(spans[i] == side, i).otherwise(axis)
            middle = F.when(spans[i] == side, (F.col(f"lo_{i}") + F.col(f"hi_{i}")) / 2).otherwise(middle)
        big = big.select(*keys, "node", axis.alias("axis"), middle.alias("middle"))
        place = F.lit(None).cast("double")
        for i, c in enumerate(coords):
            place = F.when(F.col("axis") == i, F.col(c)).otherwise(place)
        inside = active.join(big, [*keys, "node"]).withColumn("place", place)
        marks = inside.groupBy(*keys, "node").agg(F.percentile_approx("place", [j / FAN for j in range(1, FAN)], 1000).alias("marks"))
        part = F.size(F.filter(F.array_distinct(F.concat("marks", F.array("middle"))), lambda m: m < F.col("place")))
        active = cut(inside.join(marks, [*keys, "node"]).withColumn("node", F.concat_ws("/", "node", part)).select(*active.columns))
        depth += 1


def knn_join(queries: DataFrame, points: DataFrame, k: int, coords: list[str], qid: str, pid: str,
             keys: list[str] = (), strict: bool = True, leaf: int = LEAF, count: list | None = None) -> DataFrame:
    """The k nearest points of every query by (distance, pid): exact, without pairing all points.

    A query descends the `split_tree` of its group. At each level the farthest corner of a box with k points bounds its k-th distance, and boxes that begin
    beyond the bound are left. The leaves that remain are opened nearest first, four times as many a round, while their boxes begin within the k-th distance
    found so far. At most k points per identical position are kept, since no more can be returned; null coordinates never meet.
    `strict`: a query group with fewer than k points is an error. `count` takes up the pairs formed in each round.
    """
    own, d = list(keys), len(coords)
    keys = own or ["__all"]
    whole = lambda df: df if own else df.withColumn("__all", F.lit(0))
    known = F.lit(True)
    for c in coords:
        known = known & F.col(c).isNotNull()
    pts = whole(points).filter(known).select(*keys, F.col(pid).alias("pid"), *[F.col(c).cast("double").alias(c) for c in coords])
    pts = cut(top_k(pts, [*keys, *coords], [F.col("pid")], k))
    roots, kids, leaves, depth = split_tree(pts, keys, coords, max(leaf, k))
    at = [F.col(f"q_{i}") for i in range(d)]
    q = whole(queries).select(*keys, F.col(qid).alias("qid"), *[F.col(c).cast("double").alias(f"q_{i}") for i, c in enumerate(coords)])
    far = float("inf")
    near_of = lambda b: _norm([F.greatest(b[f"lo_{i}"] - at[i], at[i] - b[f"hi_{i}"], F.lit(0.0)) for i in range(d)])
    far_of = lambda b: _norm([F.greatest(F.abs(b[f"lo_{i}"] - at[i]), F.abs(b[f"hi_{i}"] - at[i])) for i in range(d)])
    root = F.struct(F.lit("").alias("node"), (F.col("n") > 2 * max(leaf, k)).alias("inner"), near_of({f"{s}_{i}": F.col(f"{s}_{i}") for s in ("lo", "hi") for i in range(d)}).alias("near"))
    line = [*keys, "qid", *[f"q_{i}" for i in range(d)]]
    state = q.join(roots, keys).select(*line, F.lit(far).alias("bound"), F.array(root).alias("open"))
    for _ in range(depth):
        # boxes without children stay as they are
        inner = state.select(*line, "bound", F.explode(F.filter("open", lambda b: b["inner"])).alias("b"))
        opened = inner.withColumn("node", F.col("b.node")).join(kids, [*keys, "node"])
        boxes = F.transform("kids", lambda b: F.struct(b["node"].alias("node"), b["inner"].alias("inner"), near_of(b).alias("near")))
        least = F.array_min(F.transform("kids", lambda b: F.when(b["n"] >= k, far_of(b)).otherwise(F.lit(far))))
        opened = opened.select(*line, F.least("bound", least).alias("bound"), boxes.alias("open"))
        stay = state.select(*line, "bound", F.filter("open", lambda b: ~b["inner"]).alias("open"))
        state = opened.unionByName(stay).groupBy(*line).agg(F.min("bound").alias("bound"), F.flatten(F.collect_list("open")).alias("open"))
        state = cut(state.withColumn("open", F.filter("open", lambda b: b["near"] <= F.col("bound"))))
    kind = f"array<struct<dist:double,pid:{pts.schema['pid'].dataType.simpleString()}>>"
    todo = F.array_sort(F.transform("open", lambda b: F.struct(b["near"].alias("near"), b["node"].alias("node"))))
    state = state.select(*line, todo.alias("todo"), F.expr(f"cast(array() as {kind})").alias("best"))
    done, many = None, 1
    while True:
        ask = state.select(*line, F.explode(F.slice("todo", 1, many)).alias("b")).withColumn("node", F.col("b.node"))
        dist = F.transform("points", lambda p: F.struct(_norm([at[i] - p[c] for i, c in enumerate(coords)]).alias("dist"), p["pid"].alias("pid")))
        met = ask.join(leaves, [*keys, "node"])
        if count is not None:
            count.append(met.agg(F.coalesce(F.sum(F.size("points")), F.lit(0))).first()[0])
        found = met.select(*line, F.slice(F.array_sort(dist), 1, k).alias("best"))
        rest = state.select(*line, "best", F.slice("todo", many + 1, F.greatest(F.size("todo"), F.lit(1))).alias("todo"))
        both = found.withColumn("todo", F.lit(None).cast(rest.schema["todo"].dataType)).unionByName(rest)
        merged = both.groupBy(*line).agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"), F.max("todo").alias("todo"))
        kth = F.when(F.size("best") >= k, F.get("best", F.lit(k - 1))["dist"]).otherwise(F.lit(far))
        state = cut(merged.withColumn("todo", F.filter("todo", lambda b: b["near"] <= kth)))
        ready = state.filter(F.size("todo") == 0)
        done = ready if done is None else done.unionByName(ready)
        state, many = state.filter(F.size("todo") > 0), many * 4
        if state.isEmpty():
            break
    out = done.select(*own, F.col("qid").alias(qid), F.explode("best").alias("b")).select(*own, qid, F.col("b.pid").alias(pid), F.col("b.dist").alias("dist"))
    if not strict:
        return out
    n = out.groupBy(*own, qid).agg(F.count("*").alias("__n"))
    chk = queries.select(*own, qid).join(n, [*own, qid], "left").select(
        *own, qid, F.when(F.coalesce("__n", F.lit(0)) < k, F.raise_error(F.lit(f"fewer than {k} points")))
        .otherwise(F.lit(True)).alias("__ok"))
    return out.join(chk.filter("__ok"), [*own, qid]).drop("__ok")


def fill_nearest(missing: DataFrame, known: DataFrame, k: int, value: str, keys: list[str] = ("frame",)) -> DataFrame:
    """Value of each missing pixel: mean over its k nearest known pixels."""
    keys = list(keys)
    known = known.withColumn("__id", F.col("v").cast("long") * 1000003 + F.col("u"))
    q = missing.withColumn("__q", F.col("v").cast("long") * 1000003 + F.col("u"))
    nn = knn_join(q, known, k, ["u", "v"], "__q", "__id", keys, strict=False)
    got = nn.join(known.select(*keys, "__id", value), [*keys, "__id"]).groupBy(*keys, "__q").agg(
        F.avg(value).alias(value))
    return q.join(got, [*keys, "__q"]).drop("__q")


def cell_of(u: Column, v: Column, rounding: bool = True) -> tuple[Column, Column]:
    """Target cell of a position; floor(x + 0.5) as in splatting, or truncation."""
    h = 0.5 if rounding else 0.0
    return F.floor(u + h), F.floor(v + h)


def bilinear_splat(df: DataFrame, keys: list[str], h: int, w: int, values: list[str], clamp: bool = False,
                   weight: Column | None = None) -> DataFrame:
    """Spread each value over four cells with bilinear weights and divide by the weight sum.

    Points whose four cells are not all inside are dropped, or clamped to a border that is cut off.
    """
    u, v = F.col("u"), F.col("v")
    x0, y0 = cell_of(u, v)
    d = df.withColumn("__x", x0).withColumn("__y", y0)
    if not clamp:
        d = d.filter((F.col("__x") >= 0) & (F.col("__x") + 1 < w) & (F.col("__y") >= 0) & (F.col("__y") + 1 < h))
    wx, wy = u - F.col("__x"), v - F.col("__y")
    cells = []
    for dx, fx in ((0, 1 - wx), (1, wx)):
        for dy, fy in ((0, 1 - wy), (1, wy)):
            f = fx * fy if weight is None else fx * fy * weight
            cells.append(F.struct((F.col("__x") + dx).alias("x"), (F.col("__y") + dy).alias("y"), f.alias("w")))
    d = d.withColumn("__c", F.explode(F.array(*cells)))
    if clamp:
        d = d.filter((F.col("__c.x") >= 0) & (F.col("__c.x") < w) & (F.col("__c.y") >= 0) & (F.col("__c.y") < h))
    g = d.groupBy(*keys, F.col("__c.x").alias("x"), F.col("__c.y").alias("y")).agg(
        F.sum("__c.w").alias("weight"), *[F.sum(F.col("__c.w") * F.col(c)).alias("__" + c) for c in values])
    return g.select(*keys, "x", "y", "weight",
                    *[F.when(F.col("weight") != 0, F.col("__" + c) / F.col("weight")).alias(c) for c in values])


def zbuffer_nearest(df: DataFrame, keys: list[str], h: int, w: int, z: str = "z", eps: float = 1e-5) -> DataFrame:
    """Keep per target cell the points nearest to the camera, ties within eps. The per-cell minimum is a
    partial aggregate joined back, so a crowded cell is never gathered."""
    x, y = cell_of(F.col("u"), F.col("v"))
    clip = lambda c, n: F.greatest(F.lit(0), F.least(c, F.lit(n - 1)))
    d = df.withColumn("cx", clip(x, w)).withColumn("cy", clip(y, h))
    near = d.groupBy(*keys, "cx", "cy").agg(F.min(z).alias("__z"))
    return d.join(near, [*keys, "cx", "cy"]).filter(F.col(z) <= F.col("__z") + eps).drop("__z")


def mean_depth_raster(df: DataFrame, keys: list[str], h: int, w: int, z: str = "z") -> DataFrame:
    """Mean depth of the points truncated into each cell of the image."""
    x, y = F.col("u").cast("int"), F.col("v").cast("int")
    d = df.withColumn("x", x).withColumn("y", y).filter(
        (F.col("x") >= 0) & (F.col("x") < w) & (F.col("y") >= 0) & (F.col("y") < h))
    return d.groupBy(*keys, "x", "y").agg(F.avg(z).alias("depth"), F.count("*").alias("n"))


def painter(df: DataFrame, keys: list[str], cols: list[str], keep: str = "nearest", z: str = "z", tie: str = "pid") -> DataFrame:
    """One point per cell: the nearest, or the farthest as in an ascending overwrite."""
    x, y = cell_of(F.col("u"), F.col("v"), rounding=False)
    pick = F.min_by if keep == "nearest" else F.max_by
    return df.groupBy(*keys, x.alias("x"), y.alias("y")).agg(
        pick(F.struct(z, tie, *cols), F.struct(z, tie)).alias("p")).select(*keys, "x", "y", "p.*")


def splat_points(df: DataFrame, keys: list[str], h: int, w: int, z: str = "z") -> DataFrame:
    """Depth map of projected points: the nearest depth of each floor cell inside the image."""
    u, v = F.col("u"), F.col("v")
    d = df.filter((u > 0) & (u < w) & (v > 0) & (v < h) & (F.col(z) > 0))
    x, y = cell_of(u, v, rounding=False)
    return d.groupBy(*keys, x.alias("x"), y.alias("y")).agg(F.min(z).alias("depth"))


def robust_extent(df: DataFrame, keys: list[str], coords: list[str], q: float = 0.01) -> DataFrame:
    """Quantile box (q .. 1-q) and side length per axis."""
    d = exact_percentiles(df, keys, {c: F.col(c) for c in coords}, {"lo": q, "hi": 1 - q})
    return d.withColumns({c + "_len": F.col(c + "_hi") - F.col(c + "_lo") for c in coords})
