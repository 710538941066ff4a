"""Ordered computations that never sort a whole group in one task.

A group (clip, worker, view) may hold a large share of all rows, so every operator here splits the
group into blocks of the order column, works inside the blocks, and carries one summary row per block
across them. The carry is joined back on (group, block); whether it is broadcast is left to the
adaptive planner, which knows its size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 65536
_B = "__block"
_G = "__group"


def block_of(order: str, width: int = BLOCK) -> Column:
    """Block number of an integer order column: at most `width` distinct positions per block."""
    return F.floor(F.col(order) / F.lit(width))


def _order(order: str | Sequence[str]) -> list[str]:
    return [order] if isinstance(order, str) else list(order)


def _blocked(df: DataFrame, keys: Sequence[str], order: list[str], width: int, block: Column | None) -> DataFrame:
    """Add the group (one struct column, so that null keys form a group) and the block number. Windows,
    carries and the join between them all use (group, block), so rows are shuffled once."""
    g = F.struct(*keys) if keys else F.lit(0)
    return df.withColumn(_G, g).withColumn(_B, block if block is not None else block_of(order[0], width))


def _carry_window():
    return Window.partitionBy(_G).orderBy(_B)


def rank0(df: DataFrame, keys: Sequence[str], order: str | Sequence[str], out: str,
          width: int = BLOCK, block: Column | None = None) -> DataFrame:
    """Dense 0-based position inside each group."""
    order = _order(order)
    d = _blocked(df, keys, order, width, block)
    prev = _carry_window().rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        d.groupBy(_G, _B).agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__off", F.coalesce(F.sum("__n").over(prev), F.lit(0))).drop("__n")
    )
    local = d.withColumn("__i", F.row_number().over(Window.partitionBy(_G, _B).orderBy(*order)))
    return (
        local.join(offsets, [_G, _B])
        .withColumn(out, (F.col("__i") - 1 + F.col("__off")).cast("long"))
        .select(*[c for c in df.columns if c != out], out)
    )


_COMBINE = {
    "sum": lambda c, l: F.coalesce(c + l, c, l),
    "count": lambda c, l: F.coalesce(c, F.lit(0)) + F.coalesce(l, F.lit(0)),
    "max": lambda c, l: F.greatest(c, l),
    "min": lambda c, l: F.least(c, l),
    "last": lambda c, l: F.coalesce(l, c),
}


def running(df: DataFrame, keys: Sequence[str], order: str | Sequence[str],
            aggs: dict[str, tuple[str, Column]], include_current: bool = True, reverse: bool = False,
            width: int = BLOCK, block: Column | None = None) -> DataFrame:
    """Running aggregates from the start of each group (or from its end when `reverse`).

    `aggs` maps an output name to (kind, column) with kind sum, count, max, min or last; `last` is the
    last non-null value seen so far. The order must be unique inside a group.
    """
    order = _order(order)
    d = _blocked(df, keys, order, width, block)
    if reverse:
        d = d.withColumn(_B, -F.col(_B))
    sort = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    d = d.select("*", *[c.alias("__x_" + o) for o, (_, c) in aggs.items()])
    key = F.struct(*[F.col(c) for c in order])
    part, total = [], []
    prev = _carry_window().rowsBetween(Window.unboundedPreceding, -1)
    stop = 0 if include_current else -1
    w = Window.partitionBy(_G, _B).orderBy(*sort).rowsBetween(Window.unboundedPreceding, stop)
    local = []
    for o, (kind, _) in aggs.items():
        x = F.col("__x_" + o)
        if kind == "last":
            seen = F.when(x.isNotNull(), key)
            part.append((F.min_by(x, seen) if reverse else F.max_by(x, seen)).alias("__p_" + o))
            total.append(F.last("__p_" + o, ignorenulls=True).over(prev).alias("__c_" + o))
            local.append(F.last(x, ignorenulls=True).over(w).alias("__l_" + o))
        else:
            fn = getattr(F, kind)
            merge = F.sum if kind == "count" else fn
            part.append(fn(x).alias("__p_" + o))
            total.append(merge("__p_" + o).over(prev).alias("__c_" + o))
            local.append(fn(x).over(w).alias("__l_" + o))
    carry = d.groupBy(_G, _B).agg(*part).select(_G, _B, *total)
    j = d.select("*", *local).join(carry, [_G, _B])
    outs = [_COMBINE[kind](F.col("__c_" + o), F.col("__l_" + o)).alias(o) for o, (kind, _) in aggs.items()]
    return j.select(*[c for c in df.columns if c not in aggs], *outs)


def shifted(df: DataFrame, keys: Sequence[str], order: str | Sequence[str], cols: dict[str, Column],
            ahead: bool = False, width: int = BLOCK, block: Column | None = None) -> DataFrame:
    """Values of the previous row of each group (the next one when `ahead`); null at the edge."""
    order = _order(order)
    d = _blocked(df, keys, order, width, block)
    d = d.withColumn("__v", F.struct(*[c.alias(o) for o, c in cols.items()]))
    key = F.struct(*[F.col(c) for c in order])
    edge = F.min_by("__v", key) if ahead else F.max_by("__v", key)
    step = F.lead if ahead else F.lag
    carry = (
        d.groupBy(_G, _B).agg(edge.alias("__e"))
        .withColumn("__e", step("__e").over(_carry_window()))
    )
    w = Window.partitionBy(_G, _B).orderBy(*order)
    j = d.withColumn("__s", step("__v").over(w)).join(carry, [_G, _B])
    pick = F.coalesce(F.col("__s"), F.col("__e"))
    return j.select(*[c for c in df.columns if c not in cols], *[pick[o].alias(o) for o in cols])


def sliding(df: DataFrame, keys: Sequence[str], pos: str, before: int, after: int,
            outs: dict[str, callable], width: int = BLOCK) -> DataFrame:
    """Frame `before` rows back to `after` rows ahead over a dense position column.

    Each block also receives the few rows its edge frames need from its neighbours. `outs` maps a name
    to a function of the window.
    """
    blk = F.floor(F.col(pos) / width)
    first = F.floor((F.col(pos) - after) / width)
    last = F.floor((F.col(pos) + before) / width)
    d = df.withColumn("__home", blk).withColumn(_B, F.explode(F.sequence(first, last)))
    w = Window.partitionBy(*keys, _B).orderBy(pos).rowsBetween(-before, after)
    return (
        d.select("*", *[fn(w).alias(o) for o, fn in outs.items()])
        .filter(F.col(_B) == F.col("__home"))
        .select(*df.columns, *outs)
    )


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows of each group. For k up to 1000 the planner limits every map task to k rows per group
    before the shuffle; beyond that a salted pass does the same."""
    if k > 1000:
        plain = [f.name for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
        d = df.withColumn("__salt", F.pmod(F.xxhash64(*plain), F.lit(64)))
        w = Window.partitionBy(*keys, "__salt").orderBy(*order)
        df = d.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= k).drop("__k", "__salt")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= k).drop("__k")


def exact_percentiles(df: DataFrame, keys: Sequence[str], cols: dict[str, Column], qs: dict[str, float],
                      bins: int = 64) -> DataFrame:
    """Exact percentiles with linear interpolation of several columns: one row per group, columns
    `<col>_<q>`. Nulls are left out.

    All columns go through one pass. Equal values are counted before the shuffle. A mergeable sketch of the different values cuts them into `bins` ranges of
    about as many each, wherever they lie; their counts tell the range of each wanted rank, and only that range is sorted.
    """
    keys = list(keys)
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("c"), x.cast("double").alias("v")) for n, x in cols.items()]))
    c = df.select(*keys, rows.alias("__r")).filter(F.col("__r.v").isNotNull()) \
        .groupBy(*keys, F.col("__r.c").alias("__col"), F.col("__r.v").alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    g = [*keys, "__col"]
    d = value_ranges(c, g, bins)
    prev = Window.partitionBy(*g).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    hist = (
        d.groupBy(*g, _B).agg(F.sum("__c").alias("__bn"), F.first("__n").alias("__n"))
        .withColumn("__off", F.coalesce(F.sum("__bn").over(prev), F.lit(0)))
    )
    hit = None
    for q in qs.values():
        p = F.lit(float(q)) * (F.col("__n") - 1)
        one = (F.floor(p) < F.col("__off") + F.col("__bn")) & (F.ceil(p) >= F.col("__off"))
        hit = one if hit is None else hit | one
    need = hist.filter(hit).select(*g, _B, "__off")
    w = Window.partitionBy(*g, _B).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    sel = d.join(need, [*g, _B]).withColumn("__end", F.col("__off") + F.sum("__c").over(w))
    outs = []
    for n in cols:
        for name, q in qs.items():
            p = F.lit(float(q)) * (F.col("__n") - 1)
            at = lambda r: F.max(F.when((F.col("__col") == n) & (F.col("__end") > r) & (F.col("__end") - F.col("__c") <= r), F.col("__v")))
            frac = F.max(F.when(F.col("__col") == n, p - F.floor(p)))
            outs.append((at(F.floor(p)) + (at(F.ceil(p)) - at(F.floor(p))) * frac).alias(f"{n}_{name}"))
    return sel.groupBy(*keys).agg(*outs)


def value_ranges(counts: DataFrame, by: Sequence[str], bins: int) -> DataFrame:
    """Different values (`by`, __v, __c) with the count `__n` of their group and a range number: about one part in `bins` of a group's different values each."""
    marks = F.percentile_approx("__v", [i / bins for i in range(1, bins)], 10_000).alias("__marks")
    span = counts.groupBy(*by).agg(F.sum("__c").alias("__n"), marks)
    return counts.join(span, list(by)).withColumn(_B, F.size(F.filter("__marks", lambda m: m < F.col("__v"))).cast("long")).drop("__marks")


def exact_percentile(df: DataFrame, keys: Sequence[str], value: str, qs: dict[str, float], bins: int = 64) -> DataFrame:
    """`exact_percentiles` of one column, named after the quantiles."""
    d = exact_percentiles(df, keys, {"__p": F.col(value)}, qs, bins)
    return d.select(*keys, *[F.col(f"__p_{n}").alias(n) for n in qs])


def _alike(a, b) -> bool:
    """Whether two states are the same, as user code or as Spark hands them over."""
    import numpy as np

    if hasattr(a, "asDict"):
        a = a.asDict()
    if hasattr(b, "asDict"):
        b = b.asDict()
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_alike(a[k], b[k]) for k in a)
    if any(isinstance(x, (list, tuple, np.ndarray)) for x in (a, b)):
        return a is not None and b is not None and len(a) == len(b) and np.array_equal(np.asarray(a), np.asarray(b))
    return a is b or bool(a == b)


def _walk(fold, keys: list[str], pos: str, cols: list[str], outs: list[str] | None):
    """Walk sorted blocks as they stream in, holding one. A block begins with a row of its own; where that says `__go`, its entry is `__entry`, else what the block before
    ended with, and a block whose entry is that of its last run keeps the end it has. States come as arrays of one or none, since nulls would turn whole numbers
    into floats on the way to pandas. Yields the blocks' ends, or with `outs` the rows."""
    import numpy as np
    import pandas as pd

    def held(states):
        if states is None or not len(states):
            return None
        return states[0].item() if isinstance(states[0], np.generic) else states[0]

    def run(pdfs):
        mark, parts, carried = None, [], None

        def close():
            nonlocal carried
            if mark is None:
                return None
            go, known = mark["__go"].iloc[0], held(mark["__entry"].iloc[0])
            entry = known if go else carried
            if not go and _alike(entry, known):
                carried = held(mark["__end"].iloc[0])
                return None
            pdf = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0].reset_index(drop=True)
            if pdf[pos].is_monotonic_increasing is False:
                pdf = pdf.sort_values(pos, ignore_index=True)
            out, carried = fold(pdf[[*keys, _B, pos, *cols]], entry)
            if outs is not None:
                return pd.concat([pdf[[*keys, pos]], out[outs].reset_index(drop=True)], axis=1)
            return mark[[*keys, _B]].reset_index(drop=True).assign(__entry=[[] if entry is None else [entry]], __end=[[] if carried is None else [carried]])

        for pdf in pdfs:
            at = np.flatnonzero(~pdf["__row"].to_numpy(bool)).tolist()
            if not at or at[0] > 0:
                parts.append(pdf.iloc[:at[0] if at else len(pdf)])
            for i, j in zip(at, [*at[1:], len(pdf)]):
                done = close()
                if done is not None:
                    yield done
                mark, parts = pdf.iloc[i:i + 1], [pdf.iloc[i + 1:j]] if j > i + 1 else []
        done = close()
        if done is not None:
            yield done

    return run


def fold_blocks(df: DataFrame, keys: Sequence[str], pos: str, cols: Sequence[str], fold, state: str, outs: str,
                width: int = BLOCK, start: DataFrame | None = None, reach: int = 8) -> tuple[DataFrame, DataFrame]:
    """Order-dependent fold over a dense position, block by block in parallel: its rows (keys, pos, outs) and its end (keys, state) per group.

    `fold(pdf, state)` returns (frame with the columns of `outs`, end state) for one block in order; the state is any value of the type `state`, None at
    the beginning of a group that `start` (keys, state) does not name. Every block but the first first runs from None, then only the blocks whose
    entry turned out different run again, until no entry changes. A round walks `reach` times as many blocks in a row as the one before, so folds that forget
    their start settle after a few short rounds, and one that never forgets takes as many rounds as the logarithm of its blocks. A task
    streams through its blocks and holds one, whatever the size of its group; a state goes with its block once, not with every row.
    """
    from reelframe.session import cut, shuffled

    keys, cols = list(keys), [c for c in cols if c != pos]
    base = df.select(*keys, pos, *cols).withColumn(_B, F.floor(F.col(pos) / width).cast("long")).dropna(subset=[*keys, _B])
    ddl = lambda names: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name in names)
    names = [p.strip().split()[0].strip("`") for p in outs.split(",")] if outs else []
    # a block's row of state takes the place of a frame before its first one, so that no column of frames gets nulls by it
    heads = cut(base.groupBy(*keys, _B).agg(F.min_by(F.struct(pos, *cols), pos).alias("__head")))
    none, empty = F.lit(None).cast(state), F.expr("array()").cast(f"array<{state}>")
    one = lambda c: F.when(F.col(c).isNull(), empty).otherwise(F.array(c))

    def walked(marks: DataFrame, blocks: int, names: list[str] | None, kinds: str) -> DataFrame:
        rows = base.join(shuffled(marks.select(*keys, _B)), [*keys, _B], "left_semi")
        rows = rows.select(*keys, _B, F.lit(True).alias("__row"), pos, *cols, F.lit(False).alias("__go"), empty.alias("__entry"), empty.alias("__end"))
        first = heads.join(shuffled(marks), [*keys, _B]).select(*keys, _B, F.lit(False).alias("__row"), "__head.*", F.col("go").alias("__go"), one("entry").alias("__entry"), one("end").alias("__end"))
        both = rows.unionByName(first).withColumn("__run", F.floor(F.col(_B) / blocks))
        return both.repartition(*keys, "__run").sortWithinPartitions(*keys, "__run", _B, "__row", pos).drop("__run").mapInPandas(_walk(fold, keys, pos, cols, names), kinds)

    end_kinds = f"{ddl([*keys, _B])}, __entry array<{state}>, __end array<{state}>"
    todo = heads.select(*keys, _B).withColumn("entry", none)
    if start is not None:
        given = heads.groupBy(*keys).agg(F.min(_B).alias(_B)).join(shuffled(start.select(*keys, F.col("state").alias("__given"))), keys)
        todo = todo.join(shuffled(given), [*keys, _B], "left").select(*keys, _B, F.coalesce("__given", "entry").alias("entry"))
    marks, blocks, known = todo.select(*keys, _B, F.lit(True).alias("go"), "entry", none.alias("end")), 1, None
    while True:
        ran = walked(marks, blocks, None, end_kinds).select(*keys, _B, F.get("__entry", F.lit(0)).alias("entry"), F.get("__end", F.lit(0)).alias("end"))
        if known is not None:
            ran = cut(ran)
            ran = known.join(shuffled(ran.select(*keys, _B)), [*keys, _B], "left_anti").unionByName(ran)
        known = cut(ran)
        w = Window.partitionBy(*keys).orderBy(_B)
        seen = known.withColumn("__new", F.lag("end").over(w))
        if start is not None:
            first = start.select(*keys, F.col("state").alias("__start"))
            seen = seen.withColumn("__first", F.row_number().over(w) == 1).join(shuffled(first), keys, "left").withColumn("__new", F.when(F.col("__first"), F.col("__start")).otherwise(F.col("__new")))
        seen = cut(seen.select(*keys, _B, "entry", "end", "__new"))
        changed = seen.filter(~F.col("__new").eqNullSafe(F.col("entry")))
        if changed.isEmpty():
            break
        blocks *= reach
        of_run = F.floor(F.col(_B) / blocks).alias("__run")
        begin = changed.groupBy(*keys, of_run).agg(F.min(_B).alias("__from"))
        go = F.col(_B) == F.col("__from")
        marks = seen.select("*", of_run).join(shuffled(begin), [*keys, "__run"]).filter(F.col(_B) >= F.col("__from")) \
            .select(*keys, _B, go.alias("go"), F.when(go, F.col("__new")).otherwise(F.col("entry")).alias("entry"), "end")
    marks = known.select(*keys, _B, F.lit(True).alias("go"), "entry", none.alias("end"))
    done = walked(marks, 1, names, f"{ddl(keys)}, {ddl([pos])}, {outs}")
    return done, known.groupBy(*keys).agg(F.max_by("end", _B).alias("state"))


def entries(maps: DataFrame, keys: Sequence[str], pos: str, cols: Sequence[str], compose, apply, start: Column, identity: Column,
            width: int = 256, levels: int | None = None) -> DataFrame:
    """State before each step of a chain of maps: (keys, pos, entry). `pos` counts from 0 without gaps in each group.

    A map is a struct of `cols`; `apply(state, map)` gives the next state, `compose(first, map)` one map for both, and `identity` is the map
    that changes nothing. Chunks of `width` maps are composed to one, whose entries are found the same way a level up; then each chunk is
    walked from its entry. There are as many levels as the longest chain needs; `maps` is read for that and on every level, so it should be stored.
    """
    keys = list(keys)
    if levels is None:
        longest, levels = maps.agg(F.coalesce(F.max(pos), F.lit(0))).first()[0], 1
        while longest >= width**levels:
            levels += 1
    step = F.struct(F.col(pos).alias("p"), F.struct(*cols).alias("m"))
    chunk = (F.floor(F.col(pos) / width) if levels > 1 else F.lit(0)).cast("long").alias("__c")
    g = maps.groupBy(*keys, chunk).agg(F.array_sort(F.collect_list(step)).alias("__m"))
    if levels > 1:
        whole = F.aggregate("__m", identity, lambda f, x: compose(f, x["m"]))
        upper = g.select(*keys, "__c", whole.alias("__f")).select(*keys, "__c", "__f.*")
        g = g.join(entries(upper, keys, "__c", cols, compose, apply, start, identity, width, levels - 1), [*keys, "__c"])
    else:
        g = g.withColumn("entry", start)
    kind = f"array<struct<p:{maps.schema[pos].dataType.simpleString()},entry:{g.schema['entry'].dataType.simpleString()}>>"
    walked = F.aggregate("__m", F.struct(F.col("entry").alias("at"), F.expr(f"cast(array() as {kind})").alias("seen")),
                         lambda s, x: F.struct(apply(s["at"], x["m"]).alias("at"), F.array_append(s["seen"], F.struct(x["p"].alias("p"), s["at"].alias("entry"))).alias("seen")))
    return g.select(*keys, F.explode(walked["seen"]).alias("__s")).select(*keys, F.col("__s.p").alias(pos), F.col("__s.entry").alias("entry"))


def range_rank(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """0-based position of each row in the order of the whole table. Rows are dealt to ranges of the order, so no value of its first column need fit
    one task; one row per range carries the counts across."""
    from reelframe.session import cut

    d = cut(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = d.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__base"))
    d = d.withColumn("__i", F.row_number().over(Window.partitionBy("__range").orderBy(*order)))
    return d.join(base, "__range").select(*[c for c in df.columns if c != out], (F.col("__base") + F.col("__i") - 1).alias(out))
