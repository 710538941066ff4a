"""Running state over ordered streams: keyframe selection, chunk numbers, averages, last-20 statistics.

A micro-batch is worked on by the block operators of the batch twins, so a key with half of all rows is cut into blocks like any other group. What a key
hands to the next batch is one small record, kept in an `Upsert` table with the largest order value seen; a batch that starts before
it is an error. Each operator runs what its stream has and returns the stored rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.operators import telemetry as T
from reelframe.operators.ordered import fold_blocks, rank0, running, sliding
from reelframe.sources.files import scratch
from reelframe.streaming.upsert import Upsert


def _in_order(batch: DataFrame, known: DataFrame, key: str, order: str) -> None:
    late = batch.groupBy(key).agg(F.min(order).alias("low")).join(known.select(key, "top"), key).filter("low <= top").limit(1).collect()
    if late:
        raise ValueError(f"rows of {late[0][0]} came out of order: {late[0].low} after {late[0].top}")


def carried(stream: DataFrame, key: str, order: str, state: str, rows: Callable[[DataFrame, DataFrame], DataFrame], ends: Callable[[DataFrame, DataFrame, DataFrame], DataFrame],
            flush: Callable[[DataFrame, DataFrame], DataFrame] | None = None, buckets: int = 16) -> DataFrame:
    """Run a stream with one record per key between batches.

    `rows(batch, known)` gives the rows to store, `known` holding the records (key, state columns, top) of the keys seen before; `ends(batch, known,
    stored)` gives the new records of the batch's keys, without top. `flush(all rows, all records)` has the last word when the stream is at its end.
    Rows are written before records, and both under the number of their batch, so a batch that runs again changes nothing.
    """
    spark = stream.sparkSession
    path = scratch(spark, "stream")
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    store = Upsert(spark, f"{path}/state", [key], f"`{key}` {kinds[key]}, {state}, top {kinds[order]}", buckets)
    shape = []

    def step(batch: DataFrame, number: int) -> None:
        known = store.read(number).join(batch.select(key).distinct(), key, "left_semi")
        _in_order(batch, known, key, order)
        out = rows(batch, known)
        shape[:] = [out.schema]
        out.write.mode("overwrite").parquet(f"{path}/data/batch={number}")
        stored = spark.read.schema(out.schema).parquet(f"{path}/data/batch={number}")
        tops = batch.groupBy(key).agg(F.max(order).alias("top"))
        store.write(ends(batch, known, stored).join(tops, key), tops, number)

    q = stream.writeStream.foreachBatch(step).option("checkpointLocation", path + "/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    if not shape:
        empty = spark.createDataFrame([], stream.schema)
        return rows(empty, store.read())
    done = spark.read.schema(shape[0]).option("recursiveFileLookup", "true").parquet(path + "/data")
    return done if flush is None else flush(done, store.read())


# --- keyframes -----------------------------------------------------------------------------------

_TRACK = ["__views", "__view", "__kp", "__u", "__v"]


def _flat_tracks(df: DataFrame, tracks: str | None) -> tuple[DataFrame, list[str]]:
    """The array of structs as plain arrays, a view as its place among the frame's views: numbers in Python, not an object per track."""
    if tracks is None:
        return df, []
    o = F.coalesce(F.col(tracks), F.expr(f"cast(array() as {df.schema[tracks].dataType.simpleString()})"))
    kind = df.schema[tracks].dataType.elementType["kp"].dataType.simpleString()
    kp, none = ("bigint", F.lit(-2**63)) if kind in ("tinyint", "smallint", "int", "bigint") else ("string", F.lit("None"))
    view = lambda s: F.coalesce(s["view_id"].cast("string"), F.lit("None"))
    number = lambda c: F.transform(o, lambda s: F.coalesce(s[c].cast("double"), F.lit(float("nan"))))
    d = df.withColumn("__views", F.array_sort(F.array_distinct(F.transform(o, view))))
    flat = [F.transform(o, lambda s: F.array_position("__views", view(s)).cast("int")).alias("__view"),
            F.transform(o, lambda s: F.coalesce(s["kp"].cast(kp), none)).alias("__kp"), number("u").alias("__u"), number("v").alias("__v")]
    return d.select(*[c for c in df.columns if c != tracks], "__views", *flat), _TRACK


def _keyframe_fold(value: str, thresh: float, tracks: str | None):
    """Fold over frames whose state is the last kept frame: its value, its tracks, and how many tracks the frame before had in common with it.

    A frame is kept when it moved more than `thresh`, or its common tracks moved by more than twice that, a view's mean added over the views, or more than a
    fifth of the tracks in common is lost from one frame to the next. A view without common tracks adds no motion.
    """
    import numpy as np
    import pandas as pd

    def positions(views, view, kp, u, v):
        """view -> (kp sorted, once each, u, v); of a track named twice the last place counts."""
        view, kp, u, v = np.asarray(view), np.asarray(kp), np.asarray(u, float), np.asarray(v, float)
        out = {}
        for k, name in enumerate(views, 1):
            at = np.flatnonzero(view == k)[::-1]
            names, first = np.unique(kp[at], return_index=True)
            out[name] = (names, u[at[first]], v[at[first]])
        return out

    def met(a, b):
        """Tracks in common and the views' mean motion, added."""
        n, moved = 0, 0.0
        for name in sorted(a.keys() & b.keys()):
            _, i, j = np.intersect1d(a[name][0], b[name][0], assume_unique=True, return_indices=True)
            n += len(i)
            d = ((a[name][1][i] - b[name][1][j]) ** 2 + (a[name][2][i] - b[name][2][j]) ** 2) ** 0.5
            d = d[~np.isnan(d)]
            moved += float(d.mean()) if len(d) else 0.0
        return n, moved

    def read(state):
        last = json.loads(state) if state is not None else None
        if last is not None and tracks is not None:
            last["t"] = {k: tuple(np.array(x) for x in t) for k, t in last["t"].items()}
        return last

    def fold(pdf, state):
        last = read(state)
        x = pdf[value].to_numpy(float)
        keep = np.zeros(len(x), bool)
        if tracks is None:
            at, x0 = 0, None if last is None else last["x"]
            while at < len(x):
                if x0 is not None:
                    far = np.flatnonzero(np.abs(x[at:at + 1024] - x0) > thresh)
                    if not len(far):
                        at += 1024
                        continue
                    at += int(far[0])
                keep[at], x0, at = True, float(x[at]), at + 1
            return pd.DataFrame({"keep": keep}), None if x0 is None else json.dumps({"x": x0})
        for i, seen in enumerate(zip(*[pdf[c] for c in _TRACK])):
            now = positions(*seen)
            if last is not None:
                common, sparse = met(last["t"], now)
                lost = last["n"] > 0 and (last["n"] - common) / last["n"] > 0.2
                keep[i] = abs(x[i] - last["x"]) > thresh or sparse > 2 * thresh or lost
                last["n"] = common
            else:
                keep[i] = True
            if keep[i]:
                last = {"x": float(x[i]), "t": now, "n": 0}
        return pd.DataFrame({"keep": keep}), json.dumps({**last, "t": {k: [y.tolist() for y in t] for k, t in last["t"].items()}}, sort_keys=True)

    return fold


def keyframes_batch(df: DataFrame, key: str, pos: str, value: str, thresh: float = 2.4, width: int = 4096, tracks: str | None = None) -> DataFrame:
    """(key, pos, keep) of every frame, by the rule of `keyframes`, over a dense position."""
    flat, more = _flat_tracks(df, tracks)
    d, _ = fold_blocks(flat, [key], pos, [value, *more], _keyframe_fold(value, thresh, tracks), "string", "keep boolean", width)
    last = df.groupBy(key).agg(F.max(pos).alias("__last"))
    return d.join(last, key).withColumn("keep", F.col("keep") | (F.col(pos) == F.col("__last"))).drop("__last")


def keyframes(stream: DataFrame, key: str, order: str, value: str, thresh: float = 2.4, width: int = 4096, tracks: str | None = None) -> DataFrame:
    """(key, order, keep): a frame is kept when it moved more than `thresh` since the last kept one, or by the rule for `tracks` (an array of structs
    view_id, kp, u, v per frame) where they are given. The first frame of a key and, when the stream ends, its last are always kept."""
    cols = [value] if tracks is None else [value, tracks]
    fold = _keyframe_fold(value, thresh, tracks)
    new = {}

    def rows(batch, known):
        flat, more = _flat_tracks(batch.select(key, order, *cols), tracks)
        d = rank0(flat, [key], order, "__pos")
        done, new["ends"] = fold_blocks(d, [key], "__pos", [value, *more], fold, "string", "keep boolean", width, start=known)
        return d.select(key, order, "__pos").join(done, [key, "__pos"]).select(key, order, "keep")

    def flush(done, records):
        tops = records.select(key, "top")
        return done.join(tops, key).withColumn("keep", F.col("keep") | (F.col(order) == F.col("top"))).drop("top")

    return carried(stream, key, order, "state string", rows, lambda batch, known, stored: new["ends"], flush)


# --- counters, averages, windows -----------------------------------------------------------------

def _kept(known: DataFrame, key: str, cols: dict[str, Column]) -> DataFrame:
    return known.select(key, *[c.alias(n) for n, c in cols.items()])


def chunk_numbers(stream: DataFrame, key: str, order: str, size: int = 16) -> DataFrame:
    """Batch number of every `size` pending frames."""

    def rows(batch, known):
        d = rank0(batch.select(key, order), [key], order, "__r").join(_kept(known, key, {"__n": F.col("n")}), key, "left")
        return d.select(key, order, F.floor((F.coalesce("__n", F.lit(0)) + F.col("__r")) / size).alias("chunk"))

    def ends(batch, known, stored):
        d = stored.groupBy(key).agg(F.count("*").alias("new")).join(known, key, "left")
        return d.select(key, (F.coalesce("n", F.lit(0)) + F.col("new")).alias("n"))

    return carried(stream, key, order, "n long", rows, ends)


def ema(stream: DataFrame, key: str, order: str, value: str, decay: float = 0.99) -> DataFrame:
    """Running exponential average; a null value leaves it as it is. The average so far enters a batch as its first value."""

    def rows(batch, known):
        d = batch.select(key, order, F.col(value).cast("double").alias("__x"), F.lit(True).alias("__own"))
        before = known.select(key, F.col("top").alias(order), F.col("c").alias("__x"), F.lit(False).alias("__own"))
        return T.ema(d.unionByName(before), [key], order, "__x", decay).filter("__own").select(key, order, "ema")

    return carried(stream, key, order, "c double", rows, lambda batch, known, stored: stored.groupBy(key).agg(F.max_by("ema", order).alias("c")))


def smoothed(stream: DataFrame, key: str, order: str, value: str, window: int = 20) -> DataFrame:
    """Lower median, mean and maximum of the last `window` values and the global mean, as an array. A batch is led by the last values before it."""

    def placed(batch, known):
        d = rank0(batch.select(key, order, F.col(value).cast("double").alias("x")), [key], order, "pos")
        before = known.select(key, F.lit(None).cast(d.schema[order].dataType).alias(order), F.size("last").alias("__k"), F.posexplode("last").alias("__i", "x"))
        return d.unionByName(before.select(key, order, "x", (F.col("__i") - F.col("__k")).cast("long").alias("pos")))

    def rows(batch, known):
        d = sliding(placed(batch, known), [key], "pos", window - 1, 0, {"__l": lambda w: F.sort_array(F.collect_list("x").over(w)), "__m": lambda w: F.avg("x").over(w)}).filter("pos >= 0")
        d = running(d, [key], "pos", {"__s": ("sum", F.col("x")), "__n": ("count", F.lit(1))})
        d = d.join(_kept(known, key, {"__t0": F.col("total"), "__n0": F.col("n")}), key, "left")
        mean = (F.coalesce("__t0", F.lit(0.0)) + F.col("__s")) / (F.coalesce("__n0", F.lit(0)) + F.col("__n") + 1e-6)
        median = F.get("__l", F.floor((F.size("__l") - 1) / 2).cast("int"))
        return d.select(key, order, F.array(median, F.col("__m"), F.array_max("__l"), mean).alias("stats"))

    def ends(batch, known, stored):
        d = placed(batch, known)
        count = batch.groupBy(key).agg(F.count("*").alias("new"), F.sum(F.col(value).cast("double")).alias("sum"))
        tail = d.join(count, key).filter(F.col("pos") > F.col("new") - window)  # at most one window per key
        tail = tail.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("last"))
        old = _kept(known, key, {"n0": F.col("n"), "t0": F.col("total")})
        return tail.join(count, key).join(old, key, "left").select(
            key, "last", (F.coalesce("t0", F.lit(0.0)) + F.col("sum")).alias("total"), (F.coalesce("n0", F.lit(0)) + F.col("new")).alias("n"))

    return carried(stream, key, order, "last array<double>, total double, n long", rows, ends)
