"""User code inside queries: processors, cached models, estimators, custom aggregates and row generators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelframe.functions import arrays as X
from reelframe.operators.ordered import fold_blocks
from reelframe.operators.scoring import psnr, ssim


def processor(df: DataFrame, fn: Callable[[DataFrame], DataFrame], adds: str) -> DataFrame:
    """Apply a per-frame function and check that it adds exactly the declared columns."""
    out = df.transform(fn)
    want = T.StructType.fromDDL(adds)
    new = {f.name: f.dataType for f in out.schema if f.name not in df.columns}
    if new != {f.name: f.dataType for f in want} or any(c not in out.columns for c in df.columns):
        raise ValueError(f"processor declared {want.simpleString()} and added {new}")
    return out


def iterator_processor(df: DataFrame, keys: list[str], pos: str, fn, schema: str, before: int = 0, after: int = 0,
                       width: int = 4096) -> DataFrame:
    """Apply `fn(pdf)` to the ordered frames of a clip with `before` frames of history and `after` of
    look-ahead. A clip is cut into blocks that carry this context, so no task holds a whole clip; rows of the
    context are dropped from the result. For state without a bound use `iterator_fold`.
    """
    p = F.col(pos)
    first, last = F.floor((p - after) / width), F.floor((p + before) / width)
    d = df.withColumn("__home", F.floor(p / width)).withColumn("__blk", F.explode(F.sequence(first, last)))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromDDL(schema))

    def run(pdf):
        pdf = pdf.sort_values(pos)
        out = fn(pdf.drop(columns=["__home", "__blk"]))
        keep = (pdf["__home"] == pdf["__blk"]).to_numpy()
        return out[keep]

    return d.groupBy(*keys, "__blk").applyInPandas(run, ddl)


def iterator_fold(df: DataFrame, keys: list[str], pos: str, fn, schema: str, state: str, width: int = 65536) -> DataFrame:
    """Apply `fn(pdf, state) -> (rows, state)` to the ordered frames of a clip, with a state of the type `state` that reaches from its first frame to its last.

    The position counts without gaps. A clip is cut into blocks of `width` frames; the state a block ends with enters the next, and a block runs again only
    where its entry changed (`ordered.fold_blocks`). `schema` lists the columns that `fn` returns, a row per frame.
    """
    cols = [c for c in df.columns if c not in keys and c != pos]
    return fold_blocks(df, keys, pos, cols, fn, state, schema, width)[0]


_CACHE: dict = {}


def cached_model(df: DataFrame, config: tuple, load: Callable, predict: Callable, schema: str) -> DataFrame:
    """Run a model over batches. Each Python worker loads a configuration once and keeps it."""

    def run(pdfs: Iterator) -> Iterator:
        from reelframe.functions import udf as here

        if config not in here._CACHE:
            here._CACHE[config] = load(*config)
        for pdf in pdfs:
            yield predict(here._CACHE[config], pdf)

    return df.mapInPandas(run, schema)


# fixed values: kinds of depth an estimator may return
DEPTH_TYPES = ["metric", "model_metric", "distance", "affine_disparity", "scale_disparity"]


def estimate_depth(df: DataFrame, estimator, depth_type: str, inputs: list[str]) -> DataFrame:
    """Attach the result struct of an estimator (array columns in, struct with nullable fields out) and its
    depth type. `estimator` is a pandas UDF or a Column function; None gives nulls."""
    if depth_type not in DEPTH_TYPES:
        raise ValueError(f"unknown depth type {depth_type}")
    empty = F.struct(F.lit(None).cast("array<double>").alias("depth"), F.lit(None).cast("double").alias("confidence"),
                     F.lit(None).cast("double").alias("fov"))
    est = empty if estimator is None else estimator(*[F.col(c) for c in inputs])
    return df.withColumn("estimate", est).withColumn("depth_type", F.lit(depth_type))


def mergeable_aggregate(df: DataFrame, keys: list[str], schema: str, to_accum: Callable, merge: Callable, finalize: Callable,
                        out: str) -> DataFrame:
    """Aggregate with user code: `to_accum(pdf) -> dict` per key and batch, `merge(a, b) -> dict`,
    `finalize(dict) -> dict`. Partials form before the shuffle, so a key costs a few rows per task."""
    kddl = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    names = [f.name for f in T.StructType.fromDDL(schema)]
    one = lambda k: k if isinstance(k, tuple) else (k,)

    def partial(pdfs):
        import pandas as pd

        acc = {}
        for pdf in pdfs:
            for k, g in pdf.groupby(keys, dropna=False):
                a = to_accum(g)
                acc[one(k)] = merge(acc[one(k)], a) if one(k) in acc else a
        yield pd.DataFrame([{**dict(zip(keys, k)), **a} for k, a in acc.items()], columns=[*keys, *names])

    def fold(pdf):
        import pandas as pd

        rows = pdf[names].to_dict("records")
        a = rows[0]
        for b in rows[1:]:
            a = merge(a, b)
        return pd.DataFrame([{**dict(zip(keys, pdf[keys].iloc[0])), **a}], columns=[*keys, *names])

    def last(pdf):
        import pandas as pd

        r = pdf[names].iloc[0].to_dict()
        return pd.DataFrame([{**dict(zip(keys, pdf[keys].iloc[0])), **finalize(r)}])

    part = df.mapInPandas(partial, f"{kddl}, {schema}")
    # two levels: at most 64 rows per key reach the last merge
    lvl = part.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy(*keys, "__salt") \
        .applyInPandas(fold, f"{kddl}, {schema}")
    return lvl.groupBy(*keys).applyInPandas(lambda pdf: last(fold(pdf)), f"{kddl}, {out}")


def score_unit(pairs: DataFrame, clip: str, a: str, b: str, h: str, w: str, metrics: list[str]) -> DataFrame:
    """Mean score per clip and chosen metric of frame pairs."""
    every = {"psnr": psnr(F.col(a), F.col(b)), "ssim": ssim(a, b, h, w, F.lit(1)), "clip": X.cosine(F.col(a), F.col(b))}
    d = pairs.select(clip, *[every[m].alias(m) for m in metrics])
    return d.groupBy(clip).agg(*[F.avg(m).alias(m) for m in metrics], F.count("*").alias("frames"))
