"""Pairing of clips and frames, per-frame quality, and mergeable score aggregation."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelframe.functions.arrays import cosine, mean_squared_diff
from reelframe.operators.ordered import rank0


# --- pairing --------------------------------------------------------------------------------------

def pair_clips(raw: DataFrame, gen: DataFrame, key: str = "name", check: bool = False) -> DataFrame:
    """Clips present on both sides; with `check` an empty result is an error."""
    d = raw.join(gen, key)
    if check and d.isEmpty():
        raise ValueError("no clip exists on both sides")
    return d


def pair_frames(raw: DataFrame, gen: DataFrame, on: list[str], value: str = "value") -> DataFrame:
    """Frames joined on clip and index; with dense indices this cuts both to the shorter clip."""
    return raw.select(*on, F.col(value).alias("raw_" + value)).join(
        gen.select(*on, F.col(value).alias("gen_" + value)), on)


def keep_wanted(clips: DataFrame, wanted: DataFrame, key: str = "name") -> DataFrame:
    return clips.join(wanted.select(key), key, "left_semi")


def missing_inputs(listed: DataFrame, files: DataFrame, key: str = "name") -> DataFrame:
    return listed.join(files.select(key), key, "left_anti")


def skip_existing(clips: DataFrame, artifacts: DataFrame, key: str = "name") -> DataFrame:
    """Clips whose essential artifacts are not all present."""
    return clips.join(artifacts.filter("complete").select(key), key, "left_anti")


def missing_shards(shards: DataFrame, world: int) -> DataFrame:
    """Expected workers without a shard."""
    return shards.sparkSession.range(world).select(F.col("id").alias("rank")) \
        .join(shards.select(F.col("rank").cast("long").alias("rank")).distinct(), "rank", "left_anti")


def truncated_clips(declared: DataFrame, frames: DataFrame, key: str = "name", n: str = "frames") -> DataFrame:
    """Clips whose actual length is below the declared one."""
    actual = frames.groupBy(key).agg(F.count("*").alias("actual"))
    return declared.join(actual, key, "left").withColumn("actual", F.coalesce("actual", F.lit(0))) \
        .filter(F.col("actual") < F.col(n))


# --- merging --------------------------------------------------------------------------------------

def to_accum(scores: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Partial aggregate (sum, count); the mergeable state of a mean."""
    return scores.groupBy(*keys).agg(F.sum(value).alias("s"), F.count(value).alias("n"))


def merge_accum(accum: DataFrame, keys: list[str]) -> DataFrame:
    return accum.groupBy(*keys).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def finalize(accum: DataFrame) -> DataFrame:
    """Mean of a merged state; null over zero rows."""
    return accum.withColumn("mean", F.try_divide(F.col("s"), F.col("n"))).drop("s")


def merge_scores(clip_scores: DataFrame) -> DataFrame:
    """Exact mean per metric from the workers' partial states, next to the biased mean of means; one aggregate over the states."""
    total, n = F.sum("s"), F.sum("n")
    mean, biased = F.try_divide(total, n), F.avg(F.try_divide(F.col("s"), F.col("n")))
    return to_accum(clip_scores, ["metric", "rank"]).groupBy("metric").agg(
        n.alias("n"), mean.alias("mean"), biased.alias("mean_of_means"), (biased - mean).alias("bias"))


def clip_scores(frames: DataFrame, keys: list[str] = ["name", "metric"], value: str = "value") -> DataFrame:
    """Mean over frames; a metric without frames is left out."""
    return frames.groupBy(*keys).agg(F.avg(value).alias("value"))


def clip_scores_wide(frames: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per clip, one column per metric."""
    return frames.groupBy("name").pivot("metric", metrics).agg(F.avg("value"))


def dedupe_last_wins(results: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One record per key; the later (worker, position) overrides."""
    rest = [c for c in results.columns if c not in keys]
    return results.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def parity_diff(a: DataFrame, b: DataFrame, keys: list[str], per: str = "metric", value: str = "value") -> DataFrame:
    """Largest and mean differences of two runs per metric; rows of one side only are counted."""
    j = a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), keys, "full")
    diff = F.abs(F.col("a") - F.col("b"))
    rel = F.try_divide(diff, F.abs(F.col("a")))
    return j.groupBy(per).agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("matched"),
        F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"),
        F.max(diff).alias("max_abs"), F.max(rel).alias("max_rel"), F.avg(rel).alias("mean_rel"))


def mean_by_name(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.avg(value).alias("mean"))


def dataset_totals(videos: DataFrame) -> DataFrame:
    """Pairs, frames and strength range of a manifest."""
    return videos.agg(F.count("*").alias("pairs"), F.sum("frames").alias("frames"),
                      F.min("strength").alias("strength_min"), F.max("strength").alias("strength_max"))


# --- frame metrics --------------------------------------------------------------------------------

def psnr(a: Column, b: Column) -> Column:
    """Peak signal to noise ratio of two arrays in 0..1; identical frames give +infinity."""
    mse = mean_squared_diff(a, b)
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(-10 * F.log10(mse))


def embedding_similarity(a: Column, b: Column) -> Column:
    """Cosine of the L2-normalised embeddings."""
    return cosine(a, b)


def epe(flow_a: DataFrame, flow_b: DataFrame, keys: list[str], per: list[str]) -> DataFrame:
    """Mean end-point distance of two flow fields (du, dv per pixel)."""
    a = flow_a.select(*keys, F.col("du").alias("ua"), F.col("dv").alias("va"))
    b = flow_b.select(*keys, F.col("du").alias("ub"), F.col("dv").alias("vb"))
    return a.join(b, keys).groupBy(*per).agg(
        F.avg(F.hypot(F.col("ua") - F.col("ub"), F.col("va") - F.col("vb"))).alias("epe"))


def _ssim_batch(x, y, c1=0.01 ** 2, c2=0.03 ** 2):
    """Mean SSIM of stacked frames (n, h, w, c); separable 11-tap Gaussian over all three axes."""
    import numpy as np

    g = np.exp(-((np.arange(11) - 5) ** 2) / (2 * 1.5 ** 2))
    g /= g.sum()

    def blur(z):
        for axis in (1, 2, 3):
            pad = [(0, 0)] * 4
            pad[axis] = (5, 5)
            p = np.pad(z, pad, mode="edge")
            n = z.shape[axis]
            z = sum(g[k] * np.take(p, np.arange(k, k + n), axis=axis) for k in range(11))
        return z

    mx, my = blur(x), blur(y)
    sx, sy, sxy = blur(x * x) - mx * mx, blur(y * y) - my * my, blur(x * y) - mx * my
    s = ((2 * mx * my + c1) * (2 * sxy + c2)) / ((mx * mx + my * my + c1) * (sx + sy + c2))
    return s.mean(axis=(1, 2, 3))


@F.pandas_udf(T.DoubleType())
def ssim(a, b, h, w, c):
    """SSIM per frame pair; frames are row-major arrays (h, w, c) in 0..1. One numpy pass per frame shape."""
    import numpy as np
    import pandas as pd

    out = np.full(len(a), np.nan)
    shape = pd.DataFrame({"h": h.to_numpy(), "w": w.to_numpy(), "c": c.to_numpy()})
    for (hh, ww, cc), rows in shape.groupby(["h", "w", "c"]).groups.items():
        i = rows.to_numpy()
        x = np.stack(a.iloc[i].to_numpy()).astype(float).reshape(len(i), hh, ww, cc)
        y = np.stack(b.iloc[i].to_numpy()).astype(float).reshape(len(i), hh, ww, cc)
        out[i] = _ssim_batch(x, y)
    return pd.Series(out)


# --- embedding sets -------------------------------------------------------------------------------

def _merged_moments(a, b):
    """(n, mean, centred cross products) of two sets together."""
    (na, ma, ca), (nb, mb, cb) = a, b
    n, gap = na + nb, mb - ma
    return n, ma + gap * (nb / n), ca + cb + (gap[:, None] * gap) * (na * nb / n)


def _partial_moments(pdfs: Iterator) -> Iterator:
    import numpy as np
    import pandas as pd

    acc: dict = {}
    for pdf in pdfs:
        for s, g in pdf.groupby("set_name"):
            x = np.stack(g["vec"].to_numpy()).astype(np.float64)
            mean = x.mean(0)
            now = len(x), mean, (x - mean).T @ (x - mean)
            acc[s] = (_merged_moments(acc[s][0], now), g["slot"].iloc[0]) if s in acc else (now, g["slot"].iloc[0])
    yield pd.DataFrame([(s, slot, n, mean, cross.ravel()) for s, ((n, mean, cross), slot) in acc.items()], columns=["set_name", "slot", "n", "mean", "cross"])


def moment_sums(df: DataFrame, set_col: str, vec_col: str) -> DataFrame:
    """One row per set: n, mean, cross (centred cross products, row by row). Vectors are read once; every input partition becomes one row per set, and rows are merged in
    a tree of three levels, so that no task holds more than a few hundredths of them and the vectors are never moved."""
    import numpy as np
    import pandas as pd

    schema = "set_name string, slot int, n bigint, mean array<double>, cross array<double>"

    def merge(pdf):
        total = None
        for r in pdf.itertuples():
            now = r.n, np.asarray(r.mean), np.asarray(r.cross).reshape(len(r.mean), -1)
            total = now if total is None else _merged_moments(total, now)
        n, mean, cross = total
        return pd.DataFrame([(pdf["set_name"].iloc[0], pdf["slot"].iloc[0], n, mean, cross.ravel())], columns=["set_name", "slot", "n", "mean", "cross"])

    d = df.select(F.col(set_col).alias("set_name"), F.col(vec_col).alias("vec"), F.spark_partition_id().alias("slot")).filter("set_name IS NOT NULL AND vec IS NOT NULL")
    d = d.mapInPandas(_partial_moments, schema)
    for slots in (256, 16, 1):
        d = d.withColumn("slot", F.col("slot") % slots).groupBy("set_name", "slot").applyInPandas(merge, schema)
    return d.drop("slot")


def set_moments(df: DataFrame, set_col: str, vec_col: str) -> DataFrame:
    """Count, means and sample covariance (set_name, i, j, n, mean_i, mean_j, cov) of embedding sets."""
    m = moment_sums(df, set_col, vec_col)
    d = F.size("mean")
    e = m.select("set_name", "n", "mean", d.alias("d"), F.posexplode("cross").alias("at", "x"))
    i, j = F.floor(F.col("at") / F.col("d")).cast("int"), (F.col("at") % F.col("d")).cast("int")
    return e.select("set_name", i.alias("i"), j.alias("j"), "n", F.get("mean", i).alias("mean_i"), F.get("mean", j).alias("mean_j"), F.when(F.col("n") > 1, F.col("x") / (F.col("n") - 1)).alias("cov"))


def frechet_distance(df: DataFrame, set_col: str, vec_col: str, a: str, b: str, min_n: int = 8) -> DataFrame:
    """Frechet distance of two embedding sets; null when either has fewer than `min_n` vectors.

    Only the d*d moments reach the last step, whose size does not depend on the number of vectors.
    """
    m = moment_sums(df.filter(F.col(set_col).isin(a, b)), set_col, vec_col)

    def solve(pdf):
        import numpy as np
        import pandas as pd

        out = {a: (0, None, None), b: (0, None, None)}
        for r in pdf.itertuples():
            out[r.set_name] = r.n, np.asarray(r.mean), np.asarray(r.cross).reshape(len(r.mean), -1) / max(r.n - 1, 1)
        (na, ma, ca), (nb, mb, cb) = out[a], out[b]
        dist = None
        if min(na, nb) >= min_n:
            val, vec = np.linalg.eigh(ca)
            root = (vec * np.sqrt(np.clip(val, 0, None))) @ vec.T
            ev = np.linalg.eigvalsh(root @ cb @ root)
            dist = float(((ma - mb) ** 2).sum() + np.trace(ca) + np.trace(cb)
                         - 2 * np.sqrt(np.clip(ev, 0, None)).sum())
        return pd.DataFrame({"n_a": [na], "n_b": [nb], "frechet": [dist]})

    return m.groupBy(F.lit(1).alias("one")).applyInPandas(solve, "n_a bigint, n_b bigint, frechet double")
