"""Roll-ups of per-worker timing, load traces, scaling analysis and progress statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelframe.functions.arrays import let
from reelframe.operators.ordered import entries, rank0, running, sliding, top_k
from reelframe.session import cut


def guarded_ratio(a: Column, b: Column, digits: int | None = None, empty: Column | None = None) -> Column:
    """a / b; null (or `empty`) unless b is positive; rounded to `digits`."""
    r = F.when(b > 0, a / b)
    if digits is not None:
        r = F.round(r, digits)
    return r if empty is None else F.coalesce(r, empty)


def sample_summary(df: DataFrame, keys: list[str], digits: int = 3) -> DataFrame:
    """Totals and means of wall, CPU and device time; device means skip nulls, ratios of totals."""
    wall, cpu, busy = F.sum("wall_s"), F.sum("cpu_s"), F.sum("gpu_busy_s")
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.round(wall, digits).alias("wall_total_s"), F.round(F.avg("wall_s"), digits).alias("wall_mean_s"),
        F.round(cpu, digits).alias("cpu_total_s"), F.round(F.avg("cpu_s"), digits).alias("cpu_mean_s"),
        F.round(busy, digits).alias("gpu_busy_total_s"), F.round(F.avg("gpu_busy_s"), digits).alias("gpu_busy_mean_s"),
        guarded_ratio(cpu, wall, digits).alias("cpu_parallelism"), guarded_ratio(busy, wall, digits).alias("gpu_occupancy"))


def drop_warmup(df: DataFrame, keys: list[str], order: str, skip: int) -> DataFrame:
    """Drop the first `skip` samples per worker; a worker with no more than that keeps all."""
    bound = top_k(df.select(*keys, order), keys, [F.col(order)], skip).groupBy(*keys).agg(F.max(order).alias("__last"))
    size = df.groupBy(*keys).agg(F.count("*").alias("__n")).join(bound, keys)
    return df.join(size, keys).filter((F.col("__n") <= skip) | (F.col(order) > F.col("__last"))).drop("__n", "__last")


def steady_state(df: DataFrame, keys: list[str], order: str, skip: int, digits: int = 3) -> DataFrame:
    return sample_summary(drop_warmup(df, keys, order, skip), keys, digits)


def run_rollup(samples: DataFrame, order: str = "sample_id", skip: int = 1, digits: int = 3) -> DataFrame:
    """One row per run from (run, rank, wall_s, cpu_s, gpu_busy_s); the slowest shard sets the wall time."""
    shard = samples.groupBy("run", "rank").agg(
        F.count("*").alias("n"), F.sum("wall_s").alias("wall"), F.coalesce(F.sum("cpu_s"), F.lit(0.0)).alias("cpu"),
        F.sum("gpu_busy_s").alias("gpu"))
    warm = drop_warmup(samples, ["run", "rank"], order, skip).groupBy("run", "rank") \
        .agg(F.avg("wall_s").alias("steady"))
    n, wall = F.sum("n"), F.max("wall")
    return shard.join(warm, ["run", "rank"], "left").groupBy("run").agg(
        F.count("*").alias("n_shards"), n.alias("n_videos"),
        F.round(F.sum("cpu"), digits).alias("cpu_total_s"),
        F.round(F.sum(F.coalesce("gpu", F.lit(0.0))), digits).alias("gpu_busy_total_s"),
        guarded_ratio(F.sum("cpu"), n, digits).alias("cpu_seconds_per_video"),
        guarded_ratio(F.sum(F.coalesce("gpu", F.lit(0.0))), n, digits).alias("gpu_busy_seconds_per_video"),
        guarded_ratio(n, wall, digits).alias("throughput_videos_per_s"),
        F.round(F.avg(F.when(F.col("wall") > 0, F.col("gpu") / F.col("wall"))), digits).alias("occupancy_mean"),
        F.round(F.avg(F.when(F.col("steady") != 0, F.col("steady"))), digits).alias("steady_state_wall_mean_s"),
        F.min("n").alias("videos_min"), F.max("n").alias("videos_max"))


def straggler_imbalance(samples: DataFrame, digits: int = 3) -> DataFrame:
    """Slowest shard per run and slowest / fastest; null when the fastest took no time."""
    shard = samples.groupBy("run", "rank").agg(F.sum("wall_s").alias("w"))
    return shard.groupBy("run").agg(F.round(F.max("w"), digits).alias("straggler_s"),
                                    guarded_ratio(F.max("w"), F.min("w"), digits).alias("shard_imbalance"))


def peak_load(trace: DataFrame, quota: float) -> DataFrame:
    """Largest 1-minute load and the first time above the quota."""
    return trace.agg(F.max("l1").alias("peak"), F.min(F.when(F.col("l1") > quota, F.col("ts"))).alias("first_over"))


def max_load_row(trace: DataFrame) -> DataFrame:
    return trace.orderBy(F.col("l1").desc(), F.col("ts")).limit(1)


def worker_counts(df: DataFrame, worker: str, build: str, cold: float = 1.0, digits: int = 3) -> DataFrame:
    """Clips per worker and its model builds slower than `cold` seconds."""
    return df.groupBy(worker).agg(
        F.count("*").alias("videos"), F.count_if(F.col(build) > cold).alias("cold_builds"),
        F.round(F.sum(build), digits).alias("build_total_s"), F.round(F.avg(build), digits).alias("build_mean_s"))


def setting_mismatch(df: DataFrame, requested: str, actual: str) -> DataFrame:
    """Rows whose actual setting is known and differs from the requested one."""
    return df.agg(F.count("*").alias("n"),
                  F.count_if(F.col(actual).isNotNull() & (F.col(actual) != F.col(requested))).alias("mismatches"))


def status_counts(df: DataFrame, keys: list[str], status: str, values: list[str]) -> DataFrame:
    """One count column per status."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(status) == s).alias(s) for s in values])


# --- scaling --------------------------------------------------------------------------------------

def cell_means(runs: DataFrame) -> DataFrame:
    """Mean wall, straggler, per-video costs and clip count per (arm, g) over the repeats."""
    return runs.groupBy("arm", "g").agg(
        F.avg("wall_s").alias("wall"), F.avg("straggler_s").alias("straggler"), F.sum("n_videos").alias("n"),
        F.avg("cpu_s_per_video").alias("w_cpu"), F.avg("gpu_s_per_video").alias("w_gpu"))


def _at_smallest(cells: DataFrame, cols: list[str]) -> DataFrame:
    return cells.groupBy("arm").agg(F.min("g").alias("g0"), F.min_by(F.struct(*cols), "g").alias("b")) \
        .select("arm", "g0", *[F.col("b." + c).alias("base_" + c) for c in cols])


def scaling_table(runs: DataFrame, digits: int = 4) -> DataFrame:
    """Speed-up and efficiency against the smallest G of each arm; failed runs (null wall) are left out."""
    c = cell_means(runs.filter(F.col("wall_s").isNotNull()))
    d = c.join(_at_smallest(c, ["wall"]), "arm")
    speedup = guarded_ratio(F.col("base_wall"), F.col("wall"))
    return d.select("arm", "g", F.round("wall", digits).alias("wall_s"), F.round(speedup, digits).alias("speedup"),
                    F.round(speedup / F.col("g"), digits).alias("efficiency"),
                    guarded_ratio(F.col("n"), F.col("wall"), digits).alias("throughput"))


def saturation_point(runs: DataFrame, quota: float, digits: int = 4) -> DataFrame:
    """G* = C * W_gpu / W_cpu from the G=1 row, and the predicted throughput min(G / W_gpu, C / W_cpu)."""
    one = cell_means(runs.filter("g = 1")).select("arm", "w_cpu", "w_gpu")
    star = guarded_ratio(F.lit(quota) * F.col("w_gpu"), F.col("w_cpu"))
    return runs.select("arm", "g").distinct().join(one, "arm").select(
        "arm", "g", F.round(star, digits).alias("g_star"),
        F.round(F.least(guarded_ratio(F.col("g"), F.col("w_gpu")), guarded_ratio(F.lit(quota), F.col("w_cpu"))), digits)
        .alias("predicted"))


def serial_fraction_fit(runs: DataFrame, digits: int = 4) -> DataFrame:
    """wall(G) = S + compute(1) / G: fixed cost S, prediction, error and speed-up ceiling."""
    c = cell_means(runs)
    fit = c.groupBy("arm").agg(F.avg(F.col("wall") - F.col("straggler")).alias("s"))
    base = _at_smallest(c, ["wall", "straggler"])
    d = c.join(fit, "arm").join(base, "arm")
    pred = F.col("s") + F.col("base_straggler") / F.col("g")
    return d.select("arm", "g", F.round("s", digits).alias("serial_s"), F.round(pred, digits).alias("predicted_s"),
                    F.round(guarded_ratio((pred - F.col("wall")) * 100, F.col("wall")), digits).alias("error_pct"),
                    guarded_ratio(F.col("base_wall"), F.col("s"), digits).alias("ceiling"))


def fleet_projection(runs: DataFrame, total: int, digits: int = 4) -> DataFrame:
    """Throughput of total/G containers of G devices, and its ratio to one container of all devices."""
    c = cell_means(runs).withColumn("containers", F.floor(F.lit(total) / F.col("g")))
    d = c.withColumn("fleet", guarded_ratio(F.col("containers") * F.col("n"), F.col("wall")))
    one = d.filter(F.col("g") == total).select("arm", F.col("fleet").alias("one"))
    return d.join(one, "arm", "left").select(
        "arm", "g", "containers", F.round("fleet", digits).alias("fleet_v_per_s"),
        guarded_ratio(F.col("fleet"), F.col("one"), digits).alias("vs_single"))


def repeat_stats(runs: DataFrame, a: int, b: int, digits: int = 4) -> DataFrame:
    """Mean and spread of two cells per arm, and their gap in units of the spread of the difference."""
    d = runs.groupBy("arm").agg(*[
        fn(F.when(F.col("g") == g, F.col("wall_s"))).alias(f"{name}_{side}")
        for side, g in (("a", a), ("b", b)) for name, fn in (("mean", F.avg), ("sd", F.stddev_samp))])
    spread = F.sqrt(F.col("sd_a") * F.col("sd_a") + F.col("sd_b") * F.col("sd_b"))
    gap = F.col("mean_b") - F.col("mean_a")
    return d.select("arm", *[F.round(c, digits).alias(c) for c in ("mean_a", "sd_a", "mean_b", "sd_b")],
                    F.round(spread, digits).alias("spread"), guarded_ratio(gap, spread, digits).alias("gap_in_spread"),
                    guarded_ratio(F.col("mean_b"), F.col("mean_a"), digits).alias("ratio"))


def best_config(runs: DataFrame, digits: int = 4) -> DataFrame:
    """G with the smallest mean wall per arm, and whether it is the largest one tried."""
    return cell_means(runs).groupBy("arm").agg(
        F.min_by("g", F.struct("wall", "g")).alias("best_g"), F.round(F.min("wall"), digits).alias("best_wall_s"),
        F.max("g").alias("largest_g")).withColumn("largest_is_best", F.col("best_g") == F.col("largest_g"))


def budget_split(budget: Column, workers: Column) -> Column:
    """Threads per worker: at least one."""
    return F.greatest(F.lit(1).cast("long"), F.floor(budget / workers))


# --- running statistics ---------------------------------------------------------------------------

def smoothed(df: DataFrame, keys: list[str], order: str, value: str, window: int = 20) -> DataFrame:
    """Lower median, mean, max and latest of the last `window` values, and the running global mean."""
    run = running(df, keys, order, {"pos": ("count", F.lit(1)), "__s": ("sum", F.col(value)), "__n": ("count", F.col(value))}) \
        .withColumn("pos", F.col("pos") - 1)
    out = sliding(run, keys, "pos", window - 1, 0, {
        "__list": lambda w: F.collect_list(value).over(w),
        "mean": lambda w: F.avg(value).over(w),
        "max": lambda w: F.max(value).over(w)})
    med = let(F.sort_array("__list"), lambda a: F.get(a, F.floor((F.size(a) - 1) / 2).cast("int")))
    return out.select(*df.columns, "pos", med.alias("median"), "mean", "max", F.col(value).alias("latest"),
                      (F.col("__s") / (F.col("__n") + 1e-6)).alias("global_mean"))


def eta(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Remaining time: running mean of the iteration time times the iterations left."""
    d = running(df, keys, order, {"pos": ("count", F.lit(1)), "__s": ("sum", F.col(value)), "__n": ("count", F.col(value))})
    n = df.groupBy(*keys).agg(F.count("*").alias("total"))
    return d.join(n, keys).withColumn("eta_s", F.col("__s") / F.col("__n") * (F.col("total") - F.col("pos"))) \
        .drop("__s", "__n", "pos")


def _log_decay(decay: float, warmup: bool):
    """Column functions: log of the product of the decays after update `base` up to update `m`, and the weight of update m.

    With warm-up the decay is min(decay, (1+m)/(10+m)). Its product telescopes to nine factors, until the constant decay takes over
    after update `turn`; for a decay of 1 it never does.
    """
    if not warmup:
        return (lambda m, base: (m - base) * math.log(decay)), (lambda m: F.lit(1.0 - decay))
    turn = None if decay == 1 else max(0, math.ceil((10 * decay - 1) / (1 - decay)) - 1)

    def warm(m, base):
        e = F.lit(0.0)
        for k in range(2, 11):
            e = e - F.log1p((m - base) / (base.cast("double") + k))
        return e

    def log_decay(m, base):
        if turn is None:
            return warm(m, base)
        t = F.lit(turn).cast("long")
        low, high = F.least(m, t), F.least(base, t)
        return warm(low, high) + ((m - low) - (base - high)) * math.log(decay)

    return log_decay, lambda m: F.lit(1.0) - F.least(F.lit(decay), (m + 1) / (m + 10.0))


def ema(df: DataFrame, keys: list[str], order: str, value: str, decay: float = 0.99, warmup: bool = False,
        out: str = "ema", rows: int = 4096) -> DataFrame:
    """Exponential moving average per group; the first value starts it, a null value leaves it as it is.

    An update is the affine map e -> d * e + (1 - d) * x. Blocks of `rows` updates (fewer where the decay is so strong that their weights would leave
    the range of doubles) sum their own weighted values; a block is one map, and the entries of all blocks come from
    `ordered.entries`. Every value counts, however far back; a decay of 1 without warm-up keeps the first value.
    """
    if not 0 < decay <= 1:
        raise ValueError("decay must be over 0 and at most 1")
    width = rows if decay == 1 else max(1, min(rows, int(300.0 / -math.log(decay))))
    log_decay, weight = _log_decay(decay, warmup)
    seen = rank0(df.filter(F.col(value).isNotNull()), keys, order, "__m")
    m = F.col("__m")
    seen = seen.withColumn("__b", F.floor(m / width))
    base = F.greatest(F.col("__b") * width - 1, F.lit(0).cast("long"))
    w = F.when(m == 0, F.lit(1.0)).otherwise(weight(m))
    seen = seen.withColumn("__t", w * F.col(value) * F.exp(-log_decay(m, base)))
    # block 0 starts the average: what enters it has no weight
    kept = F.when(F.col("__b") == 0, 0.0).otherwise(F.exp(log_decay(F.col("__top"), base)))
    maps = seen.groupBy(*keys, "__b").agg(F.sum("__t").alias("__s"), F.max("__m").alias("__top"))
    maps = cut(maps.select(*keys, "__b", kept.alias("a"), (F.col("__s") * F.exp(log_decay(F.col("__top"), base))).alias("s")))
    one = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("s"))
    compose = lambda f, x: F.struct((x["a"] * f["a"]).alias("a"), (x["a"] * f["s"] + x["s"]).alias("s"))
    carry = entries(maps, keys, "__b", ["a", "s"], compose, lambda e, x: x["a"] * e + x["s"], F.lit(0.0), one)
    win = Window.partitionBy(*keys, "__b").orderBy("__m").rowsBetween(Window.unboundedPreceding, 0)
    local = seen.withColumn("__l", F.sum("__t").over(win))
    got = local.join(carry, [*keys, "__b"]).select(*keys, order, ((F.col("__l") + F.col("entry")) * F.exp(log_decay(m, base))).alias("__e"))
    d = df.join(got, [*keys, order], "left")
    return running(d, keys, order, {out: ("last", F.col("__e"))}).drop("__e")
