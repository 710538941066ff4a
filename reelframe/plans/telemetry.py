"""Queries over timing, load and scaling operators."""

from pyspark.sql import functions as F

from reelframe.fixtures import LOAD_QUOTA
from reelframe.functions import text as TX
from reelframe.operators import telemetry as T
from reelframe.plans.registry import query
from reelframe.sources.shards import parse_logs

_SUMMARY = """count(*) AS n, round(sum(wall_s), 6) AS wall_total_s, round(avg(wall_s), 6) AS wall_mean_s,
    round(sum(cpu_s), 6) AS cpu_total_s, round(avg(cpu_s), 6) AS cpu_mean_s, round(sum(gpu_busy_s), 6) AS gpu_busy_total_s,
    round(avg(gpu_busy_s), 6) AS gpu_busy_mean_s, round(sum(cpu_s) / sum(wall_s), 6) AS cpu_parallelism,
    round(sum(gpu_busy_s) / sum(wall_s), 6) AS gpu_occupancy"""


@query("sample_summary", f"SELECT run, {_SUMMARY} FROM sample_timing GROUP BY run")
def sample_summary(v):
    return T.sample_summary(v.sample_timing, ["run"], digits=6)


@query("steady_state", f"""
    SELECT run, rank, {_SUMMARY} FROM (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY run, rank) AS c FROM sample_timing
      WINDOW w AS (PARTITION BY run, rank ORDER BY sample_id)) WHERE c <= 5 OR k > 5 GROUP BY run, rank""")
def steady_state(v):
    return T.steady_state(v.sample_timing, ["run", "rank"], "sample_id", 5, digits=6)


@query("run_rollup", """
    WITH k AS (SELECT *, row_number() OVER (PARTITION BY run, rank ORDER BY sample_id) AS k, count(*) OVER (PARTITION BY run, rank) AS c FROM sample_timing),
    s AS (SELECT run, rank, count(*) AS n, sum(wall_s) AS wall, sum(cpu_s) AS cpu, sum(gpu_busy_s) AS gpu,
                 avg(wall_s) FILTER (c <= 1 OR k > 1) AS steady FROM k GROUP BY run, rank)
    SELECT run, count(*) AS n_shards, CAST(sum(n) AS BIGINT) AS n_videos, round(sum(cpu), 6) AS cpu_total_s,
           round(sum(coalesce(gpu, 0)), 6) AS gpu_busy_total_s, round(sum(cpu) / sum(n), 6) AS cpu_seconds_per_video,
           round(sum(coalesce(gpu, 0)) / sum(n), 6) AS gpu_busy_seconds_per_video, round(sum(n) / max(wall), 6) AS throughput_videos_per_s,
           round(avg(gpu / wall), 6) AS occupancy_mean, round(avg(nullif(steady, 0)), 6) AS steady_state_wall_mean_s,
           min(n) AS videos_min, max(n) AS videos_max FROM s GROUP BY run""")
def run_rollup(v):
    return T.run_rollup(v.sample_timing, digits=6)


@query("straggler_imbalance", """
    SELECT run, round(max(w), 6) AS straggler_s, round(max(w) / min(w), 6) AS shard_imbalance
    FROM (SELECT run, rank, sum(wall_s) AS w FROM sample_timing GROUP BY run, rank) GROUP BY run""")
def straggler_imbalance(v):
    return T.straggler_imbalance(v.sample_timing, digits=6)


@query("peak_load", f"""
    SELECT max(l1) AS peak, epoch_us(min(CASE WHEN l1 > {LOAD_QUOTA / 4} THEN ts END)) AS first_over_us FROM load_trace""")
def peak_load(v):
    d = T.peak_load(v.load_trace.withColumn("ts", F.col("ts").cast("timestamp")), LOAD_QUOTA / 4)
    return d.select("peak", F.unix_micros("first_over").alias("first_over_us"))


@query("max_load_row", "SELECT l1, l5, l15 FROM load_trace ORDER BY l1 DESC, ts LIMIT 1")
def max_load_row(v):
    return T.max_load_row(v.load_trace).select("l1", "l5", "l15")


@query("per_worker_counts", """
    SELECT rank, count(*) AS videos, count(*) FILTER (wall_s / 10 > 1) AS cold_builds, round(sum(wall_s / 10), 6) AS build_total_s,
           round(avg(wall_s / 10), 6) AS build_mean_s FROM sample_timing GROUP BY rank""")
def per_worker_counts(v):
    return T.worker_counts(v.sample_timing.withColumn("build", F.col("wall_s") / 10), "rank", "build", digits=6)


@query("setting_mismatch", """
    SELECT count(*) AS n, count(*) FILTER (a IS NOT NULL AND a <> g) AS mismatches
    FROM (SELECT g, CASE WHEN rep <> 1 THEN g + n_videos % 2 END AS a FROM runs)""")
def setting_mismatch(v):
    d = v.runs.withColumn("actual", F.when(F.col("rep") != 1, F.col("g") + F.col("n_videos") % 2))
    return T.setting_mismatch(d, "g", "actual")


@query("job_status_counts", """
    WITH d AS (SELECT CAST(user_id % 8 AS INT) AS rank, event_id % 97 = 0 AS crashed, CAST(value AS DECIMAL(10,2)) AS w FROM events)
    SELECT rank, count(*) FILTER (NOT crashed AND w >= 5) AS done, count(*) FILTER (NOT crashed AND w = 0) AS missing,
           count(*) FILTER (crashed OR (w < 5 AND w > 0)) AS failed FROM d GROUP BY rank""")
def job_status_counts(v):
    w = F.col("wall_s")
    d = parse_logs(v.logs).withColumn("status", F.when(F.col("error").isNotNull() | w.isNull(), "failed").when(w == 0, "missing").when(w < 5, "failed").otherwise("done"))
    return T.status_counts(d, ["rank"], "status", ["done", "missing", "failed"])


_CELLS = """c AS (SELECT arm, g, avg(wall_s) AS wall, avg(straggler_s) AS st, sum(n_videos) AS n, avg(cpu_s_per_video) AS w_cpu,
                  avg(gpu_s_per_video) AS w_gpu FROM runs GROUP BY arm, g)"""


@query("scaling_table", f"""
    WITH {_CELLS}, b AS (SELECT arm, arg_min(wall, g) AS base FROM c GROUP BY arm)
    SELECT arm, g, round(wall, 9) AS wall_s, round(base / wall, 9) AS speedup, round(base / wall / g, 9) AS efficiency,
           round(n / wall, 9) AS throughput FROM c JOIN b USING (arm)""")
def scaling_table(v):
    return T.scaling_table(v.runs, digits=9)


@query("saturation_point", f"""
    WITH {_CELLS}, o AS (SELECT arm, w_cpu, w_gpu FROM c WHERE g = 1)
    SELECT c.arm, g, round(198 * o.w_gpu / o.w_cpu, 9) AS g_star, round(least(g / o.w_gpu, 198 / o.w_cpu), 9) AS predicted
    FROM c JOIN o ON c.arm = o.arm""")
def saturation_point(v):
    return T.saturation_point(v.runs, 198.0, digits=9)


@query("serial_fraction_fit", f"""
    WITH {_CELLS}, f AS (SELECT arm, avg(wall - st) AS s, arg_min(st, g) AS st1, arg_min(wall, g) AS w1 FROM c GROUP BY arm)
    SELECT arm, g, round(s, 9) AS serial_s, round(s + st1 / g, 9) AS predicted_s, round((s + st1 / g - wall) * 100 / wall, 9) AS error_pct,
           CASE WHEN s > 0 THEN round(w1 / s, 9) END AS ceiling FROM c JOIN f USING (arm)""")
def serial_fraction_fit(v):
    return T.serial_fraction_fit(v.runs, digits=9)


@query("fleet_projection", f"""
    WITH {_CELLS}, d AS (SELECT *, CAST(floor(8 / g) AS BIGINT) AS containers, floor(8 / g) * n / wall AS fleet FROM c),
    o AS (SELECT arm, fleet AS one FROM d WHERE g = 8)
    SELECT arm, g, containers, round(fleet, 9) AS fleet_v_per_s, round(fleet / one, 9) AS vs_single FROM d LEFT JOIN o USING (arm)""")
def fleet_projection(v):
    return T.fleet_projection(v.runs, 8, digits=9)


@query("repeat_stats", """
    WITH d AS (SELECT arm, avg(wall_s) FILTER (g = 4) AS ma, stddev_samp(wall_s) FILTER (g = 4) AS sa,
                      avg(wall_s) FILTER (g = 8) AS mb, stddev_samp(wall_s) FILTER (g = 8) AS sb FROM runs GROUP BY arm)
    SELECT arm, round(ma, 9) AS mean_a, round(sa, 9) AS sd_a, round(mb, 9) AS mean_b, round(sb, 9) AS sd_b,
           round(sqrt(sa * sa + sb * sb), 9) AS spread, round((mb - ma) / sqrt(sa * sa + sb * sb), 9) AS gap_in_spread,
           round(mb / ma, 9) AS ratio FROM d""")
def repeat_stats(v):
    return T.repeat_stats(v.runs, 4, 8, digits=9)


@query("best_config", f"""
    WITH {_CELLS} SELECT arm, arg_min(g, wall) AS best_g, round(min(wall), 9) AS best_wall_s, max(g) AS largest_g,
    arg_min(g, wall) = max(g) AS largest_is_best FROM c GROUP BY arm""")
def best_config(v):
    return T.best_config(v.runs, digits=9)


@query("guarded_ratio", """
    SELECT sample_id, CASE WHEN wall_s > 0 THEN round(cpu_s / wall_s, 6) END AS cpu_par,
           CASE WHEN gpu_busy_s > 0 THEN round(wall_s / gpu_busy_s, 6) ELSE 0.0::DOUBLE END AS wall_per_gpu FROM sample_timing""")
def guarded_ratio(v):
    return v.sample_timing.select(
        "sample_id", T.guarded_ratio(F.col("cpu_s"), F.col("wall_s"), 6).alias("cpu_par"),
        T.guarded_ratio(F.col("wall_s"), F.col("gpu_busy_s"), 6, F.lit(0.0)).alias("wall_per_gpu"))


@query("budget_split", """
    SELECT arm, g, CAST(rep AS INT) AS rep, greatest(1, CAST(floor(n_videos / g) AS BIGINT)) AS threads, round(n_videos / 198.0::DOUBLE, 6) AS over_report FROM runs""")
def budget_split(v):
    return v.runs.select("arm", "g", F.col("rep").cast("int").alias("rep"),
                         T.budget_split(F.col("n_videos"), F.col("g")).alias("threads"),
                         F.round(F.col("n_videos") / 198.0, 6).alias("over_report"))


@query("smoothed_value", """
    WITH d AS (SELECT rank, sample_id, wall_s, row_number() OVER p - 1 AS pos, list_sort(list(wall_s) OVER w) AS l, avg(wall_s) OVER w AS mean,
      max(wall_s) OVER w AS max, sum(wall_s) OVER p / (count(*) OVER p + 1e-6) AS g FROM sample_timing
      WINDOW w AS (PARTITION BY rank ORDER BY sample_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), p AS (PARTITION BY rank ORDER BY sample_id))
    SELECT rank, sample_id, pos, l[CAST(floor((len(l) - 1) / 2) AS INT) + 1] AS median, round(mean, 6) AS mean, max, wall_s AS latest, round(g, 6) AS global_mean FROM d""")
def smoothed_value(v):
    d = T.smoothed(v.sample_timing.select("rank", "sample_id", "wall_s"), ["rank"], "sample_id", "wall_s", 20)
    return d.select("rank", "sample_id", "pos", "median", F.round("mean", 6).alias("mean"), "max", "latest",
                    F.round("global_mean", 6).alias("global_mean"))


@query("eta", """
    WITH d AS (SELECT rank, sample_id, CAST(round(wall_s * 100) AS DOUBLE) AS cs FROM sample_timing)
    SELECT rank, sample_id, sum(cs) OVER p / count(*) OVER p * (count(*) OVER (PARTITION BY rank) - row_number() OVER p) AS eta_cs
    FROM d WINDOW p AS (PARTITION BY rank ORDER BY sample_id)""")
def eta(v):
    # whole hundredths of a second add up exactly in any order
    d = v.sample_timing.select("rank", "sample_id", F.round(F.col("wall_s") * 100).alias("cs"))
    return T.eta(d, ["rank"], "sample_id", "cs").select("rank", "sample_id", F.col("eta_s").alias("eta_cs"))


_FOLD = """
    WITH RECURSIVE s AS (SELECT run, sample_id, gpu_busy_s AS x, row_number() OVER (PARTITION BY run ORDER BY sample_id) AS k,
                count(gpu_busy_s) OVER (PARTITION BY run ORDER BY sample_id) AS m FROM sample_timing),
    f AS (SELECT run, sample_id, k, x AS e FROM s WHERE k = 1
      UNION ALL SELECT s.run, s.sample_id, s.k, CASE WHEN s.x IS NULL THEN f.e WHEN f.e IS NULL THEN s.x ELSE {step} END
      FROM f JOIN s ON s.run = f.run AND s.k = f.k + 1)
    SELECT run, sample_id, round(e, 6) AS ema FROM f"""


def _ema(v, **kw):
    d = T.ema(v.sample_timing.select("run", "sample_id", "gpu_busy_s"), ["run"], "sample_id", "gpu_busy_s", **kw)
    return d.select("run", "sample_id", F.round("ema", 6).alias("ema"))


@query("ema_scale_bias", _FOLD.format(step="0.99::DOUBLE * f.e + 0.01::DOUBLE * s.x"))
def ema_scale_bias(v):
    return _ema(v, decay=0.99)


@query("ema_warmup", _FOLD.format(step="f.e - (1 - least(0.99::DOUBLE, s.m::DOUBLE / (9 + s.m))) * (f.e - s.x)"))
def ema_warmup(v):
    return _ema(v, decay=0.99, warmup=True)


@query("json_field", """
    SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS INT), 0) AS k,
           coalesce(CAST(json_extract_string(props, '$.timing.n') AS INT), -1) AS n FROM events""")
def json_field(v):
    return v.table("events").select("event_id", TX.json_field(F.col("props"), "$.k", "int", 0).alias("k"),
                                    TX.json_field(F.col("props"), "$.timing.n", "int", -1).alias("n"))


@query("epoch_to_ts", """
    SELECT sample_id, epoch_us(ts) AS back_us,
      CAST(CAST(floor(CAST(floor(wall_s * 100) AS BIGINT) / 3600) AS BIGINT) AS VARCHAR) || ':' || lpad(CAST(CAST(floor(CAST(floor(wall_s * 100) AS BIGINT) % 3600 / 60) AS BIGINT) AS VARCHAR), 2, '0')
      || ':' || lpad(CAST(CAST(floor(wall_s * 100) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS eta FROM sample_timing""")
def epoch_to_ts(v):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return v.sample_timing.select(
        "sample_id", F.unix_micros(TX.epoch_to_ts((us / F.lit(1000000)).cast("decimal(20,6)"))).alias("back_us"),
        TX.format_eta(F.col("wall_s") * 100).alias("eta"))


@query("format_eta", """
    SELECT sample_id, CAST(s // 3600 AS VARCHAR) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS eta
    FROM (SELECT sample_id, CAST(floor(cpu_s) AS BIGINT) AS s FROM sample_timing)""")
def format_eta(v):
    return v.sample_timing.select("sample_id", TX.format_eta(F.col("cpu_s")).alias("eta"))
