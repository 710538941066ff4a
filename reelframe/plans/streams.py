"""Queries that run streams over the tables and queries with user code."""

from pyspark.sql import functions as F

from reelframe.functions import camera
from reelframe.functions import udf as U
from reelframe.operators import blocks as BL
from reelframe.operators.ordered import rank0
from reelframe.operators.sampling import route_redetect
from reelframe.plans.depth import R
from reelframe.plans.graph import _RES, _res
from reelframe.plans import geometry  # noqa: F401  (its SQL texts must be registered first)
from reelframe.plans.registry import SQL, query
from reelframe.plans.scans import _score_payloads
from reelframe.plans.scoring import frame_pairs
from reelframe.plans.telemetry import _FOLD
from reelframe.sources import shards as S
from reelframe.sources.files import scratch
from reelframe.streaming import core as C
from reelframe.streaming import monitors as MO
from reelframe.streaming import stateful as ST


def _events(v):
    """Sample timing rows as a stream."""
    k = F.get_json_object("props", "$.k").cast("int")
    return C.table_stream(v.spark, v.path, "events").select(
        F.col("event_id").alias("sample_id"), F.col("event_type").alias("run"), (F.col("user_id") % 8).alias("rank"), "ts",
        F.col("value").alias("wall_s"), F.when(k % 7 != 0, F.col("value") * k / 100.0).alias("gpu_busy_s"))


@query("stream_load_peak", """
    SELECT epoch_us(date_trunc('hour', ts)) AS start_us, round(avg(l1), 6) AS mean, max(l1) AS peak, count(*) AS n, max(l1) > 100 AS alert FROM load_trace GROUP BY 1""")
def stream_load_peak(v):
    t = C.table_stream(v.spark, v.path, "events").select("ts", F.col("value").alias("l1"))
    d = MO.run_load_peak(t, 100.0, "1 hour")
    return d.select(F.unix_micros("start").alias("start_us"), R("mean"), "peak", "n", "alert")


@query("stream_utilisation", """
    WITH s AS (SELECT sample_id, wall_s, ts, make_timestamp(CAST(epoch_us(ts) + round(wall_s * 1e6) AS BIGINT)) AS e FROM sample_timing),
    t AS (SELECT ts AS tick, l1 AS util FROM load_trace)
    SELECT sample_id, wall_s, round(avg(util), 6) AS util_mean, count(util) AS ticks, round(wall_s * avg(util) / 100.0, 9) AS busy_s
    FROM s LEFT JOIN t ON tick >= s.ts AND tick <= e GROUP BY sample_id, wall_s""")
def stream_utilisation(v):
    ticks = C.table_stream(v.spark, v.path, "events").select("ts", F.col("value").alias("util"))
    m = MO.run_utilisation_matches(_events(v), ticks)
    d = MO.utilisation(v.sample_timing, m)
    return d.select("sample_id", "wall_s", R("util_mean"), F.coalesce("ticks", F.lit(0)).alias("ticks"), R("busy_s", d=9))


@query("stream_device_utilisation", """
    WITH s AS (SELECT sample_id, rank, wall_s, ts, make_timestamp(CAST(epoch_us(ts) + round(wall_s * 1e6) AS BIGINT)) AS e FROM sample_timing),
    t AS (SELECT ts AS tick, user_id % 8 AS rank, value AS util FROM events)
    SELECT sample_id, wall_s, round(avg(util), 6) AS util_mean, count(util) AS ticks, round(wall_s * avg(util) / 100.0, 9) AS busy_s
    FROM s LEFT JOIN t ON t.rank = s.rank AND tick >= s.ts AND tick <= e GROUP BY sample_id, wall_s""")
def stream_device_utilisation(v):
    """Every worker's samples with the ticks of its own device."""
    ticks = C.table_stream(v.spark, v.path, "events").select("ts", (F.col("user_id") % 8).alias("rank"), F.col("value").alias("util"))
    m = MO.run_utilisation_matches(_events(v), ticks, on="rank")
    d = MO.utilisation(v.sample_timing, m)
    return d.select("sample_id", "wall_s", R("util_mean"), F.coalesce("ticks", F.lit(0)).alias("ticks"), R("busy_s", d=9))


@query("stream_new_shards", """
    SELECT metric, count(*) AS n, round(avg(m), 6) AS mean FROM (SELECT rank, name, metric, avg(value) AS m FROM frame_scores GROUP BY ALL) GROUP BY metric""")
def stream_new_shards(v):
    path = scratch(v.spark, "arriving")
    # every shard arrives twice
    for _ in range(2):
        _score_payloads(v).withColumn("worker", F.col("rank")).drop("part").write.mode("append").partitionBy("worker").json(path)
    shards = C.folder_stream(v.spark.createDataFrame([], S.schemas.SHARD), path, "json") \
        .select("rank", "results", F.col("_metadata.file_modification_time").alias("arrived"))
    r = shards.select("arrived", F.explode("results").alias("r")).select(
        "arrived", F.col("r.name").alias("name"), F.explode("r.scores").alias("metric", "value"))
    return MO.merged_scores(r).select("metric", "n", R("mean"))


@query("stream_pair_frames", """
    SELECT name, frame_idx, metric, value AS raw_value, value + (name % 5) * 1e-4 AS gen_value FROM frame_scores WHERE frame_idx <= name % 7""")
def stream_pair_frames(v):
    path = scratch(v.spark, "frames")
    d = v.frame_scores.drop("rank").withColumn("arrived", F.timestamp_seconds(86400 + F.col("name") % 3600))
    d.write.parquet(path + "/raw")
    d.filter("frame_idx <= name % 7").withColumn("value", F.col("value") + (F.col("name") % 5) * 1e-4).write.parquet(path + "/gen")
    raw, gen = [C.folder_stream(d, f"{path}/{s}") for s in ("raw", "gen")]
    return MO.run_pair_frames(raw, gen, ["name", "frame_idx", "metric"])


_KEYFRAMES = """
    WITH RECURSIVE s AS (SELECT run, sample_id, wall_s AS x, row_number() OVER w AS k, count(*) OVER (PARTITION BY run) AS n FROM sample_timing WINDOW w AS (PARTITION BY run ORDER BY sample_id)),
    f AS (SELECT run, sample_id, k, n, x AS last, true AS keep FROM s WHERE k = 1
      UNION ALL SELECT s.run, s.sample_id, s.k, s.n, CASE WHEN abs(s.x - f.last) > 24 THEN s.x ELSE f.last END, abs(s.x - f.last) > 24 FROM f JOIN s ON s.run = f.run AND s.k = f.k + 1)
    SELECT run, sample_id FROM f WHERE keep OR k = n"""


@query("stream_keyframes", _KEYFRAMES)
def stream_keyframes(v):
    return ST.keyframes(_events(v), "run", "sample_id", "wall_s", 24.0).filter("keep").select("run", "sample_id")


@query("keyframe_tracks", """
    WITH RECURSIVE o AS (SELECT kp % 4 AS clip, view_id, frame, kp, u, v FROM observations),
    s AS (SELECT clip, frame, avg(u) AS x, row_number() OVER w AS k, count(*) OVER (PARTITION BY clip) AS n FROM o GROUP BY clip, frame WINDOW w AS (PARTITION BY clip ORDER BY frame)),
    v AS (SELECT a.clip, a.frame AS a, b.frame AS b, a.view_id, count(*) AS n, avg(sqrt((a.u - b.u) ** 2 + (a.v - b.v) ** 2)) AS d FROM o a JOIN o b USING (clip, view_id, kp) WHERE a.frame < b.frame GROUP BY ALL),
    p AS (SELECT clip, a, b, CAST(sum(n) AS BIGINT) AS n, sum(d) AS d FROM v GROUP BY clip, a, b),
    f AS (SELECT clip, frame, k, n, frame AS last, x, 0::BIGINT AS seen, true AS keep FROM s WHERE k = 1
      UNION ALL SELECT clip, frame, k, n, CASE WHEN keep THEN frame ELSE last END, CASE WHEN keep THEN nx ELSE x END, CASE WHEN keep THEN 0 ELSE now END, keep
      FROM (SELECT s.clip, s.frame, s.k, s.n, f.last, f.x, s.x AS nx, coalesce(p.n, 0) AS now,
              abs(s.x - f.x) > 60 OR coalesce(p.d, 0) > 120 OR (f.seen > 0 AND (f.seen - coalesce(p.n, 0)) / f.seen::DOUBLE > 0.2) AS keep
            FROM f JOIN s ON s.clip = f.clip AND s.k = f.k + 1 LEFT JOIN p ON p.clip = s.clip AND p.a = f.last AND p.b = s.frame))
    SELECT clip, frame FROM f WHERE keep OR k = n""")
def keyframe_tracks(v):
    o = v.observations.withColumn("clip", F.col("kp") % 4)
    tracks = F.array_sort(F.collect_list(F.struct("view_id", "kp", "u", "v")))
    d = o.groupBy("clip", "frame").agg(F.avg("u").alias("x"), tracks.alias("tracks"))
    path = scratch(v.spark, "frames")
    d.repartitionByRange(3, "frame").write.parquet(path)
    C.stamp_order(v.spark, path)
    return ST.keyframes(C.folder_stream(d, path, files_per_batch=1), "clip", "frame", "x", 60.0, tracks="tracks").filter("keep").select("clip", "frame")


@query("keyframe_selection", _KEYFRAMES)
def keyframe_selection(v):
    d = rank0(v.sample_timing, ["run"], "sample_id", "pos")
    k = ST.keyframes_batch(d, "run", "pos", "wall_s", 24.0)
    return d.join(k.filter("keep"), ["run", "pos"]).select("run", "sample_id")


@query("stream_chunks", """
    SELECT run, sample_id, CAST(floor((row_number() OVER (PARTITION BY run ORDER BY sample_id) - 1) / 16) AS BIGINT) AS chunk FROM sample_timing""")
def stream_chunks(v):
    return ST.chunk_numbers(_events(v), "run", "sample_id", 16)


@query("stream_ema", _FOLD.format(step="0.99::DOUBLE * f.e + 0.01::DOUBLE * s.x"))
def stream_ema(v):
    return ST.ema(_events(v), "run", "sample_id", "gpu_busy_s", 0.99).select("run", "sample_id", R("ema"))


@query("stream_smoothed", """
    WITH d AS (SELECT rank, sample_id, list_sort(list(wall_s) OVER w) AS l, avg(wall_s) OVER w AS mean, max(wall_s) OVER w AS max, sum(wall_s) OVER p / (count(*) OVER p + 1e-6) AS g FROM sample_timing
      WINDOW w AS (PARTITION BY rank ORDER BY sample_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), p AS (PARTITION BY rank ORDER BY sample_id))
    SELECT rank, sample_id, l[CAST(floor((len(l) - 1) / 2) AS INT) + 1] AS median, round(mean, 6) AS mean, max, round(g, 6) AS global_mean FROM d""")
def stream_smoothed(v):
    d = ST.smoothed(_events(v), "rank", "sample_id", "wall_s", 20)
    s = F.col("stats")
    return d.select("rank", "sample_id", s[0].alias("median"), R(s[1], "mean"), s[2].alias("max"), R(s[3], "global_mean"))


@query("stream_enrich", "SELECT sample_id, run, wall_s, count(*) OVER (PARTITION BY run) AS run_samples FROM sample_timing")
def stream_enrich(v):
    attrs = v.sample_timing.groupBy("run").agg(F.count("*").alias("run_samples"))
    return MO.run(MO.enrich(_events(v).select("sample_id", "run", "wall_s"), attrs, ["run"]))


@query("stream_processors", """
    SELECT sample_id, wall_s, wall_s / 60 AS wall_min, wall_s > 50 AS slow FROM sample_timing WHERE wall_s > 1""")
def stream_processors(v):
    chain = [lambda d: d.filter("wall_s > 1"), lambda d: d.withColumn("wall_min", F.col("wall_s") / 60),
             lambda d: d.withColumn("slow", F.col("wall_s") > 50)]
    return MO.run(MO.processors(_events(v).select("sample_id", "wall_s"), chain))


@query("stream_best", "SELECT run, max(wall_s) AS best_res, arg_max(sample_id, {'v': wall_s, 'e': -sample_id}) AS best_ep FROM sample_timing GROUP BY run")
def stream_best(v):
    return MO.best_so_far(_events(v), "run", "wall_s", "sample_id", 0.0)


@query("stream_redetect", "SELECT sample_id, run, CASE WHEN sample_id % 24 = 0 THEN 'detect' ELSE 'track' END AS branch FROM sample_timing")
def stream_redetect(v):
    return MO.run(route_redetect(_events(v).select("sample_id", "run"), 12.0, 2.0, "sample_id"))


@query("stream_object_registry", """
    WITH f AS (SELECT obj_id, min(frame) AS first_frame, arg_min(phrase, frame) AS phrase FROM objects GROUP BY obj_id)
    SELECT obj_id, first_frame, phrase, row_number() OVER (ORDER BY first_frame, obj_id) - 1 AS reg_id FROM f""")
def stream_object_registry(v):
    path = scratch(v.spark, "objects")
    v.objects.repartitionByRange(8, "frame", "obj_id").write.parquet(path)
    C.stamp_order(v.spark, path)
    return MO.object_registry(C.folder_stream(v.objects, path, files_per_batch=2)).select("obj_id", "first_frame", "phrase", "reg_id")


@query("stream_dirty_refresh", """
    WITH e AS (SELECT i, j, CASE WHEN i % 8 = 0 THEN age * 3 WHEN i % 4 = 0 THEN age + 10 ELSE age END AS age FROM edges UNION ALL SELECT i, j + 1000, 1 FROM edges WHERE i % 16 = 0)
    SELECT i, count(*) AS n, CAST(sum(age) AS BIGINT) AS s, max(age) AS oldest FROM e GROUP BY i""")
def stream_dirty_refresh(v):
    """All edges arrive, then changed ages, changed ages once more for some of them, and new edges."""
    path = scratch(v.spark, "changes")
    e = v.edges.select("i", "j", "age")
    sets = [e, e.filter("i % 4 = 0").withColumn("age", F.col("age") + 10), e.filter("i % 8 = 0").withColumn("age", F.col("age") * 3),
            e.filter("i % 16 = 0").select("i", (F.col("j") + 1000).alias("j"), F.lit(1).cast(e.schema["age"].dataType).alias("age"))]
    for k, d in enumerate(sets):
        d.repartition(2, "i").write.parquet(f"{path}/{k}")
    C.stamp_order(v.spark, path, "*/part-*")
    derive = lambda d: d.groupBy("i").agg(F.count("*").alias("n"), F.sum("age").alias("s"), F.max("age").alias("oldest"))
    stream = C.folder_stream(e, path, files_per_batch=2)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in derive(e).schema)
    return MO.dirty_refresh(stream, ["i", "j"], "i", kinds, derive, buckets=8)[1]


# --- user code -------------------------------------------------------------------------------------

@query("processor_api", "SELECT name, frame_idx, value, value / 50 AS norm FROM frames")
def processor_api(v):
    return U.processor(v.frames, lambda d: d.withColumn("norm", F.col("value") / 50), "norm double")


@query("iterator_processor", """
    SELECT clip, frame_idx, round(tx - coalesce(lag(tx) OVER w, tx) + coalesce(lead(tx) OVER w, tx), 6) AS mixed FROM poses WINDOW w AS (PARTITION BY clip ORDER BY frame_idx)""")
def iterator_processor(v):
    def fn(pdf):
        x = pdf["tx"]
        out = x - x.shift(1).fillna(x) + x.shift(-1).fillna(x)
        return pdf[["clip", "frame_idx"]].assign(mixed=out.round(6))

    d = U.iterator_processor(v.poses.select("clip", "frame_idx", "tx"), ["clip"], "frame_idx", fn, "clip int, frame_idx int, mixed double", 1, 1)
    return d.select("clip", "frame_idx", R("mixed"))


@query("iterator_fold", """
    WITH d AS (SELECT clip, frame_idx, tx, max(tx) OVER (PARTITION BY clip ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM poses)
    SELECT clip, frame_idx, greatest(tx, coalesce(before, tx)) AS highest, CAST(count(*) FILTER (before IS NULL OR tx > before) OVER (PARTITION BY clip ORDER BY frame_idx) AS BIGINT) AS records FROM d""")
def iterator_fold(v):
    def fn(pdf, state):
        import numpy as np
        import pandas as pd

        top, seen = (-np.inf, 0) if state is None else (state["top"], state["seen"])
        x = pdf["tx"].to_numpy()
        high = np.maximum.accumulate(np.maximum(x, top))
        records = seen + np.cumsum(high > np.r_[top, high[:-1]])
        return pd.DataFrame({"highest": high, "records": records}), {"top": float(high[-1]), "seen": int(records[-1])}

    return U.iterator_fold(v.poses.select("clip", "frame_idx", "tx"), ["clip"], "frame_idx", fn, "highest double, records bigint", "struct<top:double,seen:bigint>", 32)


@query("score_unit", """
    WITH p AS (SELECT pair_id, a.px_raw AS ra, b.px_raw AS rb FROM (SELECT * FROM frame_px WHERE side = 'raw') a JOIN (SELECT * FROM frame_px WHERE side = 'gen') b USING (pair_id)),
    d AS (SELECT pair_id, (unnest(ra)::DOUBLE + 1) / 2 AS x, (unnest(rb)::DOUBLE + 1) / 2 AS y FROM p),
    f AS (SELECT pair_id, -10 * log10(avg((x - y) ** 2)) AS psnr, sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))) AS clip FROM d GROUP BY pair_id)
    SELECT pair_id % 12 AS video, round(avg(psnr), 6) AS psnr, round(avg(clip), 6) AS clip, count(*) AS frames FROM f GROUP BY 1""")
def score_unit(v):
    d = frame_pairs(v).withColumn("video", F.col("pair_id") % 12)
    return U.score_unit(d, "video", "a", "b", "h", "w", ["psnr", "clip"]).select("video", R("psnr"), R("clip"), "frames")


@query("worker_cached_model", """
    SELECT vec_id, round(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * ((i * 7) % 5 - 2))), 5) AS score FROM embedding_set""")
def worker_cached_model(v):
    def load(seed, dim):
        import numpy as np

        return (np.arange(1, dim + 1) * seed) % 5 - 2.0

    def predict(model, pdf):
        import numpy as np

        return pdf[["vec_id"]].assign(score=np.stack(pdf["embedding"].to_numpy()).astype(float) @ model)

    d = U.cached_model(v.embedding_set.select("vec_id", "embedding"), (7, 64), load, predict, "vec_id bigint, score double")
    return d.select("vec_id", R("score", d=5))


@query("mergeable_aggregate", "SELECT run, count(*) AS n, round(avg(wall_s), 6) AS mean FROM sample_timing GROUP BY run")
def mergeable_aggregate(v):
    d = U.mergeable_aggregate(
        v.sample_timing.select("run", "wall_s"), ["run"], "s double, n bigint",
        lambda g: {"s": float(g["wall_s"].sum()), "n": len(g)}, lambda a, b: {"s": a["s"] + b["s"], "n": a["n"] + b["n"]},
        lambda a: {"n": int(a["n"]), "mean": a["s"] / a["n"]}, "n bigint, mean double")
    return d.select("run", "n", R("mean"))


@query("model_interface", "SELECT vec_id, 'metric' AS depth_type, 64 AS size, NULL::DOUBLE AS confidence FROM frame_px")
def model_interface(v):
    est = lambda px: F.struct(F.transform(px, lambda x: x.cast("double") + 2).alias("depth"), F.lit(None).cast("double").alias("confidence"),
                              F.lit(None).cast("double").alias("fov"))
    d = U.estimate_depth(v.frame_px, est, "metric", ["px_raw"])
    return d.select("vec_id", "depth_type", F.size("estimate.depth").alias("size"), "estimate.confidence")


@query("robust_kernel", f"""
    SELECT round(sum(w * r * r), 6) AS plain, round(sum(w * r * r * CASE WHEN r * r <= 1 THEN 1 ELSE 1 / abs(r) END), 6) AS huber FROM ({_RES})""")
def robust_kernel(v):
    plain = BL.normal_equations(v.coo, _res(v), None)[2]
    hub = BL.normal_equations(v.coo, _res(v), BL.huber)[2]
    return plain.select(R("energy", "plain"), hub.select(F.round("energy", 6)).scalar().alias("huber"))


@query("generator_tables", SQL["crop_boxes"])
def generator_tables(v):
    sizes = v.strings.select("id", (240 + F.col("id") % 480).alias("h"), (320 + F.col("id") % 640).alias("w"))
    return camera.crop_boxes(sizes, "h", "w", 2, 0.25).drop("h", "w")


