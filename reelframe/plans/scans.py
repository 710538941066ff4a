"""Queries over readers and writers: data from the tables goes out to files and comes back."""

from pyspark.sql import functions as F

from reelframe.plans.registry import query
from reelframe.sources import artifacts as A
from reelframe.sources import files as FS
from reelframe.sources import shards as S


def _timing_payloads(v):
    t = v.sample_timing.select(
        "rank", F.col("sample_id").cast("string").alias("name"), "wall_s", "cpu_s", "gpu_busy_s",
        F.col("sample_id").alias("_id"))
    return S.shard_payloads(t, "rank", "per_sample", 4096, F.col("_id"))


def _timing_shards(v):
    path = FS.scratch(v.spark, "shards")
    S.write_shards(_timing_payloads(v), path)
    return S.scan_shards(v.spark, path)


def _score_payloads(v):
    clip = v.frame_scores.groupBy("rank", "name", "metric").agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    res = clip.groupBy("rank", "name").agg(
        F.sum("n").cast("int").alias("frames"),
        F.map_from_entries(F.collect_list(F.struct("metric", "m"))).alias("scores"))
    res = res.select("rank", F.col("name").cast("string").alias("name"), "frames", "scores",
                     F.col("name").alias("_id"))
    return S.shard_payloads(res, "rank", "results", 4096, F.col("_id"))


@query("scan_shard_json", """
    SELECT CAST(rank AS INT) AS rank, count(*) AS n, round(sum(wall_s), 4) AS wall_s,
           round(sum(gpu_busy_s), 4) AS gpu_busy_s FROM sample_timing GROUP BY rank""")
def scan_shard_json(v):
    return S.explode_per_sample(_timing_shards(v)).groupBy("rank").agg(
        F.count("*").alias("n"), F.round(F.sum("wall_s"), 4).alias("wall_s"),
        F.round(F.sum("gpu_busy_s"), 4).alias("gpu_busy_s"))


@query("explode_results", """
    SELECT CAST(rank AS INT) AS rank, CAST(name AS VARCHAR) AS name, metric,
           CAST(sum(count(*)) OVER (PARTITION BY rank, name) AS INT) AS frames, round(avg(value), 6) AS value
    FROM frame_scores GROUP BY rank, name, metric""")
def explode_results(v):
    return S.explode_results(_score_payloads(v)).withColumn("value", F.round("value", 6))


@query("explode_per_sample", """
    SELECT CAST(rank AS INT) AS rank, CAST(sample_id AS VARCHAR) AS name, wall_s, cpu_s, gpu_busy_s
    FROM sample_timing""")
def explode_per_sample(v):
    return S.explode_per_sample(_timing_payloads(v)).select("rank", "name", "wall_s", "cpu_s", "gpu_busy_s")


@query("scan_load_trace", """
    SELECT epoch_us(ts) AS us, l1, l5, l15 FROM load_trace""")
def scan_load_trace(v):
    path = FS.scratch(v.spark, "trace")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    v.load_trace.select(F.concat_ws(" ", (us / F.lit(1e6)).cast("decimal(20,6)"), "l1", "l5", "l15").alias("line")) \
        .write.text(path)
    return S.scan_load_trace(v.spark, path).select(F.unix_micros("ts").alias("us"), "l1", "l5", "l15")


@query("scan_metadata_csv", "SELECT CAST(name AS VARCHAR) AS sequence, num_frames FROM raw_clips")
def scan_metadata_csv(v):
    path = FS.scratch(v.spark, "metadata")
    v.raw_clips.select(F.col("name").cast("string").alias("sequence"), "num_frames") \
        .write.option("header", "true").csv(path)
    return S.scan_metadata_csv(v.spark, path)


@query("scan_manifest", """
    SELECT 'orders' AS source, CAST(name AS VARCHAR) AS name, CAST(frames AS INT) AS frames,
           (name % 100) / 100.0::DOUBLE AS degrade_strength FROM gen_clips""")
def scan_manifest(v):
    path = FS.scratch(v.spark, "manifest")
    # one manifest document per block of 4096 clip numbers
    vid = F.struct(F.col("name").cast("string").alias("name"), F.col("frames").cast("int").alias("frames"),
                   ((F.col("name") % 100) / F.lit(100.0)).alias("degrade_strength"))
    v.gen_clips.groupBy(F.floor(F.col("name") / 4096).alias("part")).agg(F.collect_list(vid).alias("videos")) \
        .select(F.lit("orders").alias("source"), "videos").write.json(path)
    return S.scan_manifest(v.spark, path, multiline=False).select("source", "name", "frames", "degrade_strength")


@query("list_clips", "SELECT DISTINCT concat('clip=', clip) AS folder, 'parquet' AS ext FROM poses")
def list_clips(v):
    path = FS.scratch(v.spark, "clips")
    v.poses.write.partitionBy("clip").parquet(path)
    return FS.list_clips(FS.list_paths(v.spark, path), ["PARQUET"]).select("folder", "ext").distinct() \
        .orderBy("folder")


@query("artifact_index", f"""
    WITH a AS (SELECT name, frames, kind, place, concat('file:/out/', dir, '/', name, suffix) AS path FROM gen_clips,
               (VALUES {', '.join(f"({i}, '{k}', '{d}', '{s}')" for i, (k, (d, s)) in enumerate(FS.ARTIFACTS.items()))}) k(place, kind, dir, suffix)
               WHERE frames > 2 OR place % frames = 0)
    SELECT CAST(name AS VARCHAR) AS name, {', '.join(f"max(path) FILTER (kind = '{k}') AS {k}" for k in FS.ARTIFACTS)}, count(*) = {len(FS.ARTIFACTS)} AS complete FROM a GROUP BY 1""")
def artifact_index(v):
    # the artifact paths a clip would have, less the kinds its index leaves out
    kinds = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(d).alias("d"), F.lit(s).alias("s"))
                      for k, (d, s) in FS.ARTIFACTS.items()])
    paths = v.gen_clips.select("name", "frames", F.posexplode(kinds).alias("i", "a")) \
        .filter((F.col("frames") > 2) | (F.col("i") % F.col("frames") == 0)) \
        .select(F.concat(F.lit("file:/out/"), F.col("a.d"), F.lit("/"), F.col("name").cast("string"),
                         F.col("a.s")).alias("path"))
    return FS.artifact_index(paths)


@query("write_read_poses", """
    SELECT clip, frame_idx, tx, ty, tz, qx, qy, qz, qw FROM poses WHERE frame_idx % 3 <> 0""")
def write_read_poses(v):
    path = FS.scratch(v.spark, "poses")
    cols = ["tx", "ty", "tz", "qx", "qy", "qz", "qw"]
    p = v.poses.select("clip", "frame_idx", F.when(F.col("frame_idx") % 3 != 0, F.struct(*cols)).alias("pose"))
    A.write_indexed(p, path, F.col("pose"))
    return A.read_indexed(v.spark, path).select("clip", "frame_idx", "pose.*")


@query("write_read_intrinsics", """
    SELECT clip, frame_idx, tx + 2 AS fx, ty + 2 AS fy, tz AS cx, qx AS cy,
           CASE WHEN is_kf THEN 'MEI' ELSE 'PINHOLE' END AS camera_type FROM poses""")
def write_read_intrinsics(v):
    path = FS.scratch(v.spark, "intrinsics")
    d = v.poses.select("clip", "frame_idx", "is_kf",
                       F.struct((F.col("tx") + 2).alias("fx"), (F.col("ty") + 2).alias("fy"),
                                F.col("tz").alias("cx"), F.col("qx").alias("cy")).alias("k"))
    A.write_indexed(d.drop("is_kf"), path, F.col("k"))
    cams = d.filter("is_kf").select("clip", "frame_idx", F.lit("MEI").alias("camera_type"))
    return A.read_intrinsics(A.read_indexed(v.spark, path), cams).select("clip", "frame_idx", "k.*", "camera_type")


@query("scan_phrases", """
    SELECT obj_id, arg_max(phrase, {'f': frame, 'p': phrase}) AS phrase
    FROM objects GROUP BY obj_id""")
def scan_phrases(v):
    path = FS.scratch(v.spark, "phrases")
    v.objects.select("frame", F.concat_ws(": ", F.col("obj_id").cast("string"), "phrase").alias("value")) \
        .write.partitionBy("frame").text(path)
    return S.combined_phrases(S.parse_phrases(v.spark.read.text(path)))


@query("depth_fill_corrupt", """
    WITH b AS (SELECT vec_id, side, vec_id % 7 <> 3 AS ok, px_raw,
                      CASE WHEN vec_id % 7 <> 3 THEN CAST(8 + vec_id % 2 AS INT) END AS h FROM frame_px),
    c AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY side ORDER BY vec_id) AS hh FROM b)
    SELECT vec_id, side, hh AS h, NOT ok AS filled,
           CASE WHEN ok THEN 64 ELSE hh * 8 END AS size,
           CASE WHEN ok THEN CAST(px_raw[1] AS DOUBLE) END AS first_value FROM c""")
def depth_fill_corrupt(v):
    ok = F.col("vec_id") % 7 != 3
    d = v.frame_px.select("vec_id", "side", ok.alias("ok"),
                          F.when(ok, 8 + F.col("vec_id") % 2).cast("int").alias("h"), "w",
                          F.when(ok, F.col("px_raw")).alias("px"))
    out = A.fill_corrupt_frames(d, ["side"], "vec_id", F.col("ok"), "h", "w", "px")
    return out.select("vec_id", "side", "h", F.isnan(F.col("px")[0]).alias("filled"), F.size("px").alias("size"),
                      F.when(~F.isnan(F.col("px")[0]), F.col("px")[0]).alias("first_value"))


@query("scan_worker_logs", """
    SELECT event_id AS line_no, CAST(user_id % 8 AS INT) AS rank,
           CASE WHEN ok THEN CAST(json_extract_string(props,'$.k') AS INT) END AS i, CASE WHEN ok THEN 99 END AS n, event_type AS name,
           CASE WHEN ok THEN CAST(CAST(value AS DECIMAL(10,2)) AS DOUBLE) END AS wall_s, CASE WHEN ok THEN user_id % 50 + 0.5::DOUBLE END AS cpu_s,
           CASE WHEN ok AND event_id % 3 = 1 THEN event_id % 7 + 0.25::DOUBLE END AS gpu_busy_s, CASE WHEN ok AND event_id % 3 = 0 THEN 0.25::DOUBLE END AS cache_s,
           CASE WHEN ok AND event_id % 5 <> 0 THEN CAST(event_id % 101 AS DOUBLE) END AS gpu_util, CASE WHEN ok THEN CAST(user_id % 9 AS DOUBLE) END AS cores_busy,
           CASE WHEN NOT ok THEN concat('no frame: ', event_id) END AS error
    FROM (SELECT *, event_id % 97 <> 0 AS ok FROM events)""")
def scan_worker_logs(v):
    path = FS.scratch(v.spark, "logs")
    v.logs.select(F.concat_ws("\t", F.col("line_no").cast("string"), "line").alias("value")).write.text(path)
    raw = v.spark.read.text(path).select(
        F.split("value", "\t", 2)[0].cast("long").alias("line_no"), F.split("value", "\t", 2)[1].alias("line"))
    return S.parse_logs(raw)


@query("scan_sweep", """
    SELECT arm, g AS G, CAST(rep AS INT) AS rep, round(wall_s, 6) AS wall_s, n_videos FROM runs""")
def scan_sweep(v):
    path = FS.scratch(v.spark, "sweep")
    r = v.runs.select("arm", F.col("g").alias("G"), F.col("rep").cast("int").alias("rep"), "wall_s", "n_videos")
    # a sweep file per arm and G: as many rows as repeats
    r.groupBy("arm", "G").agg(F.collect_list(F.struct("arm", "G", "rep", "wall_s", "n_videos")).alias("rows")) \
        .select("rows").write.json(path)
    return S.scan_sweep(v.spark, path, multiline=False).select(
        "arm", "G", "rep", F.round("wall_s", 6).alias("wall_s"), "n_videos")


@query("write_shards_by_worker", """
    SELECT CAST(rank AS INT) AS worker, count(*) AS samples, CAST(sum(sample_id) AS BIGINT) AS id_sum
    FROM sample_timing GROUP BY rank""")
def write_shards_by_worker(v):
    path = FS.scratch(v.spark, "byworker")
    S.write_shards(_timing_payloads(v), path)
    back = v.spark.read.schema("per_sample ARRAY<STRUCT<name: STRING>>, worker INT").json(path)
    return back.select("worker", F.explode("per_sample.name").alias("name")).groupBy("worker").agg(
        F.count("*").alias("samples"), F.sum(F.col("name").cast("long")).alias("id_sum"))


@query("write_summary", "SELECT run, count(*) AS n_videos, round(sum(wall_s), 3) AS wall_s FROM sample_timing GROUP BY run")
def write_summary(v):
    path = FS.scratch(v.spark, "summary")
    s = v.sample_timing.groupBy("run").agg(F.count("*").alias("n_videos"), F.round(F.sum("wall_s"), 3).alias("wall_s"))
    S.write_summary(s, path)
    return S.read_summary(v.spark, [path + "/none", path], "run STRING, n_videos BIGINT, wall_s DOUBLE")


@query("write_read_points", """
    SELECT pid % 16 AS kf, pid, x * 2 AS x, y * 2 AS y, z * 2 AS z FROM points""")
def write_read_points(v):
    path = FS.scratch(v.spark, "points")
    v.points.withColumn("kf", F.col("pid") % 16).write.partitionBy("kf").parquet(path)
    return A.scale_points(v.spark.read.parquet(path), 2.0).select(
        F.col("kf").cast("long").alias("kf"), "pid", "x", "y", "z")
