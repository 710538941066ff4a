"""Queries over selection, sharding and clip length operators."""

from pyspark.sql import functions as F

from reelframe.fixtures import SKY_PHRASE
from reelframe.operators import sampling as S
from reelframe.plans.registry import query
from reelframe.sources.shards import drop_private


def _px(df):
    return df.select("frame", "u", "v", F.round("depth", 9).alias("depth"))


@query("frame_stride", "SELECT * FROM frame_scores WHERE frame_idx >= 1 AND frame_idx < 7 AND (frame_idx - 1) % 2 = 0")
def frame_stride(v):
    return S.frame_stride(v.frame_scores, 1, 7, 2)


@query("cap_frames", """
    SELECT name, frame_idx, value FROM (
      SELECT *, row_number() OVER (PARTITION BY name ORDER BY frame_idx) AS k FROM frames) WHERE k <= 3""")
def cap_frames(v):
    return S.cap_frames_gapped(v.frames, ["name"], 3)


@query("limit_clips", "SELECT name, frames FROM gen_clips ORDER BY name LIMIT 25")
def limit_clips(v):
    return S.limit_clips(v.gen_clips, 25)


@query("shard_stride", """
    SELECT name, status, num_frames, (row_number() OVER (ORDER BY name) - 1) % 8 AS rank FROM raw_clips""")
def shard_stride(v):
    return S.shard_stride(v.raw_clips, 8)


@query("shard_chunk", """
    SELECT name, CAST(least(floor((row_number() OVER (ORDER BY name) - 1) / floor((SELECT count(*) FROM gen_clips) / 7)), 6)
           AS BIGINT) AS rank FROM gen_clips""")
def shard_chunk(v):
    return S.shard_chunk(v.gen_clips.select("name"), 7)


@query("min_frames_filter", """
    SELECT name, status, TRY_CAST(num_frames AS DOUBLE) AS num_frames FROM raw_clips
    WHERE TRY_CAST(num_frames AS DOUBLE) >= 24""")
def min_frames_filter(v):
    return S.min_frames(v.raw_clips, 24)


@query("seeded_shuffle")
def seeded_shuffle(v):
    return S.seeded_shuffle(v.raw_clips.select("name"), 7)


@query("select_metrics", "SELECT * FROM frame_scores WHERE metric IN ('clip', 'ssim')")
def select_metrics(v):
    return S.select_metrics(v.frame_scores, "clip, , ssim")


@query("sample_calibration_frames", """
    WITH d AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY frame_idx) - 1 AS pos FROM frames),
    g AS (SELECT name, least(3, CAST(floor((count(*) - 1) / 2) AS BIGINT)) AS g FROM d GROUP BY name)
    SELECT d.name, pos, value FROM d JOIN g ON d.name = g.name WHERE pos IN (0, g, 2 * g)""")
def sample_calibration_frames(v):
    d = S.enumerate_frames(v.frames, ["name"], "frame_idx").drop("frame_idx")
    return S.calibration_frames(d, 0.25, 12.0, idx="pos")


@query("keep_every_nth", "SELECT frame, u, v, round(depth, 9) AS depth FROM depth_px WHERE u % 8 = 3 AND v % 8 = 3")
def keep_every_nth(v):
    return _px(S.every_nth(S.every_nth(v.depth_px, 8, 3, "u"), 8, 3, "v"))


@query("confidence_filter", """
    WITH s AS (SELECT vec_id, list_max(list_transform(embedding[1:10], lambda x: 1.0 / (1.0 + exp(-CAST(x AS DOUBLE))))) AS score
               FROM embedding_set)
    SELECT vec_id, round(score, 9) AS score FROM s WHERE score > 0.55""")
def confidence_filter(v):
    d = v.embedding_set.select("vec_id", F.slice("embedding", 1, 10).alias("logits"))
    return S.confidence(d, 0.55).select("vec_id", F.round("score", 9).alias("score"))


@query("mask_quality_filter", """
    SELECT image, box_id, score / 2000 AS pred_iou, (x1 - x0) / 60 AS stability FROM boxes
    WHERE score / 2000 > 0.454 AND (x1 - x0) / 60 >= 0.6""")
def mask_quality_filter(v):
    d = v.boxes.select("image", "box_id", (F.col("score") / 2000).alias("pred_iou"),
                       ((F.col("x1") - F.col("x0")) / 60).alias("stability"))
    return S.mask_quality(d, 0.454, 0.6)


@query("box_area_filter", "SELECT * FROM boxes WHERE (x1 - x0) * (y1 - y0) <= 170 * 260 * 0.02")
def box_area_filter(v):
    return S.drop_large_boxes(v.boxes, 170, 260, 0.02)


@query("box_edge_filter", """
    SELECT * FROM boxes WHERE NOT (
      (abs(x0 - 50) <= 20 AND NOT abs(x0 - 0) <= 20) OR (abs(y0 - 0) <= 20 AND NOT abs(y0 - 0) <= 20) OR
      (abs(x1 - 180) <= 20 AND NOT abs(x1 - 260) <= 20) OR (abs(y1 - 100) <= 20 AND NOT abs(y1 - 170) <= 20))""")
def box_edge_filter(v):
    return S.drop_near_crop_edge(v.boxes, (50, 0, 180, 100), (0, 0, 260, 170))


_PROJECT = "SELECT pid, 20.0 * x / z + 64 AS u, 20.0 * y / z + 48 AS v, 1.0 / z AS disp FROM points"


def projected(v):
    p = v.points
    return p.select("pid", (F.lit(20.0) * F.col("x") / F.col("z") + 64).alias("u"),
                    (F.lit(20.0) * F.col("y") / F.col("z") + 48).alias("v"), (F.lit(1.0) / F.col("z")).alias("disp"))


@query("in_frame_filter", f"""
    SELECT pid, round(u, 9) AS u, round(v, 9) AS v FROM ({_PROJECT})
    WHERE u > 0 AND u < 512 AND v > 0 AND v < 384 AND disp > 0""")
def in_frame_filter(v):
    return S.in_frame(projected(v), 512, 384).select("pid", F.round("u", 9).alias("u"), F.round("v", 9).alias("v"))


@query("depth_range_filter", "SELECT frame, u, v, round(depth, 9) AS depth FROM depth_px WHERE depth > 1e-4 AND depth > 1.5 AND depth < 3.5")
def depth_range_filter(v):
    return _px(S.depth_range(v.depth_px, 1.5, 3.5))


@query("sample_n_valid")
def sample_n_valid(v):
    return S.sample_n(v.depth_px.filter("valid").select("frame", "u", "v", "depth"), ["frame"], 200, 11, ["u", "v"])


@query("drop_square_hole", """
    SELECT frame, u, v, round(depth, 9) AS depth FROM depth_px
    WHERE NOT (u >= frame * 7 % 40 AND u < frame * 7 % 40 + 16 AND v >= frame * 5 % 30 AND v < frame * 5 % 30 + 16)""")
def drop_square_hole(v):
    f = F.col("frame")
    return _px(S.drop_square_hole(v.depth_px, f * 7 % 40, f * 5 % 30, 16))


@query("grid_downscale_select", """
    SELECT frame, u, v, round(depth, 9) AS depth FROM depth_px
    WHERE u IN (SELECT CAST(floor(k * 64.0 / 20) AS BIGINT) FROM range(20) t(k))
      AND v IN (SELECT CAST(floor(k * 48.0 / 10) AS BIGINT) FROM range(10) t(k)) AND depth > 1e-4""")
def grid_downscale_select(v):
    return _px(S.grid_select(v.depth_px, 48, 64, 10, 20))


@query("scanline_sample", """
    WITH b AS (SELECT -0.5 + p / 7.0 AS pitch, -pi() / 2.1 + y * (2 * pi() / 2.1 / 199) AS yaw FROM range(8) a(p), range(200) c(y)),
    c AS (SELECT cos(pitch) * sin(yaw) AS x, sin(pitch) AS y FROM b),
    d AS (SELECT x, y, sqrt(1 - x * x - y * y) AS z FROM c),
    e AS (SELECT DISTINCT CAST(round_even((48 * x + 32 * z) / (z + 1e-8), 0) AS BIGINT) AS u,
                 CAST(round_even((48 * y + 24 * z) / (z + 1e-8), 0) AS BIGINT) AS v FROM d)
    SELECT frame, p.u, p.v, round(depth, 9) AS depth FROM depth_px p JOIN e ON p.u = e.u AND p.v = e.v WHERE depth > 1e-4""")
def scanline_sample(v):
    return _px(S.scanline_sample(v.depth_px, 8, 48, 64))


@query("valid_mask_from_instances", f"""
    SELECT p.frame, u, v, label, (label = 0 OR o.phrase IS NOT NULL) AS in_mask
    FROM depth_px p LEFT JOIN (SELECT * FROM objects WHERE phrase = '{SKY_PHRASE}') o
      ON p.frame = o.frame AND p.label = o.obj_id""")
def valid_mask_from_instances(v):
    return S.valid_from_instances(v.depth_px.select("frame", "u", "v", "label"), v.objects, SKY_PHRASE)


@query("prune_metadata_columns", "SELECT sample_id, run, wall_s FROM sample_timing")
def prune_metadata_columns(v):
    d = v.sample_timing.withColumn("_pid", F.col("rank") * 10).drop("rank", "ts")
    return drop_private(d, ("cpu_s", "gpu_busy_s"))


@query("strength_schedule", """
    SELECT name, round(0.2 + 0.6 * (row_number() OVER (ORDER BY name) - 1) / greatest(1, (SELECT count(*) FROM gen_clips) - 1), 9)
           AS strength FROM gen_clips""")
def strength_schedule(v):
    return S.strength_schedule(v.gen_clips.select("name"), 0.2, 0.8, digits=9)


_POS = "SELECT name, row_number() OVER (PARTITION BY name ORDER BY frame_idx) - 1 AS pos, value FROM frames"


def _pos(v):
    return S.enumerate_frames(v.frames, ["name"], "frame_idx").select("name", "pos", "value")


@query("frame_enumerate", _POS)
def frame_enumerate(v):
    return _pos(v)


@query("pingpong_extend", f"""
    WITH d AS ({_POS}), n AS (SELECT name, count(*) AS n FROM d GROUP BY name),
    t AS (SELECT name, n, k AS out_idx, CASE WHEN n = 1 THEN 0 ELSE k % (2 * (n - 1)) END AS m FROM n, range(10) r(k))
    SELECT t.name, d.pos, d.value, t.out_idx FROM t JOIN d ON d.name = t.name
      AND d.pos = CASE WHEN m < n THEN m ELSE 2 * (n - 1) - m END""")
def pingpong_extend(v):
    return S.pingpong_extend(_pos(v), 10)


@query("pad_last_frame", f"""
    WITH d AS ({_POS}), n AS (SELECT name, count(*) AS n FROM d GROUP BY name)
    SELECT n.name, d.pos, d.value, k AS out_idx FROM n, range(8) r(k), d
    WHERE d.name = n.name AND d.pos = least(least(2, n - 1) + k, n - 1)""")
def pad_last_frame(v):
    return S.pad_last(_pos(v), 2, 8)


@query("pack_offsets", """
    WITH c AS (SELECT pid % 100 AS kf, pid % 3 AS view_idx, count(*) AS n FROM points GROUP BY 1, 2)
    SELECT kf, view_idx, n, CAST(coalesce(sum(n) OVER (ORDER BY kf, view_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           AS BIGINT) AS start FROM c""")
def pack_offsets(v):
    c = v.points.groupBy((F.col("pid") % 100).alias("kf"), (F.col("pid") % 3).alias("view_idx")) \
        .agg(F.count("*").alias("n"))
    return S.pack_offsets(c, [], ["kf", "view_idx"])


@query("overlap_windows", """
    WITH d AS (SELECT clip, frame_idx AS pos, tx FROM poses), n AS (SELECT clip, count(*) AS n FROM d GROUP BY clip),
    w AS (SELECT clip, n, k, p FROM n, range(100000) a(k), range(32) b(p) WHERE 22 * k < n),
    f AS (SELECT clip, k, p, least(CASE WHEN k = 0 THEN p WHEN p = 0 THEN 0 WHEN p = 1 THEN 22 * k - 10 ELSE 22 * k + p END, n - 1) AS pos FROM w)
    SELECT f.clip, f.pos, k AS "window", CAST(p AS INT) AS slot, d.tx FROM f JOIN d ON d.clip = f.clip AND d.pos = f.pos""")
def overlap_windows(v):
    d = v.poses.select("clip", F.col("frame_idx").cast("long").alias("pos"), "tx")
    return S.overlap_windows(d, "clip")


@query("consecutive_pairs", """
    SELECT * FROM (SELECT name, frame_idx, value, lead(frame_idx) OVER w AS next_frame_idx, lead(value) OVER w AS next_value
      FROM frames WINDOW w AS (PARTITION BY name ORDER BY frame_idx)) WHERE next_frame_idx IS NOT NULL""")
def consecutive_pairs(v):
    return S.consecutive_pairs(v.frames, ["name"], "frame_idx", ["frame_idx", "value"])


@query("sorted_listing", "SELECT name, status FROM raw_clips ORDER BY name")
def sorted_listing(v):
    return v.raw_clips.select("name", "status").orderBy("name")
