"""Queries over pairing, merging and frame quality."""

from pyspark.sql import functions as F

from reelframe.functions import arrays as X
from reelframe.operators import scoring as Q
from reelframe.operators.sampling import strength_schedule
from reelframe.plans.registry import query


def second_run(v):
    return v.frame_scores.withColumn("value", F.col("value") + (F.col("name") % 5) * 1e-4)


_CLIP = "SELECT rank, name, metric, avg(value) AS value FROM frame_scores GROUP BY rank, name, metric"


def _clip(v):
    return Q.clip_scores(v.frame_scores, ["rank", "name", "metric"])


@query("merge_scores", f"""
    WITH c AS ({_CLIP}), p AS (SELECT metric, rank, sum(value) AS s, count(*) AS n FROM c GROUP BY metric, rank)
    SELECT metric, CAST(sum(n) AS BIGINT) AS n, round(sum(s) / sum(n), 6) AS mean, round(avg(s / n), 6) AS mean_of_means,
           round(avg(s / n) - sum(s) / sum(n), 6) AS bias FROM p GROUP BY metric""")
def merge_scores(v):
    paired = Q.keep_wanted(v.frame_scores, Q.pair_clips(v.raw_clips, v.gen_clips).select("name"))
    d = Q.merge_scores(Q.clip_scores(paired, ["rank", "name", "metric"]))
    return d.select("metric", "n", *[F.round(c, 6).alias(c) for c in ("mean", "mean_of_means", "bias")])


@query("mean_of_means", f"""
    WITH c AS ({_CLIP}), p AS (SELECT metric, rank, avg(value) AS m, sum(value) AS s, count(*) AS n FROM c GROUP BY metric, rank)
    SELECT metric, round(avg(m), 6) AS mean_of_means, round(sum(s) / sum(n), 6) AS weighted_mean FROM p GROUP BY metric""")
def mean_of_means(v):
    return Q.merge_scores(_clip(v)).select("metric", F.round("mean_of_means", 6).alias("mean_of_means"),
                                           F.round("mean", 6).alias("weighted_mean"))


@query("clip_scores", """
    SELECT name, round(avg(CASE WHEN metric = 'clip' THEN value END), 6) AS clip,
           round(avg(CASE WHEN metric = 'lpips' THEN value END), 6) AS lpips,
           round(avg(CASE WHEN metric = 'ssim' THEN value END), 6) AS ssim FROM frame_scores GROUP BY name""")
def clip_scores(v):
    m = ["clip", "lpips", "ssim"]
    return Q.clip_scores_wide(v.frame_scores, m).select("name", *[F.round(c, 6).alias(c) for c in m])


@query("dedupe_last_wins", """
    SELECT run, clip, rank, sample_id, wall_s FROM (
      SELECT *, sample_id % 500 AS clip, row_number() OVER (PARTITION BY run, sample_id % 500 ORDER BY rank DESC, sample_id DESC) AS k
      FROM sample_timing) WHERE k = 1""")
def dedupe_last_wins(v):
    d = v.sample_timing.select("run", (F.col("sample_id") % 500).alias("clip"), "rank", "sample_id", "wall_s")
    return Q.dedupe_last_wins(d, ["run", "clip"], ["rank", "sample_id"])


@query("parity_diff", """
    WITH b AS (SELECT name, frame_idx, metric, value + (name % 5) * 1e-4 AS value FROM frame_scores WHERE name % 97 <> 0),
    a AS (SELECT name, frame_idx, metric, value FROM frame_scores WHERE name % 89 <> 0),
    j AS (SELECT metric, a.value AS a, b.value AS b FROM a FULL JOIN b USING (name, frame_idx, metric))
    SELECT metric, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS matched, count(*) FILTER (b IS NULL) AS only_a,
           count(*) FILTER (a IS NULL) AS only_b, round(max(abs(a - b)), 9) AS max_abs,
           round(max(abs(a - b) / abs(a)), 9) AS max_rel, round(avg(abs(a - b) / abs(a)), 9) AS mean_rel FROM j GROUP BY metric""")
def parity_diff(v):
    # each run misses some clips of the other
    a, b = v.frame_scores.filter("name % 89 <> 0"), second_run(v).filter("name % 97 <> 0")
    return Q.parity_diff(a, b, ["name", "frame_idx", "metric"]).select(
        "metric", "matched", "only_a", "only_b", *[F.round(c, 9).alias(c) for c in ("max_abs", "max_rel", "mean_rel")])


@query("mean_by_name", "SELECT metric, round(avg(value), 6) AS mean FROM frame_scores GROUP BY metric")
def mean_by_name(v):
    return Q.mean_by_name(v.frame_scores, "metric", "value").select("metric", F.round("mean", 6).alias("mean"))


@query("dataset_totals", """
    WITH s AS (SELECT frames, round(0.2 + 0.6 * (row_number() OVER (ORDER BY name) - 1) / greatest(1, (SELECT count(*) FROM gen_clips) - 1), 4) AS strength FROM gen_clips)
    SELECT count(*) AS pairs, CAST(sum(frames) AS BIGINT) AS frames, min(strength) AS strength_min, max(strength) AS strength_max FROM s""")
def dataset_totals(v):
    return Q.dataset_totals(strength_schedule(v.gen_clips, 0.2, 0.8))


@query("pair_clips", "SELECT name, status, num_frames, frames FROM raw_clips JOIN gen_clips USING (name)")
def pair_clips(v):
    return Q.pair_clips(v.raw_clips, v.gen_clips)


@query("pair_frames", """
    SELECT name, frame_idx, metric, a.value AS raw_value, a.value + (name % 5) * 1e-4 AS gen_value
    FROM frame_scores a WHERE frame_idx <= name % 7""")
def pair_frames(v):
    # generated clips of their own lengths
    return Q.pair_frames(v.frame_scores, second_run(v).filter("frame_idx <= name % 7"), ["name", "frame_idx", "metric"])


@query("select_clips_semi", """
    SELECT name, frames FROM gen_clips WHERE name IN (SELECT name FROM raw_clips WHERE status = 'F')""")
def select_clips_semi(v):
    return Q.keep_wanted(v.gen_clips, v.raw_clips.filter("status = 'F'"))


@query("missing_inputs_anti", "SELECT name, status FROM raw_clips WHERE name NOT IN (SELECT name FROM gen_clips)")
def missing_inputs_anti(v):
    return Q.missing_inputs(v.raw_clips, v.gen_clips).select("name", "status")


@query("skip_existing_anti", "SELECT name, status FROM raw_clips WHERE name NOT IN (SELECT name FROM gen_clips WHERE frames >= 4)")
def skip_existing_anti(v):
    return Q.skip_existing(v.raw_clips, v.gen_clips.withColumn("complete", F.col("frames") >= 4)).select("name", "status")


@query("missing_shards", "SELECT k AS rank FROM range(16) r(k) WHERE k NOT IN (SELECT rank FROM sample_timing)")
def missing_shards(v):
    return Q.missing_shards(v.sample_timing, 16)


@query("frechet_distance")
def frechet_distance(v):
    return Q.frechet_distance(v.embedding_set, "set_name", "embedding", "raw", "gen")


@query("set_moments", """
    WITH e AS (SELECT set_name, vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embedding_set)
    SELECT a.set_name, CAST(a.i AS INT) AS i, CAST(b.i AS INT) AS j, count(*) AS n, round(avg(a.x), 6) AS mean_i, round(avg(b.x), 6) AS mean_j,
           round(covar_samp(a.x, b.x), 6) AS cov
    FROM e a JOIN e b ON a.set_name = b.set_name AND a.vec_id = b.vec_id GROUP BY 1, 2, 3""")
def set_moments(v):
    return Q.set_moments(v.embedding_set, "set_name", "embedding").select(
        "set_name", "i", "j", "n", *[F.round(c, 6).alias(c) for c in ("mean_i", "mean_j", "cov")])


def frame_pairs(v):
    """Raw and generated frame arrays in 0..1, one row per pair."""
    px = F.transform("px_raw", lambda x: (x.cast("double") + 1) / 2)
    d = v.frame_px.select("pair_id", "side", "h", "w", px.alias("px"))
    return d.filter("side = 'raw'").select("pair_id", "h", "w", F.col("px").alias("a")).join(
        d.filter("side = 'gen'").select("pair_id", F.col("px").alias("b")), "pair_id")


_PAIRS = """
    SELECT pair_id, a.px_raw AS ra, b.px_raw AS rb FROM (SELECT * FROM frame_px WHERE side = 'raw') a
    JOIN (SELECT * FROM frame_px WHERE side = 'gen') b USING (pair_id)"""


@query("psnr", f"""
    WITH p AS ({_PAIRS}), d AS (SELECT pair_id, unnest(ra)::DOUBLE AS x, unnest(rb)::DOUBLE AS y FROM p)
    SELECT pair_id, round(-10 * log10(avg(((x + 1) / 2 - (y + 1) / 2) ** 2)), 6) AS psnr FROM d GROUP BY pair_id""")
def psnr(v):
    return frame_pairs(v).select("pair_id", F.round(Q.psnr(F.col("a"), F.col("b")), 6).alias("psnr"))


@query("ssim")
def ssim(v):
    return frame_pairs(v).select("pair_id", Q.ssim("a", "b", "h", "w", F.lit(1)).alias("ssim"))


@query("embedding_similarity", f"""
    WITH p AS ({_PAIRS}), d AS (SELECT pair_id, unnest(ra)::DOUBLE AS x, unnest(rb)::DOUBLE AS y FROM p)
    SELECT pair_id, round(sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 6) AS clip_i FROM d GROUP BY pair_id""")
def embedding_similarity(v):
    d = v.frame_px.select("pair_id", "side", "px_raw")
    j = d.filter("side = 'raw'").select("pair_id", F.col("px_raw").alias("a")).join(
        d.filter("side = 'gen'").select("pair_id", F.col("px_raw").alias("b")), "pair_id")
    return j.select("pair_id", F.round(Q.embedding_similarity(F.col("a"), F.col("b")), 6).alias("clip_i"))


@query("epe", """
    SELECT frame, round(avg(sqrt((depth - target) ** 2 + (target - depth / 2) ** 2)), 6) AS epe FROM depth_px GROUP BY frame""")
def epe(v):
    k = ["frame", "u", "v"]
    a = v.depth_px.select(*k, F.col("depth").alias("du"), F.col("target").alias("dv"))
    b = v.depth_px.select(*k, F.col("target").alias("du"), (F.col("depth") / 2).alias("dv"))
    return Q.epe(a, b, k, ["frame"]).select("frame", F.round("epe", 6).alias("epe"))


@query("vector_stats", """
    WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embedding_set),
    p AS (SELECT *, exp(x - max(x) OVER w) / sum(exp(x)) OVER w * exp(max(x) OVER w) AS p FROM e WINDOW w AS (PARTITION BY vec_id))
    SELECT vec_id, max(x) AS max, min(x) AS min, round(avg(x), 6) AS mean, round(var_samp(x), 6) AS var, round(stddev_samp(x), 6) AS sd,
           round(-sum(p * ln(p + 1e-9)), 6) AS entropy FROM p GROUP BY vec_id""")
def vector_stats(v):
    d = v.embedding_set.select("vec_id", X.vector_stats(F.col("embedding")).alias("s"))
    return d.select("vec_id", "s.max", "s.min", *[F.round("s." + c, 6).alias(c) for c in ("mean", "var", "sd", "entropy")])


@query("sigmoid_softmax", """
    WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS a, list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE))) AS z,
                      sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embedding_set)
    SELECT vec_id, round(1 / (1 + exp(-a)), 6) AS sigmoid, round(ln(greatest(least(greatest(a, 0), 1), 1e-3) / greatest(1 - least(greatest(a, 0), 1), 1e-3)), 6) AS inv_sigmoid,
           round(exp(a) / z, 6) AS softmax, round(a / n, 6) AS unit FROM e""")
def sigmoid_softmax(v):
    e = F.col("embedding")
    return v.embedding_set.select(
        "vec_id", F.round(X.sigmoid(e[0]), 6).alias("sigmoid"), F.round(X.inverse_sigmoid(e[0]), 6).alias("inv_sigmoid"),
        F.round(X.softmax(e)[0], 6).alias("softmax"), F.round(X.l2_normalise(e)[0], 6).alias("unit"))


_P = "(px_raw[{}]::DOUBLE + 1) / 2"


@query("contrast_drift", """
    WITH d AS (SELECT vec_id, unnest(range(64)) AS i, (unnest(px_raw)::DOUBLE + 1) / 2 * 255 AS x, (vec_id % 10) / 10.0::DOUBLE AS s FROM frame_px)
    SELECT vec_id, i::INT AS i, round(least(greatest(x * (1 - 0.1 * s) + 128 * 0.1 * s, 0), 255), 6) AS x FROM d""")
def contrast_drift(v):
    x = F.transform("px_raw", lambda p: (p.cast("double") + 1) / 2 * 255)
    d = v.frame_px.select("vec_id", X.contrast_drift(x, (F.col("vec_id") % 10) / F.lit(10.0)).alias("px"))
    return d.select("vec_id", F.posexplode("px").alias("i", "x")).withColumn("x", F.round("x", 6))


@query("u8_float", """
    WITH d AS (SELECT vec_id, unnest(range(64)) AS i, (unnest(px_raw)::DOUBLE + 1) / 2 AS x FROM frame_px),
    e AS (SELECT *, CAST(floor(least(greatest(x, 0), 1) * 255.0) AS INT) AS u8 FROM d)
    SELECT vec_id, i::INT AS i, u8, round(u8 / 255.0::DOUBLE, 6) AS unit, round((u8 / 255.0::DOUBLE - 0.5) / 0.5, 6) AS signed FROM e""")
def u8_float(v):
    x = F.transform("px_raw", lambda p: (p.cast("double") + 1) / 2)
    d = v.frame_px.select("vec_id", X.unit_to_u8(x).alias("u8"))
    unit = X.u8_to_unit(F.col("u8"))
    d = d.select("vec_id", F.posexplode(F.arrays_zip("u8", unit.alias("unit"), X.to_signed_unit(unit).alias("signed"))).alias("i", "z"))
    return d.select("vec_id", "i", "z.u8", F.round("z.unit", 6).alias("unit"), F.round("z.signed", 6).alias("signed"))


@query("frame_crop", """
    SELECT vec_id, CAST(k AS INT) AS i, px_raw[(floor(k / 4) + 2)::INT * 8 + k % 4 + 3 + 1] AS x FROM frame_px, range(12) r(k)""")
def frame_crop(v):
    d = v.frame_px.select("vec_id", X.crop(F.col("px_raw"), F.col("w"), 2, 3, 3, 4).alias("px"))
    return d.select("vec_id", F.posexplode("px").alias("i", "x"))


@query("channel_renorm", """
    WITH d AS (SELECT vec_id, unnest(range(64)) AS i, unnest(px_raw)::DOUBLE AS x FROM frame_px)
    SELECT vec_id, i::INT AS i, round(x * ([0.229, 0.224])[i % 2 + 1]::DOUBLE + ([0.485, 0.456])[i % 2 + 1]::DOUBLE, 6) AS x FROM d""")
def channel_renorm(v):
    d = v.frame_px.select("vec_id", X.channel_renorm(F.col("px_raw"), [0.485, 0.456], [0.229, 0.224]).alias("px"))
    return d.select("vec_id", F.posexplode("px").alias("i", "x")).withColumn("x", F.round("x", 6))


@query("union_shards", """
    SELECT * FROM frame_scores WHERE rank < 3 UNION ALL SELECT * FROM frame_scores WHERE rank >= 3""")
def union_shards(v):
    return v.frame_scores.filter("rank < 3").unionByName(v.frame_scores.filter("rank >= 3"))


@query("stream_truncation", """
    SELECT name, declared AS frames, coalesce(n, 0) AS actual FROM (SELECT name, frames + name % 2 AS declared FROM gen_clips)
    LEFT JOIN (SELECT name, count(*) AS n FROM frames GROUP BY name) USING (name) WHERE coalesce(n, 0) < declared""")
def stream_truncation(v):
    d = v.gen_clips.select("name", (F.col("frames") + F.col("name") % 2).alias("frames"))
    return Q.truncated_clips(d, v.frames)
