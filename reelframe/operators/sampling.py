"""Frame, clip and pixel selection: strides, caps, shards, samples, and clip length changes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.functions.values import present
from reelframe.operators.ordered import rank0, running, shifted, top_k


# --- frames ---------------------------------------------------------------------------------------

def frame_stride(df: DataFrame, start: int, end: int, step: int, idx: str = "frame_idx") -> DataFrame:
    """Every `step`-th frame of [start, end); end = -1 keeps all. The range reaches the scan."""
    i = F.col(idx)
    d = df.filter(i >= start)
    if end >= 0:
        d = d.filter(i < end)
    return d.filter((i - start) % step == 0)


def cap_frames(df: DataFrame, k: int, idx: str = "frame_idx") -> DataFrame:
    """First k frames of each clip with dense indices."""
    return df.filter(F.col(idx) < k)


def cap_frames_gapped(df: DataFrame, keys: list[str], k: int, idx: str = "frame_idx") -> DataFrame:
    """First k frames of each clip when indices have gaps."""
    return top_k(df, keys, [F.col(idx)], k)


def calibration_frames(df: DataFrame, gap_s: float, fps: float, key: str = "name", idx: str = "frame_idx") -> DataFrame:
    """Frames 0, g and 2g with g = min(int(gap_s * fps), (n - 1) // 2)."""
    g = df.groupBy(key).agg(F.count("*").alias("n")).select(
        key, F.least(F.lit(int(gap_s * fps)), F.floor((F.col("n") - 1) / 2)).alias("g"))
    wanted = g.select(key, F.explode(F.array_distinct(F.array(F.lit(0).cast("long"), F.col("g"), F.col("g") * 2)))
                      .alias("__i"))
    d = df.withColumn("__i", F.col(idx).cast("long"))
    return d.join(wanted, [key, "__i"], "left_semi").drop("__i")


def every_nth(df: DataFrame, n: int, offset: int = 0, idx: str = "frame_idx") -> DataFrame:
    """Rows whose index is `offset` modulo n."""
    return df.filter(F.col(idx) % n == offset)


def route_redetect(df: DataFrame, fps: float, gap_s: float = 2.0, idx: str = "frame_idx") -> DataFrame:
    """Mark the frames that take the expensive branch: one every int(fps * gap_s)."""
    return df.withColumn("branch", F.when(F.col(idx) % int(fps * gap_s) == 0, "detect").otherwise("track"))


def chunks(df: DataFrame, keys: list[str], order: str, size: int) -> DataFrame:
    """Number the batches of `size` pending frames; the last batch is the remainder."""
    d = rank0(df, keys, order, "__p")
    return d.withColumn("chunk", F.floor(F.col("__p") / size)).drop("__p")


# --- clips ----------------------------------------------------------------------------------------

def limit_clips(df: DataFrame, k: int, key: str = "name") -> DataFrame:
    return df.orderBy(key).limit(k)


def shard_stride(df: DataFrame, world: int, key: str = "name", block: Column | None = None) -> DataFrame:
    """Clip at sorted position i goes to worker i mod world."""
    return rank0(df, [], key, "__p", block=block).withColumn("rank", F.col("__p") % world).drop("__p")


def shard_hash(df: DataFrame, world: int, key: str = "name") -> DataFrame:
    """Order-free sharding: no sort, no shuffle."""
    return df.withColumn("rank", F.pmod(F.xxhash64(key), F.lit(world)))


def shard_chunk(df: DataFrame, k: int, key: str = "name", block: Column | None = None) -> DataFrame:
    """Contiguous chunks of n // k sorted clips; the last takes the remainder."""
    n = df.select(F.greatest(F.floor(F.count("*") / k), F.lit(1))).scalar()
    return rank0(df, [], key, "__p", block=block) \
        .withColumn("rank", F.least(F.floor(F.col("__p") / n), F.lit(k - 1))).drop("__p")


def min_frames(df: DataFrame, m: int, col: str = "num_frames") -> DataFrame:
    """Keep clips with at least m frames; unreadable counts are dropped, a missing column keeps all."""
    if col not in df.columns:
        return df
    return df.withColumn(col, F.expr(f"try_cast(`{col}` AS DOUBLE)")).filter(F.col(col) >= m)


def seeded_shuffle(df: DataFrame, seed: int, key: str = "name") -> DataFrame:
    """Reproducible position of every clip in an order drawn from the seed."""
    d = df.withColumn("__h", F.xxhash64(key, F.lit(seed)))
    return rank0(d, [], ["__h", key], "pos", block=F.shiftright("__h", 48)).drop("__h")


def select_metrics(df: DataFrame, names: str, col: str = "metric") -> DataFrame:
    """Keep the metrics of a comma list; blanks are ignored."""
    return df.filter(F.col(col).isin([n.strip() for n in names.split(",") if n.strip()]))


def strength_schedule(df: DataFrame, lo: float, hi: float, key: str = "name", digits: int = 4) -> DataFrame:
    """Linear strength over the sorted clips, rounded."""
    n = df.select(F.greatest(F.count("*") - 1, F.lit(1))).scalar()
    return rank0(df, [], key, "__p").withColumn(
        "strength", F.round(F.lit(lo) + F.lit(hi - lo) * F.col("__p") / n, digits)).drop("__p")


# --- detections and pixels ------------------------------------------------------------------------

def confidence(df: DataFrame, threshold: float, logits: str = "logits") -> DataFrame:
    """Keep detections whose best class probability passes the threshold."""
    best = F.array_max(F.transform(logits, lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x.cast("double")))))
    return df.withColumn("score", best).filter(F.col("score") > threshold)


def mask_quality(df: DataFrame, iou_min: float, stability_min: float) -> DataFrame:
    """Predicted IoU above, then stability at or above the thresholds; a threshold of 0 or less is off."""
    if iou_min > 0:
        df = df.filter(F.col("pred_iou") > iou_min)
    if stability_min > 0:
        df = df.filter(F.col("stability") >= stability_min)
    return df


def drop_large_boxes(df: DataFrame, h: float, w: float, ratio: float) -> DataFrame:
    return df.filter((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) <= h * w * ratio)


def drop_near_crop_edge(df: DataFrame, crop: tuple, image: tuple, atol: float = 20.0) -> DataFrame:
    """Drop boxes with a side near the crop edge, unless that side is near the image edge too."""
    near = None
    for c, edge, img in zip(["x0", "y0", "x1", "y1"], crop, image):
        side = (F.abs(F.col(c) - edge) <= atol) & ~(F.abs(F.col(c) - img) <= atol)
        near = side if near is None else near | side
    return df.filter(~near)


def in_frame(df: DataFrame, w: float, h: float, u: str = "u", v: str = "v", disp: str = "disp") -> DataFrame:
    """Projected points strictly inside the image and in front of the camera."""
    c = [F.col(x) for x in (u, v, disp)]
    return df.filter((c[0] > 0) & (c[0] < w) & (c[1] > 0) & (c[1] < h) & present(c[2]))


def zero_out_of_frame(df: DataFrame, w: float, h: float, u: str = "u", v: str = "v", disp: str = "disp") -> DataFrame:
    """Keep every row; flag the valid ones and zero the coordinates of the others."""
    ok = (F.col(u) > 0) & (F.col(u) < w) & (F.col(v) > 0) & (F.col(v) < h) & present(F.col(disp))
    d = df.withColumn("valid", ok)
    return d.withColumns({c: F.when(F.col("valid"), F.col(c)).otherwise(0.0) for c in (u, v)})


def depth_range(df: DataFrame, lo: float, hi: float, eps: float = 1e-4) -> DataFrame:
    d = F.col("depth")
    return df.filter(present(d, eps) & (d > lo) & (d < hi))


def sample_n(df: DataFrame, keys: list[str], n: int, seed: int, at: list[str]) -> DataFrame:
    """n rows per group without replacement, reproducible from the seed; all rows of smaller groups."""
    h = F.xxhash64(*at, F.lit(seed))
    return top_k(df, keys, [h, *[F.col(c) for c in at]], n)


def drop_square_hole(df: DataFrame, u0: Column, v0: Column, length: int) -> DataFrame:
    """Remove the square [u0, u0+length) x [v0, v0+length)."""
    u, v = F.col("u"), F.col("v")
    return df.filter(~((u >= u0) & (u < u0 + length) & (v >= v0) & (v < v0 + length)))


def seeded_hole(df: DataFrame, h: int, w: int, length: int, seed: int, key: str = "frame") -> DataFrame:
    """Square hole at a position drawn per frame from the seed."""
    u0 = F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit("u")), F.lit(w - length))
    v0 = F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit("v")), F.lit(h - length))
    return drop_square_hole(df, u0, v0, length)


def grid_select(df: DataFrame, h: int, w: int, lh: int, lw: int, eps: float = 1e-4) -> DataFrame:
    """Valid pixels on the low-resolution grid int(k * size / low): a closed-form test per axis."""
    def on(c, size, low):
        k = F.ceil(F.col(c) * low / F.lit(float(size)))
        return (F.floor(k * F.lit(size / low)) == F.col(c)) & (k < low)
    return df.filter(on("u", w, lw) & on("v", h, lh) & present(F.col("depth"), eps))


def scanline_cells(spark, lines: int, h: int, w: int, horizontal: int = 200) -> DataFrame:
    """Pixels hit by lines x 200 beams over pitch +-0.5 and yaw +-pi/2.1; at most lines * 200 rows.

    A beam of that pitch and yaw meets the image plane at tan(yaw) and tan(pitch) / cos(yaw) in units of the focal length h.
    """
    def at(i, reach, n):
        return F.lit(-reach) + i * F.lit(2.0 * reach / max(n - 1, 1))

    beams = spark.range(lines * horizontal)
    pitch, yaw = at(F.col("id") % lines, 0.5, lines), at(F.floor(F.col("id") / lines), math.pi / 2.1, horizontal)
    u, v = h * F.tan(yaw) + 0.5 * w, h * F.tan(pitch) / F.cos(yaw) + 0.5 * h
    cells = beams.select(F.bround(u, 0).cast("long").alias("u"), F.bround(v, 0).cast("long").alias("v"))
    return cells.filter((F.col("u") >= 0) & (F.col("u") < w) & (F.col("v") >= 0) & (F.col("v") < h)).distinct()


def scanline_sample(px: DataFrame, lines: int, h: int, w: int, eps: float = 1e-4) -> DataFrame:
    """Valid pixels under the scan lines. The beam table is lines * 200 rows at most, so it is broadcast
    while that stays under 100,000 rows and joined by shuffle beyond."""
    cells = scanline_cells(px.sparkSession, lines, h, w)
    if lines * 200 <= 100_000:
        cells = F.broadcast(cells)
    return px.filter(present(F.col("depth"), eps)).join(cells, ["u", "v"], "left_semi")


def valid_from_instances(px: DataFrame, objects: DataFrame, sky: str) -> DataFrame:
    """A pixel is valid on the background (id 0) or on an instance whose phrase is the sky."""
    ids = objects.filter(F.col("phrase") == sky).select(
        "frame", F.col("obj_id").alias("label"), F.lit(True).alias("__sky")).distinct()
    return px.join(ids, ["frame", "label"], "left") \
        .withColumn("in_mask", (F.col("label") == 0) | F.coalesce("__sky", F.lit(False))).drop("__sky")


# --- clip length ----------------------------------------------------------------------------------

def enumerate_frames(df: DataFrame, keys: list[str], order: str, out: str = "pos") -> DataFrame:
    """Dense 0-based index per stream."""
    return rank0(df, keys, order, out)


def _with_length(df: DataFrame, key: str) -> DataFrame:
    return df.join(df.groupBy(key).agg(F.count("*").alias("__n")), key)


def pingpong_extend(df: DataFrame, n: int, key: str = "name", pos: str = "pos") -> DataFrame:
    """Extend to n frames by reflection without repeating the ends; longer clips are cut. Each frame
    computes the output positions it serves, so only the clip length is joined."""
    d = _with_length(df, key).filter(F.col(pos) < n)
    r, last = F.col(pos), F.lit(n - 1).cast("long")
    period = 2 * (F.col("__n") - 1)
    up = F.sequence(r, last, F.greatest(period, F.lit(1)))
    back = F.when((r > 0) & (r < F.col("__n") - 1) & (period - r <= last),
                  F.sequence(period - r, last, F.greatest(period, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
    return d.withColumn("out_idx", F.explode(F.concat(up, back))).drop("__n")


def pad_last(df: DataFrame, start: int, n: int, key: str = "name", pos: str = "pos") -> DataFrame:
    """n frames from `start`, repeating the last frame beyond the end; start is clamped to the last frame."""
    d = _with_length(df, key)
    s = F.least(F.lit(start), F.col("__n") - 1)
    r, last = F.col(pos), F.col("__n") - 1
    d = d.filter((r >= s) & (r - s < n))
    outs = F.when(r == last, F.sequence(r - s, F.lit(n - 1).cast("long"))).otherwise(F.array(r - s))
    return d.withColumn("out_idx", F.explode(outs)).drop("__n")


def overlap_windows(df: DataFrame, key: str = "name", pos: str = "pos", length: int = 32, step: int = 22,
                    copied: int = 10, keep: int = 8, align: int = 12) -> DataFrame:
    """Overlapping windows of a clip padded with its last frame.

    The first `copied` positions of a later window repeat earlier frames: position 0 is frame 0,
    position 1 is frame step*k - (step - align), the others follow the overlap.
    """
    d = _with_length(df, key)
    starts = d.filter(F.col(pos) % step == 0).select(
        key, "__n", (F.col(pos) / step).cast("long").alias("window"),
        F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("slot"))
    k, p = F.col("window"), F.col("slot")
    f = F.when(k == 0, p).when(p == 0, F.lit(0)).when(p == 1, step * k - (step - align)).otherwise(step * k + p)
    w = starts.select(key, "window", "slot", F.least(f, F.col("__n") - 1).cast("long").alias(pos))
    return w.join(df, [key, pos])


def consecutive_pairs(df: DataFrame, keys: list[str], order: str, cols: list[str]) -> DataFrame:
    """Each frame with the columns of the next frame of its clip."""
    d = shifted(df, keys, order, {"next_" + c: F.col(c) for c in cols}, ahead=True)
    return d.filter(F.col("next_" + cols[0]).isNotNull())


def pack_offsets(counts: DataFrame, keys: list[str], order: list[str], n: str = "n") -> DataFrame:
    """Start offset of each group: exclusive prefix sum of the counts."""
    d = running(counts, keys, order, {"start": ("sum", F.col(n))}, include_current=False)
    return d.withColumn("start", F.coalesce("start", F.lit(0)))
