"""Keypoint tracks: correspondences, displacement, persistence and loss."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.operators.ordered import rank0, shifted
from reelframe.operators.points import bilinear_splat


def consecutive_frames(obs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs (keys, view_id, a, b) of existing frames and the frame after them; `keys` name the clip."""
    f = obs.select(*keys, "view_id", F.col("frame").alias("a")).distinct()
    nxt = obs.select(*keys, "view_id", (F.col("frame") - 1).alias("a")).distinct()
    return f.join(nxt, [*keys, "view_id", "a"], "left_semi").withColumn("b", F.col("a") + 1)


def correspondences(obs: DataFrame, pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Keypoints seen in both frames of each pair (keys, view_id, a, b), with both positions."""
    s = obs.select(*keys, "view_id", F.col("frame").alias("a"), "kp", F.col("u").alias("ua"), F.col("v").alias("va"))
    t = obs.select(*keys, "view_id", F.col("frame").alias("b"), "kp", F.col("u").alias("ub"), F.col("v").alias("vb"))
    return s.join(pairs, [*keys, "view_id", "a"]).join(t, [*keys, "view_id", "b", "kp"])


def common_keypoints(obs: DataFrame, step: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """Keypoints of each frame that are also in the frame `step` later."""
    later = obs.select(*keys, "view_id", (F.col("frame") - step).alias("frame"), "kp")
    return obs.select(*keys, "view_id", "frame", "kp").intersect(later)


def displacement(obs: DataFrame, pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    c = correspondences(obs, pairs, keys)
    return c.groupBy(*keys, "view_id", "a", "b").agg(
        F.count("*").alias("n"), F.avg(F.hypot(F.col("ub") - F.col("ua"), F.col("vb") - F.col("va"))).alias("mean_disp"))


def track_grid(obs: DataFrame, pairs: DataFrame, h: int, w: int, fu: float, fv: float, keys: Sequence[str] = ()) -> DataFrame:
    """Keypoint flow splatted to a grid as target coordinates; weights below 0.1 count as 0."""
    c = correspondences(obs, pairs, keys)
    d = c.select(*keys, "view_id", "a", "b", (F.col("ua") * fu).alias("u"), (F.col("va") * fv).alias("v"),
                 ((F.col("ub") - F.col("ua")) * fu).alias("du"), ((F.col("vb") - F.col("va")) * fv).alias("dv"))
    g = bilinear_splat(d, [*keys, "view_id", "a", "b"], h, w, ["du", "dv"])
    weak = F.col("weight") < 0.1
    z = lambda c: F.when(weak, 0.0).otherwise(F.coalesce(c, F.lit(0.0)))
    return g.select(*keys, "view_id", "a", "b", "x", "y", (z("du") + F.col("x")).alias("tu"), (z("dv") + F.col("y")).alias("tv"),
                    F.when(weak, 0.0).otherwise(F.col("weight")).alias("weight"))


def persistence(obs: DataFrame, limit: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Number of preceding keyframes through which a keypoint stayed visible without a gap, at most `limit`.
    An island of visibility has a constant difference of keyframe rank and row rank."""
    view = [*keys, "view_id"]
    kf = rank0(obs.select(*view, "frame").distinct(), view, "frame", "kf")
    d = obs.select(*view, "frame", "kp").join(kf, [*view, "frame"])
    d = rank0(d, [*view, "kp"], "kf", "__r").withColumn("__isle", F.col("kf") - F.col("__r"))
    first = d.groupBy(*view, "kp", "__isle").agg(F.min("kf").alias("__first"))
    return d.join(first, [*view, "kp", "__isle"]).select(
        *view, "frame", "kp", F.least(F.col("kf") - F.col("__first"), F.lit(limit)).alias("chain"))


def track_loss(obs: DataFrame, pairs: DataFrame, ratio: float = 0.2, keys: Sequence[str] = ()) -> DataFrame:
    """Flag the frames whose number of tracks in common with the frame before fell by more than `ratio`, per `keys` (as the clip).

    Every second frame of `pairs` is there: where no track survives, the count is 0.
    """
    frames = pairs.select(*keys, F.col("b").alias("frame")).distinct()
    n = correspondences(obs, pairs, keys).groupBy(*keys, F.col("b").alias("frame")).agg(F.count("*").alias("n"))
    d = frames.join(n, [*keys, "frame"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    d = shifted(d, keys, "frame", {"last_n": F.col("n")})
    drop = (F.col("last_n") > 0) & ((F.col("last_n") - F.col("n")) / F.col("last_n") > ratio)
    return d.select(*keys, "frame", "n", "last_n", F.coalesce(drop, F.lit(False)).alias("lost"))
