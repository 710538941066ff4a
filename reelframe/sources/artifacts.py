"""Pose, intrinsics, depth and point artifacts as partitioned parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.operators.ordered import running


def write_indexed(df: DataFrame, path: str, value: Column, by: str = "clip") -> None:
    """Persist rows whose value is present; the original frame index is kept."""
    df.filter(value.isNotNull()).write.mode("overwrite").partitionBy(by).parquet(path)


def read_indexed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_intrinsics(intr: DataFrame, cameras: DataFrame | None) -> DataFrame:
    """Attach the camera type by frame; without a camera table every camera is a pinhole and a fifth
    parameter is an error."""
    if cameras is None:
        out = intr.withColumn("camera_type", F.lit("PINHOLE"))
        if "k1" in intr.columns:
            out = out.withColumn("camera_type", F.when(
                F.col("k1").isNotNull(), F.raise_error(F.lit("pinhole camera with five parameters")))
                .otherwise(F.col("camera_type")))
        return out
    return intr.join(cameras, ["clip", "frame_idx"], "left") \
        .withColumn("camera_type", F.coalesce("camera_type", F.lit("PINHOLE")))


def fill_corrupt_frames(frames: DataFrame, keys: list[str], order: str, ok: Column, h: str, w: str,
                        payload: str) -> DataFrame:
    """Give every unreadable frame the last good size and an all-NaN payload; error if none came before."""
    d = running(frames, keys, order, {"__hw": ("last", F.when(ok, F.struct(h, w)))})
    bad = F.when(F.col("__hw").isNull(), F.raise_error(F.lit("first frame is unreadable")))
    nan = F.array_repeat(F.lit(float("nan")), F.col(f"__hw.{h}") * F.col(f"__hw.{w}"))
    return d.select(
        *[c for c in frames.columns if c not in (h, w, payload)],
        F.col(f"__hw.{h}").alias(h), F.col(f"__hw.{w}").alias(w),
        bad.otherwise(F.when(ok, F.col(payload).cast("array<double>")).otherwise(nan)).alias(payload))


def scale_points(points: DataFrame, factor: float) -> DataFrame:
    """Multiply the coordinates of a point map."""
    return points.withColumns({c: F.col(c) * F.lit(float(factor)) for c in ("x", "y", "z")})
