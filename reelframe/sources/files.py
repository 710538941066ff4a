"""Scratch folders in the shared file system and file listings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.session import shared_dir

IMAGE_EXTS = ["jpg", "jpeg", "png", "bmp", "tiff", "tif"]

# fixed values: artifact kind -> (folder, file suffix) of the nine essential files of a clip
ARTIFACTS = {
    "rgb": ("rgb", ".mp4"), "pose": ("pose", ".npz"), "depth": ("depth", ".zip"),
    "intrinsics": ("intrinsics", ".npz"), "flow": ("flow", ".zip"), "mask": ("mask", ".zip"),
    "mask_phrase": ("mask", ".txt"), "meta_info": ("meta", "_info.pkl"), "meta_vis": ("meta", "_vis.mp4"),
}


def scratch(spark: SparkSession, name: str) -> str:
    """New folder under the session's shared checkpoint folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def list_paths(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """All files under a folder; contents are never read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", glob).load(root).select("path"))


def with_name_parts(paths: DataFrame) -> DataFrame:
    """Add folder, file name, stem and lower-case extension of `path`."""
    base = F.element_at(F.split("path", "/"), -1)
    return paths.select(
        "path",
        F.element_at(F.split("path", "/"), -2).alias("folder"),
        base.alias("file"),
        F.regexp_replace(base, r"\.[^.]*$", "").alias("stem"),
        F.lower(F.regexp_extract(base, r"\.([^.]*)$", 1)).alias("ext"),
    )


def list_clips(paths: DataFrame, exts: list[str]) -> DataFrame:
    """Distinct files with one of the extensions, in either case, sorted by path."""
    return with_name_parts(paths).filter(F.col("ext").isin([e.lower() for e in exts])) \
        .dropDuplicates(["path"]).orderBy("path")


def artifact_index(paths: DataFrame, meta_folder: str = "meta") -> DataFrame:
    """One row per clip with the path of each essential artifact (null when absent) and `complete`.
    `meta_folder` is the folder the writing pipeline keeps its own metadata in."""
    file = F.element_at(F.split("path", "/"), -1)
    folder = F.element_at(F.split("path", "/"), -2)
    kind, clip = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (d, suffix) in ARTIFACTS.items():
        hit = (folder == (meta_folder if d == "meta" else d)) & file.endswith(suffix)
        kind = F.when(hit, F.lit(k)).otherwise(kind)
        clip = F.when(hit, F.expr("substring(element_at(split(path, '/'), -1), 1, "
                                  f"length(element_at(split(path, '/'), -1)) - {len(suffix)})")).otherwise(clip)
    d = paths.select("path", kind.alias("kind"), clip.alias("name")).filter(F.col("kind").isNotNull())
    wide = d.groupBy("name").agg(*[F.max(F.when(F.col("kind") == k, F.col("path"))).alias(k) for k in ARTIFACTS])
    complete = None
    for k in ARTIFACTS:
        complete = F.col(k).isNotNull() if complete is None else complete & F.col(k).isNotNull()
    return wide.withColumn("complete", complete)
