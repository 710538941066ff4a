"""Shard, sweep, manifest, log and trace readers, and the writers that produce shard payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe import schemas

# fixed values: start of a worker's progress line, its further fields, and a crash line
LOG_PATTERN = r"^\[rank (\d+)\] (\d+)/(\d+) (\S+) wall=([0-9.]+)s"
LOG_FIELDS = {"cpu_s": r" cpu=([0-9.]+)s", "gpu_busy_s": r" gpu_busy=([0-9.]+)s", "cache_s": r" cache=([0-9.]+)s", "gpu_util": r" gpu_util=([0-9.]+)%", "cores_busy": r" cores_busy=([0-9.]+)"}
FAILED_PATTERN = r"^\[rank (\d+)\] FAILED ([^:\s]+): (.*)$"

def scan_shards(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Shard payloads under a folder (one JSON document per line or file); error when there are none."""
    r = spark.read.schema(schemas.SHARD).option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob).option("multiLine", "true")
    df = r.json(path)
    if df.isEmpty():
        raise FileNotFoundError(f"no shard files under {path}")
    return df


def explode_results(shards: DataFrame) -> DataFrame:
    """One row per clip and metric."""
    return shards.select("rank", F.explode("results").alias("r")).select(
        "rank", F.col("r.name").alias("name"), F.col("r.frames").alias("frames"),
        F.explode("r.scores").alias("metric", "value"))


def explode_per_sample(shards: DataFrame) -> DataFrame:
    """One timing row per clip."""
    return shards.select("rank", F.posexplode("per_sample").alias("pos", "s")).select("rank", "pos", "s.*")


def drop_private(df: DataFrame, heavy: tuple[str, ...] = ()) -> DataFrame:
    """Drop columns with a leading underscore and the named heavy ones."""
    return df.select([c for c in df.columns if not c.startswith("_") and c not in heavy])


def shard_payloads(results: DataFrame, rank: str, field: str, per_payload: int, part: Column) -> DataFrame:
    """Group result rows into payload documents of one worker.

    `part` splits a worker's rows so that a payload never holds more than `per_payload` of them; a
    worker with many results gets many payloads.
    """
    cols = [c for c in drop_private(results).columns if c != rank]
    return (
        results.groupBy(F.col(rank).cast("int").alias("rank"), F.floor(part / per_payload).alias("part"))
        .agg(F.collect_list(F.struct(*cols)).alias(field))
    )


def write_shards(payloads: DataFrame, path: str) -> None:
    """Payloads as JSON, one folder per worker."""
    payloads.withColumn("worker", F.col("rank")).drop("part").write.mode("overwrite") \
        .partitionBy("worker").json(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """Summary records as JSON."""
    summary.write.mode("overwrite").json(path)


def scan_load_trace(spark: SparkSession, path: str) -> DataFrame:
    """Text lines `epoch l1 l5 l15`."""
    return spark.read.schema(schemas.LOAD_TRACE).option("sep", " ").csv(path) \
        .select(F.timestamp_seconds("epoch").alias("ts"), "l1", "l5", "l15")


def scan_metadata_csv(spark: SparkSession, path: str) -> DataFrame:
    """Clip list from CSV; the column `sequence` is required."""
    df = spark.read.option("header", "true").csv(path)
    if "sequence" not in df.columns:
        raise ValueError(f"column 'sequence' missing in {path}: {df.columns}")
    return df


def scan_manifest(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Manifest documents, one row per clip."""
    m = spark.read.schema(schemas.MANIFEST).option("multiLine", str(multiline).lower()).json(path)
    return m.select("source", "resolution", "fps", "seed", "strength_range", F.explode("videos").alias("v")) \
        .select("source", "resolution", "fps", "seed", "strength_range", "v.*")


def scan_sweep(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Sweep documents, one row per run."""
    s = spark.read.schema(schemas.SWEEP).option("multiLine", str(multiline).lower()).json(path)
    return s.select(F.explode("rows").alias("r")).select("r.*")


def read_summary(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """First summary file of the list that exists; an empty table when none does."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        if hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hp):
            return spark.read.schema(schema).json(p)
    return spark.createDataFrame([], schema)


def parse_logs(lines: DataFrame, col: str = "line") -> DataFrame:
    """Worker progress lines as columns, with null for fields a line does not have, and crash lines with their error; other lines are dropped."""
    done, failed = F.col(col).rlike(LOG_PATTERN), F.col(col).rlike(FAILED_PATTERN)
    g = lambda n, kind: F.when(done, F.regexp_extract(col, LOG_PATTERN, n)).cast(kind)
    x = lambda n: F.regexp_extract(col, FAILED_PATTERN, n)
    more = [F.when(done, F.regexp_extract(col, pattern, 1)).try_cast("double").alias(name) for name, pattern in LOG_FIELDS.items()]
    return lines.filter(done | failed).select(
        *[c for c in lines.columns if c != col],
        F.coalesce(g(1, "int"), F.when(failed, x(1)).cast("int")).alias("rank"), g(2, "int").alias("i"), g(3, "int").alias("n"),
        F.coalesce(g(4, "string"), F.when(failed, x(2))).alias("name"), g(5, "double").alias("wall_s"), *more, F.when(failed, x(3)).alias("error"))


def parse_phrases(lines: DataFrame, col: str = "value") -> DataFrame:
    """`id: phrase` lines, split at the first colon only."""
    p = F.split(F.col(col), ":", 2)
    return lines.select(*[c for c in lines.columns if c != col],
                        F.trim(p[0]).cast("int").alias("obj_id"), F.trim(p[1]).alias("phrase"))


def combined_phrases(df: DataFrame) -> DataFrame:
    """Phrase per object id over all frames; the last frame wins."""
    return df.groupBy("obj_id").agg(F.max_by("phrase", F.struct("frame", "phrase")).alias("phrase"))
