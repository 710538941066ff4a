"""Sources and sinks shared by the streaming operators. Nothing here opens a port or keeps rows on the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.sources.files import scratch

def table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 64) -> DataFrame:
    """Parquet table of a folder as a stream, whether it is one file or a folder of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # as a pattern the path may name either; a plain path would have to be a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/{name}.parque[t]")


def folder_stream(df_like: DataFrame, folder: str, fmt: str = "parquet", files_per_batch: int = 64) -> DataFrame:
    """Files of a folder as a stream with the schema of a table."""
    return df_like.sparkSession.readStream.schema(df_like.schema).option("maxFilesPerTrigger", files_per_batch) \
        .option("recursiveFileLookup", "true").format(fmt).load(folder)


def run_append(stream: DataFrame) -> DataFrame:
    """Run what is available through an append-mode file sink and return the written table."""
    spark = stream.sparkSession
    path = scratch(spark, "stream")
    q = (stream.writeStream.format("parquet").option("path", path + "/data").option("checkpointLocation", path + "/ckpt")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path + "/data")


def run_batches(stream: DataFrame, step: Callable[[DataFrame, int, str], DataFrame | None], mode: str = "append",
                schema=None) -> DataFrame:
    """Run what is available and let `step(batch, id, folder)` give the rows to store for each batch.

    Every batch has its own folder that is overwritten, so a batch that runs again after a failure leaves
    the same result.
    """
    spark = stream.sparkSession
    path = scratch(spark, "stream")

    def write(batch: DataFrame, batch_id: int) -> None:
        out = step(batch, batch_id, path + "/data")
        if out is not None:
            out.write.mode("overwrite").parquet(f"{path}/data/batch={batch_id}")

    q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", path + "/ckpt")
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    r = spark.read.option("basePath", path + "/data")
    return (r.schema(schema) if schema is not None else r).parquet(path + "/data")


def bounded(df: DataFrame, time: str, delay: str | None) -> DataFrame:
    """A watermark bounds the state and loses rows that come later than it; without one, as for a finite table, none is lost."""
    return df.withWatermark(time, delay) if delay else df


def event_time(ts: str = "ts") -> Column:
    return F.col(ts).cast("timestamp")


def stamp_order(spark: SparkSession, folder: str, glob: str = "part-*") -> int:
    """Give the files of a folder modification times in the order of their names, as if they had arrived one after the other; returns their number.
    A file stream reads in order of these times. For file systems that keep times that are set (local, HDFS)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder + "/" + glob)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().toString() for s in fs.globStatus(path))
    for k, name in enumerate(names):
        fs.setTimes(jvm.org.apache.hadoop.fs.Path(name), 1_000_000_000_000 + 1000 * k, -1)
    return len(names)
