"""Session settings and lineage cuts shared by the operators."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # without it every column expression built in Python records its call site
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cpus: str = "8", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName("reelframe")
    for k, v in SETTINGS.items():
        b = b.config(k, v)
    spark = (
        b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the session's Python workers, once per context; they need not find it on their own paths."""
    sc = spark.sparkContext
    if not getattr(sc, "_reelframe_shipped", False):
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="reelframe-zip-"), "reelframe"), "zip", root, "reelframe")
        sc.addPyFile(made)
        sc._reelframe_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Checkpoint folder named by the session. Where none is named, a local master gets a temporary one; a cluster gets an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="reelframe-ckpt-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df below the shared folder and read it back: cuts the lineage, and later scans read the result instead of making it again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Materialise a loop state in the shared folder, so a lost executor restarts from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffled(df: DataFrame) -> DataFrame:
    """Side of a join that grows with the input: it is shuffled and sorted. Left to the planner, one of 10 MB as written can be a broadcast of many times that, made on the driver."""
    return df.hint("merge")
