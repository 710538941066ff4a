"""Tables of keyed rows that micro-batches update: only the hash buckets of changed keys are written, and a repeated batch leaves the same table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Upsert:
    """A folder with the rows of each key. A version is what one batch wrote: `data/v=<batch>/bucket=<b>` and, last, the list of its buckets `written/v=<batch>`.

    A reader takes for every bucket the newest version that is listed, so a batch that stopped half-way is not seen; when it runs again it starts from the
    versions before it and overwrites its own. At most `buckets` names come to the driver.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], schema: str, buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path, list(keys), buckets
        self.schema = spark.createDataFrame([], schema).schema
        self.listed: set[int] = set()

    def bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _written(self, before: int | None) -> dict[int, int]:
        """Newest version of each bucket, of those that have rows."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/written")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return {}
        w = self.spark.read.schema("bucket int, n long, v long").option("basePath", f"{self.path}/written").parquet(f"{self.path}/written")
        if before is not None:
            w = w.filter(F.col("v") < before)
        return {r.bucket: r.top.v for r in w.groupBy("bucket").agg(F.max(F.struct("v", "n")).alias("top")).collect() if r.top.n}

    def read(self, before: int | None = None, only: Sequence[int] | None = None) -> DataFrame:
        """Rows as the batches before `before` left them (all batches without it), of some buckets or all."""
        paths = [f"{self.path}/data/v={v}/bucket={b}" for b, v in sorted(self._written(before).items()) if only is None or b in set(only)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame, changed: DataFrame, batch: int) -> None:
        """Replace the rows of the keys in `changed` by `rows`, which must not hold other keys; a key without rows is gone."""
        changed = changed.select(*self.keys).distinct()
        touched = [r.b for r in changed.select(self.bucket().alias("b")).distinct().collect()]
        if not touched:
            return
        kept = self.read(batch, touched).join(changed, self.keys, "left_anti")
        new = kept.unionByName(rows.select(kept.columns)).withColumn("bucket", self.bucket())
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v={batch}")
        data = self.spark.read.schema(f"{self.schema.fields[0].name} {self.schema.fields[0].dataType.simpleString()}, bucket int").parquet(f"{self.path}/data/v={batch}")
        listed = self.spark.createDataFrame([(b,) for b in touched], "bucket int").join(data.groupBy("bucket").agg(F.count("*").alias("n")), "bucket", "left")
        listed.select("bucket", F.coalesce("n", F.lit(0).cast("long")).alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/written/v={batch}")
