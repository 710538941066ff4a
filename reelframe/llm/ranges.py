"""Totals over everything that stands earlier in a global order, without a task that sees the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelframe.session import staged


def totals_before(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """df with, for every entry of `sums`, the sum of its column over all rows that stand before the row in `order`.

    Rows are dealt to ranges of the order, so that a hot value of its first column takes as many ranges as it needs; a range is summed by
    itself, and what the ranges before it hold is joined to it: one row per range. Equal rows of the order follow each other in any way.
    """
    cols = {f"_o{i}": c for i, c in enumerate(order)} | {f"_x_{k}": c.cast("long") for k, c in sums.items()}
    keys = [f"_o{i}" for i in range(len(order))]
    dealt = staged(df.select("*", *(c.alias(k) for k, c in cols.items())).repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), name)
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    whole = dealt.groupBy("_range").agg(*(F.sum(f"_x_{k}").alias(f"_x_{k}") for k in sums))
    base = whole.select("_range", *(F.coalesce(F.sum(f"_x_{k}").over(ahead), F.lit(0)).alias(f"_b_{k}") for k in sums))
    inside = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.select("*", *(F.coalesce(F.sum(f"_x_{k}").over(inside), F.lit(0)).alias(f"_l_{k}") for k in sums))
    return local.join(base, "_range").select(*df.columns, *((F.col(f"_b_{k}") + F.col(f"_l_{k}")).alias(k) for k in sums))
