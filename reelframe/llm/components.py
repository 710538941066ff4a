"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.session import staged


def _least(pairs: DataFrame, name: str) -> DataFrame:
    """Smallest partner of each `u`; written, so that the join back is between two plain shuffles, which adaptive execution can split at a hub."""
    return staged(pairs.groupBy("u").agg(F.min("v").alias("m")), name)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of links: root is the smallest node that can be reached. Null ends and self links are left out.

    Each round hangs larger neighbours, then smaller ones, on the smallest one they know; rounds grow with the logarithm of the
    longest chain, and a round whose links are those of the one before is the last. Each round is written to the shared folder.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter((F.col(a) != F.col(b)) & F.col(a).isNotNull() & F.col(b).isNotNull()).distinct()
    edges = staged(edges, "links")
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = both.join(_least(both, "links-up"), "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        up = staged(up, "links")
        down = up.join(_least(up, "links-down"), "u")
        edges = staged(down.select("u", F.col("m").alias("v")).unionByName(down.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), "links")
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
