"""Exact copies: combined in each input partition, then per salted digest, then per digest, always by the whole text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.session import staged


def sha256(c: Column) -> Column:
    return F.coalesce(F.sha2(c, 256), F.lit(""))  # never null, so that joins on it need no null filter


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same characters; null counts as empty, so null and empty texts form one group. keep_id is the
    largest id of the group. Rows that repeat id and text are all counted and all kept or all dropped. Null ids lose to any id; where a
    group has null ids only, keep_id is null and its rows are kept. An empty table gives an empty result; other columns are not looked at.

    The grouping keys hold the text itself, so map tasks first combine their own copies, each of `salts` parts of a digest is combined
    next (a hot text reaches at most one row per map task and part), and the winners of the parts meet last. A digest under which
    several texts meet is told from the others by count, and its rows are joined by text.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    rows = rows.withColumn("sha", digest(F.col("body")))
    winner = lambda n: [F.max("top").alias("top"), F.sum(n).alias("n")]
    parts = rows.select("sha", "body", F.col("doc_id").alias("top"), F.lit(1).cast("long").alias("n"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"))
    salted = parts.groupBy("sha", "salt", "body").agg(*winner("n"))
    merged = salted.repartition("sha").groupBy("sha", "body").agg(*winner("n"))
    groups = staged(merged.groupBy("sha").agg(F.count("*").alias("texts"), *winner("n")), "exact-groups")

    def shaped(df: DataFrame) -> DataFrame:
        return df.select("doc_id", F.col("top").alias("keep_id"), F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("top")).alias("kept"), F.col("text_sha256"))

    named = rows.select("doc_id", "sha", (F.col("sha") if digest is sha256 else sha256(F.col("body"))).alias("text_sha256"))
    out = shaped(named.join(groups.filter("texts = 1"), "sha"))
    clashes = groups.filter("texts > 1").select("sha")
    if clashes.isEmpty():
        return out
    met = rows.join(clashes, "sha", "left_semi")
    by_text = staged(met.groupBy("sha", "body").agg(F.max("doc_id").alias("top"), F.count("*").alias("n")), "exact-clashes")
    return out.unionByName(shaped(met.join(by_text, ["sha", "body"]).withColumn("text_sha256", sha256(F.col("body")))))
