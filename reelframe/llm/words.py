"""Native word and shingle columns shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def split_words(c: Column, gap: str) -> Column:
    """Words of c: what stands between matches of gap, without empty ones; null text has none."""
    return F.array_remove(F.split(F.coalesce(c.cast("string"), F.lit("")), gap), "")


def rolling(df: DataFrame, words: str, k: int, keep: list[str]) -> DataFrame:
    """A row per run of k words: keep, `pos` from 0, `g0`..`g{k-1}`; of a row with 1 to k-1 words the whole sequence, the rest of it null."""
    w = F.col(words)
    parts = [w, *(F.slice(w, i + 1, F.greatest(F.size(w), F.lit(1))) for i in range(1, k))]
    zipped = F.arrays_zip(*(p.alias(f"g{i}") for i, p in enumerate(parts)))
    out = df.select(*keep, (F.size(w) < k).alias("_few"), F.posexplode(zipped).alias("pos", "_g"))
    out = out.filter(F.col(f"_g.g{k - 1}").isNotNull() | (F.col("_few") & (F.col("pos") == 0)))
    return out.select(*keep, "pos", *(F.col(f"_g.g{i}").alias(f"g{i}") for i in range(k)))
