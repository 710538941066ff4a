"""Benchmark items inside documents: size-partitioned MinHash search for containment, then exact shingle containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.llm.words import rolling, split_words
from reelframe.session import staged

GAP = r"[^\p{L}\p{N}]+"


def words(c: Column) -> Column:
    return split_words(F.lower(c.cast("string")), GAP)


def leaking_texts(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_text: str = "text", k: int = 5, share: float = 0.8, broadcast_rows: int = 500_000) -> DataFrame:
    """(sha, item, n_shared, n_item) by the SHA-256 of the texts, as `find_leaks` finds them: for removals, which a null or repeated id must not misguide."""
    return _found(docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body")), bench.select(F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("body")), k, share, broadcast_rows)


def find_leaks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
               k: int = 5, share: float = 0.8, broadcast_rows: int = 500_000) -> DataFrame:
    """Pairs (doc_id, item_id, n_shared, n_item, containment) where a document holds at least `share` of an item's distinct k-word shingles.

    Words are runs of letters and digits of the lower-cased text. A text of fewer than k words is one shingle, its whole sequence, so
    a short item meets short documents of the same words only; texts without words never meet. Rows that repeat id and text give one
    pair; equal texts under several ids give a pair each; null ids are kept as null. Other columns are not looked at.

    Search: an item of q shingles may lack m = q - ceil(share * q) of them, so its q-dependent sketch, the m + 1 smallest hashes, meets
    every document that holds the item: no threshold to tune and no miss. Items are partitioned by size (powers of two), and a document
    is only tried against partitions whose smallest item can be held by its number of shingles. Every shingle of every document
    is looked up. The sketches are broadcast while they number at most `broadcast_rows`; beyond, the lookup is a shuffled join, which
    adaptive execution splits where a shingle is hot. Candidates are then
    held against all shingles of their items, word by word, in a second scan.
    """
    items = bench.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("body")).distinct()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    found = _found(rows.select("body"), items.select("body"), k, share, broadcast_rows)
    items = items.select("item_id", F.sha2("body", 256).alias("item"))
    out = rows.select("doc_id", F.sha2("body", 256).alias("sha")).join(found, "sha").join(items.select("item_id", "item"), "item")
    return out.select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment")).distinct()


def _found(rows: DataFrame, items: DataFrame, k: int, share: float, broadcast_rows: int) -> DataFrame:
    need = lambda q: F.ceil(q * F.lit(share) - F.lit(1e-9)).cast("int")
    kinds = items.distinct().select(F.sha2("body", 256).alias("item"), words(F.col("body")).alias("w"))
    grams = [f"g{i}" for i in range(k)]
    sizes = rolling(kinds, "w", k, ["item"]).select("item", *grams).distinct().groupBy("item").agg(F.count("*").cast("int").alias("q"))
    kinds = staged(kinds.join(sizes, "item").withColumn("part", F.floor(F.log2("q")).cast("int")), "leak-items")
    sized = rolling(kinds, "w", k, ["item", "q", "part"]).select("item", "q", "part", F.xxhash64(*grams).alias("h"))
    sketch = sized.groupBy("item", "q", "part").agg(F.array_sort(F.collect_set("h")).alias("hs"))
    sketch = sketch.select("item", "part", need(F.pow(F.lit(2), F.col("part"))).alias("least"), F.explode(F.slice("hs", F.lit(1), F.col("q") - need(F.col("q")) + 1)).alias("h"))
    sketch = staged(sketch, "leak-sketch")

    looked = rows.select(F.sha2("body", 256).alias("sha"), words(F.col("body")).alias("w"))
    looked = looked.withColumn("n", F.greatest(F.size("w") - (k - 1), F.least(F.size("w"), F.lit(1))))
    looked = rolling(looked, "w", k, ["sha", "n"]).select("sha", "n", F.xxhash64(*grams).alias("h"))
    small = sketch.count() <= broadcast_rows
    met = looked.join(F.broadcast(sketch) if small else sketch, "h").filter("n >= least")
    pairs = staged(met.select("sha", "item").distinct(), "leak-pairs")

    # candidates are held against all shingles of their items, found by hash and compared word by word; no text is moved
    whole = staged(rolling(kinds, "w", k, ["item", "q"]).select("item", "q", F.xxhash64(*grams).alias("h"), *(F.col(g).alias(f"i{g}") for g in grams)).distinct(), "leak-shingles")
    every = rolling(rows.select(F.sha2("body", 256).alias("sha"), words(F.col("body")).alias("w")), "w", k, ["sha"]).withColumn("h", F.xxhash64(*grams))
    same = every.join(F.broadcast(whole) if whole.count() <= broadcast_rows else whole, "h")
    for g in grams:
        same = same.filter(F.col(g).eqNullSafe(F.col(f"i{g}")))
    same = same.select("sha", "item", "q", *grams).distinct().join(pairs, ["sha", "item"], "left_semi")
    counted = same.groupBy("sha", "item", "q").agg(F.count("*").cast("int").alias("n_shared")).filter(F.col("n_shared") >= need(F.col("q")))
    return staged(counted.select("sha", "item", "n_shared", F.col("q").alias("n_item")), "leaks")
