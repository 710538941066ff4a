"""Mixing sources to target weights by weighted fair queueing: virtual finish times, one global order, a cut at the budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.llm.ranges import totals_before
from reelframe.session import staged

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """Words that each source should give. sizes: `source`, `size` rows; result: source, place, source_size, target.

    Sources in code-point order, null last, weigh `weights`, repeating, and share `share` (a fraction) of all words by weight. A target
    stops at `most` times the source's size; what is left over is dealt again by weight until none is above. With sources ordered by size
    for their weight those that stop come first, so one running total finds them; a source of no words has target 0.
    """
    num, den = share
    known = staged(sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), "mix-sources")
    placed = totals_before(known, [F.col("source").isNull(), F.col("source")], {"place": F.lit(1)}, "mix-places")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    placed = staged(placed.withColumn("weight", weight), "mix-weights")
    ordered = totals_before(placed, [most * F.col("source_size") / F.col("weight"), F.col("place")], {"size_before": F.col("source_size"), "weight_before": F.col("weight")}, "mix-ratios")
    whole = placed.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    rest = (num * F.col("all_size") - den * most * F.col("size_before")).cast("double") / (den * (F.col("all_weight") - F.col("weight_before")))
    stops = most * F.col("source_size") / F.col("weight") <= rest
    judged = staged(ordered.join(F.broadcast(whole)).withColumn("stops", stops), "mix-stops")  # one row is broadcast
    free = judged.agg(F.sum(F.when(F.col("stops"), F.col("source_size")).otherwise(0)).alias("stopped"), F.sum(F.when(F.col("stops"), 0).otherwise(F.col("weight"))).alias("free"))
    fair = (num * F.col("all_size") - den * most * F.col("stopped")).cast("double") * F.col("weight") / (den * F.col("free"))
    target = F.when(F.col("stops"), (most * F.col("source_size")).cast("double")).otherwise(fair)
    return staged(judged.join(F.broadcast(free)).select("source", "place", "source_size", target.alias("target")), "mix-targets")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2, packet: int = 16, seed: int = 0,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(rows, mix). rows: one per input row with row (a number), doc_id, source, size, source_size, target, taken. mix: what is read, in
    order: at (words read before), row, doc_id, source, round (from 0), first_word, words.

    A source's queue is its documents in an order shuffled by the digest of `seed` and id, `most` times over. A document's virtual finish
    time is the source's words up to its end, divided by the source's target, so every source reaches its target at time one. Documents of all
    sources are sorted by finish time over the whole cluster and read until the budget, `share` of all words, is spent; the last is cut there. The
    document that a source has in service at time one is queued in packets of `packet` words with finish times of their own, so
    a source's words miss its target by less than that, however long its documents are.

    A size is the number of runs of characters that are no ASCII white space; null and empty texts have 0 and are never read. Null sources are
    one source, the last; null ids are an id of their own. Rows that repeat are rows of their own, queued next to each other; reruns give the
    same words for the same rows. An empty table gives two empty results; other columns are not looked at. Very long texts are counted whole.
    """
    num, den = share
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
    sizes = staged(sizes.withColumn("turn", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))), "mix-sizes")
    targets = source_targets(sizes.select("source", "size"), weights, share, most)

    order = [F.col("source").isNull(), F.col("source"), F.col("turn"), F.col("doc_id"), F.col("size")]
    queued = totals_before(sizes, order, {"row": F.lit(1), "words_before": F.col("size")}, "mix-queues")
    # the words of all sources in front are taken off, so that every queue starts at 0
    starts = totals_before(targets, [F.col("place")], {"source_start": F.col("source_size")}, "mix-starts")
    queued = queued.join(starts.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "turn")
    queued = staged(queued.withColumn("begin", F.col("words_before") - F.col("source_start")), "mix-rows")

    turns = queued.filter("size > 0").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    turns = turns.withColumn("begin", F.col("begin") + F.col("round") * F.col("source_size")).filter("begin < target")
    in_service = F.col("begin") + F.col("size") > F.col("target")
    first = F.when(in_service, F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(packet).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    parts = turns.withColumn("piece", F.when(in_service, F.lit(packet)).otherwise(F.col("size"))).withColumn("first_word", F.explode(first))
    parts = parts.withColumn("words", F.least("piece", F.col("size") - F.col("first_word"))).withColumn("begin", F.col("begin") + F.col("first_word")).filter("begin < target")
    parts = parts.select("row", "doc_id", "source", "place", "round", "first_word", "words", "begin", ((F.col("begin") + F.col("words")) / F.col("target")).alias("finish"))
    lined = totals_before(parts, [F.col("finish"), F.col("place"), F.col("begin")], {"at": F.col("words")}, "mix-line")
    budget = sizes.agg(F.floor(num * F.sum("size") / den).alias("budget"))
    mix = lined.join(F.broadcast(budget)).filter("at < budget").withColumn("words", F.least("words", F.col("budget") - F.col("at")))
    mix = staged(mix.select("at", "row", "doc_id", "source", "round", "first_word", "words"), "mix")

    taken = mix.groupBy("row").agg(F.sum("words").alias("taken"))
    rows = queued.join(taken, "row", "left").select("row", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
    return rows, mix
