"""Ranked lexical search: bit-sliced Bloom signatures bound every document's score from above, and what the bounds do not exclude is scored exactly."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelframe.llm.ranges import totals_before
from reelframe.session import staged

#: terms are runs of digits, letters and characters beyond ASCII; only A-Z are lower-cased
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: a term has an entry for each of these numbers of occurrences that it reaches in a document
LEVELS = (1, 2, 3, 4, 6, 10, 20, 64)
#: slices an entry sets, and slices a block has per entry of its largest document: one entry in sixty looks present and is not
HASHES, SLICES = 3, 10.4
#: bits of a block, entries that wait for their block in a task
BITS, WAITING = 1 << 25, 1 << 23
ODD = np.uint64(0x9E3779B97F4A7C15)


def terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(PLAIN).split()


def slots(hashes: np.ndarray, level: np.ndarray | int, slices: int) -> np.ndarray:
    """The HASHES slices of each entry (rows: entries)."""
    h = (hashes + (np.atleast_1d(np.asarray(level, np.uint64)) + np.uint64(1)) * ODD) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    step = (h >> np.uint64(32)) | np.uint64(1)
    at = h & np.uint64(0xFFFFFFFF)
    return np.stack([(at + np.uint64(k) * step) % np.uint64(slices) for k in range(HASHES)], axis=-1).astype(np.int64)


@dataclass
class Items:
    """One batch of items: distinct terms, and per item its number, term places and how often each occurs in it."""

    numbers: list[int]
    vocabulary: list[bytes]
    places: list[np.ndarray]
    repeats: list[np.ndarray]

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Items:
        counts = [Counter(terms(text)) for _, text in rows]
        vocabulary = sorted(set().union(*counts))
        at = {t: k for k, t in enumerate(vocabulary)}
        places = [np.array([at[t] for t in c], np.int64) for c in counts]
        return cls([i for i, _ in rows], vocabulary, places, [np.array(list(c.values()), np.int64) for c in counts])


@dataclass
class Statistics:
    """Documents with a term, all their terms, and the weight of every term of a batch."""

    docs: int
    length: int
    weight: np.ndarray

    def norm(self, n: int) -> int:
        return 25 + 75 * n * self.docs // self.length


def entry_hashes(counts: Counter) -> tuple[np.ndarray, np.ndarray]:
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, counts), np.uint64, len(counts))
    tf = np.fromiter(counts.values(), np.int64, len(counts))
    reached = [(np.flatnonzero(tf >= at), k) for k, at in enumerate(LEVELS)]
    return np.concatenate([h[r] for r, _ in reached]), np.concatenate([np.full(len(r), k, np.uint8) for r, k in reached])


def block_row(held: list[tuple[int, int, np.ndarray, np.ndarray, list[int]]], most_slices: int = 1 << 22) -> dict:
    """A row per block: its slices as bitmaps over its documents, their keys and lengths, and in how many each item term occurs."""
    slices = min(most_slices, max(64, math.ceil(SLICES * max(len(h) for _, _, h, _, _ in held))))
    bits = np.zeros((slices, -(-len(held) // 8)), np.uint8)
    for doc, (_, _, h, level, _) in enumerate(held):
        bits[slots(h, level, slices).ravel(), doc >> 3] |= np.uint8(128 >> (doc & 7))
    df = Counter(t for *_, found in held for t in found)
    return {"slices": slices, "bits": bits.tobytes(), "keys": [d[0] for d in held], "lengths": [d[1] for d in held], "term": list(df), "df": list(df.values())}


BLOCKS = "slices int, bits binary, keys array<long>, lengths array<long>, term array<int>, df array<long>"


def signature_blocks(docs: DataFrame, items: Items, block_docs: int, block_slices: int) -> DataFrame:
    """Blocks of at most `block_docs` documents with about as many distinct terms. docs: `key`, `body`. Documents without terms are left out; all others
    are indexed. A block never has over `block_slices` slices: beyond, its bitmaps are denser, which raises bounds and loses nothing."""
    wanted = {t: k for k, t in enumerate(items.vocabulary)}

    def built(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[int, list] = {}
        entries: Counter = Counter()
        for frame in frames:
            for key, text in zip(frame["key"], frame["body"]):
                counts = Counter(terms(text))
                if not counts:
                    continue
                h, level = entry_hashes(counts)
                size = len(h).bit_length()
                waiting.setdefault(size, []).append((key, sum(counts.values()), h, level, [wanted[t] for t in counts.keys() & wanted.keys()]))
                entries[size] += len(h)
                if len(waiting[size]) == block_docs or len(waiting[size]) * (SLICES * 2**size) >= BITS:
                    yield pd.DataFrame([block_row(waiting.pop(size), block_slices)])
                    del entries[size]
                elif sum(entries.values()) > WAITING:
                    size = max(entries, key=entries.get)
                    yield pd.DataFrame([block_row(waiting.pop(size), block_slices)])
                    del entries[size]
        for held in waiting.values():
            yield pd.DataFrame([block_row(held, block_slices)])

    return docs.select("key", "body").mapInPandas(built, BLOCKS)


def upper_bounds(block, hashes: np.ndarray, items: Items, known: Statistics) -> np.ndarray:
    """Items x documents: at least the score of every document of the block.

    A term's slices, and-ed, are a bitmap of the documents that seem to hold it. Every level adds what reaching it can add to the score at most, for the
    document's length; an item's bound sums its terms' slices by weight.
    """
    n = len(block.keys)
    bits = np.frombuffer(block.bits, np.uint8).reshape(block.slices, -1)
    norms = [known.norm(int(x)) for x in block.lengths]
    worth, before = np.zeros((len(hashes), n)), np.zeros(n)
    live = np.arange(len(hashes))
    seen = np.full((len(live), bits.shape[1]), 255, np.uint8)
    for k in range(len(LEVELS)):
        at = slots(hashes[live], k, block.slices)
        seen = seen & bits[at[:, 0]]
        for j in range(1, HASHES):
            seen &= bits[at[:, j]]
        some = seen.any(1)
        live, seen = live[some], seen[some]
        if not len(live):
            break
        most = np.array([10**9 * (LEVELS[k + 1] - 1) // (1000 * (LEVELS[k + 1] - 1) + 8 * m) if k + 1 < len(LEVELS) else 10**6 for m in norms], float)
        worth[live] += np.unpackbits(seen, axis=1, count=n) * (most - before)
        before = most
    worth *= known.weight[:, None]
    # a float holds such sums exactly up to 9e15; the factor covers rounding beyond
    return np.stack([r @ worth[p] for p, r in zip(items.places, items.repeats)]) * (1 + 1e-9)


def term_hashes(items: Items) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, items.vocabulary), np.uint64, len(items.vocabulary))


def most_promising(blocks: DataFrame, items: Items, known: Statistics, top: int) -> DataFrame:
    """(key, place): for each item the documents with the `top` highest bounds, from the best of every task."""

    def picked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = term_hashes(items)
        best, keys = np.zeros((len(items.numbers), top)), np.zeros((len(items.numbers), top), np.int64)
        for frame in frames:
            for block in frame.itertuples():
                bounds = np.concatenate([best, upper_bounds(block, hashes, items, known)], axis=1)
                owners = np.concatenate([keys, np.broadcast_to(np.asarray(block.keys, np.int64), (len(keys), len(block.keys)))], axis=1)
                at = np.argpartition(-bounds, top - 1, axis=1)[:, :top]
                best, keys = np.take_along_axis(bounds, at, 1), np.take_along_axis(owners, at, 1)
        item, rank = np.nonzero(best > 0)
        yield pd.DataFrame({"key": keys[item, rank], "place": item.astype(np.int32), "bound": best[item, rank]})

    found = blocks.mapInPandas(picked, "key long, place int, bound double")
    w = Window.partitionBy("place").orderBy(F.col("bound").desc(), "key")
    return found.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top).select("key", "place")


def not_excluded(blocks: DataFrame, items: Items, known: Statistics, least: np.ndarray) -> DataFrame:
    """(key, place): every document whose bound reaches the item's entry of `least`."""

    def kept(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = term_hashes(items)
        for frame in frames:
            for block in frame.itertuples():
                item, doc = np.nonzero(upper_bounds(block, hashes, items, known) >= least[:, None])
                yield pd.DataFrame({"key": np.asarray(block.keys, np.int64)[doc], "place": item.astype(np.int32)})

    return blocks.mapInPandas(kept, "key long, place int")


def exact_scores(docs: DataFrame, pairs: DataFrame, items: Items, known: Statistics, broadcast_rows: int) -> DataFrame:
    """(place, doc_id, score) of the pairs, from the documents' whole texts; only scores above 0. Pairs are broadcast up to `broadcast_rows` documents."""
    asked = staged(pairs.groupBy("key").agg(F.collect_set("place").alias("places")), "lexical-asked")  # as long as the batch of items at most
    weights = [w.tolist() for w in (known.weight[p] * r for p, r in zip(items.places, items.repeats))]
    needed = [[items.vocabulary[k] for k in p] for p in items.places]

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row, (text, places) in enumerate(zip(frame["body"], frame["places"])):
                counts = Counter(terms(text))
                m8, worth = 8 * known.norm(counts.total()), {}
                for place in places:
                    score = 0
                    for t, w in zip(needed[place], weights[place]):
                        tf = counts.get(t)
                        if tf:
                            if t not in worth:
                                worth[t] = 1_000_000_000 * tf // (1000 * tf + m8)
                            score += w * worth[t]
                    if score:
                        rows.append((row, place, score))
            out = pd.DataFrame(rows, columns=["row", "place", "score"], dtype=np.int64)
            out["doc"] = frame["doc"].to_numpy()[out["row"]]
            yield out[["place", "doc", "score"]].astype({"place": np.int32})

    joined = docs.join(F.broadcast(asked) if asked.count() <= broadcast_rows else asked, "key")
    kind = docs.schema["doc_id"].dataType
    held = joined.select(F.to_json(F.struct("doc_id")).alias("doc"), "body", "places").mapInPandas(scored, "place int, doc string, score long")
    return held.select("place", F.from_json("doc", T.StructType([T.StructField("doc_id", kind)]))["doc_id"].alias("doc_id"), "score")


def search(docs: DataFrame, bench: DataFrame, top: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
           batch_chars: int = 4_000_000, broadcast_rows: int = 200_000, block_docs: int = 512, block_slices: int = 1 << 22) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item its `top` documents with the highest scores above 0, equal scores by ascending doc_id, null last.

    Terms are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. With N documents that have a term, L terms in all, n in the
    document and df documents holding a term, a term weighs w = floor(1000 * ln((2N + 2) / (2df + 1))), m is 25 + (75nN) div L, and a score
    sums w * ((10^9 tf) div (1000 tf + 8m)) over the item's terms, repeats included.

    Documents are indexed in bit-sliced Bloom signatures, whose bounds never lie below a score. The documents with the highest bounds are scored first; the
    `top`-th score among them is a floor, and every document whose bound reaches it is scored exactly from its whole text. Nothing else decides.

    Items are distinct (item_id, text) rows, dealt into batches of `batch_chars` characters (or one longer item), the only part of the items that a task or the driver
    holds; each batch reads the documents anew. Null and empty texts have no terms: such documents are in no count and no result, such
    items have no rows. Documents that repeat id and text are rows of their own; empty tables give an empty result; other columns are not looked at.
    """
    body = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), body(text_col).alias("body")).withColumn("key", F.xxhash64("doc_id", "body"))
    listed = bench.select(F.col(item_col).alias("item_id"), body(item_text).alias("body")).distinct().withColumn("chars", F.length("body").cast("long"))
    listed = totals_before(listed, [F.xxhash64("item_id", "body"), F.col("body")], {"item": F.lit(1), "chars_before": F.col("chars")}, "lexical-items")
    listed = staged(listed.withColumn("batch", F.floor(F.col("chars_before") / batch_chars)), "lexical-batches")
    batches = [r.batch for r in listed.select("batch").distinct().orderBy("batch").toLocalIterator()]
    found = None
    for b in batches:
        items = Items.of([(r.item, r.body) for r in listed.filter(F.col("batch") == b).orderBy("item").select("item", "body").collect()])
        one = ranked(rows, signature_blocks(rows, items, block_docs, block_slices), items, top, broadcast_rows)
        if one is not None:
            found = one if found is None else found.unionByName(one)
    if found is None:
        return rows.select(F.lit(0).alias("rank"), "doc_id", F.lit(0).cast("long").alias("score")).join(listed.select("item_id"), F.lit(False)).select("item_id", "rank", "doc_id", "score")
    return found.join(listed.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def ranked(rows: DataFrame, blocks: DataFrame, items: Items, top: int, broadcast_rows: int) -> DataFrame | None:
    """(item, rank, doc_id, score) of one batch; None if no item or no document has a term."""
    blocks = staged(blocks, "lexical-blocks")
    total = blocks.select(F.size("keys").alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("length")).agg(F.sum("n"), F.sum("length")).first()
    if not items.vocabulary or total[0] is None:
        return None
    df = np.zeros(len(items.vocabulary), np.int64)
    for t, n in blocks.select(F.explode(F.arrays_zip("term", "df")).alias("x")).groupBy("x.term").agg(F.sum("x.df")).toLocalIterator():  # at most one row per term of the batch
        df[t] = n
    known = Statistics(int(total[0]), int(total[1]), np.array([math.floor(1000 * math.log((2 * total[0] + 2) / (2 * int(x) + 1))) for x in df], np.int64))

    first = staged(exact_scores(rows, most_promising(blocks, items, known, top), items, known, broadcast_rows), "lexical-first")
    by_score = Window.partitionBy("place").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    least = np.ones(len(items.numbers), np.int64)
    for place, score in first.withColumn("_r", F.row_number().over(by_score)).filter(F.col("_r") == top).select("place", "score").toLocalIterator():  # one row per item of the batch
        least[place] = score
    pairs = staged(not_excluded(blocks, items, known, least), "lexical-pairs")
    scores = exact_scores(rows, pairs, items, known, broadcast_rows)
    best = scores.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= top)
    number = F.element_at(F.array(*(F.lit(i).cast("long") for i in items.numbers)), F.col("place") + 1)
    return staged(best.select(number.alias("item"), "rank", "doc_id", "score"), "lexical-ranks")
