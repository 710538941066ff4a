"""Near copies by SimHash: fingerprints over word shingles, joined on sets of bit blocks that close pairs must share, then verified."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from reelframe.llm.components import components
from reelframe.session import staged

BITS = 64
#: shingles hashed at a time
STEP = 1 << 16


def shingle_hashes(text: str, k: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of every k-word shingle, repeats included, in bounded pieces. A-Z are lower-cased, words end at ASCII white space; of fewer
    than k words the whole sequence is hashed, of none nothing."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    k = min(k, len(words))
    first, last = starts[:len(words) - k + 1].tolist(), (starts + sizes)[k - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(first), STEP):
        part = [digest(line[i:j], seed) for i, j in zip(first[at:at + STEP], last[at:at + STEP])]
        yield np.array(part, dtype=np.uint64)


def lane(h: np.ndarray, i: int) -> np.ndarray:
    """The hashes themselves for lane 0, hashes of them for the others."""
    if not i:
        return h
    h = (h ^ np.uint64(i * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def fingerprint_of(pieces: Iterable[np.ndarray], lanes: int = 1) -> list[int]:
    """For each lane the bits set in over half of the hashes; zero where there is none."""
    votes, n = np.zeros((lanes, BITS), np.int64), 0
    for h in pieces:
        for i in range(lanes):
            votes[i] += np.unpackbits(lane(h, i).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(h)
    return np.packbits(2 * votes > n, axis=1).view(">u8").ravel().tolist() if n else [0] * lanes


def fingerprint(text: str | None, k: int, lanes: int = 1) -> list[int]:
    """`fingerprint_of` the text's shingle hashes; zero for a text without words."""
    return fingerprint_of(shingle_hashes(text or "", k), lanes)


def fingerprints(k: int, lanes: int):
    @pandas_udf("array<long>")
    def of(text: pd.Series) -> pd.Series:
        prints = np.array([fingerprint(t, k, lanes) for t in text], dtype=np.uint64).reshape(-1, lanes)
        return pd.Series(list(prints.view(np.int64)))

    return of


def block_masks(radius: int, blocks: int) -> list[int]:
    """Masks of which two fingerprints at `radius` or fewer differing bits share at least one: of equal blocks all sets that leave out `radius`."""
    if blocks <= radius:
        raise ValueError("there must be more blocks than differing bits")
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    return [sum(s) for s in combinations(parts, blocks - radius)]


def spanning_links(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A tree of links over each set of fingerprints connected at `radius`, found by growing from one fingerprint over those not yet reached."""
    left, links = np.unique(prints.view(np.uint64)), []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(left ^ at) <= radius
            if near.any():
                found = left[near]
                front.extend(found)
                links.extend((at, x) for x in found)
                left = left[~near]
    return [(int(a.view(np.int64)), int(b.view(np.int64))) for a, b in links]


def close_links(prints: DataFrame, radius: int, blocks: int = 7, most: int = 2048) -> DataFrame:
    """Links (lane, a, b) that connect whatever fingerprints of a lane `radius` or fewer differing bits connect. prints: distinct (lane, fp).

    Fingerprints meet by block key: with 7 blocks and 4 bits 35 keys of 27 bits each, at every size of the table. A key with over `most`
    of them is dealt into parts of about that size, and each pair of parts meets in a task of its own, so no task holds more than two
    parts; each gives a spanning tree of verified links, not all pairs.
    """
    masks = block_masks(radius, blocks)
    signed = lambda m: m - (1 << BITS) if m >> (BITS - 1) else m
    keys = F.array(*(F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks)))
    keyed = prints.select("lane", "fp", F.explode(keys).alias("k")).select("lane", "fp", "k.c", "k.key")
    place = ["lane", "c", "key"]
    hot = staged(keyed.groupBy(*place).agg(F.count("*").alias("n")).filter(F.col("n") > most), "simhash-hot")
    group = F.collect_list("fp").alias("fps")
    if hot.isEmpty():
        met = keyed.groupBy(*place).agg(group)
    else:
        cold = keyed.join(hot, place, "left_anti").groupBy(*place, F.lit(0).alias("i"), F.lit(0).alias("j")).agg(group)
        parts = keyed.join(hot, place).withColumn("parts", F.ceil(F.col("n") / most).cast("int")).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        dealt = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        met = cold.unionByName(dealt.groupBy(*place, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(group))

    def verified(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            links = [(at, *x) for at, fps in zip(frame["lane"], frame["fps"]) for x in spanning_links(np.asarray(fps, dtype=np.int64), radius)]
            yield pd.DataFrame(links, columns=["lane", "a", "b"], dtype=np.int64)

    return met.filter(F.size("fps") > 1).select("lane", "fps").mapInPandas(verified, "lane int, a long, b long").distinct()


def node_links(rows: DataFrame, lanes: int, radius: int, blocks: int) -> DataFrame:
    """Links (a, b) between nodes, that is values of lane 0, over all lanes. rows: `fps`, a fingerprint per lane."""
    if lanes == 1:
        return close_links(rows.select(F.lit(0).alias("lane"), F.col("fps")[0].alias("fp")).distinct(), radius, blocks).select("a", "b")
    held = staged(rows.select(F.col("fps")[0].alias("node"), F.posexplode("fps").alias("lane", "fp")).distinct(), "simhash-lanes")
    first = staged(held.groupBy("lane", "fp").agg(F.min("node").alias("first")), "simhash-first")
    same = held.join(first, ["lane", "fp"]).filter("node != first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    links = staged(close_links(first.select("lane", "fp"), radius, blocks), "simhash-links")
    end = lambda c: first.select("lane", F.col("fp").alias(c), F.col("first").alias(f"{c}_node"))
    far = links.join(end("a"), ["lane", "a"]).join(end("b"), ["lane", "b"]).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    return same.unionByName(far)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, radius: int = 4, blocks: int = 7, lanes: int = 1) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 lowercase hex digits), component_id (smallest doc_id reachable over links, itself included).

    Two rows are linked when their fingerprints differ in `radius` or fewer bits. With more `lanes` there are as many fingerprints, of hashes of the
    same shingles, and being that close in one of them is enough: of texts about as far apart as `radius` allows, more are found. The
    fingerprint shown is that of lane 0. Equal fingerprints are one node, so copies form no pairs. Null and empty texts and those without
    words have fingerprint zero, linked like any other. Null ids are passed over when the smallest is taken; where a
    component has no other, component_id is null. Repeated rows are rows of their own; other columns are not looked at.
    """
    rows = staged(docs.select(F.col(id_col).alias("doc_id"), fingerprints(k, lanes)(F.col(text_col).cast("string")).alias("fps")), "simhash-rows")
    labels = staged(components(node_links(rows, lanes, radius, blocks)).select(F.col("node").alias("fp"), "root"), "simhash-labels")
    rows = rows.select("doc_id", F.col("fps")[0].alias("fp"))
    prints = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-prints")
    linked = labels.join(prints, "fp")
    named = staged(linked.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-roots")
    known = prints.join(labels.join(named, "root").select("fp", F.lit(True).alias("linked"), "component_id"), "fp", "left")
    known = staged(known.select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id")), "simhash-known")
    return rows.join(known, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
