"""Near copies by shingle similarity: SimHash fingerprints and MinHash bands find candidates, every link is verified on the texts' whole shingle sets."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from reelframe.llm.components import components
from reelframe.llm.exact import sha256
from reelframe.llm.simhash import fingerprint_of, node_links, shingle_hashes
from reelframe.session import staged

#: a pair of similarity s shares a band with probability 1 - (1 - s^ROWS)^BANDS: at 0.8 all but 5 in a million
BANDS, ROWS = 40, 6
#: fingerprints that differ in so many bits or fewer are candidates, as they are linked in op3
RADIUS = 4


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text or "", k)]))


@lru_cache(1)
def factors() -> np.ndarray:
    return np.random.default_rng(11).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(h: np.ndarray) -> np.ndarray:
    """A key per band from the smallest values under ROWS orders of the hashes; sets without a shingle have keys of their own."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(h), 1024):
        least = np.minimum(least, np.multiply.outer(factors(), h[at:at + 1024]).min(1))
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for value in least.reshape(BANDS, ROWS).T:
        key = (key ^ value) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def text_keys(text: str | None, k: int) -> np.ndarray:
    """The SimHash fingerprint of all k-word shingles, repeats included, and the band keys of their set; the shingles are hashed once."""
    pieces = list(shingle_hashes(text or "", k))
    distinct = np.unique(np.concatenate([np.zeros(0, np.uint64), *pieces]))
    return np.append(np.array(fingerprint_of(pieces), np.uint64).view(np.int64), band_keys(distinct))


def keys(k: int):
    @pandas_udf("struct<fp: long, bands: array<long>>")
    def of(text: pd.Series) -> pd.DataFrame:
        made = [text_keys(t, k) for t in text]
        return pd.DataFrame({"fp": pd.Series([m[0] for m in made], dtype="int64"), "bands": [m[1:] for m in made]})

    return of


def sets(k: int):
    @pandas_udf("binary")
    def of(text: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, k).tobytes() for t in text])

    return of


def similar_links(held: list[np.ndarray], share: float) -> list[tuple[int, int]]:
    """A tree of links over each group of sets that pairs of a similarity of `share` or more connect, by growing from one set over those not yet
    reached; two sets without a shingle are alike."""
    sizes = np.array([len(s) for s in held], np.int64)
    _, number = np.unique(np.concatenate(held), return_inverse=True)
    ends = np.cumsum(sizes)
    parts = [number[e - n:e] for e, n in zip(ends, sizes)]
    inside = np.zeros(len(number) + 1, bool)
    left, links = np.argsort(sizes, kind="stable"), []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            fit = (sizes[left] >= share * sizes[at] - 1e-9) & (share * sizes[left] - 1e-9 <= sizes[at])
            tried = left[fit]
            if not len(tried):
                continue
            inside[parts[at]] = True
            both = np.array([np.count_nonzero(inside[parts[x]]) for x in tried])
            inside[parts[at]] = False
            near = both >= share * (sizes[tried] + sizes[at] - both) - 1e-9
            found = tried[near]
            front.extend(found)
            links.extend((int(at), int(x)) for x in found)
            left = left[~np.isin(left, found)]
    return links


def verified_links(held: DataFrame, share: float, most: int = 256, most_bytes: int = 32 << 20) -> DataFrame:
    """Links (a, b) that connect whatever pairs of a similarity of `share` or more connect among the sets under a root. held: distinct (root, sha, set).

    A root with over `most` sets or `most_bytes` is dealt into parts of about that size, and each pair of parts meets in a task of its own.
    """
    parts = F.greatest(F.ceil(F.col("n") / most), F.ceil(F.col("size") / most_bytes)).cast("int")
    counted = held.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.length("set")).alias("size"))
    hot = staged(counted.select("root", parts.alias("parts")).filter("parts > 1"), "near-hot")
    met = held.join(hot.select("root"), "root", "left_anti").select("root", F.lit(0).alias("i"), F.lit(0).alias("j"), "sha", "set")
    if not hot.isEmpty():
        own = held.join(hot, "root").withColumn("own", F.pmod(F.xxhash64("sha"), F.col("parts")).cast("int"))
        dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        met = met.unionByName(dealt.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "sha", "set"))

    def verified(frame: pd.DataFrame) -> pd.DataFrame:
        names = frame["sha"].tolist()
        links = similar_links([np.frombuffer(s, np.uint64) for s in frame["set"]], share)
        return pd.DataFrame([(names[a], names[b]) for a, b in links], columns=["a", "b"], dtype=object)

    return met.groupBy("root", "i", "j").applyInPandas(verified, "a string, b string").distinct()


def candidates(held: DataFrame) -> DataFrame:
    """(node, root): the texts that have a candidate, by their numbers, under a root per group that candidates connect. held: sha, fp, bands.

    Texts are candidates when fingerprints within RADIUS bits of each other connect them (`simhash.node_links`, op3's join) or when they share a band.
    """
    # a number for a text only groups candidates, so two texts under one number are no harm
    node = F.xxhash64("sha").alias("node")
    prints = held.select("fp").distinct().select(F.array("fp").alias("fps"))
    close = staged(components(node_links(prints, 1, RADIUS, 7)).select(F.col("node").alias("fp"), "root"), "near-prints")
    group = F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp")).alias("key")
    keyed = held.select(node, F.explode("bands").alias("key")).unionByName(held.join(close, "fp", "left").select(node, group)).distinct()
    keyed = staged(keyed, "near-keys")
    first = staged(keyed.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("n")).filter("n > 1"), "near-first")
    return staged(components(keyed.join(first, "key").filter("node != first").select("node", "first"), "node", "first"), "near-candidates")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, share: float = 0.8) -> DataFrame:
    """One row per different (doc_id, text_sha256): keep_id, keep_sha256, the first of all linked ones in the order of ids, nulls last, then digests.

    Two texts are linked when their sets of k-word shingles have a Jaccard similarity of `share` or more, also by way of others. Words are as in
    op3: A-Z lower-cased, ended by ASCII white space; a text of fewer than k words is one shingle; null and empty texts and those without words are
    alike. Texts whose SimHash fingerprints link, or that share one of BANDS keys, which at a similarity of 0.8 all but 5 in a million pairs do, are
    candidates; groups that candidates connect are verified on the 64-bit hashes of all shingles. Only texts with a candidate have their shingles moved.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), sha256(text).alias("sha"), text.alias("body"))
    held = staged(rows.select("doc_id", "sha", keys(k)("body").alias("keys")).select("doc_id", "sha", "keys.*"), "near-rows")
    roots = candidates(held)
    met = rows.withColumn("node", F.xxhash64("sha")).join(roots, "node").select("root", "sha", sets(k)("body").alias("set"))
    met = staged(met.groupBy("root", "sha").agg(F.first("set").alias("set")), "near-sets")
    linked = staged(components(verified_links(met, share)).select(F.col("node").alias("sha"), F.col("root").alias("group")), "near-groups")
    top = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "sha")).alias("top")
    known = staged(held.groupBy("sha").agg(top), "near-top").join(linked, "sha", "left").withColumn("group", F.coalesce("group", "sha"))
    known = staged(known, "near-known")
    best = staged(known.groupBy("group").agg(F.min("top").alias("top")), "near-best")
    known = staged(known.select("sha", "group").join(best, "group").select("sha", "top"), "near-kept")
    out = held.select("doc_id", "sha").distinct().join(known, "sha")
    return out.select("doc_id", F.col("sha").alias("text_sha256"), F.col("top.doc_id").alias("keep_id"), F.col("top.sha").alias("keep_sha256"))
