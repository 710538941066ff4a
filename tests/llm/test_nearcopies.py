import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelframe.llm import nearcopies
from reelframe.llm.nearcopies import near_copies


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def edited(prose, seed, n, edits):
    w = prose(seed, n).split()
    out = list(w)
    for i in random.Random(seed).sample(range(n), edits):
        out[i] = f"x{seed}q{i}"
    return " ".join(w), " ".join(out)


def groups(texts):
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    held = [shingles(t) for t in texts]
    for a, b in combinations(range(len(texts)), 2):
        if alike(held[a], held[b]):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def case(prose):
    """Pairs with similarities on both sides of 0.8, also of long texts, a chain, and short texts."""
    texts = []
    for g in range(120):
        texts += edited(prose, 5000 + g, 240 if g % 3 else 3000, (3 + g % 6) if g % 3 else 30 + 4 * (g % 12))
    w = prose(77, 200).split()
    texts += [" ".join(w[:at] + prose(300 + at, 8).split() + w[at:]) for at in range(0, 160, 8)]
    return texts + ["one two", "ONE  two", "one two three", "", None, " \n"]


def test_groups_like_brute_force(table, prose):
    texts = case(prose)
    rows = list(enumerate(texts))
    got = {r.doc_id: r.keep_id for r in near_copies(table(rows)).collect()}
    want = groups(texts)
    assert 30 < sum(g != i for i, g in enumerate(want)) < 140
    assert got == dict(enumerate(want))


def test_pairs_near_the_limit_meet_in_a_band(prose):
    met = []
    for g in range(400):
        a, b = edited(prose, 9000 + g, 300, 6)
        sa, sb = shingles(a), shingles(b)
        assert 0.78 < len(sa & sb) / len(sa | sb) < 0.9
        met.append((nearcopies.band_keys(nearcopies.shingle_set(a, 5)) == nearcopies.band_keys(nearcopies.shingle_set(b, 5))).any())
    assert all(met)


def test_fingerprints_bring_pairs_that_share_no_band(table, prose):
    a, b = edited(prose, 34782, 60, 5)
    x, y = nearcopies.text_keys(a, 5), nearcopies.text_keys(b, 5)
    assert not (x[1:] == y[1:]).any() and int(np.bitwise_count(x[:1].view(np.uint64) ^ y[:1].view(np.uint64))[0]) == nearcopies.RADIUS
    assert shingles(a) & shingles(b) and 2 * len(shingles(a) & shingles(b)) >= len(shingles(a) | shingles(b))
    rows = table([(1, a), (2, b), (3, prose(4, 60))])
    assert {r.doc_id: r.keep_id for r in near_copies(rows, share=0.5).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.doc_id: r.keep_id for r in near_copies(rows).collect()} == {1: 1, 2: 2, 3: 3}


def test_candidates_are_close_prints_or_shared_bands(spark):
    prints = {"a": 0, "b": 0b1111, "c": 0b11111111, "far": 0b11111 << 40, "same": 0b11111 << 40, "banded": -1, "alone": 0x5555 << 32}
    held = [(n, fp, [7] if n in ("c", "banded") else [100 + i]) for i, (n, fp) in enumerate(prints.items())]
    got = nearcopies.candidates(spark.createDataFrame(held, "sha string, fp long, bands array<long>"))
    name = spark.createDataFrame([(n,) for n in prints], "sha string").select("sha", F.xxhash64("sha").alias("node"))
    met = {}
    for r in got.join(name, "node").collect():
        met.setdefault(r.root, set()).add(r.sha)
    assert sorted(map(sorted, met.values())) == [["a", "b", "banded", "c"], ["far", "same"]]


@pytest.mark.parametrize("most", [3, 256])
def test_crowded_roots_are_dealt_without_losing_links(spark, prose, most):
    texts = sorted({t for t in case(prose)[240:] if t})
    held = [nearcopies.shingle_set(t, 5) for t in texts]
    df = spark.createDataFrame([(1, f"{i:03}", bytearray(h.tobytes())) for i, h in enumerate(held)], "root long, sha string, set binary")
    links = [(int(r.a), int(r.b)) for r in nearcopies.verified_links(df, 0.8, most=most).collect()]
    assert all(alike(set(held[a].tolist()), set(held[b].tolist())) for a, b in links)
    up = list(range(len(texts)))
    for _ in texts:
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    assert up == groups(texts)


def test_empty_table(table):
    assert near_copies(table([])).collect() == []
    assert nearcopies.similar_links([np.zeros(0, np.uint64)] * 2, 0.8) == [(0, 1)]
