import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from reelframe.llm.components import components
from reelframe.llm.simhash import block_masks, close_links, fingerprint, near_groups, spanning_links


def slow_print(text, k=4):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def roots(links, nodes):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprint_and_components_like_brute_force(table, prose, odd):
    rng = random.Random(1)
    rows = list(odd)
    for g in range(8):
        w = prose(g, 400).split()
        for i in range(6):
            v = list(w)
            for _ in range(rng.randrange(4)):
                v[rng.randrange(len(v))] = "changed"
            rows.append((100 * g + 50 - i, " ".join(v)))
    rows += [(3000 + i, prose(90 + i, 50)) for i in range(30)]
    df = near_groups(table(rows))
    assert df.columns == ["doc_id", "fingerprint", "component_id"]
    got = df.collect()
    prints = [slow_print(t) for _, t in rows]
    group = roots([(a, b) for a, b in combinations(sorted(set(prints)), 2) if (a ^ b).bit_count() <= 4], set(prints))
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[group[p]] = min(i, least.get(group[p], i))
    want = [(i, f"{p:016x}", least.get(group[p])) for (i, _), p in zip(rows, prints)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert len({p for p in prints}) > len({group[p] for p in prints})


@pytest.mark.parametrize("text", ["", " ", "a", "a b c", "A b C d", "é É x\u00a0y z w", "a\u2003b c\x1cd e"])
def test_fingerprint_of_small_texts(text):
    assert fingerprint(text, 4) == [slow_print(text)]
    assert fingerprint(text, 4, 3)[0] == slow_print(text)


@pytest.mark.parametrize("radius,blocks", [(4, 5), (4, 7), (4, 8), (3, 6), (0, 1)])
def test_close_prints_share_a_mask(radius, blocks):
    masks = block_masks(radius, blocks)
    rng = random.Random(4)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), radius):
            y ^= 1 << b
        assert any(x & m == y & m for m in masks)


def crowd(seed, n, flips):
    rng = random.Random(seed)
    centre = rng.getrandbits(64)
    out = set()
    for _ in range(n):
        x = centre
        for b in rng.sample(range(64), rng.randrange(flips)):
            x ^= 1 << b
        out.add(x)
    return out


def test_crowded_keys_are_split_without_losing_links(spark):
    prints = crowd(7, 150, 9) | crowd(8, 60, 12) | {random.Random(i).getrandbits(64) for i in range(100)}
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    df = spark.createDataFrame([(0, p) for p in signed], "lane int, fp long").repartition(3)
    want = roots([(a, b) for a, b in combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 4], signed)
    for most in (7, 2048):
        links = [(r.a, r.b) for r in close_links(df, 4, most=most).collect()]
        assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 4 for a, b in links)
        assert roots(links, signed) == want


def test_spanning_links_connect_and_stay_few():
    prints = np.array(sorted(crowd(9, 200, 6)), np.uint64).view(np.int64)
    links = spanning_links(prints, 4)
    assert len(links) < len(prints)


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(1000, 1000 + i) for i in range(1, 60)]
    links = chain + star + [(5, 5), (None, 3), (2000, 1999), (1999, 2000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for e in chain + star for n in e} | {1999, 2000}
    assert got == roots(chain + star + [(1999, 2000)], nodes)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_empty_table(table):
    assert near_groups(table([])).collect() == []


def test_more_lanes_link_whatever_is_close_in_any(table, prose):
    rng = random.Random(21)
    rows = []
    for g in range(6):
        w = prose(200 + g, 150).split()
        for i in range(8):
            v = list(w)
            for _ in range(i // 2):
                v[rng.randrange(len(v))] = f"new{i}"
            rows.append((10 * g + i, " ".join(v)))
    rows += [(None, prose(900, 20)), (99, None), (98, "")]
    prints = [fingerprint(t, 4, 5) for _, t in rows]
    at = list(range(len(rows)))
    close = [(a, b) for a, b in combinations(at, 2) if any((x ^ y).bit_count() <= 4 for x, y in zip(prints[a], prints[b]))]
    group = roots(close, at)
    least = {}
    for (i, _), g in zip(rows, (group[a] for a in at)):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = sorted(((i, f"{prints[a][0]:016x}", least.get(group[a])) for a, (i, _) in enumerate(rows)), key=repr)
    assert sorted(map(tuple, near_groups(table(rows), lanes=5, blocks=6).collect()), key=repr) == want
    one = roots([(a, b) for a, b in combinations(at, 2) if (prints[a][0] ^ prints[b][0]).bit_count() <= 4], at)
    assert len(set(group.values())) < len(set(one.values()))
