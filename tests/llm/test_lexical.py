import math
import random
import re
from collections import Counter, namedtuple

import numpy as np
import pytest

from reelframe.llm.lexical import Items, Statistics, block_row, entry_hashes, search, term_hashes, upper_bounds

UP = {c: c + 32 for c in range(65, 91)}


def terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(UP))


def expected(docs, items, top=10):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, length = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for j, text in set(items):
        found = []
        for i, c in counted:
            m = 25 + 75 * c.total() * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(j, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=repr)


def bench(spark, items):
    return spark.createDataFrame([(j, t, 3, 4, "k") for j, t in items], "item_id long, text string, item int, rank int, key string")


def case(prose, odd):
    items = [(j, prose(j, 10 + 3 * j)) for j in range(12)] + [(20, "one"), (21, None), (22, ""), (23, "漢字 W1 w1 W1 É"), (0, prose(0, 10)), (0, "another text of item zero"), (None, prose(3, 5)), (24, "never-seen-anywhere")]
    docs = odd + [(100 + k, prose(k % 40, 20 + k % 90)) for k in range(150)]
    docs += [(1000 + j, prose(j + 50, 300) + " " + prose(j, 10 + 3 * j).upper() + ". " * 3) for j in range(12)]
    docs += [(2000 + k, prose(5, 25)) for k in range(25)] + [(2000, prose(5, 25))]
    return docs, items


def test_like_brute_force(spark, table, prose, odd):
    docs, items = case(prose, odd)
    want = expected(docs, items)
    assert len(want) > 100
    assert got(search(table(docs), bench(spark, items))) == want
    # several batches of items, and pairs that are not broadcast
    assert got(search(table(docs, 5), bench(spark, items), batch_chars=300, broadcast_rows=0)) == want
    assert got(search(table(docs), bench(spark, items), top=3)) == expected(docs, items, 3)


def test_small_and_dense_blocks(spark, table, prose, odd):
    """Blocks of few slices bound badly; the rows stay."""
    docs, items = case(prose, odd)
    assert got(search(table(docs), bench(spark, items), block_docs=3, block_slices=70)) == expected(docs, items)


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a b")], []), ([], []), ([(1, None)], [(1, "a")]), ([(1, "a b")], [(1, None)]), ([(1, "a b a")], [(7, "A")])])
def test_small_tables(spark, table, docs, items):
    assert got(search(table(docs), bench(spark, items))) == expected(docs, items)


def test_bounds_hold_and_exclude(prose):
    rng = random.Random(4)
    common = prose(1, 60).split()
    docs = [Counter(terms(" ".join(rng.choices(common, k=rng.randrange(1, 400))) + " " + prose(k, 40))) for k in range(300)]
    items = Items.of([(j, prose(j, 30)) for j in range(20)])
    df = Counter(t for c in docs for t in c)
    length = sum(c.total() for c in docs)
    weight = np.array([math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t.decode()] + 1))) for t in items.vocabulary])
    known = Statistics(len(docs), length, weight)
    coded = [Counter({t.encode(): n for t, n in c.items()}) for c in docs]
    row = block_row([(k, c.total(), *entry_hashes(c), []) for k, c in enumerate(coded)])
    bounds = upper_bounds(namedtuple("Block", row)(**row), term_hashes(items), items, known)
    near = 0
    for i, (places, repeats) in enumerate(zip(items.places, items.repeats)):
        for k, c in enumerate(coded):
            m = known.norm(c.total())
            score = sum(int(weight[p]) * int(r) * (10**9 * c[items.vocabulary[p]] // (1000 * c[items.vocabulary[p]] + 8 * m)) for p, r in zip(places, repeats) if c[items.vocabulary[p]])
            assert bounds[i, k] >= score
            near += bounds[i, k] <= 1.3 * score + 1e6
    assert near > 0.7 * bounds.size
