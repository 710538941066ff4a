import random
import re
import zlib
from collections import Counter

import pytest

from reelframe.llm.spelling import keyed_words, spelling_groups


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def counts(rows, least, drop):
    n = Counter()
    for i, t in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if drop and h % drop == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= least:
                n[w] += 1
    return n


def one_edit(a, b):
    """By trying every edit."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def expected(rows, least=7, seen=2, ratio=10, drop=None):
    n = {w: k for w, k in counts(rows, least, drop).items() if k >= seen}
    near = {w: [v for v in n if abs(len(v) - len(w)) <= 1 and v != w and one_edit(v, w)] for w in n}
    form = {}
    for w in n:
        top = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = top if top is not None and n[top] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def got(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, df.collect()), key=repr)


def case(odd, seed=0):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abénoÀÿ÷") for _ in range(rng.randrange(6, 12))) for _ in range(30)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "x" * 70, "q" * 150]
    words = ["chainword"] * 500 + ["chainwerd"] * 40 + ["chbinwerd"] * 3 + ["chbinwer"] * 2
    for stem in stems:
        words += [stem] * rng.choice([2, 3, 30, 400])
        for _ in range(12):
            at, kind = rng.randrange(len(stem)), rng.randrange(3)
            made = stem[:at] + ("" if kind == 0 else rng.choice("abéz")) + stem[at + (kind < 2):]
            words += [made.upper() if rng.random() < 0.2 else made] * rng.choice([1, 2, 3, 40])
    rng.shuffle(words)
    return odd + [(100 + k, " ".join(words[k::60]) + ", Éclairs7éclairs_don't") for k in range(60)]


@pytest.mark.parametrize("drop", [None, 5])
def test_like_brute_force(table, odd, drop):
    rows = case(odd)
    want = expected(rows, drop=drop)
    assert sum(r[1] is not None for r in want) > 20 and any(r[2] != r[1] and r[1] for r in want)
    assert got(spelling_groups(table(rows), drop=drop)) == want


def test_long_words_in_parts(table, odd):
    """Short segments' bounds lowered, so that keys of long words are dealt into parts."""
    rows = case(odd, 1)
    assert got(spelling_groups(table(rows, 5), pieces=2, most=3)) == expected(rows)


def test_every_key_of_short_words_is_small(table, spark):
    words = spark.createDataFrame([(a + b + "bcdefgh", 2) for a in "abcdefgh" for b in "abcdefgh"], "word string, n long")
    keys = keyed_words(words).groupBy("m", "key").count().collect()
    assert max(k["count"] for k in keys) == 64


@pytest.mark.parametrize("rows", [[], [(1, None), (2, "")], [(1, "lonelyword lonelyword")], [(1, "short")]])
def test_small_tables(table, rows):
    assert got(spelling_groups(table(rows))) == expected(rows)
