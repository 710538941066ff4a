import hashlib
import random

import pytest

from reelframe.llm import suffix
from reelframe.llm.suffix import RunIndex, least_orders, remove_repeats


def expected(rows, span):
    last = 2**63 - 1
    least = {}
    docs = [(last if i is None else i, i, (t or "").encode()) for i, t in rows]
    for o, _, b in docs:
        for p in range(len(b) - span + 1):
            g = b[p:p + span]
            least[g] = min(o, least.get(g, o))
    out = []
    for o, i, b in docs:
        gone = [False] * len(b)
        for p in range(len(b) - span + 1):
            if least[b[p:p + span]] < o:
                gone[p:p + span] = [True] * span
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=repr)


def case(prose):
    rng = random.Random(2)
    base = prose(1, 200)
    rows = []
    for i in range(25):
        a = rng.randrange(len(base) - 200)
        rows.append((rng.randrange(1000), prose(10 + i, rng.randrange(30)) + base[a:a + rng.randrange(20, 200)] + prose(50 + i, rng.randrange(20))))
    rows += [(2000, base), (2001, base), (None, base[:90]), (None, base[:90]), (5, None), (6, ""), (7, "short"), (8, "a" * 300), (9, "xx" + "a" * 120 + "yy"), (10, "é" * 60), (11, "-" + "é" * 60), (12, "ab" * 90), (13, "ba" * 70)]
    return rows


@pytest.mark.parametrize("chunk,crowded", [(4 << 20, 4 << 20), (600, 4 << 20), (900, 1500), (900, 100)])
def test_removal_like_brute_force(table, prose, chunk, crowded):
    rows = case(prose)
    assert got(remove_repeats(table(rows), chunk_bytes=chunk, crowded=crowded)) == expected(rows, 50)


def test_other_lengths_and_random_texts(table):
    rng = random.Random(9)
    rows = [(rng.randrange(40), "".join(rng.choice("ab") for _ in range(rng.randrange(120)))) for _ in range(60)]
    assert got(remove_repeats(table(rows), span=16, chunk_bytes=700)) == expected(rows, 16)


def test_spans_give_the_remaining_bytes(table, prose):
    rows = case(prose)
    by = {}
    for i, t in rows:
        by.setdefault(i, []).append((t or "").encode())
    for r in remove_repeats(table(rows)).collect():
        texts = set()
        for b in by[r.doc_id]:
            out, at = b"", 0
            for s in r.spans:
                out, at = out + b[at:s.start], s.end
            texts.add(out + b[at:])
        assert bytes(r.kept) in texts and hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256
        assert r.n_removed == sum(s.end - s.start for s in r.spans) and r.n_spans == len(r.spans)


def test_matching_statistics_like_brute_force():
    rng = random.Random(5)
    for trial in range(30):
        letters, span = rng.choice(["ab", "abcdefgh", "a"]), rng.choice([16, 50, 64])
        base = "".join(rng.choice(letters) for _ in range(300))
        texts = []
        for _ in range(rng.randint(1, 10)):
            i = rng.randint(0, 200)
            texts.append((base[i:i + rng.randint(0, 150)] + "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))).encode())
        asked = texts + ["".join(rng.choice(letters + "zé") for _ in range(60)).encode() for _ in range(3)]
        index = RunIndex(texts, span)
        lengths, found = index.matches(asked, span)
        assert index.runs <= len(index.symbols)
        at = 0
        for x in asked:
            for i in range(len(x)):
                best = 0
                while best < span and i + best < len(x) and any(x[i:i + best + 1] in t for t in texts):
                    best += 1
                assert lengths[at + i] == best
                assert found[at + i] == (min(k for k, t in enumerate(texts) if x[i:i + span] in t) if best == span else -1)
            at += len(x)


@pytest.mark.parametrize("at_once", [1 << 20, 300, 1])
def test_every_answer_comes_from_an_index(prose, monkeypatch, at_once):
    base = prose(3, 120).encode()
    rng = random.Random(1)
    least = {base[a:a + rng.randrange(50, 90)]: rng.randrange(99) for a in [rng.randrange(len(base) - 90) for _ in range(60)]}
    seen = []

    class Watched(RunIndex):
        def __init__(self, texts, span):
            super().__init__(texts, span)
            seen.extend(texts)

    monkeypatch.setattr(suffix, "RunIndex", Watched)
    # texts that share a string of 50 bytes but not its first 50 have one anchor only as stretches do: cut them so
    import numpy as np

    parts = {}
    for t, o in least.items():
        s = suffix.stretches(np.frombuffer(t, np.uint8), np.array([len(t)]), 50)
        for a, n in zip(s.start.tolist(), s.count.tolist()):
            piece = t[a:a + n + 49]
            parts[piece] = min(o, parts.get(piece, o))
    begin, orders = least_orders(parts, 50, at_once)
    assert sorted(seen) == sorted(parts)
    for t in parts:
        for i in range(len(t) - 49):
            assert orders[begin[t] + i] == min(o for x, o in parts.items() if t[i:i + 50] in x)


@pytest.mark.parametrize("span", [8, 16, 50, 64])
def test_longer_anchors_keep_equal_strings_together(span):
    import numpy as np

    rng = random.Random(span)
    base = bytes(rng.choice(b"abcd") for _ in range(400))
    body = b"".join(base[a:a + 150] for a in [rng.randrange(250) for _ in range(9)])
    data = np.frombuffer(body, np.uint8)
    coarse = suffix.stretches(data, np.array([150] * 9), span)
    fine = suffix.longer(data, coarse, span)
    assert fine.count.sum() == coarse.count.sum() and len(fine.start) >= len(coarse.start)
    key = {}
    for a, n, k in zip(fine.start.tolist(), fine.count.tolist(), fine.anchor.tolist()):
        for i in range(a, a + n):
            assert key.setdefault(body[i:i + span], k) == k


def test_copies_compress_to_few_runs(prose):
    text = prose(4, 300).encode()
    one, many = RunIndex([text], 50), RunIndex([text] * 20, 50)
    assert many.runs < 2 * one.runs


def test_odd_rows_and_empty_table(table, odd):
    rows = [(i, t if t is None or len(t) < 3000 else t[:3000]) for i, t in odd]
    assert got(remove_repeats(table(rows))) == expected(rows, 50)
    assert len(remove_repeats(table(odd), bodies=False).collect()) == len(odd)
    assert remove_repeats(table([])).collect() == []
