import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from reelframe.llm.packing import fullest, minimum_slack, pack_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def ids():
    t = Tokenizer.from_file(PATH)
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


def check(rows, df, ids, size):
    got = df.collect()
    assert df.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    want = []
    for i, text in rows:
        x = ids(text)
        start, length = 0, len(x) % size or size
        for piece in range(-(-len(x) // size)):
            want.append((i, piece, start, length, zlib.crc32(np.array(x[start:start + length], "<u4").tobytes())))
            start, length = start + length, size
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(bins), -(-sum(r.length for r in got) // size)


def test_ids_pieces_and_places(table, prose, odd, ids):
    texts = ["it's we'll  x'd\n\n  y \t z", "<|endoftext|> a", "x <|endoftext|>", "a  <|endoftext|><|endoftext|>\n b <|endoftext", "<|endoftext|>", "naïve café № ½ ²³ ª 12345", " a\u0085b  c", "a_b __c -- ... !?", "é", " lead", "trail "]
    rows = odd + [(100 + i, t) for i, t in enumerate(texts)] + [(200 + i, prose(i, 20 + 37 * i % 700)) for i in range(60)]
    n, bound = check(rows, pack_documents(table(rows), PATH), ids, 1024)
    assert n <= bound + 1
    n, bound = check(rows, pack_documents(table(rows), PATH, size=64), ids, 64)
    assert n <= 1.03 * bound + 1


def test_one_length_is_most_of_the_table(spark, table, ids):
    rows = [(i, "same text here") for i in range(700)]
    n, bound = check(rows, pack_documents(table(rows), PATH, size=16), ids, 16)
    assert n == 175 and bound == 175
    assert pack_documents(table([]), PATH).collect() == []


def test_fullest_is_a_subset_sum_optimum():
    rng = random.Random(2)
    for _ in range(200):
        left = {rng.randint(1, 20): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        room = rng.randint(1, 40)
        sums = {0}
        for length, n in left.items():
            for _ in range(n):
                sums |= {s + length for s in sums if s + length <= room}
        got = fullest(left, room)
        assert all(n <= left[k] for k, n in got.items())
        assert sum(k * n for k, n in got.items()) == max(sums)


def best_fit(counts, size):
    """Sequences of best-fit decreasing."""
    rooms = []
    for k in sorted(counts, reverse=True):
        for _ in range(counts[k]):
            at = min((i for i, r in enumerate(rooms) if r >= k), key=rooms.__getitem__, default=None)
            if at is None:
                rooms.append(size - k)
            else:
                rooms[at] -= k
    return len(rooms)


def test_plan_is_no_worse_than_best_fit():
    rng = random.Random(8)
    for case in range(12):
        counts = {}
        for _ in range(rng.randint(50, 500)):
            k = min(1024, int(rng.paretovariate(0.7) * 20)) if case % 2 else rng.randint(1, 1024)
            counts[k] = counts.get(k, 0) + 1
        n = sum(times for _, times in minimum_slack(counts, 1024))
        assert n <= best_fit(counts, 1024)


def test_plan_uses_every_piece_once():
    rng = random.Random(3)
    counts = {k: rng.randint(1, 50) for k in rng.sample(range(1, 1025), 300)}
    plan = minimum_slack(counts, 1024)
    used = {}
    for bin_, times in plan:
        assert sum(k * n for k, n in bin_.items()) <= 1024
        for k, n in bin_.items():
            used[k] = used.get(k, 0) + n * times
    assert used == counts
    assert minimum_slack({}, 1024) == []
