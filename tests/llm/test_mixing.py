import hashlib
import re
from fractions import Fraction

import pytest

from reelframe.llm.mixing import mix_sources, source_targets

SCHEMA = "doc_id long, text string, source string, size long, row int, target string, at double, words int, place int, turn string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, s, 7, 1, "x", 0.5, 3, 9, "z") for i, t, s in rows], SCHEMA).repartition(parts)


def targets(sizes):
    """sizes: source -> words. Reshares the excess in rounds."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, free, out = Fraction(3 * sum(sizes.values()), 2), set(order), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if unit * weight[s] >= 2 * sizes[s]}
        if not full:
            out |= {s: unit * weight[s] for s in free}
            break
        out |= {s: Fraction(2 * sizes[s]) for s in full}
        left -= sum(2 * sizes[s] for s in full)
        free -= full
    return order, out


def expected(rows):
    size = {}
    docs = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in rows]
    for _, s, n in docs:
        size[s] = size.get(s, 0) + n
    order, target = targets(size)
    line = []
    for s in order:
        queue = [d for d in docs if d[1] == s]
        queue.sort(key=lambda d: (hashlib.md5(f"0:{'' if d[0] is None else d[0]}".encode()).hexdigest(), d[0] is not None, d[0] or 0, d[2]))
        begin = 0
        for k in range(2):
            for at, d in enumerate(queue):
                pieces = [(0, d[2])] if begin + d[2] <= target[s] else [(j, min(16, d[2] - j)) for j in range(0, d[2], 16)]
                for j, n in pieces:
                    if n and begin + j < target[s]:
                        line.append((float((begin + j + n) / target[s]), order.index(s), begin + j, (s, at), n))
                begin += d[2]
    left, taken = 3 * sum(size.values()) // 2, {}
    for _, _, _, who, n in sorted(line):
        got = min(n, left)
        left -= got
        taken[who] = taken.get(who, 0) + got
    out = []
    for s in order:
        queue = sorted((d for d in docs if d[1] == s), key=lambda d: (hashlib.md5(f"0:{'' if d[0] is None else d[0]}".encode()).hexdigest(), d[0] is not None, d[0] or 0, d[2]))
        out += [(d[0], s, d[2], size[s], round(float(target[s]), 6), taken.get((s, at), 0)) for at, d in enumerate(queue)]
    return sorted(out, key=repr)


def got(rows):
    assert rows.columns == ["row", "doc_id", "source", "size", "source_size", "target", "taken"]
    found = rows.collect()
    assert len({r.row for r in found}) == len(found)
    return sorted(((r.doc_id, r.source, r.size, r.source_size, round(r.target, 6), r.taken) for r in found), key=repr)


def case(prose, odd):
    rows = [(i, t, ["b", None, "", "é", "Z"][k % 5]) for k, (i, t) in enumerate(odd)]
    rows += [(100 + i, prose(i, 5 + 37 * i % 90), "hot" if i % 3 else f"s{i % 7}") for i in range(120)]
    return rows + [(100, prose(0, 5), "s0"), (900, "  ", "empty"), (901, None, "empty"), (902, "one", "one")]


def test_like_brute_force(spark, prose, odd):
    rows = case(prose, odd)
    want = expected(rows)
    found, mix = mix_sources(frame(spark, rows))
    assert got(found) == want
    # the mix is gapless, in one order, and within a packet of every target
    line = sorted((r.at, r.words) for r in mix.collect())
    assert [a for a, _ in line] == [sum(n for _, n in line[:k]) for k in range(len(line))]
    assert sum(n for _, n in line) == 3 * sum(w[2] for w in want) // 2
    by = {}
    for w in want:
        by.setdefault(w[1], [w[4], 0])[1] += w[5]
    assert all(abs(t - n) <= 16 for t, n in by.values())
    assert all(w[5] <= 2 * w[2] for w in want)


def test_reruns_and_layout(spark, prose, odd):
    rows = case(prose, odd)
    assert got(mix_sources(frame(spark, rows, 1))[0]) == got(mix_sources(frame(spark, rows[::-1], 8))[0])
    plain = frame(spark, [r for r in rows if r[0] is not None and r[0] >= 100])
    assert got(mix_sources(plain, seed=1)[0]) != got(mix_sources(plain)[0])


@pytest.mark.parametrize("rows", [[], [(1, "", "a"), (2, None, None)], [(1, "only one here", "a")], [(k, "w " * k, "a") for k in range(9)]])
def test_small_tables(spark, rows):
    assert got(mix_sources(frame(spark, rows))[0]) == expected(rows)


def test_targets(spark):
    sizes = {"a": 10, "b": 1000, "c": 3, "d": 0, "e": 500, None: 70}
    rows = source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
    _, want = targets(sizes)
    assert {r.source: round(r.target, 9) for r in rows} == {s: round(float(t), 9) for s, t in want.items()}
