import random
import zlib
from itertools import product

import numpy as np
import pytest

from reelframe.llm import crf


def documents(prose, n=300):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(n):
        lines = [prose(1000 * i + j, rng.randint(8, 40)).capitalize() + "." for j in range(rng.randint(2, 8))]
        if i % 4 == 0:
            kind = rng.randrange(3)
            spoil = [lambda x: " ".join(w + "***" for w in x.split()), lambda x: x.upper().replace(" ", "!! "), lambda x: " | ".join(x.split())][kind]
            lines = [spoil(x) if j else x for j, x in enumerate(lines)]
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(i % 4 != 0)))
    return rows, labels


def test_chain_equals_enumeration():
    rng = np.random.default_rng(1)
    count = np.array([3, 0, 1, 5, 4])
    lines = crf.Lines(np.zeros((13, 1), np.float32), np.ones(13, int), np.cumsum(count) - count, count)
    e, step, start = rng.normal(size=13), rng.normal(size=(2, 2)), 0.7
    good, moves, total = crf.chain(e, lines, step, start)
    want_moves, logs = np.zeros((2, 2)), 0.0
    for first, n in zip(lines.first, count):
        if not n:
            continue
        z, p, m = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in product((0, 1), repeat=int(n)):
            s = (y[0] - 0.5) * start + sum((a - 0.5) * x for a, x in zip(y, e[first:first + n])) + sum(step[a, b] for a, b in zip(y, y[1:]))
            w = np.exp(s)
            z += w
            p += w * np.array(y)
            for a, b in zip(y, y[1:]):
                m[a, b] += w
        np.testing.assert_allclose(good[first:first + n], p / z, atol=1e-9)
        want_moves += m / z
        logs += np.log(z)
    np.testing.assert_allclose(moves, want_moves, atol=1e-9)
    assert abs(total - logs) < 1e-9


def test_features_see_words_symbols_and_repeats():
    lines = crf.lines_of(["aa aa aa bb\n\n  \nXX!! 12", "", None, "one"])
    assert lines.count.tolist() == [2, 0, 0, 1]
    own = lines.x[:, :crf.N_OWN]
    np.testing.assert_allclose(own[0, :6], [0, 0, 0, 0.5, 0.5, 0], atol=1e-6)
    np.testing.assert_allclose(own[1, [0, 1, 5]], [2 / 7, 1, 2 / 7], atol=1e-6)
    np.testing.assert_allclose(lines.x[0, 2 * crf.N_OWN:3 * crf.N_OWN], own[1])  # the line after
    assert lines.x[0, crf.N_OWN:2 * crf.N_OWN].sum() == 0 and lines.x[2, 2 * crf.N_OWN:3 * crf.N_OWN].sum() == 0
    again = crf.lines_of(["x y\nz\nx y"])
    assert again.x[:, 3 * crf.N_OWN].tolist() == [0, 0, 1]


def test_long_lines_are_cut_not_dropped(monkeypatch):
    monkeypatch.setattr(crf, "PIECE", 100)
    lines = crf.lines_of(["a" * 250 + "\nb", "c"])
    assert lines.sizes.sum() == 252 and lines.count.tolist() == [4, 1]


def test_held_out_documents_are_told_apart(spark, table, prose, odd):
    rows, labels = documents(prose)
    marks = spark.createDataFrame([(i, q, 1 - q) for i, q in labels] + [(4, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = table(rows)
    model = crf.train(docs, marks, sample_docs=200)
    got = {r.doc_id: r for r in crf.quality(docs, model).collect()}
    for i, q in labels:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert got[i].predicted == int(got[i].score >= 0.5) and 0 <= got[i].score <= 1
    held = [(got[i].predicted, q) for i, q in labels if got[i].held_out]
    assert np.mean([p == q for p, q in held]) > 0.95
    strange = crf.quality(table(odd), model).collect()
    assert len(strange) == len(odd) and all(0 <= r.score <= 1 for r in strange)
    assert {r.score for r in strange if r.doc_id in (1, 2, 3)} == {model.prior}
    assert crf.quality(table([]), model).collect() == []


def test_labels_of_held_out_rows_change_nothing(spark, table, prose):
    rows, labels = documents(prose, 60)
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    models = [crf.train(table(rows), spark.createDataFrame([(i, 1 - q if flip and held(i) else q) for i, q in labels], "doc_id long, quality int")) for flip in (False, True)]
    np.testing.assert_allclose(models[0].weights, models[1].weights)
    assert models[0].shift == pytest.approx(models[1].shift)


def test_without_labels_the_prior_decides(spark, table):
    model = crf.train(table([(1, "a b")]), spark.createDataFrame([], "doc_id long, quality int"))
    assert all(0 <= r.score <= 1 for r in crf.quality(table([(1, "a b"), (2, None)]), model).collect())


def test_long_lines_are_cut_between_words(monkeypatch):
    """Blanks over a cut or at the end make no line without a word; words stay whole unless they are longer than a piece."""
    monkeypatch.setattr(crf, "PIECE", 16)
    for line in ["word" + " " * 60, "a b" + " " * 40 + "c", "alpha beta gamma delta epsilon", "x" * 40 + " y"]:
        parts = [x for lines, _ in crf.cut_lines([line]) for x in lines]
        assert all(x.strip() and len(x) <= 16 for x in parts)
        assert "".join("".join(parts).split()) == "".join(line.split())
        if max(map(len, line.split())) <= 16:
            assert [w for x in parts for w in x.split()] == line.split()
        assert len(crf.lines_of([line, "next line"]).sizes) == len(parts) + 1
        assert crf.lines_of(["next line", line]).count.tolist() == [1, len(parts)]
