"""Every stage held against a plain version of it on the stage's own input."""

import math
import re
import sys
import zlib
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from reelframe.llm import crf  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "rows")
        stage(spark, out[-1], data).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def pairs(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_names_order_and_columns(spark, data, stages):
    assert len(corpus_pipeline.STAGES) == 5
    for df in stages[1:5]:
        assert sorted(df.columns) == sorted(stages[0].columns)
    assert corpus_pipeline.run(spark, data).count() == stages[5].count()


def test_quality(spark, data, stages):
    before, after = pairs(stages[0]), pairs(stages[1])
    model = crf.train(stages[0], spark.read.parquet(f"{data}/labels.parquet"))
    ids = sorted(before)
    scores = model.score([before[i] for i in ids])
    assert set(after) == {i for i, s in zip(ids, scores) if s >= 0.5}
    assert 0 < len(after) < len(before)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    assert np.mean([(i in after) == (q == 1) for i, q in labels.items()]) > 0.95


def test_exact(stages):
    before, after = pairs(stages[1]), pairs(stages[2])
    best = {}
    for i, t in before.items():
        best[t] = max(i, best.get(t, i))
    assert set(after) == set(best.values())


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near(stages):
    """Against all pairs of the stage's input, by the Jaccard similarity of their 5-word shingles."""
    before, after = pairs(stages[2]), pairs(stages[3])
    of = {i: shingle_set(t) for i, t in before.items()}
    up = {i: i for i in of}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(sorted(of), 2):
        if of[a] == of[b] or len(of[a] & of[b]) >= 0.8 * len(of[a] | of[b]):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    assert set(after) == {find(i) for i in of}


def test_removals_by_id_and_text(spark, data):
    """Texts that share an id, or have none, are judged by themselves."""
    item, second = (r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").orderBy("item_id").limit(2).collect())
    words = [f"w{i}" for i in range(60)]
    near, copy, clean, other = " ".join(words), " ".join([*words[:59], "x"]), " ".join(f"c{i}" for i in range(40)), " ".join(f"d{i}" for i in range(40))
    rows = [(1, near), (2, copy), (2, clean), (None, copy + " y"), (None, other), (3, "before " + item), (3, clean + " z z z z"), (None, "without an id " + second), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, data).collect()}
    assert left == {(i, t) for i, t in rows if t not in (copy, copy + " y", clean + " z z z z")}
    left = {(r.doc_id, r.text) for r in corpus_pipeline.drop_leaks(spark, docs, data).collect()}
    assert left == {(i, t) for i, t in rows if item not in (t or "") and second not in (t or "")}


def test_leaks(spark, data, stages):
    before, after = pairs(stages[3]), pairs(stages[4])

    def shingles(text):
        w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    items = [shingles(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    held = {i: shingles(t) for i, t in before.items()}
    clean = {i for i, s in held.items() if not any(q and len(q & s) >= math.ceil(0.8 * len(q)) for q in items)}
    assert set(after) == clean and len(clean) < len(before)


def test_packing(stages):
    docs, rows = pairs(stages[4]), stages[5].collect()
    assert {r.doc_id for r in rows} == set(docs)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        assert sum(n for _, n in parts) <= 1024
        assert sorted(o for o, _ in parts) == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]
    assert len(bins) <= -(-sum(r.length for r in rows) // 1024) + 1


def odd_documents(spark):
    rows = [(1, "one two three four five.", "en", "s", 1), (1, "one two three four five.", "en", "s", 1), (None, "one two three four five.", None, None, None), (2, None, None, None, None), (3, "", None, None, None), (None, None, None, None, None),
            (4, " ".join(f"w{i % 991}" for i in range(50_000)), "en", "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("stage", range(5))
def test_odd_rows(spark, data, stage):
    docs = odd_documents(spark)
    got = corpus_pipeline.STAGES[stage][1](spark, docs, data)
    if stage == 4:
        assert got.count() >= 7
    else:
        assert got.columns == docs.columns
        assert {zlib.crc32((r.text or "").encode()) for r in got.collect()} <= {zlib.crc32((r.text or "").encode()) for r in docs.collect()}
    if stage == 1:
        assert sorted((r.doc_id, r.text or "") for r in got.collect() if r.doc_id is not None)[:3] == [(1, "one two three four five."), (3, ""), (4, docs.filter("doc_id = 4").first().text)]
    assert corpus_pipeline.STAGES[stage][1](spark, docs.limit(0), data).collect() == []
