"""Blocked ordered operators against plain pandas, with blocks small enough to cross borders."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reelframe.operators import ordered as O


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(1)
    idx = np.concatenate([rng.choice(400, 150, replace=False), rng.choice(50, 9, replace=False), [7]])
    key = ["hot"] * 150 + ["b"] * 9 + ["c"]
    val = rng.normal(size=160).round(3)
    val[rng.random(160) < 0.3] = np.nan
    return pd.DataFrame({"k": key, "t": idx.astype("int64"), "x": val})


def load(spark, pdf):
    d = spark.createDataFrame(pdf).repartition(4)
    return d.withColumn("x", F.when(~F.isnan("x"), F.col("x")))


def collect(df, cols):
    return {(r["k"], r["t"]): tuple(r[c] for c in cols) for r in df.collect()}


def test_rank_and_running(spark, frame):
    d = load(spark, frame)
    got = collect(O.running(O.rank0(d, ["k"], "t", "r", width=16), ["k"], "t", {
        "s": ("sum", F.col("x")), "n": ("count", F.col("x")), "m": ("max", F.col("x")), "l": ("last", F.col("x"))}, width=16),
        ["r", "s", "n", "m", "l"])
    for k, g in frame.sort_values("t").groupby("k"):
        seen = []
        for r, (t, x) in enumerate(zip(g["t"], g["x"])):
            if x == x:
                seen.append(x)
            a = got[(k, t)]
            assert a[0] == r and a[2] == len(seen)
            assert (a[1] is None) == (not seen)
            if seen:
                assert a[1] == pytest.approx(sum(seen)) and a[3] == max(seen) and a[4] == seen[-1]


def test_reverse_and_exclusive(spark, frame):
    d = load(spark, frame)
    nxt = collect(O.running(d, ["k"], "t", {"l": ("last", F.col("x"))}, include_current=False, reverse=True, width=16), ["l"])
    for k, g in frame.sort_values("t").groupby("k"):
        rows = list(zip(g["t"], g["x"]))
        for i, (t, _) in enumerate(rows):
            later = [x for _, x in rows[i + 1:] if x == x]
            assert nxt[(k, t)][0] == (later[0] if later else None)


def test_shift_both_ways(spark, frame):
    d = load(spark, frame)
    prev = collect(O.shifted(d, ["k"], "t", {"p": F.col("t")}, width=16), ["p"])
    nxt = collect(O.shifted(d, ["k"], "t", {"p": F.col("t")}, ahead=True, width=16), ["p"])
    for k, g in frame.sort_values("t").groupby("k"):
        t = list(g["t"])
        for i, x in enumerate(t):
            assert prev[(k, x)][0] == (t[i - 1] if i else None)
            assert nxt[(k, x)][0] == (t[i + 1] if i + 1 < len(t) else None)


def test_sliding_crosses_blocks(spark):
    d = spark.range(100).select(F.lit("a").alias("k"), F.col("id").alias("t"))
    got = collect(O.sliding(d, ["k"], "t", 5, 2, {"s": lambda w: F.sum("t").over(w)}, width=7), ["s"])
    for t in range(100):
        assert got[("a", t)][0] == sum(range(max(0, t - 5), min(99, t + 2) + 1))


def test_exact_percentiles(spark, frame):
    d = load(spark, frame)
    got = {r["k"]: r for r in O.exact_percentiles(d, ["k"], {"x": F.col("x")}, {"lo": 0.1, "mid": 0.5, "hi": 0.93}, bins=8).collect()}
    for k, g in frame.groupby("k"):
        x = g["x"].dropna()
        if len(x):
            for n, q in (("lo", 0.1), ("mid", 0.5), ("hi", 0.93)):
                assert got[k]["x_" + n] == pytest.approx(np.quantile(x, q))


def test_percentiles_with_an_outlier(spark):
    """A value of 1e9 among 100,000 leaves no range with over 2 % of the rows."""
    from reelframe.operators.ordered import exact_percentiles, value_ranges

    x = np.r_[np.random.default_rng(0).normal(0, 1, 99_999), 1e9]
    d = spark.createDataFrame(pd.DataFrame({"k": "a", "x": x}))
    r = exact_percentiles(d, ["k"], {"x": F.col("x")}, {"lo": 0.1, "mid": 0.5, "hi": 0.9}).first()
    assert [r["x_lo"], r["x_mid"], r["x_hi"]] == pytest.approx(np.percentile(x, [10, 50, 90]), rel=1e-12)
    sizes = value_ranges(d.select("k", F.col("x").alias("__v"), F.lit(1).alias("__c")), ["k"], 64).groupBy("__block").count().agg(F.max("count")).first()[0]
    assert sizes <= 2000


def test_percentile_of_repeated_values(spark):
    d = spark.createDataFrame([(1.0,)] * 50 + [(2.0,)] * 3, "v double")
    r = O.exact_percentile(d, [], "v", {"a": 0.5, "b": 1.0, "c": 0.0}).first()
    assert (r["a"], r["b"], r["c"]) == (1.0, 2.0, 1.0)


def test_top_k_beyond_planner_limit(spark):
    d = spark.range(5000).withColumn("k", F.lit(1))
    got = O.top_k(d, ["k"], [F.col("id").desc()], 1500)
    assert got.agg(F.count("*"), F.min("id")).first()[:] == (1500, 3500)


def test_group_limit_runs_before_the_shuffle(spark):
    d = O.top_k(spark.range(1000).withColumn("k", F.col("id") % 3).repartition(3), ["k"], [F.col("id")], 5)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_fold_settles_across_blocks(spark):
    from reelframe.streaming.stateful import keyframes_batch

    rng = np.random.default_rng(3)
    x = rng.normal(size=300).cumsum()
    d = spark.createDataFrame(pd.DataFrame({"k": "a", "t": np.arange(300), "x": x}))
    got = {r["t"] for r in keyframes_batch(d, "k", "t", "x", 2.0, width=20).filter("keep").collect()}
    last, want = None, set()
    for i, v in enumerate(x):
        if last is None or abs(v - last) > 2.0:
            want.add(i)
            last = v
    assert got == want | {299}


def test_iterator_fold_of_a_million_frames(spark):
    """A state that never forgets, over blocks of one clip."""
    from reelframe.functions.udf import iterator_fold

    n = 1_000_000
    d = spark.range(n).select(F.lit("a").alias("clip"), F.col("id").alias("t"), F.pmod(F.col("id") * 7919, F.lit(1000)).alias("x"))

    def fold(pdf, state):
        total = (0 if state is None else state) + pdf["x"].cumsum()
        return pd.DataFrame({"total": total}), int(total.iloc[-1])

    got = iterator_fold(d, ["clip"], "t", fold, "total bigint", "bigint", 200_000).orderBy("t").toPandas()["total"]
    assert np.array_equal(got, np.cumsum(np.arange(n) * 7919 % 1000))


def test_rounds_of_a_fold_that_never_forgets(spark, monkeypatch):
    """As many rounds as the logarithm of its blocks, with integers beyond the doubles and frames with nulls."""
    from reelframe import session

    n, cuts = 500, []
    monkeypatch.setattr(session, "cut", lambda df, cut=session.cut: cuts.append(1) or cut(df))
    d = spark.range(n).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("clip"), F.col("id").alias("t"), F.when(F.col("id") % 7 != 0, F.col("id")).alias("x"))
    d = O.rank0(d, ["clip"], "t", "p")

    def fold(pdf, state):
        total = [2**60 + 1 if state is None else state["s"]]
        for x in pdf["x"].fillna(0):
            total.append(total[-1] + int(x))
        return pd.DataFrame({"total": total[1:]}), {"s": total[-1]}

    done, ends = O.fold_blocks(d, ["clip"], "p", ["x"], fold, "struct<s:bigint>", "total bigint", 4)
    want, sums = {}, {"a": 2**60 + 1, "b": 2**60 + 1}
    for k in ("a", "b"):
        for p, i in enumerate(i for i in range(n) if (i % 3 == 0) == (k == "a")):
            sums[k] += i if i % 7 else 0
            want[k, p] = sums[k]
    assert {(r.clip, r.p): r.total for r in done.collect()} == want
    assert {r.clip: r.state.s for r in ends.collect()} == sums
    assert len(cuts) < 20


def test_ema_over_many_blocks(spark):
    from reelframe.operators.telemetry import ema

    rng = np.random.default_rng(4)
    x = rng.normal(5, 1, size=700)
    x[rng.random(700) < 0.2] = np.nan
    d = spark.createDataFrame(pd.DataFrame({"k": "a", "t": np.arange(700), "x": x})).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    for warm in (False, True):
        got = {r["t"]: r["ema"] for r in ema(d, ["k"], "t", "x", 0.9, warm).collect()}
        c, n = None, 0
        for t, v in enumerate(x):
            if v == v:
                if c is None:
                    c = v
                else:
                    n += 1
                    dec = min(0.9, (1 + n) / (10 + n)) if warm else 0.9
                    c = dec * c + (1 - dec) * v
            assert got[t] == (None if c is None else pytest.approx(c, rel=1e-9))


@pytest.mark.parametrize("decay, warm, rows", [(0.9999999, False, 64), (0.9999999, True, 50), (1.0, True, 64), (0.5, False, 4096), (1e-200, False, 7), (0.97, True, 3)])
def test_ema_counts_every_value(spark, decay, warm, rows):
    from reelframe.operators.telemetry import ema

    n = 3000
    x = np.random.default_rng(7).normal(0, 1, size=n) + 1000.0 * (np.arange(n) < 5)
    d = spark.createDataFrame(pd.DataFrame({"k": "a", "t": np.arange(n), "x": x}))
    got = {r["t"]: r["ema"] for r in ema(d, ["k"], "t", "x", decay, warm, rows=rows).collect()}
    c = x[0]
    for t in range(1, n):
        dec = min(decay, (1 + t) / (10 + t)) if warm else decay
        c = dec * c + (1 - dec) * x[t]
        assert got[t] == pytest.approx(c, rel=1e-9, abs=1e-9)


def test_entries_of_a_chain(spark):
    from reelframe.operators.ordered import entries

    rng = np.random.default_rng(1)
    rows = [(k, i, float(rng.uniform(-1.2, 1.2)), float(rng.normal())) for k, n in (("a", 1), ("b", 40), ("c", 333)) for i in range(n)]
    maps = spark.createDataFrame(rows, "k string, i long, a double, s double")
    compose = lambda f, x: F.struct((x["a"] * f["a"]).alias("a"), (x["a"] * f["s"] + x["s"]).alias("s"))
    got = entries(maps, ["k"], "i", ["a", "s"], compose, lambda e, x: x["a"] * e + x["s"], F.lit(2.0), F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("s")), width=7)
    at, want = {}, {}
    for k, i, a, s in rows:
        want[k, i] = at.get(k, 2.0)
        at[k] = a * want[k, i] + s
    assert {(r.k, r.i): pytest.approx(r.entry, rel=1e-9, abs=1e-9) for r in got.collect()} == want


def test_range_rank_of_one_hot_value(spark):
    from reelframe.operators.ordered import range_rank

    d = spark.createDataFrame([(i % 3 // 2, 1000 - i) for i in range(500)], "hot int, x int")
    got = sorted((r["hot"], r["x"], r["at"]) for r in range_rank(d, ["hot", "x"], "at").collect())
    assert [r[2] for r in got] == list(range(500))


def test_ema_of_decay_one_keeps_the_first_value(spark):
    from reelframe.operators.telemetry import ema

    d = spark.createDataFrame([("a", 0, None), ("a", 1, 3.0), ("a", 2, 9.0), ("a", 3, None), ("b", 0, 5.0)], "k string, t int, x double")
    got = {(r.k, r.t): r.ema for r in ema(d, ["k"], "t", "x", 1.0).collect()}
    assert got == {("a", 0): None, ("a", 1): 3.0, ("a", 2): 3.0, ("a", 3): 3.0, ("b", 0): 5.0}
