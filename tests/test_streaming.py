"""Streams over several batches against the batch result; state must survive from batch to batch."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reelframe.operators import telemetry as T
from reelframe.streaming import core as C
from reelframe.streaming import monitors as MO
from reelframe.streaming import stateful as ST


@pytest.fixture(scope="module")
def timing(spark, tmp_path_factory):
    rng = np.random.default_rng(2)
    n = 120
    pdf = pd.DataFrame({"run": np.where(np.arange(n) % 3 == 0, "a", "b"), "rank": np.arange(n) % 2, "sample_id": np.arange(n),
                        "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n) * 7, unit="s"),
                        "wall_s": rng.uniform(1, 30, n).round(2), "gpu": rng.uniform(0, 5, n).round(3)})
    df = spark.createDataFrame(pdf).withColumn("gpu", F.when(F.col("sample_id") % 5 != 2, F.col("gpu")))
    path = str(tmp_path_factory.mktemp("timing"))
    # four files in order of arrival
    for i in range(4):
        df.filter((F.col("sample_id") >= i * 30) & (F.col("sample_id") < (i + 1) * 30)).coalesce(1).write.mode("append").parquet(path)
        for f in os.listdir(path):
            if f.endswith(".parquet") and os.path.getmtime(os.path.join(path, f)) > 1_600_000_000:
                os.utime(os.path.join(path, f), (1_500_000_000 + i * 100,) * 2)
    return df, path


def stream(timing):
    df, path = timing
    return C.folder_stream(df, path, files_per_batch=1)


def rows(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def test_chunks_continue_over_batches(spark, timing):
    got = ST.chunk_numbers(stream(timing), "run", "sample_id", 16)
    pdf = timing[0].toPandas().sort_values("sample_id")
    pdf["chunk"] = pdf.groupby("run").cumcount() // 16
    assert rows(got, "run", "sample_id", "chunk") == set(pdf[["run", "sample_id", "chunk"]].itertuples(index=False, name=None))


def test_ema_equals_batch(spark, timing):
    got = {r["sample_id"]: r["ema"] for r in ST.ema(stream(timing), "run", "sample_id", "gpu", 0.9).collect()}
    want = {r["sample_id"]: r["ema"] for r in T.ema(timing[0], ["run"], "sample_id", "gpu", 0.9).collect()}
    assert got.keys() == want.keys()
    assert all((got[k] is None and want[k] is None) or got[k] == pytest.approx(want[k]) for k in got)


def test_smoothed_equals_batch(spark, timing):
    got = {r["sample_id"]: r["stats"] for r in ST.smoothed(stream(timing), "rank", "sample_id", "wall_s", 20).collect()}
    for r in T.smoothed(timing[0].select("rank", "sample_id", "wall_s"), ["rank"], "sample_id", "wall_s", 20).collect():
        assert got[r["sample_id"]] == pytest.approx([r["median"], r["mean"], r["max"], r["global_mean"]])


def test_keyframes_equal_batch(spark, timing):
    from reelframe.operators.ordered import rank0

    got = rows(ST.keyframes(stream(timing), "run", "sample_id", "wall_s", 8.0, width=8).filter("keep"), "run", "sample_id")
    d = rank0(timing[0], ["run"], "sample_id", "pos")
    k = ST.keyframes_batch(d, "run", "pos", "wall_s", 8.0, width=8).filter("keep")
    assert got == rows(d.join(k, ["run", "pos"]), "run", "sample_id")


def test_load_peak_keeps_every_window(spark, timing):
    trace = lambda d: d.select("ts", F.col("wall_s").alias("l1"))
    got = MO.run_load_peak(trace(stream(timing)), 25.0, "1 minute")
    assert rows(got, "start", "peak", "n", "alert") == rows(MO.load_peak(trace(timing[0]), 25.0), "start", "peak", "n", "alert")


def test_best_so_far_over_batches(spark, timing):
    got = MO.best_so_far(stream(timing), "run", "wall_s", "sample_id", 0.0)
    pdf = timing[0].toPandas()
    want = {(k, g["wall_s"].max(), g.loc[g["wall_s"].idxmax(), "sample_id"]) for k, g in pdf.groupby("run")}
    assert rows(got, "run", "best_res", "best_ep") == want
    none = MO.best_so_far(stream(timing), "run", "wall_s", "sample_id", 1e9)
    assert {r["best_ep"] for r in none.collect()} == {-1}


def test_utilisation_join_equals_batch(spark, timing):
    ticks = lambda d: d.select("ts", F.col("wall_s").alias("util"))
    got = MO.run(MO.utilisation_matches(stream(timing), ticks(stream(timing))))
    want = MO.utilisation_matches(timing[0], ticks(timing[0]))
    assert rows(got, "sample_id", "tick") == rows(want, "sample_id", "tick") and want.count() > 120


def registry_case(spark, tmp_path):
    """Twelve range files in six batches, objects that come again, one frame with half of them."""
    rng = np.random.default_rng(3)
    seen = [(int(f if k % 2 else 20), int(rng.integers(0, 400)), f"p{k}") for k, f in enumerate(rng.integers(0, 60, 1500))]
    d = spark.createDataFrame(seen, "frame long, obj_id int, phrase string")
    path = str(tmp_path / "objects")
    d.repartitionByRange(12, "frame", "obj_id").write.parquet(path)
    assert C.stamp_order(spark, path) == 12
    first = {}
    for f, o, p in sorted(seen):
        first.setdefault(o, (f, p))
    want = {(o, f, p, k) for k, (o, (f, p)) in enumerate(sorted(first.items(), key=lambda x: (x[1][0], x[0])))}
    return C.folder_stream(d, path, files_per_batch=2), want


def test_registry_over_many_files_and_batches(spark, tmp_path):
    stream, want = registry_case(spark, tmp_path)
    assert rows(MO.object_registry(stream), "obj_id", "first_frame", "phrase", "reg_id") == want


def test_registry_batch_that_runs_again(spark, tmp_path, monkeypatch):
    stream, want = registry_case(spark, tmp_path)
    plain = C.run_batches

    def twice(df, step, **kw):
        def both(batch, number, path):
            step(batch, number, path)
            return step(batch, number, path)

        return plain(df, both, **kw)

    monkeypatch.setattr(MO, "run_batches", twice)
    assert rows(MO.object_registry(stream), "obj_id", "first_frame", "phrase", "reg_id") == want


def test_upsert_replaces_touched_buckets_only(spark, tmp_path):
    from reelframe.streaming.upsert import Upsert

    t = Upsert(spark, str(tmp_path / "t"), ["k"], "k int, x string", buckets=8)
    frame = lambda r: spark.createDataFrame(r, "k int, x string")
    assert t.read().count() == 0
    base = frame([(k, "a") for k in range(40)])
    t.write(base, base, 0)
    change = frame([(3, "b"), (41, "n")])
    gone = frame([(3, ""), (5, ""), (41, "")])
    want = {(k, "a") for k in range(40) if k not in (3, 5)} | {(3, "b"), (41, "n")}
    for _ in range(2):
        t.write(change, gone, 1)
        assert rows(t.read(), "k", "x") == want
    assert len(list((tmp_path / "t/data/v=1").glob("bucket=*"))) <= 3
    assert rows(t.read(before=1), "k", "x") == {(k, "a") for k in range(40)}
    # a batch that stopped before its list was written is not seen
    frame([(7, "lost")]).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(str(tmp_path / "t/data/v=2"))
    assert rows(t.read(), "k", "x") == want
    t.write(frame([]), frame([(k, "") for k in range(50)]), 2)
    assert t.read().count() == 0


def test_dirty_refresh_equals_the_batch_twin_after_repeats(spark, tmp_path):
    rng = np.random.default_rng(9)
    now, folder = {}, str(tmp_path / "changes")
    for k in range(4):
        part = {(int(i), int(j)): int(rng.integers(0, 99)) for i, j in zip(rng.integers(0, 5 if k else 30, 60), rng.integers(0, 20, 60))}
        now |= part
        spark.createDataFrame([(i, j, a) for (i, j), a in part.items()], "i int, j int, age int").coalesce(1).write.parquet(f"{folder}/{k}")
    assert C.stamp_order(spark, folder, "*/part-*") == 4
    like = spark.createDataFrame([], "i int, j int, age int")
    made = []

    def derive(d):
        made.append(d.select("i").distinct().count())
        return d.groupBy("i").agg(F.count("*").alias("n"), F.sum("age").alias("s"))

    class Twice:
        """A stream whose batches each run twice."""

        def __init__(self, df):
            self.df = df

        def __getattr__(self, name):
            return getattr(self.df, name)

        @property
        def writeStream(self):
            outer = self.df.writeStream

            class Writer:
                def foreachBatch(self, step):
                    return outer.foreachBatch(lambda b, n: (step(b, n), step(b, n)))

            return Writer()

    source, derived = MO.dirty_refresh(Twice(C.folder_stream(like, folder, files_per_batch=1)), ["i", "j"], "i", "i int, n long, s long", derive, buckets=4)
    assert rows(source, "i", "j", "age") == {(i, j, a) for (i, j), a in now.items()}
    want = {}
    for (i, _), a in now.items():
        n, s = want.get(i, (0, 0))
        want[i] = (n + 1, s + a)
    assert rows(derived, "i", "n", "s") == {(i, n, s) for i, (n, s) in want.items()}
    # the first batch makes all, the later ones only what changed
    assert len(made) == 8 and max(made[2:]) <= 5 < made[0]


def keyframes_of(frames, thresh):
    """frames: (x, {(view, kp): (u, v)}) in order."""
    kept, last, n = [], None, 0
    for k, (x, seen) in enumerate(frames):
        keep = last is None
        if last is not None:
            common = last[1].keys() & seen.keys()
            views = {v for v, _ in common}
            sparse = sum(np.mean([np.hypot(*np.subtract(last[1][c], seen[c])) for c in common if c[0] == v]) for v in views)
            keep = abs(x - last[0]) > thresh or sparse > 2 * thresh or (n > 0 and (n - len(common)) / n > 0.2)
            n = len(common)
        if keep:
            kept.append(k)
            last, n = (x, seen), 0
    return kept + [len(frames) - 1]


def test_keyframes_by_tracks_over_batches_and_blocks(spark, tmp_path):
    rng = np.random.default_rng(11)
    clips, out = {}, []
    for clip, n in (("hot", 150), ("b", 30), ("c", 1)):
        x, at, frames = 0.0, {}, []
        for k in range(n):
            x += rng.normal(0, 0.4)
            at = {c: p for c, p in at.items() if rng.random() > 0.04} | {(int(rng.integers(2)), int(rng.integers(30))): (float(rng.uniform(0, 50)), 1.0) for _ in range(3)}
            at = {c: (u + float(rng.normal(0, 0.7)), v) for c, (u, v) in at.items()}
            frames.append((x, dict(at)))
            out.append((clip, k, x, [(v, p, float(u), float(w)) for (v, p), (u, w) in at.items()]))
        clips[clip] = frames
    d = spark.createDataFrame(out, "clip string, frame int, x double, tracks array<struct<view_id:int,kp:int,u:double,v:double>>")
    path = str(tmp_path / "frames")
    d.repartitionByRange(3, "frame").write.parquet(path)
    C.stamp_order(spark, path)
    want = {(c, k) for c, f in clips.items() for k in keyframes_of(f, 2.0)}
    got = ST.keyframes(C.folder_stream(d, path, files_per_batch=1), "clip", "frame", "x", 2.0, width=16, tracks="tracks")
    assert got.count() == len(out)
    assert rows(got.filter("keep"), "clip", "frame") == want
    batch = ST.keyframes_batch(d, "clip", "frame", "x", 2.0, width=16, tracks="tracks").filter("keep")
    assert rows(batch, "clip", "frame") == want
    assert 20 < len(want) < 150


def test_tracks_reach_python_as_numbers(spark):
    """Arrays of numbers, not an object per track; a track without a place is in common but moves nothing."""
    rows_ = [("a", k, 0.0, [("left", None, 1.0, 1.0), ("left", 2, None, 1.0), ("right", 2, 5.0 + 9 * (k == 2), 1.0)]) for k in range(4)]
    d = spark.createDataFrame(rows_, "clip string, frame int, x double, tracks array<struct<view_id:string,kp:bigint,u:double,v:double>>")
    flat, names = ST._flat_tracks(d, "tracks")

    def kinds(pdfs):
        for pdf in pdfs:
            yield pd.DataFrame({"kind": [str(np.asarray(x).dtype.kind) for c in names[1:] for x in pdf[c]]})

    assert {r.kind for r in flat.mapInPandas(kinds, "kind string").collect()} <= {"i", "f"}
    got = rows(ST.keyframes_batch(d, "clip", "frame", "x", 2.0, width=2, tracks="tracks").filter("keep"), "frame")
    assert got == {(0,), (2,), (3,)}


def test_a_hot_key_is_several_tasks(spark):
    from reelframe.operators.ordered import fold_blocks

    d = spark.range(4000).select(F.lit("hot").alias("k"), F.col("id").alias("t"), (F.col("id") * 0.1).alias("x"))

    def fold(pdf, state):
        return pd.DataFrame({"n": [len(pdf)] * len(pdf)}), 1.0

    done, ends = fold_blocks(d, ["k"], "t", ["x"], fold, "double", "n int", 250)
    assert done.agg(F.max("n")).first()[0] == 250 and done.count() == 4000 and ends.count() == 1


def test_tables_in_one_file_or_many_lose_no_rows(spark, tmp_path):
    base = spark.range(90).select(F.col("id"), (F.timestamp_seconds(F.lit(1_700_000_000) - F.col("id") * 600)).alias("ts"), (F.col("id") % 7).cast("double").alias("l1"))
    base.repartition(4).write.parquet(str(tmp_path / "many.parquet"))
    base.coalesce(1).write.parquet(str(tmp_path / "one"))
    next((tmp_path / "one").glob("part-*.parquet")).rename(tmp_path / "single.parquet")
    want = sorted(map(tuple, MO.load_peak(base, 5.0, "1 hour").collect()))
    for name in ("many", "single"):
        got = MO.run_load_peak(C.table_stream(spark, str(tmp_path), name, files_per_batch=1), 5.0, "1 hour")
        assert sorted(map(tuple, got.collect())) == want
    assert sum(r[3] for r in want) == 90


def test_keyed_state_refuses_files_out_of_order(spark, tmp_path):
    frames = spark.createDataFrame([("a", i, float(i)) for i in range(20)], "clip string, frame long, x double")
    for k, part in enumerate(("frame >= 10", "frame < 10")):
        frames.filter(part).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        import os
        import time
        for f in (tmp_path / f"in/{k}").glob("*.parquet"):
            os.utime(f, (time.time() - 100 + k, time.time() - 100 + k))
    stream = C.folder_stream(frames, str(tmp_path / "in"), files_per_batch=1)
    with pytest.raises(Exception, match="out of order"):
        ST.keyframes(stream, "clip", "frame", "x").count()


def test_pair_frames_over_batches(spark, tmp_path, monkeypatch):
    """Sides that arrive in other batches, repeated rows, null keys and times, a pair beyond the hour; every batch runs twice."""
    rng = np.random.default_rng(4)
    t0 = pd.Timestamp("2024-01-01")
    made = {}
    for s in ("raw", "gen"):
        rows_ = [(int(n) if n else None, int(f), None if k == 7 else (t0 + pd.Timedelta(minutes=int(m))).to_pydatetime(), float(k))
                 for k, (n, f, m) in enumerate(zip(rng.integers(0, 12, 300), rng.integers(0, 4, 300), rng.integers(0, 240, 300)))]
        made[s] = spark.createDataFrame(rows_ + rows_[:5], "name long, frame int, arrived timestamp, value double")
        made[s].repartition(6 if s == "raw" else 3).write.parquet(str(tmp_path / s))
    plain, numbers = C.run_batches, []

    def twice(df, step, **kw):
        def again(batch, number, path):
            numbers.append(number)
            step(batch, number, path).count()
            return step(batch, number, path)

        return plain(df, again, **kw)

    monkeypatch.setattr(MO, "run_batches", twice)
    got = MO.run_pair_frames(*(C.folder_stream(made[s], str(tmp_path / s), files_per_batch=2) for s in ("raw", "gen")), ["name", "frame"])
    want = MO.pair_frames(made["raw"], made["gen"], ["name", "frame"])
    table = lambda d: sorted(map(tuple, d.select("name", "frame", "raw_value", "gen_value").collect()))
    assert numbers == [0, 1, 2] and 500 < want.count() and table(got) == table(want)
    assert got.columns == want.columns


@pytest.mark.parametrize("on", [None, "rank"])
def test_utilisation_totals_are_those_of_the_matches(spark, tmp_path, monkeypatch, on):
    """Intervals from none to days, before 1970 too, at bucket borders; repeated rows and ids, nulls, NaN; several batches that run twice."""
    rng = np.random.default_rng(6)
    base = [-5_000_000, 0, 1 << 40, (1 << 40) + 3]
    walls = [0.0, 1e-6, 3e-6, 8e-6, 2.0 ** 20 / 1e6, 0.5, 7.25, 61.0, 4000.0, 2e5, -3.0, None]
    spans = [3, 40, 3_000_000, 90_000_000, 9_000_000_000]
    at = lambda: int(base[rng.integers(4)]) + int(rng.integers(0, spans[rng.integers(5)]))
    made = {"s": [(None if k == 9 else int(k % 250), None if k == 8 else at(), walls[k % 12], None if k % 50 == 7 else int(k % 2)) for k in range(360)],
            "t": [(None if k == 5 else at(), None if k % 9 == 0 else float("nan") if k == 22 else float(rng.uniform(0, 100)), None if k % 40 == 3 else int(k % 2)) for k in range(900)]}
    schema = {"s": "sample_id long, us long, wall_s double, rank int", "t": "us long, util double, rank int"}
    df = {}
    for c, rows_ in made.items():
        df[c] = spark.createDataFrame(rows_ + rows_[:20], schema[c]).withColumn("ts", F.timestamp_micros("us"))
        df[c].repartition(5 if c == "s" else 3).write.parquet(str(tmp_path / c))
    plain, numbers = C.run_batches, []

    def twice(d, step, **kw):
        def again(batch, number, path):
            numbers.append(number)
            step(batch, number, path).count()
            return step(batch, number, path)

        return plain(d, again, **kw)

    monkeypatch.setattr(MO, "run_batches", twice)
    got = MO.run_utilisation_matches(*(C.folder_stream(df[c], str(tmp_path / c), files_per_batch=2) for c in ("s", "t")), on=on)
    m = MO.utilisation_matches(df["s"], df["t"], on=on)
    assert numbers == [0, 1, 2] and m.count() > 10_000
    # rows of totals: no more than the samples' ids in each of two parts of a batch, whatever the number of matches
    assert got.count() <= 2 * 3 * 251
    table = lambda d: sorted((str(r.sample_id), str(r.wall_s), r.ticks or 0, "" if r.util_mean is None else f"{r.util_mean:.9f}", str(r.busy_s)[:9]) for r in d.collect())
    for totals in (got, MO.utilisation_totals(df["s"], df["t"], on)):
        assert table(MO.utilisation(df["s"], totals)) == table(MO.utilisation(df["s"], m))


def test_utilisation_totals_do_not_grow_with_the_matches(spark):
    """Every sample meets every tick: no step of the plan that ran gives a row per pair."""
    n = 2000
    d = spark.range(n).select(F.col("id").alias("sample_id"), F.timestamp_micros(F.col("id") * 997).alias("ts"), F.lit(10.0).alias("wall_s"), F.col("id").alias("util"))
    got = MO.utilisation_totals(d.withColumn("ts", F.timestamp_micros(F.lit(0))), d)
    assert [tuple(r)[1:] for r in got.collect()] == [(n * (n - 1) / 2, n, n)] * n
    metrics, todo = [], [got._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if p.metrics().contains("numOutputRows"):
            metrics.append(p.metrics().apply("numOutputRows").value())
        if "AdaptiveSparkPlan" in p.nodeName():
            todo.append(p.executedPlan())
        elif "QueryStage" in p.nodeName():
            todo.append(p.plan())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    assert metrics and max(metrics) < 40 * n
