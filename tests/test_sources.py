"""Readers, writers and edge cases on small files."""

import json

import pytest
from pyspark.sql import functions as F

from reelframe import schemas
from reelframe.functions import text as TX
from reelframe.functions import udf as U
from reelframe.operators import masks as M
from reelframe.operators import sampling as SA
from reelframe.operators import scoring as Q
from reelframe.operators import telemetry as T
from reelframe.session import shared_dir
from reelframe.sources import artifacts as A
from reelframe.sources import files as FS
from reelframe.sources import shards as S


def test_shards_from_documents(spark, tmp_path):
    for r in range(3):
        (tmp_path / f"shard_{r}.json").write_text(json.dumps({
            "rank": r, "world_size": 4, "results": [{"name": f"v{r}", "frames": 2, "scores": {"psnr": 1.0 + r, "clip": 0.5}}],
            "per_sample": [{"name": f"v{r}", "wall_s": 2.0, "cpu_s": 1.0, "gpu_busy_s": None}]}, indent=1))
    (tmp_path / "summary.json").write_text("{}")
    sh = S.scan_shards(spark, str(tmp_path), "shard_*.json")
    got = {(r["rank"], r["name"], r["metric"], r["value"]) for r in S.explode_results(sh).collect()}
    assert (2, "v2", "psnr", 3.0) in got and len(got) == 6
    assert S.explode_per_sample(sh).filter("gpu_busy_s IS NULL").count() == 3
    assert [r["rank"] for r in Q.missing_shards(sh, 4).collect()] == [3]


def test_no_shards_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        S.scan_shards(spark, str(tmp_path), "shard_*.json")


def test_metadata_needs_sequence(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,num_frames\nx,3\n")
    with pytest.raises(ValueError, match="sequence"):
        S.scan_metadata_csv(spark, str(tmp_path / "a.csv"))


def test_manifest_and_trace(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"source": "s", "frames": 81, "fps": 16.0, "videos": [
        {"name": "a", "frames": 81, "degrade_strength": 0.2}, {"name": "b", "frames": 40, "degrade_strength": 0.4}]}, indent=1))
    assert {(r["name"], r["frames"]) for r in S.scan_manifest(spark, str(tmp_path / "m.json")).collect()} == {("a", 81), ("b", 40)}
    (tmp_path / "load.txt").write_text("1700000000 1.5 1.0 0.5\n1700000001.5 2.5 1.0 0.5\n")
    assert [r["l1"] for r in S.scan_load_trace(spark, str(tmp_path / "load.txt")).orderBy("ts").collect()] == [1.5, 2.5]


def test_sweep_and_summary_fallback(spark, tmp_path):
    (tmp_path / "sweep.json").write_text(json.dumps({"rows": [{"arm": "x", "G": 1, "rep": 0, "rc": 0, "wall_s": 3.0}]}, indent=1))
    assert S.scan_sweep(spark, str(tmp_path / "sweep.json")).first()["wall_s"] == 3.0
    assert S.read_summary(spark, [str(tmp_path / "no"), str(tmp_path / "neither")], "a INT").count() == 0


def test_listing_ignores_case_of_extension(spark, tmp_path):
    for f in ("b.PNG", "a.jpg", "c.txt", "d.png"):
        (tmp_path / f).write_bytes(b"x")
    got = FS.list_clips(FS.list_paths(spark, str(tmp_path)), FS.IMAGE_EXTS)
    assert [r["file"] for r in got.collect()] == ["a.jpg", "b.PNG", "d.png"]


def test_artifact_index(spark):
    paths = [(f"/o/{d}/v1{s}",) for d, s in FS.ARTIFACTS.values()] + [("/o/rgb/v2.mp4",), ("/o/rgb/x.txt",)]
    got = {r["name"]: r for r in FS.artifact_index(spark.createDataFrame(paths, "path string")).collect()}
    assert got["v1"]["complete"] and not got["v2"]["complete"] and set(got) == {"v1", "v2"}


def test_phrases_with_second_colon(spark):
    d = spark.createDataFrame([("3: sky: blue",)], "value string")
    assert S.parse_phrases(d).first()[:] == (3, "sky: blue")


def test_logs_drop_other_lines(spark):
    d = spark.createDataFrame([("[rank 3] 2/8 clip_1 wall=12.50s cpu=3.1s gpu_util=5%",), ("loading",)], "line string")
    r = S.parse_logs(d).collect()
    assert len(r) == 1 and r[0]["rank"] == 3 and r[0]["cpu_s"] == 3.1 and r[0]["name"] == "clip_1"


def test_corrupt_first_frame_is_an_error(spark):
    d = spark.createDataFrame([("a", 0, False, None, None, None), ("a", 1, True, 1, 2, [1.0, 2.0])],
                              "clip string, i int, ok boolean, h int, w int, px array<double>")
    with pytest.raises(Exception, match="first frame"):
        A.fill_corrupt_frames(d, ["clip"], "i", F.col("ok"), "h", "w", "px").collect()


def test_pinhole_with_five_parameters_is_an_error(spark):
    d = spark.createDataFrame([("a", 0, 1.0, 0.1)], "clip string, frame_idx int, fx double, k1 double")
    with pytest.raises(Exception, match="five parameters"):
        A.read_intrinsics(d, None).collect()


def test_min_frames_without_column(spark):
    d = spark.createDataFrame([("a",)], "name string")
    assert SA.min_frames(d, 5).count() == 1


def test_pingpong_and_padding(spark):
    d = spark.createDataFrame([("a", i) for i in range(4)] + [("one", 0)], "name string, pos long")
    got = {}
    for r in SA.pingpong_extend(d, 9).collect():
        got.setdefault(r["name"], {})[r["out_idx"]] = r["pos"]
    assert [got["a"][i] for i in range(9)] == [0, 1, 2, 3, 2, 1, 0, 1, 2] and set(got["one"].values()) == {0} and len(got["one"]) == 9
    pad = {r["out_idx"]: r["pos"] for r in SA.pad_last(d, 2, 5).filter("name = 'a'").collect()}
    assert pad == {0: 2, 1: 3, 2: 3, 3: 3, 4: 3}


def test_sampling_is_repeatable_and_complete(spark):
    d = spark.range(500).select((F.col("id") % 3).alias("frame"), F.col("id").alias("u"), F.lit(0).alias("v"))
    a = {tuple(r) for r in SA.sample_n(d, ["frame"], 20, 1, ["u", "v"]).collect()}
    assert a == {tuple(r) for r in SA.sample_n(d.repartition(7), ["frame"], 20, 1, ["u", "v"]).collect()} and len(a) == 60
    assert SA.sample_n(d, ["frame"], 9999, 1, ["u", "v"]).count() == 500


def test_merge_does_not_depend_on_the_shards(spark):
    rows = [("psnr", i % 5, float(i)) for i in range(40)]
    d = spark.createDataFrame(rows, "metric string, rank int, value double")
    one = Q.merge_scores(d).first()["mean"]
    two = Q.merge_scores(d.withColumn("rank", F.col("rank") % 2)).first()["mean"]
    assert one == two == pytest.approx(19.5)


def test_empty_and_zero_inputs(spark):
    e = spark.createDataFrame([], "run string, rank int, wall_s double, cpu_s double, gpu_busy_s double")
    assert T.sample_summary(e, ["run"]).count() == 0
    z = spark.createDataFrame([("a", 0, 0.0, 0.0, None)], e.schema)
    r = T.sample_summary(z, ["run"]).first()
    assert r["cpu_parallelism"] is None and r["gpu_busy_mean_s"] is None and r["n"] == 1
    assert T.straggler_imbalance(z).first()["shard_imbalance"] is None


def test_rle_round_trip(spark):
    px = spark.createDataFrame([(0, 0, 0), (0, 0, 1), (0, 1, 3), (1, 2, 3)], "frame int, u int, v int")
    runs = M.rle_encode(px, ["frame"], 4, 3)
    got = {}
    for r in runs.collect():
        got.setdefault(r["frame"], {})[r["run"]] = r["length"]
    assert got[0] == {0: 0, 1: 2, 2: 5, 3: 1, 4: 4} and got[1] == {0: 11, 1: 1}
    back = {(r["frame"], r["u"], r["v"]) for r in M.rle_decode(runs, ["frame"], 4).collect()}
    assert back == {tuple(r) for r in px.collect()}


def test_processor_must_declare_its_columns(spark):
    with pytest.raises(ValueError, match="declared"):
        U.processor(spark.range(3), lambda d: d.withColumn("x", F.lit(1)), "x double")


def test_iterator_processor_blocks_do_not_show(spark):
    d = spark.range(50).select(F.lit("a").alias("clip"), F.col("id").alias("pos"))
    fn = lambda p: p.assign(s=p["pos"].rolling(3, min_periods=1).sum())
    whole = {tuple(r) for r in U.iterator_processor(d, ["clip"], "pos", fn, "clip string, pos long, s double", 2, 0, 1000).collect()}
    cut = {tuple(r) for r in U.iterator_processor(d, ["clip"], "pos", fn, "clip string, pos long, s double", 2, 0, 7).collect()}
    assert whole == cut and len(cut) == 50


def test_classify_pattern(spark):
    d = spark.createDataFrame([("2000",), ("downscale_8",), ("distance_1_5",), ("LiDAR_16",), ("sift",)], "s string")
    got = [tuple(r[0]) for r in d.select(TX.classify_pattern(F.col("s"))).collect()]
    assert got == [("count", 2000, None), ("downscale", 8, None), ("distance", 1, 5), ("lidar", 16, None), (None, None, None)]


def test_checkpoint_folder_is_kept(spark):
    assert shared_dir(spark) == shared_dir(spark)
    assert "per_sample ARRAY<STRUCT<name: STRING" in schemas.SHARD
