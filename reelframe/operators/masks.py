"""Masks and objects: run lengths, areas, agreement counts, new objects and label helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.operators.ordered import rank0, running


def rle_encode(mask_px: DataFrame, keys: list[str], h: int, w: int, masks: DataFrame | None = None) -> DataFrame:
    """Column-major run lengths of the set pixels (keys, u, v): rows (keys, run, length). Even runs are
    background, and run 0 has length 0 when the first pixel is set. A mask of `masks` (keys) without pixels is one run of h * w."""
    d = mask_px.select(*keys, (F.col("u").cast("long") * h + F.col("v")).alias("pos"))
    # set pixels in a row have one difference of position and rank
    runs = rank0(d, keys, "pos", "__r").groupBy(*keys, (F.col("pos") - F.col("__r")).alias("__isle")).agg(
        F.min("pos").alias("lo"), F.count("*").alias("n"))
    end = runs.groupBy(*keys).agg(F.max("lo").alias("__last"))
    runs = running(runs, keys, "lo", {"__k": ("count", F.lit(1)), "__end": ("last", F.col("lo") + F.col("n"))}, include_current=False)
    runs = runs.join(end, keys)
    r = F.coalesce("__k", F.lit(0)) * 2
    gap = F.col("lo") - F.coalesce("__end", F.lit(0))
    tail = F.when(F.col("lo") == F.col("__last"), F.lit(h * w) - F.col("lo") - F.col("n"))
    parts = F.array(F.struct(r.alias("run"), gap.alias("length")), F.struct((r + 1).alias("run"), F.col("n").alias("length")),
                    F.struct((r + 2).alias("run"), F.when(tail > 0, tail).alias("length")))
    out = runs.select(*keys, F.explode(parts).alias("p")).select(*keys, "p.run", "p.length").filter("length IS NOT NULL")
    if masks is None:
        return out
    bare = masks.select(*keys).distinct().join(mask_px.select(*keys).distinct(), keys, "left_anti")
    return out.unionByName(bare.select(*keys, F.lit(0).cast(out.schema["run"].dataType).alias("run"), F.lit(h * w).cast("long").alias("length")))


def rle_decode(runs: DataFrame, keys: list[str], h: int) -> DataFrame:
    """Set pixels (keys, u, v) of run lengths."""
    d = running(runs, keys, "run", {"__start": ("sum", F.col("length"))}, include_current=False)
    d = d.filter((F.col("run") % 2 == 1) & (F.col("length") > 0)).withColumn("__start", F.coalesce("__start", F.lit(0)))
    pos = F.explode(F.sequence(F.col("__start"), F.col("__start") + F.col("length") - 1)).alias("pos")
    return d.select(*keys, pos).select(*keys, F.floor(F.col("pos") / h).alias("u"), (F.col("pos") % h).alias("v"))


def rle_area(counts: Column) -> Column:
    """Set pixels of a run-length array: sum of the odd runs."""
    return F.aggregate(F.filter(counts, lambda x, i: i % 2 == 1), F.lit(0).cast("long"), lambda s, x: s + x)


def mask_area_box(px: DataFrame, keys: list[str], masks: DataFrame | None = None) -> DataFrame:
    """Area and tight xyxy box per mask; masks without pixels get zeros."""
    g = px.groupBy(*keys).agg(F.count("*").alias("area"), F.min("u").alias("x0"), F.min("v").alias("y0"),
                              F.max("u").alias("x1"), F.max("v").alias("y1"))
    if masks is None:
        return g
    return masks.join(g, keys, "left").na.fill(0, ["area", "x0", "y0", "x1", "y1"])


def stability_score(px: DataFrame, keys: list[str], logit: str, t: float, offset: float) -> DataFrame:
    """Pixels above t + offset per pixel above t - offset."""
    x = F.col(logit)
    return px.groupBy(*keys).agg(F.try_divide(F.count_if(x > t + offset), F.count_if(x > t - offset)).alias("stability"))


def mask_iou(a: DataFrame, b: DataFrame, keys: list[str], masks: DataFrame | None = None) -> DataFrame:
    """Intersection / max(union, 1) of two pixel sets; a mask of `masks` (keys) without pixels in either set has 0."""
    on = [*keys, "u", "v"]
    j = a.select(*on, F.lit(1).alias("a")).join(b.select(*on, F.lit(1).alias("b")), on, "full")
    g = j.groupBy(*keys).agg((F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull())
                              / F.greatest(F.count("*"), F.lit(1))).alias("iou"))
    return g if masks is None else masks.select(*keys).distinct().join(g, keys, "left").na.fill(0.0, ["iou"])


def confusion(df: DataFrame, pred: str, gt: str) -> DataFrame:
    p, g = F.col(pred) == 1, F.col(gt) == 1
    return df.agg(F.count_if(p & g).alias("tp"), F.count_if(p & ~g).alias("fp"),
                  F.count_if(~p & ~g).alias("tn"), F.count_if(~p & g).alias("fn"))


def topk_accuracy(df: DataFrame, scores: str, target: str, ks: list[int]) -> DataFrame:
    """Share (%) of rows whose class is among the k best scores; ties go to the lower class."""
    s, t = F.col(scores), F.col(target).cast("int")
    own = F.get(s, t)
    rank = F.size(F.filter(s, lambda x, i: (x > own) | ((x == own) & (i < t)))) + 1
    d = df.select(F.when(own.isNotNull(), rank).alias("r"))
    return d.agg(*[F.coalesce(F.avg(F.when(F.col("r") <= k, 100.0).otherwise(0.0)), F.lit(0.0)).alias(f"top{k}") for k in ks])


def onehot_accuracy(df: DataFrame, pred: str, target: str) -> DataFrame:
    """Share (%) of rows whose vectors agree within 1e-4 in total."""
    diff = F.aggregate(F.zip_with(pred, target, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return df.agg((F.avg((diff < 1e-4).cast("double")) * 100).alias("accuracy"))


def best_metric(df: DataFrame, value: str, epoch: str, init: float, better: str = "large", is_ema: Column | None = None) -> DataFrame:
    """Best value and its first epoch, strictly better than the start value; -1 when none is. With
    `is_ema` the variants all, regular and ema."""
    d = df.select(F.col(value).alias("x"), F.col(epoch).alias("e"), (is_ema if is_ema is not None else F.lit(False)).alias("ema"))
    kinds = F.array(F.lit("all"), F.when(F.col("ema"), "ema").otherwise("regular")) if is_ema is not None else F.array(F.lit("all"))
    d = d.select("x", "e", F.explode(kinds).alias("variant"))
    best = F.max("x") if better == "large" else F.min("x")
    at = F.max_by("e", F.struct("x", -F.col("e"))) if better == "large" else F.min_by("e", F.struct("x", "e"))
    ok = (F.col("b") > init) if better == "large" else (F.col("b") < init)
    g = d.groupBy("variant").agg(best.alias("b"), at.alias("at"))
    return g.select("variant", F.when(ok, F.col("b")).otherwise(F.lit(init)).alias("best_res"),
                    F.when(ok, F.col("at")).otherwise(F.lit(-1)).cast("long").alias("best_ep"))


def object_ids(df: DataFrame, frame: str, obj: str) -> DataFrame:
    """Distinct non-zero ids per frame with their number and the largest, as rows (frame, obj, n, max)."""
    ids = df.filter(F.col(obj) != 0).select(frame, obj).distinct()
    n = ids.groupBy(frame).agg(F.count("*").alias("n"), F.max(obj).alias("max_id"))
    return ids.join(n, frame)


def new_objects(px: DataFrame, frame: str, track: str, seg: str, start: int, min_ratio: float = 0.8, min_area: int = 200,
                max_id: int = 255) -> DataFrame:
    """New objects of a segmentation over untracked pixels: accepted when enough of the object is new and
    large enough; ids follow `start` in segment order within the budget."""
    g = px.filter(F.col(seg) != 0).groupBy(frame, seg).agg(
        F.count("*").alias("area"), F.count_if(F.col(track) == 0).alias("new_area")).filter("new_area > 0")
    ok = g.filter((F.col("new_area") / F.col("area") >= min_ratio) & (F.col("new_area") >= min_area))
    d = rank0(ok, [frame], seg, "__r")
    return d.withColumn("new_id", F.col("__r") + start).filter(F.col("new_id") <= max_id).drop("__r")


def frame_phrases(ids: DataFrame, phrases: DataFrame, frame: str, obj: str) -> DataFrame:
    """Phrases of exactly the ids present in each frame."""
    return ids.select(frame, obj).distinct().join(phrases, obj)


def phrase_class(phrase: Column, classes: list[str]) -> Column:
    """Position of the first class contained in the phrase, else null."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(classes))):
        out = F.when(phrase.contains(classes[i]), i).otherwise(out)
    return out


def best_phrase(tokens: DataFrame, keys: list[str], order: str, token: str, score: str, sep: str = ".") -> DataFrame:
    """Phrase with the largest token score sum among the separator-ended phrases; the first on ties."""
    t = F.col(token)
    d = running(tokens, keys, order, {"__seg": ("sum", F.when(t == sep, 1).otherwise(0))}, include_current=False)
    d = d.withColumn("__seg", F.coalesce("__seg", F.lit(0))).filter(t != sep)
    g = d.groupBy(*keys, "__seg").agg(
        F.sum(score).alias("score"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), t.alias("t")))), lambda x: x["t"]), " ").alias("phrase"))
    g = g.withColumn("score", F.round("score", 9))
    return g.groupBy(*keys).agg(F.max_by("phrase", F.struct("score", -F.col("__seg"))).alias("phrase"), F.max("score").alias("score"))


def label_color(label: Column) -> list[Column]:
    """Colour of an object id by spreading its bits: red, green, blue."""
    bit = lambda m, s: F.shiftleft(label.bitwiseAND(F.lit(m)), s) if s >= 0 else F.shiftright(label.bitwiseAND(F.lit(m)), -s)
    return [bit(1, 7).bitwiseOR(bit(8, 3)).bitwiseOR(bit(64, -1)),
            bit(2, 6).bitwiseOR(bit(16, 2)).bitwiseOR(bit(128, -2)),
            bit(4, 5).bitwiseOR(bit(32, 1))]


def one_hot(label: Column, classes: int) -> Column:
    """Vector over 0..classes with a 1 at the label."""
    return F.transform(F.sequence(F.lit(0), F.lit(classes)), lambda i: F.when(i == label, 1.0).otherwise(0.0))


def compact_ids(df: DataFrame, keys: list[str], obj: str, out: str = "compact") -> DataFrame:
    """Dense ids from 1 in the order of the original ones, per group."""
    ids = rank0(df.select(*keys, obj).distinct(), keys, obj, "__r")
    return df.join(ids, [*keys, obj]).withColumn(out, F.col("__r") + 1).drop("__r")
