"""Joining of overlapping depth windows into one sequence per clip."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.operators.ordered import entries
from reelframe.session import cut


def _window_maps(pairs: DataFrame, key: str, counts) -> DataFrame:
    """The fit of each window as an affine map of the (scale, shift) of the window before: (key, pos, m00, m01, m10, m11, v0, v1).

    `counts` tells for each pair whether its reference moves with the window before; a reference clamped at 0 does not.
    """
    p, x, one = F.col("p"), F.col("x"), F.col("slot") == 1
    moves = lambda c: F.sum(F.when(one & counts, c).otherwise(0.0))
    fixed = lambda c: F.sum(F.when(one, 0.0).otherwise(c))
    g = pairs.groupBy(key, "window").agg(
        F.sum(p * p).alias("a00"), F.sum(p).alias("a01"), F.count("*").cast("double").alias("a11"), fixed(p * x).alias("f0"), fixed(x).alias("f1"),
        moves(p * x).alias("px"), moves(p).alias("p1"), moves(x).alias("x1"), moves(F.lit(1.0)).alias("n1"))
    det = F.col("a00") * F.col("a11") - F.col("a01") * F.col("a01")
    solve = lambda r0, r1: ((F.col("a11") * r0 - F.col("a01") * r1) / det, (F.col("a00") * r1 - F.col("a01") * r0) / det)
    (m00, m10), (m01, m11), (v0, v1) = solve(F.col("px"), F.col("x1")), solve(F.col("p1"), F.col("n1")), solve(F.col("f0"), F.col("f1"))
    # a window that cannot be fitted keeps its values
    safe = lambda c, other: F.when(det != 0, c).otherwise(other)
    return g.select(key, (F.col("window") - 1).cast("long").alias("pos"), safe(m00, 0.0).alias("m00"), safe(m01, 0.0).alias("m01"), safe(m10, 0.0).alias("m10"),
                    safe(m11, 0.0).alias("m11"), safe(v0, 1.0).alias("v0"), safe(v1, 0.0).alias("v1"))


def _chained(maps: DataFrame, key: str) -> DataFrame:
    """(key, window, s, b, scale, shift): the fit that enters each window and its own."""
    cols = ["m00", "m01", "m10", "m11", "v0", "v1"]
    state = lambda s, b: F.struct(s.alias("s"), b.alias("b"))
    apply = lambda e, m: state(m["m00"] * e["s"] + m["m01"] * e["b"] + m["v0"], m["m10"] * e["s"] + m["m11"] * e["b"] + m["v1"])

    def compose(f, m):
        row = lambda i, c: m[f"m{i}0"] * f[f"m0{c}"] + m[f"m{i}1"] * f[f"m1{c}"]
        add = lambda i: m[f"m{i}0"] * f["v0"] + m[f"m{i}1"] * f["v1"] + m[f"v{i}"]
        return F.struct(*(row(i, c).alias(f"m{i}{c}") for i in (0, 1) for c in (0, 1)), add(0).alias("v0"), add(1).alias("v1"))

    one = F.struct(*(F.lit(x).alias(c) for c, x in zip(cols, (1.0, 0.0, 0.0, 1.0, 0.0, 0.0))))
    start = state(F.lit(1.0), F.lit(0.0))
    e = maps.join(entries(maps, [key], "pos", cols, compose, apply, start, one), [key, "pos"])
    own = apply(F.col("entry"), F.struct(*cols))
    return e.select(key, (F.col("pos") + 1).cast("int").alias("window"), "entry.*", own.alias("o")).select(key, "window", "s", "b", F.col("o.s").alias("scale"), F.col("o.b").alias("shift"))


def stitch_windows(px: DataFrame, n_frames: DataFrame, key: str = "clip", length: int = 32, step: int = 22, interp: int = 8, align: int = 12) -> DataFrame:
    """Depth per (clip, frame, pixel) from window predictions (clip, window, slot, pix, depth); windows count from 0 without gaps.

    Window k is fitted to two reference frames: position 0 of the first window and position `align` of the
    window before, already aligned and clamped at 0. With the clamped pixels known a fit is an affine map of the fit before, so all fits of a clip
    follow from composing maps in parallel (`ordered.entries`). The first round clamps nothing; a round then looks up which pixels
    the fits clamp, and the maps of the windows where that changed are made again, until none does. Then overlapping positions cross-fade.
    """
    overlap = length - step
    lead = overlap - interp
    if lead != 2:
        raise ValueError("two positions must be left for the fit")
    d = px.select(key, "window", "slot", "pix", "depth")
    cur = d.filter("window > 0 AND slot < 2")
    ref0 = d.filter("window = 0 AND slot = 0").select(key, "pix", F.col("depth").alias("x"))
    ref1 = d.filter(F.col("slot") == align).select(key, (F.col("window") + 1).alias("window"), "pix", F.col("depth").alias("x"))
    pairs = cur.filter("slot = 0").join(ref0, [key, "pix"]).unionByName(
        cur.filter("slot = 1").join(ref1, [key, "window", "pix"]), allowMissingColumns=True)
    # read once per round below
    pairs = cut(pairs.select(key, "window", "slot", F.col("depth").alias("p"), "x"))
    maps = cut(_window_maps(pairs, key, F.lit(True)))
    fit, before = cut(_chained(maps, key)), None
    while True:
        # the first window's own reference is never clamped
        now = fit.select(key, "window", F.col("s").alias("s1"), F.col("b").alias("b1"))
        seen = pairs.filter("slot = 1 AND window > 1").join(now, [key, "window"])
        was = F.lit(True)
        if before is not None:
            seen = seen.join(before.select(key, "window", F.col("s").alias("s0"), F.col("b").alias("b0")), [key, "window"])
            was = F.col("s0") * F.col("x") + F.col("b0") > 0
        changed = cut(seen.filter((F.col("s1") * F.col("x") + F.col("b1") > 0) != was).select(key, "window").distinct())
        if changed.isEmpty():
            break
        again = pairs.join(changed, [key, "window"], "left_semi").join(now, [key, "window"])
        again = _window_maps(again, key, (F.col("window") == 1) | (F.col("s1") * F.col("x") + F.col("b1") > 0))
        maps = cut(maps.join(changed.select(key, (F.col("window") - 1).cast("long").alias("pos")), [key, "pos"], "left_anti").unionByName(again))
        fit, before = cut(_chained(maps, key)), fit
    fit = fit.select(key, "window", "scale", "shift")
    first = d.join(fit, [key, "window"], "left")
    val = F.when(F.col("window") == 0, F.col("depth")).otherwise(
        F.greatest(F.col("depth") * F.col("scale") + F.col("shift"), F.lit(0.0)))
    last = d.groupBy(key).agg(F.max("window").alias("__last"))
    e = first.join(last, key).filter((F.col("window") == 0) | (F.col("slot") >= lead)).withColumn("val", val)
    s = F.col("slot")
    fade = F.lit(1.0 / (interp - 1)) if interp > 1 else F.lit(1.0)
    into = (F.col("window") > 0) & (s < overlap)
    away = (s >= length - interp) & (F.col("window") < F.col("__last"))
    wgt = F.when(into, (s - lead) * fade).when(away, 1.0 - (s - (length - interp)) * fade).otherwise(1.0)
    out = e.select(key, (F.col("window") * step + s).alias("frame"), "pix", (wgt * F.col("val")).alias("d")) \
        .groupBy(key, "frame", "pix").agg(F.sum("d").alias("depth"))
    return out.join(n_frames, key).filter(F.col("frame") < F.col("n")).drop("n")
