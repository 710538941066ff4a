"""Warping of depth pixels between frames. Relative poses are formed once per frame pair, before the pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.functions import camera, se3
from reelframe.operators.depth import surface_normals
from reelframe.operators.points import bilinear_splat

MIN_DEPTH = camera.MIN_DEPTH


def relative_poses(edges: DataFrame, poses: DataFrame, frame: str = "frame", rig: list[Column] | None = None,
                   invert: bool = False) -> DataFrame:
    """Pose of frame i seen from frame j for every edge: Tj Ti^-1 (or Tj^-1 Ti for camera-to-world poses),
    as g0..g6; with a rig pose r: r^-1 G r."""
    a = poses.select(F.col(frame).alias("i"), *[F.col(c).alias("i_" + c) for c in se3.POSE])
    b = poses.select(F.col(frame).alias("j"), *[F.col(c).alias("j_" + c) for c in se3.POSE])
    d = edges.join(a, "i").join(b, "j")
    pi, pj = se3.pose("i_"), se3.pose("j_")
    g = se3.compose(se3.inverse(pj), pi) if invert else se3.compose(pj, se3.inverse(pi))
    if rig is not None:
        g = se3.compose(se3.compose(se3.inverse(rig), g), rig)
    return d.select(*edges.columns, *[c.alias(f"g{n}") for n, c in enumerate(g)])


def _g() -> list[Column]:
    return [F.col(f"g{n}") for n in range(7)]


def _move(k: list[Column], disp: str, rotate: bool = True) -> list[Column]:
    """Homogeneous ray of a pixel moved into the other frame: R x + disp t."""
    x = camera.pinhole_ray(k, F.col("u"), F.col("v"))
    if rotate:
        x = se3.rotate(_g()[3:], x)
    return [a + F.col(disp) * t for a, t in zip(x, _g()[:3])]


def reproject_edges(px: DataFrame, edges: DataFrame, poses: DataFrame, k: list[Column], rig: list[Column] | None = None,
                    frame: str = "frame", disp: str = "disp") -> DataFrame:
    """Coordinates of the pixels of frame i in frame j per edge, the induced flow, and a flag for depths
    beyond the minimum."""
    rel = relative_poses(edges, poses, frame, rig)
    d = px.withColumnRenamed(frame, "i").join(rel, "i")
    d = d.select(*edges.columns, "u", "v", *[c.alias(f"x{n}") for n, c in enumerate(_move(k, disp))])
    x = [F.col(f"x{n}") for n in range(3)]
    p = camera.pinhole_project(k, x)
    return d.select(*edges.columns, "u", "v", p[0].alias("uj"), p[1].alias("vj"), (p[0] - F.col("u")).alias("du"),
                    (p[1] - F.col("v")).alias("dv"), (x[2] > MIN_DEPTH).alias("valid"))


def frame_distance(px: DataFrame, edges: DataFrame, poses: DataFrame, k: list[Column], beta: float = 0.25,
                   frame: str = "frame", disp: str = "disp", bidirectional: bool = False) -> DataFrame:
    """Mean induced flow per edge: beta of the full motion, 1 - beta of the translation alone; 1000 when
    fewer than 75 % of the pixels stay in front of the camera."""
    if bidirectional:
        both = edges.select("i", "j").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct()
        d = frame_distance(px, both, poses, k, beta, frame, disp)
        back = d.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("dist").alias("__back"))
        return edges.join(d, ["i", "j"]).join(back, ["i", "j"]).withColumn(
            "dist", (F.col("dist") + F.col("__back")) / 2).drop("__back")
    rel = relative_poses(edges.select("i", "j"), poses, frame)
    d = px.withColumnRenamed(frame, "i").join(rel, "i")
    d = d.select("i", "j", "u", "v", *[c.alias(f"a{n}") for n, c in enumerate(_move(k, disp))],
                 *[c.alias(f"b{n}") for n, c in enumerate(_move(k, disp, rotate=False))])

    def flow(p):
        x = [F.col(f"{p}{n}") for n in range(3)]
        du, dv = k[0] * x[0] / x[2] + k[2] - F.col("u"), k[1] * x[1] / x[2] + k[3] - F.col("v")
        ok = x[2] > MIN_DEPTH
        return F.sum(F.when(ok, F.sqrt(du * du + dv * dv)).otherwise(0.0)), F.sum(ok.cast("double"))

    (fa, na), (fb, nb) = flow("a"), flow("b")
    g = d.groupBy("i", "j").agg((beta * fa + (1 - beta) * fb).alias("f"), (beta * na + (1 - beta) * nb).alias("n"),
                                F.count("*").alias("total"))
    d = g.select("i", "j", F.when(F.col("n") / (F.col("total") + 1e-8) < 0.75, 1000.0)
                 .otherwise(F.col("f") / F.col("n")).alias("dist"))
    return edges.select("i", "j").distinct().join(d, ["i", "j"], "left").na.fill(1000.0, ["dist"])  # an edge whose frame has no pixel is far


def frames_to_points(px: DataFrame, poses: DataFrame, k: list[Column], frame: str = "frame") -> DataFrame:
    """World points of depth pixels from camera-to-world poses."""
    d = px.join(poses.select(frame, *se3.POSE), frame)
    w = se3.act(se3.pose(), camera.pinhole_unproject(k, F.col("u"), F.col("v"), F.col("depth")))
    return d.select(*px.columns, *[c.alias(n) for c, n in zip(w, "xyz")])


def depth_votes(px: DataFrame, poses: DataFrame, k: list[Column], threshold: float, h: int, w: int, reach: int = 3,
                min_votes: int = 2, frame: str = "frame", disp: str = "disp", masked: Column | None = None) -> DataFrame:
    """Pixels whose depth agrees with at least two of the +-3 neighbour frames.

    A pixel is moved into each neighbour and gets its vote when one of the four surrounding depths is
    within `threshold` times the mean depth scale. The four depths of a cell are put together once, so a
    moved pixel is joined to one row.
    """
    d = px.withColumnRenamed(disp, "disp")
    quad = F.explode(F.array(*[F.struct((F.col("u") - a).alias("qu"), (F.col("v") - b).alias("qv"), F.lit(f"d{b}{a}").alias("s"))
                               for a in (0, 1) for b in (0, 1)]))
    q = d.select(frame, "u", "v", "disp", quad.alias("q")).groupBy(F.col(frame).alias("j"), "q.qu", "q.qv").agg(
        *[F.max(F.when(F.col("q.s") == s, F.col("disp"))).alias(s) for s in ("d00", "d01", "d10", "d11")])
    off = [o for o in range(-reach, reach + 1) if o]
    frames = poses.select(F.col(frame).alias("i"))
    pairs = frames.withColumn("j", F.explode(F.array(*[F.col("i") + o for o in off])))
    rel = relative_poses(pairs, poses, frame)
    thr = d.agg((F.lit(threshold) / F.avg("disp"))).scalar()
    m = d.withColumnRenamed(frame, "i").join(rel, "i")
    m = m.select("i", "j", "u", "v", "disp", *[c.alias(f"x{n}") for n, c in enumerate(_move(k, "disp"))])
    uj, vj = k[0] * F.col("x0") / F.col("x2") + k[2], k[1] * F.col("x1") / F.col("x2") + k[3]
    m = m.select("i", "j", "u", "v", F.floor(uj).alias("qu"), F.floor(vj).alias("qv"), (F.col("x2") / F.col("disp")).alias("z"))
    m = m.filter((F.col("qu") >= 0) & (F.col("qv") >= 0) & (F.col("qu") < w - 1) & (F.col("qv") < h - 1))
    hit = F.lit(False)
    for s in ("d00", "d01", "d10", "d11"):
        hit = hit | F.coalesce(F.abs(F.col("z") - 1.0 / F.col(s)) < thr, F.lit(False))
    votes = m.join(q, ["j", "qu", "qv"]).filter(hit).groupBy("i", "u", "v").agg(F.count("*").alias("votes"))
    n = poses.select(F.least(F.lit(min_votes), F.count("*") - 1)).scalar()
    mean = d.groupBy(frame).agg(F.avg("disp").alias("__mean"))
    out = d.join(votes.withColumnRenamed("i", frame), [frame, "u", "v"], "left").join(mean, frame)
    keep = (F.coalesce("votes", F.lit(0)) >= n) & (F.col("disp") > 0.5 * F.col("__mean"))
    if masked is not None:
        keep = keep & ~masked
    return out.select(frame, "u", "v", F.coalesce("votes", F.lit(0)).cast("long").alias("votes"), keep.alias("keep"))


def reproject_frame(px: DataFrame, pairs: DataFrame, poses: DataFrame, k: list[Column], h: int, w: int,
                    values: list[str], frame: str = "frame", cull: bool = True) -> DataFrame:
    """Forward warp of frame i into camera j (camera-to-world poses): near pixels weigh more, pixels facing
    away are dropped, values are splatted bilinearly."""
    ray = camera.pinhole_ray(k, F.col("u"), F.col("v"))
    src = px.select(F.col(frame).alias("i"), "u", "v", "depth", *values,
                    *[(c * F.col("depth")).alias(n) for c, n in zip(ray, "xyz")])
    if cull:
        nrm = surface_normals(src, ["i"])
        src = src.join(nrm, ["i", "u", "v"])
    rel = relative_poses(pairs, poses, frame, invert=True)
    d = src.join(rel, "i")
    d = d.select("i", "j", "depth", *values, *(["nx", "ny", "nz", "weight"] if cull else []), *[f"g{n}" for n in range(7)],
                 *[c.alias(f"p{n}") for n, c in enumerate(se3.act(_g(), [F.col(c) for c in "xyz"]))])
    p = [F.col(f"p{n}") for n in range(3)]
    ok = (p[2] > 1e-6) & (F.col("depth") > 1e-6)
    if cull:
        n2 = se3.rotate(_g()[3:], [F.col("n" + c) for c in "xyz"])
        ok = ok & (F.col("weight") > 0) & (se3.dot(n2, p) < 0)
    sat = F.log(1.0 + F.least(F.greatest(p[2], F.lit(0.0)), F.lit(1000.0)))
    d = d.withColumn("__ok", ok).withColumn("__log", sat)
    # the largest log depth of the warped frame scales the weights
    top = d.groupBy("i", "j").agg(F.max("__log").alias("__top"))
    d = d.join(top, ["i", "j"])
    # a weight of 0 instead of a filter: pushed down, the condition would repeat the whole expression chain
    wgt = F.when(F.col("__ok"), F.exp(-F.col("__log") / (F.col("__top") + 1e-7) * 50.0)).otherwise(0.0)
    uv = [k[0] * p[0] / (p[2] + 1e-6) + k[2], k[1] * p[1] / (p[2] + 1e-6) + k[3]]
    d = d.select("i", "j", *values, uv[0].alias("u"), uv[1].alias("v"), wgt.alias("__w"))
    return bilinear_splat(d, ["i", "j"], h, w, values, weight=F.col("__w")).filter("weight > 0")
