"""Queries over reprojection, window stitching and frame arrays."""

from pyspark.sql import functions as F

from reelframe.functions import frames as FR
from reelframe.functions import se3
from reelframe.operators import reproject as RP
from reelframe.operators.ordered import rank0
from reelframe.operators.sampling import every_nth, overlap_windows
from reelframe.operators.stitch import stitch_windows
from reelframe.plans.depth import R
from reelframe.plans.registry import query

KI = [40.0, 41.0, 32.0, 24.0]
_ROT = 0.01


def k():
    return [F.lit(c) for c in KI]


def px(v):
    return v.depth_px.withColumn("disp", 1.0 / F.col("depth"))


def poses(v):
    """One pose per frame: a slow move to the side with a slow turn about the vertical axis."""
    f = F.col("frame")
    a = f * _ROT / 2
    z = F.lit(0.0)
    cols = [f * 0.02, z, f * -0.01, z, F.sin(a), z, F.cos(a)]
    return v.depth_px.select("frame").distinct().select("frame", *se3.named(cols))


def edges(v):
    """Edges of the graph view between existing frames, both ends folded into 20 frames."""
    e = v.edges.select((F.col("i") % 20).alias("i"), (F.col("j") % 20).alias("j"))
    return e.filter("i < j").distinct()


# relative pose of frame j to frame i: a turn by (j - i) * 0.01 about y after moving the centre
_SQL = """e AS (SELECT DISTINCT i % 20 AS i, j % 20 AS j FROM edges WHERE i % 20 < j % 20),
    g AS (SELECT i, j, cos((j - i) * 0.01::DOUBLE) AS c, sin((j - i) * 0.01::DOUBLE) AS s FROM e),
    t AS (SELECT i, j, c, s, j * 0.02::DOUBLE - (c * (i * 0.02::DOUBLE) + s * (i * -0.01::DOUBLE)) AS tx,
                 j * -0.01::DOUBLE - (-s * (i * 0.02::DOUBLE) + c * (i * -0.01::DOUBLE)) AS tz FROM g),
    r AS (SELECT t.*, p.u, p.v, 1 / p.depth AS disp, (p.u - 32) / 40.0::DOUBLE AS rx, (p.v - 24) / 41.0::DOUBLE AS ry FROM t JOIN depth_px p ON p.frame = t.i),
    x AS (SELECT *, c * rx + s + disp * tx AS x0, ry AS x1, -s * rx + c + disp * tz AS x2, rx + disp * tx AS y0, ry AS y1, 1 + disp * tz AS y2 FROM r)"""


@query("reproject_edges", f"""
    WITH {_SQL} SELECT i, j, u, v, round(40 * x0 / CASE WHEN x2 < 0.1 THEN 1 ELSE x2 END + 32, 5) AS uj, round(41 * x1 / CASE WHEN x2 < 0.1 THEN 1 ELSE x2 END + 24, 5) AS vj,
    x2 > 0.1 AS valid FROM x""")
def reproject_edges(v):
    return RP.reproject_edges(px(v), edges(v), poses(v), k()).select("i", "j", "u", "v", R("uj", d=5), R("vj", d=5), "valid")


@query("frame_distance", f"""
    WITH {_SQL}, f AS (SELECT i, j, CASE WHEN x2 > 0.1 THEN sqrt((40 * x0 / x2 + 32 - u) ** 2 + (41 * x1 / x2 + 24 - v) ** 2) ELSE 0 END AS a, (x2 > 0.1)::INT AS na,
      CASE WHEN y2 > 0.1 THEN sqrt((40 * y0 / y2 + 32 - u) ** 2 + (41 * y1 / y2 + 24 - v) ** 2) ELSE 0 END AS b, (y2 > 0.1)::INT AS nb FROM x)
    SELECT i, j, round(CASE WHEN sum(0.25 * na + 0.75 * nb) / count(*) < 0.75 THEN 1000 ELSE sum(0.25 * a + 0.75 * b) / sum(0.25 * na + 0.75 * nb) END, 5) AS dist
    FROM f GROUP BY i, j""")
def frame_distance(v):
    return RP.frame_distance(px(v), edges(v), poses(v), k(), 0.25).select("i", "j", R("dist", d=5))


@query("frame_distance_both", f"""
    WITH {_SQL.replace("e AS (SELECT DISTINCT i % 20 AS i, j % 20 AS j FROM edges WHERE i % 20 < j % 20)",
                       "e0 AS (SELECT DISTINCT i % 20 AS i, j % 20 AS j FROM edges WHERE i % 20 < j % 20), e AS (SELECT i, j FROM e0 UNION SELECT j, i FROM e0)")},
    f AS (SELECT i, j, CASE WHEN x2 > 0.1 THEN sqrt((40 * x0 / x2 + 32 - u) ** 2 + (41 * x1 / x2 + 24 - v) ** 2) ELSE 0 END AS a, (x2 > 0.1)::INT AS na,
      CASE WHEN y2 > 0.1 THEN sqrt((40 * y0 / y2 + 32 - u) ** 2 + (41 * y1 / y2 + 24 - v) ** 2) ELSE 0 END AS b, (y2 > 0.1)::INT AS nb FROM x),
    d AS (SELECT i, j, CASE WHEN sum(0.25 * na + 0.75 * nb) / count(*) < 0.75 THEN 1000 ELSE sum(0.25 * a + 0.75 * b) / sum(0.25 * na + 0.75 * nb) END AS dist FROM f GROUP BY i, j)
    SELECT a.i, a.j, round((a.dist + b.dist) / 2, 5) AS dist FROM e0 JOIN d a USING (i, j) JOIN d b ON b.i = e0.j AND b.j = e0.i""")
def frame_distance_both(v):
    return RP.frame_distance(px(v), edges(v), poses(v), k(), 0.25, bidirectional=True).select("i", "j", R("dist", d=5))


@query("frames_to_points", """
    WITH p AS (SELECT frame, u, v, depth, (u - 32) / 40.0::DOUBLE * depth AS x, (v - 24) / 41.0::DOUBLE * depth AS y, cos(frame * 0.01::DOUBLE) AS c, sin(frame * 0.01::DOUBLE) AS s
               FROM depth_px WHERE u % 8 = 3 AND v % 8 = 3 AND valid)
    SELECT frame, u, v, round(c * x + s * depth + frame * 0.02, 6) AS x, round(y, 6) AS y, round(-s * x + c * depth - frame * 0.01, 6) AS z FROM p""")
def frames_to_points(v):
    d = every_nth(every_nth(v.depth_px.filter("valid"), 8, 3, "u"), 8, 3, "v").select("frame", "u", "v", "depth")
    return RP.frames_to_points(d, poses(v), k()).select("frame", "u", "v", R("x"), R("y"), R("z"))


@query("depth_consistency_vote")
def depth_consistency_vote(v):
    return RP.depth_votes(px(v), poses(v), k(), 0.5, 48, 64)


@query("reproject_frame")
def reproject_frame(v):
    d = RP.reproject_frame(v.depth_px, edges(v), poses(v), k(), 48, 64, ["target"])
    return d.select("i", "j", "x", "y", R("target", d=5), R("weight", d=9))


@query("stitch_windows", """
    WITH RECURSIVE o AS (SELECT u AS clip, row_number() OVER (PARTITION BY u ORDER BY frame * 64 + v) - 1 AS pos, depth FROM depth_px),
    n AS (SELECT clip, count(*) AS n FROM o GROUP BY clip),
    w AS (SELECT clip, k, p, least(CASE WHEN k = 0 THEN p WHEN p = 0 THEN 0 WHEN p = 1 THEN 4 * k - 1 ELSE 4 * k + p END, n - 1) AS pos
          FROM n, range((SELECT max(n) FROM n)) a(k), range(8) b(p) WHERE 4 * k < n),
    x AS (SELECT clip, k, p, i AS pix, CASE WHEN i = 0 THEN depth ELSE depth * 0.7 + 0.2 END * (1 + k % 3 * 0.1::DOUBLE) + k % 2 * 0.05::DOUBLE AS d FROM w JOIN o USING (clip, pos), range(2) c(i)),
    l AS (SELECT clip, k, list(d ORDER BY pix) FILTER (p = 0) AS a, list(d ORDER BY pix) FILTER (p = 1) AS b, list(d ORDER BY pix) FILTER (p = 3) AS c FROM x GROUP BY clip, k),
    j AS (SELECT l.clip, l.k, l.a || l.b AS q, z.a AS r0, y.c AS r1 FROM l JOIN l z ON z.clip = l.clip AND z.k = 0 JOIN l y ON y.clip = l.clip AND y.k = l.k - 1),
    f AS (SELECT clip, 0::BIGINT AS k, 1::DOUBLE AS s, 0::DOUBLE AS b FROM n
      UNION ALL SELECT clip, k, CASE WHEN det <> 0 THEN (a11 * b0 - a01 * b1) / det ELSE 1 END, CASE WHEN det <> 0 THEN (a00 * b1 - a01 * b0) / det ELSE 0 END
      FROM (SELECT *, a00 * a11 - a01 * a01 AS det FROM (SELECT clip, k, list_sum(list_transform(q, lambda v: v * v)) AS a00, list_sum(q) AS a01, len(q)::DOUBLE AS a11,
              list_sum(list_transform(t, lambda v, i: v * q[i])) AS b0, list_sum(t) AS b1
            FROM (SELECT j.clip, j.k, j.q, j.r0 || CASE WHEN j.k = 1 THEN j.r1 ELSE list_transform(j.r1, lambda v: greatest(f.s * v + f.b, 0)) END AS t FROM f JOIN j ON j.clip = f.clip AND j.k = f.k + 1)))),
    e AS (SELECT clip, 4 * k + p AS frame, pix, CASE WHEN k = 0 THEN d ELSE greatest(d * s + b, 0) END
            * CASE WHEN k > 0 AND p < 4 THEN p - 2 WHEN p >= 6 AND k < max(k) OVER (PARTITION BY clip) THEN 7 - p ELSE 1 END AS d
          FROM x JOIN f USING (clip, k) WHERE k = 0 OR p >= 2)
    SELECT clip, frame, CAST(pix AS INT) AS pix, round(sum(d), 5) AS depth FROM e JOIN n USING (clip) WHERE frame < n GROUP BY clip, frame, pix""")
def stitch_windows_query(v):
    """Each frame's pixel column is a clip; positions are its frames in order, seen through short windows."""
    d = v.depth_px.select(F.col("u").alias("clip"), (F.col("frame") * 64 + F.col("v")).alias("ord"), "depth")
    d = rank0(d, ["clip"], "ord", "pos").select("clip", "pos", F.array("depth", F.col("depth") * 0.7 + 0.2).alias("px"))
    win = overlap_windows(d, "clip", "pos", 8, 4, align=3)
    n = d.groupBy("clip").agg(F.count("*").alias("n"))
    rows = win.select("clip", "window", "slot", F.posexplode("px").alias("pix", "depth")) \
        .withColumn("depth", F.col("depth") * (1 + (F.col("window") % 3) * 0.1) + F.col("window") % 2 * 0.05)
    return stitch_windows(rows, n, "clip", 8, 4, 2, 3).select("clip", "frame", "pix", R("depth", d=5))


def _arrays(v):
    return v.frame_px.select("vec_id", "h", "w", F.transform("px_raw", lambda x: (x.cast("double") + 1) / 2).alias("px"))


def _explode(df, col, d=6):
    return df.select("vec_id", F.posexplode(col).alias("i", "x")).withColumn("x", F.round("x", d))


_NB = """p AS (SELECT vec_id, i, i % 8 AS u, i // 8 AS v, (x + 1) / 2 AS x FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(px_raw)::DOUBLE AS x FROM frame_px))"""


@query("depth_reliability", f"""
    WITH {_NB}, w AS (SELECT a.vec_id, a.i, a.x, max(b.x) AS mx, min(b.x) AS mn, sum(b.x) / 25 AS mean FROM p a JOIN p b ON a.vec_id = b.vec_id
      AND b.u BETWEEN a.u - 2 AND a.u + 2 AND b.v BETWEEN a.v - 2 AND a.v + 2 GROUP BY 1, 2, 3)
    SELECT vec_id, CAST(i AS INT) AS i, CASE WHEN (mx - mn) / (mean + 1e-6) < 1.0 AND x > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS x FROM w""")
def depth_reliability(v):
    d = _arrays(v)
    return _explode(d.select("vec_id", FR.reliable_mask(5, 1.0)("px", "h", "w").alias("px")), "px")


@query("morph_erode_dilate", f"""
    WITH {_NB}, w AS (SELECT a.vec_id, a.i, max(b.x) AS mx, min(b.x) AS mn FROM p a JOIN p b ON a.vec_id = b.vec_id
      AND b.u BETWEEN a.u - 2 AND a.u + 2 AND b.v BETWEEN a.v - 2 AND a.v + 2 GROUP BY 1, 2)
    SELECT vec_id, CAST(i AS INT) AS i, round(mn, 6) AS eroded, round(mx, 6) AS dilated FROM w""")
def morph_erode_dilate(v):
    d = _arrays(v).select("vec_id", FR.morph("erode")("px", "h", "w").alias("e"), FR.morph("dilate")("px", "h", "w").alias("d"))
    z = d.select("vec_id", F.posexplode(F.arrays_zip("e", "d")).alias("i", "z"))
    return z.select("vec_id", "i", R(F.col("z.e"), "eroded"), R(F.col("z.d"), "dilated"))


def _peak_pass(n: int) -> str:
    """State of pass n from that of pass n - 1: 0 open, 1 peak, 2 covered."""
    near = "b.vec_id = a.vec_id AND b.u BETWEEN a.u - 2 AND a.u + 2 AND b.v BETWEEN a.v - 2 AND a.v + 2"
    live = "CASE WHEN {t}.s = 0 THEN {t}.x ELSE 0 END"
    return f"""f{n} AS (SELECT a.vec_id, a.i, a.u, a.v, a.x, a.s, a.s = 0 AND {live.format(t="a")} >= max({live.format(t="b")}) AS top FROM s{n - 1} a JOIN s{n - 1} b ON {near} GROUP BY a.vec_id, a.i, a.u, a.v, a.x, a.s),
    s{n} AS (SELECT a.vec_id, a.i, a.u, a.v, a.x, CASE WHEN a.top THEN 1 WHEN a.s = 0 AND bool_or(b.top) THEN 2 ELSE a.s END AS s FROM f{n} a JOIN f{n} b ON {near}
      GROUP BY a.vec_id, a.i, a.u, a.v, a.x, a.s, a.top)"""


@query("grid_nms", f"""
    WITH {_NB}, s0 AS (SELECT *, 0 AS s FROM p), {_peak_pass(1)}, {_peak_pass(2)}, {_peak_pass(3)}
    SELECT vec_id, CAST(i AS INT) AS i, round(CASE WHEN s = 1 THEN x ELSE 0 END, 6) AS x FROM s3""")
def grid_nms(v):
    return _explode(_arrays(v).select("vec_id", FR.grid_nms(2)("px", "h", "w").alias("px")), "px")


@query("frame_resize", f"""
    WITH {_NB}, o AS (SELECT r.k AS i, greatest((r.k // 5 + 0.5::DOUBLE) * 8 / 12 - 0.5, 0) AS cy, greatest((r.k % 5 + 0.5::DOUBLE) * 8 / 5 - 0.5, 0) AS cx,
           least((r.k // 5) * 8 // 12, 7) AS ny, least((r.k % 5) * 8 // 5, 7) AS nx FROM range(60) r(k)),
    t AS (SELECT i, cy - floor(cy) AS fy, cx - floor(cx) AS fx, CAST(floor(cy) AS INT) AS y, CAST(floor(cx) AS INT) AS x, ny, nx FROM o),
    g AS (SELECT p.vec_id, t.i, sum(CASE WHEN p.v = t.y THEN 1 - fy ELSE 0 END * CASE WHEN p.u = t.x THEN 1 - fx ELSE 0 END * p.x)
            + sum(CASE WHEN p.v = least(t.y + 1, 7) THEN fy ELSE 0 END * CASE WHEN p.u = t.x THEN 1 - fx ELSE 0 END * p.x)
            + sum(CASE WHEN p.v = t.y THEN 1 - fy ELSE 0 END * CASE WHEN p.u = least(t.x + 1, 7) THEN fx ELSE 0 END * p.x)
            + sum(CASE WHEN p.v = least(t.y + 1, 7) THEN fy ELSE 0 END * CASE WHEN p.u = least(t.x + 1, 7) THEN fx ELSE 0 END * p.x) AS b,
            max(CASE WHEN p.v = ny AND p.u = nx THEN p.x END) AS n FROM t, p GROUP BY 1, 2)
    SELECT vec_id, CAST(i AS INT) AS i, round(b, 6) AS bilinear, round(n, 6) AS nearest, round(CASE WHEN b > 0.9 THEN 1 ELSE 0 END::DOUBLE, 6) AS mask FROM g""")
def frame_resize(v):
    d = _arrays(v).select("vec_id", FR.resize(12, 5)("px", "h", "w").alias("b"), FR.resize(12, 5, "nearest")("px", "h", "w").alias("n"),
                          FR.resize(12, 5, "mask")("px", "h", "w").alias("m"))
    z = d.select("vec_id", F.posexplode(F.arrays_zip("b", "n", "m")).alias("i", "z"))
    return z.select("vec_id", "i", R(F.col("z.b"), "bilinear"), R(F.col("z.n"), "nearest"), R(F.col("z.m"), "mask"))
