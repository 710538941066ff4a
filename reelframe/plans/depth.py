"""Queries over depth pixels and points."""

from pyspark.sql import functions as F

from reelframe.operators import depth as D
from reelframe.operators import points as P
from reelframe.plans.registry import query

K = ["frame"]


def R(c, n=None, d=6):
    return F.round(F.col(c) if isinstance(c, str) else c, d).alias(n or c)


@query("masked_mean", "SELECT frame, round(sum(CASE WHEN valid THEN depth ELSE 0 END) / greatest(count(*) FILTER (valid), 1), 6) AS mean FROM depth_px GROUP BY frame")
def masked_mean(v):
    return D.masked_mean(v.depth_px, K, F.col("depth"), F.col("valid")).select("frame", R("mean"))


@query("depth_metrics", """
    SELECT frame, count(*) AS n, round(avg(abs(depth - target) / target), 6) AS abs_rel, round(sqrt(avg((ln(depth) - ln(target)) ** 2)), 6) AS rmse_log,
           round(avg(CASE WHEN greatest(depth / target, target / depth) < 1.25 THEN 1.0 ELSE 0.0 END), 6) AS delta1
    FROM depth_px WHERE valid GROUP BY frame""")
def depth_metrics(v):
    return D.depth_metrics(v.depth_px, K, "depth", "target", F.col("valid")).select("frame", "n", R("abs_rel"), R("rmse_log"), R("delta1"))


_FIT = "frame, regr_slope(target, depth) AS s, regr_intercept(target, depth) AS b"


@query("scale_shift_fit", f"""
    SELECT f.frame, round(s, 6) AS scale, round(b, 6) AS shift, round(o.s1, 6) AS scale_only FROM
    (SELECT {_FIT} FROM depth_px WHERE valid GROUP BY frame) f
    JOIN (SELECT frame, sum(depth * target) / (sum(depth * depth) + 1e-6) AS s1 FROM depth_px WHERE valid GROUP BY frame) o USING (frame)""")
def scale_shift_fit(v):
    a = D.scale_shift(v.depth_px, K, F.col("depth"), F.col("target"), F.col("valid"))
    b = D.scale_shift(v.depth_px, K, F.col("depth"), F.col("target"), F.col("valid"), scale_only=True)
    return a.join(b.select("frame", F.col("scale").alias("scale_only")), "frame").select("frame", R("scale"), R("shift"), R("scale_only"))


_TRIM = """q AS (SELECT frame, quantile_cont(s, 0.1) FILTER (s > 0) AS sl, quantile_cont(s, 0.9) FILTER (s > 0) AS sh,
                  quantile_cont(t, 0.1) FILTER (valid) AS tl, quantile_cont(t, 0.9) FILTER (valid) AS th FROM d GROUP BY frame),
    m AS (SELECT d.* FROM d JOIN q USING (frame) WHERE s > sl AND s < sh AND t > tl AND t < th)"""


@query("align_inv_depth", f"""
    WITH d AS (SELECT frame, u, v, 1 / depth AS s, 1 / target AS t, valid FROM depth_px), {_TRIM},
    f AS (SELECT frame, regr_slope(t, s) AS a, regr_intercept(t, s) AS b FROM m GROUP BY frame)
    SELECT frame, u, v, round(a, 6) AS scale, round(b, 6) AS shift, round(a * s + b, 6) AS aligned_inv FROM d JOIN f USING (frame)""")
def align_inv_depth(v):
    d = v.depth_px.withColumn("inv", 1.0 / F.col("depth"))
    out = D.align_inv_depth(d, K, "inv", "target", F.col("valid"))
    return out.select("frame", "u", "v", R("scale"), R("shift"), R(F.col("scale") * F.col("inv") + F.col("shift"), "aligned_inv"))


@query("align_depth_median", f"""
    WITH d AS (SELECT frame, u, v, depth AS s, target AS t, valid FROM depth_px), {_TRIM},
    f AS (SELECT frame, quantile_cont(t / s, 0.5) AS a FROM m GROUP BY frame)
    SELECT frame, u, v, round(a, 9) AS scale, round(greatest(s * a, 1e-4), 9) AS aligned FROM d JOIN f USING (frame)""")
def align_depth_median(v):
    return D.align_depth_median(v.depth_px, K, "depth", "target", F.col("valid")).select("frame", "u", "v", R("scale", d=9), R("aligned", d=9))


@query("align_depth_affine", f"""
    WITH d AS (SELECT frame, u, v, depth AS s, target AS t, valid FROM depth_px), {_TRIM},
    f AS (SELECT frame, regr_slope(t, s) AS a, regr_intercept(t, s) AS b FROM m GROUP BY frame)
    SELECT frame, u, v, round(a, 6) AS scale, round(b, 6) AS shift, round(greatest(a * s + b, 1e-4), 6) AS aligned FROM d JOIN f USING (frame)""")
def align_depth_affine(v):
    return D.align_depth_affine(v.depth_px, K, "depth", "target", F.col("valid")).select("frame", "u", "v", R("scale"), R("shift"), R("aligned"))


@query("global_complete", """
    WITH f AS (SELECT frame, regr_slope(target, depth) AS a, regr_intercept(target, depth) AS b FROM depth_px WHERE label % 3 = 0 GROUP BY frame)
    SELECT frame, u, v, round(depth * a + b, 6) AS completed FROM depth_px JOIN f USING (frame)""")
def global_complete(v):
    return D.global_complete(v.depth_px, K, "depth", "target", F.col("label") % 3 == 0).select("frame", "u", "v", R("completed"))


@query("knn_complete")
def knn_complete(v):
    return D.knn_complete(v.depth_px, K, "depth", "target", F.col("label") % 3 == 0, 5).select("frame", "u", "v", R("completed"))


@query("cover_known", """
    SELECT frame, u, v, round(CASE WHEN u < 20 THEN target * 2 WHEN label = 3 THEN target ELSE depth END, 9) AS depth FROM depth_px""")
def cover_known(v):
    p = v.depth_px
    sparse = p.filter("label = 3").select("frame", "u", "v", F.col("target").alias("depth"))
    prior = p.filter("u < 20").select("frame", "u", "v", (F.col("target") * 2).alias("depth"))
    return D.cover_known(p.select("frame", "u", "v", "depth"), sparse, prior, ["frame", "u", "v"]).select("frame", "u", "v", R("depth", d=9))


@query("coverage_score", """
    WITH s AS (SELECT frame, count(DISTINCT CASE WHEN depth > 2.5 AND u // 6 < 10 AND v // 4 < 10 THEN (u // 6) * 10 + v // 4 END) / 100.0::DOUBLE AS score
               FROM depth_px GROUP BY frame)
    SELECT frame, round(score, 6) AS score, round((SELECT min(score) FROM s WHERE frame % 10 = 0), 6) AS min_score,
           CASE WHEN (SELECT min(score) FROM s WHERE frame % 10 = 0) < 0.3 THEN 'fallback' ELSE 'prompted' END AS branch FROM s""")
def coverage_score(v):
    per, low = D.coverage_score(v.depth_px.withColumn("depth", F.when(F.col("depth") > 2.5, F.col("depth")).otherwise(0.0)), "frame", 48, 64)
    return per.select("frame", R("score"), low.select(F.round("min_score", 6)).scalar().alias("min_score"), low.select("branch").scalar().alias("branch"))


@query("min_pool", """
    SELECT frame, u // 4 AS bu, v // 4 AS bv, round(coalesce(min(CASE WHEN label <> 2 THEN depth END), 0), 9) AS depth FROM depth_px GROUP BY 1, 2, 3""")
def min_pool(v):
    d = v.depth_px.withColumn("depth", F.when(F.col("label") == 2, 0.0).otherwise(F.col("depth")))
    return D.min_pool(d, K, 4).select("frame", "bu", "bv", R("depth", d=9))


@query("motion_score", """
    WITH p AS (SELECT frame // 4 AS f, frame % 4 AS view, avg(sqrt(depth * depth + target * target) * valid::INT) / (avg(valid::INT) + 1e-6) AS s FROM depth_px GROUP BY 1, 2)
    SELECT f, round(min(s), 6) AS motion FROM p GROUP BY f""")
def motion_score(v):
    d = v.depth_px.withColumn("f", F.floor(F.col("frame") / 4)).withColumn("view", F.col("frame") % 4)
    return D.motion_score(d, ["f"], "view", "depth", "target", F.col("valid")).select("f", R("motion"))


@query("expected_point", """
    WITH a AS (SELECT frame, u, sum(depth / 50) AS s FROM depth_px GROUP BY frame, u), b AS (SELECT frame, v, sum(depth / 50) AS s FROM depth_px GROUP BY frame, v)
    SELECT frame, round(eu / 63, 6) AS eu, round(ev / 47, 6) AS ev FROM (SELECT frame, sum(u * exp(s)) / sum(exp(s)) AS eu FROM a GROUP BY frame)
    JOIN (SELECT frame, sum(v * exp(s)) / sum(exp(s)) AS ev FROM b GROUP BY frame) USING (frame)""")
def expected_point(v):
    d = v.depth_px.withColumn("depth", F.col("depth") / 50)
    return D.expected_point(d, K, "depth", 48, 64).select("frame", R("eu"), R("ev"))


@query("uncertainty_map", """
    WITH d AS (SELECT frame, u, v, CASE WHEN label <> 1 THEN abs(depth - target) / target ELSE 0 END AS x FROM depth_px)
    SELECT frame, u, v, round((x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w), 6) AS uncertainty FROM d WINDOW w AS (PARTITION BY frame)""")
def uncertainty_map(v):
    d = v.depth_px.withColumn("glob", F.when(F.col("label") == 1, 0.0).otherwise(F.col("target")))
    return D.uncertainty_map(d, K, "depth", "glob").select("frame", "u", "v", R("uncertainty"))


@query("masked_normalise", """
    WITH r AS (SELECT frame, min(depth) AS lo, max(depth) - min(depth) AS span FROM depth_px WHERE valid GROUP BY frame)
    SELECT frame, u, v, round((depth - lo) / span, 9) AS norm, round(depth, 9) AS back FROM depth_px JOIN r USING (frame)""")
def masked_normalise(v):
    d = D.normalise(v.depth_px, K, "depth", F.col("valid"))
    return d.select("frame", "u", "v", R("norm", d=9), R(D.denormalise(F.col("norm"), F.col("lo"), F.col("span")), "back", 9))


@query("min_max_normalise", """
    SELECT frame, u, v, round(least(greatest((depth - min(depth) OVER w) / (max(depth) OVER w - min(depth) OVER w), 0), 1), 6) AS norm
    FROM depth_px WINDOW w AS (PARTITION BY frame)""")
def min_max_normalise(v):
    return D.normalise(v.depth_px, K, "depth", F.lit(True), clip=True).select("frame", "u", "v", R("norm"))


@query("large_change_guard", """
    SELECT frame, u, v, label FROM depth_px WHERE label IN (1, 2, 3, 5, 6) AND frame IN (
      SELECT frame FROM depth_px WHERE label IN (1, 2, 3, 5, 6) GROUP BY frame HAVING count(*) <= 3072 * 0.4)""")
def large_change_guard(v):
    d = v.depth_px.filter("label IN (1, 2, 3, 5, 6)").select("frame", "u", "v", "label")
    return D.large_change_guard(d, "frame", 3072, 0.4)


@query("surface_normals", """
    WITH p AS (SELECT frame, u, v, (u - 32) / 40.0::DOUBLE * depth AS x, (v - 24) / 40.0::DOUBLE * depth AS y, depth AS z FROM depth_px),
    d AS (SELECT c.frame, c.u, c.v, c.x, c.y, c.z,
      CASE WHEN c.u = 0 THEN r.x - c.x ELSE c.x - l.x END AS ax, CASE WHEN c.u = 0 THEN r.y - c.y ELSE c.y - l.y END AS ay, CASE WHEN c.u = 0 THEN r.z - c.z ELSE c.z - l.z END AS az,
      CASE WHEN c.v = 0 THEN b.x - c.x ELSE c.x - t.x END AS bx, CASE WHEN c.v = 0 THEN b.y - c.y ELSE c.y - t.y END AS by_, CASE WHEN c.v = 0 THEN b.z - c.z ELSE c.z - t.z END AS bz
      FROM p c LEFT JOIN p l ON l.frame = c.frame AND l.u = c.u - 1 AND l.v = c.v LEFT JOIN p r ON r.frame = c.frame AND r.u = c.u + 1 AND r.v = c.v
      LEFT JOIN p t ON t.frame = c.frame AND t.v = c.v - 1 AND t.u = c.u LEFT JOIN p b ON b.frame = c.frame AND b.v = c.v + 1 AND b.u = c.u),
    n AS (SELECT *, ay * bz - az * by_ AS n0, az * bx - ax * bz AS n1, ax * by_ - ay * bx AS n2 FROM d WHERE ax IS NOT NULL AND bx IS NOT NULL),
    c AS (SELECT *, sqrt(n0*n0 + n1*n1 + n2*n2) + 1e-6 AS ln, -(n0*x + n1*y + n2*z) / ((sqrt(n0*n0 + n1*n1 + n2*n2) + 1e-6) * (sqrt(x*x + y*y + z*z) + 1e-6)) AS co FROM n)
    SELECT frame, u, v, round(abs(n0 / ln), 5) AS nx, round(abs(n1 / ln), 5) AS ny, round(abs(n2 / ln), 5) AS nz, round(least(abs(co), 1), 5) AS weight FROM c""")
def surface_normals(v):
    z = F.col("depth")
    p = v.depth_px.select("frame", "u", "v", ((F.col("u") - 32) / 40.0 * z).alias("x"), ((F.col("v") - 24) / 40.0 * z).alias("y"), z.alias("z"))
    return D.surface_normals(p, K).select("frame", "u", "v", *[R(F.abs("n" + c), "n" + c, 5) for c in "xyz"], R("weight", d=5))


@query("depth_reliability_rows", """
    WITH w AS (SELECT a.frame, a.u, a.v, a.depth, max(b.depth) AS mx, min(b.depth) AS mn, sum(b.depth) / 25 AS mean FROM depth_px a JOIN depth_px b
      ON a.frame = b.frame AND b.u BETWEEN a.u - 2 AND a.u + 2 AND b.v BETWEEN a.v - 2 AND a.v + 2 GROUP BY 1, 2, 3, 4)
    SELECT frame, u, v, round(depth, 9) AS depth, ((mx - mn) / (mean + 1e-6) < 1.5 AND depth > 0) AS reliable FROM w""")
def depth_reliability_rows(v):
    return D.reliability_rows(v.depth_px, K, 5, 1.5).select("frame", "u", "v", R("depth", d=9), "reliable")


# --- points ----------------------------------------------------------------------------------------

@query("knn_join", """
    SELECT qid, pid, round(dist, 6) AS dist FROM (SELECT q.qid, p.pid, sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2 + (q.z - p.z) ** 2) AS dist,
      row_number() OVER (PARTITION BY q.qid ORDER BY sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2 + (q.z - p.z) ** 2), p.pid) AS k FROM query_points q, points p)
    WHERE k <= 5""")
def knn_join(v):
    return P.knn_join(v.query_points, v.points, 5, ["x", "y", "z"], "qid", "pid").select("qid", "pid", R("dist"))


@query("fill_nearest", """
    WITH k AS (SELECT frame, u, v, target FROM depth_px WHERE label = 3), m AS (SELECT frame, u, v FROM depth_px WHERE label <> 3),
    d AS (SELECT m.frame, m.u, m.v, k.target, row_number() OVER (PARTITION BY m.frame, m.u, m.v ORDER BY (m.u - k.u) ** 2 + (m.v - k.v) ** 2, k.v * 1000003 + k.u) AS r
          FROM m JOIN k ON m.frame = k.frame)
    SELECT frame, u, v, round(avg(target), 9) AS target FROM d WHERE r <= 5 GROUP BY 1, 2, 3""")
def fill_nearest(v):
    p = v.depth_px
    d = P.fill_nearest(p.filter("label <> 3").select("frame", "u", "v"), p.filter("label = 3").select("frame", "u", "v", "target"), 5, "target")
    return d.select("frame", "u", "v", R("target", d=9))


def uvz(v):
    """Points projected with a pinhole camera, tagged with a frame."""
    z = F.col("z")
    return v.points.select((F.col("pid") % 8).alias("frame"), "pid", (20.0 * F.col("x") / z / 8 + 64).alias("u"),
                           (20.0 * F.col("y") / z / 8 + 8).alias("v"), "z")


_UVZ = "p AS (SELECT pid % 8 AS frame, pid, 20.0::DOUBLE * x / z / 8 + 64 AS u, 20.0::DOUBLE * y / z / 8 + 8 AS v, z FROM points)"


@query("bilinear_splat", f"""
    WITH {_UVZ}, c AS (SELECT *, floor(u + 0.5)::BIGINT AS x0, floor(v + 0.5)::BIGINT AS y0 FROM p),
    i AS (SELECT * FROM c WHERE x0 >= 0 AND x0 + 1 < 256 AND y0 >= 0 AND y0 + 1 < 192),
    s AS (SELECT frame, x0 + dx AS x, y0 + dy AS y, z, (CASE WHEN dx = 0 THEN 1 - (u - x0) ELSE u - x0 END) * (CASE WHEN dy = 0 THEN 1 - (v - y0) ELSE v - y0 END) AS w
          FROM i, range(2) a(dx), range(2) b(dy))
    SELECT frame, x, y, round(sum(w), 6) AS weight, round(sum(w * z), 6) AS wz FROM s GROUP BY 1, 2, 3""")
def bilinear_splat(v):
    d = P.bilinear_splat(uvz(v), K, 192, 256, ["z"])
    return d.select("frame", "x", "y", R("weight"), R(F.coalesce(F.col("weight") * F.col("z"), F.lit(0.0)), "wz"))


@query("zbuffer_nearest", f"""
    WITH {_UVZ}, c AS (SELECT *, greatest(0, least(floor(u + 0.5), 255))::BIGINT AS cx, greatest(0, least(floor(v + 0.5), 191))::BIGINT AS cy FROM p)
    SELECT frame, cx, cy, pid, z FROM (SELECT *, min(z) OVER (PARTITION BY frame, cx, cy) AS m FROM c) WHERE z <= m + 1e-5""")
def zbuffer_nearest(v):
    return P.zbuffer_nearest(uvz(v), K, 192, 256).select("frame", "cx", "cy", "pid", "z")


@query("mean_depth_raster", f"""
    WITH {_UVZ}, c AS (SELECT *, trunc(u)::INT AS x, trunc(v)::INT AS y FROM p)
    SELECT frame, x, y, round(avg(z), 6) AS depth, count(*) AS n FROM c WHERE x >= 0 AND x < 256 AND y >= 0 AND y < 192 GROUP BY 1, 2, 3""")
def mean_depth_raster(v):
    return P.mean_depth_raster(uvz(v), K, 192, 256).select("frame", "x", "y", R("depth"), "n")


@query("painter_order", f"""
    WITH {_UVZ}, c AS (SELECT *, floor(u)::BIGINT AS x, floor(v)::BIGINT AS y FROM p)
    SELECT frame, x, y, arg_min(pid, {{'z': z, 'p': pid}}) AS nearest, arg_max(pid, {{'z': z, 'p': pid}}) AS farthest FROM c GROUP BY 1, 2, 3""")
def painter_order(v):
    a = P.painter(uvz(v), K, [], "nearest").select("frame", "x", "y", F.col("pid").alias("nearest"))
    return a.join(P.painter(uvz(v), K, [], "farthest").select("frame", "x", "y", F.col("pid").alias("farthest")), ["frame", "x", "y"])


@query("splat_points", f"""
    WITH {_UVZ} SELECT frame, floor(u)::BIGINT AS x, floor(v)::BIGINT AS y, min(z) AS depth FROM p
    WHERE u > 0 AND u < 256 AND v > 0 AND v < 192 AND z > 0 GROUP BY 1, 2, 3""")
def splat_points(v):
    return P.splat_points(uvz(v), K, 192, 256)


@query("robust_extent", """
    SELECT """ + ", ".join(f"round(quantile_cont({c}, 0.01), 6) AS {c}_lo, round(quantile_cont({c}, 0.99), 6) AS {c}_hi, round(quantile_cont({c}, 0.99) - quantile_cont({c}, 0.01), 6) AS {c}_len" for c in "xyz") + " FROM points")
def robust_extent(v):
    d = P.robust_extent(v.points, [], ["x", "y", "z"])
    return d.select(*[R(c) for c in d.columns])
