"""Queries over poses, cameras, trajectories and generated grids."""

from pyspark.sql import functions as F

from reelframe.functions import camera as C
from reelframe.functions import se3
from reelframe.operators import trajectory as TR
from reelframe.plans.registry import query

R6 = lambda c, n: F.round(c, 6).alias(n)


def _r(cols, names):
    return [R6(c, n) for c, n in zip(cols, names)]


def _rot_sql(p=""):
    x, y, z, w = (f"{p}{c}" for c in ("qx", "qy", "qz", "qw"))
    return [f"(1-2*({y}*{y}+{z}*{z}))", f"(2*({x}*{y}-{z}*{w}))", f"(2*({x}*{z}+{y}*{w}))",
            f"(2*({x}*{y}+{z}*{w}))", f"(1-2*({x}*{x}+{z}*{z}))", f"(2*({y}*{z}-{x}*{w}))",
            f"(2*({x}*{z}-{y}*{w}))", f"(2*({y}*{z}+{x}*{w}))", f"(1-2*({x}*{x}+{y}*{y}))"]


def _apply_sql(m, v):
    return [f"({m[3*i]}*{v[0]}+{m[3*i+1]}*{v[1]}+{m[3*i+2]}*{v[2]})" for i in range(3)]


_M = _rot_sql()
_MT = [_M[i] for i in (0, 3, 6, 1, 4, 7, 2, 5, 8)]
_INV = _apply_sql(_MT, ["tx", "ty", "tz"])


@query("se3_inverse", f"""
    SELECT clip, frame_idx, {', '.join(f'round(-{e}, 6) AS {n}' for e, n in zip(_INV, ('tx', 'ty', 'tz')))},
           round(-qx, 6) AS qx, round(-qy, 6) AS qy, round(-qz, 6) AS qz, round(qw, 6) AS qw FROM poses""")
def se3_inverse(v):
    return v.poses.select("clip", "frame_idx", *_r(se3.inverse(se3.pose()), se3.POSE))


@query("se3_product_identity", """
    SELECT clip, frame_idx, 0.0::DOUBLE AS tx, 0.0::DOUBLE AS ty, 0.0::DOUBLE AS tz, 0.0::DOUBLE AS qx, 0.0::DOUBLE AS qy, 0.0::DOUBLE AS qz, 1.0::DOUBLE AS qw FROM poses""")
def se3_product_identity(v):
    p = se3.pose()
    # adding zero turns -0.0 into 0.0
    return v.poses.select("clip", "frame_idx", *[(F.round(c, 6) + 0.0).alias(n)
                                                 for c, n in zip(se3.compose(p, se3.inverse(p)), se3.POSE)])


@query("quat_matrix", f"""
    SELECT clip, frame_idx, {', '.join(f'round({e}, 6) AS m{i}' for i, e in enumerate(_M))},
           {', '.join(f'round({c} * CASE WHEN qw < 0 THEN -1 ELSE 1 END, 6) AS {c}' for c in ('qx', 'qy', 'qz', 'qw'))} FROM poses""")
def quat_matrix(v):
    m = se3.quat_to_matrix(se3.pose()[3:])
    d = v.poses.select("clip", "frame_idx", *[c.alias(f"m{i}") for i, c in enumerate(m)])
    d = d.withColumn("q", se3.matrix_to_quat([F.col(f"m{i}") for i in range(9)]))
    sign = F.when(F.col("q.qw") < 0, -1.0).otherwise(1.0)
    return d.select("clip", "frame_idx", *[R6(F.col(f"m{i}"), f"m{i}") for i in range(9)],
                    *[R6(F.col("q." + c) * sign, c) for c in ("qx", "qy", "qz", "qw")])


@query("se3_exp_log", """
    SELECT clip, frame_idx, round(tx, 6) AS tx, round(ty, 6) AS ty, round(tz, 6) AS tz,
      round(qx * CASE WHEN qw < 0 THEN -1 ELSE 1 END, 6) AS qx, round(qy * CASE WHEN qw < 0 THEN -1 ELSE 1 END, 6) AS qy,
      round(qz * CASE WHEN qw < 0 THEN -1 ELSE 1 END, 6) AS qz, round(abs(qw), 6) AS qw,
      round(2 * atan(sqrt(qx*qx + qy*qy + qz*qz) / abs(qw)), 6) AS angle FROM poses""")
def se3_exp_log(v):
    names = [f"l{i}" for i in range(6)]
    d = se3.with_log(v.poses, se3.pose(), names).select("clip", "frame_idx", *names)
    t = [F.col(n) for n in names]
    back = se3.with_exp(d, t, se3.POSE).withColumn("angle", se3.length(t[3:]))
    sign = F.when(F.col("qw") < 0, -1.0).otherwise(1.0)
    return back.select("clip", "frame_idx", *_r(se3.pose()[:3], se3.POSE[:3]),
                       *[R6(F.col(c) * sign, c) for c in se3.POSE[3:]], R6(F.col("angle"), "angle"))


_PT = _apply_sql(_M, ["2.0::DOUBLE", "(tx+1)", "frame_idx"])


@query("sim3_apply", f"""
    SELECT clip, frame_idx, {', '.join(f'round(1.5 * {e} + {t}, 6) AS {n}' for e, t, n in zip(_PT, ('tx', 'ty', 'tz'), 'xyz'))},
           2.0::DOUBLE AS bx, round(tx + 1, 6) AS "by", round(frame_idx::DOUBLE, 6) AS bz FROM poses""")
def sim3_apply(v):
    p, s = se3.pose(), F.lit(1.5)
    x = [F.lit(2.0), F.col("tx") + 1, F.col("frame_idx").cast("double")]
    y = se3.sim3_point(p, s, x)
    d = v.poses.withColumns({f"y{i}": c for i, c in enumerate(y)})
    ip, inv_s = se3.sim3_inverse(p, s)
    back = se3.sim3_point(ip, inv_s, [F.col(f"y{i}") for i in range(3)])
    return d.select("clip", "frame_idx", *_r([F.col(f"y{i}") for i in range(3)], "xyz"), *_r(back, ("bx", "by", "bz")))


def _rig(v):
    """One rig pose per region row: a camera to the side, turned about the vertical axis."""
    a = F.col("r_regionkey") * 0.1
    return v.table("region").select(F.col("r_regionkey").alias("view_idx"), F.col("r_regionkey").cast("double").alias("tx"),
                                    F.lit(0.5).alias("ty"), F.lit(0.0).alias("tz"), F.lit(0.0).alias("qx"),
                                    F.sin(a).alias("qy"), F.lit(0.0).alias("qz"), F.cos(a).alias("qw"))


_RIGT = _apply_sql(_M, ["view_idx", "0.5::DOUBLE", "0"])


@query("rig_trajectory", f"""
    WITH r AS (SELECT r_regionkey AS view_idx, sin(r_regionkey * 0.1::DOUBLE) AS sy, cos(r_regionkey * 0.1::DOUBLE) AS cy FROM region)
    SELECT clip, frame_idx, view_idx, {', '.join(f'round({e} + {t}, 6) AS {t}' for e, t in zip(_RIGT, ('tx', 'ty', 'tz')))},
           round(qx * cy - qz * sy, 6) AS qx, round(qy * cy + qw * sy, 6) AS qy, round(qz * cy + qx * sy, 6) AS qz,
           round(qw * cy - qy * sy, 6) AS qw FROM poses, r""")
def rig_trajectory(v):
    d = se3.rig_trajectory(v.poses, _rig(v))
    return d.select("clip", "frame_idx", "view_idx", *_r(se3.pose(), se3.POSE))


@query("lookup_frame_strict", """
    SELECT p.clip, p.frame_idx, tx FROM poses p""")
def lookup_frame_strict(v):
    want = v.poses.select("clip", "frame_idx")
    return TR.lookup_strict(want, v.poses.select("clip", "frame_idx", "tx"), ["clip", "frame_idx"], "tx")


@query("assign_attributes", """
    SELECT p.clip, p.frame_idx, p.tx, CASE WHEN p.is_kf THEN p.tz END AS kf_tz, c.n AS clip_frames
    FROM poses p JOIN (SELECT clip, count(*) AS n FROM poses GROUP BY clip) c ON p.clip = c.clip""")
def assign_attributes(v):
    p = v.poses
    frames = p.select("clip", "frame_idx", "tx")
    d = TR.assign_by_frame(frames, p.filter("is_kf").select("clip", "frame_idx", F.col("tz").alias("kf_tz")), ["clip", "frame_idx"])
    return TR.assign_by_clip(d, p.groupBy("clip").agg(F.count("*").alias("clip_frames")), "clip")


@query("asof_keyframe", """
    WITH k AS (SELECT clip, frame_idx AS t, tx, coalesce(lead(frame_idx) OVER w, frame_idx) AS t1 FROM poses WHERE is_kf
               WINDOW w AS (PARTITION BY clip ORDER BY frame_idx))
    SELECT p.clip, p.frame_idx, k.t AS t0, k.tx AS tx0, k.t1 FROM poses p ASOF JOIN k ON p.clip = k.clip AND p.frame_idx >= k.t""")
def asof_keyframe(v):
    p = v.poses
    d = TR.asof_keyframe(p.select("clip", "frame_idx"), p.filter("is_kf").select("clip", "frame_idx", "tx"), ["clip"], "frame_idx", ["tx"])
    return d.select("clip", "frame_idx", F.col("k0.frame_idx").alias("t0"), F.col("k0.tx").alias("tx0"), F.col("k1.frame_idx").alias("t1"))


@query("keyframe_neighborhood", """
    WITH k AS (SELECT clip, frame_idx AS t, row_number() OVER (PARTITION BY clip ORDER BY frame_idx) - 1 AS kf, count(*) OVER (PARTITION BY clip) AS n
               FROM poses WHERE is_kf),
    f AS (SELECT p.clip, p.frame_idx, least((SELECT count(*) FROM k WHERE k.clip = p.clip AND k.t < p.frame_idx) + 2, (SELECT max(n) FROM k WHERE k.clip = p.clip) - 1) AS r FROM poses p)
    SELECT f.clip, f.frame_idx, k.kf, k.t AS kf_frame_idx FROM f JOIN k ON k.clip = f.clip AND k.kf BETWEEN f.r - 4 AND f.r""")
def keyframe_neighborhood(v):
    p = v.poses
    return TR.keyframe_neighborhood(p.select("clip", "frame_idx"), p.filter("is_kf"), ["clip"], "frame_idx", 2)


@query("keyframe_velocity")
def keyframe_velocity(v):
    d = TR.keyframe_velocity(v.poses.filter("is_kf").drop("is_kf"), ["clip"], "frame_idx")
    return d.select("clip", "frame_idx", *[R6(F.col(f"v{i}"), f"v{i}") for i in range(6)])


@query("pose_interpolate")
def pose_interpolate(v):
    d = TR.pose_interpolate(v.poses.select("clip", "frame_idx"), v.poses.filter("is_kf").drop("is_kf"), ["clip"], "frame_idx")
    return d.select("clip", "frame_idx", *_r(se3.pose(), se3.POSE))


_A, _B = ["tx", "ty", "tz"], ["rx", "ry", "rz"]


def _moved(v):
    """Positions and the same positions turned, scaled, shifted and slightly disturbed."""
    q = [F.lit(0.0), F.lit(0.0), F.lit(0.6), F.lit(0.8)]
    y = se3.sim3_point([F.lit(1.0), F.lit(-2.0), F.lit(0.5), *q], F.lit(1.7), [F.col(c) for c in _A])
    noise = (F.col("frame_idx") % 7) * 1e-3
    return v.poses.select("clip", "frame_idx", *_A, *[(c + noise).alias(n) for c, n in zip(y, _B)])


@query("align_points")
def align_points(v):
    d = TR.align_points(_moved(v), ["clip"], _A, _B)
    return d.select("clip", "n", *[R6(F.col(c), c) for c in d.columns if c not in ("clip", "n")])


@query("trajectory_error")
def trajectory_error(v):
    d = TR.trajectory_error(_moved(v), ["clip"], _A, _B)
    return d.select("clip", *[R6(F.col(c), c) for c in ("mean", "rmse", "max")])


@query("rotation_average")
def rotation_average(v):
    d = TR.pose_mean(v.poses, ["clip"])
    return d.select("clip", *_r(se3.pose(), se3.POSE))


# --- cameras ---------------------------------------------------------------------------------------

@query("fov_focal", """
    SELECT clip, frame_idx, round(480 / 2.0::DOUBLE / tan((0.6 + abs(tx) / 4) / 2), 6) AS focal, round(0.6 + abs(tx) / 4, 6) AS fov,
           round(480 / (2 * tan((0.6 + abs(tx) / 4) / 2)), 6) AS fx, round(2 * atan(320 / (500 + 10 * ty) * 300 / 640), 6) AS fov_resized FROM poses""")
def fov_focal(v):
    fov = 0.6 + F.abs("tx") / 4
    f = C.fov_to_focal(fov, F.lit(480.0))
    return v.poses.select("clip", "frame_idx", R6(f, "focal"), R6(C.focal_to_fov(f, F.lit(480.0)), "fov"),
                          R6(C.intrinsics_from_fov(fov, F.lit(480.0), F.lit(640.0))[0], "fx"),
                          R6(C.fov_after_resize(500 + 10 * F.col("ty"), F.lit(320.0), F.lit(300.0), F.lit(640.0)), "fov_resized"))


@query("intrinsics_resize_crop", """
    WITH k AS (SELECT clip, frame_idx, 500 + 10 * tx AS fx, 510 + 10 * ty AS fy, 320 + tz AS cx, 240 + qx AS cy FROM poses)
    SELECT clip, frame_idx, round(fx * 320 / 640, 6) AS fx, round(fy * 256 / 480, 6) AS fy, round(cx * 320 / 640 - 32, 6) AS cx, round(cy * 256 / 480 - 28, 6) AS cy,
           round(fx, 6) AS bfx, round(fy, 6) AS bfy, round(cx, 6) AS bcx, round(cy, 6) AS bcy, round(640 - cx, 6) AS flipped FROM k""")
def intrinsics_resize_crop(v):
    k = [500 + 10 * F.col("tx"), 510 + 10 * F.col("ty"), 320 + F.col("tz"), 240 + F.col("qx")]
    i = F.lit
    new = C.resize_center_crop(k, (i(480), i(640)), (i(256), i(320)), (i(200), i(256)))
    back = C.recover_intrinsics(new, i(2.0), i(480 / 256), i(32), i(28))
    return v.poses.select("clip", "frame_idx", *_r(new, ("fx", "fy", "cx", "cy")), *_r(back, ("bfx", "bfy", "bcx", "bcy")),
                          R6(C.flip_intrinsics(k, i(640))[2], "flipped"))


_K = [20.0, 21.0, 64.0, 48.0]


def _k():
    return [F.lit(x) for x in _K]


def _xyz():
    return [F.col(c) for c in "xyz"]


@query("pinhole_project", """
    SELECT pid, round(20 * x / (CASE WHEN z - 2 < 0.1 THEN 1 ELSE z - 2 END) + 64, 6) AS u,
           round(21 * y / (CASE WHEN z - 2 < 0.1 THEN 1 ELSE z - 2 END) + 48, 6) AS v,
           (20 * x / z + 64 > 0 AND 20 * x / z + 64 < 512 AND 21 * y / z + 48 > 0 AND 21 * y / z + 48 < 384) AS valid FROM points""")
def pinhole_project(v):
    x, y, z = _xyz()
    u = C.pinhole_project(_k(), [x, y, z - 2])
    unit = C.pinhole_project_unit(_k(), [x, y, z], 384.0, 512.0)
    return v.points.select("pid", *_r(u, "uv"), unit["valid"].alias("valid"))


@query("pinhole_unproject", """
    SELECT frame, u, v, round(depth * (u - 32) / 40, 6) AS x, round(depth * (v - 24) / 41, 6) AS y, round(depth, 6) AS z,
           round((u - 32) / 40 / sqrt(((u - 32) / 40.0::DOUBLE) ** 2 + ((v - 24) / 41.0::DOUBLE) ** 2 + 1), 6) AS rx FROM depth_px""")
def pinhole_unproject(v):
    k = [F.lit(c) for c in (40.0, 41.0, 32.0, 24.0)]
    u, vv = F.col("u"), F.col("v")
    return v.depth_px.select("frame", "u", "v", *_r(C.pinhole_unproject(k, u, vv, F.col("depth")), "xyz"),
                             R6(C.pinhole_ray(k, u, vv, unit=True)[0], "rx"))


@query("mei_project_unproject", """
    SELECT pid, round(20 * x / (z + 0.3 * sqrt(x*x + y*y + z*z)) + 64, 6) AS u, round(21 * y / (z + 0.3 * sqrt(x*x + y*y + z*z)) + 48, 6) AS v,
           round(x / z, 8) AS rx, round(y / z, 8) AS ry, round(20 / 1.3, 6) AS pinhole_fx FROM points""")
def mei_project_unproject(v):
    k = [*_k(), F.lit(0.3)]
    d = v.points.select("pid", *[c.alias(n) for c, n in zip(C.mei_project(k, _xyz()), "uv")])
    ray = C.mei_unproject(k, F.col("u"), F.col("v"))
    return d.select("pid", *_r([F.col("u"), F.col("v")], "uv"), F.round(ray[0], 8).alias("rx"), F.round(ray[1], 8).alias("ry"),
                    R6(C.mei_pinhole(k)[0], "pinhole_fx"))


@query("panorama_project", """
    WITH r AS (SELECT pid, x, y, z, sqrt(x*x + y*y + z*z) AS r FROM points)
    SELECT pid, round(atan2(x, z) / (2 * pi()) + 0.5, 6) AS u, round(acos(-y / r) / pi(), 6) AS v,
           round(x / r, 6) AS rx, round(y / r, 6) AS ry, round(z / r, 6) AS rz FROM r""")
def panorama_project(v):
    d = v.points.select("pid", *[c.alias(n) for c, n in zip(C.panorama_project(_xyz()), "uv")])
    return d.select("pid", *_r([F.col("u"), F.col("v")], "uv"),
                    *_r(C.panorama_unproject(F.col("u"), F.col("v")), ("rx", "ry", "rz")))


@query("spherical_convert", """
    WITH r AS (SELECT pid, x, y, z, sqrt(x*x + y*y + z*z) AS r FROM points)
    SELECT pid, round(atan2(x / r, z / r), 6) AS theta, round(acos(y / r), 6) AS phi, round(r, 6) AS r, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z,
           round(asin(y / r), 6) AS pitch, round(z, 6) AS zb FROM r""")
def spherical_convert(v):
    d = v.points.select("pid", *[c.alias(n) for c, n in zip(C.to_spherical(_xyz()), ("theta", "phi", "r"))],
                        F.col("y").alias("y0"), F.col("z").alias("z0"))
    s = [F.col(c) for c in ("theta", "phi", "r")]
    pitch = C.to_spherical_zbuffer([F.lit(0.0), F.col("y0") / F.col("r"), F.col("z0")])[0]
    zb = C.from_spherical_zbuffer(s[0], s[1], F.col("z0"))[2]
    return d.select("pid", *_r(s, ("theta", "phi", "r")), *_r(C.from_spherical(*s), "xyz"), R6(pitch, "pitch"), R6(zb, "zb"))


@query("depth_disparity", """
    SELECT frame, u, v, round(CASE WHEN label <> 1 THEN 1 / depth ELSE 0 END, 9) AS disp,
           round(CASE WHEN label <> 1 THEN 1 / depth ELSE -depth END, 9) AS disp_keep, round(1 / greatest(depth, 1e-3), 9) AS inv
    FROM depth_px""")
def depth_disparity(v):
    # label 1 stands for unusable depth
    x = F.when(F.col("label") == 1, -F.col("depth")).otherwise(F.col("depth"))
    return v.depth_px.select(
        "frame", "u", "v", F.round(C.depth_to_disparity(x), 9).alias("disp"),
        F.round(C.depth_to_disparity(x, keep=True), 9).alias("disp_keep"),
        F.round(C.depth_to_disparity(F.col("depth"), floor=1e-3), 9).alias("inv"))


@query("latitude_horizon", """
    WITH r AS (SELECT pid, x / sqrt(x*x + y*y + z*z) AS x, y / sqrt(x*x + y*y + z*z) AS y, z / sqrt(x*x + y*y + z*z) AS z FROM points)
    SELECT pid, round(asin(least(greatest(0.6 * y + 0.8 * z, -1 + 1e-6), 1 - 1e-6)), 6) AS latitude,
           round((my + mx * tan(y / 4)) / 384, 6) AS horizon_left, round((my - (512 - mx) * tan(y / 4)) / 384, 6) AS horizon_right
    FROM (SELECT *, 20 * sin(y / 4) * tan(z / 4) + 64 AS mx, 21 * cos(y / 4) * tan(z / 4) + 48 AS my FROM r)""")
def latitude_horizon(v):
    n = se3.length(_xyz())
    d = v.points.select("pid", *[(c / n).alias(m) for c, m in zip(_xyz(), "xyz")])
    h = C.horizon_line(_k(), F.col("y") / 4, F.col("z") / 4, F.lit(384.0), F.lit(512.0))
    return d.select("pid", R6(C.latitude(_xyz(), [F.lit(0.0), F.lit(0.6), F.lit(0.8)]), "latitude"),
                    R6(h["left"], "horizon_left"), R6(h["right"], "horizon_right"))


@query("standard_size", """
    WITH s AS (SELECT id, 240 + id % 480 AS h, 320 + id % 640 AS w FROM strings),
    t AS (SELECT id, CAST(floor(h * sqrt(196608 / (h * w)::DOUBLE)) AS BIGINT) AS h1, CAST(floor(w * sqrt(196608 / (h * w)::DOUBLE)) AS BIGINT) AS w1 FROM s)
    SELECT id, h1 - h1 % 8 AS h, w1 - w1 % 8 AS w, h1 % 8 // 2 AS top, w1 % 8 // 2 AS "left" FROM t""")
def standard_size(v):
    s = C.standard_size(240 + F.col("id") % 480, 320 + F.col("id") % 640)
    return v.strings.select("id", s.alias("s")).select("id", "s.h", "s.w", "s.top", "s.left")


@query("aspect_resize", """
    WITH s AS (SELECT id, 240 + id * 37 % 480 AS h, 320 + id * 91 % 640 AS w FROM strings),
    t AS (SELECT *, CASE WHEN greatest(h, w)::DOUBLE / least(h, w) * 300 > 500 THEN CAST(round_even(500 * least(h, w) / greatest(h, w)::DOUBLE, 0) AS BIGINT) ELSE 300 END AS size FROM s)
    SELECT id, CAST(CASE WHEN least(h, w) = size THEN h WHEN w < h THEN floor(size * h / w::DOUBLE) ELSE size END AS BIGINT) AS h,
           CAST(CASE WHEN least(h, w) = size THEN w WHEN w < h THEN size ELSE floor(size * w / h::DOUBLE) END AS BIGINT) AS w,
           CAST(floor(h * (1024.0::DOUBLE / greatest(h, w)) + 0.5) AS BIGINT) AS long_h, CAST(floor(w * (1024.0::DOUBLE / greatest(h, w)) + 0.5) AS BIGINT) AS long_w FROM t""")
def aspect_resize(v):
    h, w = 240 + F.col("id") * 37 % 480, 320 + F.col("id") * 91 % 640
    d = v.strings.select("id", C.aspect_resize(h, w, 300, 500).alias("a"), C.long_side_resize(h, w, 1024).alias("l"))
    return d.select("id", "a.h", "a.w", F.col("l.h").alias("long_h"), F.col("l.w").alias("long_w"))


@query("crop_boxes", """
    WITH s AS (SELECT id, 240 + id % 480 AS h, 320 + id % 640 AS w, l AS layer, CAST(pow(2, l) AS BIGINT) AS n FROM strings, range(3) r(l)),
    o AS (SELECT *, CAST(CASE WHEN layer = 0 THEN 0 ELSE floor(0.25 * least(h, w) * (2.0 / n)) END AS BIGINT) AS ov FROM s),
    c AS (SELECT *, CAST(ceil((ov * (n - 1) + w) / n::DOUBLE) AS BIGINT) AS cw, CAST(ceil((ov * (n - 1) + h) / n::DOUBLE) AS BIGINT) AS ch FROM o)
    SELECT id, CAST(layer AS INT) AS layer, (cw - ov) * a AS x0, (ch - ov) * b AS y0, least((cw - ov) * a + cw, w) AS x1, least((ch - ov) * b + ch, h) AS y1
    FROM c, range(4) x(a), range(4) y(b) WHERE a < n AND b < n""")
def crop_boxes(v):
    d = v.strings.select("id", (240 + F.col("id") % 480).alias("h"), (320 + F.col("id") % 640).alias("w"))
    return C.crop_boxes(d, "h", "w", 2, 0.25).drop("h", "w")


@query("point_grid", """
    WITH s AS (SELECT id, l AS layer, CAST(floor((3 + id % 6) / pow(2, l)) AS BIGINT) AS n FROM strings, range(2) r(l))
    SELECT id, CAST(layer AS INT) AS layer, round((a + 0.5) / n, 6) AS x, round((b + 0.5) / n, 6) AS y FROM s, range(9) p(a), range(9) q(b) WHERE a < n AND b < n""")
def point_grid(v):
    d = C.point_grid(v.strings.select("id"), 3 + F.col("id") % 6, 1, 2)
    return d.select("id", "layer", R6(F.col("x"), "x"), R6(F.col("y"), "y"))


@query("aabb_grid", """
    WITH s AS (SELECT id, CAST(floor((1 + id % 3) / 0.5) AS BIGINT) AS nx FROM strings)
    SELECT id, round(a * (1 + id % 3)::DOUBLE / (nx - 1), 6) AS x, round(b * 2.0::DOUBLE / 3, 6) AS y, round(-1 + c * 1.0::DOUBLE, 6) AS z
    FROM s, range(6) p(a), range(4) q(b), range(2) r(c) WHERE a < nx""")
def aabb_grid(v):
    d = v.strings.select("id")
    lo = [F.lit(0.0), F.lit(0.0), F.lit(-1.0)]
    hi = [1.0 + F.col("id") % 3, F.lit(2.0), F.lit(0.0)]
    return C.aabb_grid(d, lo, hi, 0.5).select("id", *_r(_xyz(), "xyz"))


@query("look_at_path", """
    WITH s AS (SELECT id, 1 + id % 5 AS depth, k AS step FROM strings, range(13) r(k)),
    p AS (SELECT *, CASE id % 2 WHEN 0 THEN -step * 0.2 * depth / 13 ELSE 0.2 * (cos(step * 2 * pi() / 12) - 1) * depth END AS x,
                 CASE id % 2 WHEN 0 THEN 0 ELSE 0.2 * sin(step * 2 * pi() / 12) * depth END AS y FROM s),
    f AS (SELECT *, -x / sqrt(x*x + y*y + depth*depth) AS fx, -y / sqrt(x*x + y*y + depth*depth) AS fy, depth / sqrt(x*x + y*y + depth*depth) AS fz FROM p)
    SELECT id, CAST(step AS INT) AS step, round(fz / sqrt(fx*fx + fz*fz), 6) AS m0, round(-fx / sqrt(fx*fx + fz*fz), 6) AS m2, round(-x, 6) AS m3,
           round(sqrt(fx*fx + fz*fz), 6) AS m5, round(-y, 6) AS m7, round(fx, 6) AS m8, round(fy, 6) AS m9, round(fz, 6) AS m10 FROM f""")
def look_at_path(v):
    kind = F.when(F.col("id") % 2 == 0, "left").otherwise("clockwise")
    d = C.camera_path(v.strings.select("id"), kind, 13, F.lit(0.2), (1 + F.col("id") % 5).cast("double"), "center_facing")
    return d.select("id", "step", *[R6(F.col(f"m{i}") + 0.0, f"m{i}") for i in (0, 2, 3, 5, 7, 8, 9, 10)])
