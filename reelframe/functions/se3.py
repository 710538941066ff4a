"""Rigid and similarity transforms as column expressions.

A pose is a list of seven columns tx, ty, tz, qx, qy, qz, qw; a vector is a list of three.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSE = ["tx", "ty", "tz", "qx", "qy", "qz", "qw"]
Vec = list


def pose(prefix: str = "") -> list[Column]:
    """Pose columns, or the fields of a struct column given as 'name.'."""
    return [F.col(prefix + c) for c in POSE]


def named(p: list[Column], prefix: str = "") -> list[Column]:
    return [c.alias(prefix + n) for c, n in zip(p, POSE)]


def as_struct(p: list[Column]) -> Column:
    return F.struct(*named(p))


def cross(a: Vec, b: Vec) -> Vec:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def length(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def add(a: Vec, b: Vec) -> Vec:
    return [x + y for x, y in zip(a, b)]


def times(k, a: Vec) -> Vec:
    return [k * x for x in a]


def rotate(q: Vec, v: Vec) -> Vec:
    """v + 2w (q x v) + 2 q x (q x v)."""
    uv = times(F.lit(2.0), cross(q[:3], v))
    return add(add(v, times(q[3], uv)), cross(q[:3], uv))


def quat_mul(a: Vec, b: Vec) -> Vec:
    v = add(add(times(a[3], b[:3]), times(b[3], a[:3])), cross(a[:3], b[:3]))
    return [*v, a[3] * b[3] - dot(a[:3], b[:3])]


def quat_inv(q: Vec) -> Vec:
    return [-q[0], -q[1], -q[2], q[3]]


def act(p: list[Column], v: Vec) -> Vec:
    return add(rotate(p[3:], v), p[:3])


def inverse(p: list[Column]) -> list[Column]:
    qi = quat_inv(p[3:])
    return [-c for c in rotate(qi, p[:3])] + qi


def compose(a: list[Column], b: list[Column]) -> list[Column]:
    return act(a, b[:3]) + quat_mul(a[3:], b[3:])


def quat_to_matrix(q: Vec) -> list[Column]:
    """Nine entries, row by row."""
    x, y, z, w = q
    return [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
            2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
            2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]


def matrix_to_quat(m: list[Column]) -> Column:
    """Struct (qx, qy, qz, qw): the largest of the four squared components picks the formula."""
    m00, m01, m02, m10, m11, m12, m20, m21, m22 = m
    sq = {"qw": m00 + m11 + m22, "qx": m00 - m11 - m22, "qy": m11 - m00 - m22, "qz": m22 - m00 - m11}
    terms = {
        "qw": lambda s: (m21 - m12, m02 - m20, m10 - m01, s),
        "qx": lambda s: (s, m01 + m10, m02 + m20, m21 - m12),
        "qy": lambda s: (m01 + m10, s, m12 + m21, m02 - m20),
        "qz": lambda s: (m02 + m20, m12 + m21, s, m10 - m01),
    }
    top = F.greatest(*sq.values())
    out = None
    for k, e in sq.items():
        # 4 c^2 = 1 + e for the component c of this branch; the other entries are 4 c times theirs
        s = 1 + e
        half = F.sqrt(s) * 2
        q = F.struct(*[(t / half).alias(n) for t, n in zip(terms[k](s), ("qx", "qy", "qz", "qw"))])
        out = F.when(e == top, q) if out is None else out.when(e == top, q)
    return out


def se3_matrix(p: list[Column]) -> list[Column]:
    """Twelve entries of the 3x4 matrix, row by row."""
    r = quat_to_matrix(p[3:])
    return [*r[0:3], p[0], *r[3:6], p[1], *r[6:9], p[2]]


_EPS = 1e-6


def so3_log(q: Vec) -> Vec:
    """Rotation vector: the angle is 2 atan2(n, |w|) with the sign of w; next to n = 0 its quotient by n is 2 / w (1 - (n / w)^2 / 3)."""
    w, n = q[3], length(q[:3])
    angle = 2.0 * F.atan2(n, F.abs(w)) * F.when(w < 0, -1.0).otherwise(1.0)
    t = n / w
    return times(F.when(n < _EPS, 2.0 / w * (1.0 - t * t / 3.0)).otherwise(angle / n), q[:3])


def se3_log(p: list[Column]) -> list[Column]:
    """Tangent (translation part first)."""
    phi = so3_log(p[3:])
    th2 = dot(phi, phi)
    th = F.sqrt(th2)
    k = F.when(th < _EPS, F.lit(1.0 / 12.0)).otherwise(
        1.0 / th2 - (1.0 + F.cos(th)) / (2.0 * th * F.sin(th)))
    pt = cross(phi, p[:3])
    tau = add(add(p[:3], times(F.lit(-0.5), pt)), times(k, cross(phi, pt)))
    return tau + phi


def se3_exp(t: list[Column]) -> list[Column]:
    tau, phi = t[:3], t[3:]
    th2 = dot(phi, phi)
    th = F.sqrt(th2)
    small = th < _EPS
    a = F.when(small, 0.5 - th2 / 24.0).otherwise((1.0 - F.cos(th)) / th2)
    b = F.when(small, F.lit(1.0 / 6.0)).otherwise((th - F.sin(th)) / (th2 * th))
    pt = cross(phi, tau)
    tr = add(add(tau, times(a, pt)), times(b, cross(phi, pt)))
    k = F.when(small, 0.5 - th2 / 48.0).otherwise(F.sin(th / 2.0) / th)
    return tr + times(k, phi) + [F.cos(th / 2.0)]


def with_log(df: DataFrame, p: list[Column], names: list[str]) -> DataFrame:
    """Add the tangent of a pose in steps, so that no step repeats the expressions of the one before."""
    d = df.withColumns({f"__q{i}": c for i, c in enumerate(p)})
    q = [F.col(f"__q{i}") for i in range(7)]
    d = d.withColumns(dict(zip(names[3:], so3_log(q[3:]))))
    phi = [F.col(n) for n in names[3:]]
    d = d.withColumn("__th2", dot(phi, phi)).withColumns({f"__c{i}": c for i, c in enumerate(cross(phi, q[:3]))})
    th2, th = F.col("__th2"), F.sqrt("__th2")
    k = F.when(th < _EPS, F.lit(1.0 / 12.0)).otherwise(1.0 / th2 - (1.0 + F.cos(th)) / (2.0 * th * F.sin(th)))
    pt = [F.col(f"__c{i}") for i in range(3)]
    tau = add(add(q[:3], times(F.lit(-0.5), pt)), times(k, cross(phi, pt)))
    return d.select(*df.columns, *[c.alias(n) for c, n in zip(tau, names[:3])], *names[3:])


def with_exp(df: DataFrame, t: list[Column], names: list[str]) -> DataFrame:
    """Add the pose of a tangent, in steps like `with_log`."""
    d = df.withColumns({f"__t{i}": c for i, c in enumerate(t)})
    tau, phi = [F.col(f"__t{i}") for i in range(3)], [F.col(f"__t{i}") for i in range(3, 6)]
    d = d.withColumn("__th2", dot(phi, phi)).withColumns({f"__c{i}": c for i, c in enumerate(cross(phi, tau))})
    th2, th = F.col("__th2"), F.sqrt("__th2")
    small = th < _EPS
    d = d.withColumn("__a", F.when(small, 0.5 - th2 / 24.0).otherwise((1.0 - F.cos(th)) / th2)) \
        .withColumn("__b", F.when(small, F.lit(1.0 / 6.0)).otherwise((th - F.sin(th)) / (th2 * th))) \
        .withColumn("__k", F.when(small, 0.5 - th2 / 48.0).otherwise(F.sin(th / 2.0) / th))
    pt = [F.col(f"__c{i}") for i in range(3)]
    tr = add(add(tau, times(F.col("__a"), pt)), times(F.col("__b"), cross(phi, pt)))
    return d.select(*df.columns, *[c.alias(n) for c, n in zip(tr + times(F.col("__k"), phi) + [F.cos(th / 2.0)], names)])


# --- similarity -----------------------------------------------------------------------------------

def sim3_point(p: list[Column], s: Column, v: Vec) -> Vec:
    return add(times(s, rotate(p[3:], v)), p[:3])


def sim3_pose(p: list[Column], s: Column, x: list[Column]) -> list[Column]:
    return sim3_point(p, s, x[:3]) + quat_mul(p[3:], x[3:])


def sim3_inverse(p: list[Column], s: Column) -> tuple[list[Column], Column]:
    qi = quat_inv(p[3:])
    return [-c / s for c in rotate(qi, p[:3])] + qi, 1.0 / s


# --- tables ---------------------------------------------------------------------------------------

def rig_trajectory(poses: DataFrame, rig: DataFrame, max_views: int = 4096) -> DataFrame:
    """Pose of every view: frame pose times rig pose. The rig has one row per camera; a table with more
    than `max_views` rows is refused."""
    views = rig.agg(F.collect_list(F.struct("view_idx", as_struct(pose()).alias("r"))).alias("v")).select(
        F.when(F.size("v") <= max_views, F.col("v")).otherwise(F.raise_error(F.lit("rig table too large"))))
    d = poses.withColumn("__v", F.explode(views.scalar()))
    keep = [c for c in poses.columns if c not in POSE]
    return d.select(*keep, F.col("__v.view_idx").alias("view_idx"), *named(compose(pose(), pose("__v.r."))))
