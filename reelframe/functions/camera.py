"""Camera models, image sizes and camera paths as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.functions import se3

MIN_DEPTH = 0.1


# --- field of view, intrinsics, sizes --------------------------------------------------------------

def fov_to_focal(fov: Column, size: Column) -> Column:
    return size / 2.0 / F.tan(fov / 2.0)


def focal_to_fov(focal: Column, size: Column) -> Column:
    return 2.0 * F.atan(size / (2.0 * focal))


def intrinsics_from_fov(fov_y: Column, h: Column, w: Column) -> list[Column]:
    """fx = fy from the vertical field of view, principal point in the middle."""
    f = h / (2.0 * F.tan(fov_y / 2.0))
    return [f, f, w / 2.0, h / 2.0]


def fov_after_resize(focal: Column, centre: Column, new: Column, old: Column) -> Column:
    return 2.0 * F.atan(centre / focal * new / old)


def resize_intrinsics(k: list[Column], sx: Column, sy: Column) -> list[Column]:
    return [k[0] * sx, k[1] * sy, k[2] * sx, k[3] * sy]


def crop_intrinsics(k: list[Column], left: Column, top: Column) -> list[Column]:
    return [k[0], k[1], k[2] - left, k[3] - top]


def flip_intrinsics(k: list[Column], w: Column) -> list[Column]:
    """Mirrored left to right."""
    return [k[0], k[1], w - k[2], k[3]]


def resize_center_crop(k: list[Column], src_hw, resize_hw, crop_hw) -> list[Column]:
    (sh, sw), (rh, rw), (ch, cw) = src_hw, resize_hw, crop_hw
    r = resize_intrinsics(k, rw / (sw * F.lit(1.0)), rh / (sh * F.lit(1.0)))
    return crop_intrinsics(r, F.greatest(F.floor((rw - cw) / 2), F.lit(0)), F.greatest(F.floor((rh - ch) / 2), F.lit(0)))


def recover_intrinsics(k: list[Column], fac_x, fac_y, left, top) -> list[Column]:
    """Undo a resize and crop."""
    return [k[0] * fac_x, k[1] * fac_y, (k[2] + left) * fac_x, (k[3] + top) * fac_y]


def intrinsics_matrix(k: list[Column]) -> list[Column]:
    z, one = F.lit(0.0), F.lit(1.0)
    return [k[0], z, k[2], z, k[1], k[3], z, z, one]


def standard_size(h: Column, w: Column, area: int = 384 * 512) -> Column:
    """Size with the given area and the aspect of (h, w), cut to multiples of 8; with the crop offsets."""
    s = F.sqrt(F.lit(float(area)) / (h * w))
    h1, w1 = F.floor(h * s), F.floor(w * s)
    return F.struct((h1 - h1 % 8).alias("h"), (w1 - w1 % 8).alias("w"),
                    F.floor(h1 % 8 / 2).alias("top"), F.floor(w1 % 8 / 2).alias("left"),
                    (w / w1).alias("fac_x"), (h / h1).alias("fac_y"))


def aspect_resize(h: Column, w: Column, short: int, longest: int) -> Column:
    """Size with the given short side, capped on the long side."""
    lo, hi = F.least(h, w) * F.lit(1.0), F.greatest(h, w) * F.lit(1.0)
    size = F.when(hi / lo * short > longest, F.bround(longest * lo / hi, 0).cast("long")).otherwise(F.lit(short).cast("long"))
    same = F.least(h, w) == size
    oh = F.when(same, h).when(w < h, F.floor(size * h / w)).otherwise(size)
    ow = F.when(same, w).when(w < h, size).otherwise(F.floor(size * w / h))
    return F.struct(oh.cast("long").alias("h"), ow.cast("long").alias("w"))


def long_side_resize(h: Column, w: Column, target: int) -> Column:
    s = F.lit(float(target)) / F.greatest(h, w)
    return F.struct(F.floor(h * s + 0.5).alias("h"), F.floor(w * s + 0.5).alias("w"))


# --- models ----------------------------------------------------------------------------------------

def pinhole_project(k: list[Column], p: list[Column], limit: bool = True) -> list[Column]:
    z = F.when(p[2] < MIN_DEPTH, F.lit(1.0)).otherwise(p[2]) if limit else p[2]
    return [k[0] * p[0] / z + k[2], k[1] * p[1] / z + k[3]]


def pinhole_project_unit(k: list[Column], p: list[Column], h: float, w: float) -> Column:
    """Struct (u, v, d, valid) in 0..1; all zero outside the image."""
    u, v = (k[0] * p[0] / p[2] + k[2]) / w, (k[1] * p[1] / p[2] + k[3]) / h
    ok = (p[2] > 0) & (u > 0) & (u < 1) & (v > 0) & (v < 1)
    z = lambda c: F.when(ok, c).otherwise(0.0)
    return F.struct(z(u).alias("u"), z(v).alias("v"), z(p[2]).alias("d"), ok.alias("valid"))


def pinhole_ray(k: list[Column], u: Column, v: Column, unit: bool = False) -> list[Column]:
    r = [(u - k[2]) / k[0], (v - k[3]) / k[1], F.lit(1.0)]
    return se3.times(1.0 / se3.length(r), r) if unit else r


def pinhole_unproject(k: list[Column], u: Column, v: Column, depth: Column) -> list[Column]:
    return se3.times(depth, pinhole_ray(k, u, v))


def mei_project(k: list[Column], p: list[Column], limit: bool = True) -> list[Column]:
    """Unified model with one parameter k[4]."""
    z = F.when(p[2] < MIN_DEPTH, F.lit(1.0)).otherwise(p[2]) if limit else p[2]
    d = z + k[4] * F.sqrt(p[0] * p[0] + p[1] * p[1] + z * z)
    return [k[0] * p[0] / d + k[2], k[1] * p[1] / d + k[3]]


def mei_unproject(k: list[Column], u: Column, v: Column) -> list[Column]:
    """Ray with z = 1."""
    x, y = (u - k[2]) / k[0], (v - k[3]) / k[1]
    r2 = x * x + y * y
    f = (k[4] + F.sqrt(1.0 + (1.0 - k[4] * k[4]) * r2)) / (1.0 + r2)
    return [x * f / (f - k[4]), y * f / (f - k[4]), F.lit(1.0)]


def mei_pinhole(k: list[Column]) -> list[Column]:
    """Pinhole intrinsics with the same slope in the centre."""
    return [k[0] / (1.0 + k[4]), k[1] / (1.0 + k[4]), k[2], k[3]]


def panorama_project(p: list[Column]) -> list[Column]:
    """Equirectangular (u, v) in 0..1."""
    return [F.atan2(p[0], p[2]) / (2 * math.pi) + 0.5, F.acos(-p[1] / se3.length(p)) / math.pi]


def panorama_unproject(u: Column, v: Column) -> list[Column]:
    th, ph = (u - 0.5) * (2 * math.pi), v * math.pi
    return [F.sin(ph) * F.sin(th), -F.cos(ph), F.sin(ph) * F.cos(th)]


def to_spherical(p: list[Column]) -> list[Column]:
    """theta, phi, range."""
    r = se3.length(p)
    return [F.atan2(p[0] / r, p[2] / r), F.acos(p[1] / r), r]


def from_spherical(th: Column, ph: Column, r: Column) -> list[Column]:
    return [r * F.sin(ph) * F.sin(th), r * F.cos(ph), r * F.cos(th) * F.sin(ph)]


def to_spherical_zbuffer(p: list[Column]) -> list[Column]:
    """pitch, yaw, z of a unit direction."""
    return [F.asin(p[1]), F.atan2(p[0], p[2]), p[2]]


def from_spherical_zbuffer(th: Column, ph: Column, z: Column) -> list[Column]:
    return [z * F.tan(th), z / F.tan(ph) / F.cos(th), z]


def depth_to_disparity(d: Column, keep: bool = False, floor: float | None = None) -> Column:
    """1 / d where positive, else 0 (or d itself); with `floor` clamp first."""
    if floor is not None:
        return 1.0 / F.greatest(d, F.lit(floor))
    return F.when(d > 0, 1.0 / d).otherwise(d if keep else F.lit(0.0))


# --- gravity and paths -----------------------------------------------------------------------------

def latitude(ray: list[Column], gravity: list[Column], eps: float = 1e-6) -> Column:
    """Angle of a unit ray above the horizon."""
    d = se3.dot(ray, gravity)
    return F.asin(F.least(F.greatest(d, F.lit(-1 + eps)), F.lit(1 - eps)))


def horizon_line(k: list[Column], roll: Column, pitch: Column, h: Column, w: Column) -> Column:
    """Height of the horizon at the left and right image border, relative to the image height."""
    # the horizon midpoint is the z axis turned by the pitch about x and the roll about z
    x, y, z = F.sin(roll) * F.sin(pitch), F.cos(roll) * F.sin(pitch), F.cos(pitch)
    mx, my = k[0] * x / z + k[2], k[1] * y / z + k[3]
    t = F.tan(roll)
    return F.struct(((my + mx * t) / h).alias("left"), ((my - (w - mx) * t) / h).alias("right"))


# fixed values: direction name -> (axis, sign)
DIRECTIONS = {"left": (0, -1), "right": (0, 1), "up": (1, -1), "down": (1, 1), "zoom_out": (2, -1), "zoom_in": (2, 1)}


def look_at(pos: list[Column], target: list[Column]) -> list[Column]:
    """Right, up and forward rows and the negated position, twelve entries row by row; y is up.

    With the unit forward (fx, fy, fz) and r = |(fx, fz)|: right = (fz, 0, -fx) / r, up = (-fx fy / r, r, -fy fz / r).
    """
    ahead = [t - p for t, p in zip(target, pos)]
    fx, fy, fz = se3.times(1.0 / se3.length(ahead), ahead)
    r = F.hypot(fx, fz)
    rows = [[fz / r, F.lit(0.0), 0.0 - fx / r], [0.0 - fx * fy / r, r, 0.0 - fy * fz / r], [fx, fy, fz]]  # no negative zeros
    return [c for row, p in zip(rows, pos) for c in (*row, -p)]


def path_offset(kind: Column, step: Column, n: int, distance: Column, depth: Column) -> list[Column]:
    """Camera offset at a step: six straight directions, and circles 'clockwise' / 'counterclockwise'."""
    out = []
    th = step * (2 * math.pi / (n - 1))
    for axis in range(3):
        e = F.lit(0.0)
        for name, (a, sign) in DIRECTIONS.items():
            if a == axis:
                e = F.when(kind == name, step * distance * depth / n * sign).otherwise(e)
        if axis == 0:
            turn = distance * (F.cos(th) - 1.0) * depth
            e = F.when(kind == "clockwise", turn).when(kind == "counterclockwise", -turn).otherwise(e)
        if axis == 1:
            e = F.when(kind.isin("clockwise", "counterclockwise"), distance * F.sin(th) * depth).otherwise(e)
        out.append(e)
    return out


def camera_path(df: DataFrame, kind: Column, n: int, distance: Column, depth: Column, aim: str) -> DataFrame:
    """n look-at matrices (m0..m11) per row; aim is center_facing, trajectory_aligned or no_rotation."""
    follow = {"center_facing": 0.0, "trajectory_aligned": 2.0, "no_rotation": 1.0}[aim]
    d = df.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    off = path_offset(kind, F.col("step"), n, distance, depth)
    d = d.withColumns({f"__o{i}": c for i, c in enumerate(off)}).withColumn("__depth", depth)
    pos = [F.col(f"__o{i}") for i in range(3)]
    target = [pos[0] * follow, pos[1] * follow, F.col("__depth") + pos[2] * follow]
    m = look_at(pos, target)
    return d.select(*df.columns, "step", *[c.alias(f"m{i}") for i, c in enumerate(m)])


# --- generated grids -------------------------------------------------------------------------------

def linspace(i: Column, lo: Column, hi: Column, n: Column) -> Column:
    return F.when(n > 1, lo + i * (hi - lo) / (n - 1)).otherwise(lo)


def crop_boxes(df: DataFrame, h: str, w: str, layers: int, overlap_ratio: float) -> DataFrame:
    """Overlapping crops of each image: layer i has (2^i)^2 of them, layer 0 is the image."""
    hh, ww = F.col(h).cast("long"), F.col(w).cast("long")
    d = df.withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(layers)))) \
        .withColumn("__n", F.pow(F.lit(2.0), F.col("layer")).cast("long"))
    n = F.col("__n")
    # overlap relative to the short side; the whole image needs none
    ov = F.when(F.col("layer") == 0, F.lit(0)).otherwise(F.floor(F.lit(overlap_ratio) * F.least(hh, ww) * (F.lit(2.0) / n)))
    d = d.withColumn("__ov", ov)
    o = F.col("__ov")
    d = d.withColumn("__cw", F.ceil((o * (n - 1) + ww) / n)).withColumn("__ch", F.ceil((o * (n - 1) + hh) / n))
    d = d.withColumn("ix", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))) \
        .withColumn("iy", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    x0, y0 = (F.col("__cw") - o) * F.col("ix"), (F.col("__ch") - o) * F.col("iy")
    return d.select(*df.columns, "layer", x0.alias("x0"), y0.alias("y0"),
                    F.least(x0 + F.col("__cw"), ww).alias("x1"), F.least(y0 + F.col("__ch"), hh).alias("y1"))


def point_grid(df: DataFrame, n: Column, layers: int = 0, downscale: int = 1) -> DataFrame:
    """Evenly spaced points in the unit square, fewer per layer."""
    d = df.withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(layers)))) \
        .withColumn("__n", F.floor(n / F.pow(F.lit(float(downscale)), F.col("layer")))) \
        .filter(F.col("__n") > 0)
    d = d.withColumn("ix", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1))) \
        .withColumn("iy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    return d.select(*df.columns, "layer", ((F.col("ix") + 0.5) / F.col("__n")).alias("x"),
                    ((F.col("iy") + 0.5) / F.col("__n")).alias("y"))


def aabb_grid(df: DataFrame, mins: list[Column], maxs: list[Column], spacing: float) -> DataFrame:
    """Points filling a box at a spacing: int(extent / spacing) steps per axis, both ends included."""
    d = df
    for a, (lo, hi) in enumerate(zip(mins, maxs)):
        d = d.withColumn(f"__n{a}", F.floor((hi - lo) / spacing)).filter(F.col(f"__n{a}") > 0) \
            .withColumn(f"__i{a}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"__n{a}") - 1)))
    pts = [linspace(F.col(f"__i{a}"), lo, hi, F.col(f"__n{a}")).alias(c)
           for a, (lo, hi, c) in enumerate(zip(mins, maxs, ("x", "y", "z")))]
    return d.select(*df.columns, *pts)
