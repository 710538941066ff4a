"""Keyframe lookups, pose interpolation and trajectory alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelframe.functions import se3
from reelframe.operators.ordered import BLOCK, rank0, running, shifted


def lookup_strict(wanted: DataFrame, df: DataFrame, on: list[str], col: str) -> DataFrame:
    """Exact lookup; a missing row is an error."""
    j = wanted.join(df, on, "left")
    return j.withColumn(col, F.when(F.col(col).isNull(), F.raise_error(F.lit(f"{col} missing for a requested frame")))
                        .otherwise(F.col(col)))


def assign_by_frame(frames: DataFrame, attrs: DataFrame, on: list[str]) -> DataFrame:
    """Attach attributes given per frame."""
    return frames.join(attrs, on, "left")


def assign_by_clip(frames: DataFrame, attrs: DataFrame, key: str) -> DataFrame:
    """Spread one value per clip over its frames."""
    return frames.join(attrs, key, "left")


def asof(left: DataFrame, right: DataFrame, keys: list[str], t: str, cols: list[str], out: str,
         width: int = BLOCK) -> DataFrame:
    """Latest row of `right` at or before t, as a struct column of `cols`; times are unique per side.

    Both sides go through one ordered pass in blocks of the time column.
    """
    rest = [c for c in left.columns if c not in [*keys, t]]
    a = left.select(*keys, t, F.lit(1).alias("__side"), F.struct(*rest).alias("__left") if rest else
                    F.lit(None).alias("__left"))
    b = right.select(*keys, t, F.lit(0).alias("__side"), F.struct(*cols).alias("__right"))
    u = a.unionByName(b, allowMissingColumns=True)
    r = running(u, keys, [t, "__side"], {out: ("last", F.col("__right"))}, width=width)
    d = r.filter("__side = 1")
    return d.select(*keys, t, *[F.col(f"__left.{c}").alias(c) for c in rest], out)


def asof_keyframe(frames: DataFrame, kfs: DataFrame, keys: list[str], t: str, cols: list[str]) -> DataFrame:
    """For each frame the latest keyframe k0 at or before it, and the one after that, k1 (k0 at the end)."""
    nxt = shifted(kfs, keys, t, {"__next": F.struct(t, *cols)}, ahead=True)
    here = F.struct(t, *cols)
    pairs = nxt.select(*keys, t, here.alias("k0"), F.coalesce("__next", here).alias("k1"))
    d = asof(frames, pairs, keys, t, ["k0", "k1"], "__k")
    return d.select(*[c for c in d.columns if c != "__k"], "__k.k0", "__k.k1")


def keyframe_neighborhood(frames: DataFrame, kfs: DataFrame, keys: list[str], t: str, nn: int = 3) -> DataFrame:
    """Keyframes from r - 2nn to r around each frame, r = min(first keyframe at or after it + nn, last)."""
    k = rank0(kfs.select(*keys, t), keys, t, "kf")
    n = k.groupBy(*keys).agg(F.max("kf").alias("__last"))
    before = asof(frames, k.withColumn("kt", F.col(t)), keys, t, ["kf", "kt"], "__p")
    pos = F.when(F.col("__p").isNull(), F.lit(0)).when(F.col("__p.kt") == F.col(t), F.col("__p.kf")) \
        .otherwise(F.col("__p.kf") + 1)
    d = before.withColumn("__pos", pos).drop("__p").join(n, keys)
    r = F.least(F.col("__pos") + nn, F.col("__last"))
    d = d.withColumn("kf", F.explode(F.sequence(F.greatest(r - 2 * nn, F.lit(0)), r))).drop("__pos", "__last")
    return d.join(k.withColumnRenamed(t, "kf_" + t), [*keys, "kf"])


def keyframe_velocity(kfs: DataFrame, keys: list[str], t: str) -> DataFrame:
    """log(T1 T0^-1) / (t1 - t0 + 1e-3) from each keyframe to the next; zero at the last one."""
    d = shifted(kfs, keys, t, {"__n": F.struct(t, *se3.POSE)}, ahead=True)
    p0 = se3.pose()
    p1 = [F.coalesce(F.col("__n." + c), F.col(c)) for c in se3.POSE]
    dt = F.coalesce(F.col(f"__n.{t}"), F.col(t)) - F.col(t) + 1e-3
    d = d.select(*keys, t, *se3.POSE, *[c.alias(f"__d{i}") for i, c in enumerate(se3.compose(p1, se3.inverse(p0)))],
                 dt.alias("__dt"))
    d = se3.with_log(d, [F.col(f"__d{i}") for i in range(7)], [f"__l{i}" for i in range(6)])
    return d.select(*keys, t, *se3.POSE, *[(F.col(f"__l{i}") / F.col("__dt")).alias(f"v{i}") for i in range(6)])


def pose_interpolate(frames: DataFrame, kfs: DataFrame, keys: list[str], t: str) -> DataFrame:
    """Pose at each time by constant velocity from the latest keyframe: exp(v (t - t0)) T0."""
    vel = keyframe_velocity(kfs, keys, t).withColumn("t0", F.col(t))
    cols = ["t0", *se3.POSE, *[f"v{i}" for i in range(6)]]
    d = asof(frames.select(*keys, t), vel, keys, t, cols, "k").filter(F.col("k").isNotNull())
    dt = F.col(t) - F.col("k.t0")
    d = se3.with_exp(d, [F.col(f"k.v{i}") * dt for i in range(6)], [f"__s{i}" for i in range(7)])
    return d.select(*keys, t, *se3.named(se3.compose([F.col(f"__s{i}") for i in range(7)], se3.pose("k."))))


# --- alignment ------------------------------------------------------------------------------------

_ALIGN = T.StructType([T.StructField(f"r{i}", T.DoubleType()) for i in range(9)]
                      + [T.StructField(c, T.DoubleType()) for c in ("t0", "t1", "t2", "scale")])


def _solver(scale: bool):
    @F.pandas_udf(_ALIGN)
    def solve(n, sums, cross, sq):
        import numpy as np
        import pandas as pd

        n = n.to_numpy(float)[:, None]
        s = np.stack(sums.to_numpy()) / n
        m1, m2 = s[:, :3], s[:, 3:]
        k = np.stack(cross.to_numpy()).reshape(-1, 3, 3) - n[:, :, None] * m1[:, :, None] * m2[:, None, :]
        var = sq.to_numpy(float) - n[:, 0] * (m1 ** 2).sum(1)
        u, _, vt = np.linalg.svd(k)
        z = np.tile(np.eye(3), (len(k), 1, 1))
        z[:, 2, 2] = np.sign(np.linalg.det(u @ vt))
        r = vt.transpose(0, 2, 1) @ z @ u.transpose(0, 2, 1)
        c = np.einsum("nij,nji->n", r, k) / var if scale else np.ones(len(k))
        t = m2 - c[:, None] * np.einsum("nij,nj->ni", r, m1)
        out = np.concatenate([r.reshape(-1, 9), t, c[:, None]], 1)
        return pd.DataFrame(out, columns=[f.name for f in _ALIGN.fields])

    return solve


def align_points(df: DataFrame, keys: list[str], a: list[str], b: list[str], scale: bool = True) -> DataFrame:
    """Similarity taking points a to points b, one row per group (r0..r8, t0..t2, scale). Seventeen sums
    per group reach the 3x3 decomposition."""
    sums = F.array(*[F.sum(c) for c in [*a, *b]])
    cross = F.array(*[F.sum(F.col(x) * F.col(y)) for x in a for y in b])
    sq = F.sum(sum((F.col(x) * F.col(x) for x in a[1:]), F.col(a[0]) * F.col(a[0])))
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), sums.alias("s"), cross.alias("c"), sq.alias("q"))
    return g.select(*keys, "n", _solver(scale)("n", "s", "c", "q").alias("m")).select(*keys, "n", "m.*")


def trajectory_error(df: DataFrame, keys: list[str], est: list[str], ref: list[str], scale: bool = True) -> DataFrame:
    """Mean, rms and largest residual per group after aligning the estimated positions."""
    m = align_points(df, keys, est, ref, scale)
    j = df.join(m, keys)
    x = [F.col(c) for c in est]
    res = []
    for i, c in enumerate(ref):
        row = sum((F.col(f"r{3 * i + k}") * x[k] for k in (1, 2)), F.col(f"r{3 * i}") * x[0])
        res.append(F.col("scale") * row + F.col(f"t{i}") - F.col(c))
    e2 = res[0] * res[0] + res[1] * res[1] + res[2] * res[2]
    return j.groupBy(*keys).agg(F.avg(F.sqrt(e2)).alias("mean"), F.sqrt(F.avg(e2)).alias("rmse"),
                                F.max(F.sqrt(e2)).alias("max"))


_QUAT = T.StructType([T.StructField(c, T.DoubleType()) for c in ("qx", "qy", "qz", "qw")])


@F.pandas_udf(_QUAT)
def _top_quaternion(m):
    import numpy as np
    import pandas as pd

    a = np.stack(m.to_numpy()).reshape(-1, 4, 4)
    q = np.linalg.eigh(a)[1][:, :, -1]
    q = q * np.where(q[:, 3:] < 0, -1.0, 1.0)
    return pd.DataFrame(q, columns=["qx", "qy", "qz", "qw"])


def pose_mean(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean translation and chordal mean rotation per group (sign with qw >= 0)."""
    q = ["qx", "qy", "qz", "qw"]
    outer = F.array(*[F.avg(F.col(a) * F.col(b)) for a in q for b in q])
    g = df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ("tx", "ty", "tz")], outer.alias("m"))
    return g.select(*keys, "tx", "ty", "tz", _top_quaternion("m").alias("q")).select(*keys, "tx", "ty", "tz", "q.*")
