"""Indexed reductions and sparse block algebra on coordinate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scatter_reduce(df: DataFrame, index: str, value: str, pos: str | None = None, integer: bool = False) -> DataFrame:
    """Sum, product, mean, minimum and maximum (with position) per index, dense from 0 to the largest index;
    slots without values hold 0, and 1 as product."""
    x = F.col(value)
    n = F.greatest(F.count(value), F.lit(1))
    mean = F.floor(F.sum(x) / n) if integer else F.sum(x) / n
    at = F.col(pos) if pos else F.lit(None).cast("long")
    g = df.groupBy(index).agg(
        F.sum(x).alias("sum"), F.product(x).alias("mul"), mean.alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.min_by(at, F.struct(x, at)).alias("argmin"), F.max_by(at, F.struct(x, -at)).alias("argmax"), F.count("*").alias("n"))
    top = df.agg(F.max(index)).first()[0]
    slots = df.sparkSession.range(0 if top is None else top + 1).withColumnRenamed("id", index)
    d = slots.join(g.withColumn(index, F.col(index).cast("long")), index, "left")
    return d.select(index, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("sum", "mean", "min", "max")],
                    F.coalesce("mul", F.lit(1.0)).alias("mul"), "argmin", "argmax", F.coalesce("n", F.lit(0)).alias("n"))


def coalesce_entries(a: DataFrame, on: list[str] = ("i", "j"), value: str = "a") -> DataFrame:
    """Sum duplicate entries."""
    return a.groupBy(*on).agg(F.sum(value).alias(value))


def add_entries(a: DataFrame, b: DataFrame, on: list[str] = ("i", "j"), value: str = "a", sign: float = 1.0) -> DataFrame:
    """a + sign * b."""
    on = list(on)
    return coalesce_entries(a.select(*on, value).unionByName(b.select(*on, (F.col(value) * sign).alias(value))), on, value)


def damp(a: DataFrame, ep: float, lam: float, value: str = "a") -> DataFrame:
    """Add ep + lam * a on the diagonal of a coalesced matrix."""
    x = F.col(value)
    return a.withColumn(value, F.when(F.col("i") == F.col("j"), x + ep + lam * x).otherwise(x))


def paired_columns(a: DataFrame, b: DataFrame, value: str = "a", block: int = 512) -> DataFrame:
    """Pairs (i, j1, j2, x, y) of the entries of a and b that share a row. A row is a grid of column blocks: of about `block` columns of a by as many of b, each
    cell of the grid with a key of its own, so a row of m columns is the work of (m / block) ** 2 tasks."""
    x = coalesce_entries(a, value=value).select("i", F.col("j").alias("j1"), F.col(value).alias("x"))
    y = coalesce_entries(b, value=value).select("i", F.col("j").alias("j2"), F.col(value).alias("y"))
    parts = lambda d, n: d.groupBy("i").agg(F.ceil(F.count("*") / block).cast("int").alias(n))
    grid = parts(x, "nx").join(parts(y, "ny"), "i")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = x.join(grid, "i").select("i", "j1", "x", F.pmod(F.xxhash64("j1"), F.col("nx")).cast("int").alias("bx"), others("ny").alias("by"))
    y = y.join(grid, "i").select("i", "j2", "y", others("nx").alias("bx"), F.pmod(F.xxhash64("j2"), F.col("ny")).cast("int").alias("by"))
    return x.join(y, ["i", "bx", "by"])


def transposed_product(a: DataFrame, b: DataFrame, upper: bool = False, value: str = "a", block: int = 512) -> DataFrame:
    """A^T B of coordinate tables (i, j, a). Duplicates are summed first, so a crowded row forms only the
    pairs of its distinct columns, spread over `paired_columns`' grid."""
    j = paired_columns(a, b, value, block)
    if upper:
        j = j.filter("j1 <= j2")
    return j.groupBy(F.col("j1").alias("i"), F.col("j2").alias("j")).agg(F.sum(F.col("x") * F.col("y")).alias(value))


def transposed_vector(a: DataFrame, v: DataFrame, value: str = "a") -> DataFrame:
    """A^T v with v given as (i, x)."""
    return coalesce_entries(a, value=value).join(v.groupBy("i").agg(F.sum("x").alias("x")), "i").groupBy("j").agg(
        F.sum(F.col(value) * F.col("x")).alias("x"))


def huber(r: Column) -> Column:
    """Weight 1 inside the unit residual, 1 / |r| outside."""
    return F.when(r * r <= 1, 1.0).otherwise(1.0 / F.abs(r))


def normal_equations(jac: DataFrame, res: DataFrame, kernel=huber, fixed: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """J^T W J (upper triangle), -J^T W r and the energy from Jacobian entries (i, j, a) and residuals (i, r, w)."""
    r = res.withColumn("w", F.col("w") * kernel(F.col("r"))) if kernel is not None else res
    energy = r.agg(F.sum(F.col("w") * F.col("r") * F.col("r")).alias("energy"))
    j = coalesce_entries(jac)
    if fixed is not None:
        j = j.join(fixed.select("j"), "j", "left_anti")
    w = j.join(r.select("i", "w", "r"), "i")
    lhs = transposed_product(j, w.select("i", "j", (F.col("a") * F.col("w")).alias("a")), upper=True)
    rhs = w.groupBy("j").agg(F.sum(-F.col("a") * F.col("w") * F.col("r")).alias("x"))
    return lhs, rhs, energy


def sum_terms(terms: list, fixed: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Normal equations of several residual terms, each (jacobian, residuals, kernel)."""
    parts = [normal_equations(j, r, k, fixed) for j, r, k in terms]
    lhs, rhs, energy = parts[0]
    for a, b, e in parts[1:]:
        lhs, rhs, energy = lhs.unionByName(a), rhs.unionByName(b), energy.unionByName(e)
    return coalesce_entries(lhs), rhs.groupBy("j").agg(F.sum("x").alias("x")), energy.agg(F.sum("energy").alias("energy"))
