"""Array expressions on vectors and flattened frames; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate `value` once and pass it to `body`; a lambda would evaluate it again per element."""
    return F.transform(F.array(value), body)[0]


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l2_normalise(a: Column) -> Column:
    return let(norm(a), lambda n: F.transform(a, lambda x: F.try_divide(x.cast("double"), n)))


def mean_squared_diff(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return total(F.transform(d, lambda x: x * x)) / F.size(a)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x.cast("double")))


def inverse_sigmoid(x: Column, eps: float = 1e-3) -> Column:
    """log(x / (1 - x)) with both parts clamped from below."""
    c = F.least(F.greatest(x.cast("double"), F.lit(0.0)), F.lit(1.0))
    return F.log(F.greatest(c, F.lit(eps)) / F.greatest(F.lit(1.0) - c, F.lit(eps)))


def softmax(a: Column) -> Column:
    def scaled(e):
        return let(total(e), lambda z: F.transform(e, lambda x: x / z))
    return let(_exp_shifted(a), scaled)


def _exp_shifted(a: Column) -> Column:
    """exp(x - max)."""
    return let(F.array_max(a).cast("double"), lambda m: F.transform(a, lambda x: F.exp(x.cast("double") - m)))


def vector_stats(a: Column) -> Column:
    """max, min, mean, sample variance, standard deviation and softmax entropy as a struct."""
    n = F.size(a)
    entropy = let(softmax(a), lambda p: F.aggregate(p, F.lit(0.0), lambda s, x: s - x * F.log(x + 1e-9)))

    def spread(mean):
        var = F.when(n > 1, F.aggregate(a, F.lit(0.0), lambda s, x: s + (x.cast("double") - mean) * (x.cast("double") - mean)) / (n - 1))
        return F.struct(F.array_max(a).cast("double").alias("max"), F.array_min(a).cast("double").alias("min"),
                        mean.alias("mean"), var.alias("var"), F.sqrt(var).alias("sd"), entropy.alias("entropy"))

    return let(total(a) / n, spread)


def contrast_drift(a: Column, strength: Column) -> Column:
    """x * (1 - 0.1 s) + 128 * 0.1 s, clipped to 0..255."""
    return let(strength * 0.1, lambda k: F.transform(a, lambda x: F.least(
        F.greatest(x.cast("double") * (1 - k) + 128.0 * k, F.lit(0.0)), F.lit(255.0))))


def u8_to_unit(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") / 255.0)


def unit_to_u8(a: Column) -> Column:
    """0..1 floats to 0..255 integers, clipped, truncated."""
    return F.transform(a, lambda x: F.floor(F.least(F.greatest(x.cast("double"), F.lit(0.0)), F.lit(1.0)) * 255.0).cast("int"))


def to_signed_unit(a: Column) -> Column:
    """0..1 to -1..1."""
    return F.transform(a, lambda x: (x.cast("double") - 0.5) / 0.5)


def channel_renorm(a: Column, mean: list[float], std: list[float]) -> Column:
    """x * std + mean with the channel as the fastest axis."""
    c = len(mean)
    ms, ss = F.array(*[F.lit(float(m)) for m in mean]), F.array(*[F.lit(float(s)) for s in std])
    return F.transform(a, lambda x, i: x.cast("double") * ss[i % c] + ms[i % c])


def crop(a: Column, w: Column, top: int, left: int, height: int, width: int) -> Column:
    """Window of a row-major frame of width `w`."""
    idx = F.sequence(F.lit(0), F.lit(height * width - 1))
    return F.transform(idx, lambda k: F.get(a, (F.floor(k / width) + top).cast("int") * w + k % width + left))
