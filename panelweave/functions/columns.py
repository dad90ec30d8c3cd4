"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def sigmoid(x: Column, bound: float = 50.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-bound), F.least(F.lit(bound), x))))


def softmax(x: Column, temperature: float, *keys: str) -> Column:
    """Share of exp(x/T) within the keys, shifted by the largest x/T."""
    w = Window.partitionBy(*keys)
    e = F.exp(x / temperature - F.max(x / temperature).over(w))
    return e / F.sum(e).over(w)


def log10_normal_tail(z: Column) -> Column:
    """log10 of the two-sided normal p-value of z.

    Beyond |z| = 3 the Mills ratio as a continued fraction, log-density kept
    apart so that nothing underflows; below, the all-positive power series of
    the distribution function.
    """
    a = F.abs(z)
    ratio = a
    for k in range(60, 0, -1):
        ratio = a + k / ratio
    far = F.log(2 / ratio) - a * a / 2 - F.log(F.sqrt(F.lit(2 * 3.141592653589793)))
    state = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.struct(a.alias("term"), a.alias("total")),
        lambda s, k: F.struct((s["term"] * a * a / (2 * k + 1)).alias("term"),
                              (s["total"] + s["term"] * a * a / (2 * k + 1)).alias("total")),
        lambda s: s["total"])
    density = F.exp(-a * a / 2) / F.sqrt(F.lit(2 * 3.141592653589793))
    near = F.log(1 - 2 * density * state)
    return F.when(a > 3, far).otherwise(near) / F.log(F.lit(10.0))


def mixed_integer(k: Column, seed: int) -> Column:
    """A well-mixed 31-bit integer of k by congruential steps, the middle one quadratic.

    Plain integer arithmetic below 2^62, so that SQL engines agree on it."""
    m = 2147483647
    u = (k * 48271 + seed) % m
    u = (u * u + u) % m
    return (u * 69621 + 12345) % m
