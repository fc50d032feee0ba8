"""Tail probabilities as column expressions: the t and F laws, and the exact law of the signed-rank statistic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from heldout.functions.scalars import pnorm_two_sided

#: Terms of the continued fraction. It settles within about twice the root of the larger parameter.
TERMS = 600
#: Degrees of freedom beyond which the t law is taken from the normal one (relative error below 1e-8 there).
MANY = 40_000
#: Largest number of pairs, and no ties, for which the signed-rank law is counted out.
COUNTED = 49


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0: Stirling's series at x + 8, carried back."""
    y = x + 8.0
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - 1 / (1680 * F.pow(y, F.lit(7.0))) + 1 / (1188 * F.pow(y, F.lit(9.0)))
    shift = F.ln(x)
    for k in range(1, 8):
        shift = shift + F.ln(x + float(k))
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def _fraction(x: Column, a: Column, b: Column) -> Column:
    """The incomplete beta integral left of its mean, by its continued fraction (evaluated forwards)."""

    def away(v: Column) -> Column:
        return F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)

    def step(state: Column, k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        t = F.when(k % 2 == 0, even).otherwise(odd)
        c, d = away(1 + t / state["c"]), 1 / away(1 + t * state["d"])
        return F.struct(c.alias("c"), d.alias("d"), (state["f"] * c * d).alias("f"))

    first = F.struct(F.lit(1.0).alias("c"), F.lit(0.0).alias("d"), F.lit(1.0).alias("f"))
    value = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), first, step, lambda s: s["f"])
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1 - x)) / a
    return front / value


def beta_share(x: Column, a: Column, b: Column) -> Column:
    """Regularised incomplete beta function for x in [0, 1]; NULL for NULL."""
    inside = F.when(x * (a + b + 2) < a + 1, _fraction(x, a, b)).otherwise(1 - _fraction(1 - x, b, a))
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).when(x.isNotNull(), inside)


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a Pearson correlation of n pairs by the t law with n - 2 degrees of freedom; NULL below 3 pairs."""
    df = (n - 2).cast("double")
    left = 1 - r * r
    t = F.abs(r) * F.sqrt(df / left)
    near = pnorm_two_sided(t * (1 - 1 / (4 * df)) / F.sqrt(1 + t * t / (2 * df)))
    exact = beta_share(left, F.least(df, F.lit(float(MANY))) / 2, F.lit(0.5))
    return F.when((n < 3) | r.isNull(), None).when(F.abs(r) >= 1, F.lit(0.0)).when(df > MANY, near).otherwise(exact)


def f_tail(f: Column, d1: Column, d2: Column) -> Column:
    """Upper tail of the F law."""
    return F.when(f <= 0, F.lit(1.0)).otherwise(beta_share(d2 / (d2 + d1 * f), d2 / 2, d1 / 2))


def signed_rank_p(w: Column, n: Column) -> Column:
    """Exact two-sided p of the signed-rank statistic W+ of n pairs without ties (n at most ``COUNTED``): shares of all sign patterns,
    added up rank by rank."""
    ranks = F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(COUNTED)), F.lit(1)).cast("int"))

    def grow(shares: Column, k: Column) -> Column:
        gap = F.array_repeat(F.lit(0.0), k)
        return F.zip_with(F.concat(shares, gap), F.concat(gap, shares), lambda a, b: (a + b) / 2)

    law = F.aggregate(ranks, F.array(F.lit(1.0)), grow)
    # The law is symmetric: the smaller tail, doubled.
    tail = F.least(w, n * (n + 1) / 2 - w).cast("int")
    return F.when((n >= 1) & (n <= COUNTED), F.least(F.lit(1.0), 2 * F.aggregate(F.slice(law, F.lit(1), tail + 1), F.lit(0.0), lambda s, v: s + v)))
