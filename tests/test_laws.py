"""Tail probabilities against independent sums and published values."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from heldout.functions import laws as L
from heldout.operators.reports import wilcoxon_signed_rank


def density_share(x, a, b):
    """Incomplete beta by quadrature after t = sin^2."""
    u = (np.arange(400_000) + 0.5) / 400_000 * math.asin(math.sqrt(x))
    body = 2 * np.sin(u) ** (2 * a - 1) * np.cos(u) ** (2 * b - 1)
    return body.mean() * math.asin(math.sqrt(x)) * math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))


def test_log_gamma_and_beta(spark):
    xs = [0.5, 1.0, 1.5, 2.0, 7.25, 100.0, 12345.5]
    got = [r["g"] for r in spark.createDataFrame([(x,) for x in xs], "x double").withColumn("g", L.log_gamma(F.col("x"))).collect()]
    assert np.allclose(got, [math.lgamma(x) for x in xs], rtol=1e-12, atol=1e-12)
    cases = [(x, a, b) for x in (0.001, 0.2, 0.5, 0.9, 0.999) for a, b in ((0.5, 0.5), (1.0, 3.0), (11.5, 0.5), (40.0, 25.5), (3000.0, 0.5))]
    df = spark.createDataFrame([*cases, (0.0, 1.0, 1.0), (1.0, 1.0, 1.0), (None, 1.0, 1.0)], "x double, a double, b double")
    rows = df.withColumn("v", L.beta_share(F.col("x"), F.col("a"), F.col("b"))).collect()
    assert [r["v"] for r in rows[-3:]] == [0.0, 1.0, None]
    for r in rows[:-3]:
        assert r["v"] == pytest.approx(density_share(r["x"], r["a"], r["b"]), rel=1e-6, abs=1e-12), r


def test_correlation_p(spark):
    cases = [(0.0, 10), (0.75, 25), (-0.75, 25), (0.5, 3), (0.02, 15_000), (1.0, 9), (0.3, 2), (None, 9), (0.008, 39_000), (0.008, 41_000)]
    got = [r["p"] for r in spark.createDataFrame(cases, "r double, n long").withColumn("p", L.correlation_p(F.col("r"), F.col("n"))).collect()]
    for (r, n), p in zip(cases, got):
        if r is None or n < 3:
            assert p is None
        elif abs(r) == 1:
            assert p == 0.0
        else:
            assert p == pytest.approx(density_share(1 - r * r, (n - 2) / 2, 0.5), rel=1e-5)
    # Published 5% points: t with 10 degrees of freedom 2.228, F with (3, 20) 3.098.
    t = 2.2281388519649385
    row = spark.range(1).select(L.correlation_p(F.lit(t / math.sqrt(10 + t * t)), F.lit(12)).alias("t"), L.f_tail(F.lit(3.0983912), F.lit(3.0), F.lit(20.0)).alias("f")).first()
    assert (row["t"], row["f"]) == (pytest.approx(0.05, abs=1e-9), pytest.approx(0.05, abs=1e-6))


@pytest.mark.parametrize("n", [1, 5, 9])
def test_signed_rank_law(spark, n):
    sums = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product((0, 1), repeat=n)]
    df = spark.createDataFrame([(float(w), n) for w in range(n * (n + 1) // 2 + 1)], "w double, n long").withColumn("p", L.signed_rank_p(F.col("w"), F.col("n")))
    for r in df.collect():
        low = min(r["w"], n * (n + 1) / 2 - r["w"])
        assert r["p"] == pytest.approx(min(1.0, 2 * sum(s <= low for s in sums) / 2**n))


def test_signed_rank_test_is_exact_where_it_can_be(spark):
    plain = spark.createDataFrame([(d,) for d in (1.5, -0.5, 2.5, 3.5, 4.5, -0.25)], "d double")
    r = wilcoxon_signed_rank(plain, "d").first()
    assert (r["w_plus"], r["p_value"]) == (18.0, pytest.approx(2 * 5 / 64))
    for more in ([(0.0,)], [(-1.5,)]):
        r = wilcoxon_signed_rank(plain.union(spark.createDataFrame(more, "d double")), "d").first()
        assert r["p_value"] == r["p_normal"]
    many = wilcoxon_signed_rank(spark.range(60).select((F.col("id") - 20.5).alias("d")).withColumn("d", F.col("d") * (1 + F.col("d") / 1000)), "d").first()
    assert many["p_value"] == many["p_normal"]
