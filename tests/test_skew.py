"""The sliced path for hot groups gives what the plain window gives, on a table where one group has most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from heldout.operators import metrics
from heldout.operators.ranking import neighbours
from heldout.operators.resampling import permute
from heldout.plans import skew


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    n = 400
    grp = np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abc"), n))
    value = np.where(rng.random(n) < 0.35, 0.0, np.round(rng.normal(size=n), 1))
    pdf = pd.DataFrame({"id": np.arange(n), "grp": grp, "v": value})
    return pdf, spark.createDataFrame(pdf)


def _sorted(df, by="id"):
    return df.toPandas().sort_values(by).reset_index(drop=True)


def test_midrank_hot(hot, skewed):
    pdf, df = skewed
    got = _sorted(skew.midrank(df, ["grp"], "v", "r"))
    assert np.allclose(got["r"], pdf.groupby("grp")["v"].rank())
    got = _sorted(skew.midrank(df, [], "v", "r"))
    assert np.allclose(got["r"], pdf["v"].rank())


def test_min_rank_hot(hot, skewed):
    pdf, df = skewed
    got = _sorted(skew.min_rank(df, ["grp"], "v", "r", descending=True))
    assert (got["r"] == pdf.groupby("grp")["v"].rank(method="min", ascending=False)).all()


def test_number_rows_hot(hot, skewed):
    pdf, df = skewed
    got = _sorted(skew.number_rows(df, ["grp"], ["v", "id"], "rn"))
    want = pdf.sort_values(["v", "id"]).groupby("grp").cumcount().sort_index() + 1
    assert (got["rn"] == want).all()


def test_quantiles_hot(hot, skewed):
    pdf, df = skewed
    got = _sorted(skew.quantiles(df, ["grp"], "v", {"a": 0.1, "b": 0.5, "c": 0.95}), "grp")
    want = pdf.groupby("grp")["v"].quantile([0.1, 0.5, 0.95]).unstack()
    assert np.allclose(got[["a", "b", "c"]], want)


def test_neighbours_hot(hot, skewed):
    pdf, df = skewed
    got = _sorted(neighbours(df, ["grp"], ["v", "id"], ["id"]))
    want = pdf.sort_values(["v", "id"]).groupby("grp")["id"].shift().sort_index()
    assert got["prev_id"].fillna(-1).tolist() == want.fillna(-1).tolist()


def test_order_statistic(spark, hot):
    df = spark.createDataFrame([(float(i),) for i in range(1, 41)], "x double")
    row = skew.order_statistic(df, [], "x", 0.95, "q").first()
    assert (row["n"], row["k"], row["q"], row["status"]) == (40, 39, 39.0, "finite")
    few = skew.order_statistic(df.limit(10), [], "x", 0.95, "q").first()
    assert few["q"] is None and few["status"] == "infinite"


def test_attach_beyond_broadcast_limit(spark, skewed):
    pdf, df = skewed
    spark.conf.set("spark.heldout.broadcastRows", "1")
    try:
        got = _sorted(skew.group_attach(df, ["grp"], [F.avg("v").alias("m")]))
    finally:
        spark.conf.unset("spark.heldout.broadcastRows")
    assert np.allclose(got["m"], pdf.groupby("grp")["v"].transform("mean"))


def test_null_values_keep_null_rank(spark, hot):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else float(i)) for i in range(60)], "id int, v double")
    got = _sorted(skew.midrank(df, [], "v", "r"))
    assert got["r"].isna().sum() == 20 and got["r"].max() == 40


@pytest.fixture(scope="module")
def awkward(spark):
    """A NULL group with most rows, a group without a known value, ties, signed zeros and NaN."""
    rng = np.random.default_rng(4)
    rows = [(k, None if k % 2 else "abcd"[k % 4], float(rng.integers(-3, 4)) * 0.5 + (0.1 if k % 5 else -0.0)) for k in range(200)]
    rows += [(200 + k, g, v) for k, (g, v) in enumerate([(None, None), ("u", None), ("u", None), (None, -0.0), (None, 0.0), ("a", float("nan")), (None, float("nan"))])]
    return spark.createDataFrame(rows, "id long, grp string, v double")


def _both_ways(spark, make):
    """The rows of an operator below and above the limit of hot groups."""
    out = []
    for limit in ("1000000", "20"):
        spark.conf.set(skew.HOT_ROWS, limit)
        try:
            rows = make().collect()
        finally:
            spark.conf.unset(skew.HOT_ROWS)
        cols = sorted(rows[0].asDict())
        out.append(sorted(str(tuple(0.0 if r[c] == 0 else r[c] for c in cols)) for r in rows))
    return out


@pytest.mark.parametrize(
    "make",
    [
        lambda df: skew.midrank(df, ["grp"], "v", "r"),
        lambda df: skew.min_rank(df, ["grp"], "v", "r", descending=True),
        lambda df: skew.number_rows(df, ["grp"], ["v", "id"]),
        lambda df: skew.quantiles(df, ["grp"], "v", {"a": 0.1, "b": 0.5, "c": 0.95}),
        lambda df: skew.cumulate(df.na.fill(0.0).replace(float("nan"), 1.0), ["grp"], ["v", "id"], ["id"]),
        lambda df: skew.order_statistic(df, ["grp"], "v", 0.9, "q"),
        lambda df: neighbours(df, ["grp"], ["v", "id"], ["id"]),
        lambda df: permute(df, ["grp"], "v", "p", 3),
        lambda df: skew.group_attach(df, ["grp"], [F.count("v").alias("n")]),
    ],
)
def test_one_result_at_every_size(spark, awkward, make):
    below, above = _both_ways(spark, lambda: make(awkward))
    assert below == above


def test_the_null_group_is_a_group(spark, awkward):
    n = awkward.filter("grp IS NULL").count()
    assert skew.group_attach(awkward, ["grp"], [F.count(F.lit(1)).alias("n")]).filter(f"grp IS NULL AND n = {n}").count() == n
    assert skew.midrank(awkward, ["grp"], "v", "r").filter("grp IS NULL AND v IS NOT NULL AND r IS NULL").count() == 0
    both = metrics.null_panel(awkward.select("id", "grp", F.col("v").alias("actual"), (F.col("v") * 2).alias("pred")).filter("NOT isnan(v)"))
    assert both.count() == 1
