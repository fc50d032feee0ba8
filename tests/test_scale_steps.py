"""Steps that must not grow beyond their input: what they shuffle, repeat and hold."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from heldout.functions.scalars import mixed_array, mixed_runs
from heldout.operators import fold_fits as FF
from heldout.operators import metrics as M
from heldout.operators import resampling as R
from heldout.plans import skew


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_runs_of_hashes_equal_single_ones():
    starts = np.array([0, 5, 2147483646, 2147483647, 1 << 31])
    for n in (1, 2, 1000, 70_000):
        assert (mixed_runs(starts, n) == mixed_array(starts[:, None] + np.arange(n))).all()


def test_pair_statistic_takes_a_replicate_at_a_time_of_a_large_stratum():
    n = R.CELLS // 2 + 1
    assert [len(some) for _, some, _ in R._blocks(n, range(1, 4), np.full((3, 1), n))] == [1, 1, 1] and n * 8 < 1 << 21
    rng = np.random.default_rng(2)
    y, p = np.round(rng.normal(size=90), 1), np.round(rng.normal(size=90), 1)
    w = R.multiplicities(7, 0, 90, np.full(4, 90), range(1, 5))
    linear, ranked = R._pair_statistic({"y": y, "p": p})(w)
    for k in range(4):
        d = pd.DataFrame({"y": np.repeat(y, w[k]), "p": np.repeat(p, w[k])})
        assert np.isclose(linear[k], d.corr().iloc[0, 1]) and np.isclose(ranked[k], d.rank().corr().iloc[0, 1])


def test_large_classes_need_no_drawn_rows(spark, hot, monkeypatch):
    monkeypatch.setattr(R, "drawn", None)
    monkeypatch.setattr(R, "SLICE", 16)
    rng = np.random.default_rng(3)
    df = spark.createDataFrame(pd.DataFrame({"id": range(90), "pred": np.round(rng.normal(size=90), 1), "actual": rng.normal(size=90)}))
    got = R.bootstrap_auc_by_class(df, "pred", F.col("actual") > 0.2, 12, 3).first()
    spark.conf.set(skew.HOT_ROWS, "1000")
    assert np.allclose(list(got), list(R.bootstrap_auc_by_class(df, "pred", F.col("actual") > 0.2, 12, 3).first()))


def test_ranks_of_a_large_group_shuffle_rows_once_per_column(spark, hot):
    rng = np.random.default_rng(4)
    x = np.where(rng.random(200) < 0.4, 1.0, np.round(rng.normal(size=200), 1))
    rows = [(k, None if k % 11 == 0 else "g" if k % 9 else None, None if k % 17 == 0 else float(x[k]), float(rng.normal())) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, g string, x double, y double")
    ranked = skew.midranks(df, ["g"], {"rx": "x", "ry": "y"})
    assert plan(ranked).count("Exchange hashpartitioning") == 2
    got = ranked.toPandas().sort_values("id")
    want = got.assign(g=got.g.fillna("-")).groupby("g")[["x", "y"]].rank()
    assert np.allclose(got[["rx", "ry"]], want, equal_nan=True)


def test_run_summary_reads_its_input_once(spark):
    df = spark.range(60).select((F.col("id") % 3).cast("string").alias("grp"), (F.col("id") % 7).cast("double").alias("actual"), (F.col("id") % 5).cast("double").alias("pred"))
    out = M.run_summary(df, 3.0)
    assert "Range (" not in plan(out) and out.first()["macro_mae"] is not None


def test_pair_batches_are_summed_in_bounded_parts(spark):
    df = spark.range(5000).coalesce(1).select("id")

    def add(batch):
        assert batch.num_rows <= 1024
        return {0: np.array([batch.num_rows, 0.0])}

    assert FF._sums(df, add)[0][0] == 5000


def test_slices_of_a_stratum_share_their_hashes(monkeypatch):
    made = []
    monkeypatch.setattr(R, "mixed_runs", lambda starts, n: made.append(len(starts) * n) or mixed_runs(starts, n))
    sizes = [4096] * 10 + [17]
    draws = R.slice_draws(9, sizes, range(1, 31))
    draws[3, 2], draws[4, 5], draws[5, 0] = 100, 9000, 4096  # far from as many draws as rows, and exactly as many
    strata = R._Strata(9, sizes, draws)
    got = [list(strata.slices(i, i + 1)) for i in range(30)]
    assert sum(made) < draws.sum() / 4
    for part, size in enumerate(sizes):
        assert (np.array([g[part] for g in got]) == R.multiplicities(9, part, size, draws[:, part], range(1, 31))).all()


def test_shared_counts_hold_more_than_a_byte(monkeypatch):
    monkeypatch.setattr(R, "mixed_runs", lambda starts, n: np.zeros((len(starts), n), np.uint32))  # all draws hit the first row
    strata = R._Strata(1, [400, 400], np.array([[395, 405]]))
    assert [x[0] for x in strata.slices(0, 1)] == [395, 405]


def test_sums_of_a_run_of_slices(spark, monkeypatch):
    monkeypatch.setattr(R, "SLICE", 8)
    monkeypatch.setattr(R, "TOGETHER", 3)
    monkeypatch.setattr(R, "AT_ONCE", 4)
    rows = [(k, None if k % 5 == 0 else "g", float(k)) for k in range(90)]
    df = spark.createDataFrame(rows, "id long, grp string, v double")
    got = R.resampled_sums(df, 10, ["grp"], {"s": F.col("v"), "n": F.lit(1.0)}, 3).toPandas()
    want = R.drawn(df, 10, ["grp"], ["v"], 3).groupBy("b", "grp").agg(F.sum(F.col("w") * F.col("v")).alias("s"), F.sum("w").alias("n")).toPandas()
    got, want = (x.fillna({"grp": "-"}).sort_values(["b", "grp"]).reset_index(drop=True) for x in (got, want))
    assert len(got) == 20 and np.allclose(got.s, want.s) and (got.n == want.n).all()


def test_pair_statistic_of_multiplicities_in_bytes():
    rng = np.random.default_rng(5)
    y, p = np.round(rng.normal(size=900), 1), rng.normal(size=900)
    w = R.multiplicities(7, 0, 900, np.full(3, 900), range(1, 4))
    w[2] = 0
    w[2, :2] = 899, 1  # nearly all one tie
    narrow, wide = (R._pair_statistic({"y": y, "p": p})(x) for x in (w[:2].astype(np.uint8), w))
    assert np.allclose(narrow[0], wide[0][:2]) and np.allclose(narrow[1], wide[1][:2]) and np.isclose(abs(wide[1][2]), 1)


def test_ranged_auc_shuffles_no_multiplicities(spark, hot, monkeypatch):
    monkeypatch.setattr(R, "SLICE", 16)
    rng = np.random.default_rng(6)
    df = spark.createDataFrame(pd.DataFrame({"id": range(90), "cls": (rng.random(90) < 0.3).astype("int32"), "_score": np.round(rng.normal(size=90), 1)}))
    df = df.withColumn("cls", F.col("cls").cast("int"))
    out = R._ranged_auc(df, 12, 3, skew.profile(df, ["cls"]))
    assert plan(out).count("FlatMapGroupsInArrow") == 1
    stats = R.resampled(df, 12, ["cls"], [], ["cls", "_score"], R._auc_statistic, "auc double", 3, like=skew.Profile(2, 20, 90))
    assert np.allclose([r["auc"] for r in out.orderBy("b").collect()], [r["auc"] for r in stats.orderBy("b").collect()])
