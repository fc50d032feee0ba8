"""Registered queries against their SQL on the smallest tables; the full comparison is ``check.py``."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = [
    "per_group_report", "threshold_table", "precedence_reason", "rank_meta_association", "eb_shrinkage_macro", "bootstrap_stratified_first20",
    "ssgsea_score", "stream_score", "predict_frozen", "interval_lookup", "title_key_join", "segment_features",
]


#: Queries that rank, number or take quantiles, run with every group treated as too large for a task.
HOT = ["within_group_metrics", "auc_rank", "threshold_table", "conformal_interval", "stratified_folds", "adjacent_segments", "midrank", "roc_points", "placement_percentile"]


def _norm(v):
    return float(f"{v:.7g}") + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, sf, con, name):
    _compare(spark, sf, con, name)


@pytest.mark.parametrize("name", HOT)
def test_query_matches_sql_with_hot_groups(spark, sf, con, hot, name):
    _compare(spark, sf, con, name)


def _compare(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(str(tuple(map(_norm, r))) for r in df.select(*cols).collect())
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert [names[i] for i in order] == cols
    assert got == sorted(str(tuple(_norm(r[i]) for i in order)) for r in cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 2


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = entry.queries()["metrics_panel"](spark, sf)._jdf.queryExecution().toString()
    assert "o_orderpriority" not in plan.split("Physical Plan")[-1]
    allow = entry.queries()["filter_allowlist"](spark, sf)._jdf.queryExecution().toString()
    assert "LessThan(p_size,5)" in allow


def test_full_counts_of_replicates(spark, sf):
    """As many replicates as in the source material: p-values below 1/21 can occur."""
    row = entry.queries()["permutation_test_mae_full"](spark, sf).first()
    assert row.n_perm == 1000 and row.p_value < 1 / 21
    assert entry.queries()["bootstrap_group_means_full"](spark, sf).first().n_ok == 10_000


def test_whole_tables(spark, sf, con):
    """All features, columns and groups, against the plain tables."""
    q = entry.queries()
    gram = {(r.grp, r.i, r.j): r.v for r in q["group_gram_full"](spark, sf).collect()}
    rows = con.execute("SELECT 'G' || label, embedding FROM embeddings").fetchall()
    groups = {g for g, _ in rows}
    assert set(gram) == {(g, i, j) for g in groups for i in range(64) for j in range(64)}
    for i, j in ((0, 63), (63, 63), (12, 40)):
        want = {g: sum((x[i] + 1) / 2 * (x[j] + 1) / 2 for h, x in rows if h == g) for g in groups}
        assert all(gram[g, i, j] == pytest.approx(want[g], abs=1e-4) for g in groups)
    sizes = [n for (n,) in con.execute("SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey").fetchall()]
    assert q["conformal_interval_full"](spark, sf).first().n == sum(max(1, int(n * 0.2)) for n in sizes)
    # A cell of any of the 64 columns may be missing.
    status = {r.raw_id: r.status for r in q["scan_expression_matrix_full"](spark, sf).collect()}
    gone = lambda v, k: (v * 31 + k * 17) % 29 == 0 or (k == 7 and (v * 31 + k * 17) % 9 == 0)
    assert len(status) == len(rows)
    assert status == {r.raw_id: r.status for r in q["scan_expression_matrix"](spark, sf).collect()}
    assert all((s == "missing_or_nonfinite") == any(gone(int(f[2:]), k) for k in range(64)) for f, s in status.items())
    assert 0 < q["ood_rms_distance_full"](spark, sf).first().cut


def test_maps_are_made_for_all_groups(spark, sf, con):
    nations = {g for (g,) in con.execute("SELECT DISTINCT n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey").fetchall()}
    assert len(nations) == 25
    assert {r.grp for r in entry.queries()["percentile_map_logistic"](spark, sf).select("grp").distinct().collect()} == nations
