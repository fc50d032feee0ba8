"""The pipeline and the registered queries on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from heldout.llm.catalog import ORACLES, QUERIES
from tests.llm.test_operators import expected_components, expected_hits

TABLES = "documents pages benchmark labels".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert [names[i] for i in order] == cols
    assert sorted(str(tuple(r)) for r in df.select(*cols).collect()) == sorted(str(tuple(r[i] for i in order)) for r in cur.fetchall())


def test_all_are_registered():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in names if n.startswith("op") and n[2:3].isdigit()} and "pipeline" in names


def test_pipeline_stages(spark, sf, con):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    benchmark = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    steps = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "MinHash near-dedup", "benchmark decontamination", "SentencePiece"]
    kept = docs
    for name in list(steps)[:4]:
        before = {r.doc_id: r.text for r in kept.collect()}
        after = steps[name](spark, kept, sf)
        assert after.columns == docs.columns
        kept = spark.createDataFrame(after.collect(), docs.schema)
        left = {r.doc_id: r.text for r in kept.collect()}
        assert left.items() <= before.items()
        if name == "exact dedup":
            assert len(left) == len({"".join((t or "").split()) for t in before.values()})
        if name == "MinHash near-dedup":
            assert set(left) == {c for _, _, c in expected_components(list(before.items()))}
        if name == "benchmark decontamination":
            assert set(left) == {d for d, t in before.items() if not expected_hits(t, benchmark)[1]}
    tokens = steps["SentencePiece"](spark, kept, sf).collect()
    whole = corpus_pipeline.run(spark, sf).collect()
    assert sorted(map(str, tokens)) == sorted(map(str, whole)) and len(tokens) == kept.count()
