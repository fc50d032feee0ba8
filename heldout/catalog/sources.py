"""Source, sink and streaming queries: they write tables taken from the given ones to the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from heldout.catalog.base import long_view, pred_view, query, r, rounded, samples_view, table, with_views
from heldout.catalog.model import FEATURES, GRID, vectors
from heldout.operators.metrics import metrics_panel
from heldout.plans.storage import materialise, scratch_path
from heldout.sources import manifest as MF
from heldout.sources import matrix as MX
from heldout.sources import sinks as SK
from heldout.streaming import score as ST

SAMPLES = [f"TCGA-AB-{i:04d}-01A-11D" for i in range(64)]


def matrix_file(spark, sf) -> str:
    """A matrix text: one row per vector (feature), one column per entry (sample); some values are NA."""
    path = scratch_path(spark, "matrix")
    i = F.col("vec_id")
    x = [F.when((i * 31 + p * 17) % 29 != 0, (F.col("embedding").getItem(p).cast("double") + 1.0) / 2.0).alias(s) for p, s in enumerate(SAMPLES)]
    wide = table(spark, sf, "embeddings").select(F.concat(F.lit("cg"), i).alias("probe_id"), *x)
    SK.sink_table(wide, path, ["probe_id", *SAMPLES])
    return path


CELLS = """cells AS (SELECT 'cg' || vec_id AS feature, vec_id, pos, CASE WHEN (vec_id * 31 + pos * 17) % 29 <> 0 THEN (CAST(e AS DOUBLE) + 1.0) / 2.0 END AS value FROM
    (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings))"""
STATS = f"""{CELLS}, st AS (SELECT feature, count(value) AS n_known, 1 - count(value) / 64 AS missing, var_pop(value) AS var FROM cells GROUP BY feature)"""


@query("scan_matrix_tsv", f"WITH {CELLS} SELECT feature, CAST(pos AS INTEGER) AS pos, {r('value', 9)} AS value FROM cells")
def scan_matrix_tsv(spark, sf):
    m = MX.scan_matrix_tsv(spark, matrix_file(spark, sf))
    return rounded(m.select("feature", F.posexplode("x").alias("pos", "value")), 9)


@query("matrix_violations", "SELECT 'cg' || vec_id AS feature, count(*) AS n, 'duplicate' AS violation FROM embeddings WHERE vec_id % 25 = 0 GROUP BY 1 UNION ALL SELECT 'cg' || vec_id, 1, 'out_of_range' FROM embeddings WHERE vec_id % 25 = 1".replace("count(*) AS n", "2 * count(*) AS n"))
def matrix_violations(spark, sf):
    m = MX.scan_matrix_tsv(spark, matrix_file(spark, sf))
    number = F.regexp_extract("feature", r"(\d+)", 1).cast("long")
    again = m.filter(number % 25 == 0)
    spoiled = m.withColumn("x", F.when(number % 25 == 1, F.concat(F.array(F.lit(1.5)), F.slice("x", 2, 63))).otherwise(F.col("x")))
    return MX.matrix_violations(spoiled.unionByName(again), 64)


@query("scan_matrix_topk", f"WITH {STATS} SELECT feature, CAST(n_known AS INTEGER) AS n_known, {r('missing')} AS missing, {r('var', 9)} AS var FROM st WHERE missing <= 0.05 AND var > 0 ORDER BY st.var DESC, feature LIMIT 100")
def scan_matrix_topk(spark, sf):
    top = MX.scan_matrix_topk(MX.scan_matrix_tsv(spark, matrix_file(spark, sf)), 100)
    return top.select("feature", "n_known", F.round("missing", 6).alias("missing"), F.round("var", 9).alias("var"))


@query("running_topk_prune", f"WITH {STATS} SELECT count(*) AS seen, count(*) FILTER (missing > 0.04) AS dropped_missing, count(*) FILTER (missing <= 0.04 AND NOT var > 0) AS dropped_constant, CAST(0 AS BIGINT) AS out_of_range FROM st")
def matrix_counts(spark, sf):
    return MX.matrix_counts(MX.scan_matrix_tsv(spark, matrix_file(spark, sf)), 0.04)


@query("scan_matrix_features_only", f"WITH {CELLS} SELECT feature, CAST(CASE pos WHEN 3 THEN 0 ELSE 1 END AS INTEGER) AS pos, {r('value', 9)} AS value FROM cells WHERE pos IN (3, 40) AND vec_id IN (SELECT p_partkey FROM part WHERE p_size < 10)")
def scan_matrix_features_only(spark, sf):
    needed = table(spark, sf, "part").filter("p_size < 10").select(F.concat(F.lit("cg"), "p_partkey").alias("feature"))
    m = MX.scan_matrix_features_only(MX.scan_matrix_tsv(spark, matrix_file(spark, sf), keep=[3, 40]), needed)
    return rounded(m.select("feature", F.posexplode("x").alias("pos", "value")), 9)


@query("scan_header_only", "SELECT DISTINCT CAST(pos AS INTEGER) AS pos, 'TCGA-AB-' || lpad(CAST(pos AS VARCHAR), 4, '0') || '-01A-11D' AS sample FROM (SELECT generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)")
def scan_header_only(spark, sf):
    return MX.scan_header_only(spark, matrix_file(spark, sf))


@query("scan_matrix_columns_by_prefix", "SELECT DISTINCT 'TCGA-AB-' || lpad(CAST(pos AS VARCHAR), 4, '0') || '-01A' AS sample, CAST(pos AS INTEGER) AS pos, 'TCGA-AB-' || lpad(CAST(pos AS VARCHAR), 4, '0') || '-01A-11D' AS column_name FROM (SELECT generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) WHERE pos IN (SELECT n_nationkey FROM nation)")
def scan_matrix_columns_by_prefix(spark, sf):
    header = MX.scan_header_only(spark, matrix_file(spark, sf))
    wanted = table(spark, sf, "nation").select(F.concat(F.lit("TCGA-AB-"), F.lpad(F.col("n_nationkey").cast("string"), 4, "0"), F.lit("-01A")).alias("sample"))
    return MX.columns_by_prefix(header, wanted)[0]


def sample_files(spark, sf) -> str:
    """One two-column file per sample below ``file_id=<name>``."""
    path = scratch_path(spark, "samples")
    rows = long_view(spark, sf).filter("(id + pos) % 11 <> 0").select(
        F.concat(F.lit("S"), F.lpad(F.col("pos").cast("string"), 2, "0")).alias("file_id"),
        F.concat(F.when(F.col("id") % 40 == 0, "rs").otherwise("cg"), F.col("id")).alias("feature"), "value",
    )
    rows.repartition("file_id").write.partitionBy("file_id").option("sep", "\t").csv(path)
    return path


@query(
    "scan_sample_files",
    f"""{with_views('v_long')} SELECT 'P' || lpad(CAST(pos AS VARCHAR), 2, '0') AS sample, 'cg' || id AS feature, {r('value', 9)} AS value FROM v_long
    WHERE (id + pos) % 11 <> 0 AND id % 40 <> 0 AND id IN (SELECT p_partkey FROM part WHERE p_size < 30)""",
)
def scan_sample_files(spark, sf):
    path = sample_files(spark, sf)
    manifest = long_view(spark, sf).select("pos").distinct().select(
        F.concat(F.lit("S"), F.lpad(F.col("pos").cast("string"), 2, "0")).alias("file_key"), F.concat(F.lit("P"), F.lpad(F.col("pos").cast("string"), 2, "0")).alias("sample")
    )
    allow = table(spark, sf, "part").filter("p_size < 30").select(F.concat(F.lit("cg"), "p_partkey").alias("feature"))
    return rounded(MX.scan_sample_files(spark, f"{path}/*", manifest, "file_id=([^/]+)", allow), 9)


@query(
    "sample_file_violations",
    f"""{with_views('v_long')}, f AS (SELECT 'S' || pos AS sample, 'cg' || id AS feature, CASE WHEN (id + pos) % 97 = 5 THEN value + 2 ELSE value END AS value,
      CASE WHEN (id * 3 + pos) % 89 = 1 THEN 2 ELSE 1 END AS n FROM v_long)
    SELECT sample, feature, CAST(n AS BIGINT) AS n, CASE WHEN n > 1 THEN 'duplicate' ELSE 'out_of_range' END AS violation FROM f WHERE n > 1 OR value < 0 OR value > 1""",
)
def sample_file_violations(spark, sf):
    """Sample files with planted repeats and values outside the range."""
    path = scratch_path(spark, "violations")
    key = F.col("id") + F.col("pos")
    rows = long_view(spark, sf).select(
        F.concat(F.lit("S"), "pos").alias("file_id"), F.concat(F.lit("cg"), "id").alias("feature"), F.when(key % 97 == 5, F.col("value") + 2).otherwise(F.col("value")).alias("value"),
        F.explode(F.sequence(F.lit(1), F.when((F.col("id") * 3 + F.col("pos")) % 89 == 1, 2).otherwise(1))).alias("copy"),
    ).drop("copy")
    rows.repartition("file_id").write.partitionBy("file_id").option("sep", "\t").csv(path)
    manifest = long_view(spark, sf).select(F.concat(F.lit("S"), "pos").alias("file_key"), F.concat(F.lit("S"), "pos").alias("sample")).distinct()
    return MX.sample_file_violations(MX.scan_sample_files(spark, f"{path}/*", manifest, "file_id=([^/]+)"))


@query("manifest_digest_check")
def manifest_digest_check(spark, sf):
    """No SQL: file digests. One manifest entry is falsified and one names no file."""
    path = sample_files(spark, sf)
    files = MF.file_digests(spark, path).filter(F.col("filename").endswith(".csv"))
    last = files.agg(F.max("filename").alias("_last")).withColumn("_one", F.lit(1))
    m = files.withColumn("_one", F.lit(1)).join(F.broadcast(last), "_one").select("filename", F.col("length").alias("size"), F.when(F.col("filename") == F.col("_last"), "0" * 32).otherwise(F.col("md5")).alias("md5"), "sha256")
    gone = spark.createDataFrame([("absent.csv", 1, "x", "y")], "filename string, size long, md5 string, sha256 string")
    return MF.digest_check(files, m.unionByName(gone)).groupBy("status").agg(F.count(F.lit(1)).alias("files"))


@query("run_manifest_hash")
def run_manifest_hash(spark, sf):
    """No SQL: SHA-256 of the files of a written table."""
    path = scratch_path(spark, "hash")
    table(spark, sf, "customer").write.option("header", True).csv(path)
    return MF.file_digests(spark, path).filter(F.col("filename").endswith(".csv")).select("length", "sha256")


@query("scan_tsv_table", "SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def scan_tsv_table(spark, sf):
    path = scratch_path(spark, "table")
    c = table(spark, sf, "customer").withColumn("c_acctbal", F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal")))
    SK.sink_table(c, path, ["c_custkey", "c_acctbal", "c_mktsegment"])
    return MX.scan_tsv_table(spark, path, "c_custkey long, c_acctbal double, c_mktsegment string")


@query("sink_table", "SELECT p_partkey, p_name, p_size FROM part")
def sink_table(spark, sf):
    path = scratch_path(spark, "sink")
    SK.sink_table(table(spark, sf, "part"), path, ["p_size", "p_partkey", "p_name"])
    return MX.scan_tsv_table(spark, path, "p_size int, p_partkey long, p_name string")


@query("scan_annotation_gz", "SELECT 'cg' || p_partkey AS probe, p_partkey * 100 AS position FROM part WHERE p_partkey % 10 <> 0")
def scan_annotation_gz(spark, sf):
    path, k = scratch_path(spark, "annotation"), F.col("p_partkey")
    rows = table(spark, sf, "part").select(F.concat(F.when(k % 10 == 0, "rs").otherwise("cg"), k).alias("probe"), (k * 100).alias("position"))
    rows.write.option("header", True).option("sep", "\t").option("compression", "gzip").csv(path)
    return MX.scan_annotation_gz(spark, path, "probe string, position long")


@query(
    "scan_nested_json_hits",
    """SELECT 'f' || o_orderkey AS id, 'o' || o_orderkey || '.txt' AS file_name, o_orderkey * 10 AS file_size, 'P' || o_custkey AS patient_id, 'P' || o_custkey || '-01' AS sample_id, 'T' || (o_custkey % 5) AS grp
    FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 6 <> 0 AND o_orderkey % 5 <> 0""",
)
def scan_nested_json_hits(spark, sf):
    path, k = scratch_path(spark, "hits"), F.col("o_orderkey")
    patient = F.concat(F.lit("P"), F.col("o_custkey"))
    sample = F.struct(F.concat(patient, F.lit("-01")).alias("submitter_id"), F.when(k % 5 == 0, "Solid Tissue Normal").otherwise("Primary Tumor").alias("sample_type"))
    samples = F.when(k % 6 == 0, F.array(sample, sample)).otherwise(F.array(sample))
    case = F.struct(patient.alias("submitter_id"), F.struct(F.concat(F.lit("TCGA-T"), F.col("o_custkey") % 5).alias("project_id")).alias("project"), samples.alias("samples"))
    hit = F.struct(
        F.concat(F.lit("f"), k).alias("id"), F.concat(F.lit("o"), k, F.lit(".txt")).alias("file_name"), (k * 10).alias("file_size"),
        F.when(k % 4 == 0, F.array(case, case)).otherwise(F.array(case)).alias("cases"),
    )
    pages = table(spark, sf, "orders").select(F.floor(k / 50).alias("page"), hit.alias("hit")).groupBy("page").agg(F.collect_list("hit").alias("hits"))
    pages.select("hits").write.json(path)
    return MX.scan_nested_json_hits(spark, path)


@query("scan_gene_sets", "SELECT p_brand AS set_name, 'g' || p_partkey AS feature FROM part")
def scan_gene_sets(spark, sf):
    """Ragged rows of at most 100 ids; a large set takes several rows."""
    path, k = scratch_path(spark, "sets"), F.col("p_partkey")
    rows = table(spark, sf, "part").groupBy("p_brand", F.floor(k / 100).alias("line")).agg(F.collect_list(F.concat(F.lit(" g"), k)).alias("ids"))
    rows.select(F.concat_ws(",", "p_brand", F.concat_ws(",", "ids"), F.lit("")).alias("value")).write.text(path)
    return MX.scan_gene_sets(spark, path)


@query("gene_set_violations", "SELECT 'g' || p_partkey AS feature, CASE WHEN p_partkey % 30 = 0 THEN 'shared' ELSE 'repeated' END AS violation FROM part WHERE p_partkey % 30 IN (0, 1)")
def gene_set_violations(spark, sf):
    k = F.col("p_partkey")
    sets = table(spark, sf, "part").select(F.explode(F.when(k % 30 == 0, F.array(F.lit("a"), F.lit("b"))).when(k % 30 == 1, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a")))).alias("set_name"), F.concat(F.lit("g"), k).alias("feature"))
    return MX.gene_set_violations(sets)


#: A feature is missing or not where any of the 64 columns of the matrix file is.
EXPRESSION_SQL = """SELECT 'cg' || vec_id AS raw_id, 'symbol' AS id_type, CASE WHEN len(list_filter(range(64), lambda k:
    (vec_id * 31 + k * 17) % 29 = 0 OR (k = 7 AND (vec_id * 31 + k * 17) % 9 = 0))) > 0 THEN 'missing_or_nonfinite' ELSE 'retained' END AS status FROM embeddings"""


@query("scan_expression_matrix", EXPRESSION_SQL)
def scan_expression_matrix(spark, sf):
    return MX.scan_expression_matrix(spark, matrix_file(spark, sf)).select("raw_id", "id_type", "status")


# The name under which all columns were registered first.
query("scan_expression_matrix_full", EXPRESSION_SQL)(scan_expression_matrix)


@query("scan_headerless_map", "SELECT 'cg' || p_partkey AS key, unnest(CASE WHEN p_partkey % 4 = 0 THEN [p_type, p_brand] ELSE [p_type] END) AS value FROM part")
def scan_headerless_map(spark, sf):
    path, k = scratch_path(spark, "map"), F.col("p_partkey")
    genes = F.when(k % 4 == 0, F.concat_ws(";", "p_type", "p_brand")).otherwise(F.col("p_type"))
    table(spark, sf, "part").select(F.concat(F.lit("cg"), k), genes).write.option("sep", "\t").csv(path)
    return MX.scan_headerless_map(spark, path, ";")


@query("scan_fold_outputs", f"{with_views('v_pred')} SELECT id, grp, {r('pred', 9)} AS pred, CASE WHEN grp < 'NATION_2' THEN {r('covariate', 9)} END AS covariate FROM v_pred")
def scan_fold_outputs(spark, sf):
    path, df = scratch_path(spark, "folds"), pred_view(spark, sf)
    df.filter("grp < 'NATION_2'").select("id", "grp", "pred", "covariate").write.parquet(f"{path}/a")
    df.filter("grp >= 'NATION_2'").select("id", "grp", "pred").write.parquet(f"{path}/b")
    return rounded(MX.scan_fold_outputs(spark, [f"{path}/a", f"{path}/b"]), 9)


@query(
    "manifest_select_tier",
    """SELECT p_name AS filename, sum(p_size) AS bytes FROM (SELECT p_name || '-' || p_partkey AS p_name, p_size FROM part WHERE p_size >= 40) GROUP BY 1""".replace("sum(p_size)", "CAST(sum(p_size) AS BIGINT)"),
)
def manifest_select_tier(spark, sf):
    p = table(spark, sf, "part").select(F.concat(F.lit(" "), F.concat_ws("-", "p_name", "p_partkey"), F.lit("\r")).alias("filename"), F.col("p_size").cast("long").alias("size"))
    wanted = p.filter("size >= 40").select("filename", F.col("size").alias("tier_pos"))
    tier, _ = MF.select_tier(p, wanted)
    return tier.select("filename", F.col("size").alias("bytes"))


@query("manifest_tier_total", "SELECT count(*) AS files, CAST(sum(r_regionkey) AS BIGINT) AS bytes FROM region WHERE r_name IN ('ASIA', 'EUROPE', 'AFRICA')")
def manifest_tier_total(spark, sf):
    m = table(spark, sf, "region").select(F.col("r_name").alias("filename"), F.col("r_regionkey").alias("size"))
    tier = spark.createDataFrame(list(enumerate(["ASIA", "EUROPE", "AFRICA"])), "tier_pos int, filename string")
    return MF.select_tier(m, tier)[1]


@query("scan_sidecar_json", "SELECT false AS engineering_only, CAST(64 AS BIGINT) AS n_samples, count(*) AS n_features, 'historical' AS track FROM embeddings")
def scan_sidecar_json(spark, sf):
    m = MX.scan_matrix_tsv(spark, matrix_file(spark, sf))
    path = scratch_path(spark, "provenance")
    SK.provenance_record(m, m.select("feature"), "historical").write.json(path)
    return MX.scan_sidecar_json(spark, path).select("engineering_only", "n_samples", "n_features", "track")


@query("sink_provenance")
def sink_provenance(spark, sf):
    """No SQL: order-free digest."""
    m = MX.scan_matrix_tsv(spark, matrix_file(spark, sf))
    return SK.provenance_record(m, m.select("feature"), "historical")


@query(
    "sink_ledger_append",
    f"""{with_views('v_metrics')}, e AS (SELECT grp, n, {r('mae')} AS mae FROM v_metrics) SELECT 'run1' AS run_id, 'started' AS status, grp, n, mae, CAST(0 AS BIGINT) AS prior FROM e
    UNION ALL SELECT 'run1', 'finished', grp, n, mae, 0 FROM e UNION ALL SELECT 'run2', 'started', grp, n, mae, 2 * (SELECT count(*) FROM e) FROM e UNION ALL SELECT 'run2', 'finished', grp, n, mae, 2 * (SELECT count(*) FROM e) FROM e""",
)
def sink_ledger_append(spark, sf):
    path = scratch_path(spark, "ledger")
    panel = metrics_panel(pred_view(spark, sf), ["grp"]).select("grp", "n", "mae")
    prior = {}
    for run in ("run1", "run2"):
        entry = panel.select(F.lit(run).alias("run_id"), F.current_timestamp().alias("evaluated_at"), F.lit("frozen").alias("model"), "grp", "n", "mae")
        prior[run] = SK.recorded_evaluation(entry, path, lambda: None)
    ledger = SK.read_ledger(spark, path)
    return rounded(ledger.select("run_id", "status", "grp", "n", "mae", F.when(F.col("run_id") == "run1", prior["run1"]).otherwise(prior["run2"]).cast("long").alias("prior")))


@query("export_run_manifest", f"{with_views('v_pred')} SELECT CAST(pos AS INTEGER) AS pos, field, value FROM (SELECT 0 AS pos, 'rows' AS field, CAST(count(*) AS VARCHAR) AS value FROM v_pred UNION ALL SELECT 1, 'groups', CAST(count(DISTINCT grp) AS VARCHAR) FROM v_pred UNION ALL SELECT 2, 'kind', 'frozen')")
def export_run_manifest(spark, sf):
    facts = pred_view(spark, sf).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("grp").alias("groups"), F.lit("frozen").alias("kind"))
    return SK.export_run_manifest(facts)


@query("sink_model_bundle")
def sink_model_bundle(spark, sf):
    """No SQL: a fitted model written, read back and used."""
    from heldout.operators.model import freeze_model, score

    path, rows = scratch_path(spark, "bundle"), vectors(spark, sf)
    run = freeze_model(rows, FEATURES, seed=61, missing=False, **GRID)
    SK.sink_model_bundle(run, path, ["model", "tuning", "selected", "conformal", "partitions"])
    back = SK.read_model_bundle(spark, path, ["model"])
    return rounded(score(rows, back["model"], FEATURES, left_out=False).select("id", "grp", "pred"), 5)


@query(
    "sink_fold_resumable",
    f"{with_views('v_pred')} SELECT grp AS fold, count(*) AS n, {r('avg(pred)')} AS mean_pred, grp = 'NATION_1' AS resumed FROM v_pred GROUP BY grp",
)
def sink_fold_resumable(spark, sf):
    # Read once per fold and run: written once, so that the joins behind it do not run and broadcast for every fold.
    path, df = scratch_path(spark, "resume"), materialise(pred_view(spark, sf).select("grp", "pred"))
    folds = [x[0] for x in df.select("grp").distinct().orderBy("grp").collect()]

    def run(fold):
        return df.filter(F.col("grp") == fold).agg(F.count(F.lit(1)).alias("n"), F.avg("pred").alias("mean_pred"))

    SK.sink_fold_resumable(spark, path, [f for f in folds if f != "NATION_1"], run)
    done = SK.sink_fold_resumable(spark, path, folds, run)
    return rounded(spark.read.parquet(path).select("fold", "n", "mean_pred", F.col("fold").isin(*done).alias("resumed")))


# --- streaming ---------------------------------------------------------------------------------------------


def fixed_model(spark, sf):
    """A frozen model whose coefficients come from the supplier table: beta_j = balance / 10000 of supplier j < 5."""
    s = table(spark, sf, "supplier").filter("s_suppkey < 5").select(F.col("s_suppkey").cast("int").alias("pos"), (F.col("s_acctbal") / 10000).alias("beta"))
    terms = F.transform(F.array_sort(F.collect_list(F.struct("pos", "beta"))), lambda t: t)
    m = s.agg(terms.alias("t")).select(
        F.lit("ALL").alias("outer_group"), F.lit(0.25).alias("intercept"), F.transform("t", lambda t: t["pos"]).alias("pos"),
        F.transform("t", lambda t: t["beta"]).alias("beta"), F.transform("t", lambda t: F.lit(0.0)).alias("fill"),
    )
    return m


SCORED = """scored AS (SELECT vec_id AS id, 'G' || label AS grp, 0.25 + (SELECT sum(s_acctbal / 10000 * ((CAST(embedding[s_suppkey + 1] AS DOUBLE) + 1.0) / 2.0)) FROM supplier WHERE s_suppkey < 5) AS pred FROM embeddings)"""


def streamed(spark, sf):
    source = scratch_path(spark, "stream-in")
    vectors(spark, sf).select("id", "grp", "x").repartition(8).write.parquet(source)
    return ST.read_sample_stream(spark, source, "id long, grp string, x array<double>", 3)


@query("stream_score", f"WITH {SCORED} SELECT id, grp, {r('pred')} AS pred FROM scored")
def stream_score(spark, sf):
    out, state = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-state")
    ST.stream_score(streamed(spark, sf), fixed_model(spark, sf), FEATURES, out, state).awaitTermination()
    return rounded(spark.read.parquet(out))


@query("stream_ledger", f"WITH {SCORED} SELECT grp, count(*) AS n, {r('sum(pred)')} AS pred_sum FROM scored GROUP BY grp")
def stream_ledger(spark, sf):
    from heldout.operators.model import score

    path, state = scratch_path(spark, "stream-ledger"), scratch_path(spark, "stream-state")
    scored = score(streamed(spark, sf), fixed_model(spark, sf), FEATURES, left_out=False).select("id", "grp", "pred")
    ST.stream_ledger(scored, path, state).awaitTermination()
    total = ST.read_stream_ledger(spark, path).groupBy("grp").agg(F.sum("n").alias("n"), F.sum("pred_sum").alias("pred_sum"))
    return rounded(total)


__all__ = ["samples_view"]
