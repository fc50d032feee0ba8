"""Cohort construction and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from heldout.catalog.base import (
    VIEWS, long_view, pred_view, pred_view_b, parts_view, query, r, rounded, segments_view, table, with_views,
)
from heldout.functions import scalars as S
from heldout.operators import cohort as C

# --- candidate, label, type, quality and purity tables made from orders and customers ---------------------

VIEWS["v_barcodes"] = (
    (),
    """SELECT c_custkey, 'T' || c_nationkey AS tissue, c_nationkey,
    'TCGA-' || substr(to_base(c_custkey, 36, 6), 1, 2) || '-' || substr(to_base(c_custkey, 36, 6), 3, 4) AS patient FROM customer""",
)
VIEWS["v_meta"] = (
    ("v_barcodes",),
    """SELECT o_orderkey AS file_id, CASE WHEN o_orderkey % 89 = 0 THEN 'TCGA-XX-0000' ELSE patient END AS patient_id,
    CASE WHEN o_orderkey % 97 = 0 THEN 'not-a-barcode' ELSE patient || CASE WHEN o_orderkey % 10 = 3 THEN '-01A' ELSE '-11A' END END AS sample_id,
    CASE WHEN o_orderkey % 61 = 0 THEN '' WHEN o_orderkey % 67 = 0 THEN 'UNRESOLVED' WHEN c_nationkey = 5 THEN 'OV' ELSE tissue END AS cancer_type
    FROM orders JOIN v_barcodes ON o_custkey = c_custkey""",
)
VIEWS["v_labels"] = (
    ("v_barcodes",),
    """SELECT patient || '-01' AS sample, CASE WHEN c_custkey % 41 = 0 THEN 'NA' ELSE CAST(c_custkey % 20 AS VARCHAR) END AS loh,
    CAST(c_custkey * 3 % 30 AS VARCHAR) AS lst, CAST(c_custkey * 7 % 25 AS VARCHAR) AS tai,
    CAST(c_custkey % 20 + c_custkey * 3 % 30 + c_custkey * 7 % 25 + CASE WHEN c_custkey % 37 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS total
    FROM v_barcodes, range(2) d(i) WHERE c_custkey % 47 <> 0 AND (i = 0 OR c_custkey % 43 = 0)""",
)
VIEWS["v_types"] = (
    ("v_barcodes",),
    """SELECT patient AS sample, CASE WHEN c_nationkey = 5 THEN 'OVCA' WHEN c_custkey % 53 = 0 THEN 'TX' ELSE tissue END AS cancer_type
    FROM v_barcodes WHERE c_custkey % 13 <> 0""",
)
VIEWS["v_quality"] = (
    ("v_barcodes",),
    """SELECT 'HumanMethylation450' AS platform, patient || '-01A-11D' AS aliquot,
    CASE WHEN c_custkey % 31 = 0 THEN 'True' ELSE 'False' END AS do_not_use,
    CASE WHEN c_custkey % 23 = 0 THEN '1.0' ELSE '0.0' END AS pathology_excluded FROM v_barcodes WHERE c_custkey % 29 <> 0
    UNION ALL SELECT 'GenomeArray', patient || '-01A-11D', 'True', '0.0' FROM v_barcodes""",
)
VIEWS["v_purity"] = (
    ("v_barcodes",),
    """SELECT patient || '-01' AS sample, CAST(c_custkey % 100 AS VARCHAR) AS purity, '2' AS ploidy
    FROM v_barcodes, range(2) d(i) WHERE i = 0 OR c_custkey % 19 = 0""",
)
RULES = """judged AS (
    SELECT m.*, l.*, q.*, p.*, CASE WHEN bad THEN 'invalid_barcode' WHEN patient <> patient_id THEN 'patient_metadata_mismatch'
      WHEN kind <> '01' THEN 'not_primary_tumor' WHEN n_primary <> 1 THEN 'ambiguous_primary_specimens'
      WHEN coalesce(n_label, 0) <> 1 THEN 'missing_or_ambiguous_label'
      WHEN cancer_type IN ('', 'UNRESOLVED') THEN 'missing_group'
      WHEN n_types > 1 OR one_type <> cancer_type THEN 'conflicting_group'
      WHEN has_quality IS NULL THEN 'missing_quality_annotation' WHEN bad_quality THEN 'quality_excluded'
      WHEN a IS NULL OR b IS NULL OR c IS NULL OR d IS NULL OR least(a, b, c, d) < 0 THEN 'invalid_label'
      WHEN abs(a + b + c - d) > 1e-6 THEN 'part_sum_mismatch' END AS reason
    FROM (SELECT *, count(*) FILTER (kind = '01') OVER (PARTITION BY patient_id) AS n_primary FROM
          (SELECT *, NOT regexp_matches(sample_id, '^TCGA-[A-Z0-9]{2}-[A-Z0-9]{4}(-[0-9]{2}[A-Z]?(-[A-Z0-9]+)*)?$') AS bad,
           CASE WHEN regexp_matches(sample_id, '^TCGA-') THEN substr(sample_id, 1, 12) END AS patient,
           CASE WHEN regexp_matches(sample_id, '^TCGA-') THEN substr(sample_id, 14, 2) END AS kind FROM v_meta)) m
    LEFT JOIN (SELECT substr(sample, 1, 15) AS lk, count(*) AS n_label, try_cast(max(loh) AS DOUBLE) AS a, try_cast(max(lst) AS DOUBLE) AS b,
      try_cast(max(tai) AS DOUBLE) AS c, try_cast(max(total) AS DOUBLE) AS d FROM v_labels GROUP BY 1) l ON substr(sample_id, 1, 15) = lk
    LEFT JOIN (SELECT sample AS tk, count(DISTINCT t) AS n_types, max(t) AS one_type FROM
      (SELECT sample, CASE WHEN cancer_type = 'OVCA' THEN 'OV' ELSE cancer_type END AS t FROM v_types) GROUP BY 1) t ON patient = tk
    LEFT JOIN (SELECT substr(aliquot, 1, 16) AS qk, true AS has_quality, bool_or(lower(do_not_use) = 'true' OR pathology_excluded = '1.0') AS bad_quality
      FROM v_quality WHERE contains(lower(platform), 'methylation450') GROUP BY 1) q ON substr(sample_id, 1, 16) = qk
    LEFT JOIN (SELECT sample AS pk, count(*) AS n_pur, try_cast(max(purity) AS DOUBLE) AS pur, try_cast(max(ploidy) AS DOUBLE) AS plo
      FROM v_purity GROUP BY 1) p ON substr(sample_id, 1, 15) = pk)"""
AUDIT = with_views("v_meta", "v_labels", "v_types", "v_quality", "v_purity") + ", " + RULES


def barcodes(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    code = F.lpad(F.conv(F.col("c_custkey").cast("string"), 10, 36), 6, "0")
    patient = F.concat(F.lit("TCGA-"), F.substring(code, 1, 2), F.lit("-"), F.substring(code, 3, 4))
    return c.select("*", F.concat(F.lit("T"), "c_nationkey").alias("tissue"), patient.alias("patient"))


def meta_table(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    j = o.join(barcodes(spark, sf), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    tail = F.when(k % 10 == 3, "-01A").otherwise("-11A")
    return j.select(
        k.alias("file_id"),
        F.when(k % 89 == 0, "TCGA-XX-0000").otherwise(F.col("patient")).alias("patient_id"),
        F.when(k % 97 == 0, "not-a-barcode").otherwise(F.concat("patient", tail)).alias("sample_id"),
        F.when(k % 61 == 0, "").when(k % 67 == 0, "UNRESOLVED").when(F.col("c_nationkey") == 5, "OV")
        .otherwise(F.col("tissue")).alias("cancer_type"),
    )


def audit_inputs(spark, sf):
    b, k = barcodes(spark, sf), F.col("c_custkey")
    key01 = F.concat("patient", F.lit("-01")).alias("sample")

    def copies(when):
        return F.explode(F.when(when, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_i")

    labels = b.filter(k % 47 != 0).select(
        key01,
        F.when(k % 41 == 0, "NA").otherwise((k % 20).cast("string")).alias("loh"),
        (k * 3 % 30).cast("string").alias("lst"),
        (k * 7 % 25).cast("string").alias("tai"),
        (k % 20 + k * 3 % 30 + k * 7 % 25 + F.when(k % 37 == 0, 1).otherwise(0)).cast("string").alias("total"),
        copies(k % 43 == 0),
    ).drop("_i")
    types = b.filter(k % 13 != 0).select(
        F.col("patient").alias("sample"),
        F.when(F.col("c_nationkey") == 5, "OVCA").when(k % 53 == 0, "TX").otherwise(F.col("tissue")).alias("cancer_type"),
    )
    aliquot = F.concat("patient", F.lit("-01A-11D")).alias("aliquot")
    quality = b.filter(k % 29 != 0).select(
        F.lit("HumanMethylation450").alias("platform"), aliquot,
        F.when(k % 31 == 0, "True").otherwise("False").alias("do_not_use"),
        F.when(k % 23 == 0, "1.0").otherwise("0.0").alias("pathology_excluded"),
    ).unionByName(b.select(F.lit("GenomeArray").alias("platform"), aliquot, F.lit("True").alias("do_not_use"), F.lit("0.0").alias("pathology_excluded")))
    purity = b.select(key01, (k % 100).cast("string").alias("purity"), F.lit("2").alias("ploidy"), copies(k % 19 == 0)).drop("_i")
    return meta_table(spark, sf), labels, types, quality, purity


@query(
    "audited_join",
    f"""{AUDIT} SELECT file_id, patient_id, sample_id, cancer_type, a AS loh, b AS lst, c AS tai, d AS total,
    CASE WHEN n_pur = 1 THEN pur END AS purity, CASE WHEN n_pur = 1 THEN plo END AS ploidy,
    CASE WHEN cancer_type IN ('T3', 'T7') THEN 'locked' ELSE 'development' END AS partition FROM judged WHERE reason IS NULL""",
)
def audited_join(spark, sf):
    return C.audited_join(*audit_inputs(spark, sf), locked=("T3", "T7"))[0]


@query(
    "precedence_reason",
    f"""{AUDIT} SELECT file_id, patient_id, sample_id, cancer_type, CASE WHEN reason IS NULL THEN 'included' ELSE 'excluded' END AS status,
    coalesce(reason, 'unique_match') AS reason FROM judged""",
)
def precedence_reason(spark, sf):
    return C.audited_join(*audit_inputs(spark, sf))[1]


@query(
    "exclusion_counts",
    f"""{AUDIT} SELECT CASE WHEN reason IS NULL THEN 'included' ELSE 'excluded' END AS status, coalesce(reason, 'unique_match') AS reason,
    count(*) AS n FROM judged GROUP BY 1, 2""",
)
def exclusion_counts(spark, sf):
    return C.exclusion_counts(C.audited_join(*audit_inputs(spark, sf))[1])


@query(
    "unique_primary_count",
    f"""{with_views('v_meta')} SELECT file_id, count(*) FILTER (substr(sample_id, 14, 2) = '01') OVER (PARTITION BY patient_id) AS n_primary FROM v_meta""",
)
def unique_primary_count(spark, sf):
    m = meta_table(spark, sf).withColumn("kind", F.substring("sample_id", 14, 2))
    return C.unique_primary_count(m).select("file_id", "n_primary")


@query(
    "parse_barcode",
    f"""{with_views('v_meta')} SELECT file_id, CASE WHEN ok THEN substr(sample_id, 1, 12) END AS patient,
    CASE WHEN ok THEN substr(sample_id, 1, 15) END AS key, CASE WHEN ok THEN substr(sample_id, 14, 2) END AS kind
    FROM (SELECT *, regexp_matches(sample_id, '^TCGA-[A-Z0-9]{{2}}-[A-Z0-9]{{4}}(-[0-9]{{2}}[A-Z]?(-[A-Z0-9]+)*)?$') AS ok FROM v_meta)""",
)
def parse_barcode(spark, sf):
    m = meta_table(spark, sf).withColumn("b", S.parse_barcode("sample_id"))
    return m.select("file_id", "b.patient", "b.key", "b.kind")


@query(
    "type_counts",
    f"""{with_views('v_meta')} SELECT substr(sample_id, 14, 2) AS kind, count(*) AS n, count(DISTINCT patient_id) AS patients FROM v_meta GROUP BY 1""",
)
def type_counts(spark, sf):
    m = meta_table(spark, sf).withColumn("kind", F.substring("sample_id", 14, 2))
    return m.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("patient_id").alias("patients"))


@query(
    "missing_counts",
    f"""{with_views('v_meta')} SELECT 'cancer_type' AS "column", count(*) FILTER (trim(coalesce(cancer_type, '')) = '') AS n_missing FROM v_meta
    UNION ALL SELECT 'sample_id', count(*) FILTER (trim(coalesce(sample_id, '')) = '') FROM v_meta""",
)
def missing_counts(spark, sf):
    return C.missing_counts(meta_table(spark, sf), ["cancer_type", "sample_id"])


@query(
    "cohort_five_number",
    f"""{with_views('v_pred')} SELECT grp, count(*) AS n, count(*) FILTER (actual >= 42) AS n_high, {r('min(actual)')} AS "min",
    {r('quantile_cont(actual, 0.25)')} AS q1, {r('quantile_cont(actual, 0.5)')} AS median, {r('quantile_cont(actual, 0.75)')} AS q3,
    {r('max(actual)')} AS "max" FROM v_pred GROUP BY grp""",
)
def cohort_five_number(spark, sf):
    return rounded(C.cohort_five_number(pred_view(spark, sf), "actual", 42.0))


@query(
    "alias_values",
    f"""{with_views('v_types')} SELECT sample, CASE cancer_type WHEN 'OVCA' THEN 'OV' WHEN 'AML' THEN 'LAML' ELSE cancer_type END AS cancer_type FROM v_types""",
)
def alias_values(spark, sf):
    t = audit_inputs(spark, sf)[2]
    return t.select("sample", S.alias_values("cancer_type").alias("cancer_type"))


@query(
    "coalesce_group_source",
    """WITH b AS (SELECT c_custkey AS k FROM customer), a AS (SELECT c_custkey AS k, c_mktsegment AS grp FROM customer WHERE c_custkey % 3 = 0),
    s AS (SELECT o_custkey AS k, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN max(o_orderstatus) END AS g FROM orders WHERE o_orderkey % 5 = 1 GROUP BY 1)
    SELECT b.k, coalesce(a.grp, g, 'UNRESOLVED') AS grp, CASE WHEN a.grp IS NOT NULL THEN 'authoritative' WHEN g IS NOT NULL THEN 'subtype' ELSE 'none' END AS grp_source
    FROM b LEFT JOIN a ON b.k = a.k LEFT JOIN s ON b.k = s.k""",
)
def coalesce_group_source(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey").alias("k")
    auth = c.filter("c_custkey % 3 = 0").select(k, F.col("c_mktsegment").alias("grp"))
    sub = table(spark, sf, "orders").filter("o_orderkey % 5 = 1").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("grp"))
    return C.coalesce_group_source(c.select(k), auth, sub, "k")


@query(
    "lookup_align",
    """SELECT c_custkey, s_acctbal, false AS missing FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey
    UNION ALL SELECT DISTINCT c_custkey, NULL, true FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""",
)
def lookup_align(spark, sf):
    dim = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_acctbal")
    found, gone = C.lookup_align(table(spark, sf, "customer").select("c_custkey"), dim, "c_custkey")
    gone = gone.select("c_custkey", F.lit(None).cast("double").alias("s_acctbal"), F.lit(True).alias("missing"))
    return found.withColumn("missing", F.lit(False)).unionByName(gone)


def annotations(spark, sf):
    p, k = table(spark, sf, "part").select("p_partkey"), F.col("p_partkey")
    probe = F.concat(F.lit("cg"), k).alias("probe")
    chrom = F.when(k % 24 == 22, "chrX").when(k % 24 == 23, "chrY").otherwise(F.concat(F.lit("chr"), k % 24 + 1)).alias("chromosome")
    a = p.select(probe, chrom, (k * 100).alias("position"))
    b = p.filter(k % 3 != 0).select(
        probe, chrom, (k * 100 + F.when(k % 7 == 0, 1).otherwise(0)).alias("position"),
        F.when(k % 11 == 0, "TRUE").when(k % 11 == 1, " yes ").when(k % 11 == 2, "0").otherwise("FALSE").alias("masked"),
    )
    return a, b


VIEWS["v_annotations"] = (
    (),
    """SELECT 'cg' || p_partkey AS probe, CASE p_partkey % 24 WHEN 22 THEN 'chrX' WHEN 23 THEN 'chrY' ELSE 'chr' || (p_partkey % 24 + 1) END AS chromosome,
    p_partkey * 100 AS position, p_partkey % 24 < 22 AS auto, p_partkey % 7 <> 0 AS same, p_partkey % 11 NOT IN (0, 1) AS clean FROM part WHERE p_partkey % 3 <> 0""",
)


@query(
    "bridge_join",
    f"{with_views('v_annotations')} SELECT probe, chromosome, position FROM v_annotations WHERE auto AND same AND clean",
)
def bridge_join(spark, sf):
    return C.bridge_join(*annotations(spark, sf))[0]


@query(
    "filter_bridge_predicates",
    f"""{with_views('v_annotations')} SELECT count(*) AS common, count(*) FILTER (auto) AS autosomal, count(*) FILTER (auto AND same) AS same_coordinates,
    count(*) FILTER (auto AND same AND clean) AS kept FROM v_annotations""",
)
def bridge_counts(spark, sf):
    return C.bridge_join(*annotations(spark, sf))[1]


@query(
    "melt_join_dims",
    f"""WITH w AS (SELECT vec_id, label, embedding FROM embeddings), m AS (SELECT vec_id AS probe, 'g' || (vec_id % 50) AS gene FROM w
    UNION ALL SELECT vec_id, 'h' || (vec_id % 30) FROM w WHERE vec_id % 5 = 0),
    l AS (SELECT vec_id AS probe, 'S' || i AS sample, CAST(embedding[i + 1] AS DOUBLE) AS value FROM w, range(6) t(i))
    SELECT l.probe, l.sample, {r('value')} AS value, gene, r_name AS site FROM l LEFT JOIN m ON l.probe = m.probe
    LEFT JOIN region ON l.sample = 'S' || r_regionkey""",
)
def melt_join_dims(spark, sf):
    e, v = table(spark, sf, "embeddings"), F.col("vec_id")
    cols = [f"S{i}" for i in range(6)]
    wide = e.select(v.alias("probe"), *[F.col("embedding").getItem(i).cast("double").alias(c) for i, c in enumerate(cols)])
    genes = F.explode(F.when(v % 5 == 0, F.array(F.concat(F.lit("g"), v % 50), F.concat(F.lit("h"), v % 30))).otherwise(F.array(F.concat(F.lit("g"), v % 50))))
    feature_map = e.select(v.alias("probe"), genes.alias("gene"))
    samples = table(spark, sf, "region").select(F.concat(F.lit("S"), "r_regionkey").alias("sample"), F.col("r_name").alias("site"))
    return rounded(C.melt_join_dims(wide, "probe", cols, feature_map, samples))


@query(
    "checked_inner_merge",
    f"""{with_views('v_pred', 'v_pred_b')} SELECT count(*) AS n, count(*) FILTER (a.id % 1000 = 1) AS group_mismatch, count(*) FILTER (a.id % 500 = 2) AS label_mismatch
    FROM v_pred a JOIN v_pred_b b ON a.id = b.id""",
)
def checked_inner_merge(spark, sf):
    b = pred_view_b(spark, sf).select("id", "grp", "actual", F.col("pred").alias("pred_b"))
    b = b.withColumn("grp", F.when(F.col("id") % 1000 == 1, "OTHER").otherwise(F.col("grp")))
    b = b.withColumn("actual", F.when(F.col("id") % 500 == 2, F.col("actual") + 1).otherwise(F.col("actual")))
    return C.checked_inner_merge(pred_view(spark, sf), b, "id")[1]


def signature_inputs(spark, sf):
    k, p = F.col("p_partkey"), table(spark, sf, "part").select("p_partkey")
    sets = p.filter(k % 4 < 2).select(F.when(k % 4 == 0, "positive").otherwise("negative").alias("set_name"), F.concat(F.lit("s"), k).alias("id"))
    cand = p.filter(k % 5 != 0).select(
        F.concat(F.lit("s"), k).alias("id"),
        F.explode(F.when(k % 7 == 0, F.array(F.concat(F.lit("c"), k), F.concat(F.lit("c"), k + 1))).otherwise(F.array(F.concat(F.lit("c"), k)))).alias("candidate"),
    )
    universe = p.filter(k % 3 != 0).select(F.concat(F.lit("c"), k).alias("candidate"))
    return sets, cand, universe


SIG = """WITH s AS (SELECT CASE p_partkey % 4 WHEN 0 THEN 'positive' ELSE 'negative' END AS set_name, 's' || p_partkey AS id, p_partkey AS k FROM part WHERE p_partkey % 4 < 2),
    c AS (SELECT 's' || p_partkey AS id, 'c' || p_partkey AS candidate FROM part WHERE p_partkey % 5 <> 0
          UNION ALL SELECT 's' || p_partkey, 'c' || (p_partkey + 1) FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 = 0),
    u AS (SELECT 'c' || p_partkey AS candidate FROM part WHERE p_partkey % 3 <> 0),
    a AS (SELECT set_name, s.id, count(c.candidate) AS n_candidates, count(u.candidate) AS n_expressed,
      coalesce(string_agg(c.candidate, ';' ORDER BY c.candidate), '') AS candidate_ids, max(u.candidate) AS hit
      FROM s LEFT JOIN c ON s.id = c.id LEFT JOIN u ON c.candidate = u.candidate GROUP BY 1, 2),
    audit AS (SELECT set_name, id, n_candidates, n_expressed, candidate_ids, CASE WHEN n_expressed = 1 THEN 'matched' WHEN n_expressed > 1 THEN 'ambiguous'
      WHEN n_candidates > 0 THEN 'not_in_universe' ELSE 'unmapped' END AS status, CASE WHEN n_expressed = 1 THEN hit END AS matched_id FROM a)"""


@query("signature_map", f"{SIG} SELECT * FROM audit")
def signature_map(spark, sf):
    return C.signature_map(*signature_inputs(spark, sf))[0]


@query(
    "signature_coverage",
    f"""{SIG} SELECT set_name, count(*) AS set_size, count(*) FILTER (status = 'matched') AS matched, count(DISTINCT matched_id) AS unique_matched,
    {r('count(DISTINCT matched_id) / count(*)')} AS coverage FROM audit GROUP BY 1""",
)
def signature_coverage(spark, sf):
    return rounded(C.signature_map(*signature_inputs(spark, sf))[1])


@query(
    "first_per_key_merge",
    """WITH f AS (SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn
      FROM orders WHERE o_orderstatus = 'F') WHERE rn = 1)
    SELECT o_custkey, o_orderkey, o_totalprice, late, high FROM f JOIN (SELECT o_custkey,
      arg_min(late, o_orderkey) FILTER (late IS NOT NULL) AS late, arg_min(o_totalprice, o_orderkey) FILTER (o_orderkey % 3 = 1) AS high
      FROM (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey * 10 END AS late FROM orders) GROUP BY 1) USING (o_custkey)""",
)
def first_per_key_merge(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select("o_custkey", "o_orderkey", "o_totalprice")
    k = F.col("o_orderkey")
    m = table(spark, sf, "orders").select("o_custkey", k.alias("seq"), F.when(k % 2 == 0, k * 10).alias("late"), F.when(k % 3 == 1, F.col("o_totalprice")).alias("high"))
    return C.first_per_key_merge(o, m, "o_custkey", ["o_orderkey"], ["late", "high"], ["seq"])


def pair_sql(view, per_row, seed):
    from heldout.catalog.ranking import q_key

    return f"""d AS (SELECT grp, id, actual, row_number() OVER (PARTITION BY grp ORDER BY {q_key(seed, 'id')}, id) AS rn FROM {view}),
    m AS (SELECT a.grp, a.id AS ai, b.id AS bi, a.actual > b.actual AS hi, (a.rn + b.rn) % 2 <> 0 AS want FROM d a JOIN d b
      ON a.grp = b.grp AND b.rn BETWEEN a.rn + 1 AND a.rn + {per_row} WHERE a.actual <> b.actual)"""


@query(
    "within_group_pairs",
    f"""{with_views('v_pred')}, {pair_sql('v_pred', 3, 21)} SELECT grp, CASE WHEN want = hi THEN ai ELSE bi END AS i,
    CASE WHEN want = hi THEN bi ELSE ai END AS j, CAST(want AS INTEGER) AS outcome FROM m""",
)
def within_group_pairs(spark, sf):
    return C.within_group_pairs(pred_view(spark, sf), 3, seed=21)


@query(
    "logo_prior_join",
    f"""{with_views('v_pred')}, s AS (SELECT grp, avg(pred - actual) AS rbar, avg(actual) AS ybar FROM v_pred GROUP BY grp)
    SELECT a.grp, count(*) AS n_others, {r('avg(b.rbar)')} AS rbar_mean, {r('var_samp(b.rbar)')} AS rbar_var, {r('avg(b.ybar)')} AS ybar_mean,
    {r('var_samp(b.ybar)')} AS ybar_var FROM s a JOIN s b ON a.grp <> b.grp GROUP BY a.grp""",
)
def logo_prior_join(spark, sf):
    stats = pred_view(spark, sf).groupBy("grp").agg(F.avg(F.col("pred") - F.col("actual")).alias("rbar"), F.avg("actual").alias("ybar"))
    return rounded(C.logo_prior_join(stats, ["rbar", "ybar"]))


@query(
    "interval_lookup",
    f"""{with_views('v_segments')}, p AS (SELECT event_id, user_id AS sample, event_id * 104729 % 1000000000 AS x FROM events)
    SELECT event_id, p.sample, x, s.seg_start, s.seg_end, {r('s.log2r')} AS log2r FROM p LEFT JOIN v_segments s ON p.sample = s.sample AND x >= s.seg_start AND x < s.seg_end""",
)
def interval_lookup(spark, sf):
    points = table(spark, sf, "events").select("event_id", F.col("user_id").alias("sample"), (F.col("event_id") * 104729 % 1000000000).alias("x"))
    segs = segments_view(spark, sf).select("sample", "seg_start", "seg_end", "log2r")
    return rounded(C.interval_lookup(points, segs, ["sample"], "x", 10_000_000))


@query(
    "membership_semi",
    "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)",
)
def membership_semi(spark, sf):
    from heldout.operators.checks import membership

    o = table(spark, sf, "orders").filter("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return membership(table(spark, sf, "customer").select("c_custkey"), o, "c_custkey")[0]


@query(
    "missing_anti",
    "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)",
)
def missing_anti(spark, sf):
    from heldout.operators.checks import membership

    o = table(spark, sf, "orders").filter("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return membership(table(spark, sf, "customer").select("c_custkey"), o, "c_custkey")[1]


TITLE = "substr(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), 1, 60)"


@query("normalize_title_key", f"SELECT doc_id, {TITLE} AS title_key FROM documents")
def normalize_title_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.title_key("text").alias("title_key"))


@query(
    "title_key_join",
    f"""WITH d AS (SELECT doc_id, n_chars, {TITLE} AS title_key FROM documents),
    b AS (SELECT n_chars, title_key, min(doc_id) AS note FROM d WHERE doc_id % 2 = 1 GROUP BY 1, 2)
    SELECT a.doc_id, a.n_chars, a.title_key, note FROM d a JOIN b ON a.n_chars = b.n_chars AND a.title_key = b.title_key WHERE a.doc_id % 2 = 0""",
)
def title_key_join(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars", "text")
    notes = d.filter("doc_id % 2 = 1").select("n_chars", "text", F.col("doc_id").alias("note"))
    return C.title_key_join(d.filter("doc_id % 2 = 0"), notes, "n_chars", "text").select("doc_id", "n_chars", "title_key", "note")


@query(
    "overlay_defaults",
    """SELECT d.doc_id, lang, coalesce(quality, CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS quality, coalesce(toxic, 0) AS toxic
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def overlay_defaults(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    defaults = {"quality": F.when(F.col("lang") == "en", 1).otherwise(0), "toxic": F.lit(0)}
    return C.overlay_defaults(d, table(spark, sf, "labels"), "doc_id", defaults)
