"""The operators of this folder over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heldout.llm.decontaminate import N, contamination
from heldout.llm.exact_dedup import exact_dedup
from heldout.llm.importance import BUCKETS, MIN_WORDS, SEED, importance
from heldout.llm.importance import PERCENT as DRAWN_PERCENT
from heldout.llm.licenses import TEMPLATES, THRESHOLD, bigrams, license_scan
from heldout.llm.merkle import FAN, build, fold, prove, tampered_digest
from heldout.llm.minhash_dedup import PERCENT, SHINGLE, near_duplicates
from heldout.llm.secrets import KINDS, secrets, written
from heldout.llm.substring_dedup import WINDOW, dedup_substrings
from heldout.llm.token_files import read_documents, write_tokens
from heldout.llm.toxicity import toxicity
from heldout.llm.url_filters import DEPTH, FAN_OUT, REJECT, RULES, STRENGTH, Z, url_filter
from heldout.llm.warc import ALPHABET, archive_pages
from heldout.plans.storage import scratch_path
from heldout.llm.sentencepiece_codec import digests, encode
from heldout.llm.registry import ORACLES, QUERIES, query, table  # noqa: F401

SQL_NORMALISED = "regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')"


@query(
    "op5_exact_dedup",
    f"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256({SQL_NORMALISED}) AS h, {SQL_NORMALISED} AS t FROM documents),
    r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM r""",
)
def op5_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup(table(spark, sf, "documents")).drop("n_chars")


def _url_sql() -> str:
    """The templates of ``url_filter`` in SQL, one level of the tree after the other."""
    cols = [f"s{i}" for i in range(DEPTH)]
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    url = "(?s)^.*?://([^/?#]*)([^?#]*)"
    token = "(regexp_matches({0}, '^[0-9a-f-]{{16,}}$') OR (regexp_matches({0}, '^[0-9A-Za-z_-]{{20,}}$') AND regexp_matches({0}, '[0-9]') AND regexp_matches({0}, '[A-Za-z]')))"
    shape = []
    for i, c in enumerate(cols):
        seg = f"parts[{i + 1}]"
        tail = f"WHEN len(parts) > {DEPTH} THEN '**' " if i == DEPTH - 1 else ""
        shape.append(
            f"CASE WHEN NOT starts_with(path, '/') THEN NULL {tail}WHEN {token.format(seg)} THEN '*' ELSE regexp_replace({seg}, '[0-9]+', '#', 'g') END AS {c}"
        )
    longest_first = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = "CASE " + " ".join(
        f"WHEN (host = '{d}' OR ends_with(host, '.{d}')) AND starts_with(path, '{p}') THEN '{d}{p}'" for _, d, p in longest_first
    ) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN '{d}{p}' THEN '{v}'" for v, d, p in RULES) + " END"
    sql = f"""WITH u AS (SELECT page_id, {low.format(f"coalesce(regexp_extract(url, '{url}', 1), '')")} AS host,
        coalesce(regexp_extract(url, '{url}', 2), '') AS path FROM pages),
      p AS (SELECT *, string_split(substr(path, 2), '/') AS parts, {fits} AS rule FROM u),
      r AS (SELECT page_id, host, path, rule, {', '.join(shape)} FROM p),
      l AS (SELECT doc_id, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS b FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
      t0 AS (SELECT host, {', '.join(cols)}, count(b) AS lab, coalesce(sum(b), 0) AS bad, '' AS template, '' AS parent
             FROM r LEFT JOIN l ON page_id = doc_id GROUP BY host, {', '.join(cols)})"""
    for i, c in enumerate(cols):
        sql += f""", k{i} AS (SELECT host, template, count(DISTINCT {c}) AS kids FROM t{i} GROUP BY host, template),
      t{i + 1} AS (SELECT host, {', '.join(cols)}, lab, bad, CASE WHEN {c} IS NULL THEN parent ELSE template END AS parent,
        CASE WHEN {c} IS NULL THEN template ELSE template || '/' || CASE WHEN kids > {FAN_OUT} AND {c} <> '**' THEN '*' ELSE {c} END END AS template
        FROM t{i} JOIN k{i} USING (host, template))"""
    return sql + f""", n AS (SELECT host, parent, template, sum(lab) AS lab, sum(bad) AS bad FROM t{DEPTH} GROUP BY ALL),
      a AS (SELECT *, sum(lab) OVER w AS al, sum(bad) OVER w AS ab FROM n WINDOW w AS (PARTITION BY host, parent)),
      m AS (SELECT *, lab > 0 AND al > lab AND abs(bad / lab - (ab - bad) / (al - lab))
            <= {Z} * sqrt((ab / al) * (1 - ab / al) * (1 / lab + 1 / (al - lab))) AS alike FROM a),
      j AS (SELECT host, template, max(CASE WHEN alike THEN
              (SELECT (sum(o.bad) + {STRENGTH / 2}) / (sum(o.lab) + {STRENGTH}) FROM m o WHERE o.host = m.host AND o.parent = m.parent AND o.alike)
              ELSE (bad + {STRENGTH / 2}) / (lab + {STRENGTH}) END) > {REJECT} AS reject FROM m GROUP BY host, template)
      SELECT page_id, r.host, path, rule, coalesce({verdict}, CASE WHEN reject THEN 'block' ELSE 'allow' END) AS verdict, template
      FROM r JOIN t{DEPTH} c ON r.host = c.host AND {' AND '.join(f'r.{c} IS NOT DISTINCT FROM c.{c}' for c in cols)} JOIN j USING (template) WHERE j.host = c.host"""


@query("op10_url_filters", _url_sql())
def op10_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    marks = table(spark, sf, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    return url_filter(table(spark, sf, "pages"), marks)


SQL_BASE32 = "concat(" + ", ".join(
    f"substr('{ALPHABET}', (((('0x' || substr(h, {1 + 5 * g}, 5))::BIGINT >> {shift}) & 31) + 1)::INT, 1)" for g in range(8) for shift in (15, 10, 5, 0)
) + ")"


@query(
    "op6_warc",
    f"""WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
    r AS (SELECT *, min(page_id) OVER (PARTITION BY t) AS f FROM p)
    SELECT page_id, octet_length(encode(t)) AS payload_bytes, {SQL_BASE32} AS payload_digest,
    CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to FROM r""",
)
def op6_warc(spark: SparkSession, sf: str) -> DataFrame:
    read = archive_pages(table(spark, sf, "pages"))
    return read.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL_WORDS = f"regexp_extract_all({SQL_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query(
    "op4_decontamination",
    f"""WITH d AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
    b AS (SELECT item_id, {SQL_WORDS} AS w FROM benchmark),
    g AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS gram
          FROM (SELECT item_id, w, least(len(w), {N}) AS m, unnest(range(1, len(w) - least(len(w), {N}) + 2)) AS i FROM b WHERE len(w) > 0)),
    k AS (SELECT DISTINCT m FROM g),
    x AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS gram
          FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, k WHERE len(w) >= m)),
    h AS (SELECT doc_id, x.m, i, item_id FROM x JOIN g ON x.gram = g.gram AND x.m = g.m),
    c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY doc_id),
    t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
)
def op4_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).drop("items", "spans")


@query("op1_secret_scans")
def op1_secret_scans(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets(table(spark, sf, "documents"))
    kinds = F.transform("base", lambda b: b["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.concat("base", "found")).alias("spans"))


def piece_model() -> str:
    """The public 32k BPE model, as it is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op2_sentencepiece")
def op2_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return digests(encode(docs, piece_model(), decoded="decoded").drop("text"))


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity(table(spark, sf, "documents"), table(spark, sf, "labels").select("doc_id", "toxic"))


SQL_SPLIT = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"


@query(
    "op7_substring_dedup",
    f"""WITH d AS (SELECT doc_id, {SQL_SPLIT} AS w FROM documents),
    x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h
          FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS i FROM d WHERE len(w) >= {WINDOW})),
    s AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM x) WHERE n > 1),
    c AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM s),
    r AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id),
    k AS (SELECT doc_id, p, w[p] AS word FROM (SELECT d.doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d) t
          WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = t.doc_id AND c.p = t.p)),
    j AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM k GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN r USING (doc_id) LEFT JOIN j USING (doc_id)""",
)
def op7_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    kept = dedup_substrings(table(spark, sf, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL_LOW_SPLIT = f"regexp_extract_all({SQL_LOW}, '[^\\x20\\x09-\\x0D]+')"


@query(
    "op8_minhash_dedup",
    f"""WITH RECURSIVE d AS (SELECT doc_id, {SQL_LOW_SPLIT} AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS g
          FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE}, 0) + 2)) AS i FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= {PERCENT} * (nx.n + ny.n - c)),
    r AS (SELECT x AS doc_id, y AS o FROM l UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.o = l.x),
    f AS (SELECT doc_id, min(o) AS m FROM r GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
    d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN f USING (doc_id)""",
)
def op8_minhash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents"))


def _license_sql() -> str:
    rows = sorted({(name, text) for name, text in TEMPLATES})
    values = ", ".join("({}, '{}', [{}])".format(k, name, ", ".join(f"'{g}'" for g in bigrams(text))) for k, (name, text) in enumerate(rows))
    low = SQL_LOW
    return f"""WITH t(o, license, grams) AS (VALUES {values}),
    d AS (SELECT doc_id, {low} AS x FROM documents),
    p AS (SELECT doc_id, unnest(list_distinct(list_concat(string_split(x, chr(10)), regexp_split_to_array(x, '\\n[ \\t\\r]*\\n'), [x]))) AS part FROM d),
    w AS (SELECT doc_id, part, regexp_extract_all(part, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM p),
    g AS (SELECT doc_id, part, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS grams FROM w WHERE len(w) > 1),
    c AS (SELECT doc_id, part, license, o, 2.0::DOUBLE * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) AS dice FROM g JOIN t
          ON 2.0::DOUBLE * least(len(g.grams), len(t.grams)) / (len(g.grams) + len(t.grams)) >= {THRESHOLD}),
    m AS (SELECT doc_id, part, license, dice FROM c WHERE dice >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY doc_id, part ORDER BY dice DESC, o) = 1),
    a AS (SELECT doc_id, count(*) AS n_matches, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, max(dice) AS dice FROM m GROUP BY doc_id),
    b AS (SELECT m.doc_id, min(license) AS license FROM m JOIN a ON m.doc_id = a.doc_id AND m.dice = a.dice GROUP BY m.doc_id)
    SELECT doc_id, coalesce(n_matches, 0) AS n_matches, license, dice, coalesce(licenses, '') AS licenses FROM d LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)"""


@query("op9_license_scans", _license_sql())
def op9_license_scans(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan(table(spark, sf, "documents"), windows=True).drop("matches")


def word_tokenizer() -> str:
    """The public 49k BPE tokenizer of words, as it is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op11_token_files")
def op11_token_files(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf, "documents"), path, word_tokenizer(), end_id=2)
    return read_documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


#: CRC-32 in SQL: the table of its 256 remainders as CTE ``crc``, and the checksum of a list of bytes.
SQL_CRC_TABLE = """crc AS (SELECT list(list_reduce(range(9), lambda c, k: CASE WHEN k = 0 THEN c ELSE xor(c >> 1, 3988292384 * (c & 1)) END, n) ORDER BY n) AS tab
    FROM range(256) t(n))"""


def sql_crc(text: str) -> str:
    code = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: ('0x' || substr(hex(encode({text})), (2 * i - 1)::INT, 2))::BIGINT)"
    return f"xor(list_reduce({code}, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


LEAF_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Levels of a tree that the SQL writes out: 16 ** 8 leaves.
SQL_LEVELS = 8


def _merkle_sql() -> str:
    def leaf(text: str) -> str:
        fields = [text if f == "text" else f for f in LEAF_FIELDS]
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode({x}::VARCHAR)) || ':' || {x}::VARCHAR, '-')" for x in fields) + ")"

    def tree(name: str, first: str, leaf_rows: str) -> str:
        """CTEs name_0 to name_8: tree, pos, h (digest), n (nodes of the level), a and b (siblings before and after)."""
        out = []
        for k in range(SQL_LEVELS + 1):
            rows = leaf_rows if k == 0 else (
                f"SELECT tree, pos // {FAN} AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h, any_value(n + {FAN - 1}) // {FAN} AS n FROM {name}_{k - 1} WHERE n > 1 GROUP BY tree, pos // {FAN}"
            )
            w = f"PARTITION BY tree, pos // {FAN} ORDER BY pos ROWS BETWEEN"
            out.append(f"""{name}_{k} AS (SELECT *, coalesce(string_agg(h, '') OVER ({w} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
              coalesce(string_agg(h, '') OVER ({w} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM ({rows}))""")
        roots = " UNION ALL ".join(f"SELECT tree, h FROM {name}_{k} WHERE n = 1" for k in range(SQL_LEVELS + 1))
        return f"{', '.join(out)}, {name}_root AS ({roots})"

    def climb(name: str, rows: str, at: str) -> str:
        """CTEs that take proof and folded digest of every leaf up one tree."""
        out, last = [], rows
        for k in range(SQL_LEVELS):
            step = f"{name}_up_{k}"
            more = "coalesce(t.n, 0) > 1"
            out.append(f"""{step} AS (SELECT r.* REPLACE (CASE WHEN {more} THEN proof || t.a || t.b ELSE proof END AS proof,
              CASE WHEN {more} THEN sha256(t.a || up || t.b) ELSE up END AS up) FROM {last} r
              LEFT JOIN {name}_{k} t ON t.tree IS NOT DISTINCT FROM r.{'tree' if name == 'own' else 'one'} AND t.pos = r.{at} // {FAN**k})""")
            last = step
        return ", ".join(out)

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH {SQL_CRC_TABLE},
    d AS (SELECT doc_id, source AS tree, 0 AS one, {leaf('text')} AS leaf,
      CASE WHEN {sql_crc('doc_id::VARCHAR')} % 5 = 0 THEN {leaf(lowered)} ELSE {leaf('text')} END AS claimed,
      row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, {leaf('text')}) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM documents, crc),
    {tree('own', 'd', 'SELECT tree, pos, leaf AS h, n FROM d')},
    s AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS top, count(*) OVER () AS n FROM own_root),
    {tree('top', 's', 'SELECT 0 AS tree, top AS pos, subroot AS h, n FROM s')},
    base AS (SELECT doc_id, d.tree, one, pos, top, leaf, subroot, claimed AS up, '' AS proof FROM d JOIN s ON d.tree IS NOT DISTINCT FROM s.tree),
    {climb('own', 'base', 'pos')}, {climb('top', f'own_up_{SQL_LEVELS - 1}', 'top')}
    SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, up AS folded_root, up = root AS verified
    FROM top_up_{SQL_LEVELS - 1}, (SELECT h AS root FROM top_root)"""


@query("op12_merkle_manifest", _merkle_sql())
def op12_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    tampered = {"tampered": tampered_digest("doc_id", "text", LEAF_FIELDS)}
    manifest = build(table(spark, sf, "documents"), "doc_id", "source", LEAF_FIELDS, tampered)
    proofs = prove(manifest).withColumn("claimed", F.coalesce("tampered", "digest"))
    return fold(proofs, "claimed").select(
        F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _importance_sql() -> str:
    return f"""WITH {SQL_CRC_TABLE},
    d AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents), b AS (SELECT {SQL_WORDS} AS w FROM benchmark),
    x AS (SELECT doc_id, unnest(w) AS f FROM d), y AS (SELECT unnest(w) AS f FROM b),
    v AS (SELECT f, {sql_crc('f')} % {BUCKETS} AS k FROM (SELECT f FROM x UNION SELECT f FROM y), crc),
    s AS (SELECT k, count(*) AS s FROM x JOIN v USING (f) GROUP BY k), t AS (SELECT k, count(*) AS t FROM y JOIN v USING (f) GROUP BY k),
    g AS (SELECT k, floor(1000 * ln(((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + {BUCKETS}))::DOUBLE
      / ((s + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + {BUCKETS}))::DOUBLE))::BIGINT AS gain FROM s LEFT JOIN t USING (k)),
    e AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM x JOIN v USING (f) JOIN g USING (k) GROUP BY doc_id),
    c AS (SELECT doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight,
      coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
      FROM d LEFT JOIN e USING (doc_id)),
    r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM c WHERE n_features >= {MIN_WORDS})
    SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {DRAWN_PERCENT} * n // 100 THEN rank END AS rank FROM c LEFT JOIN r USING (doc_id)"""


@query("op13_importance_resampling", _importance_sql())
def op13_importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    scored = importance(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return scored.select("doc_id", "n_features", "weight", "score", "rank")
