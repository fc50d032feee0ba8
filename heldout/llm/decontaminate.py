"""Benchmark decontamination: training windows are looked up in a hash set of benchmark windows, hits verified word by word.

A window is ``N`` consecutive words of an item; an item with fewer words, but not none, is one window. Words are ``WORD`` after A-Z are
lower-cased. Each document's word hashes are combined by doubling (1, 2, 4, 8 words) to the hash of every window, and each window is
looked up in the set inside the row: texts are read once and never shuffled. What is found is carried on as the window's own words, which
must equal the item's words, so a hash collision adds nothing.

The set is part of the plan, which its size bounds: up to ``SET_LIMIT`` different windows. A larger benchmark takes another way with the
same result: windows are exploded and met with the benchmark's hashes in a shuffled join.

Defined cases: null texts (documents or items) have no words; an item whose id is null marks words but is not counted or listed; rows that
repeat an id are separate rows; an empty benchmark hits nothing. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heldout.llm.common import ascii_lower, drop_ids, text_of
from heldout.plans.storage import materialise

N = 10
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
SET_LIMIT = 20_000


def _with_words(df: DataFrame, text_col: str, *keep: Column) -> DataFrame:
    """Keep ``keep`` and add ``words``: what lies between the gaps of the text, without the empty ends."""
    rows = df.select(*keep, F.split(ascii_lower(text_of(text_col)), GAP).alias("_parts"))
    lead = F.when(F.get("_parts", F.lit(0)) == "", 1).otherwise(0)
    tail = F.when((F.size("_parts") > 1) & (F.element_at("_parts", -1) == ""), 1).otherwise(0)
    return rows.withColumn("words", F.slice("_parts", lead + 1, F.size("_parts") - lead - tail)).drop("_parts")


def _paired(left: str, right: str, shift: int) -> Column:
    """Hashes of the windows that begin in ``left`` and go on, ``shift`` words later, in ``right``."""
    n = F.greatest(F.least(F.size(left), F.size(right) - shift), F.lit(0))
    return F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(shift + 1), n), lambda a, b: F.xxhash64(a, b))


def _with_hashes(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """Add ``w<m>``, the hashes of all windows of m words, for each m of ``lengths``."""
    rows = rows.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    power = 1
    while 2 * power <= max(lengths, default=1):
        rows = rows.withColumn(f"h{2 * power}", _paired(f"h{power}", f"h{power}", power))
        power *= 2
    for m in lengths:
        bits = [1 << b for b in range(m.bit_length()) if m >> b & 1][::-1]
        at, last = bits[0], f"h{bits[0]}"
        for size in bits[1:]:
            rows = rows.withColumn(f"c{m}_{at + size}", _paired(last, f"h{size}", at))
            at, last = at + size, f"c{m}_{at + size}"
        rows = rows.withColumn(f"w{m}", F.col(last))
    return rows.select(*[c for c in rows.columns if c[0] not in "hc" or not c[1:2].isdigit()])


def benchmark_windows(benchmark: DataFrame, n: int = N, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item_id, m, gram, hash) of all items; written, as it is read several times."""
    rows = _with_words(benchmark, text_col, F.col(item_col).cast("string").alias("item_id")).filter(F.size("words") > 0)
    m = F.least(F.size("words"), F.lit(n))
    starts = F.sequence(F.lit(0), F.size("words") - m)
    grams = F.transform(starts, lambda i: F.slice("words", i + 1, m))
    grams = rows.select("item_id", m.alias("m"), F.explode(grams).alias("words")).withColumn("gram", F.array_join("words", " ")).distinct()
    hashed = _with_hashes(grams, list(range(1, n + 1)))
    pick = F.coalesce(*[F.when(F.col("m") == k, F.get(f"w{k}", F.lit(0))) for k in range(1, n + 1)])
    return materialise(hashed.select("item_id", "m", "gram", pick.alias("hash")), "windows")


def _places(hashes: str, known: list[int]) -> Column:
    """Positions of the hashes that are in the set ``known``."""
    marked = F.transform(hashes, lambda h, i: F.when(h.isin(known), i).otherwise(F.lit(-1)))
    return F.filter(marked, lambda p: p >= 0)


def _found(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One written row per document: at, id, n_words and its candidate windows (m, pos, gram)."""
    lengths = sorted(r.m for r in windows.select("m").distinct().collect())
    rows = _with_words(docs, text_col, F.col(id_col).alias("id"))
    none = F.array().cast("array<struct<m:int,pos:int,gram:string>>")
    hashes = windows.select("hash").distinct()
    few = hashes.limit(SET_LIMIT + 1).count() <= SET_LIMIT
    if not lengths:
        return materialise(rows.select(F.monotonically_increasing_id().alias("at"), "id", F.size("words").alias("n_words"), none.alias("hits")), "found")
    rows = _with_hashes(rows, lengths)

    def named(m: int, places: Column) -> Column:
        return F.transform(places, lambda p: F.struct(F.lit(m).alias("m"), p.alias("pos"), F.array_join(F.slice("words", p + 1, F.lit(m)), " ").alias("gram")))

    if few:
        for m in lengths:
            known = [r.hash for r in windows.filter(F.col("m") == m).select("hash").distinct().collect()]
            rows = rows.withColumn(f"p{m}", _places(f"w{m}", known))
        hits = reduce(lambda a, b: F.concat(a, b), [named(m, F.col(f"p{m}")) for m in lengths])
        found = rows.select(F.monotonically_increasing_id().alias("at"), "id", F.size("words").alias("n_words"), hits.alias("hits"))
        return materialise(found, "found")
    # Beyond the limit: the word lists are written once, so that the windows and the words of the hits come from the same rows.
    rows = materialise(rows.withColumn("at", F.monotonically_increasing_id()), "words")
    each = reduce(
        lambda a, b: a.unionByName(b),
        [rows.select("at", F.lit(m).alias("m"), F.posexplode(f"w{m}").alias("pos", "hash")) for m in lengths],
    )
    met = each.join(windows.select("m", "hash").distinct(), ["m", "hash"], "left_semi")
    places = met.groupBy("at").agg(F.collect_list(F.struct("m", "pos")).alias("places"))
    joined = rows.select("at", "id", "words").join(places, "at", "left")
    gram = F.transform("places", lambda p: F.struct(p["m"].alias("m"), p["pos"].alias("pos"), F.array_join(F.slice("words", p["pos"] + 1, p["m"]), " ").alias("gram")))
    return materialise(joined.select("at", "id", F.size("words").alias("n_words"), F.coalesce(gram, none).alias("hits")), "found")


def _covered(places: Column) -> Column:
    """Words inside the union of sorted spans (pos, m)."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(acc, p):
        end = F.greatest(acc["end"], p["pos"] + p["m"])
        return F.struct(end.alias("end"), (acc["n"] + end - F.greatest(acc["end"], p["pos"])).alias("n"))

    return F.aggregate(places, start, step)["n"]


def contamination(
    docs: DataFrame, benchmark: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """One row per document: id_col, n_words, n_hit, n_items, items (sorted), spans (pos, m of each verified window), contaminated."""
    windows = benchmark_windows(benchmark, n, item_col, item_text_col)
    found = _found(docs, windows, id_col, text_col)
    few = windows.limit(10 * SET_LIMIT + 1).count() <= 10 * SET_LIMIT
    hits = found.select("at", F.explode("hits").alias("hit")).select("at", "hit.*")
    owners = windows.select("item_id", "gram", F.col("m").alias("_m"))
    same = (F.col("gram") == F.col("_gram")) & (F.col("m") == F.col("_m"))
    owners = owners.withColumnRenamed("gram", "_gram")
    real = hits.join(F.broadcast(owners) if few else owners, same)
    per_doc = real.groupBy("at").agg(
        F.array_sort(F.collect_set(F.struct("pos", "m"))).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items")
    )
    none = F.array().cast("array<string>")
    rows = found.select("at", "id", "n_words").join(per_doc, "at", "left")
    return rows.select(
        F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"),
        F.coalesce(_covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"), "spans",
        F.col("spans").isNotNull().alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without any hit, all their columns. All rows of an id go if one of them is hit."""
    bad = contamination(docs, benchmark, n, id_col, text_col).filter("contaminated").select(id_col).distinct()
    return drop_ids(docs, materialise(bad, "contaminated"), id_col)


def remove_spans(text: Column, spans: Column) -> Column:
    """``text`` without the words inside ``spans`` (as ``contamination`` returns them) and the gaps right before these words."""
    hit = F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["pos"], s["pos"] + s["m"] - 1))))
    words = F.regexp_extract_all(text, F.lit("(" + WORD.replace("\\x3A-\\x60", "\\x3A-\\x40\\x5B-\\x60") + ")"), F.lit(0))
    gaps = F.split(text, WORD.replace("\\x3A-\\x60", "\\x3A-\\x40\\x5B-\\x60"))
    pieces = F.transform(words, lambda w, i: F.when(F.array_contains(hit, i), F.lit("")).otherwise(F.concat(F.get(gaps, i), w)))
    return F.when(spans.isNull(), text).otherwise(F.concat(F.array_join(pieces, ""), F.element_at(gaps, -1)))
