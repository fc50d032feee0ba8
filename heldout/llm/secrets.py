"""Secret scans: fixed patterns, and a randomness battery whose findings keep a false-discovery rate per encoding and length.

Base patterns (``assign``, ``access``, ``hex``) give spans that always stay. For every other run of 20 or more token characters
the smallest fitting encoding is inferred (decimal, hexadecimal, base 32, 36, 62, 64). Three tests ask whether the characters could be
uniformly random in it: chi-squared uniformity, runs above and below the middle of the alphabet, serial correlation of neighbours.
Fisher's method joins them; a token that fails at level ``RANDOM`` is structured and no finding. For the rest the chi-squared statistic is
compared with what ordinary text of the same length gives (the coincidence of letters in prose, scaled to the alphabet; its mean and
variance are those of multinomial counts): ``p_ordinary`` is small if the token is far more even than prose can be at that
length. Findings are chosen by the step-up rule at rate ``RATE`` within each (encoding, length class), counted over all documents.

Only DataFrame operations are used. Patterns run inside the row; positions come from summed lengths of matches and of the gaps between
them. Documents without a match cost the pattern tests alone. What goes on to the statistics are the candidates, not the texts. The
step-up rule needs counts per class and per bin of p-values only, a table of bounded size.

Defined cases: null and empty texts have no spans; a repeated id is a separate row; equal tokens count once per occurrence; positions
are code points. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heldout.llm.common import text_of
from heldout.plans.storage import materialise

# The base patterns, their least lengths, and the order in which kinds are listed.
ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = "[A-Za-z0-9+/_-]{20,}"
DIGITS, UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Name, pattern, alphabet; the first that fits is inferred.
ENCODINGS = (
    ("decimal", "^[0-9]+$", DIGITS),
    ("hex", "^[0-9a-f]+$", DIGITS + "abcdef"),
    ("hex_upper", "^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", "^[0-9a-z]+$", DIGITS + UPPER.lower()),
    ("base36_upper", "^[0-9A-Z]+$", DIGITS + UPPER),
    ("base62", "^[0-9A-Za-z]+$", DIGITS + UPPER + UPPER.lower()),
    ("base64", "", DIGITS + UPPER + UPPER.lower() + "+/"),
)
#: Coincidence of letters in prose, times the alphabet's size: sums of squared and of cubed shares (even letters would give 1 and 1).
COINCIDENCE, TRIPLE = 1.73, 3.9
RANDOM = 0.01
RATE = 0.05
BLOCK = 256
BINS = 400


def _running(lengths: Column) -> Column:
    """Sums of all elements before each one. Blocks keep the cost of long lists far from quadratic."""
    n = F.size(lengths)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    zero = F.lit(0).cast("long")

    def before(values: Column, first: Column) -> Column:
        none = F.struct(F.array().cast("array<bigint>").alias("out"), first.alias("sum"))
        return F.aggregate(values, none, lambda a, x: F.struct(F.concat(a["out"], F.array(a["sum"])).alias("out"), (a["sum"] + x).alias("sum")))["out"]

    totals = F.transform(starts, lambda s: F.aggregate(F.slice(lengths, s + 1, F.lit(BLOCK)), zero, lambda a, x: a + x))
    firsts = before(totals, zero)
    return F.flatten(F.zip_with(starts, firsts, lambda s, f: before(F.slice(lengths, s + 1, F.lit(BLOCK)), f)))


def _spans(rows: DataFrame, name: str, pattern: str, kind: int, value_group: int = 0, least: int = 0) -> DataFrame:
    """Add ``name``: (start, kind, end, token) of the matches whose value has ``least`` characters."""
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,token:string>>")
    hit = F.col("text").rlike(pattern)
    rows = rows.withColumn("_v", F.when(hit, F.regexp_extract_all("text", F.lit(pattern), F.lit(value_group))))
    rows = rows.withColumn("_m", F.when(hit, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))) if value_group else F.col("_v"))
    rows = rows.withColumn("_g", F.when(F.col("_m").isNotNull(), F.split("text", pattern, -1)))
    rows = rows.withColumn("_l", F.zip_with("_m", F.slice("_g", F.lit(1), F.size("_m")), lambda m, g: (F.length(m) + F.length(g)).cast("long")))
    rows = rows.withColumn("_b", F.when(F.col("_m").isNotNull(), _running(F.col("_l"))))

    def span(before: Column, i: Column) -> Column:
        start = before + F.length(F.get("_g", i))
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(F.get("_m", i))).alias("end"), F.get("_v", i).alias("token"))

    found = F.filter(F.transform("_b", span), lambda s: F.length(s["token"]) >= least)
    return rows.withColumn(name, F.coalesce(found, none)).drop("_v", "_m", "_g", "_l", "_b")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One written row per document: at, id, ``base`` spans and ``candidates`` outside them."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    rows = _spans(rows, "assign", ASSIGN, 0, 1, 6)
    rows = _spans(rows, "access", ACCESS, 1)
    rows = _spans(rows, "hex", HEX, 2)
    rows = _spans(rows, "maybe", CANDIDATE, 3).drop("text")
    rows = rows.withColumn("base", F.concat("assign", "access", "hex"))
    inside = lambda c: F.exists("base", lambda b: (b["start"] <= c["start"]) & (c["end"] <= b["end"]))
    candidates = F.filter("maybe", lambda c: ~inside(c)).alias("candidates")
    bare = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end"))).alias("base")
    return materialise(rows.select(F.monotonically_increasing_id().alias("at"), "id", bare, candidates), "secrets")


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the normal law, by the rational Chebyshev fit of the complementary error function (relative error about 1e-7)."""
    x = F.abs(z) / F.lit(math.sqrt(2))
    t = F.lit(1.0) / (F.lit(1.0) + x / 2)
    # Coefficients of the fit, lowest power first.
    fit = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = F.lit(fit[-1])
    for c in fit[-2::-1]:
        poly = F.lit(c) + t * poly
    tail = t * F.exp(-x * x + poly) / 2
    return F.when(z >= 0, tail).otherwise(1 - tail)


def battery(tokens: DataFrame) -> DataFrame:
    """Add to rows with ``token``: encoding, p_chi, p_runs, p_serial, p_random (joined) and p_ordinary."""
    which, alphabet = F.lit(ENCODINGS[-1][0]), F.lit(ENCODINGS[-1][2])
    for name, pattern, letters in ENCODINGS[-2::-1]:
        fits = F.col("token").rlike(pattern)
        which, alphabet = F.when(fits, name).otherwise(which), F.when(fits, letters).otherwise(alphabet)
    rows = tokens.withColumn("encoding", which).withColumn("_a", alphabet)
    rows = rows.withColumn("_k", F.length("_a").cast("double")).withColumn("_n", F.length("token").cast("double"))
    rows = rows.withColumn("_chars", F.split(F.translate("token", "-_", "+/"), ""))
    rows = rows.withColumn("_x", F.transform(F.filter("_chars", lambda c: c != ""), lambda c: F.instr(F.col("_a"), c).cast("double") - 1))
    zero, n, k = F.lit(0.0), F.col("_n"), F.col("_k")
    cells = F.transform(F.sequence(F.lit(0), F.length("_a") - 1), lambda c: F.size(F.filter("_x", lambda x: x == c)).cast("double"))
    rows = rows.withColumn("_sq", F.aggregate(cells, zero, lambda a, v: a + v * v))

    # Chi-squared with k-1 degrees of freedom, to a normal score by the cube root.
    chi, df = k / n * F.col("_sq") - n, k - 1
    rows = rows.withColumn("p_chi", upper_tail((F.pow(F.greatest(chi, zero) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))))

    # Runs of values in the upper half of the alphabet.
    rows = rows.withColumn("_up", F.transform("_x", lambda x: F.when(x >= k / 2, 1.0).otherwise(0.0)))
    nxt = lambda c: F.slice(c, F.lit(2), F.size(c) - 1)
    cur = lambda c: F.slice(c, F.lit(1), F.size(c) - 1)
    add = lambda a, v: a + v
    rows = rows.withColumn("_n1", F.aggregate("_up", zero, add))
    runs = 1 + F.aggregate(F.zip_with(cur("_up"), nxt("_up"), lambda a, b: F.abs(a - b)), zero, add)
    both = 2 * F.col("_n1") * (n - F.col("_n1"))
    var = both * (both - n) / (n * n * (n - 1))
    rows = rows.withColumn("p_runs", F.when(var > 0, 2 * upper_tail(F.abs(runs - both / n - 1) / F.sqrt(F.when(var > 0, var)))).otherwise(zero))

    # Correlation of each value with the next.
    rows = rows.withColumn("_mean", F.aggregate("_x", zero, add) / n)
    rows = rows.withColumn("_d", F.transform("_x", lambda x: x - F.col("_mean")))
    own = F.aggregate("_d", zero, lambda a, v: a + v * v)
    rows = rows.withColumn("_own", own).withColumn("_lag", F.aggregate(F.zip_with(cur("_d"), nxt("_d"), lambda a, b: a * b), zero, add))
    serial = (F.col("_lag") / F.when(F.col("_own") > 0, F.col("_own")) + 1 / n) * F.sqrt(n)
    rows = rows.withColumn("p_serial", F.coalesce(2 * upper_tail(F.abs(serial)), zero))

    # Fisher: minus twice the summed logarithms is chi-squared with six degrees of freedom, whose tail is closed.
    least = lambda c: F.log(F.greatest(F.least(F.col(c), F.lit(1.0)), F.lit(1e-300)))
    half = -(least("p_chi") + least("p_runs") + least("p_serial"))
    rows = rows.withColumn("p_random", F.exp(-half) * (1 + half + half * half / 2))

    # Ordinary text of this length: mean and variance of the sum of squared multinomial counts.
    s2, s3 = F.lit(COINCIDENCE) / k, F.lit(TRIPLE) / (k * k)
    mean = n + n * (n - 1) * s2
    spread = 2 * n * (n - 1) * (s2 + 2 * (n - 2) * s3 - (2 * n - 3) * s2 * s2)
    rows = rows.withColumn("p_ordinary", upper_tail((mean - F.col("_sq")) / F.sqrt(spread)))
    return rows.drop(*[c for c in rows.columns if c.startswith("_")])


def discoveries(tested: DataFrame, rate: float = RATE) -> DataFrame:
    """Keep the rows found at the false-discovery rate within their encoding and length class (the power of two below the length)."""
    score = -F.log2(F.greatest("p_ordinary", F.lit(1e-300)))
    rows = tested.withColumn("length_class", F.floor(F.log2(F.length("token").cast("double"))).cast("int"))
    rows = rows.withColumn("bin", F.when(F.col("p_random") >= RANDOM, F.least(F.floor(2 * score), F.lit(BINS)).cast("int")).otherwise(F.lit(-1)))
    counted = rows.groupBy("encoding", "length_class", "bin").agg(F.count(F.lit(1)).alias("n"))
    of = Window.partitionBy("encoding", "length_class")
    above = F.sum("n").over(of.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    level = F.pow(F.lit(2.0), -F.col("bin") / 2)
    passed = counted.withColumn("all", F.sum("n").over(of)).withColumn("above", above).filter((F.col("bin") >= 0) & (level * F.col("all") <= rate * F.col("above")))
    cut = passed.groupBy("encoding", "length_class").agg(F.min("bin").alias("cut"))
    # At most one row per encoding and power of two: a table of a few hundred rows whatever the input.
    return rows.join(F.broadcast(cut), ["encoding", "length_class"]).filter("bin >= cut").drop("bin", "cut")


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """One row per document: id_col, ``base`` and ``found`` spans (start, kind, end), kinds numbered as in ``KINDS``."""
    rows = scan(docs, id_col, text_col)
    each = rows.select("at", F.explode("candidates").alias("c")).select("at", "c.*")
    found = discoveries(battery(each), rate).groupBy("at").agg(F.collect_list(F.struct("start", "kind", "end")).alias("found"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    joined = rows.select("at", "id", "base").join(found, "at", "left")
    return joined.select(F.col("id").alias(id_col), F.array_sort("base").alias("base"), F.coalesce("found", none).alias("found"))


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end`` in order of start and kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
