"""URL filters: domain rules first, then a tree of path templates per host whose labelled purity decides.

A url's segments become lexical shapes (runs of digits are ``#``, long hexadecimal or mixed tokens are ``*``). A host's tree grows level by
level until no path has a further segment. Below every node, children that are too many to be names (more than ``FAN_OUT``) become the wildcard
``*``, except those whose share of bad labels differs significantly from their siblings': these keep their name. Sibling templates
whose shares of bad labels do not differ significantly are merged, i.e. judged on
their summed labels. A template is rejected if its smoothed share of bad labels exceeds ``REJECT``; without labels that share is 1/2,
which allows.

Everything is DataFrame operations. Rows are combined into cells (host, shapes) before the first shuffle, so a host with a third of
all pages is a few cells; the verdicts return to the pages by an ordinary join that adaptive execution splits.

Defined cases: a null url, or one without ``://``, has empty host and path and no template labels of its own beyond those rows; null or
repeated page ids are separate rows; labels of a null id are ignored, of repeated labels a bad one wins; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heldout.llm.common import ascii_lower, text_of
from heldout.plans.storage import materialise

#: Levels of the SQL, which covers paths of at most so many segments, and of the plan between two written steps; trees have no bound.
DEPTH = 4
FAN_OUT = 16
REJECT = 0.6
STRENGTH = 4
Z = 1.96
#: Rules of the given task: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def parsed(url_col: str) -> tuple[Column, Column]:
    url = text_of(url_col)
    return ascii_lower(F.regexp_extract(url, URL, 1)), F.regexp_extract(url, URL, 2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, domain, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(domain + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def shapes(path: Column) -> Column:
    """The shapes of all segments (empty where the path has none)."""
    parts = F.split(F.substring(path, 2, 2147483647), "/")

    def shape(seg: Column) -> Column:
        token = seg.rlike("^[0-9a-f-]{16,}$|^(?=.*[0-9])(?=.*[A-Za-z])[0-9A-Za-z_-]{20,}$")
        return F.when(token, F.lit("*")).otherwise(F.regexp_replace(seg, "[0-9]+", "#"))

    return F.when(path.startswith("/"), F.transform(parts, shape)).otherwise(F.array().cast("array<string>")).alias("shapes")


def _alike(lab: Column, bad: Column, all_lab: Column, all_bad: Column) -> Column:
    """Whether a share of bad labels does not differ significantly from that of the rest; false unless both sides have labels."""
    others, others_bad, rate = all_lab - lab, all_bad - bad, all_bad / all_lab
    gap = F.abs(bad / lab - others_bad / others)
    alike = gap <= F.lit(Z) * F.sqrt(rate * (1 - rate) * (1 / lab + 1 / others))
    # ANSI arithmetic raises on 0/0, so the test is evaluated only where both sides have labels.
    return F.when((lab > 0) & (others > 0), alike).otherwise(F.lit(False))


def _grown(tree: DataFrame, level: int) -> DataFrame:
    """One further segment for the paths that have one; the others stay."""
    seg = F.get("shapes", F.lit(level))
    tree = tree.withColumn("seg", seg)
    more = tree.filter("seg IS NOT NULL")
    kids = more.groupBy("host", "template", "seg").agg(F.sum("lab").alias("k_lab"), F.sum("bad").alias("k_bad"))
    around = kids.groupBy("host", "template").agg(F.count(F.lit(1)).alias("kids"), F.sum("k_lab").alias("a_lab"), F.sum("k_bad").alias("a_bad"))
    many = kids.join(around.filter(F.col("kids") > FAN_OUT), ["host", "template"])
    two_sided = (F.col("k_lab") > 0) & (F.col("a_lab") > F.col("k_lab"))
    apart = two_sided & ~_alike(F.col("k_lab"), F.col("k_bad"), F.col("a_lab"), F.col("a_bad"))
    wild = many.select("host", "template", "seg", (~apart).alias("wild"))
    tree = tree.join(wild, ["host", "template", "seg"], "left")
    child = F.when(F.col("wild"), F.lit("*")).otherwise(F.col("seg"))
    grown = F.when(F.col("seg").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), child))
    parent = F.when(F.col("seg").isNull(), F.col("parent")).otherwise(F.col("template"))
    return tree.withColumn("parent", parent).withColumn("template", grown).drop("seg", "wild")


def template_verdicts(cells: DataFrame) -> DataFrame:
    """``cells``: host, shapes, lab, bad. Returns host, shapes and whether the template of that cell is rejected."""
    cells = materialise(cells, "url-cells")
    deepest = cells.agg(F.max(F.size("shapes"))).first()[0] or 0
    tree = cells.withColumn("template", F.lit("")).withColumn("parent", F.lit(""))
    for level in range(deepest):
        if level and level % DEPTH == 0:
            tree = materialise(tree, "url-tree")
        tree = _grown(tree, level)
    nodes = tree.groupBy("host", "parent", "template").agg(F.sum("lab").alias("lab"), F.sum("bad").alias("bad"))
    around = nodes.groupBy("host", "parent").agg(F.sum("lab").alias("all_lab"), F.sum("bad").alias("all_bad"))
    nodes = nodes.join(around, ["host", "parent"])
    nodes = nodes.withColumn("alike", _alike(F.col("lab"), F.col("bad"), F.col("all_lab"), F.col("all_bad")))
    merged = nodes.filter("alike").groupBy("host", "parent").agg(F.sum("lab").alias("m_lab"), F.sum("bad").alias("m_bad"))
    nodes = nodes.join(merged, ["host", "parent"], "left")
    lab = F.when(F.col("alike"), F.col("m_lab")).otherwise(F.col("lab"))
    bad = F.when(F.col("alike"), F.col("m_bad")).otherwise(F.col("bad"))
    nodes = nodes.select("host", "template", ((bad + F.lit(STRENGTH / 2)) / (lab + F.lit(float(STRENGTH))) > F.lit(REJECT)).alias("reject"))
    judged = tree.select("host", "template", "shapes").join(nodes.groupBy("host", "template").agg(F.max("reject").alias("reject")), ["host", "template"])
    return judged.select("host", "shapes", "template", "reject")


def url_filter(
    pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """``labels``: page id in ``id_col`` and boolean ``bad``. Returns id_col, host, path, rule, verdict, template."""
    host, path = parsed(url_col)
    rows = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    rows = rows.select("*", shapes(F.col("path")), rule_of(F.col("host"), F.col("path"), rules).alias("_rule"))
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col("bad").cast("int")).alias("_bad"))
    one = F.col("_bad").isNotNull().cast("long")
    labelled = rows.join(marks, "_id", "left")
    cells = labelled.groupBy("host", "shapes").agg(F.sum(one).alias("lab"), F.sum(F.coalesce("_bad", F.lit(0)).cast("long")).alias("bad"))
    judged = template_verdicts(cells)
    same = (F.col("p.host") == F.col("j.host")) & (F.col("p.shapes") == F.col("j.shapes"))
    joined = rows.alias("p").join(judged.alias("j"), same)
    method = F.when(F.col("j.reject"), "block").otherwise("allow")
    return joined.select(
        F.col("p._id").alias(id_col), "p.host", "p.path", F.col("p._rule.rule").alias("rule"),
        F.coalesce(F.col("p._rule.verdict"), method).alias("verdict"), "j.template",
    )
