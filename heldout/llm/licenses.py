"""Licence scans: parts of a text compared with licence templates by the Dice coefficient of their sets of word bigrams.

The parts of a text are its lines, its blocks between blank lines and the text as a whole. A part is compared only with templates whose
size allows the coefficient: with n and t bigrams it is at most 2 min(n, t) / (n + t). Before any template is tried, a part must be within
the bounds of all sizes and enough of its bigrams must occur in some template at all (at least THRESHOLD / (2 - THRESHOLD) of them, or no
template can reach the threshold). So nearly every part costs only its tokenising, and the comparison itself meets few parts.

With ``windows`` (the registered query), what the matching parts leave over is searched for windows of words, with the templates and with the full texts of ``license_texts``: a notice
inside a line, or a licence over several lines and blocks of a longer document. With c common and u foreign bigrams the coefficient reaches
the threshold exactly if (2 - THRESHOLD) c - THRESHOLD u is at least THRESHOLD t. So a common bigram scores 2 - THRESHOLD and a foreign one
-THRESHOLD, and the windows are the runs of highest score, ended where the score falls by more than (2 - 2 THRESHOLD) t, which no match allows.
The coefficient of a window then counts distinct bigrams, by 64-bit hashes. Of overlapping windows the one with most common bigrams stays. Only
texts with THRESHOLD / (2 - THRESHOLD) of a template's bigrams are searched. Two copies so near that no run ends between them are one window.

Everything happens inside the row with DataFrame functions; nothing is shuffled. The templates are a parameter of bounded size (some
thousand bigrams) and part of the plan.

Defined cases: null, empty and wordless texts match nothing; a part of one word has no bigrams; equal parts of a text count once, equal windows each; of equal
coefficients the first template by identifier, then by text, is the best; repeated rows are separate rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heldout.llm.common import ascii_lower, text_of

THRESHOLD = 0.85
TEMPLATE_LIMIT = 20_000
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

# Identifiers and texts of licence notices and of short licences.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may "
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express "
        "or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details.",
    ),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def full_texts() -> tuple[tuple[str, str], ...]:
    """Identifiers and texts of whole licences, for the windows."""
    return tuple((p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))


def bigrams(text: str) -> list[str]:
    """Sorted distinct word bigrams of a template."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in re.split(GAP, low) if w]
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _pairs(words: Column, join) -> Column:
    """Distinct pairs of neighbours."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), join))


def parts_of(text: Column) -> Column:
    """Lines, blocks between blank lines, and the whole; equal parts once."""
    return F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, "\n[ \\t\\r]*\n"), F.array(text)))


def _let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _runs(hits: Column, t: Column, threshold: float) -> Column:
    """(s, e) of the runs of highest score among the places ``hits`` of common bigrams; r is the best run since the last peak."""
    gain, bound = F.lit(2 - threshold), t["size"] * F.lit(2 - 2 * threshold)
    none, zero = F.lit(-1), F.lit(0.0)
    found = F.array().cast("array<struct<s:int,e:int>>")

    def state(s, e, cur, top, last, rs, re, rcur, rtop, out):
        names = ("s", "e", "cur", "top", "last", "rs", "re", "rcur", "rtop", "out")
        return F.struct(*[c.alias(n) for n, c in zip(names, (s, e, cur, top, last, rs, re, rcur, rtop, out), strict=True)])

    def closed(a: Column) -> Column:
        good = a["top"] >= t["size"] * F.lit(threshold) - F.lit(1e-9)
        return F.when(good, F.concat(a["out"], F.array(F.struct(a["s"].alias("s"), a["e"].alias("e"))))).otherwise(a["out"])

    def step(a: Column, p: Column) -> Column:
        cost = (p - a["last"] - 1) * F.lit(threshold)
        cur, rcur = a["cur"] - cost, a["rcur"] - cost
        again = F.struct(p.alias("s"), p.alias("e"), gain.alias("cur"), gain.alias("top"))
        longer = F.struct(
            a["rs"].alias("s"), F.when(rcur + gain > a["rtop"], p).otherwise(a["re"]).alias("e"), (rcur + gain).alias("cur"),
            F.greatest(a["rtop"], rcur + gain).alias("top"),
        )
        rest = F.when((a["rs"] < 0) | (rcur <= 0), again).otherwise(longer)
        restart = _let(rest, lambda r: state(r["s"], r["e"], r["cur"], r["top"], p, none, none, zero, zero, closed(a)))
        peak = state(a["s"], p, cur + gain, cur + gain, p, none, none, zero, zero, a["out"])
        on = _let(rest, lambda r: state(a["s"], a["e"], cur + gain, a["top"], p, r["s"], r["e"], r["cur"], r["top"], a["out"]))
        first = state(p, p, gain, gain, p, none, none, zero, zero, a["out"])
        return F.when(a["s"] < 0, first).when((cur <= 0) | (a["top"] - cur > bound), restart).when(cur + gain > a["top"], peak).otherwise(on)

    return F.aggregate(hits, state(none, none, zero, zero, none, none, none, zero, zero, found), step, closed)


def _windows(grams: Column, words: Column, t: Column, threshold: float) -> Column:
    """The windows of one template that reach the threshold."""
    hits = F.filter(F.transform(grams, lambda g, i: F.when(F.array_contains(t["grams"], g), i)), lambda i: i.isNotNull())

    def scored(run: Column) -> Column:
        own = F.array_distinct(F.slice(grams, run["s"] + 1, run["e"] - run["s"] + 1))

        def row(g: Column) -> Column:
            common = F.size(F.array_intersect(g, t["grams"]))
            text = F.concat_ws(" ", F.slice(words, run["s"] + 1, run["e"] - run["s"] + 2))
            dice = (common * 2.0) / (F.size(g) + t["size"])
            return F.struct(common.alias("common"), dice.alias("dice"), (-t["order"]).alias("order"), run["s"].alias("s"), run["e"].alias("e"), t["license"].alias("license"), text.alias("part"))

        return _let(own, row)

    runs = _let(hits, lambda h: F.when(F.size(h) >= t["need"], _runs(h, t, threshold)).otherwise(F.array().cast("array<struct<s:int,e:int>>")))
    return F.filter(F.transform(runs, scored), lambda w: w["dice"] >= threshold)


def license_scan(
    docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
    windows: bool = False, texts: Sequence[tuple[str, str]] | None = None,
) -> DataFrame:
    """One row per document: id_col, n_matches (parts with a licence), license and dice of the best one, licenses (sorted), ``matches``
    (part, license, dice of each). With ``windows`` the windows count as the parts do; ``texts`` are whole licences for them, by default ``full_texts``."""
    texts = () if not windows else full_texts() if texts is None else texts
    kept = sorted({(name, text) for name, text in templates if bigrams(text)})
    sets = [bigrams(text) for _, text in kept]
    wider = kept + sorted({(name, text) for name, text in texts if bigrams(text)})
    wide_sets = [bigrams(text) for _, text in wider]
    known = sorted({g for s in wide_sets for g in s})
    if len(known) > TEMPLATE_LIMIT:
        raise ValueError("too many templates for one plan; scan with parts of them")
    match_type = "array<struct<part:string,license:string,dice:double>>"
    rows = docs.select(F.col(id_col).alias("_id"), ascii_lower(text_of(text_col)).alias("_text"))
    if not kept:
        rows = rows.withColumn("matches", F.array().cast(match_type))
    else:
        # Size bounds: 2 min(n, t) / (n + t) >= threshold.
        ratio = threshold / (2 - threshold)
        low, high = math.ceil(min(map(len, sets)) * ratio), math.floor(max(map(len, sets)) / ratio)
        rows = rows.withColumn("_parts", parts_of(F.col("_text")))
        rows = rows.withColumn("_words", F.transform("_parts", lambda s: F.filter(F.split(s, GAP), lambda w: w != "")))
        # Parts beyond the bounds of all templates leave here: a part of n words has at most n - 1 bigrams, and its distinct ones are counted next.
        sized = F.transform("_words", lambda w: F.when(F.size(w) > low, _pairs(w, lambda a, b: F.xxhash64(a, b))))
        rows = rows.withColumn("_pairs", sized)
        hashes = docs.sparkSession.createDataFrame([(g.split(" ")[0], g.split(" ")[1]) for g in known], "a string, b string")
        hash_of = {f"{r[0]} {r[1]}": r[2] for r in hashes.select("a", "b", F.xxhash64("a", "b")).collect()}
        found = sorted({hash_of[g] for s in sets for g in s})

        def maybe(p: Column, i: Column) -> Column:
            enough = F.size(F.filter(p, lambda h: h.isin(found))) >= F.lit(ratio - 1e-9) * F.size(p)
            return F.when((F.size(p) >= low) & (F.size(p) <= high), F.when(enough, i).otherwise(-1)).otherwise(-1)

        rows = rows.withColumn("_at", F.filter(F.transform("_pairs", maybe), lambda i: i >= 0))
        if windows:
            # The windows: texts with enough of a template's bigrams anywhere. The hashes of a template travel as one literal.
            needs = [math.ceil(ratio * len(s) - 1e-9) for s in wide_sets]
            wide = F.array(*[
                F.struct(
                    F.lit(name).alias("license"), F.split(F.lit(",".join(str(hash_of[g]) for g in s)), ",").cast("array<bigint>").alias("grams"), F.lit(k).alias("order"),
                    F.lit(len(s)).alias("size"), F.lit(need).alias("need"),
                )
                for k, ((name, _), s, need) in enumerate(zip(wider, wide_sets, needs, strict=True))
            ])
            everything = sorted(set(hash_of.values()))
            whole = F.get("_pairs", (F.array_position("_parts", F.col("_text")) - 1).cast("int"))
            rows = rows.withColumn("_hits", F.filter(whole, lambda h: h.isin(everything)))
            tried = F.filter(wide, lambda t: (F.size("_hits") >= t["need"]) & (F.size(F.array_intersect("_hits", t["grams"])) >= t["need"]))
            rows = rows.withColumn("_tried", F.when(F.size("_hits") >= min(needs), tried)).drop("_hits")
            rows = rows.withColumn("_text", F.when(F.size("_tried") > 0, F.col("_text")))
        rows = rows.drop("_pairs")
        own = F.transform("_at", lambda i: F.struct(F.get("_parts", i).alias("part"), _pairs(F.get("_words", i), lambda a, b: F.concat(a, F.lit(" "), b)).alias("grams")))
        rows = rows.withColumn("_own", own).drop("_parts", "_words", "_at")
        library = F.array(*[
            F.struct(F.lit(name).alias("license"), F.array(*[F.lit(g) for g in s]).alias("grams"), F.lit(k).alias("order"))
            for k, ((name, _), s) in enumerate(zip(kept, sets, strict=True))
        ])

        def compared(p: Column) -> Column:
            n = F.size(p["grams"])
            fitting = F.filter(library, lambda t: (F.least(n, F.size(t["grams"])) * 2.0) / (n + F.size(t["grams"])) >= threshold)
            scored = F.transform(
                fitting,
                lambda t: F.struct(
                    ((F.size(F.array_intersect(p["grams"], t["grams"])) * 2.0) / (n + F.size(t["grams"]))).alias("dice"), (-t["order"]).alias("order"), t["license"].alias("license")
                ),
            )
            best = F.array_max(F.filter(scored, lambda s: s["dice"] >= threshold))
            return F.struct(p["part"].alias("part"), best["license"].alias("license"), best["dice"].alias("dice"))

        rows = rows.withColumn("matches", F.filter(F.transform("_own", compared), lambda m: m["license"].isNotNull())).drop("_own")
        if windows:
            # Matching parts are one foreign word each; where the whole text matches, nothing is left.
            bar, done = F.array(F.lit("\n")), F.transform("matches", lambda m: m["part"])
            rows = rows.withColumn("_done", done)
            kept_words = lambda s: F.when(F.array_contains("_done", s), bar).otherwise(F.filter(F.split(s, GAP), lambda w: w != ""))
            by_line = lambda s: F.when(F.array_contains("_done", s), bar).otherwise(F.flatten(F.transform(F.split(s, "\n"), kept_words)))
            left = F.when(F.array_contains("_done", F.col("_text")), bar).otherwise(F.flatten(F.transform(F.split("_text", "\n[ \\t\\r]*\n"), by_line)))
            rows = rows.withColumn("_left", F.when(F.col("_text").isNotNull(), left)).drop("_text", "_done")
            n = F.greatest(F.size("_left") - 1, F.lit(0))
            grams = F.zip_with(F.slice("_left", F.lit(1), n), F.slice("_left", F.lit(2), n), lambda a, b: F.xxhash64(a, b))
            rows = rows.withColumn("_grams", F.when(F.col("_left").isNotNull(), grams))
            near = F.flatten(F.transform("_tried", lambda t: _windows(F.col("_grams"), F.col("_left"), t, threshold)))
            rows = rows.withColumn("_windows", F.when(F.col("_left").isNotNull(), F.sort_array(near, asc=False))).drop("_tried", "_grams", "_left")
            apart = F.aggregate(
                "_windows", F.slice("_windows", F.lit(1), F.lit(0)),
                lambda a, w: F.when(F.exists(a, lambda o: (o["s"] <= w["e"] + 1) & (w["s"] <= o["e"] + 1)), a).otherwise(F.concat(a, F.array(w))),
            )
            more = F.transform(apart, lambda w: F.struct(w["part"].alias("part"), w["license"].alias("license"), w["dice"].alias("dice")))
            rows = rows.withColumn("matches", F.when(F.size("_windows") > 0, F.concat("matches", more)).otherwise(F.col("matches"))).drop("_windows")
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    # The best match: largest coefficient, then the first licence by name.
    best = F.array_max(F.transform("matches", lambda m: m["dice"]))
    first = F.array_min(F.transform(F.filter("matches", lambda m: m["dice"] == F.col("_best")), lambda m: m["license"]))
    rows = rows.withColumn("_best", best)
    return rows.select(
        F.col("_id").alias(id_col), F.size("matches").cast("long").alias("n_matches"), first.alias("license"), F.col("_best").alias("dice"),
        F.array_join(names, ",").alias("licenses"), "matches",
    )
