"""Licence scan: sparse TF-IDF cosine of passages to licence templates, then inheritance from directories.

A passage is a line; in a licence file (by its name) the whole text is one more. Terms are lower-case runs
of letters and digits, with version numbers kept whole. Idf comes from the templates; a term that no template
has gets the largest idf, and each of its occurrences counts as a term of its own. A template's `signals` are its heaviest terms,
as many as leave the rest too light to reach the threshold alone, so a passage without a signal cannot match, and
one pattern over the text finds all passages that may. Longer forms (whole licences, file headers, openings of long licences,
identifier lines) have an index of their own: wherever the terms of a text, with signs, comment marks and line ends left out, hold the first
terms of a form, as many terms as the form has are one more passage. All of this is one projection over a row.

A file without a licence of its own inherits that of its nearest ancestor directory (its own directory first)
that holds a licence file with a recognised licence. Only distinct directories are joined with their ancestors; files then
look up their directory, a directory with a large share of all files by broadcast.

Everything is DataFrame expressions: no Python runs on executors. Results for odd input: a null text or path gives no own licence, a null path
nothing to inherit; empty texts have no passages; of several licence files in a directory the best score wins, then the lowest
path; of equal templates the first listed; repeated rows are reported each; a very long text is read whole within its row; columns of any name
are kept in `row`, so none can clash; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.llm.license_forms import FORMS, identifier_lines
from pagelens.operators.skew import lookup
from pagelens.session import scratch_path

#: Licence notices: plain values.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This file is subject to the Mozilla Public License, version 2.0."),
)
THRESHOLD = 0.7
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice)([._-].*)?$"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
HOT_ROWS = 10_000


class Index:
    """Template vectors of length 1, idf and signals: sizes follow the template list."""

    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        counts = [Counter(re.findall(TERM, text.lower())) for _, text in templates]
        present = Counter(t for c in counts for t in c)
        self.names = [name for name, _ in templates]
        self.idf = {t: math.log((1 + len(counts)) / (1 + n)) + 1 for t, n in sorted(present.items())}
        self.other = math.log(1 + len(counts)) + 1
        self.weights = []
        for c in counts:
            raw = {t: n * self.idf[t] for t, n in c.items()}
            norm = math.sqrt(sum(x * x for x in raw.values()))
            self.weights.append({t: x / norm for t, x in raw.items()})
        self.signals = set()
        for w in self.weights:
            rest = 1.0
            for t, x in sorted(w.items(), key=lambda p: (-p[1], p[0])):
                if rest < threshold**2 - 1e-9:
                    break
                self.signals.add(t)
                rest -= x * x
        self.pattern = "(?i)(" + "|".join(re.escape(t) for t in sorted(self.signals)) + ")"


class Forms:
    """The index of longer forms, and where their passages begin: at the first terms, for as many terms as each has."""

    OPENING = 4
    #: Every form has one of these words, so other texts are not split into terms.
    HINT = "(?i)(licen[cs]e|permission|redistribution)"

    def __init__(self, forms=(*FORMS, *identifier_lines(name for name, _ in (*TEMPLATES, *FORMS))), threshold: float = THRESHOLD):
        self.index = Index(forms, threshold)
        terms = [re.findall(TERM, text.lower()) for _, text in forms]
        for _, text in forms:
            if not re.search(self.HINT, text):
                raise ValueError(f"a form without a hint: {text[:40]!r}")
        self.starts = sorted({(" ".join(t[: self.OPENING]), len(t)) for t in terms})

    def passages(self, text: Column) -> Column:
        joined = F.array_join(F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1)), " ")
        # An array of one, so that the terms are joined once for all forms.
        openings = "|".join(re.escape(opening) for opening in sorted({o for o, _ in self.starts}))
        found = lambda j: F.when(j.rlike(rf"(?<!\S)({openings})(?!\S)"), F.flatten(F.array(*[self._at(j, *s) for s in self.starts])))
        return F.when(text.rlike(self.HINT), F.array_distinct(F.get(F.transform(F.array(joined), found), F.lit(0))))

    def _at(self, joined: Column, opening: str, n: int) -> Column:
        more = n - len(opening.split())
        # Looking ahead takes nothing away, so a passage may begin inside another.
        return F.regexp_extract_all(joined, F.lit(rf"(?<!\S)(?=({re.escape(opening)}(?!\S)(?: \S+){{0,{more}}}))"), F.lit(1))


def _vector(passage: Column, index: Index) -> Column:
    """struct(known: terms that templates have, others: number of other terms)."""
    terms = F.regexp_extract_all(F.lower(passage), F.lit(f"({TERM})"), F.lit(1))
    known = F.filter(terms, lambda t: t.isin(*index.idf))
    return F.struct(known.alias("known"), F.size(terms).alias("n"))


def _best(vector: Column, index: Index) -> Column:
    """struct(score, order, license) of the most similar template; ties go to the first listed."""
    known = vector["known"]
    # Written as one literal each, which is parsed once when the plan is made.
    table = {t: [w.get(t, 0.0) for w in index.weights] for t in index.idf}
    weights = F.from_json(F.lit(json.dumps(table)), "map<string,array<double>>")
    idf = F.from_json(F.lit(json.dumps(index.idf)), "map<string,double>")
    zeros = F.array(*[F.lit(0.0)] * len(index.names))
    # Each occurrence of a term adds once to the products and, with those before it, to the square.
    counted = F.transform(F.array_distinct(known), lambda t: F.struct(t.alias("t"), F.size(F.filter(known, lambda x: x == t)).alias("tf")))
    start = F.struct(zeros.alias("dots"), F.lit(0.0).alias("square"))
    total = F.aggregate(
        counted,
        start,
        lambda s, c: F.struct(
            F.zip_with(s["dots"], weights[c["t"]], lambda d, w: d + w * c["tf"] * idf[c["t"]]).alias("dots"),
            (s["square"] + F.pow(c["tf"] * idf[c["t"]], F.lit(2.0))).alias("square"),
        ),
        lambda s: F.struct(s["dots"].alias("dots"), F.sqrt(s["square"] + (vector["n"] - F.size(known)) * (index.other**2)).alias("norm")),
    )
    names = F.array(*[F.lit(n) for n in index.names])
    scored = F.transform(
        F.array(total),
        lambda s: F.array_max(
            F.transform(s["dots"], lambda d, i: F.struct((d / F.greatest(s["norm"], F.lit(1e-9))).alias("score"), (-i).alias("order")))
        ),
    )[0]
    return F.struct(scored["score"].alias("score"), scored["order"].alias("order"), F.get(names, -scored["order"]).alias("license"))


def _able(vectors: Column, index: Index, threshold: float) -> Column:
    """The vectors that may reach the threshold, by the share of their weight that known terms can hold at most: most end here."""
    heavy = max(index.idf.values())
    may = lambda v: (F.size(v["known"]) > 0) & (
        F.pow(F.size(v["known"]) * F.lit(heavy), F.lit(2.0)) * (1 - threshold**2)
        >= threshold**2 * (v["n"] - F.size(v["known"])) * index.other**2
    )
    return F.filter(vectors, may)


def own_licenses(df: DataFrame, path: str, text: str, index: Index, threshold: float = THRESHOLD, forms: Forms | None = None) -> DataFrame:
    """Columns of `df` but the text as struct `row`, path, directory, is_file (a licence file), own (score, license) or null."""
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    out = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text]).alias("row"), F.col(path).alias("path"), F.col(text).alias("text")
    )
    out = out.withColumn("is_file", F.coalesce(name.rlike(LICENSE_FILE), F.lit(False)))
    lines = F.filter(F.split("text", r"\r?\n"), lambda x: x.rlike(index.pattern))
    passages = F.when(
        F.col("text").rlike(index.pattern), F.concat(lines, F.when(F.col("is_file"), F.array("text")).otherwise(F.array().cast("array<string>")))
    )
    out = out.withColumn("vectors", F.transform(passages, lambda p: _vector(p, index)))
    out = out.withColumn("vectors", _able(F.col("vectors"), index, threshold))
    best = F.when(F.size("vectors") > 0, F.array_max(F.transform("vectors", lambda v: _best(v, index))))
    if forms is not None:
        out = out.withColumn("openings", forms.passages(F.col("text")))
        out = out.withColumn("longer", F.transform("openings", lambda p: _vector(p, forms.index)))
        longer = F.when(F.size("longer") > 0, F.array_max(F.transform("longer", lambda v: _best(v, forms.index))))
        # The greater score; at equal scores the longer form.
        best = F.when(F.coalesce(longer["score"], F.lit(-1.0)) >= F.coalesce(best["score"], F.lit(-1.0)), longer).otherwise(best)
    out = out.withColumn("best", best)
    return out.select(
        "row",
        "path",
        F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), F.lit(""))).alias("directory"),
        "is_file",
        F.when(F.col("best.score") >= threshold, F.struct("best.score", "best.license")).alias("own"),
    )


def scan(
    df: DataFrame, path: str, text: str, templates=TEMPLATES, threshold: float = THRESHOLD, hot_rows: int = HOT_ROWS,
    forms: Forms | None = None,
) -> DataFrame:
    """(row: columns of `df` but the text, license, score, how: own, inherited or none, inherited_from); all known forms by default."""
    spark = df.sparkSession

    def written(part: DataFrame, name: str) -> DataFrame:
        at = scratch_path(spark, name)
        part.write.parquet(at)
        return spark.read.schema(part.schema).parquet(at)

    files = written(own_licenses(df, path, text, Index(templates, threshold), threshold, forms or Forms(threshold=threshold)), "licenses")
    holders = (
        files.filter(F.col("is_file") & F.col("own").isNotNull() & F.col("directory").isNotNull())
        .groupBy(F.col("directory").alias("holder"))
        .agg(F.min(F.struct((-F.col("own.score")).alias("order"), "path", F.col("own.license").alias("license"))).alias("best"))
        .select("holder", F.col("best.license").alias("inherited"))
    )
    directories = files.filter(F.col("directory").isNotNull()).groupBy("directory").agg(F.count(F.lit(1)).alias("n"))
    steps = F.split("directory", "/")
    ancestors = directories.select(
        "directory",
        F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))).alias("holder"),
    )
    rooted = ancestors.unionByName(directories.filter(F.substring("directory", 1, 1).isin("/", "") == F.lit(False)).select("directory", F.lit("").alias("holder")))
    nearest = (
        rooted.distinct().join(holders, "holder")
        .groupBy("directory")
        .agg(F.max(F.struct(F.length("holder").alias("depth"), "holder", "inherited")).alias("near"))
    )
    known = written(
        directories.join(nearest, "directory", "left").select("directory", "n", F.col("near.holder").alias("holder"), F.col("near.inherited").alias("inherited")),
        "directories",
    )
    out = lookup(files.filter(F.col("directory").isNotNull()), known, "directory", hot_rows)
    lone = files.filter(F.col("directory").isNull()).withColumns({"holder": F.lit(None).cast("string"), "inherited": F.lit(None).cast("string")})
    out = out.unionByName(lone)
    inherits = F.col("own").isNull() & F.col("inherited").isNotNull()
    return out.select(
        "row",
        F.coalesce("own.license", "inherited").alias("license"),
        F.coalesce("own.score", F.lit(0.0)).alias("score"),
        F.when(F.col("own").isNotNull(), "own").when(inherits, "inherited").otherwise("none").alias("how"),
        F.when(inherits, F.col("holder")).alias("inherited_from"),
    )
