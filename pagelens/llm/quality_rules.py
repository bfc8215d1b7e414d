"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

A rule bounds a measure from below, from above or both; a text is kept if it fails none.
Measures are ratios and lengths over the words of the whole text; those of counts that the
base check needs are columns as well. Everything is an expression over one row: no shuffle.

Repeated word windows are found in two steps, so that most texts pay for the first only: 64-bit
hashes of the windows are compared as sets, and where a hash occurs twice the windows
themselves are sorted and compared, so no collision can change a count.

Results for odd input: a null or wordless text has no words, all counts 0 and ratios 0, and
fails the base check; repeated rows are judged each, and equal texts equally; an empty table gives an empty result; a very
long text is measured whole within its row; columns of any name are kept in `row`, so none can clash; a bound on a measure that
is not known is an error.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 5
# Splitting at a plain blank is several times faster than at a pattern.
OTHER_BLANKS = r"[\t-\r]"
WORD = r"[^ \t-\r]"
SYMBOLS = "#*$%&|<>"
LETTERS, LATIN, MARKS = r"\p{L}\p{M}", "A-Za-z", ".,;:!?"
#: Prose has a sentence mark in so many words or fewer.
SENTENCE_WORDS = 40
#: Common words of the languages served: plain values, all in lower case.
STOP_WORDS = (
    "the of and to in a is that for on are with as by at or an be this from was it "
    "der die das und in von zu den mit ist auf für ein eine im dem nicht des sich als "
    "le la les de des et en un une du dans est que qui pour par sur au pas avec "
    "el la los las de del y en un una que se por con para es no lo su al"
).split()


@dataclass(frozen=True)
class Rule:
    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: Production thresholds. On the labelled rows of sf0.1 that pass the base check, good texts have no symbols (bad ones mostly 0.4
#: and more a word) and up to 0.33 repeated lines (bad ones 0.25). A text in a language without a listed word has no stop word
#: either, so that rule lets prose be: mostly letters, with sentence marks or in another script than the listed languages'.
RULES = (
    Rule("too_short", "n_words", least=10),
    Rule("too_long", "n_words", most=100_000),
    Rule("short_words", "mean_word_chars", least=1.5),
    Rule("long_words", "mean_word_chars", most=25),
    Rule("symbols", "symbols_per_word", most=0.2),
    Rule("no_stop_words", "words_without_stop_word", most=25),
    Rule("repeated_lines", "duplicate_line_ratio", most=0.5),
    Rule("repeated_words", "repeated_word_ratio", most=0.2),
)


def measured(df: DataFrame, text: str, stop_words: Iterable[str] = STOP_WORDS) -> DataFrame:
    """`df` as struct `row`, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words, no_prose."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), body.alias("t"))
    out = out.select(
        "row", "t", F.filter(F.split(F.regexp_replace("t", OTHER_BLANKS, " "), " "), lambda x: x != "").alias("words"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)).alias("lines"),
    )
    words, n = F.col("words"), F.size("words")
    every = F.sequence(F.lit(0), n - WINDOW)
    hashed = F.transform(every, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    out = out.select(
        "row", "t", "words", "lines", n.cast("bigint").alias("n_words"),
        F.when(n > WINDOW, hashed).otherwise(F.array().cast("array<bigint>")).alias("hashes"),
    )
    joined = lambda i: F.array_join(F.slice(words, i + 1, WINDOW), " ")
    windows = F.sort_array(F.transform(every, lambda i: F.struct(joined(i).alias("text"), i.alias("at"))))
    none = F.array().cast("array<struct<text:string,at:int>>")
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    # Each step is a column of its own: inside a lambda an expression would be evaluated once for each element.
    out = out.withColumn("windows", F.when(repeats, windows).otherwise(none)).drop("hashes")
    same = lambda i, w: F.get(F.col("windows"), i)["text"].eqNullSafe(w["text"])
    out = out.withColumn(
        "places",
        F.sort_array(
            F.array_compact(
                F.transform("windows", lambda w, i: F.when(same(i - 1, w) | same(i + 1, w), w["at"]))
            )
        ),
    )
    # Each window adds the words up to the next one; the last adds all of its words.
    step = F.transform(
        "places", lambda p, i: F.least(F.coalesce(F.get(F.col("places"), i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))
    )
    out = out.select(
        "row",
        "t",
        "n_words",
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("t", f"[^{SYMBOLS}]+", "")).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.aggregate(step, F.lit(0), lambda s, g: s + g).cast("bigint").alias("n_repeat_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.size(F.filter(words, lambda w: F.lower(w).isin(*sorted(set(stop_words))))).cast("bigint").alias("n_stop_words"),
    )
    number = lambda signs: F.length(F.regexp_replace("t", f"[^{signs}]+", ""))
    prose = (2 * number(LETTERS) >= F.col("word_chars")) & (
        (SENTENCE_WORDS * number(MARKS) >= F.col("n_words")) | (2 * number(LATIN) < number(LETTERS))
    )
    # Only texts without a stop word are looked at again.
    return out.select(*[c for c in out.columns if c != "t"], F.when(F.col("n_stop_words") == 0, ~prose).otherwise(False).alias("no_prose"))


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b).cast("double")).otherwise(F.lit(0.0))


def measures() -> dict[str, Column]:
    """Every measure that a rule may bound, over the columns of `measured`."""
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word_chars": _ratio("word_chars", "n_words"),
        "symbols_per_word": _ratio("n_symbols", "n_words"),
        "stop_word_ratio": _ratio("n_stop_words", "n_words"),
        # The length of a text that has none at all and is no prose: a short text, or prose in another language, may well have none.
        "words_without_stop_word": F.when(F.col("no_prose"), F.col("n_words")).otherwise(0).cast("double"),
        "duplicate_line_ratio": _ratio("n_dup_lines", "n_lines"),
        "repeated_word_ratio": _ratio("n_repeat_words", "n_words"),
    }


def failed(rules: Iterable[Rule]) -> Column:
    """Names of the rules that a text fails, in the table's order."""
    known = measures()
    broken = []
    for rule in rules:
        if rule.measure not in known:
            raise ValueError(f"rule {rule.name}: no measure {rule.measure!r}")
        value, bad = known[rule.measure], F.lit(False)
        if rule.least is not None:
            bad = bad | (value < F.lit(float(rule.least)))
        if rule.most is not None:
            bad = bad | (value > F.lit(float(rule.most)))
        broken.append(F.when(bad, F.lit(rule.name)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def judged(df: DataFrame, text: str, rules: Iterable[Rule] = RULES, stop_words: Iterable[str] = STOP_WORDS) -> DataFrame:
    """`row`, the counts, failed (rule names), base_failed and kept for each row of `df`."""
    out = measured(df, text, stop_words)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = out.withColumns({"failed": failed(rules), "base_failed": base})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def _sql() -> str:
    """The same judgement of `documents` with the production rules in ANSI SQL."""
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    bounds = []
    for r in RULES:
        bad = [f"{r.measure} < {r.least!r}"] if r.least is not None else []
        bad += [f"{r.measure} > {r.most!r}"] if r.most is not None else []
        bounds.append(f"CASE WHEN {' OR '.join(bad)} THEN '{r.name}' END")
    return f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0b\\x0c\\r]+') AS words FROM documents
), x AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w
), win AS (
  SELECT doc_id, i, word || ' ' || lead(word, 1) OVER p || ' ' || lead(word, 2) OVER p || ' ' || lead(word, 3) OVER p
    || ' ' || lead(word, 4) OVER p AS five FROM x WINDOW p AS (PARTITION BY doc_id ORDER BY i)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS n FROM win WHERE five IS NOT NULL) WHERE n > 1
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest([0, 1, 2, 3, 4]) AS u(k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w
), kept_lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM lines
  WHERE regexp_matches(line, '[^ \\t\\n\\x0b\\x0c\\r]') GROUP BY doc_id
), stops AS (
  SELECT doc_id, count(*) AS n FROM x WHERE lower(word) IN ({stops}) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    length(regexp_replace(t, '[^{LETTERS}]', '', 'g')) AS n_letters, length(regexp_replace(t, '[^{LATIN}]', '', 'g')) AS n_latin,
    length(regexp_replace(t, '[^{MARKS}]', '', 'g')) AS n_marks, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(stops.n, 0) AS n_stop_words
  FROM w LEFT JOIN kept_lines USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN stops USING (doc_id)
), r AS (
  SELECT *, CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0.0 END AS mean_word_chars,
    CASE WHEN n_words > 0 THEN n_symbols::DOUBLE / n_words ELSE 0.0 END AS symbols_per_word,
    CASE WHEN n_words > 0 THEN n_stop_words::DOUBLE / n_words ELSE 0.0 END AS stop_word_ratio,
    CASE WHEN n_stop_words = 0 AND NOT (2 * n_letters >= word_chars AND ({SENTENCE_WORDS} * n_marks >= n_words OR 2 * n_latin < n_letters))
      THEN n_words ELSE 0 END AS words_without_stop_word,
    CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0.0 END AS duplicate_line_ratio,
    CASE WHEN n_words > 0 THEN n_repeat_words::DOUBLE / n_words ELSE 0.0 END AS repeated_word_ratio,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND failed_rules = '' AS kept, failed_rules
FROM (SELECT *, concat_ws(',', {", ".join(bounds)}) AS failed_rules FROM r)
"""


SQL = _sql()
