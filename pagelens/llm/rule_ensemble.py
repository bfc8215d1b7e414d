"""Quality as a sparse ensemble of rules over text statistics.

One projection turns each whole text into statistics (lengths, ratios of symbols, capitals, stop words, repeats). A forest of
shallow trees is grown on the labelled rows; every path from a root to a node below it is a rule, a conjunction of bounds on statistics.
Logistic regression with a lasso penalty weighs the rules, and most weights become zero. What is left is compiled into one Spark
expression: a sum of CASE terms in a logistic function. Statistics are written once; training and scoring read numbers only.

Training reads at most about `sample` labelled keys, chosen by a hash of the key (one in labelled / sample of them, none left
out while there are fewer); everything else covers all rows. Forest and regression are distributed jobs over that sample.

Results for odd input: null, empty and wordless texts have statistics of 0 and are scored like any other; very long texts are
measured whole; repeated rows are scored each and train once; labels other than 0 and 1, null keys, and keys with both labels are not learned
from; with no labels every score is 0.5, with one class the share of label 1; equal statistics get equal scores, so
ties stay ties; an empty table gives an empty result; other columns travel in the struct `row`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.llm.quality_rules import measured
from pagelens.session import bounded_broadcast, scratch_path

SAMPLE = 20_000
TREES, DEPTH = 16, 3
#: Weight of the lasso penalty.
PENALTY = 0.001
ITERATIONS = 60
SEED = 17

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words"]
#: Counts of characters: what is left of a text when these are taken out.
LEFT_WITHOUT = {"n_capitals": r"\P{Lu}+", "n_digits": r"\P{Nd}+", "n_marks": "[^!?]+", "n_stops": "[^.,;:]+", "n_other": r"[\x00-\x7F]+"}


#: Statistics by name: a count, and the count it is divided by.
RATIOS = {
    "words": ("n_words", None), "longest_word": ("n_longest", None), "word_length": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"), "marks_per_word": ("n_marks", "n_words"), "stops_per_word": ("n_stops", "n_words"),
    "capitals_per_char": ("n_capitals", "word_chars"), "digits_per_char": ("n_digits", "word_chars"), "other_per_char": ("n_other", "word_chars"),
    "stop_word_ratio": ("n_stop_words", "n_words"), "distinct_words": ("n_distinct", "n_words"), "repeated_words": ("n_repeat_words", "n_words"),
    "duplicate_lines": ("n_dup_lines", "n_lines"), "words_per_line": ("n_words", "n_lines"),
}
STATISTICS = tuple(RATIOS)


def ratio(count: str, by: str | None) -> Column:
    value = F.col(count).cast("double")
    return value if by is None else F.when(F.col(by) > 0, value / F.col(by)).otherwise(F.lit(0.0))


def with_statistics(df: DataFrame, text: str) -> DataFrame:
    """`df` as struct `row`, and one column for each of STATISTICS: a projection of the whole text."""
    body = F.coalesce(F.col(f"row.`{text}`"), F.lit(""))
    chars = [F.length(F.regexp_replace(body, pattern, "")).alias(n) for n, pattern in LEFT_WITHOUT.items()]
    words = F.filter(F.split(F.regexp_replace(body, r"[\t-\r]", " "), " "), lambda w: w != "")
    out = measured(df, text).select("row", *COUNTS, *chars, words.alias("w"))
    longest = F.coalesce(F.array_max(F.transform("w", F.length)), F.lit(0))
    out = out.select("row", *COUNTS, *LEFT_WITHOUT, F.size(F.array_distinct("w")).alias("n_distinct"), longest.alias("n_longest"))
    return out.select("row", *[ratio(*x).alias(n) for n, x in RATIOS.items()])


@dataclass(frozen=True)
class Rule:
    """Holds if every statistic named is above its lower bound and not above its upper one."""

    bounds: tuple[tuple[str, float, float], ...]  # (statistic, above, at most)

    def holds(self) -> Column:
        out = F.lit(True)
        for name, above, most in self.bounds:
            if above > float("-inf"):
                out = out & (F.col(name) > F.lit(above))
            if most < float("inf"):
                out = out & (F.col(name) <= F.lit(most))
        return out

    def __str__(self) -> str:
        return " and ".join((f"{a:.4g} < " if a > float("-inf") else "") + n + (f" <= {b:.4g}" if b < float("inf") else "") for n, a, b in self.bounds)


@dataclass(frozen=True)
class Model:
    """A few dozen rules at most, whatever the corpus."""

    intercept: float
    weights: tuple[tuple[Rule, float], ...] = ()
    constant: float | None = None

    def score(self) -> Column:
        if self.constant is not None:
            return F.lit(self.constant)
        total = F.lit(self.intercept)
        for rule, weight in self.weights:
            total = total + F.when(rule.holds(), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def paths(trees: Sequence, names: Sequence[str]) -> list[Rule]:
    """Every distinct path from a root to a node below it; bounds on one statistic are merged."""
    found: dict[Rule, None] = {}

    def walk(node, bounds: dict[str, tuple[float, float]]) -> None:
        if bounds:
            found[Rule(tuple((n, *b) for n, b in sorted(bounds.items())))] = None
        if node.getClass().getSimpleName() != "InternalNode":
            return
        split = node.split()
        name, at = names[split.featureIndex()], float(split.threshold())
        low, high = bounds.get(name, (float("-inf"), float("inf")))
        walk(node.leftChild(), {**bounds, name: (low, min(high, at))})
        walk(node.rightChild(), {**bounds, name: (max(low, at), high)})

    for tree in trees:
        walk(tree._call_java("rootNode"), {})
    return list(found)


def training_rows(measures: DataFrame, key: str, labels: DataFrame, label_key: str, label: str, sample: int) -> DataFrame:
    """(y, statistics) of the sampled labelled keys, written to the shared folder."""
    spark = measures.sparkSession
    marks = labels.filter(F.col(label).isin(0, 1) & F.col(label_key).isNotNull()).groupBy(F.col(label_key).alias("key")).agg(
        F.min(label).cast("double").alias("y"), F.max(label).cast("double").alias("other")
    )
    path = scratch_path(spark, "marks")
    marks.filter("y = other").select("key", "y").write.parquet(path)
    marks = spark.read.schema("key " + marks.schema["key"].dataType.simpleString() + ", y double").parquet(path)
    total = max(marks.count(), 1)
    chosen = marks.filter(F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(total)) < sample)
    own = measures.select(F.col(key).alias("key"), F.struct(*STATISTICS).alias("s"))
    # One row a key, so copies of a labelled row weigh no more than others.
    rows = own.join(bounded_broadcast(chosen), "key").groupBy("key", "y").agg(F.min("s").alias("s")).select("y", "s.*")
    path = scratch_path(spark, "training")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def train(
    measures: DataFrame, key: str, labels: DataFrame, label_key: str, label: str, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH,
    penalty: float = PENALTY,
) -> Model:
    """Learn from `labels`; `measures` has the column `key` and STATISTICS, and should be cheap to read again."""
    rows = training_rows(measures, key, labels, label_key, label, sample)
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(counts) < 2:
        return Model(0.0, constant=next((float(y) for y in counts), 0.5))
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="features")
    forest = RandomForestClassifier(
        labelCol="y", numTrees=trees, maxDepth=depth, maxBins=64, minInstancesPerNode=5, featureSubsetStrategy="onethird", subsamplingRate=0.8, seed=SEED
    ).fit(vectors.transform(rows).select("y", "features"))
    rules = paths(forest.trees, STATISTICS)
    if not rules:
        return Model(0.0, constant=counts[1.0] / sum(counts.values()))
    marked = rows.select("y", *[F.when(r.holds(), 1.0).otherwise(0.0).alias(f"r{i}") for i, r in enumerate(rules)])
    listed = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(marked).select("y", "features")
    lasso = LogisticRegression(labelCol="y", elasticNetParam=1.0, regParam=penalty, maxIter=ITERATIONS).fit(listed)
    weights = tuple((rules[i], float(w)) for i, w in enumerate(lasso.coefficients.toArray()) if w)
    return Model(float(lasso.intercept), weights)


def with_scores(measures: DataFrame, model: Model) -> DataFrame:
    """`measures` and its `score`, the probability of label 1."""
    return measures.withColumn("score", model.score())
