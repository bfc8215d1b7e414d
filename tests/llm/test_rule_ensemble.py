"""The rule ensemble: statistics by hand, paths against the trees' own predictions, scores against plain arithmetic, held-out accuracy."""

import math
import re

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from pagelens.llm import catalog, rule_ensemble
from pagelens.llm.catalog import ENTRIES

SCHEMA = "doc_id bigint, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_statistics(text):
    words = WORD.findall(text or "")
    n, chars = len(words), sum(map(len, words))
    per = lambda x, by: x / by if by else 0.0
    count = lambda p: len(re.findall(p, text or ""))
    return {
        "words": n, "longest_word": max(map(len, words), default=0), "word_length": per(chars, n), "symbols_per_word": per(count(r"[#*$%&|<>]"), n),
        "marks_per_word": per(count("[!?]"), n), "stops_per_word": per(count("[.,;:]"), n), "digits_per_char": per(count("[0-9]"), chars),
        "capitals_per_char": per(sum(c.isupper() for c in text or ""), chars), "other_per_char": per(count(r"[^\x00-\x7F]"), chars),
        "distinct_words": per(len(set(words)), n),
    }


def test_statistics_and_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "The CAT, sat! 12 é É #\n\nThe CAT"), (4, "The CAT, sat! 12 é É #\n\nThe CAT"), (None, "x " * 50_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("9") for c in ("row", "words", "score", "n_words", "w", "t")})
    got = rule_ensemble.with_statistics(df, "text").collect()
    assert len(got) == len(rows)
    for r in got:
        for name, value in plain_statistics(r["row"]["text"]).items():
            assert r[name] == pytest.approx(value), name
    assert rule_ensemble.with_statistics(df.limit(0), "text").count() == 0


@pytest.fixture(scope="module")
def measures(spark):
    return catalog.quality_statistics(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_paths_are_those_of_the_trees(spark, measures):
    """A row falls on exactly one leaf path of each tree, so leaf rules partition the rows as the tree does."""
    rows = measures.withColumn("y", (F.col("words") % 2).cast("double"))
    vectors = VectorAssembler(inputCols=list(rule_ensemble.STATISTICS), outputCol="features").transform(rows)
    forest = RandomForestClassifier(labelCol="y", numTrees=3, maxDepth=3, seed=1).fit(vectors)
    for tree in forest.trees:
        rules = rule_ensemble.paths([tree], rule_ensemble.STATISTICS)
        assert rules and all(1 <= len(r.bounds) <= 3 for r in rules)
        root = [r for r in rules if len(r.bounds) == 1 and str(r)]
        low, high = root[0], next(r for r in root if r.bounds[0][1] == root[0].bounds[0][2] or r.bounds[0][2] == root[0].bounds[0][1])
        assert measures.filter(low.holds() == high.holds()).count() == 0


def test_score_is_the_logistic_sum_of_the_rules_that_hold(spark, measures):
    a = rule_ensemble.Rule((("words", 10.0, float("inf")), ("symbols_per_word", float("-inf"), 0.1)))
    b = rule_ensemble.Rule((("words", 20.0, 300.0),))
    model = rule_ensemble.Model(-0.5, ((a, 1.25), (b, -2.0)))
    assert str(a) == "10 < words and symbols_per_word <= 0.1" and str(b) == "20 < words <= 300"
    for r in rule_ensemble.with_scores(measures, model).limit(200).collect():
        total = -0.5 + 1.25 * (r.words > 10 and r.symbols_per_word <= 0.1) - 2.0 * (20 < r.words <= 300)
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)))


def test_labels_that_teach_nothing(spark, measures):
    train = lambda rows: rule_ensemble.train(measures, "doc_id", spark.createDataFrame(rows, "doc_id bigint, quality int"), "doc_id", "quality")
    for rows, wanted in (([], 0.5), ([(None, 1), (3, None), (4, 7)], 0.5), ([(1, 1), (2, 1)], 1.0), ([(1, 0)], 0.0), ([(1, 0), (1, 1)], 0.5)):
        model = train(rows)
        assert model.constant == wanted
        assert rule_ensemble.with_scores(measures, model).select("score").distinct().collect() == [(wanted,)]
    two = train([(i, i % 2) for i in range(40)] * 2)
    assert all(0 <= r.score <= 1 for r in rule_ensemble.with_scores(measures, two).collect())


def test_sample_is_bounded_and_one_row_a_key(spark, measures):
    labels = spark.createDataFrame([(i, i % 2) for i in range(900)] * 2, "doc_id bigint, quality int")
    rows = rule_ensemble.training_rows(measures.union(measures), "doc_id", labels, "doc_id", "quality", 100)
    assert 50 < rows.count() < 150
    assert rule_ensemble.training_rows(measures.union(measures), "doc_id", labels, "doc_id", "quality", 1000).count() == 900


def test_op12_separates_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    scored = {e.name: e for e in ENTRIES}["op12_rule_ensemble"].run(spark, folder)
    rows = scored.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert good and bad
    assert sum(r.predicted for r in good) >= 0.97 * len(good) and sum(r.predicted for r in bad) <= 0.15 * len(bad)
    assert all(0 <= r.score <= 1 for r in rows)
    assert scored.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
