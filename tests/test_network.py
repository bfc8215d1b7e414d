"""The network's trainer against MLlib's, of which it is the sparse form."""

import numpy as np
import pytest
from pyspark import RDD
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from pagelens.operators import models as md
from pagelens.operators import network as nw


def _vectors(spark, folder, n=500, terms=40, classes=3):
    random = np.random.default_rng(7)
    rows = []
    for k in range(n):
        # Some rows are empty, and a class prefers some of the terms.
        chosen = sorted({int(t) for t in (random.integers(0, terms // 2, k % 6) + (k % classes) * 6)})
        rows.append((Vectors.sparse(terms, chosen, random.random(len(chosen)).tolist()), float(k % classes)))
    spark.createDataFrame(rows, ["features", "label_index"]).coalesce(2).write.parquet(folder)
    return spark.read.parquet(folder)


@pytest.mark.parametrize("layers", [(), (9, 5)])
def test_weights_are_those_of_mllib(spark, tmp_path, layers):
    rows, sizes = _vectors(spark, str(tmp_path / "rows")), [40, *layers, 3]
    theirs = MultilayerPerceptronClassifier(layers=sizes, seed=42, maxIter=10, labelCol="label_index", featuresCol="features").fit(rows)
    weights, losses = nw.train_network(rows, sizes, 10)
    assert np.allclose(weights, theirs.weights.toArray(), rtol=1e-6, atol=1e-8)
    assert np.allclose(losses, theirs.summary().objectiveHistory, rtol=1e-9)
    again = nw.as_model(spark, sizes, weights)
    assert np.array_equal(again.weights.toArray(), weights)
    same = again.transform(rows).filter(F.col("label_index") >= 0).select("prediction").collect()
    assert same == theirs.transform(rows).select("prediction").collect()


def test_no_trainer_that_makes_rows_dense_sees_them(spark, monkeypatch):
    seen, fit = [], MultilayerPerceptronClassifier.fit
    monkeypatch.setattr(MultilayerPerceptronClassifier, "fit", lambda self, rows, *a: seen.append(rows.count()) or fit(self, rows, *a))
    texts = [(i, "alpha beta gamma" if i % 2 else "delta epsilon zeta", "odd" if i % 2 else "even") for i in range(60)]
    df = md.with_terms(spark.createDataFrame(texts, "id bigint, text string, y string"), "text", ["the"])
    model = md.train_classifier(df, "y", layers=(6, 4), epochs=3)
    assert max(seen) == 1
    losses = md.history(model)
    assert len(losses) == 4 and losses[-1] < losses[0]
    got = md.predict(model, df, ["id", "y"])
    assert got.count() == 60 and got.filter("predicted IS NULL").count() == 0
    seen.clear()
    md.training_history(df, df, "y", layers=(4,), epochs=2)
    assert max(seen) == 1


def test_gradients_are_as_many_as_cores(spark, tmp_path, monkeypatch):
    _vectors(spark, str(tmp_path / "rows")).repartition(40).write.parquet(str(tmp_path / "many"))
    rows, seen, tree = spark.read.parquet(str(tmp_path / "many")).repartition(40), [], RDD.treeReduce
    monkeypatch.setattr(RDD, "treeReduce", lambda self, *a: seen.append(self.getNumPartitions()) or tree(self, *a))
    losses = nw.train_network(rows, [40, 5, 3], 2)[1]
    assert len(losses) == 3 and losses[-1] < losses[0]
    assert max(seen) <= spark.sparkContext.defaultParallelism
