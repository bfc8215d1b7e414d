"""What the pipeline keeps on disk and in the driver's memory."""

from pyspark.sql import functions as F

from pagelens.llm import near_duplicates as nd
from pagelens.llm import toxicity


def test_kept_rows_are_found_without_a_shuffle_of_texts(spark):
    rows = [(n, f"text number {n // 3} of its own kind {'x' * (n // 3)}") for n in range(300)] + [(None, "text number 0 of its own kind ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = nd.deduplicate(df, "doc_id", "text")
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = sorted(r["doc_id"] for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert got == sorted(r[0] for r in nd.near_duplicates(df, "doc_id", "text").select("component_id").distinct().collect())


def test_bitmaps_hold_every_place(spark, monkeypatch):
    numbers = spark.range(5000).select((F.col("id") * 3 + (F.col("id") % 5) * (1 << 33)).alias("nth"))
    some = numbers.filter("hash(nth) % 3 = 0")
    for span in (64, 4096):
        monkeypatch.setattr(nd, "SPAN", span)
        assert sorted(nd._only(numbers, "nth", some).select("nth").collect()) == sorted(some.collect())
    assert nd._only(numbers, "nth", some.limit(0)).count() == 0


def test_training_reads_the_sample_in_pieces(spark, monkeypatch):
    words = "plain words of an ordinary day with trees and rivers".split()
    rows = [(n, " ".join(words[(n * i) % 10] for i in range(1, 40)) + (" nastyword stays" if n % 2 else "")) for n in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = df.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))

    def trained():
        return toxicity.train(df, "doc_id", "text", labels, "doc_id", "toxic")

    whole, sizes, split = trained(), [], toxicity.split_words
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 2000)
    monkeypatch.setattr(toxicity, "split_words", lambda texts, table: sizes.append(sum(len(t) for t in texts.to_pylist())) or split(texts, table))
    pieces = trained()
    assert max(sizes) <= 2000 < sum(sizes)
    assert (pieces.ordinary, pieces.toxic, pieces.chance) == (whole.ordinary, whole.toxic, whole.chance)
