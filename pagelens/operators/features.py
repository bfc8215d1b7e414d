"""TF-IDF features as a long table, and pair similarity over it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions.arrays import let
from pagelens.functions.text import ngram_terms, with_bigrams
from pagelens.session import written

MAX_TERMS = 5_000


#: Words that may be broadcast to find their pairs.
LISTED_WORDS = 50_000


def frequent_terms(df: DataFrame, max_terms: int, max_df: float = 0.95, spare: int = 1000, paired: bool = False) -> list[str]:
    """The `max_terms` most frequent `terms` that are in a share of `max_df` of the rows at most, equal counts by name.

    With `paired` each row's terms are its words and their pairs (see `with_bigrams`). A pair is counted no more often than
    either of its words, so pairs are counted only if both are as frequent as the last word that could be listed.

    Terms are counted by a columnar aggregate, which spills and spreads over all shuffle partitions. Only a term that is
    counted more often than that many rows can be in more of them, so rows are counted for those few terms alone.
    """
    most = max_df * df.count()

    def exploded(terms: Column) -> DataFrame:
        return df.select(F.explode(terms).alias("word"))

    def counted(rows: DataFrame) -> DataFrame:
        return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n"))

    def with_pairs(least: int) -> DataFrame:
        """Counts of the words, and of the pairs of words that are counted `least` times or more."""
        able = written(single.filter(F.col("n") >= least).select("word"), "able")
        if able.limit(LISTED_WORDS + 1).count() > LISTED_WORDS:
            return counted(exploded(F.col("terms")))
        both = exploded(F.filter("terms", lambda t: t.contains(" ")))
        for k in (1, -1):
            side = able.withColumnRenamed("word", "side")
            both = both.withColumn("side", F.substring_index("word", " ", k)).join(F.broadcast(side), "side", "left_semi")
        return single.union(counted(both.select("word")))

    totals = counted(exploded(F.col("terms")))
    single = written(counted(exploded(F.filter("terms", lambda t: ~t.contains(" ")))), "word-counts") if paired else None
    while True:
        if paired:
            last = single.orderBy(F.desc("n")).limit(max_terms + spare).agg(F.count(F.lit(1)), F.min("n")).first()
            totals = with_pairs(last[1] if last[0] == max_terms + spare else 0)
        top = totals.orderBy(F.desc("n"), "word").limit(max_terms + spare).collect()
        often = [r["word"] for r in top if r["n"] > most]
        found = df.select(F.explode(F.array_intersect("terms", F.split(F.lit("\u0001".join(often)), "\u0001"))).alias("word")).groupBy("word").count()
        banned = {r["word"] for r in found.filter(F.col("count") > most).collect()} if often else set()
        words = [r["word"] for r in top if r["word"] not in banned]
        if len(words) >= max_terms or len(top) < max_terms + spare:
            return words[:max_terms]
        spare = 4 * spare + 100


@dataclass(frozen=True)
class Weights:
    """TF-IDF rows as sparse arrays: `rows` has (key, indices ascending, weights of unit length) of every document."""

    rows: DataFrame
    words: list[str]  # at most `max_terms`, by index
    scratch: tuple[DataFrame, ...] = ()  # what `rows` are read from, and before


def tfidf_rows(df: DataFrame, key: str, text: str, stop_words: Sequence[str], max_terms: int = MAX_TERMS) -> Weights:
    """M1: the texts are split once, and only counts of listed terms are written; weighing and scaling stay inside each row."""
    words = written(df.select(key, ngram_terms(F.col(text), stop_words).alias("words")), "words")
    # Pairs of words are made where they are read: written, they would take several times the text.
    paired = F.coalesce(F.get(F.transform(F.array("words"), with_bigrams), F.lit(0)), F.array().cast("array<string>"))  # none for a null text
    terms = words.select(key, paired.alias("terms"))
    listed = sorted(frequent_terms(terms, max_terms, paired=True))
    if not listed:
        return Weights(words.select(key, F.array().cast("array<int>").alias("indices"), F.array().cast("array<double>").alias("weights")), [])
    counter = CountVectorizerModel.from_vocabulary(listed, inputCol="terms", outputCol="counts")
    counted = written(counter.transform(terms).select(key, "counts"), "counts")
    held = counted.select(F.explode(F.unwrap_udt("counts")["indices"]).alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("df"))
    smoothed = F.log((F.lit(1.0) + F.lit(float(counted.count()))) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    idf = dict(held.select("i", smoothed.alias("idf")).collect())
    weigh = ElementwiseProduct(scalingVec=Vectors.dense([idf[i] for i in range(len(listed))]), inputCol="counts", outputCol="weighed")
    scaled = Normalizer(inputCol="weighed", outputCol="scaled").transform(weigh.transform(counted))
    vector = scaled.select(key, F.unwrap_udt("scaled").alias("v"))
    return Weights(vector.select(key, F.col("v.indices").alias("indices"), F.col("v.values").alias("weights")), listed, (words, counted))


def tfidf(df: DataFrame, key: str, text: str, stop_words: Sequence[str], max_terms: int = MAX_TERMS) -> DataFrame:
    """M1: (key, word, weight) with rows of unit length; the vocabulary is bounded, and no row is shuffled."""
    found = tfidf_rows(df, key, text, stop_words, max_terms)
    names = F.split(F.lit("\u0001".join(found.words)), "\u0001")  # one constant
    flat = found.rows.select(key, F.explode(F.arrays_zip("indices", "weights")).alias("x"))
    return flat.select(key, F.get(names, F.col("x.indices")).alias("word"), F.col("x.weights").alias("weight"))


def sparse_dot(a: str, wa: str, b: str, wb: str) -> Column:
    """Dot product of two sparse rows: both lists sorted together, neighbours of one index multiplied."""

    def side(i: str, w: str) -> Column:
        return F.transform(F.arrays_zip(F.col(i).alias("i"), F.col(w).alias("w")), lambda x: F.struct(x["i"].alias("i"), x["w"].alias("w")))

    def products(both: Column) -> Column:
        after = F.slice(both, 2, F.greatest(F.size(both) - 1, F.lit(0)))
        return F.aggregate(
            F.zip_with(after, both, lambda x, y: F.when(x["i"] == y["i"], x["w"] * y["w"]).otherwise(F.lit(0.0))),
            F.lit(0.0),
            # zip_with pads the shorter list with a null.
            lambda s, x: s + F.coalesce(x, F.lit(0.0)),
        )

    return let(F.sort_array(F.concat(side(a, wa), side(b, wb))), products)


def pair_cosine(weights: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """M6: cosine of given pairs (a, b) over unit rows: one equi-join on pair side and term."""
    left = pairs.join(weights.select(F.col(key).alias("a"), "word", F.col("weight").alias("wa")), "a")
    both = left.join(weights.select(F.col(key).alias("b"), "word", F.col("weight").alias("wb")), ["b", "word"])
    dots = both.groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    return pairs.join(dots, ["a", "b"], "left").select(
        "a", "b", F.round(F.coalesce("dot", F.lit(0.0)), 6).alias("cosine")
    )
