"""Formulas on English sentences with values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from pagelens import seeds
from pagelens.functions import quality
from pagelens.functions import text as T
from pagelens.operators import entities as ents
from pagelens.operators import keywords as kw
from pagelens.operators import lexicon as lx
from pagelens.operators import prompts as pr

STOP = seeds.STOP_WORDS["en"]


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")


def test_cleaning_orders(one):
    raw = "See https://a.org/x?y=1 or  mail me@x.org\n#now!"
    clean = one(lambda f: T.clean_text(f.col("x")), raw)
    assert "a.org" not in clean and "x.org" not in clean and clean.endswith("now!")
    parity = one(lambda f: T.clean_text(f.col("x"), "reference"), raw)
    assert "a.org" in parity and "x.org" in parity


@pytest.mark.parametrize(
    "word,n", [("the", 1), ("queue", 1), ("style", 1), ("rhythm", 1), ("banana", 3), ("make", 1), ("readable", 2), ("nth", 1), ("be", 1)]
)
def test_syllables(one, word, n):
    assert one(lambda f: T.syllable_total(f.split(f.col("x"), " ")), word) == n
    assert one(lambda f: T.syllable_total(f.split(f.col("x"), " ")), f"{word} {word}") == 2 * n


def test_statistics(spark):
    row = T.add_statistics(docs(spark, "The cat sat. The cat ran!\n\nDone."), "text", STOP).first()
    assert row["word_count"] == 10 and row["sentence_count"] == 3
    assert row["paragraph_count"] == 2 and row["paragraph_count_parity"] == 1
    assert row["content_word_count"] == 5 and row["unique_words"] == 4
    assert row["lexical_diversity"] == 0.8
    assert row["avg_words_per_sentence"] == 10 / 3


def test_statistics_of_empty_text(spark):
    row = T.add_statistics(docs(spark, ""), "text", STOP).first()
    assert row["word_count"] == 0 and row["lexical_diversity"] == 0.0 and row["avg_chars_per_word"] == 0.0


def test_readability(spark):
    rows = T.add_readability(docs(spark, "The cat sat. The cat ran.", "..."), "text").orderBy("id").collect()
    asl, asw = 8 / 2, 6 / 8
    assert math.isclose(rows[0]["flesch_reading_ease"], 206.835 - 1.015 * asl - 84.6 * asw)
    assert math.isclose(rows[0]["flesch_kincaid_grade"], 0.39 * asl + 11.8 * asw - 15.59)
    assert rows[0]["reading_level"] == "Very Easy"
    assert rows[1]["flesch_reading_ease"] is None and rows[1]["reading_level"] is None


def test_reading_bands(spark):
    scores = spark.createDataFrame([(x,) for x in (95.0, 90.0, 89.9, 75.0, 65.0, 55.0, 30.0, 29.9, None)], "s double")
    got = [r[0] for r in scores.select(T.reading_level(F.col("s"))).collect()]
    assert got == [
        "Very Easy", "Very Easy", "Easy", "Fairly Easy", "Standard", "Fairly Difficult", "Difficult", "Very Difficult", None,
    ]


def test_display_statistics(spark):
    row = T.add_display_statistics(docs(spark, "Big big dog, ran. Yes!"), "text").first()
    assert row["word_count"] == 5 and row["sentence_count"] == 2 and row["unique_words"] == 1
    assert row["readability_score"] == max(0, min(100, 206.835 - 1.015 * 2.5 - 84.6 * (18 / 5) / 2))


def test_frequent_words_ties_by_first_occurrence(spark):
    rows = kw.frequent_words(docs(spark, "zebra apple zebra apple mango the the the"), "id", "text", STOP, 2).collect()
    assert [(r["rank"], r["word"], r["n"]) for r in sorted(rows)] == [(1, "zebra", 2), (2, "apple", 2)]


def test_tfidf_keywords(spark):
    rows = kw.tfidf_keywords(docs(spark, "red fox. red dog.", "single sentence only"), "id", "text", STOP).collect()
    assert {r["id"] for r in rows} == {0}
    idf1, idf2 = math.log(3 / 3) + 1, math.log(3 / 2) + 1
    norm = math.sqrt(idf1**2 + 2 * idf2**2)
    got = {r["word"]: r["score"] for r in rows}
    assert got["red"] == pytest.approx(idf1 / norm, abs=1e-6)
    assert got["red fox"] == got["fox"] == pytest.approx(idf2 / norm / 2, abs=1e-6)


def test_summary_bounds(spark):
    long = ". ".join(f"topic number {i} words repeat words again topic" for i in range(60)) + "."
    row = kw.summaries(docs(spark, long, "short text"), "id", "text", STOP).collect()
    assert len(row) == 1 and 30 <= len(row[0]["summary"].split()) <= 150
    assert row[0]["compression_ratio"] == row[0]["summary_length"] / row[0]["original_length"]


def test_sentiment_join_equals_row_form(spark):
    df = docs(spark, "good good bad thing", "terrible awful", "plain words", "")
    lexicon = seeds.table(spark, seeds.SENTIMENT, "word string, valence double, polarity double, subjectivity double")
    joined = {r["id"]: r for r in lx.sentiment(df, "id", "text", lexicon).collect()}
    rows = {r["id"]: r["compound"] for r in lx.add_compound(df, "text", seeds.SENTIMENT).collect()}
    assert {k: v["compound"] for k, v in joined.items()} == rows
    assert rows[0] == 1.5 / math.sqrt(1.5**2 + 15)
    assert [joined[i]["overall"] for i in range(4)] == ["positive", "negative", "neutral", "neutral"]
    assert joined[0]["pos"] + joined[0]["neg"] + joined[0]["neu"] == pytest.approx(1)


def test_sentiment_bounds(spark):
    df = spark.createDataFrame([(0.05,), (-0.05,), (0.0,)], "c double")
    got = df.select(lx.overall_label(F.col("c")), lx.overall_label(F.col("c"), strict=True)).collect()
    assert [tuple(r) for r in got] == [("positive", "neutral"), ("negative", "neutral"), ("neutral", "neutral")]


def test_categories(spark):
    df = docs(spark, "the game was a match", "software and market", "nothing here")
    got = {r["id"]: r for r in lx.token_categories(df, "id", "text", seeds.TOKEN_CATEGORIES).collect()}
    assert got[0]["predicted_category"] == "sports" and got[0]["confidence"] == 2 / 3
    assert got[1]["predicted_category"] == "technology" and got[1]["confidence"] == 0.5
    assert got[2]["predicted_category"] == "general"
    display = {r["id"]: r for r in lx.add_substring_category(df, "text", seeds.SUBSTRING_CATEGORIES).collect()}
    assert display[2]["category"] == "technology" and display[2]["keyword_matches"] == 0
    assert display[0]["category"] == "sports" and display[0]["category_confidence"] == 1.0


def test_language(spark):
    df = docs(spark, "le chat est dans la maison", "zzz", "the house and the dog " * 10)
    got = {r["id"]: (r["language"], r["confidence"]) for r in lx.language(df, "id", "text", seeds.STOP_WORDS).collect()}
    assert got == {0: ("fr", 0.6), 1: ("en", 0.5), 2: ("en", 0.8)}


def test_emotions(spark):
    rows = lx.emotions(docs(spark, "happy happy fear", "none"), "id", "text", seeds.EMOTIONS).collect()
    shares = {r["emotion"]: r["share"] for r in rows}
    assert {r["id"] for r in rows} == {0} and shares["joy"] == 2 / 3 and sum(shares.values()) == pytest.approx(1)
    assert rows[0]["dominant"] == "joy"


def test_entities(spark):
    text = "Mail Ann Lee at a.b@c.org on 2024-01-02, pay $5.50 in Paris"
    rows = ents.entities(docs(spark, text), "id", "text", seeds.GAZETTEER).collect()
    found = {(r["label"], r["text"]) for r in rows}
    assert {("EMAIL", "a.b@c.org"), ("DATE", "2024-01-02"), ("MONEY", "$5.50"), ("GPE", "paris")} <= found
    for r in ents.entity_offsets(docs(spark, text), "id", "text").collect():
        assert text[r["start"] : r["end"]] == r["text"]


@pytest.mark.parametrize("words,score", [(0, 0.0), (150, 0.5), (299, 299 / 300), (300, 1.35), (999, 1.0005), (1000, 1.0), (3000, 0.5)])
def test_length_factor(spark, words, score):
    df = spark.createDataFrame([(words,)], "w bigint")
    row = df.select(quality.length_factor(F.col("w")), quality.length_factor(F.col("w"), capped=True)).first()
    assert row[0] == pytest.approx(score) and row[1] == pytest.approx(min(score, 1.0))


def test_job_quality(spark):
    text = "word " * 14 + "word."
    df = docs(spark, text, "no marks here")
    cols = quality.job_quality(F.col("text"), F.lit(-0.5), F.lit(0.8))
    a, b = df.select("id", *[c.alias(n) for n, c in cols.items()]).orderBy("id").collect()
    f1 = min(len(text) / 1000, 1) * 0.2
    assert a["quality_weighted"] == pytest.approx(f1 + 0.3 + 0.1 + 0.24)
    assert a["quality_mean"] == pytest.approx((f1 + 0.3 + 0.1 + 0.24) / 4)
    assert a["quality_parity"] == pytest.approx((f1 + 0.3 + 0 + 0.24) / 4)
    assert b["quality_mean"] == pytest.approx((0.013 * 0.2 + 0.1 + 0.24) / 3)


def test_bands_and_advice(spark):
    df = spark.createDataFrame([(0.8,), (0.6,), (0.4,), (0.2,), (0.1,)], "s double")
    assert [tuple(r) for r in df.select(quality.five_level(F.col("s")), quality.four_level(F.col("s"))).collect()] == [
        ("Excellent", "Excellent"), ("Good", "Good"), ("Average", "Average"), ("Poor", "Poor"), ("Very Poor", "Poor"),
    ]
    advice = spark.range(1).select(quality.recommendations(F.lit(10), F.lit(5), F.lit("negative"))).first()[0]
    assert len(advice) == 3


RESPONSE = "Overall sentiment: Positive\nTone: calm\nThe SENTIMENT turns negative\nConfidence: .85 of 1\n- first topic\n• second\nTheme: third\n-- \n- 4\n- 5\n- 6"


def test_response_parsing(one):
    assert one(lambda f: pr.response_sentiment(f.col("x")), RESPONSE) == "negative"
    assert one(lambda f: pr.response_sentiment(f.col("x")), "overall fine") == "neutral"
    assert one(lambda f: pr.response_sentiment(f.col("x")), "") is None
    assert one(lambda f: pr.response_confidence(f.col("x")), RESPONSE) == 0.85
    assert one(lambda f: pr.response_topics(f.col("x")), RESPONSE) == ["first topic", "second", "Theme: third", "4", "5"]


@pytest.mark.parametrize("line,score", [("Score: 7", 0.7), ("score 85", 0.85), ("Score 150", 1.0), ("Score 3\nfinal score 9.5", 0.95), ("none", None)])
def test_response_score(one, line, score):
    assert one(lambda f: pr.response_score(f.col("x")), line) == score


def test_prompts(spark):
    rows = pr.requests(docs(spark, "x" * 12_000), "id", "text", seeds.PROMPTS).collect()
    # Every character is sent: two parts for each of the six kinds.
    assert len(rows) == 12 and {(r["part"], r["prompt"].count("x" * 2000)) for r in rows} == {(0, 5), (1, 1)}
    assert all("x" * 10_001 not in r["prompt"] for r in rows)


def test_long_conversations_span_rows(spark):
    df = spark.createDataFrame([(1, i, "user", str(i)) for i in range(10)], "conv_id bigint, turn bigint, role string, text string")
    rows = sorted(pr.transcripts(df, chunk=4).collect(), key=lambda r: r["part"])
    assert [[m["content"] for m in r["messages"]] for r in rows] == [["0", "1", "2", "3"], ["4", "5", "6", "7"], ["8", "9"]]
