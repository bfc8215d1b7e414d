"""Enriched content and full analysis: the steps joined into one table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens import seeds
from pagelens.functions.checks import analysis_guard
from pagelens.functions.quality import display_quality
from pagelens.functions.text import add_display_statistics, add_readability, add_statistics, clean_text
from pagelens.operators import lexicon as lx
from pagelens.operators.entities import listed_entities, pattern_entities
from pagelens.operators.keywords import add_frequent_words, summaries
from pagelens.operators.models import topic_model
from pagelens.session import spread
from pagelens.sources.tables import content_base


def enriched(
    documents: DataFrame,
    sentiment: Sequence[Sequence] = seeds.SENTIMENT,
    categories: Mapping[str, Sequence[str]] = seeds.SUBSTRING_CATEGORIES,
) -> DataFrame:
    """`content` with word count, readability, sentiment, category and quality.

    All of it is one projection over the scan: no shuffle, and columns that a
    report does not use are pruned together with their text work.
    """
    out = add_display_statistics(content_base(spread(documents, "doc_id")), "content")
    out = lx.add_compound(out, "content", sentiment)
    out = lx.add_substring_category(out, "content", categories)
    out = out.withColumn("sentiment", lx.overall_label(F.col("compound"), strict=True))
    quality = display_quality(
        F.col("word_count"), F.col("readability_score"), F.col("sentiment"), F.abs("compound")
    )
    return out.withColumn("quality_score", quality).select(
        "content_id", "job_id", "url", "title", "content", "scraped_at", "engine", "error", "word_count",
        "readability_score", "compound", "sentiment", "category", "category_confidence", "quality_score",
    )


STEPS = ("statistics", "readability", "keywords", "entities", "sentiment", "emotions", "language", "category", "topics", "summary")
LIST_STEPS = ("sentiment", "emotions", "language", "category")
#: Why a step has no result for a document that is long enough to analyse.
NO_RESULT = {
    "topics": "no word of the topic model's vocabulary",
    "summary": "too short to summarise",
    "emotions": "no word of the emotion list",
}


def analyse(
    df: DataFrame,
    key: str,
    text: str,
    *,
    stop_words: Sequence[str],
    title: str | None = None,
    sentiment: Sequence[Sequence] = seeds.SENTIMENT,
    profiles: Mapping[str, Sequence[str]] = seeds.STOP_WORDS,
    categories: Mapping[str, Sequence[str]] = seeds.TOKEN_CATEGORIES,
    emotions: Sequence[Sequence[str]] = seeds.EMOTIONS,
    gazetteer: Sequence[Sequence[str]] = (),
    steps: Sequence[str] = STEPS,
) -> DataFrame:
    """One row per document with a column per requested step, an `error` for text too short, and `failures`, a map of
    the steps that have no result to the reason.

    Statistics, readability, keywords and entities are columns of one pass over the text. The list-based steps share a
    second pass; topics and summaries have a pass each. Their results are one small row per document,
    joined by the document key. A document too short to analyse keeps its row. A title counts for the category.
    """
    out = df.select(key, F.col(text).alias("raw"), analysis_guard(F.col(text)).alias("error"))
    long_enough = F.col("error").isNull()
    kept = [key, "error"]

    def pack(part: DataFrame, name: str, before: list[str]) -> DataFrame:
        """Turn the columns a step added into one struct, null for guarded documents."""
        added = [c for c in part.columns if c not in before]
        return part.select(*before, F.when(long_enough, F.struct(*added)).alias(name))

    if "statistics" in steps:
        out = pack(add_statistics(out, "raw", stop_words), "statistics", ["raw", *kept])
        kept.append("statistics")
    if "readability" in steps:
        out = pack(add_readability(out, "raw"), "readability", ["raw", *kept])
        kept.append("readability")
    if "keywords" in steps:
        out = add_frequent_words(out, "raw", stop_words, "top")
        out = out.select("raw", *kept, F.when(long_enough, F.col("top")).alias("keywords"))
        kept.append("keywords")
    if "entities" in steps:
        # From the raw text: cleaning takes the signs that addresses and amounts are known by.
        found = pattern_entities(F.col("raw"))
        found = F.concat(found, listed_entities(F.col("raw"), gazetteer)) if gazetteer else found
        out = out.select("raw", *kept, F.when(long_enough, F.array_distinct(found)).alias("entities"))
        kept.append("entities")
    usable = df.filter(analysis_guard(F.col(text)).isNull())
    joined = [s for s in steps if s in LIST_STEPS]
    if joined:
        base = usable.select(key, clean_text(F.col(text)).alias("clean"), *([F.col(title).alias("title")] if title else []))
        small = lx.list_analyses(base, key, "clean", sentiment, profiles, categories, emotions, "title" if title else None)
        if "emotions" in joined:
            small = small.withColumn("emotions", F.when(F.col("emotions.dominant").isNotNull(), F.col("emotions")))
        out = out.join(small.select(key, *joined), key, "left")
    if "topics" in steps:
        out = out.join(topic_model(usable.select(key, text), key, text, stop_words).mixtures, key, "left")
        joined.append("topics")
    if "summary" in steps:
        short = summaries(usable.select(key, text), key, text, stop_words)
        out = out.join(short.select(key, F.struct(*[c for c in short.columns if c != key]).alias("summary")), key, "left")
        joined.append("summary")
    missing = [F.when(long_enough & F.col(s).isNull(), F.struct(F.lit(s).alias("step"), F.lit(NO_RESULT[s]).alias("reason"))) for s in NO_RESULT if s in joined]
    failures = F.map_from_entries(F.array_compact(F.array(*missing))) if missing else F.create_map().cast("map<string,string>")
    return out.select(*kept, *joined, failures.alias("failures"))
