"""Prompt tables for an offline batch model, and parsing of its responses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions.arrays import let
from pagelens.functions.text import strip
from pagelens.operators.skew import numbered

INPUT_LIMIT = 10_000
EMOTION_LIMIT = 512
SUMMARY_LIMIT = 1_024


def capped(text: Column, limit: int) -> Column:
    """Model input cap."""
    return F.substring(text, 1, limit)


def requests(
    df: DataFrame, key: str, text: str, prompts: Sequence[Sequence], limit: int = INPUT_LIMIT
) -> DataFrame:
    """One request row per prompt kind and part of a document; the short prompt list is unnested, not joined.

    A text longer than the input cap makes several parts, so every character is sent.
    """
    kinds = F.array(
        *[
            F.struct(
                F.lit(kind).alias("kind"),
                F.lit(role).alias("system_role"),
                F.lit(f"{task}\n\nContent: ").alias("head"),
                F.lit(f"\n\n{guide}").alias("tail"),
                F.lit(budget).alias("max_tokens"),
            )
            for kind, role, task, guide, budget in prompts
        ]
    )
    n_parts = F.greatest(F.ceil(F.coalesce(F.length(text), F.lit(0)) / limit).cast("int"), F.lit(1))
    parts = df.select(key, text, F.explode(F.sequence(F.lit(0), n_parts - 1)).alias("part"))
    return parts.select(key, text, "part", F.explode(kinds).alias("p")).select(
        key,
        "p.kind",
        "part",
        "p.system_role",
        F.concat("p.head", F.substr(F.col(text), F.col("part") * limit + 1, F.lit(limit)), "p.tail").alias("prompt"),
        "p.max_tokens",
    )


def _last(lines: Column) -> Column:
    return F.try_element_at(lines, F.lit(-1))


def _has(line: Column, *marks: str) -> Column:
    low = F.lower(line)
    out = F.contains(low, F.lit(marks[0]))
    for mark in marks[1:]:
        out = out | F.contains(low, F.lit(mark))
    return out


def response_sentiment(response: Column) -> Column:
    """Label on the last line that speaks of sentiment; null without one."""
    lines = F.filter(F.split(response, "\n", -1), lambda s: _has(s, "sentiment", "overall"))
    return let(
        _last(lines),
        lambda s: F.when(_has(s, "positive"), "positive")
        .when(_has(s, "negative"), "negative")
        .when(s.isNotNull(), "neutral"),
    )


def response_confidence(response: Column) -> Column:
    """First number on the last confidence line that is not a sentiment line."""
    lines = F.filter(
        F.split(response, "\n", -1),
        lambda s: _has(s, "confidence") & ~_has(s, "sentiment", "overall") & s.rlike("[0-9]"),
    )
    return F.regexp_extract(_last(lines), r"([0-9]*\.?[0-9]+)", 1).try_cast("double")


def response_topics(response: Column, k: int = 5) -> Column:
    """The first topic lines, without their bullet."""
    lines = F.filter(F.split(response, "\n", -1), lambda s: _has(s, "topic", "theme", "-", "•"))
    plain = F.transform(lines, lambda s: strip(F.regexp_replace(strip(s), r"^[-•]+", "")))
    return F.slice(F.filter(plain, lambda s: s != ""), 1, k)


def response_score(response: Column) -> Column:
    """Last score, a tenth up to ten, a hundredth above, at most one."""
    lines = F.filter(F.split(response, "\n", -1), lambda s: _has(s, "score") & s.rlike("[0-9]"))
    return let(
        F.regexp_extract(_last(lines), r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double"),
        lambda x: F.when(x <= 10, x / 10).when(x > 10, F.least(x / 100, F.lit(1.0))),
    )


def transcript_rows(df: DataFrame) -> DataFrame:
    """N19 as rows: message position inside its conversation, with no conversation gathered in one task."""
    return numbered(df.select("conv_id", "turn", "role", "text"), "turn", ["conv_id"])


def transcripts(df: DataFrame, chunk: int = 256) -> DataFrame:
    """Ordered message lists. A conversation longer than `chunk` spans several rows, in order."""
    rows = transcript_rows(df).withColumn("part", F.floor((F.col("position") - 1) / chunk))
    return rows.groupBy("conv_id", "part").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", "role", "text"))),
            lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")),
        ).alias("messages")
    )


def with_backup(primary: DataFrame, backup: DataFrame, key: str, value: str) -> DataFrame:
    """Primary result where present, else the backup's, with its origin."""
    p = primary.select(key, F.col(value).alias("__p"))
    return (
        backup.join(p, key, "left")
        .withColumn("origin", F.when(F.col("__p").isNotNull(), "primary").otherwise("backup"))
        .withColumn(value, F.coalesce("__p", value))
        .select(key, value, "origin")
    )
