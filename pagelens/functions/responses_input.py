"""Inputs built from the given tables: model responses from messages, search over bounded input lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.functions.text import tokens
from pagelens.session import bounded_broadcast, scratch_path


def responses(conversations: DataFrame) -> DataFrame:
    """A response per assistant message: labelled lines, then the message as a bullet list."""
    n = F.length("text")
    label = F.when(n % 3 == 0, "Positive").when(n % 3 == 1, "negative").otherwise("mixed")
    return conversations.filter("role = 'assistant'").select(
        "conv_id",
        "turn",
        F.concat(
            F.lit("Overall sentiment: "), label,
            F.lit("\nConfidence: 0."), F.lpad((n % 100).cast("string"), 2, "0"),
            F.lit("\nQuality score: "), (n % 130).cast("string"),
            F.lit("\n- "), F.replace("text", F.lit("\n"), F.lit("\n- ")),
        ).alias("response"),
    )


MAX_INPUTS = 10_000


def search(df: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query: str) -> DataFrame:
    """P10 for many inputs: (query_key, key) for every document that contains a query.

    Inputs and documents meet on the inner word of the query that the fewest documents hold, and
    only ids are joined; the texts of those few candidates are fetched for the substring test. A
    list of words within the checked bound becomes a constant, so only matching words are unnested.
    Inputs without an inner word are tested in the row, a bounded block of inputs at a time.
    """
    low = F.lower(F.col(query))
    inner = F.array_distinct(F.regexp_extract_all(low, F.lit(r"[^\p{L}\p{N}_]([\p{L}\p{N}_]{2,})(?=[^\p{L}\p{N}_])"), F.lit(1)))
    inputs = queries.select(query_key, low.alias("__q"), inner.alias("__ws")).filter("__q <> ''")
    anchored = inputs.filter(F.size("__ws") > 0).select(query_key, "__q", F.explode("__ws").alias("__w"))
    words = F.array_distinct(tokens(F.col(text)))
    listed = [r[0] for r in anchored.select("__w").distinct().limit(MAX_INPUTS + 1).collect()]
    if len(listed) <= MAX_INPUTS:
        words = F.array_intersect(words, F.split(F.lit("\u0001".join(listed)), "\u0001", -1))
    path = scratch_path(df.sparkSession, "postings")
    df.select(key, F.explode(words).alias("__w")).write.parquet(path)
    postings = df.sparkSession.read.parquet(path)
    held = postings.groupBy("__w").agg(F.count(F.lit(1)).alias("__n"))
    rarest = F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), "__w"))
    anchors = anchored.join(held, "__w", "left").groupBy(query_key, "__q").agg(rarest.alias("__a"))
    anchors = anchors.select(query_key, "__q", F.col("__a.__w").alias("__w"))
    pairs = postings.join(bounded_broadcast(anchors, MAX_INPUTS), "__w").select(key, query_key, "__q")
    texts = df.select(key, F.lower(text).alias("__t"))
    # The few candidates go to the texts, not the texts to them, as long as they fit the checked bound.
    out = texts.join(bounded_broadcast(pairs), key).filter(F.contains("__t", F.col("__q"))).select(query_key, key)
    short = inputs.filter(F.size("__ws") == 0).select(query_key, "__q")
    blocks = -(-short.count() // MAX_INPUTS)
    for i in range(blocks):
        block = short.filter(F.pmod(F.xxhash64("__q"), F.lit(blocks)) == i)
        out = out.unionByName(texts.join(F.broadcast(block), F.contains("__t", F.col("__q"))).select(query_key, key))
    return out
