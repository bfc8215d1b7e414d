"""Analyses that match tokens against parameter lists: sentiment, emotion, language, category.

Joined forms explode tokens, join the list (broadcast after a size check) and
aggregate by document. The exploded rows never cross the network: the partial
aggregate leaves one small row per document before the only shuffle.
In-row forms serve short lists and need no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions.arrays import let
from pagelens.functions.text import blank_word_count, tokens
from pagelens.session import bounded_broadcast


def exploded(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token) rows; a document without tokens keeps one null row."""
    return df.select(key, F.explode_outer(tokens(F.col(text))).alias("word"))


def compound_score(total: Column) -> Column:
    """Published normalisation of a valence sum into (-1, 1)."""
    return total / F.sqrt(total * total + F.lit(15.0))


def overall_label(compound: Column, strict: bool = False) -> Column:
    """Label at +-0.05; the display variant excludes the bounds."""
    if strict:
        return F.when(compound > 0.05, "positive").when(compound < -0.05, "negative").otherwise("neutral")
    return F.when(compound >= 0.05, "positive").when(compound <= -0.05, "negative").otherwise("neutral")


def polarity_label(polarity: Column) -> Column:
    """Label at +-0.1."""
    return F.when(polarity > 0.1, "positive").when(polarity < -0.1, "negative").otherwise("neutral")


def sentiment_sums() -> list[Column]:
    """Aggregates over token rows with `word`, `valence`, `polarity` and `subjectivity`."""
    v = F.col("valence")
    return [
        F.coalesce(F.sum(v), F.lit(0.0)).alias("total"),
        F.coalesce(F.sum(F.when(v > 0, v + 1)), F.lit(0.0)).alias("up"),
        F.coalesce(F.sum(F.when(v < 0, 1 - v)), F.lit(0.0)).alias("down"),
        F.count(F.when(F.col("word").isNotNull() & (v.isNull() | (v == 0)), 1)).cast("double").alias("flat"),
        F.coalesce(F.avg("polarity"), F.lit(0.0)).alias("polarity"),
        F.coalesce(F.avg("subjectivity"), F.lit(0.0)).alias("subjectivity"),
    ]


def sentiment_columns() -> dict[str, Column]:
    """N1-N3 from the sums of one document."""
    mass = F.col("up") + F.col("down") + F.col("flat")
    compound = compound_score(F.col("total"))

    def share(name: str) -> Column:
        return F.when(mass > 0, F.col(name) / mass).otherwise(F.lit(0.0))

    return {
        "pos": share("up"),
        "neg": share("down"),
        "neu": share("flat"),
        "compound": compound,
        "polarity": F.col("polarity"),
        "subjectivity": F.col("subjectivity"),
        "overall": overall_label(compound),
        "overall_strict": overall_label(compound, strict=True),
        "confidence": F.abs(compound),
        "polarity_label": polarity_label(F.col("polarity")),
    }


def select_columns(df: DataFrame, key: str, columns: Mapping[str, Column]) -> DataFrame:
    return df.select(key, *[c.alias(n) for n, c in columns.items()])


def sentiment(df: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """pos/neg/neu shares, compound, labels, polarity and subjectivity per document."""
    hits = exploded(df, key, text).join(bounded_broadcast(lexicon), "word", "left")
    return select_columns(hits.groupBy(key).agg(*sentiment_sums()), key, sentiment_columns())


def add_compound(df: DataFrame, text: str, lexicon: Sequence[Sequence]) -> DataFrame:
    """In-row N1 for a short lexicon: a hash-set test per token, then a lookup on the few hits."""
    valences = F.create_map(*[F.lit(x) for row in lexicon for x in (row[0], float(row[1]))])
    hits = F.filter(tokens(F.col(text)), lambda w: w.isin(*[row[0] for row in lexicon]))
    df = df.withColumn("__hits", hits)
    total = F.aggregate("__hits", F.lit(0.0), lambda acc, w: acc + F.try_element_at(valences, w))
    return df.withColumn("__total", total).withColumn("compound", compound_score(F.col("__total"))).drop(
        "__hits", "__total"
    )


def emotion_sums(names: Sequence[str], has: Callable[[str], Column]) -> list[Column]:
    return [F.count(F.when(has(e), 1)).cast("double").alias(f"felt_{e}") for e in names]


def emotion_columns(names: Sequence[str]) -> dict[str, Column]:
    """N4 from the hits: the dominant emotion (first wins ties) and all shares; null without a hit."""
    felt = [F.col(f"felt_{e}") for e in names]
    total = sum(felt[1:], felt[0])
    best = F.greatest(*felt) if len(felt) > 1 else felt[0]
    dominant = F.when(total == 0, F.lit(None).cast("string"))
    for e in names:
        dominant = dominant.when(F.col(f"felt_{e}") == best, e)
    shares = F.array(*[F.struct(F.lit(e).alias("emotion"), F.try_divide(F.col(f"felt_{e}"), total).alias("share")) for e in names])
    return {"dominant": dominant, "confidence": F.try_divide(best, total), "shares": F.when(total > 0, shares)}


def emotions(df: DataFrame, key: str, text: str, lexicon: Sequence[Sequence[str]]) -> DataFrame:
    """Share per emotion (long form), dominant emotion and its share.

    Emotion names come from the list, so counting is one aggregate with a column per name.
    """
    names = list(dict.fromkeys(e for _, e in lexicon))
    lex = F.broadcast(df.sparkSession.createDataFrame([tuple(r) for r in lexicon], "word string, emotion string"))
    counts = exploded(df, key, text).join(lex, "word").groupBy(key).agg(*emotion_sums(names, lambda e: F.col("emotion") == e))
    found = select_columns(counts, key, emotion_columns(names))
    return found.select(key, "dominant", "confidence", F.explode("shares").alias("x")).select(key, "dominant", "confidence", "x.emotion", "x.share")


def language_sums(names: Sequence[str], has: Callable[[str], Column]) -> list[Column]:
    """Votes per profile; `has` tells whether a token row belongs to a profile."""
    return [F.max("size").alias("size"), *[F.count(F.when(has(n), 1)).alias(f"votes_{n}") for n in names]]


def language_columns(names: Sequence[str]) -> dict[str, Column]:
    """N8 from the votes: first profile wins ties; no vote gives English at 0.5."""
    best = F.greatest(*[F.col(f"votes_{n}") for n in names])
    code = F.when(best == 0, "en")
    for n in names:
        code = code.when(F.col(f"votes_{n}") == best, n)
    return {
        "language": code,
        "confidence": F.when(best == 0, F.lit(0.5)).when(F.col("size") > 100, F.lit(0.8)).otherwise(F.lit(0.6)),
        "votes": best.cast("bigint"),
        "is_english": code == "en",
    }


def language(df: DataFrame, key: str, text: str, profiles: Mapping[str, Sequence[str]]) -> DataFrame:
    """Vote of stop-word profiles."""
    rows = [(w, lang) for lang, words in profiles.items() for w in words]
    lex = F.broadcast(df.sparkSession.createDataFrame(rows, "word string, profile string"))
    names = list(profiles)
    hits = df.select(
        key, F.length(text).alias("size"), F.explode_outer(tokens(F.col(text))).alias("word")
    ).join(lex, "word", "left")
    votes = hits.groupBy(key).agg(*language_sums(names, lambda n: F.col("profile") == n))
    return select_columns(votes, key, language_columns(names))


def category_sums(names: Sequence[str], has: Callable[[str], Column]) -> list[Column]:
    return [F.count(F.when(has(c), 1)).cast("double").alias(f"hits_{c}") for c in names]


def category_columns(names: Sequence[str]) -> dict[str, Column]:
    """N9 from the hits: shares, argmax with first-wins ties, `general` without a hit."""
    total = sum((F.col(f"hits_{c}") for c in names[1:]), F.col(f"hits_{names[0]}"))
    shares = {c: F.when(total > 0, F.col(f"hits_{c}") / total).otherwise(F.lit(0.0)) for c in names}
    most = F.greatest(*[F.col(f"hits_{c}") for c in names])
    top = F.when(most == 0, "general")
    for c in names:
        top = top.when(F.col(f"hits_{c}") == most, c)
    return {**shares, "predicted_category": top, "confidence": F.greatest(*shares.values())}


def title_hits(title: Column, lists: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """Keyword tokens of a title by category, counted in the row: titles are short."""
    def hits(words: list[str]) -> Column:
        return let(tokens(F.coalesce(title, F.lit(""))), lambda ws: F.size(F.filter(ws, lambda w: w.isin(*words))).cast("double"))

    return {c: hits(sorted(set(words))) for c, words in lists.items()}


def token_categories(df: DataFrame, key: str, text: str, lists: Mapping[str, Sequence[str]], title: str | None = None) -> DataFrame:
    """Share of keyword tokens per category with the best one, over the title, if there is one, and the text."""
    if title is not None:
        # A title is read before its text; the mark between them keeps their words apart.
        both = F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" "), F.coalesce(F.col(text), F.lit("")))
        df, text = df.select(key, both.alias("__full")), "__full"
    rows = [(w, c) for c, words in lists.items() for w in dict.fromkeys(words)]
    lex = F.broadcast(df.sparkSession.createDataFrame(rows, "word string, category string"))
    names = list(lists)
    hits = exploded(df, key, text).join(lex, "word", "left").groupBy(key).agg(
        *category_sums(names, lambda c: F.col("category") == c)
    )
    return select_columns(hits, key, category_columns(names))


def list_analyses(
    df: DataFrame,
    key: str,
    text: str,
    lexicon: Sequence[Sequence],
    profiles: Mapping[str, Sequence[str]],
    categories: Mapping[str, Sequence[str]],
    feelings: Sequence[Sequence[str]] = (),
    title: str | None = None,
) -> DataFrame:
    """N1-N4, N8 and N9 together: one token pass, one broadcast list, one small shuffle.

    The lists become one, with a row per word, so that joining it never repeats a token. A title counts for the category only.
    """
    merged: dict[str, list] = {}

    def at(word: str) -> list:
        return merged.setdefault(word, [word, None, None, None, [], [], []])

    felt = list(dict.fromkeys(e for _, e in feelings))
    for word, *values in lexicon:
        at(word)[1:4] = values
    by_feeling = {e: [w for w, x in feelings if x == e] for e in felt}
    for i, groups in ((4, profiles), (5, categories), (6, by_feeling)):
        for name, words in groups.items():
            for word in dict.fromkeys(words):
                at(word)[i].append(name)
    schema = (
        "word string, valence double, polarity double, subjectivity double, profiles array<string>, "
        "categories array<string>, feelings array<string>"
    )
    lex = F.broadcast(df.sparkSession.createDataFrame([tuple(r) for r in merged.values()], schema))
    names, kinds = list(profiles), list(categories)
    titled = title_hits(F.col(title), categories) if title is not None else {}
    # Titles are counted below the explosion, once a document and not once a token.
    df = df.select(key, F.col(text).alias("__text"), F.length(text).alias("size"), *[c.alias(f"title_{k}") for k, c in titled.items()])
    hits = df.select(key, "size", *[f"title_{k}" for k in titled], F.explode_outer(tokens(F.col("__text"))).alias("word")).join(lex, "word", "left")
    in_title = lambda c: F.max(f"title_{c}") if titled else F.lit(0.0)
    sums = hits.groupBy(key).agg(
        *sentiment_sums(),
        *language_sums(names, lambda n: F.array_contains("profiles", n)),
        *[(F.count(F.when(F.array_contains("categories", c), 1)) + in_title(c)).cast("double").alias(f"hits_{c}") for c in kinds],
        *emotion_sums(felt, lambda e: F.array_contains("feelings", e)),
    )
    packed = {
        "sentiment": sentiment_columns(),
        "language": language_columns(names),
        "category": category_columns(kinds),
    }
    if felt:
        packed["emotions"] = emotion_columns(felt)
    return sums.select(
        key, *[F.struct(*[c.alias(n) for n, c in cols.items()]).alias(name) for name, cols in packed.items()]
    )


def add_substring_category(df: DataFrame, text: str, lists: Mapping[str, Sequence[str]]) -> DataFrame:
    """Scores, first-wins argmax (the first category when nothing matches) and confidence.

    A keyword list is a parameter of known size, so the theta join on `contains` becomes a sum of
    tests inside the row: no nested-loop join and no exploded intermediate.
    """
    names = list(lists)

    def score(words: Sequence[str]) -> Column:
        quoted = ["'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in dict.fromkeys(words)]
        return F.expr("cast(" + " + ".join(f"cast(contains(__low, {w}) as int)" for w in quoted) + " as bigint)")

    df = df.withColumn("__low", F.lower(text)).withColumns({f"score_{n}": score(ws) for n, ws in lists.items()})
    df = df.drop("__low")
    best = F.greatest(*[F.col(f"score_{n}") for n in names])
    top = F.when(F.col(f"score_{names[0]}") == best, names[0])
    for n in names[1:]:
        top = top.when(F.col(f"score_{n}") == best, n)
    scale = F.greatest(blank_word_count(F.col(text)).cast("double") * F.lit(0.01), F.lit(1.0))
    return df.withColumns(
        {
            "category": top,
            "category_confidence": F.least(best.cast("double") / scale, F.lit(1.0)),
            "keyword_matches": best,
        }
    )
