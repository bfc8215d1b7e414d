"""Queries over `documents`: text statistics, keywords, lexicon analyses, quality, prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelens import seeds
from pagelens.functions import checks, quality, responses_input as ri
from pagelens.functions import text as T
from pagelens.functions.html import parse_pages
from pagelens.operators import entities as ents
from pagelens.operators import keywords as kw
from pagelens.operators import lexicon as lx
from pagelens.operators import prompts as pr
from pagelens.operators.skew import numbered
from pagelens.plans import parameters as P
from pagelens.plans import sql as S
from pagelens.plans.enrichment import analyse, enriched
from pagelens.plans.entry import Registry, docs, pages
from pagelens.sources.tables import table

ENTRIES = Registry()
STOP = seeds.all_stop_words()


@ENTRIES.add(
    "clean_text",
    "T1",
    f"SELECT doc_id, {S.clean('text')} AS clean, {S.clean_parity('text')} AS clean_parity FROM documents",
)
def clean_text(spark, sf):
    t = F.col("text")
    return docs(spark, sf).select(
        "doc_id", T.clean_text(t).alias("clean"), T.clean_text(t, "reference").alias("clean_parity")
    )


@ENTRIES.add(
    "token_counts",
    "T2 T3 T4",
    f"""SELECT doc_id, len({S.tokens('text')}) AS tokens, len({S.sentences('text')}) AS sentences,
        len({S.content_words(S.clean('text'))}) AS content_words FROM documents""",
)
def token_counts(spark, sf):
    t = F.col("text")
    return docs(spark, sf).select(
        "doc_id",
        F.size(T.tokens(t)).cast("bigint").alias("tokens"),
        F.size(T.sentences(t)).cast("bigint").alias("sentences"),
        F.size(T.content_words(T.alpha_words(T.clean_text(t)), STOP)).cast("bigint").alias("content_words"),
    )


_STATS = f"""SELECT {{keys}}, length(c) AS char_count, len(tk) AS word_count, len(st) AS sentence_count,
    len(string_split({{raw}}, chr(10) || chr(10))) AS paragraph_count, len(string_split(c, chr(10) || chr(10))) AS paragraph_count_parity,
    len(cw) AS content_word_count, len(list_distinct(cw)) AS unique_words,
    {S.ratio('len(tk)', 'len(st)')} AS avg_words_per_sentence,
    {S.ratio('coalesce(list_sum(list_transform(tk, lambda w: length(w))), 0)', 'len(tk)')} AS avg_chars_per_word,
    {S.ratio('len(list_distinct(cw))', 'len(cw)')} AS lexical_diversity"""


@ENTRIES.add(
    "text_statistics",
    "T6 A17",
    f"""WITH b AS (SELECT doc_id, text, {S.clean('text')} AS c FROM documents),
    t AS (SELECT *, {S.tokens('c')} AS tk, {S.sentences('c')} AS st, {S.content_words('c')} AS cw FROM b)
    {_STATS.format(keys='doc_id', raw='text')} FROM t""",
)
def text_statistics(spark, sf):
    return T.add_statistics(docs(spark, sf).select("doc_id", "text"), "text", STOP).drop("text")


@ENTRIES.add(
    "page_text_statistics",
    "T6 H2 H4",
    f"""WITH {S.MARKUP}, p AS (SELECT page_id, {S.title('m')} AS title, {S.visible('m')} AS text FROM markup),
    b AS (SELECT *, {S.clean('text')} AS c FROM p),
    t AS (SELECT *, {S.tokens('c')} AS tk, {S.sentences('c')} AS st, {S.content_words('c')} AS cw FROM b)
    {_STATS.format(keys='page_id', raw='text')}, length(title) AS title_length, len({S.words('title')}) AS title_word_count FROM t""",
)
def page_text_statistics(spark, sf):
    rows = parse_pages(pages(spark, sf), ("title", "text_content")).select(
        "page_id", "title", F.col("text_content").alias("text")
    )
    return T.add_statistics(rows, "text", STOP, title="title").drop("text", "title")


@ENTRIES.add(
    "display_statistics",
    "T7 T10 T15",
    f"""WITH {S.DISPLAY} SELECT doc_id, word_count, sentence_count, character_count, avg_words_per_sentence, avg_word_length,
        unique_words, lexical_diversity, readability_score FROM display3""",
)
def display_statistics(spark, sf):
    return T.add_display_statistics(docs(spark, sf).select("doc_id", "text"), "text").drop("text")


@ENTRIES.add(
    "syllables",
    "T8",
    f"SELECT doc_id, {S.syllables(S.alpha(S.clean('text')))} AS syllables FROM documents",
)
def syllables(spark, sf):
    return docs(spark, sf).select(
        "doc_id", T.syllable_total(T.alpha_words(T.clean_text(F.col("text")))).alias("syllables")
    )


_READ = f"""b AS (SELECT doc_id, {S.clean('text')} AS c FROM documents),
    r0 AS (SELECT doc_id, len({S.tokens('c')})::DOUBLE AS w, len({S.sentences('c')})::DOUBLE AS s,
        {S.syllables(S.alpha('c'))} AS syllables FROM b),
    r1 AS (SELECT doc_id, syllables, CASE WHEN w > 0 AND s > 0 THEN w / s END AS avg_sentence_length,
        CASE WHEN w > 0 AND s > 0 THEN syllables::DOUBLE / w END AS avg_syllables_per_word FROM r0),
    r2 AS (SELECT *, 206.835::DOUBLE - (1.015::DOUBLE * avg_sentence_length) - (84.6::DOUBLE * avg_syllables_per_word)
        AS flesch_reading_ease, (0.39::DOUBLE * avg_sentence_length) + (11.8::DOUBLE * avg_syllables_per_word) - 15.59::DOUBLE
        AS flesch_kincaid_grade FROM r1),
    readability AS (SELECT *, CASE WHEN flesch_reading_ease >= 90 THEN 'Very Easy' WHEN flesch_reading_ease >= 80 THEN 'Easy'
        WHEN flesch_reading_ease >= 70 THEN 'Fairly Easy' WHEN flesch_reading_ease >= 60 THEN 'Standard'
        WHEN flesch_reading_ease >= 50 THEN 'Fairly Difficult' WHEN flesch_reading_ease >= 30 THEN 'Difficult'
        WHEN flesch_reading_ease IS NOT NULL THEN 'Very Difficult' END AS reading_level FROM r2)"""


@ENTRIES.add("readability", "T8 T9", f"WITH {_READ} SELECT * FROM readability")
def readability(spark, sf):
    return T.add_readability(docs(spark, sf).select("doc_id", "text"), "text").drop("text")


def _top_words(words: str, keep: str) -> str:
    return f"""SELECT doc_id, rank, word, n FROM (SELECT doc_id, word, count(*) AS n, row_number() OVER (PARTITION BY doc_id
        ORDER BY count(*) DESC, min(pos)) AS rank FROM (SELECT doc_id, unnest({words}) AS word,
        unnest(range(1, 1 + len({words}))) AS pos FROM documents) WHERE {keep} GROUP BY doc_id, word) WHERE rank <= 10"""


@ENTRIES.add("frequent_words", "T11 W2", _top_words(S.content_words(S.clean("text"), 3), "true"))
def frequent_words(spark, sf):
    return kw.frequent_words(docs(spark, sf), "doc_id", "text", STOP)


@ENTRIES.add(
    "display_words",
    "T12",
    _top_words(
        rf"list_filter(list_transform({S.words('text')}, lambda w: lower(w)), lambda w: regexp_full_match(w, '\p{{L}}+'))",
        "length(word) > 2",
    ),
)
def display_words(spark, sf):
    return kw.display_words(docs(spark, sf), "doc_id", "text")


# Sentences, terms and weights of each document, as relations.
_TFIDF = rf"""b AS (SELECT doc_id, {S.clean('text')} AS c FROM documents),
    l AS (SELECT doc_id, c, {S.sentences('c')} AS st FROM b),
    s AS (SELECT doc_id, unnest(st) AS s, unnest(range(0, len(st))) AS pos FROM l),
    w AS (SELECT doc_id, pos, list_filter(regexp_extract_all(lower(s), '[\p{{L}}\p{{N}}_]{{2,}}'),
        lambda x: NOT list_contains({S.STOP}, x)) AS ws FROM s),
    terms AS (SELECT doc_id, pos, unnest(ws) AS term FROM w UNION ALL
        SELECT doc_id, pos, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w),
    tf AS (SELECT doc_id, pos, term, count(*) AS n FROM terms GROUP BY ALL),
    vocab AS (SELECT doc_id, term, df FROM (SELECT doc_id, term, count(*) AS df, row_number() OVER (PARTITION BY doc_id
        ORDER BY sum(n) DESC, term) AS k FROM tf GROUP BY doc_id, term) WHERE k <= 20),
    ns AS (SELECT doc_id, count(*) AS sents FROM s GROUP BY 1),
    raw AS (SELECT doc_id, pos, term, n * (ln((1.0::DOUBLE + sents) / (1.0::DOUBLE + df)) + 1.0::DOUBLE) AS x
        FROM tf JOIN vocab USING (doc_id, term) JOIN ns USING (doc_id)),
    weights AS (SELECT doc_id, pos, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id, pos)) AS weight FROM raw)"""


@ENTRIES.add(
    "tfidf_keywords",
    "T5 T13 W3",
    f"""WITH {_TFIDF}, m AS (SELECT doc_id, term AS word, round(sum(weight) / any_value(sents), 6) AS score
        FROM weights JOIN ns USING (doc_id) WHERE sents > 1 GROUP BY doc_id, term)
    SELECT doc_id, rank, word, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, word) AS rank
        FROM m) WHERE rank <= 10""",
)
def tfidf_keywords(spark, sf):
    return kw.tfidf_keywords(docs(spark, sf), "doc_id", "text", STOP)


@ENTRIES.add(
    "unique_content_words",
    "T14 A17",
    f"""SELECT source, count(DISTINCT word) AS unique_words FROM
        (SELECT source, unnest({S.content_words(S.clean('text'))}) AS word FROM documents) GROUP BY source""",
)
def unique_content_words(spark, sf):
    words = T.content_words(T.alpha_words(T.clean_text(F.col("text"))), STOP)
    # Two steps: distinct (source, word) pairs spread over all tasks first, so a hot source is not counted in one.
    pairs = docs(spark, sf).select("source", F.explode_outer(words).alias("word")).filter("word IS NOT NULL").distinct()
    return pairs.groupBy("source").agg(F.count(F.lit(1)).alias("unique_words"))


@ENTRIES.add(
    "sentiment",
    "N1 N2 N3 J4",
    f"""WITH t AS (SELECT doc_id, unnest({S.tokens('text')}) AS word FROM documents),
    s AS (SELECT doc_id, coalesce(sum(valence), 0.0::DOUBLE) AS total,
        coalesce(sum(CASE WHEN valence > 0 THEN valence + 1 END), 0.0::DOUBLE) AS up,
        coalesce(sum(CASE WHEN valence < 0 THEN 1 - valence END), 0.0::DOUBLE) AS down,
        count_if(valence IS NULL OR valence = 0)::DOUBLE AS flat,
        coalesce(sum(polarity) / count(polarity), 0.0::DOUBLE) AS polarity,
        coalesce(sum(subjectivity) / count(subjectivity), 0.0::DOUBLE) AS subjectivity
        FROM t LEFT JOIN {seeds.sql_values(P.SENTIMENT, 'word, valence, polarity, subjectivity')} l USING (word) GROUP BY doc_id),
    c AS (SELECT *, {S.compound('total')} AS compound, up + down + flat AS mass FROM s)
    SELECT doc_id, up / mass AS pos, down / mass AS neg, flat / mass AS neu, compound, polarity, subjectivity,
        CASE WHEN compound >= 0.05 THEN 'positive' WHEN compound <= -0.05 THEN 'negative' ELSE 'neutral' END AS overall,
        CASE WHEN compound > 0.05 THEN 'positive' WHEN compound < -0.05 THEN 'negative' ELSE 'neutral' END AS overall_strict,
        abs(compound) AS confidence,
        CASE WHEN polarity > 0.1 THEN 'positive' WHEN polarity < -0.1 THEN 'negative' ELSE 'neutral' END AS polarity_label FROM c""",
)
def sentiment(spark, sf):
    lexicon = seeds.table(spark, P.SENTIMENT, "word string, valence double, polarity double, subjectivity double")
    return lx.sentiment(docs(spark, sf), "doc_id", "text", lexicon)


_EMO = list(dict.fromkeys(e for _, e in P.EMOTIONS))


@ENTRIES.add(
    "emotions",
    "N4",
    f"""WITH h AS (SELECT doc_id, emotion, count(*)::DOUBLE AS n FROM (SELECT doc_id, unnest({S.tokens('text')}) AS word FROM documents)
        JOIN {seeds.sql_values(P.EMOTIONS, 'word, emotion')} l USING (word) GROUP BY ALL),
    d AS (SELECT doc_id, sum(n) AS total FROM h GROUP BY 1),
    names AS {seeds.sql_values([(e, i) for i, e in enumerate(_EMO)], 'emotion, ord')},
    g AS (SELECT doc_id, emotion, ord, coalesce(n, 0.0::DOUBLE) / total AS share FROM d CROSS JOIN names LEFT JOIN h USING (doc_id, emotion)),
    b AS (SELECT doc_id, max(share) AS confidence, arg_max(emotion, (share, -ord)) AS dominant FROM g GROUP BY 1)
    SELECT doc_id, dominant, confidence, emotion, share FROM g JOIN b USING (doc_id)""",
)
def emotions(spark, sf):
    return lx.emotions(docs(spark, sf), "doc_id", "text", P.EMOTIONS)


_PROFILE = [(w, lang) for lang, ws in seeds.STOP_WORDS.items() for w in ws]
_LANG_COLS = [(f"n_{c}", c) for c in seeds.LANGUAGES]


@ENTRIES.add(
    "language",
    "N8",
    f"""WITH t AS (SELECT doc_id, unnest({S.tokens('text')}) AS word FROM documents),
    v AS (SELECT doc_id, {', '.join(f"count(*) FILTER (profile = '{c}') AS n_{c}" for c in seeds.LANGUAGES)} FROM t
        LEFT JOIN {seeds.sql_values(_PROFILE, 'word, profile')} l USING (word) GROUP BY doc_id),
    b AS (SELECT *, greatest({', '.join(c for c, _ in _LANG_COLS)}) AS best, {S.first_best(_LANG_COLS)} AS first_best FROM v)
    SELECT b.doc_id, CASE WHEN best = 0 THEN 'en' ELSE first_best END AS language, best::BIGINT AS votes,
        CASE WHEN best = 0 THEN 0.5::DOUBLE WHEN length(text) > 100 THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END AS confidence,
        (CASE WHEN best = 0 THEN 'en' ELSE first_best END) = 'en' AS is_english FROM b JOIN documents USING (doc_id)""",
)
def language(spark, sf):
    return lx.language(docs(spark, sf), "doc_id", "text", seeds.STOP_WORDS)


_CATS = list(P.TOKEN_CATEGORIES)
_CAT_ROWS = [(w, c) for c, ws in P.TOKEN_CATEGORIES.items() for w in dict.fromkeys(ws)]
_CAT_COLS = [(c, c) for c in _CATS]


@ENTRIES.add(
    "token_categories",
    "N9 J4 W8",
    f"""WITH t AS (SELECT doc_id, unnest({S.tokens("source || ' ' || split_part(text, chr(10), 1) || ' ' || text")}) AS word FROM documents),
    h AS (SELECT doc_id, {', '.join(f"count(*) FILTER (category = '{c}')::DOUBLE AS n_{c}" for c in _CATS)} FROM t
        LEFT JOIN {seeds.sql_values(_CAT_ROWS, 'word, category')} l USING (word) GROUP BY doc_id),
    u AS (SELECT *, {' + '.join(f'n_{c}' for c in _CATS)} AS total FROM h),
    g AS (SELECT doc_id, {', '.join(f'CASE WHEN total > 0 THEN n_{c} / total ELSE 0.0::DOUBLE END AS {c}' for c in _CATS)} FROM u)
    SELECT *, CASE WHEN greatest({', '.join(_CATS)}) = 0 THEN 'general' ELSE {S.first_best(_CAT_COLS)} END AS predicted_category,
        greatest({', '.join(_CATS)}) AS confidence FROM g""",
)
def token_categories(spark, sf):
    title = F.concat("source", F.lit(" "), F.substring_index("text", "\n", 1)).alias("title")
    return lx.token_categories(docs(spark, sf).select("doc_id", "text", title), "doc_id", "text", P.TOKEN_CATEGORIES, "title")


@ENTRIES.add(
    "substring_categories",
    "N10 J5 W8",
    f"""WITH {S.ENRICHED} SELECT content_id, category, category_confidence, keyword_matches FROM content""",
)
def substring_categories(spark, sf):
    return lx.add_substring_category(docs(spark, sf), "text", seeds.SUBSTRING_CATEGORIES).select(
        F.col("doc_id").alias("content_id"), "category", "category_confidence", "keyword_matches"
    )


def _pattern_rows() -> str:
    parts = []
    for label, pattern in ents.PATTERNS:
        parts.append(
            f"SELECT doc_id, '{label}' AS label, unnest(regexp_extract_all(text, '{pattern}')) AS text FROM documents"
        )
    listed = f"""SELECT doc_id, label, word FROM (SELECT doc_id, unnest({S.tokens('text')}) AS word FROM documents)
        JOIN {seeds.sql_values(P.GAZETTEER, 'word, label')} g USING (word)"""
    return " UNION ALL ".join([*parts, listed])


@ENTRIES.add("entities", "N5 U4", f"SELECT doc_id, label, text, count(*) AS n FROM ({_pattern_rows()}) GROUP BY ALL")
def entities(spark, sf):
    return (
        ents.entities(docs(spark, sf), "doc_id", "text", P.GAZETTEER)
        .groupBy("doc_id", "label", "text")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@ENTRIES.add("entity_summary", "N6 U3 A17", f"SELECT DISTINCT doc_id, label, text FROM ({_pattern_rows()})")
def entity_summary(spark, sf):
    return ents.entity_summary(docs(spark, sf), "doc_id", "text", P.GAZETTEER)


@ENTRIES.add(
    "entity_offsets",
    "N5",
    # A span is right when cutting the text at it gives the entity back.
    " UNION ALL ".join(
        f"SELECT '{label}' AS label, coalesce(sum(len(regexp_extract_all(text, '{pattern}'))), 0)::BIGINT AS entities, "
        f"coalesce(sum(len(regexp_extract_all(text, '{pattern}'))), 0)::BIGINT AS spans_that_match FROM documents "
        f"HAVING sum(len(regexp_extract_all(text, '{pattern}'))) > 0"
        for label, pattern in ents.PATTERNS
    ),
)
def entity_offsets(spark, sf):
    d = docs(spark, sf).select("doc_id", "text")
    spans = ents.entity_offsets(d, "doc_id", "text").withColumnRenamed("text", "entity")
    cut = F.substr(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    return (
        spans.join(d, "doc_id")
        .groupBy("label")
        .agg(
            F.count(F.lit(1)).alias("entities"),
            F.count(F.when(cut == F.col("entity"), 1)).alias("spans_that_match"),
        )
    )


@ENTRIES.add(
    "summaries",
    "N11",
    f"""WITH {_TFIDF}, v AS (SELECT doc_id, count(*) AS terms FROM vocab GROUP BY 1),
    sc AS (SELECT s.doc_id, s.pos, s.s, len({S.words('s.s')}) AS n,
        round(coalesce(sum(weight), 0.0::DOUBLE) / greatest(coalesce(any_value(v.terms), 0), 1), 6) AS score
        FROM s LEFT JOIN v USING (doc_id) LEFT JOIN weights x ON x.doc_id = s.doc_id AND x.pos = s.pos
        GROUP BY s.doc_id, s.pos, s.s),
    r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY score DESC, pos
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sc),
    j AS (SELECT doc_id, string_agg(s, '. ' ORDER BY pos) AS joined FROM r WHERE before < 30 GROUP BY doc_id),
    o AS (SELECT l.doc_id, length(l.c) AS original_length,
        array_to_string({S.words("coalesce(j.joined, '')")}[1:150], ' ') AS summary FROM l LEFT JOIN j USING (doc_id) WHERE length(l.c) > 100)
    SELECT doc_id, summary, original_length, length(summary) AS summary_length,
        length(summary)::DOUBLE / original_length::DOUBLE AS compression_ratio FROM o""",
)
def summaries(spark, sf):
    return kw.summaries(docs(spark, sf), "doc_id", "text", STOP)


def _sql_of(name: str) -> str:
    return next(e.sql for e in ENTRIES if e.name == name)


_EMO_COLS = [(f"felt_{e}", e) for e in _EMO]
#: A document's title in these queries: what its source is called, and its first line.
_TITLE = "source || ' ' || split_part(text, chr(10), 1)"

@ENTRIES.add(
    "full_analysis",
    "N12 P17",
    f"""WITH {_READ}, k AS (SELECT doc_id, {S.clean('text')} AS c, {_TITLE} AS title FROM documents WHERE length({S.strip('text')}) >= 10),
    t AS (SELECT doc_id, unnest({S.tokens('c')}) AS word FROM k),
    tt AS (SELECT doc_id, word FROM t UNION ALL SELECT doc_id, unnest({S.tokens('title')}) AS word FROM k),
    s AS (SELECT doc_id, coalesce(sum(valence), 0.0::DOUBLE) AS total FROM t
        LEFT JOIN {seeds.sql_values(P.SENTIMENT, 'word, valence, polarity, subjectivity')} x USING (word) GROUP BY 1),
    v AS (SELECT doc_id, {', '.join(f"count(*) FILTER (profile = '{c}') AS n_{c}" for c in seeds.LANGUAGES)} FROM t
        LEFT JOIN {seeds.sql_values(_PROFILE, 'word, profile')} x USING (word) GROUP BY doc_id),
    h AS (SELECT doc_id, {', '.join(f"count(*) FILTER (category = '{c}') AS {c}" for c in _CATS)} FROM tt
        LEFT JOIN {seeds.sql_values(_CAT_ROWS, 'word, category')} x USING (word) GROUP BY doc_id),
    e AS (SELECT doc_id, {', '.join(f"count(*) FILTER (emotion = '{n}') AS felt_{n}" for n in _EMO)} FROM t
        LEFT JOIN {seeds.sql_values(P.EMOTIONS, 'word, emotion')} x USING (word) GROUP BY doc_id),
    f AS ({_top_words(S.content_words(S.clean('text'), 3), 'true')}),
    n AS (SELECT doc_id, count(*) AS entities FROM ({_sql_of('entity_summary')}) GROUP BY 1),
    u AS (SELECT doc_id, summary_length FROM ({_sql_of('summaries')}))
    SELECT d.doc_id, CASE WHEN k.doc_id IS NULL THEN 'Text too short for analysis' END AS error,
        CASE WHEN k.doc_id IS NOT NULL THEN len({S.tokens('k.c')}) END AS word_count,
        CASE WHEN k.doc_id IS NOT NULL THEN r.reading_level END AS reading_level, {S.compound('s.total')} AS compound,
        CASE WHEN greatest({', '.join('v.' + c for c, _ in _LANG_COLS)}) = 0 THEN 'en' ELSE {S.first_best(_LANG_COLS)} END AS language,
        CASE WHEN greatest({', '.join(_CATS)}) = 0 THEN 'general' ELSE {S.first_best(_CAT_COLS)} END AS category,
        CASE WHEN k.doc_id IS NOT NULL THEN f.word END AS top_word,
        CASE WHEN greatest({', '.join(c for c, _ in _EMO_COLS)}) > 0 THEN {S.first_best(_EMO_COLS)} END AS emotion,
        CASE WHEN k.doc_id IS NOT NULL THEN coalesce(n.entities, 0) END AS entities,
        CASE WHEN k.doc_id IS NOT NULL THEN u.summary_length END AS summary_length,
        CASE WHEN k.doc_id IS NOT NULL THEN concat_ws(',', CASE WHEN greatest({', '.join(c for c, _ in _EMO_COLS)}) = 0 THEN 'emotions' END,
            CASE WHEN u.doc_id IS NULL THEN 'summary' END) ELSE '' END AS failed_steps
    FROM documents d LEFT JOIN k USING (doc_id) LEFT JOIN readability r USING (doc_id) LEFT JOIN s USING (doc_id)
        LEFT JOIN v USING (doc_id) LEFT JOIN h USING (doc_id) LEFT JOIN (SELECT * FROM f WHERE rank = 1) f USING (doc_id)
        LEFT JOIN e USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN u USING (doc_id)""",
)
def full_analysis(spark, sf):
    title = F.concat("source", F.lit(" "), F.substring_index("text", "\n", 1)).alias("title")
    out = analyse(
        docs(spark, sf).select("doc_id", "text", title), "doc_id", "text", stop_words=STOP, title="title", sentiment=P.SENTIMENT,
        categories=P.TOKEN_CATEGORIES, emotions=P.EMOTIONS, gazetteer=P.GAZETTEER,
    )
    # Topics depend on the model's fit; `document_topics` checks them.
    failed = F.array_sort(F.filter(F.map_keys("failures"), lambda s: s != "topics"))
    return out.select(
        "doc_id",
        "error",
        "statistics.word_count",
        "readability.reading_level",
        "sentiment.compound",
        "language.language",
        F.col("category.predicted_category").alias("category"),
        F.get("keywords", F.lit(0))["word"].alias("top_word"),
        F.col("emotions.dominant").alias("emotion"),
        F.when(F.col("error").isNull(), F.size("entities")).cast("bigint").alias("entities"),
        "summary.summary_length",
        F.array_join(failed, ",").alias("failed_steps"),
    )


_MARKS = "length(text) - length(translate(text, '.!?', ''))"
_JQ = f"""q0 AS (SELECT doc_id, least(length(text)::DOUBLE / 1000::DOUBLE, 1.0::DOUBLE) * 0.2::DOUBLE AS f1,
    CASE WHEN {_MARKS} > 0 THEN greatest(0.0::DOUBLE, 1.0::DOUBLE - abs(len({S.words('text')})::DOUBLE / ({_MARKS})::DOUBLE - 15::DOUBLE)
        / 15::DOUBLE) * 0.3::DOUBLE END AS f2, abs({S.compound('coalesce(total, 0.0::DOUBLE)')}) * 0.2::DOUBLE AS f3
    FROM documents LEFT JOIN valence USING (doc_id)),
  q1 AS (SELECT *, (CASE WHEN f2 IS NULL THEN 2 ELSE 3 END)::DOUBLE AS k FROM q0)"""


@ENTRIES.add(
    "job_quality",
    "N13",
    f"""WITH {S.COMPOUND}, {_JQ}, cat AS ({_sql_of('token_categories')}), q2 AS (SELECT q1.*, confidence * 0.3::DOUBLE AS f4 FROM q1 JOIN cat USING (doc_id))
    SELECT doc_id, (f1 + coalesce(f2, 0.0::DOUBLE) + f3 + f4) / (k + 1) AS quality_mean,
        (f1 + coalesce(f2, 0.0::DOUBLE) + 0.0::DOUBLE + f4) / (k + 1) AS quality_parity, f1 + coalesce(f2, 0.0::DOUBLE) + f3 + f4 AS quality_weighted FROM q2""",
)
def job_quality(spark, sf):
    rows = lx.add_compound(docs(spark, sf).select("doc_id", "text"), "text", P.SENTIMENT)
    # The share of the best category is the confidence of a document's classification: one number a document.
    sure = token_categories(spark, sf).select("doc_id", "confidence")
    rows = rows.select("doc_id", "text", "compound").join(sure, "doc_id")
    return rows.withColumns(quality.job_quality(F.col("text"), F.col("compound"), F.col("confidence"))).drop("text", "compound", "confidence")


@ENTRIES.add(
    "display_quality",
    "N14 N15 N16",
    f"""WITH {S.ENRICHED} SELECT content_id, quality_score, {S.length_factor('word_count')} AS length_score,
        least({S.length_factor('word_count')}, 1.0::DOUBLE) AS length_score_capped, readability_score / 100.0::DOUBLE AS readability_factor,
        {S.sentiment_factor('sentiment', 'abs(compound)')} AS sentiment_score,
        CASE WHEN quality_score >= 0.8 THEN 'Excellent' WHEN quality_score >= 0.6 THEN 'Good' WHEN quality_score >= 0.4 THEN 'Average'
            ELSE 'Poor' END AS quality_level,
        CASE WHEN quality_score >= 0.8 THEN 'Excellent' WHEN quality_score >= 0.6 THEN 'Good' WHEN quality_score >= 0.4 THEN 'Average'
            WHEN quality_score >= 0.2 THEN 'Poor' ELSE 'Very Poor' END AS five_level, quality_score * 100::DOUBLE AS normalized_score,
        concat_ws('; ', CASE WHEN word_count < 200 THEN 'a longer text would go deeper' END,
            CASE WHEN readability_score < 30 THEN 'shorter sentences would be easier to read' END,
            CASE WHEN sentiment = 'negative' THEN 'a friendlier tone may suit the topic' END) AS recommendations FROM content""",
)
def display_quality(spark, sf):
    c = enriched(table(spark, sf, "documents"), P.SENTIMENT)
    w, r, s, q = F.col("word_count"), F.col("readability_score"), F.col("sentiment"), F.col("quality_score")
    return c.select(
        "content_id",
        "quality_score",
        quality.length_factor(w).alias("length_score"),
        quality.length_factor(w, capped=True).alias("length_score_capped"),
        (r / F.lit(100.0)).alias("readability_factor"),
        quality.sentiment_factor(s, F.abs("compound")).alias("sentiment_score"),
        quality.four_level(q).alias("quality_level"),
        quality.five_level(q).alias("five_level"),
        (q * 100).alias("normalized_score"),
        F.array_join(quality.recommendations(w, r, s), "; ").alias("recommendations"),
    )


@ENTRIES.add(
    "content_validity",
    "P3 P17",
    f"""SELECT doc_id, {S.content_reason('text')} IS NULL AS is_valid, {S.content_reason('text')} AS reason,
        CASE WHEN length({S.strip('text')}) < 10 THEN 'Text too short for analysis' END AS analysis_error,
        CASE WHEN length({S.strip('text')}) < 5 THEN 'Failed to process text' END AS classifier_error FROM documents""",
)
def content_validity(spark, sf):
    t = F.col("text")
    return docs(spark, sf).select(
        "doc_id",
        checks.content_is_valid(t).alias("is_valid"),
        checks.content_rejection(t).alias("reason"),
        checks.analysis_guard(t).alias("analysis_error"),
        checks.classifier_guard(t).alias("classifier_error"),
    )


@ENTRIES.add(
    "invalid_content",
    "P5 P11",
    f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx FROM documents)
    SELECT source, idx, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS preview,
        {S.content_reason('text')} AS reason FROM p WHERE {S.content_reason('text')} IS NOT NULL""",
)
def invalid_content(spark, sf):
    t = F.col("text")
    rows = docs(spark, sf).select(
        "source",
        "doc_id",
        checks.content_rejection(t).alias("reason"),
        # Valid rows only count, so their previews stay at the scan.
        F.when(checks.content_rejection(t).isNotNull(), checks.preview(t, 100, always_mark=False)).alias("preview"),
    )
    return numbered(rows, "doc_id", ["source"]).filter("reason IS NOT NULL").select(
        "source", (F.col("position") - 1).alias("idx"), "preview", "reason"
    )


@ENTRIES.add(
    "content_batch_report",
    "P5",
    f"""WITH r AS (SELECT source, {S.content_reason('text')} AS reason FROM documents)
    SELECT source, count_if(reason IS NULL)::BIGINT AS valid_contents, count_if(reason IS NOT NULL)::BIGINT AS invalid_contents,
        count_if(reason IS NULL) > 0 AS is_valid FROM r GROUP BY source""",
)
def content_batch_report(spark, sf):
    bad = checks.content_rejection(F.col("text")).isNotNull().alias("bad")
    return docs(spark, sf).select("source", bad).groupBy("source").agg(
        F.count(F.when(~F.col("bad"), 1)).alias("valid_contents"),
        F.count(F.when(F.col("bad"), 1)).alias("invalid_contents"),
        (F.count(F.when(~F.col("bad"), 1)) > 0).alias("is_valid"),
    )


@ENTRIES.add(
    "model_inputs",
    "P18 P11",
    """SELECT doc_id, length(left(text, 10000)) AS model_chars, left(text, 512) AS emotion_input, left(text, 1024) AS summary_input,
        left(text, 200) || '...' AS preview FROM documents""",
)
def model_inputs(spark, sf):
    t = F.col("text")
    return docs(spark, sf).select(
        "doc_id",
        F.length(pr.capped(t, pr.INPUT_LIMIT)).cast("bigint").alias("model_chars"),
        pr.capped(t, pr.EMOTION_LIMIT).alias("emotion_input"),
        pr.capped(t, pr.SUMMARY_LIMIT).alias("summary_input"),
        checks.preview(t, 200, always_mark=True).alias("preview"),
    )


@ENTRIES.add(
    "keyword_search",
    "P10",
    f"""SELECT b.item_id, d.doc_id FROM documents d JOIN (SELECT item_id,
        regexp_replace({S.strip('text')}, '[<>]', '', 'g') AS q FROM benchmark) b ON contains(lower(d.text), lower(b.q))""",
)
def keyword_search(spark, sf):
    # Each benchmark passage is one search input.
    items = table(spark, sf, "benchmark").select("item_id", checks.clean_query(F.col("text")).alias("q"))
    return ri.search(docs(spark, sf), "doc_id", "text", items, "item_id", "q")


_PROMPT = " UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS kind, part, '{r}' AS system_role, '{t}' || chr(10) || chr(10) || 'Content: ' || "
    f"substr(text, part * 10000 + 1, 10000) || chr(10) || chr(10) || '{g}' AS prompt, {n} AS max_tokens "
    f"FROM (SELECT *, unnest(range(0, greatest((length(text) + 9999) // 10000, 1)))::INTEGER AS part FROM documents)"
    for k, r, t, g, n in seeds.PROMPTS
)


@ENTRIES.add("prompt_requests", "N17 P18", f"SELECT doc_id, kind, part, system_role, md5(prompt) AS prompt_md5, length(prompt) AS prompt_chars, max_tokens FROM ({_PROMPT})")
def prompt_requests(spark, sf):
    return pr.requests(docs(spark, sf), "doc_id", "text", seeds.PROMPTS).select(
        "doc_id",
        "kind",
        "part",
        "system_role",
        F.md5("prompt").alias("prompt_md5"),
        F.length("prompt").cast("bigint").alias("prompt_chars"),
        F.col("max_tokens").cast("int"),
    )


# Responses derived from conversations: labelled lines built from every message.
_RESPONSE = """m AS (SELECT conv_id, turn, text, (length(text) % 3) AS k, (length(text) % 130) AS score, (length(text) % 100) AS conf
        FROM conversations WHERE role = 'assistant'),
    r AS (SELECT conv_id, turn, 'Overall sentiment: ' || CASE k WHEN 0 THEN 'Positive' WHEN 1 THEN 'negative' ELSE 'mixed' END || chr(10) ||
        'Confidence: 0.' || lpad(conf::VARCHAR, 2, '0') || chr(10) || 'Quality score: ' || score || chr(10) || '- ' ||
        replace(text, chr(10), chr(10) || '- ') AS response FROM m)"""


@ENTRIES.add(
    "response_parsing",
    "N18",
    f"""WITH {_RESPONSE}, l AS (SELECT conv_id, turn, unnest(string_split(response, chr(10))) AS s,
        unnest(range(0, len(string_split(response, chr(10))))) AS i FROM r),
    a AS (SELECT conv_id, turn, arg_max(CASE WHEN contains(lower(s), 'positive') THEN 'positive' WHEN contains(lower(s), 'negative')
        THEN 'negative' ELSE 'neutral' END, i) FILTER (contains(lower(s), 'sentiment') OR contains(lower(s), 'overall')) AS sentiment,
        arg_max(TRY_CAST(regexp_extract(s, '([0-9]*\\.?[0-9]+)', 1) AS DOUBLE), i) FILTER (contains(lower(s), 'confidence') AND NOT
            (contains(lower(s), 'sentiment') OR contains(lower(s), 'overall')) AND regexp_matches(s, '[0-9]')) AS confidence,
        arg_max(TRY_CAST(regexp_extract(s, '([0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE), i) FILTER (contains(lower(s), 'score') AND regexp_matches(s, '[0-9]')) AS x
        FROM l GROUP BY conv_id, turn),
    t AS (SELECT conv_id, turn, i, {S.strip(f"regexp_replace({S.strip('s')}, '^[-•]+', '')")} AS topic FROM l
        WHERE contains(lower(s), 'topic') OR contains(lower(s), 'theme') OR contains(s, '-') OR contains(s, '•')),
    k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS n FROM t WHERE topic <> ''),
    g AS (SELECT conv_id, turn, string_agg(topic, ' | ' ORDER BY i) AS topics FROM k WHERE n <= 5 GROUP BY ALL)
    SELECT conv_id, turn, sentiment, confidence, CASE WHEN x <= 10 THEN x / 10::DOUBLE WHEN x > 10 THEN least(x / 100::DOUBLE, 1.0::DOUBLE) END
        AS quality_score, coalesce(topics, '') AS topics FROM a LEFT JOIN g USING (conv_id, turn)""",
)
def response_parsing(spark, sf):
    r = F.col("response")
    return ri.responses(table(spark, sf, "conversations")).select(
        "conv_id",
        "turn",
        pr.response_sentiment(r).alias("sentiment"),
        pr.response_confidence(r).alias("confidence"),
        pr.response_score(r).alias("quality_score"),
        F.array_join(pr.response_topics(r), " | ").alias("topics"),
    )


@ENTRIES.add(
    "chat_transcripts",
    "N19",
    """SELECT conv_id, 0::BIGINT AS part, count(*) AS messages, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript
    FROM conversations GROUP BY conv_id""",
)
def chat_transcripts(spark, sf):
    m = F.transform("messages", lambda x: F.concat_ws(": ", x["role"], x["content"]))
    return pr.transcripts(table(spark, sf, "conversations")).select(
        "conv_id", "part", F.size("messages").cast("bigint").alias("messages"), F.array_join(m, "\n").alias("transcript")
    )


@ENTRIES.add(
    "backup_results",
    "N20",
    f"""WITH {S.COMPOUND}, {_JQ}, b AS (SELECT doc_id, CASE WHEN f1 + coalesce(f2, 0.0::DOUBLE) + f3 >= 0.3 THEN 1 ELSE 0 END AS estimate FROM q1)
    SELECT b.doc_id, coalesce(l.quality, b.estimate)::BIGINT AS quality, CASE WHEN l.quality IS NOT NULL THEN 'primary' ELSE 'backup' END AS origin
    FROM b LEFT JOIN labels l USING (doc_id)""",
)
def backup_results(spark, sf):
    rows = lx.add_compound(docs(spark, sf).select("doc_id", "text"), "text", P.SENTIMENT)
    weighted = quality.job_quality(F.col("text"), F.col("compound"))["quality_weighted"]
    estimate = rows.select("doc_id", F.when(weighted >= 0.3, 1).otherwise(0).cast("bigint").alias("quality"))
    primary = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("bigint"))
    return pr.with_backup(primary, estimate, "doc_id", "quality")
