"""SQL fragments shared by the checking queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pagelens import seeds
from pagelens.functions import html
from pagelens.plans import parameters as P

TOKEN = r"'[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]'"
BLANKS = r"E' \t\r\n\f\x0B' || chr(160)"
WORD = r"'[^\s\x{00A0}]+'"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {TOKEN})"


def strip(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def clean(x: str) -> str:
    no_urls = rf"regexp_replace({x}, 'https?://[!$-_a-z]+', '', 'g')"
    no_mail = rf"regexp_replace({no_urls}, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}\b', '', 'g')"
    folded = rf"regexp_replace({no_mail}, '\s+', ' ', 'g')"
    return rf"trim(regexp_replace({folded}, '[^\p{{L}}\p{{N}}_\s.!?,;:\-()]', ' ', 'g'), ' ')"


def clean_parity(x: str) -> str:
    folded = rf"regexp_replace({x}, '\s+', ' ', 'g')"
    kept = rf"regexp_replace({folded}, '[^\p{{L}}\p{{N}}_\s.!?,;:\-()]', ' ', 'g')"
    no_urls = rf"regexp_replace({kept}, 'https?://[!$-_a-z]+', '', 'g')"
    return rf"trim(regexp_replace({no_urls}, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}\b', '', 'g'), ' ')"


def alpha(x: str) -> str:
    return rf"list_filter({tokens(x)}, lambda w: regexp_full_match(w, '\p{{L}}+'))"


def word_list(words: Sequence[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


STOP = word_list(seeds.all_stop_words())


def content_words(x: str, min_length: int = 1) -> str:
    return f"list_filter({alpha(x)}, lambda w: length(w) >= {min_length} AND NOT list_contains({STOP}, w))"


def sentences(x: str) -> str:
    parts = f"list_transform(string_split_regex({x}, '[.!?]+'), lambda s: {strip('s')})"
    return f"list_filter({parts}, lambda s: s <> '')"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, {WORD})"


def syllables(list_sql: str) -> str:
    one = (
        "greatest(1, len(regexp_extract_all(w, '[aeiouy]+')) - "
        "CASE WHEN w LIKE '%e' AND len(regexp_extract_all(w, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END)"
    )
    return f"coalesce(list_sum(list_transform({list_sql}, lambda w: {one})), 0)::BIGINT"


def rounded(x: str, places: int) -> str:
    return f"(floor(({x})::DOUBLE * {10**places}::DOUBLE + 0.5::DOUBLE) / {10**places}::DOUBLE)"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a})::DOUBLE / ({b})::DOUBLE ELSE 0.0::DOUBLE END"


# --- pages ---------------------------------------------------------------------------------------
TAG = """<[a-zA-Z/!?](?:[^>"'']|"[^"]*"|''[^'']*'')*>"""
A_TAG = r"""(?is)<a((?:\s(?:[^>"'']|"[^"]*"|''[^'']*'')*)?)>(.*?)</a\s*>"""
IMG_TAG = r"""(?is)<img\b((?:[^>"'']|"[^"]*"|''[^'']*'')*)>"""
MARKUP = (
    r"markup AS (SELECT page_id, url, html, regexp_replace(regexp_replace(regexp_replace(html, "
    r"'(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g'), "
    r"'(?s)<!--.*?-->', '', 'g') AS m FROM pages)"
)


def decode(x: str) -> str:
    for name, char in html.NAMED:
        x = f"replace({x}, '{name}', chr({ord(char)}))"
    return x


def inner(x: str) -> str:
    return strip(decode(f"regexp_replace({x}, '{TAG}', '', 'g')"))


def fold(x: str) -> str:
    parts = rf"list_transform(string_split_regex({x}, '\r\n|\r|\n|  '), lambda s: {strip('s')})"
    return f"array_to_string(list_filter({parts}, lambda s: s <> ''), ' ')"


def visible(m: str, fused: bool = False) -> str:
    src = m if fused else f"regexp_replace({m}, '{html.BLOCK_TAG}', chr(10), 'g')"
    return fold(decode(f"regexp_replace({src}, '{TAG}', '', 'g')"))


def title(m: str) -> str:
    return (
        rf"CASE WHEN regexp_matches({m}, '(?is)<title\b[^>]*>.*?</title') THEN "
        + inner(rf"regexp_extract({m}, '(?is)<title\b[^>]*>(.*?)</title', 1)")
        + " ELSE 'No title' END"
    )


def attribute(tag: str, name: str) -> str:
    raw = rf"""regexp_extract({tag}, '(?is)(?:^|\s){name}\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1)"""
    return decode(f"""regexp_replace({raw}, '^["'']|["'']$', '', 'g')""")


def absolute(href: str, url: str) -> str:
    return (
        f"CASE WHEN regexp_matches({href}, '^https?://') THEN {href} "
        f"WHEN starts_with({href}, '//') THEN regexp_extract({url}, '^([A-Za-z][A-Za-z0-9+.-]*:)//', 1) || {href} "
        f"WHEN starts_with({href}, '/') THEN regexp_extract({url}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || {href} END"
    )


LINKS = (
    MARKUP
    + f""", anchors AS (SELECT page_id, url, unnest(regexp_extract_all(m, '{A_TAG}', 1)) AS attrs,
        unnest(regexp_extract_all(m, '{A_TAG}', 2)) AS body, unnest(range(1, 1 + len(regexp_extract_all(m, '{A_TAG}', 1)))) AS i FROM markup),
    resolved AS (SELECT page_id, url AS src_url, i, {attribute('attrs', 'href')} AS href, {inner('body')} AS text FROM anchors),
    links AS (SELECT page_id, src_url, row_number() OVER (PARTITION BY page_id ORDER BY i) AS position, dst_url, text FROM
        (SELECT *, {absolute('href', 'src_url')} AS dst_url FROM resolved) WHERE dst_url IS NOT NULL)"""
)


def host(url: str) -> str:
    return f"lower(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"


URL_LIST = (
    MARKUP
    + f""", url_list AS (SELECT page_id AS batch_id, 1 AS k, 0 AS i, url FROM pages UNION ALL
        SELECT page_id, 2, i, {attribute('attrs', 'href')} FROM (SELECT page_id,
        unnest(regexp_extract_all(m, '{A_TAG}', 1)) AS attrs,
        unnest(range(1, 1 + len(regexp_extract_all(m, '{A_TAG}', 1)))) AS i FROM markup)),
    listed AS (SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY k, i) AS position, {strip('url')} AS url
        FROM url_list WHERE {strip('url')} <> '')"""
)

WELL_FORMED = (
    r"(?i)^[a-z][a-z0-9+.-]*://(?:[^\s/?#@]+@)?"
    r"(?:(?:[\p{L}\p{N}](?:[\p{L}\p{N}_-]*[\p{L}\p{N}])?\.)+[\p{L}]{2,}|[0-9]{1,3}(?:\.[0-9]{1,3}){3}|localhost)"
    r"(?::[0-9]{1,5})?(?:[/?#]\S*)?$"
)
REFUSED_URL = r"(?i)localhost|127\.0\.0\.1|192\.168\.|10\.|172\.(1[6-9]|2[0-9]|3[0-1])\.|file://|ftp://|javascript:|data:"
REFUSED_CONTENT = r"(?is)<script[^>]*>.*?</script>|javascript:|data:image|base64,"


def url_reason(url: str, strict: bool = False) -> str:
    u = strip(url)
    h = rf"regexp_extract({u}, '^[^/?#]*//(?:[^/?#@]*@)?([^/?#:]*)', 1)"
    scope = h if strict else u
    return (
        f"CASE WHEN {url} IS NULL OR {url} = '' THEN 'empty' WHEN length({u}) < 10 THEN 'too short' "
        f"WHEN NOT regexp_matches({u}, '{WELL_FORMED}') THEN 'malformed' "
        f"WHEN lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) NOT IN ('http', 'https') THEN 'scheme' "
        f"WHEN {h} = '' THEN 'no host' WHEN regexp_matches({scope}, '{REFUSED_URL}') THEN 'refused pattern' END"
    )


def content_reason(text: str) -> str:
    t = strip(text)
    special = rf"length(regexp_replace({t}, '[\p{{L}}\p{{N}}\s]', '', 'g'))::DOUBLE / length({t})::DOUBLE"
    return (
        f"CASE WHEN {text} IS NULL OR {text} = '' THEN 'empty' WHEN length({t}) < 10 THEN 'too short' "
        f"WHEN length({t}) > 10000 THEN 'too long' WHEN len({words(t)}) < 3 THEN 'too few words' "
        f"WHEN {special} > 0.5 THEN 'special characters' "
        f"WHEN regexp_matches({text}, '{REFUSED_CONTENT}') THEN 'refused pattern' END"
    )


# --- documents -----------------------------------------------------------------------------------
DISPLAY = f"""display AS (SELECT *, len({words('text')}) AS word_count, len({sentences('text')}) AS sentence_count,
    length(text) AS character_count, length(regexp_replace(text, '[\\s\\x{{00A0}}]+', '', 'g')) AS word_chars,
    len(list_distinct(list_filter(list_transform({words('text')}, lambda w: lower(w)),
        lambda w: regexp_full_match(w, '\\p{{L}}+')))) AS unique_words FROM documents),
  display2 AS (SELECT *, word_count::DOUBLE / greatest(sentence_count, 1)::DOUBLE AS avg_words_per_sentence,
    word_chars::DOUBLE / greatest(word_count, 1)::DOUBLE AS avg_word_length,
    unique_words::DOUBLE / greatest(word_count, 1)::DOUBLE AS lexical_diversity FROM display),
  display3 AS (SELECT *, greatest(0.0::DOUBLE, least(100.0::DOUBLE, 206.835::DOUBLE - (1.015::DOUBLE * avg_words_per_sentence)
    - (84.6::DOUBLE * avg_word_length / 2.0::DOUBLE))) AS readability_score FROM display2)"""


def substring_scores(text: str, lists: Mapping[str, Sequence[str]]) -> str:
    def score(ws: Sequence[str]) -> str:
        tests = []
        for w in dict.fromkeys(ws):
            tests.append(f"contains(lower({text}), '{w}')::INT")
        return " + ".join(tests)

    return ", ".join(f"({score(ws)})::BIGINT AS score_{c}" for c, ws in lists.items())


def first_best(columns: Sequence[tuple[str, str]]) -> str:
    """CASE over (column, name) pairs: the first column that equals the greatest."""
    best = "greatest(" + ", ".join(c for c, _ in columns) + ")"
    return "CASE " + " ".join(f"WHEN {c} = {best} THEN '{n}'" for c, n in columns) + " END"


SCORES = [(f"score_{c}", c) for c in seeds.SUBSTRING_CATEGORIES]
BEST_SCORE = "greatest(" + ", ".join(c for c, _ in SCORES) + ")"
COMPOUND = f"""valence AS (SELECT t.doc_id, sum(l.valence) AS total FROM
    (SELECT doc_id, unnest({tokens('text')}) AS word FROM documents) t
    JOIN {seeds.sql_values(P.SENTIMENT, 'word, valence, polarity, subjectivity')} l USING (word) GROUP BY t.doc_id)"""


def compound(total: str) -> str:
    return f"{total} / sqrt({total} * {total} + 15.0::DOUBLE)"


def length_factor(w: str) -> str:
    return (
        f"CASE WHEN {w} < 300 THEN least({w}::DOUBLE / 300::DOUBLE, 1.0::DOUBLE) "
        f"ELSE greatest(0.5::DOUBLE, 1.0::DOUBLE - ({w}::DOUBLE - 1000::DOUBLE) / 2000::DOUBLE) END"
    )


def sentiment_factor(label: str, confidence: str) -> str:
    return (
        f"CASE WHEN {label} = 'positive' THEN 0.8::DOUBLE + {confidence} * 0.2::DOUBLE "
        f"WHEN {label} = 'negative' THEN 0.6::DOUBLE - {confidence} * 0.2::DOUBLE ELSE 0.7::DOUBLE END"
    )


ENRICHED = f"""{DISPLAY}, {COMPOUND},
  scored AS (SELECT d.*, {substring_scores('d.text', seeds.SUBSTRING_CATEGORIES)},
    coalesce(v.total, 0.0::DOUBLE) AS total FROM display3 d LEFT JOIN valence v USING (doc_id)),
  labelled AS (SELECT *, {compound('total')} AS compound, {first_best(SCORES)} AS category, {BEST_SCORE} AS keyword_matches,
    least({BEST_SCORE}::DOUBLE / greatest(word_count::DOUBLE * 0.01::DOUBLE, 1.0::DOUBLE), 1.0::DOUBLE) AS category_confidence FROM scored),
  sentimental AS (SELECT *, CASE WHEN compound > 0.05 THEN 'positive' WHEN compound < -0.05 THEN 'negative' ELSE 'neutral' END
    AS sentiment FROM labelled),
  content AS MATERIALIZED (SELECT doc_id AS content_id, 'job_' || source AS job_id, 'https://' || source || '.example.org/' || doc_id AS url,
    {strip("regexp_extract(text, '^[^.!?' || chr(10) || ']*', 0)")} AS title, text AS content,
    TIMESTAMP '2024-01-01' + to_seconds(doc_id) AS scraped_at, 'static' AS engine, {content_reason('text')} AS error,
    word_count, readability_score, compound, sentiment, category, category_confidence, keyword_matches,
    ({length_factor('word_count')}) * 0.3::DOUBLE + (readability_score / 100.0::DOUBLE) * 0.4::DOUBLE
      + ({sentiment_factor('sentiment', 'abs(compound)')}) * 0.3::DOUBLE AS quality_score FROM sentimental)"""

CUBE = """cube AS (SELECT job_id, category, sentiment, count(*) AS n, sum(word_count)::BIGINT AS words,
    sum(quality_score) AS quality, min(content_id) AS first_id FROM content GROUP BY ALL)"""

JOB_ROWS = f"""job_rows AS (SELECT doc_id AS content_id, 'job_' || source AS job_id,
    'https://' || source || '.example.org/' || doc_id AS url, TIMESTAMP '2024-01-01' + to_seconds(doc_id) AS seen_at,
    {content_reason('text')} AS reason FROM documents)"""
JOBS = (
    JOB_ROWS
    + f""", counters AS (SELECT job_id, count(*) AS total_urls, count_if(reason IS NULL)::BIGINT AS processed_urls,
    count_if(reason IS NOT NULL)::BIGINT AS failed_urls, min(seen_at) AS start_time, max(seen_at) AS end_time,
    datediff('second', min(seen_at), max(seen_at)) AS duration FROM job_rows GROUP BY job_id),
  cancelled AS (SELECT 'job_' || d.source AS job_id FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1
    GROUP BY 1 HAVING count(*) >= {P.CANCELLED_TOXIC}),
  jobs AS (SELECT c.*, CASE WHEN x.job_id IS NOT NULL THEN 'cancelled'
      WHEN total_urls = 0 OR (processed_urls + failed_urls >= total_urls AND processed_urls = 0) THEN 'failed'
      WHEN processed_urls + failed_urls >= total_urls THEN 'completed'
      WHEN processed_urls + failed_urls > 0 THEN 'running' ELSE 'pending' END AS status
    FROM counters c LEFT JOIN cancelled x USING (job_id))"""
)
