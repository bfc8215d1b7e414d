"""Queries over `pages`: parsing, links, addresses, rendering type."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelens.functions import checks, html
from pagelens.operators import links as link_ops
from pagelens.operators.skew import numbered
from pagelens.plans import sql as S
from pagelens.plans.entry import Registry, pages
from pagelens.sources.tables import listed_urls, url_lists

ENTRIES = Registry()


@ENTRIES.add(
    "host_page_report",
    "S1 H1 H2 H4 H5 P1",
    f"""WITH {S.MARKUP}, t AS (SELECT {S.host('url')} AS host, {S.url_reason('url')} AS reason,
        len({S.words(S.visible('m'))}) AS w, {S.title('m')} AS title FROM markup)
    SELECT host, count(*) AS pages, count_if(reason IS NULL)::BIGINT AS valid_pages, sum(w)::BIGINT AS words,
        sum(w)::DOUBLE / count(*)::DOUBLE AS avg_words, count_if(title <> 'No title')::BIGINT AS titled FROM t GROUP BY host""",
)
def host_page_report(spark, sf):
    rows = html.parse_pages(pages(spark, sf), ("title", "text_content"))
    return rows.groupBy(link_ops.host_of(F.col("url")).alias("host")).agg(
        F.count(F.lit(1)).alias("pages"),
        F.count(F.when(checks.url_is_valid(F.col("url")), 1)).alias("valid_pages"),
        F.sum("word_count").alias("words"),
        (F.sum("word_count").cast("double") / F.count(F.lit(1)).cast("double")).alias("avg_words"),
        F.count(F.when(F.col("title") != "No title", 1)).alias("titled"),
    )


@ENTRIES.add(
    "page_text",
    "S1 H1 H2 H4 H5",
    f"""WITH {S.MARKUP} SELECT page_id, {S.title('m')} AS title, {S.visible('m')} AS text_content,
        len({S.words(S.visible('m'))}) AS word_count FROM markup""",
)
def page_text(spark, sf):
    return html.parse_pages(pages(spark, sf), ("title", "text_content")).select(
        "page_id", "title", "text_content", "word_count"
    )


@ENTRIES.add(
    "page_text_fused",
    "H4",
    f"WITH {S.MARKUP} SELECT page_id, {S.visible('m', fused=True)} AS text_fused FROM markup",
)
def page_text_fused(spark, sf):
    return html.parse_pages(pages(spark, sf), ("text_fused",)).select("page_id", "text_fused")


@ENTRIES.add(
    "page_description",
    "H3",
    rf"""WITH pages AS (SELECT page_id, url, regexp_replace(html, '<title>([^<]*)</title>',
        '<title>\1</title><meta content="\1" name="description">', 'g') AS html FROM main.pages), {S.MARKUP}, tags AS (SELECT page_id, unnest(regexp_extract_all(m, '(?is)<meta\b[^>]*>')) AS tag FROM markup),
    named AS (SELECT page_id, min({S.attribute('tag', 'content')}) AS d FROM tags
        WHERE lower({S.attribute('tag', 'name')}) = 'description' GROUP BY page_id)
    SELECT page_id, coalesce(d, '') AS description FROM markup LEFT JOIN named USING (page_id)""",
)
def page_description(spark, sf):
    # The landed pages carry no description tag, so each title is repeated as one.
    told = F.regexp_replace(
        "html", "<title>([^<]*)</title>", '<title>$1</title><meta content="$1" name="description">'
    )
    rows = pages(spark, sf).withColumn("html", told)
    return html.parse_pages(rows, ("description",)).select("page_id", "description")


@ENTRIES.add("page_links", "H6", f"WITH {S.LINKS} SELECT page_id, position, dst_url, text FROM links")
def page_links(spark, sf):
    return link_ops.edges(html.parse_pages(pages(spark, sf), ("links",))).select("page_id", "position", "dst_url", "text")


@ENTRIES.add(
    "page_images",
    "H7",
    rf"""WITH pages AS (SELECT page_id, url, regexp_replace(html, '<a href="([^"]*)">([^<]*)</a>',
        '<img alt="\2" src="\1" title=\2>', 'g') AS html FROM main.pages), {S.MARKUP},
    tags AS (SELECT page_id, url, unnest(regexp_extract_all(m, '{S.IMG_TAG}', 1)) AS tag FROM markup)
    SELECT page_id, {S.absolute(S.attribute('tag', 'src'), 'url')} AS image_url, {S.attribute('tag', 'alt')} AS alt,
        {S.attribute('tag', 'title')} AS title FROM tags WHERE {S.absolute(S.attribute('tag', 'src'), 'url')} IS NOT NULL""",
)
def page_images(spark, sf):
    # The landed pages carry no images, so each plain link is rewritten as one.
    drawn = F.regexp_replace("html", '<a href="([^"]*)">([^<]*)</a>', '<img alt="$2" src="$1" title=$2>')
    rows = html.parse_pages(pages(spark, sf).withColumn("html", drawn), ("images",))
    return (
        rows.select("page_id", F.explode_outer("images").alias("x"))
        .select("page_id", F.col("x.url").alias("image_url"), "x.alt", "x.title")
        .filter("image_url IS NOT NULL")
    )


_LEVELS = " UNION ALL ".join(
    rf"SELECT page_id, {i}::BIGINT AS level, unnest(regexp_extract_all(m, '(?is)<h{i}\b[^>]*>(.*?)</h{i}\s*>', 1)) AS body FROM markup"
    for i in range(1, 7)
)


@ENTRIES.add(
    "page_headers", "H8", f"WITH {S.MARKUP}, found AS ({_LEVELS}) SELECT page_id, level, {S.inner('body')} AS text FROM found"
)
def page_headers(spark, sf):
    rows = html.parse_pages(pages(spark, sf), ("headers",))
    return (
        rows.select("page_id", F.explode_outer("headers").alias("h"))
        .select("page_id", F.col("h.level").cast("bigint").alias("level"), "h.text")
        .filter("level IS NOT NULL")
    )


@ENTRIES.add(
    "page_metadata_counts",
    "H9 S6",
    f"""WITH {S.LINKS}, found AS ({_LEVELS}), l AS (SELECT page_id, count(*) AS n FROM links GROUP BY 1),
    h AS (SELECT page_id, count(*) AS n FROM found GROUP BY 1),
    i AS (SELECT page_id, count(*) AS n FROM (SELECT page_id, url, unnest(regexp_extract_all(m, '{S.IMG_TAG}', 1)) AS tag FROM markup)
        WHERE {S.absolute(S.attribute('tag', 'src'), 'url')} IS NOT NULL GROUP BY 1)
    SELECT p.page_id, coalesce(l.n, 0) AS links_count, coalesce(i.n, 0) AS images_count, coalesce(h.n, 0) AS headers_count
    FROM pages p LEFT JOIN l USING (page_id) LEFT JOIN i USING (page_id) LEFT JOIN h USING (page_id)""",
)
def page_metadata_counts(spark, sf):
    return html.parse_pages(pages(spark, sf), ("links", "images", "headers")).select(
        "page_id",
        *[F.size(c).cast("bigint").alias(f"{c}_count") for c in ("links", "images", "headers")],
    )


@ENTRIES.add(
    "host_link_counts",
    "H10",
    f"""WITH {S.LINKS}, e AS (SELECT {S.host('src_url')} AS src, {S.host('dst_url')} AS dst, dst_url FROM links),
    o AS (SELECT src AS host, count(*) AS out_links, count(DISTINCT dst_url) AS distinct_targets FROM e GROUP BY 1),
    i AS (SELECT dst AS host, count(*) AS in_links FROM e GROUP BY 1)
    SELECT host, coalesce(out_links, 0)::BIGINT AS out_links, coalesce(in_links, 0)::BIGINT AS in_links,
        coalesce(distinct_targets, 0)::BIGINT AS distinct_targets FROM o FULL JOIN i USING (host)""",
)
def host_link_counts(spark, sf):
    return link_ops.host_counts(link_ops.edges(html.parse_pages(pages(spark, sf), ("links",))))


@ENTRIES.add("url_list_entries", "S3", f"WITH {S.URL_LIST} SELECT batch_id, position, url FROM listed")
def url_list_entries(spark, sf):
    return listed_urls(url_lists(pages(spark, sf)))


@ENTRIES.add(
    "url_batch_cap",
    "S2",
    f"""WITH {S.URL_LIST}, h AS (SELECT {S.host('p.url')} AS host, l.batch_id, l.position, l.url
        FROM listed l JOIN pages p ON p.page_id = l.batch_id)
    SELECT host, batch_id, position, url FROM
        (SELECT *, row_number() OVER (PARTITION BY host ORDER BY batch_id, position) AS k FROM h) WHERE k <= 100""",
)
def url_batch_cap(spark, sf):
    rows = listed_urls(url_lists(pages(spark, sf)), keep=("page_url",))
    k = F.row_number().over(W.partitionBy("host").orderBy("batch_id", "position"))
    # The cap is applied inside every task before the shuffle, so a hot host sends 100 rows per task.
    return (
        rows.select(link_ops.host_of(F.col("page_url")).alias("host"), "batch_id", "position", "url")
        .withColumn("k", k)
        .filter(F.col("k") <= checks.MAX_BATCH_URLS)
        .drop("k")
    )


@ENTRIES.add(
    "url_validity",
    "P1 P2",
    f"""WITH {S.URL_LIST} SELECT batch_id, position, {S.url_reason('url')} IS NULL AS is_valid, {S.url_reason('url')} AS reason,
        {S.url_reason('url', strict=True)} AS strict_reason FROM listed""",
)
def url_validity(spark, sf):
    u = F.col("url")
    return listed_urls(url_lists(pages(spark, sf))).select(
        "batch_id",
        "position",
        checks.url_is_valid(u).alias("is_valid"),
        checks.url_rejection(u).alias("reason"),
        checks.url_rejection(u, strict_host=True).alias("strict_reason"),
    )


@ENTRIES.add(
    "url_batch_report",
    "P4",
    f"""WITH {S.URL_LIST}, b AS (SELECT batch_id, count(*) AS urls, count_if({S.url_reason('url')} IS NULL)::BIGINT AS valid_urls
        FROM listed GROUP BY 1)
    SELECT batch_id, urls, valid_urls, urls - valid_urls AS invalid_urls, urls <= 100 AND valid_urls > 0 AS is_valid,
        CASE WHEN urls > 100 THEN 'Too many URLs (max: 100)' WHEN valid_urls = 0 THEN 'No valid URLs found' END AS error,
        CASE WHEN urls > valid_urls THEN (urls - valid_urls) || ' invalid URLs will be skipped' END AS warning FROM b""",
)
def url_batch_report(spark, sf):
    counts = (
        listed_urls(url_lists(pages(spark, sf)))
        .groupBy("batch_id")
        .agg(F.count(F.lit(1)).alias("urls"), F.count(F.when(checks.url_is_valid(F.col("url")), 1)).alias("valid_urls"))
    )
    urls, valid = F.col("urls"), F.col("valid_urls")
    return counts.select(
        "batch_id",
        "urls",
        "valid_urls",
        (urls - valid).alias("invalid_urls"),
        ((urls <= checks.MAX_BATCH_URLS) & (valid > 0)).alias("is_valid"),
        F.when(urls > checks.MAX_BATCH_URLS, f"Too many URLs (max: {checks.MAX_BATCH_URLS})")
        .when(valid == 0, "No valid URLs found")
        .alias("error"),
        F.when(urls > valid, F.concat((urls - valid).cast("string"), F.lit(" invalid URLs will be skipped"))).alias("warning"),
    )


_MARKS = " OR ".join(f"contains(lower(url), '{m}')" for m in html.SCRIPT_URL_MARKS)
_PAGE_MARKS = " OR ".join(f"contains(lower(html), '{m}')" for m in html.SCRIPT_PAGE_MARKS)
_DETECT = f"CASE WHEN {_MARKS} THEN 'javascript' WHEN html IS NULL THEN 'dynamic' WHEN {_PAGE_MARKS} THEN 'javascript' ELSE 'static' END"


@ENTRIES.add(
    "rendering_type",
    "P14 P15",
    f"""WITH d AS (SELECT page_id, {_DETECT} AS detected, CASE page_id % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'dynamic'
        WHEN 2 THEN 'unknown' END AS requested FROM pages)
    SELECT page_id, detected, CASE WHEN requested IS NULL OR requested = 'auto' THEN detected
        WHEN requested IN ('static', 'javascript', 'dynamic') THEN requested ELSE 'static' END AS engine_used FROM d""",
)
def rendering_type(spark, sf):
    detected = html.detect_rendering(F.col("url"), F.col("html"))
    kind = F.col("page_id") % 4
    requested = F.when(kind == 0, "auto").when(kind == 1, "dynamic").when(kind == 2, "unknown")
    out = pages(spark, sf).select("page_id", detected.alias("detected"), requested.alias("requested"))
    return out.select("page_id", "detected", html.choose_engine(F.col("requested"), F.col("detected")).alias("engine_used"))


@ENTRIES.add(
    "page_success_split",
    "P16 U1",
    f"""WITH {S.MARKUP}, t AS (SELECT page_id, url, {S.visible('m')} AS x FROM markup),
    r AS (SELECT page_id, coalesce({S.url_reason('url')}, {S.content_reason('x')}) AS error, len({S.words('x')}) AS w FROM t)
    SELECT CASE WHEN error IS NULL THEN 'success' ELSE 'error' END AS outcome, error, count(*) AS pages,
        sum(CASE WHEN error IS NULL THEN w END)::BIGINT AS words FROM r GROUP BY ALL""",
)
def page_success_split(spark, sf):
    from pagelens.streaming.ingest import page_rows

    # Both kinds of rows are in one table; fields a kind lacks are null. A filter for each kind would parse every page again.
    good = F.col("error").isNull()
    both = page_rows(pages(spark, sf)).select(
        F.when(good, "success").otherwise("error").alias("outcome"), "error", F.when(good, F.col("word_count")).alias("word_count")
    )
    return both.groupBy("outcome", "error").agg(F.count(F.lit(1)).alias("pages"), F.sum("word_count").alias("words"))


@ENTRIES.add(
    "page_positions",
    "W6",
    f"""SELECT {S.host('url')} AS host, page_id, row_number() OVER (PARTITION BY {S.host('url')} ORDER BY page_id) AS position
    FROM pages""",
)
def page_positions(spark, sf):
    rows = pages(spark, sf).select(link_ops.host_of(F.col("url")).alias("host"), "page_id")
    return numbered(rows, "page_id", ["host"])


@ENTRIES.add(
    "clean_export_names",
    "P13",
    """WITH n AS (SELECT page_id, trim(translate(url || '.html', '<>:"/\\|?*', '_________'), '. ') AS s FROM pages)
    SELECT page_id, CASE WHEN s = '' THEN 'untitled' WHEN length(s) > 255 THEN
        left(regexp_replace(s, '\\.[^.]*$', ''), 254 - length(regexp_extract(s, '\\.([^.]*)$', 1))) || '.' ||
        regexp_extract(s, '\\.([^.]*)$', 1) ELSE s END AS name FROM n""",
)
def clean_export_names(spark, sf):
    return pages(spark, sf).select("page_id", checks.clean_name(F.concat("url", F.lit(".html"))).alias("name"))
