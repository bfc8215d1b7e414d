"""HTML to page records with native regular expressions: one scan, no shuffle, no UDF."""

from __future__ import annotations

from html.entities import html5

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions.arrays import let
from pagelens.functions.text import blank_word_count, strip

# Markup patterns. Possessive repeats keep the matcher's stack flat on long tags.
# A block that is never closed hides the rest of the page, as in a browser.
SCRIPT = r"(?is)<script\b.*?(?:</script\s*>|\z)"
STYLE = r"(?is)<style\b.*?(?:</style\s*>|\z)"
COMMENT = r"(?s)<!--.*?-->"
TAG = r"""<[a-zA-Z/!?](?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
BLOCK_TAG = (
    r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|"
    r"header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>"
)
# What may follow an ampersand as a reference: a decimal or hexadecimal number, or a name, each with or without its semicolon.
REFERENCE = r"^(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
# The named references that the checking SQL spells out; decoding knows all of HTML's.
NAMED = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&nbsp;", "\u00a0"),
    ("&copy;", "©"),
    ("&reg;", "®"),
    ("&middot;", "·"),
    ("&ndash;", "–"),
    ("&mdash;", "—"),
    ("&hellip;", "…"),
    ("&euro;", "€"),
    ("&amp;", "&"),
)


# Numbers that stand for another character: zero, a line end, and those that old pages meant as Windows letters.
RENUMBERED = {0: "\ufffd", 13: "\r"} | {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}
# Names that HTML also accepts without a semicolon, and how long they can be.
BARE_NAMES = {name: char for name, char in html5.items() if not name.endswith(";")}
BARE_LENGTHS = range(max(map(len, BARE_NAMES)), min(map(len, BARE_NAMES)) - 1, -1)


def _table(pairs: dict[str, str]) -> Column:
    """A map that is folded into one constant; its look-up is a scan, so frequent and short lists come first."""
    return F.str_to_map(F.lit("\u0001".join(f"{k}\u0002{v}" for k, v in sorted(pairs.items()))), F.lit("\u0001"), F.lit("\u0002"))


def _numbered_character(ref: Column) -> Column:
    """The character of `#65;` or `#x41`: none for control codes, the replacement mark for what is no character."""
    hexed = F.lower(F.substring(ref, 2, 1)) == "x"
    digits = F.regexp_replace(F.regexp_replace(ref, r"^#[xX]?0*|;$", ""), "^$", "0")
    # Nine digits and more are beyond the last character in either base.
    code = F.when(F.length(digits) > 8, F.lit(0x110000)).when(hexed, F.conv(digits, 16, 10)).otherwise(digits).cast("bigint")

    def character(n: Column) -> Column:
        renamed = F.try_element_at(_table({str(k): v for k, v in RENUMBERED.items()}), n.cast("string"))
        control = n.between(1, 31) & ~n.isin(9, 10, 12, 13) | n.between(0x7F, 0x9F) | n.between(0xFDD0, 0xFDEF) | ((n % 0x10000) >= 0xFFFE)
        valid = n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
        plain = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, n).otherwise(F.lit(0xFFFD))), 8, "0")), "UTF-32")
        return F.coalesce(renamed, F.when(~valid, F.lit("\ufffd")).when(control, F.lit("")), plain)

    return let(code, character)


def _named_character(name: Column) -> Column:
    """The character of a name, or of the longest known name it begins with, followed by the rest."""
    full = _table({k: v for k, v in html5.items() if k.endswith(";")})
    bare = _table(BARE_NAMES)
    longest = [
        F.concat(F.try_element_at(bare, F.substring(name, 1, n)), F.substring(name, n + 1, 40)) for n in BARE_LENGTHS
    ]
    often = F.try_element_at(_table({k[1:]: v for k, v in NAMED}), name)
    return F.coalesce(often, F.when(name.endswith(";"), F.try_element_at(full, name)), *longest, F.concat(F.lit("&"), name))


def _after_ampersand(part: Column) -> Column:
    """The text from one ampersand to the next: its reference, if there is one, and what follows."""

    def resolved(ref: Column) -> Column:
        char = F.when(ref == "", F.lit("&")).when(ref.startswith("#"), _numbered_character(ref)).otherwise(_named_character(ref))
        return F.concat(char, F.substr(part, F.length(ref) + 1))

    return let(F.regexp_extract(part, REFERENCE, 0), resolved)


def _references(text: Column) -> Column:
    """One pass from left to right: what a reference gives is never read again."""
    parts = F.split(text, "&", -1)
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), _after_ampersand)
    return F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))


def decode_entities(col: Column) -> Column:
    """Named and numeric character references; text without an ampersand is passed through.

    Where every ampersand is spelt `&amp;`, as in most addresses, replacing them is the same single pass.
    """
    one_kind = lambda x: F.when(~x.rlike("&(?!amp;)"), F.replace(x, F.lit("&amp;"), F.lit("&")))
    return let(col, lambda x: F.when(F.contains(x, F.lit("&")), F.coalesce(one_kind(x), _references(x))).otherwise(x))


def without_code(html: Column) -> Column:
    """H1: the page without script and style elements and without comments."""
    out = F.regexp_replace(html, SCRIPT, "")
    out = F.regexp_replace(out, STYLE, "")
    return F.regexp_replace(out, COMMENT, "")


def inner_text(fragment: Column) -> Column:
    """Text of a fragment: tags removed with no separator, references decoded, trimmed."""
    return strip(decode_entities(F.regexp_replace(fragment, TAG, "")))


def title(markup: Column) -> Column:
    """H2: title text, or the stated default when the page has no title element."""
    found = F.regexp_extract(markup, r"(?is)<title\b[^>]*>(.*?)</title", 1)
    return F.when(markup.rlike(r"(?is)<title\b[^>]*>.*?</title"), inner_text(found)).otherwise(F.lit("No title"))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute inside a tag's text, decoded; empty when absent."""
    raw = F.regexp_extract(tag, rf"""(?is)(?:^|\s){name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return decode_entities(F.regexp_replace(raw, r"""^["']|["']$""", ""))


def description(markup: Column) -> Column:
    """H3: content of the first description meta tag, attributes in either order."""
    named = r"""(?is)<meta\b(?=[^>]*\sname\s*=\s*["']?description["'\s/>])[^>]*>"""
    return attribute(F.regexp_extract(markup, named, 0), "content")


def fold_lines(col: Column) -> Column:
    """Lines trimmed, split at double spaces, blanks dropped, joined by one space."""
    parts = F.transform(F.split(col, r"\r\n|\r|\n|  ", -1), strip)
    return F.array_join(F.filter(parts, lambda p: p != ""), " ")


def visible_text(markup: Column, fused: bool = False) -> Column:
    """H4: visible text. `fused` joins neighbouring blocks as plain tag removal does;
    the default breaks the line at block tags, so words of two blocks stay apart."""
    source = markup if fused else F.regexp_replace(markup, BLOCK_TAG, "\n")
    return fold_lines(decode_entities(F.regexp_replace(source, TAG, "")))


def absolute(href: Column, page_url: Column) -> Column:
    """Absolute http(s) targets kept, root-relative resolved on the page, all else null."""
    scheme = F.regexp_extract(page_url, r"^([A-Za-z][A-Za-z0-9+.-]*:)//", 1)
    origin = F.regexp_extract(page_url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    return (
        F.when(href.rlike(r"^https?://"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(origin, href))
    )


A_TAG = r"""(?is)<a((?:\s(?:[^>"']++|"[^"]*+"|'[^']*+')*+)?)>(.*?)</a\s*>"""
IMG_TAG = r"""(?is)<img\b((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""


def links(markup: Column, page_url: Column) -> Column:
    """H6: array of (url, text) in document order."""
    pairs = F.arrays_zip(
        F.regexp_extract_all(markup, F.lit(A_TAG), F.lit(1)).alias("attrs"),
        F.regexp_extract_all(markup, F.lit(A_TAG), F.lit(2)).alias("body"),
    )
    found = F.transform(
        pairs,
        lambda x: F.struct(
            absolute(attribute(x["attrs"], "href"), page_url).alias("url"), inner_text(x["body"]).alias("text")
        ),
    )
    return F.filter(found, lambda x: x["url"].isNotNull())


def hrefs(markup: Column) -> Column:
    """Raw href values in document order, before any resolution."""
    return F.transform(
        F.regexp_extract_all(markup, F.lit(A_TAG), F.lit(1)), lambda attrs: attribute(attrs, "href")
    )


def images(markup: Column, page_url: Column) -> Column:
    """H7: array of (url, alt, title) under the same address rule."""
    found = F.transform(
        F.regexp_extract_all(markup, F.lit(IMG_TAG), F.lit(1)),
        lambda t: F.struct(
            absolute(attribute(t, "src"), page_url).alias("url"),
            attribute(t, "alt").alias("alt"),
            attribute(t, "title").alias("title"),
        ),
    )
    return F.filter(found, lambda x: x["url"].isNotNull())


def headers(markup: Column) -> Column:
    """H8: array of (level, text), by level and then document order."""

    def at(level: int) -> Column:
        bodies = F.regexp_extract_all(markup, F.lit(rf"(?is)<h{level}\b[^>]*>(.*?)</h{level}\s*>"), F.lit(1))
        return F.transform(bodies, lambda b: F.struct(F.lit(level).alias("level"), b.alias("body")))

    found = F.concat(*[at(level) for level in range(1, 7)])
    return F.transform(found, lambda h: F.struct(h["level"].alias("level"), inner_text(h["body"]).alias("text")))


FIELDS = ("title", "description", "text_content", "text_fused", "links", "images", "headers")


def parse_pages(pages: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(page_id, url, html) to page records. Blank pages become error rows, never exceptions.

    Only the named fields are built; `word_count` (H5) comes with `text_content`.
    """
    m, url = F.col("markup"), F.col("url")
    build: dict[str, Callable[[], Column]] = {
        "title": lambda: title(m),
        "description": lambda: description(m),
        "text_content": lambda: visible_text(m),
        "text_fused": lambda: visible_text(m, fused=True),
        "links": lambda: links(m, url),
        "images": lambda: images(m, url),
        "headers": lambda: headers(m),
    }
    empty = F.col("html").isNull() | (F.trim("html") == "")
    out = pages.withColumn("markup", without_code(F.coalesce("html", F.lit(""))))
    out = out.withColumns({**{f: build[f]() for f in fields}, "error": F.when(empty, F.lit("empty page"))})
    if "text_content" in fields:
        out = out.withColumn("word_count", blank_word_count(F.col("text_content")))
    return out.drop("markup")


# Marks of script-rendered pages, in addresses and in page source.
SCRIPT_URL_MARKS = ("spa", "react", "angular", "vue")
SCRIPT_PAGE_MARKS = ("window.react", "window.angular", "window.vue", "data-reactroot", "ng-app", "v-app")
ENGINES = ("static", "javascript", "dynamic")


def detect_rendering(url: Column, html: Column) -> Column:
    """Rendering type from marks in the address, then in the page source."""

    def any_of(col: Column, marks: tuple[str, ...]) -> Column:
        test = F.lit(False)
        for mark in marks:
            test = test | F.contains(F.lower(col), F.lit(mark))
        return test

    return (
        F.when(any_of(url, SCRIPT_URL_MARKS), "javascript")
        .when(html.isNull(), "dynamic")
        .when(any_of(html, SCRIPT_PAGE_MARKS), "javascript")
        .otherwise("static")
    )


def choose_engine(requested: Column, detected: Column) -> Column:
    """The engine that runs. `auto` or null means detection; unknown names run as static."""
    wanted = F.when(requested.isNull() | (requested == "auto"), detected).otherwise(requested)
    return F.when(wanted.isin(*ENGINES), wanted).otherwise("static")
