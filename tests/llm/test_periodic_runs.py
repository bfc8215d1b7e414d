"""Periodic runs against a brute-force version, over hand-made word lists and over the registered query."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelens.llm import periodic_runs
from pagelens.llm.catalog import ENTRIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words):
    """Every maximal stretch of each period, kept if no smaller period covers the same stretch."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            begin = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - begin
            if length >= max(6, 4 * q) and (begin, length) not in found:
                found[begin, length] = q
    return sorted(((b, m, q) for (b, m), q in found.items()), key=lambda r: (r[0], r[2]))


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def report(words):
    runs = brute_runs(words)
    dropped = {i for b, m, q in runs for i in range(b + q, b + m)}
    top = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (
        len(runs), *best, digest("".join(f"{b},{m},{q}\n" for b, m, q in runs)),
        digest(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def planted(doc, words):
    h = zlib.crc32(str(doc).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


@pytest.mark.parametrize("seed", range(30))
def test_runs_of_small_alphabets(seed):
    rng = random.Random(seed)
    words = []
    while len(words) < 150:
        unit = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(1, 9))]
        words += (unit * rng.randint(1, 7))[: rng.randint(1, 60)]
    number = np.unique(np.array(words), return_inverse=True)[1]
    assert periodic_runs.find_runs(number) == brute_runs(words)


def test_one_word_over_and_over_is_extended_once():
    number = np.zeros(300_000, dtype=np.int64)
    assert periodic_runs.find_runs(number) == [(0, 300_000, 1)]
    assert periodic_runs.find_runs(np.tile(np.arange(1000), 5)) == [(0, 5000, 1000)]
    assert periodic_runs.find_runs(np.zeros(5, dtype=np.int64)) == []
    with pytest.raises(ValueError):
        periodic_runs.find_runs(number, least_power=3)


def test_odd_rows(spark):
    rows = [
        (None, None), (1, ""), (2, " \t\n"), (3, "a b " * 3), (4, "a b " * 4), (4, "a b " * 4), (5, "x " * 6 + "y"), (6, "é ü " * 5 + "z é ü"),
        (7, " ".join(f"w{i}" for i in range(40_000))), (8, "b a b a b a b a b"), (None, "q " * 7),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("row", "runs", "n_words", "top", "collapsed")})
    got = periodic_runs.with_runs(df.repartition(3), "text").select("row.doc_id", "row.text", "runs", "collapsed", "n_words", "top").collect()
    assert len(got) == len(rows)
    for r in got:
        words = WORD.findall(r.text or "")
        assert [tuple(x) for x in r.runs] == brute_runs(words) if len(words) < 1000 else not r.runs
        assert r.n_words == len(words)
        assert (r.top is None) == (not r.runs)
    by = {r.doc_id: r.collapsed for r in got if r.doc_id is not None}
    assert by[1] == by[2] == "" and by[4] == "a b" and by[5] == "x y" and by[6] == "é ü z é ü" and by[8] == "b a"
    assert periodic_runs.with_runs(df.limit(0), "text").count() == 0


def test_op13_equals_brute_force(spark, small):
    query = {e.name: e for e in ENTRIES}["op13_periodic_runs"]
    got = {r[0]: tuple(r)[1:] for r in query.run(spark, small).collect()}
    docs = duckdb.sql(f"select doc_id, text from '{small}/documents.parquet'").fetchall()
    assert len(got) == len(docs)
    wanted = {doc: report(planted(doc, WORD.findall(text or ""))) for doc, text in docs if len(text or "") < 12_000}
    assert {doc: got[doc] for doc in wanted} == wanted
    assert sum(r[0] > 0 for r in got.values()) > 10
