"""Every declared language is a class, and the address suffix is evidence of its own."""

import math

import numpy as np
import pyarrow as pa

from pagelens.llm import language_id

SAMPLE_TEXT = "the quick brown fox jumps over a lazy dog"


def language_rows(n_languages, n_texts):
    """Invented languages, each with letters of its own order."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(n_languages):
        words = [letters[(k * 7 + i) % 26] + letters[(k * 3 + 5 * i) % 26] + letters[(k + 11 * i) % 26] for i in range(12)]
        rows += [(f"l{k:03d}-{n}", " ".join(words[n % 3 :] + words), f"l{k:03d}") for n in range(n_texts)]
    return rows


def test_more_languages_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(language_id, "BLOCK", 4)
    rows = language_rows(11, 6)
    df = spark.createDataFrame(rows, "id string, text string, lang string")
    whole = language_id.train_text(df, "text", "lang")
    assert len(whole.languages) == 11 and [b.shape[1] for b in whole.blocks] == [4, 4, 3]
    got = {r["row"]["id"]: r for r in language_id.identify(df, "text", "lang").collect()}
    assert len(got) == len(rows) and all(got[i].text_language == k == got[i].language for i, _, k in rows)


def test_training_equals_brute_force(spark):
    rows = language_rows(3, 5) + language_rows(3, 5)[:4] + [("x", None, "l000"), ("y", "one two", None)]
    df = spark.createDataFrame(rows, "id string, text string, lang string").repartition(5)
    model = language_id.train_text(df, "text", "lang")
    for j, k in enumerate(model.languages):
        table = np.ones(language_id.BUCKETS)
        for text in {t for _, t, lang in rows if lang == k and t}:
            codes, _, _ = language_id.trigrams(pa.array([text]))
            np.add.at(table, codes, 1)
        assert np.allclose(model.blocks[0][:, j], np.log(table / table.sum()), atol=1e-5)


def test_a_sample_takes_different_texts_once(spark):
    rows = [(i, SAMPLE_TEXT, "en") for i in range(50)] + [(100 + i, f"{SAMPLE_TEXT} {i}", "en") for i in range(5)]
    df = spark.createDataFrame(rows, "id bigint, text string, lang string").repartition(4)
    whole, again = (language_id.train_text(df, "text", "lang", sample=s) for s in (6, 100))
    assert np.array_equal(whole.blocks[0], again.blocks[0])


def test_suffix_rates_equal_counts(spark):
    hosts = ["a.de", "b.de", "c.at", "d.com", "10.0.0.1", "plain", None]
    rows = [(n, h, n % 2) for n, h in enumerate(hosts * 3)]
    scored = spark.createDataFrame(rows, "id bigint, h string, best int")
    found, whole = language_id._host_evidence(scored, 2, 10_000)
    got = {r.h: (r.prior, r.n) for r in found.collect()}
    assert set(got) == {h for h in hosts if h} and got["a.de"][1] == 3
    n = lambda keep: [sum(1 for _, h, k in rows if h and keep(h) and k == j) for j in (0, 1)]
    named = n(lambda h: h.split(".")[-1] in ("de", "at", "com"))
    for host in ("a.de", "plain", "10.0.0.1"):
        own, domain = n(lambda h: h == host), n(lambda h: h.split(".")[-2:] == host.split(".")[-2:])
        suffix = host.split(".")[-1] if host == "a.de" else None
        of_suffix = n(lambda h: suffix and h.endswith("." + suffix))
        for j in (0, 1):
            up = (domain[j] + 4 * whole[j]) / (sum(domain) + 4)
            wanted = math.log((own[j] + 4 * up) / (sum(own) + 4)) + (math.log((of_suffix[j] + 1) / (named[j] + 3)) if suffix else 0)
            assert math.isclose(got[host][0][j], wanted, rel_tol=1e-9)


def test_clashing_names(spark):
    rows = [(i, SAMPLE_TEXT, "en", "x", "y") for i in range(3)]
    df = spark.createDataFrame(rows, "`logs` bigint, `text` string, `m` string, `best` string, `h` string")
    got = language_id.identify(df, "text", "m", "best", "h").collect()
    assert len(got) == 3 and all(r["row"]["best"] == "x" and r.language == "en" for r in got)
