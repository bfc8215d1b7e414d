"""The learned pair similarity: measures by hand, labels by brute force, held-out recall."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagelens.operators import duplicates as dup
from pagelens.operators import features as ft
from pagelens.operators import pair_model as pm


def texts(n=160):
    """Families of a text, its near copies, its words in another order, and strangers that share a rare word with it."""
    rng = random.Random(4)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("lon", "mar", "tis", "ven", "rop", "sat")]
    out = []
    for family in range(n // 8):
        base = rng.sample(words, 30)
        mixed = base[:]
        rng.shuffle(mixed)
        rare = f"rare{family}"
        near = [[*base[:k], f"x{family}{k}", *base[k + 1 :], rare] for k in (3, 9, 20)]
        out += [[*base, rare], *near, [*mixed, rare], *[[*rng.sample(words, 30), rare] for _ in range(3)]]
    return [" ".join(t) for t in out] + ["", None]


@pytest.fixture(scope="module")
def rows():
    return list(enumerate(texts()))


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id bigint, t string")


def unit(counts, idf):
    w = {k: n * idf[k] for k, n in counts.items()}
    norm = math.sqrt(sum(x * x for x in w.values()))
    return {k: x / norm for k, x in w.items()} if norm else {}


def test_measures_equal_those_by_hand(spark, df, rows):
    pairs = spark.createDataFrame([(a, a + d) for a in range(0, 60, 3) for d in (1, 5)] + [(0, 160), (160, 161)], "content1_id bigint, content2_id bigint")
    got = dup.pair_measures(pairs, dup.profiles(df, "id", "t"), hot_rows=1).collect()
    assert len(got) == pairs.count()
    tokens = {i: (t or "").split() for i, t in rows}
    terms = {i: Counter([*w, *[f"{x} {y}" for x, y in zip(w, w[1:])]]) for i, w in tokens.items()}
    seen = Counter(k for c in terms.values() for k in c)
    idf = {k: math.log((1 + len(rows)) / (1 + n)) + 1 for k, n in seen.items()}
    totals = Counter()
    for c in terms.values():
        totals.update(c)
    listed = sorted((k for k in seen if seen[k] <= 0.95 * len(rows)), key=lambda k: (-totals[k], k))[: ft.MAX_TERMS]
    own = {i: unit({k: n for k, n in c.items() if k in set(listed)}, idf) for i, c in terms.items() if i < 80 or i > 159}
    for r in got:
        a, b = r["content1_id"], r["content2_id"]
        x, y = set(tokens[a]), set(tokens[b])
        assert r["jaccard_similarity"] == pytest.approx(len(x & y) / len(x | y) if x | y else 0.0)
        assert r["cosine_similarity"] == pytest.approx(sum(w * own[b].get(k, 0.0) for k, w in own[a].items()))
        longest = max(len(tokens[a]), len(tokens[b]))
        assert r["length_ratio"] == pytest.approx(min(len(tokens[a]), len(tokens[b])) / longest if longest else 1.0)


def test_phrases(one):
    assert one(lambda f: pm.phrases(f.col("x")), "A b  c d a b c") == ["a b c", "b c d", "c d a", "d a b"]
    assert one(lambda f: pm.phrases(f.col("x")), "A b") == ["a b"] and one(lambda f: pm.phrases(f.col("x")), " ") == []


def test_candidates_hold_both_kinds_and_the_model_tells_them_apart(spark, df):
    found, report = pm.learned(df, "id", "t", hot_rows=20)
    rows = found.collect()
    assert all(0 <= r["probability"] <= 1 and r["is_duplicate"] == (r["probability"] >= 0.8) for r in rows)
    close = [r for r in rows if r["jaccard_similarity"] >= 0.9]
    far = [r for r in rows if r["jaccard_similarity"] <= 0.4]
    assert close and far
    assert min(r["probability"] for r in close if r["cosine_similarity"] > 0.8) > max(r["probability"] for r in far)
    r = report.first()
    assert r["duplicates"] > 5 and r["pairs"] > r["duplicates"]
    # Texts with the same words in another order are told apart by the word pairs in the cosine alone.
    assert r["recall"] >= 0.8 and r["precision"] >= 0.8


def test_one_class_and_no_pairs(spark):
    same = spark.createDataFrame([(1, "a b c d"), (2, "a b c d e")], "id bigint, t string")
    out, report = pm.learned(same, "id", "t")
    assert report.first()["pairs"] in (0, 1) and all(r["probability"] < 0.01 or r["probability"] > 0.99 for r in out.collect())
    assert pm.learned(same.limit(0), "id", "t")[0].count() == 0


def test_tfidf_rows_are_unit_rows(spark, df):
    found = ft.tfidf_rows(df, "id", "t", ["balon"])
    for r in found.rows.collect():
        assert list(r["indices"]) == sorted(set(r["indices"]))
        assert not r["weights"] or math.isclose(sum(w * w for w in r["weights"]), 1.0)
    assert "balon" not in found.words
    assert ft.tfidf(df.filter("t = ''"), "id", "t", []).count() == 0
