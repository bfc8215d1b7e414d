"""The positional index is written once, holds every word, and serves any search."""

import random

import numpy as np

from pagelens.llm import decontamination


def test_index_holds_every_position(spark):
    texts = [(1, "a b a, C"), (2, None), (3, ""), (4, "c c d"), (4, "c c d")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1)
    rows = decontamination.build_index(df, "doc_id", "text", slop=2).collect()
    assert len(rows) == 1
    row, at, got = rows[0], 0, {}
    assert row.keys == [1, 2, 3, 4, 4] and row.n_words == [4, 0, 0, 3, 3] and len(row.positions) == sum(row.sizes)
    for term, count, size in zip(row.terms, row.counts, row.sizes):
        got[term] = np.cumsum(decontamination.from_varint(row.positions[at : at + size])).tolist()
        assert len(got[term]) == count
        at += size
    places = {1: 0, 4: 13}
    assert got["a"] == [places[1], places[1] + 2] and got["c"] == [3, 13, 14, 19, 20] and got["d"] == [15, 21]


def test_one_index_serves_blocks_and_searches(spark):
    deal = random.Random(5)
    word = lambda: deal.choice("abcdefg")
    docs = [(n, " ".join(word() for _ in range(deal.randrange(0, 60)))) for n in range(60)]
    items = [(str(n), tuple(word() for _ in range(deal.randrange(1, 7)))) for n in range(40)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    index = decontamination.build_index(df, "doc_id", "text", slop=1, segment_bytes=300)
    for window in (3, 4):
        got = {r.key: r for r in decontamination.search(index, items, window).collect()}
        assert len(got) == len(docs)
        for doc, text in docs:
            w = text.split()
            wanted = {}
            for item, words in items:
                size = min(window, len(words))
                own = {words[i : i + size] for i in range(len(words) - size + 1)}
                hit = {p for s in range(len(w) - size + 1) if tuple(w[s : s + size]) in own for p in range(s, s + size)}
                if hit:
                    wanted[item] = hit
            found = {}
            for s in got[doc].spans:
                found.setdefault(s["item"], set()).update(range(s["start"], s["end"]))
            assert found == wanted
