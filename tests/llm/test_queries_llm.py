"""The registered queries against SQL or a brute-force version, over a small folder of whole tables."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from oracle import compare, connect

from pagelens.llm.catalog import ENTRIES, tokenizer

QUERIES = {e.name: e for e in ENTRIES}
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(small):
    return duckdb.sql(f"select doc_id, text from '{small}/documents.parquet' order by doc_id").fetchall()


def test_op1_equals_sql(spark, small):
    assert compare(QUERIES["op1_quality_rules"], spark, connect(small), small) is None


def test_op2_equals_brute_force(spark, small, docs):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for item, text in duckdb.sql(f"select item_id, text from '{small}/benchmark.parquet'").fetchall():
        w = word.findall((text or "").translate(LOWER))
        size = min(13, len(w))
        for s in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + size]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    got = {r.doc_id: r for r in QUERIES["op2_decontamination"].run(spark, small).collect()}
    assert any(r.contaminated for r in got.values())
    for doc, text in docs:
        w = word.findall((text or "").translate(LOWER))
        hit, items = set(), set()
        for size in sizes:
            for s in range(len(w) - size + 1):
                if tuple(w[s : s + size]) in windows:
                    hit.update(range(s, s + size))
                    items |= windows[tuple(w[s : s + size])]
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        wanted = (len(w), len(hit), len(items), digest, bool(hit) and 20 * len(hit) >= len(w))
        r = got[doc]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == wanted


def simhash(text):
    w = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(prints):
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_op3_equals_brute_force(spark, small, docs):
    prints = {i: simhash(t) for i, t in docs}
    wanted = components_of(prints)
    got = QUERIES["op3_near_duplicates"].run(spark, small).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{p:016x}", wanted[i]) for i, p in prints.items()}
    assert len(got) == len(docs)


def test_op4_separates_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    scored = QUERIES["op4_toxicity"].run(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = scored.filter("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    clean = [r for r in rows if r.toxic == 0]
    toxic = [r for r in rows if r.toxic == 1]
    assert sum(r.predicted for r in clean) <= 0.03 * len(clean)
    assert sum(r.predicted for r in toxic) >= 0.5 * len(toxic)
    assert all(0 <= r.score <= 1 for r in rows)


def test_op5_covers_every_turn(spark, small):
    rows = QUERIES["op5_tool_calls"].run(spark, small).collect()
    assert len(rows) == spark.read.parquet(f"{small}/conversations.parquet").count()
    place = {(r.conv_id, r.id): (r.order_turn, r.order_part, r.order_step, r.turn) for r in rows if r.kind == "call"}
    results = [r for r in rows if r.status == "linked" and r.kind == "result"]
    assert results and all(place[r.conv_id, r.id] < (r.order_turn, r.order_part, r.order_step, r.turn) for r in results)


def test_op6_finds_the_declared_language(spark, small):
    rows = QUERIES["op6_language_id"].run(spark, small).collect()
    assert len(rows) == spark.read.parquet(f"{small}/pages.parquet").count()
    assert sum(r.language == r.declared and r.accepted for r in rows) >= 0.95 * len(rows)


def test_op7_finds_the_planted_lines(spark, small, docs):
    lines = {
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "Released under the MIT License.": "MIT",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    }
    got = {r.doc_id: r for r in QUERIES["op7_licenses"].run(spark, small).collect()}
    assert len(got) == len(docs)
    for doc, text in docs:
        own = [lines[x] for x in (text or "").split("\n") if x in lines]
        assert (got[doc].how == "own") == bool(own)
        assert not own or got[doc].license in own


def encoded(name, docs):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(tokenizer(name))
    return {i: np.array(tool.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4") for i, t in docs}


def test_op8_reads_back_every_token(spark, small, docs):
    wanted, at = [], 0
    for doc, ids in encoded("word_bpe_49k.json", docs).items():
        wanted.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in QUERIES["op8_token_codes"].run(spark, small).collect()) == wanted


def gapless(pieces):
    at = 0
    for start, length in sorted(pieces):
        assert start == at
        at += length
    return at


def test_op9_places_every_token_once(spark, small, docs):
    ids = encoded("byte_bpe_50k.json", docs)
    own, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in QUERIES["op9_packing"].run(spark, small).collect():
        whole = ids[r.doc_id]
        assert zlib.crc32(whole[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(whole)
        own[r.doc_id].append((r.start, r.length))
        windows[r.sequence_id].append((r.offset, r.length))
    assert {i: gapless(p) for i, p in own.items()} == {i: len(x) for i, x in ids.items()}
    filled = [gapless(p) for p in windows.values()]
    assert max(filled) <= 2048 and sum(2048 - n for n in filled) <= 0.05 * sum(filled)


def test_op10_base_is_exact_and_the_model_is_better(spark, small, docs):
    tokens = {i: WORD.findall((t or "").translate(LOWER)) + [""] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = collections.Counter(w for i, words in tokens.items() if not held[i] for w in words)
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in QUERIES["op10_class_model"].run(spark, small).collect()}
    for i, words in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(words), sum(w in counts for w in words), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
    assert sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out)


def test_pipeline_stages_hand_on_documents(spark, small, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    first = {tuple(r) for r in docs.collect()}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = docs.count()
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows = docs.collect()
        assert {tuple(r) for r in rows} <= first and 0.5 * before < len(rows) <= before, name
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
