"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names, for each operator."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagelens.llm import (
    catalog,
    class_model,
    decontamination,
    language_id,
    licenses,
    near_duplicates,
    packing,
    quality_rules,
    token_codes,
    tokens,
    tool_calls,
    toxicity,
    words,
)

LONG = " ".join(f"word{i % 997}x" for i in range(60_000))
ROWS = [
    (None, None), (None, "one two three four"), (1, None), (2, ""), (3, " \t\n "), (4, "Alpha beta. gamma  delta\n\nline"),
    (4, "Alpha beta. gamma  delta\n\nline"), (5, "a b   ć <|endoftext|> 's x'll"), (6, LONG), (7, "x"),
]
SCHEMA = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def odd(spark):
    """Rows of each case, with columns named like those the operators add."""
    extra = {c: F.lit(9) for c in ("fingerprint", "component_id", "score", "row", "key", "segment", "nth", "n_words", "words", "part", "best")}
    return spark.createDataFrame(ROWS, SCHEMA).withColumns(extra)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_and_numbers_round_trip():
    texts = pa.array(["Ab c", None, "", "  DÉ \n x ", "y"])
    found = words.split_words(texts, words.LOWERED)
    assert found.strings().to_pylist() == ["ab", "c", "dÉ", "x", "y"] and found.docs.tolist() == [0, 2, 2, 2, 4, 5]
    values = np.array([0, 1, 127, 128, 300, 1 << 20, (1 << 33) + 5])
    assert words.from_varint(words.to_varint(values)).tolist() == values.tolist()


@pytest.mark.parametrize("name, pieces", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "blank")])
def test_pieces_give_the_ids_of_whole_texts(name, pieces):
    from tokenizers import Tokenizer

    texts = [t or "" for _, t in ROWS] + [" lead", "trail ", "a.\nB", "a \nb", "x).y ).", "don't 'S", "é́ ́", "12 3.5%", "tab\tx"]
    path = catalog.tokenizer(name)
    ids, offsets = tokens.Encoder(tokens.read_model(path), pieces).encode(pa.array(texts))
    tool = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == tool.encode(t, add_special_tokens=False).ids, t[:40]


def test_quality_rules(spark, odd, empty):
    got = [(r["row"]["doc_id"], r.n_words, r.base_failed, r.kept) for r in quality_rules.judged(odd, "text").collect()]
    assert (1, 0, True, False) in got and (2, 0, True, False) in got and len(got) == len(ROWS)
    assert (6, 60_000, True, False) in got  # its words come round again
    assert quality_rules.judged(empty, "text").count() == 0
    with pytest.raises(ValueError):
        quality_rules.failed([quality_rules.Rule("x", "nothing", least=1)])


def test_quality_rules_reject_table_junk(spark):
    plain = "the house of a friend stands near that old river and nobody has ever painted its wooden door in another colour"
    bare = [f"{a}{b}" for a in "bcdfg" for b in ("ole", "une", "ita", "arn", "eps", "olt", "ack", "imp")]
    texts = [plain, plain.replace(" the", " | the") + " | cell | row | 17 | cell | x | 18 |", " ".join(bare[:10]), " ".join(bare), "$5 " + plain]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = {r["row"]["doc_id"]: (r.kept, r.failed) for r in quality_rules.judged(df, "text").collect()}
    assert got == {0: (True, []), 1: (False, ["symbols"]), 2: (True, []), 3: (False, ["no_stop_words"]), 4: (True, [])}


def test_quality_rules_separate_labelled_rows(spark):
    folder = "/root/testdata/sf0.01"
    judged = quality_rules.judged(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    quality = {r.doc_id: r.quality for r in labels.collect()}
    rows = [r for r in judged.select("row.doc_id", "base_failed", "kept").collect() if not r.base_failed]
    bad = [r for r in rows if quality.get(r.doc_id) == 0]
    assert bad and all(r.kept for r in rows if quality.get(r.doc_id) == 1)
    assert sum(r.kept for r in bad) <= 0.1 * len(bad)


def test_decontamination(spark, odd, empty):
    items = spark.createDataFrame([(1, "alpha BETA gamma"), (1, "alpha beta gamma"), (2, None), (3, ""), (None, "x"), (4, "x")], "item_id bigint, text string")
    found = decontamination.contamination(odd, "doc_id", "text", items, "item_id", "text", slop=1)
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items) for r in decontamination.marked(found).collect()]
    assert len(got) == len(ROWS) and got.count((4, 5, 3, 1)) == 2 and (7, 1, 1, 1) in got and (1, 0, 0, 0) in got
    blocks = decontamination.contamination(odd, "doc_id", "text", items, "item_id", "text", block_bytes=8, segment_bytes=8)
    again = [(r.doc_id, r.n_words, r.n_hit, r.n_items) for r in decontamination.marked(blocks).collect()]
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert decontamination.contamination(empty, "doc_id", "text", items, "item_id", "text").count() == 0
    none = decontamination.contamination(odd, "doc_id", "text", items.limit(0), "item_id", "text")
    assert decontamination.marked(none).filter("contaminated").count() == 0


def test_proximity(spark):
    df = spark.createDataFrame([(1, "a b x c d"), (2, "a b c d")], SCHEMA)
    items = spark.createDataFrame([(1, "a b c d")], "item_id bigint, text string")
    got = {r.doc_id: r for r in decontamination.contamination(df, "doc_id", "text", items, "item_id", "text", slop=1).collect()}
    assert (len(got[1].spans), len(got[1].near), len(got[2].spans), len(got[2].near)) == (0, 1, 1, 0)


def test_near_duplicates(spark, odd, empty):
    got = near_duplicates.near_duplicates(odd, "doc_id", "text").collect()
    assert len(got) == len(ROWS)
    zero = {(r.doc_id, r.component_id) for r in got if r.fingerprint == "0" * 16}
    assert {(1, 1), (2, 1), (3, 1), (None, 1)} <= zero
    assert near_duplicates.deduplicate(odd, "doc_id", "text").columns == odd.columns
    assert near_duplicates.deduplicate(odd, "doc_id", "text").filter("doc_id = 4").count() == 1
    assert near_duplicates.near_duplicates(empty, "doc_id", "text").count() == 0


def test_dense_buckets_lose_no_link(spark):
    import random

    deal = random.Random(3)
    base = [deal.getrandbits(64) for _ in range(4)]
    prints = {b for b in base} | {b ^ (1 << i) ^ (1 << j) for b in base for i in range(0, 64, 9) for j in range(64)}
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)]
    df = spark.createDataFrame([(n, p) for n, p in enumerate(signed)], "id bigint, fingerprint bigint")
    wanted = [near_duplicates.label_fingerprints(df, "id", bucket=b).select("fingerprint", "component_id").collect() for b in (2, 10_000)]
    assert sorted(wanted[0]) == sorted(wanted[1])


def test_toxicity(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (7, 0), (6, None), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(odd, "doc_id", "text", labels, "doc_id", "toxic")
    scored = toxicity.with_scores(odd, "text", model)
    assert scored.count() == len(ROWS) and scored.filter("score is null or score < 0 or score > 1").count() == 0
    unlabelled = toxicity.train(odd, "doc_id", "text", labels.limit(0), "doc_id", "toxic")
    assert toxicity.with_scores(odd, "text", unlabelled).filter("score > 0").count() == 0
    assert toxicity.with_scores(empty, "text", model).count() == 0


def test_tool_calls(spark):
    call = "struct<id:string,name:string,arguments:string,after:array<string>>"
    rows = [
        (1, 0, "tool", "early", None, "a"),  # before its call
        (1, 1, "assistant", None, [("a", "t", '{"n": 1, "m": [2.0]}', None)], None),
        (1, 2, "assistant", None, [("b", "t", '{"n": 0, "z": 1, "n": 2}', ["a"]), ("c", "none", "{}", ["zz"])], None),
        (1, 3, "assistant", None, [("a", "t", None, None), ("p", "t", "{}", ["q"]), ("q", "t", '{"n": "x"}', ["p"])], None),
        (1, 4, "tool", "lost", None, "gone"), (1, 5, "user", None, None, None), (None, None, None, None, None, None),
        (2, 0, "tool", "x", None, "a"),
    ]
    df = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, text string, calls array<{call}>, result_of string")
    schemas = {"t": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer", "minimum": 1}}}}
    got = tool_calls.link(df, schemas).collect()
    by = {(r.conv_id, r.turn, r.part): r for r in got}
    early, made = by[1, 0, 0], by[1, 1, 0]
    assert early.status == "linked" and (early.order_turn, early.order_step) == (1, 1) and made.status == "linked"
    assert made.json == '{"after":[],"arguments":{"m":[2.0],"n":1},"id":"a","name":"t","role":"assistant","type":"call"}'
    assert not by[1, 2, 0].valid and by[1, 2, 1].errors == "unknown tool" and by[1, 3, 0].status == "repeated"
    assert by[1, 4, 0].status == "orphan" and by[2, 0, 0].status == "orphan" and by[None, None, 0].kind == "message"
    assert by[1, 3, 1].cyclic and len(got) == 11
    assert tool_calls.link(df.limit(0), schemas).count() == 0


def test_language_id(spark, odd, empty):
    lang = F.when(F.col("doc_id") == 6, "en").when(F.col("doc_id") == 4, "fr")
    found = language_id.identify(odd.withColumn("lang", lang), "text", "lang", None, None).collect()
    assert len(found) == len(ROWS) and all(0 <= r.probability <= 1 for r in found)
    silent = [r for r in found if r["row"]["doc_id"] == 1]
    assert not silent[0].accepted
    none = F.lit(None).cast("string")
    assert not language_id.identify(odd.withColumn("lang", none), "text", "lang").filter("accepted").count()
    assert language_id.identify(empty.withColumn("lang", none), "text", "lang").count() == 0


def test_licenses(spark):
    rows = [
        ("/a/LICENSE", "Licensed under the Apache License,\nVersion 2.0."), ("/a/b/c/x.txt", "plain"), ("/a/b/LICENSE.md", "Released under the MIT License."),
        ("/a/y.txt", ""), ("/z/n.txt", None), (None, "Licensed under CC BY-NC 4.0."), ("top", "x"), ("/a/y.txt", ""),
        ("/a/q.txt", "mit " + LONG + " released under license"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "path string, text string, license int")
    got = [(r["row"]["path"], r.license, r.how, r.inherited_from) for r in licenses.scan(df, "path", "text").collect()]
    assert len(got) == len(rows) and got.count(("/a/y.txt", "Apache-2.0", "inherited", "/a")) == 2
    assert ("/a/b/c/x.txt", "MIT", "inherited", "/a/b") in got and (None, "CC-BY-NC-4.0", "own", None) in got
    assert ("/z/n.txt", None, "none", None) in got and ("top", None, "none", None) in got and ("/a/q.txt", "Apache-2.0", "inherited", "/a") in got
    assert licenses.scan(df.limit(0), "path", "text").count() == 0


def test_token_files(spark, odd, empty):
    model = tokens.read_model(catalog.tokenizer("word_bpe_49k.json"))
    files = token_codes.write_files(odd, "doc_id", "text", model, "word", 1, file_tokens=100)
    rows = token_codes.read_files(files, "doc_id").orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, 1, 2, 3, 4, 4, 5, 6, 7]
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    longest = files.orderBy(F.desc("n_tokens")).first()
    whole = np.frombuffer(max(rows, key=lambda r: r.n_tokens)["ids"], dtype="<u4")
    file = token_codes.TokenFile(longest["path"])
    at = int(file.offsets()[file.keys().index(6)])
    for a, b in ((0, 1), (511, 514), (5000, 5000), (1023, 9000), (len(whole) - 1, len(whole))):
        assert file.tokens(at + a, at + b).tolist() == whole[a:b].tolist()
    assert token_codes.read_files(token_codes.write_files(empty, "doc_id", "text", model, "word", 1), "doc_id").count() == 0


def test_levels_hold_large_ids():
    ids = np.array([0, 255, 256, 65_535, 65_536, (1 << 32) - 1] * 200, dtype=np.uint32)
    assert [len(c) for c, _, _ in token_codes.encode_levels(ids)] == [1200, 800, 400, 200]


def test_packing(spark, odd, empty):
    model = tokens.read_model(catalog.tokenizer("byte_bpe_50k.json"))
    rows = packing.pack(odd.repartition(5), "doc_id", "text", model, "blank", 1, length=64, open_windows=2, merge_group=2).collect()
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert filled.get(r.sequence_id, 0) == r.offset and len(r.ids) == 4 * r.length
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 64 and sum(r.length for r in rows if r.start == 0 and r.doc_id in (2, 3)) >= 2
    assert packing.pack(empty, "doc_id", "text", model, "blank", 1).count() == 0


def test_class_model(spark, odd, empty):
    held = F.col("doc_id") == 4
    got = class_model.score_texts(odd, "doc_id", "text", held, units=10, endings=4, classes=4).collect()
    assert len(got) == len(ROWS) and all(np.isfinite([r.score, r.base_score]).all() for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1} and sum(r.held_out for r in got) == 2
    untrained = class_model.score_texts(odd, "doc_id", "text", F.lit(True), units=10, endings=4, classes=4).collect()
    assert all(np.isfinite(r.score) and r.train_tokens == 0 for r in untrained)
    assert class_model.score_texts(empty, "doc_id", "text", held).count() == 0


def test_exchange_ends_where_no_single_move_helps():
    n, classes = 12, 4
    deal = np.random.default_rng(5)
    table = deal.integers(0, 40, (n, n)) * (deal.random((n, n)) < 0.6)
    at = np.flatnonzero(table)
    left = table.sum(axis=0).astype(float)

    def likelihood(label):
        m = np.zeros((classes, classes))
        np.add.at(m, (np.repeat(label, n), np.tile(label, n)), table.ravel())
        return sum((x[x > 0] * np.log(x[x > 0])).sum() * k for x, k in ((m, 1), (m.sum(0), -1), (m.sum(1), -1)))

    label = class_model.exchange(np.stack([at, table.ravel()[at]], axis=1), left, classes, 50)
    best = likelihood(label)
    assert label[0] == 0 and not (label[1:] == 0).any()
    for u in range(1, n):
        for c in range(1, classes):
            other = label.copy()
            other[u] = c
            assert likelihood(other) <= best + 1e-6


def test_new_known_and_older_pieces_give_the_ids_of_whole_texts():
    import public_tokenizers
    import pyarrow as pa

    from pagelens.llm.tokens import Encoder, read_model

    texts = [
        "", "a", "a.b", " a. b", "x.,y", "It's a.m. don't.'s", "5%.$3", "a\nb c.\n", "é.x €.y ²,z", "a.\nb", " ", ". a", "a b ",
        "U.S.A., e.g.: ok!?", "a|b c*d #e f#g", "日本。a.", "\ta. b\x0bc.", "a b. c d", "a  b", None, "a,́b", "x.‍ y",
    ]
    for name, pieces in (("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "blank")):
        tool = Encoder(read_model(public_tokenizers.path(name)), pieces)
        for _ in range(3):  # new, known and older pieces
            ids, offsets = tool.encode(pa.array(texts))
            for t, a, b in zip(texts, offsets[:-1], offsets[1:]):
                assert ids[a:b].tolist() == tool.tokenizer.encode(t or "", add_special_tokens=False).ids, t
            tool.known, tool.older = {}, tool.known


@pytest.mark.parametrize("name, pieces", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "blank")])
def test_added_tokens_in_texts_give_the_ids_of_whole_texts(name, pieces):
    texts = [
        "ab <|endoftext|> cd", "ab<|endoftext|>cd.", "<|endoftext|>", "x <|startoftext|> y", "<|startoftext|><|endoftext|>", None,
        "ab <|ENDOFTEXT|> cd", "a <|endoftext |> b", "plain a|b.", "<|endoftext|>\n\n<|endoftext|> z",
    ]
    tool = tokens.Encoder(tokens.read_model(catalog.tokenizer(name)), pieces)
    ids, offsets = tool.encode(pa.array(texts))
    for t, a, b in zip(texts, offsets[:-1], offsets[1:]):
        assert ids[a:b].tolist() == tool.tokenizer.encode(t or "", add_special_tokens=False).ids, t
    assert tool.tokenizer.token_to_id("<|endoftext|>") in ids[offsets[0] : offsets[1]]
