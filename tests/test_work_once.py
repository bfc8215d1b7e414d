"""Work on texts is done once: by the number of rows that reach it, by plans, and against plain Python."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from pagelens.functions.arrays import add_top_items
from pagelens.operators import duplicates as dup
from pagelens.operators import entities as ents
from pagelens.operators import features as ft
from pagelens.operators import models as md
from pagelens.plans import job_queries, page_queries
from pagelens.sources import content_store

TEXTS = ["Mail to Ann Lee at a.b@c.org or https://x.org/?q=1 on 2024-01-02 for $ 5,00.", "no sign", "-", "€7", "x@", "", None]


def _counted(spark, df, column):
    """`df` with `column` passed through a function that counts its calls."""
    seen = spark.sparkContext.accumulator(0)

    def through(x):
        seen.add(1)
        return x

    return df.withColumn(column, F.udf(through, df.schema[column].dataType)(column)), seen


def _tables(spark, path):
    rows = [(i, f"Text {i} speaks of software. It is good.", "en", f"s{i % 3}", 40) for i in range(60)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0)], "doc_id bigint, quality bigint, toxic bigint").write.parquet(f"{path}/labels.parquet")
    pages = [(i, "https://a.org/x" if i % 2 else "nonsense", f"<p>{'words of a page ' * 20}</p>") for i in range(20)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path)


def test_content_store_analyses_rows_once(spark, tmp_path):
    content, seen = _counted(spark, job_queries.content(spark, _tables(spark, tmp_path / "t")), "word_count")
    content_store.write(content, str(tmp_path / "store"))
    assert seen.value == 60 and spark.read.parquet(str(tmp_path / "store")).count() == 60


def test_text_report_analyses_rows_once(spark, tmp_path, monkeypatch):
    content, seen = _counted(spark, job_queries.content(spark, folder := _tables(spark, tmp_path / "t")), "word_count")
    monkeypatch.setattr(job_queries, "content", lambda *_: content)
    assert job_queries.text_report(spark, folder).filter("section = 4").count() == 7 * 60
    assert seen.value == 60


def test_sheets_check_texts_once(spark, tmp_path, monkeypatch):
    folder = _tables(spark, tmp_path / "t")
    for name, n in (("sheet_rows", 3 + 60 + 60), ("sheet_tables", 4)):
        rows, seen = _counted(spark, job_queries.tb.job_rows(job_queries.docs(spark, folder)), "failed")
        monkeypatch.setattr(job_queries, "job_rows", lambda *_, rows=rows: rows)
        got = getattr(job_queries, name)(spark, folder).collect()
        assert len([r for r in got if r["sheet"] != "errors" or name == "sheet_tables"]) == n
        assert seen.value == 60


def test_page_success_split_reads_pages_once(spark, tmp_path):
    out = page_queries.page_success_split(spark, _tables(spark, tmp_path / "t"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    got = {r["outcome"]: (r["pages"], r["words"]) for r in out.collect()}
    assert got == {"success": (10, 800), "error": (10, None)}


def test_top_items_are_the_most_frequent(spark):
    rng = random.Random(2)
    lists = [rng.choices(["é", "z", "a b", "a", "ab", "𝄞", ""], [9, 5, 5, 2, 1, 1, 1], k=n) for n in (0, 1, 5, 40, 200)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*lists, None])], "id int, x array<string>")
    got = {r["id"]: r["top"] for r in add_top_items(df, "x", "top", 3).collect()}
    for i, x in enumerate(lists):
        count = Counter(x)
        assert got[i] == sorted(count, key=lambda w: (-count[w], w.encode()))[:3]
    assert got[len(lists)] is None


def test_signs_hide_no_entity(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id bigint, t string")
    got = [(r["id"], e["label"], e["text"]) for r in df.select("id", ents.pattern_entities(F.col("t")).alias("e")).collect() for e in r["e"] or ()]
    plain = [(label, p.replace(r"\p{Lu}", "[A-Z]").replace(r"\p{L}", "[A-Za-z]")) for label, p in ents.PATTERNS]
    assert sorted(got) == sorted((i, label, m.group()) for i, t in enumerate(TEXTS) if t for label, p in plain for m in re.finditer(p, t))
    assert {label for _, label, _ in got} == {label for label, _ in ents.PATTERNS}
    for r in ents.entity_offsets(df, "id", "t").collect():
        assert TEXTS[r["id"]][r["start"] : r["end"]] == r["text"]
    # Nothing is searched for where its sign is missing.
    held = df.select("id", *[ents._may_hold(F.col("t"), label).alias(label) for label in ents.SIGNS]).filter("id = 1").first()
    assert not any(held[label] for label in ents.SIGNS)


def test_tfidf_rows_write_words_not_pairs(spark, monkeypatch):
    kept = {}

    def spy(df, name, _written=ft.written):
        kept[name] = _written(df, name)
        return kept[name]

    monkeypatch.setattr(ft, "written", spy)
    df = spark.createDataFrame([(1, "red green blue red"), (2, "green blue"), (3, "other"), (4, None)], "id bigint, t string")
    found = ft.tfidf_rows(df, "id", "t", ["other"])
    assert {r["id"]: r["words"] for r in kept["words"].collect()} == {1: ["red", "green", "blue", "red"], 2: ["green", "blue"], 3: [], 4: None}
    assert found.words == ["blue", "blue red", "green", "green blue", "red", "red green"]
    assert {r["id"]: r["indices"] for r in found.rows.collect()} == {1: [0, 1, 2, 3, 4, 5], 2: [0, 2, 3], 3: [], 4: []}


def test_texts_travel_by_block_not_by_pair(spark, monkeypatch):
    """Repeated ids and pairs keep all their rows; a partner of a hub does not move the hub's text again."""
    texts = [(i, f"hub word{i % 5} red") for i in range(40)] + [(3, "hub blue"), (50, ""), (51, None)]
    df = spark.createDataFrame(texts, "id bigint, t string")
    pairs = [(0, i) for i in range(1, 40)] + [(0, 7), (50, 51), (50, 3), (0, 99), (None, 1), (1, None)]
    plans = []

    def spy(rows, _written=dup._written):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return _written(rows)

    own = dup.profiles(df, "id", "t")
    monkeypatch.setattr(dup, "_written", spy)
    setting = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    got = dup.pair_measures(spark.createDataFrame(pairs, "content1_id bigint, content2_id bigint"), own).collect()
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == setting
    of = {}
    for r in own.collect():
        of.setdefault(r["id"], []).append(set(r["words"]))
    assert len(of[3]) > 1
    share = lambda x, y: len(x & y) / len(x | y) if x | y else 0.0
    want = [(a, b, share(x, y)) for a, b in pairs for x in of.get(a, ()) for y in of.get(b, ())]
    assert sorted((r["content1_id"], r["content2_id"], r["jaccard_similarity"]) for r in got) == sorted(want)
    assert "ShuffledHashJoin" in plans[-1] and not re.search(r"hashpartitioning\([^)]*content2_id", plans[-1])


def test_training_keeps_no_texts_in_executors(spark, monkeypatch):
    """What training reads again are written counts; the terms of the texts are neither cached nor written."""
    kept, cached = [], []

    def spy(df, name, *more, _kept=md.kept):
        kept.append((name, df.columns))
        return _kept(df, name, *more)

    frame = type(spark.range(1))
    monkeypatch.setattr(md, "kept", spy)
    monkeypatch.setattr(frame, "persist", lambda self, *a, _p=frame.persist: (cached.append(self.columns), _p(self, *a))[1])
    rows = [(i, "alpha beta gamma" if i % 2 else "delta epsilon zeta", "odd" if i % 2 else "even") for i in range(40)] + [(99, "", "odd")]
    df = spark.createDataFrame(rows, "id bigint, text string, y string")
    ready = md.prepared(df, "text", ["the"])
    assert "text" not in ready.columns
    of = lambda d: {r["id"]: (r["terms"], r["error"]) for r in d.collect()}
    assert of(ready) == of(md.with_terms(df, "text", ["the"]))
    for layers in (None, (3,)):
        model = md.train_classifier(ready, "y", layers=layers, epochs=3)
        assert [type(s).__name__ for s in model.stages[:4]] == ["StringIndexerModel", "CountVectorizerModel", "IDFModel", "Normalizer"]
        assert md.predict(model, ready, ["id"]).count() == 41
    assert not any("terms" in c for c in cached) and not any("terms" in c for _, c in kept)
    assert {n for n, _ in kept} == {"words", "counts", "network-vectors"}


def test_scratch_holds_only_what_is_in_use(spark, monkeypatch):
    """Tables between the steps of clustering go once they are read, and word sets are written once."""
    rows = [(i, " ".join(f"w{i // 4}x{k}" for k in range(20) if k != i % 4)) for i in range(40)] + [(90, ""), (91, None)]
    kept = []

    def spy(df, _written=dup._written):
        kept.append(_written(df))
        return kept[-1]

    monkeypatch.setattr(dup, "_written", spy)
    got = dict(map(tuple, dup.clusters(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text").collect()))
    assert got == {i: i - i % 4 for i in range(40)} | {90: 90} | ({91: 91} if 91 in got else {})
    there = []
    for df in kept:
        path = spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]) if df.inputFiles() else None
        there.append(path is not None and path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path))
    left = [df.columns for df, here in zip(kept, there) if here]
    assert not any({"words", "token", "marks"} & set(c) for c in left) and len(left) < len(kept) / 2
    assert sum("words" in df.columns for df in kept) <= 3  # all representatives, and those in doubt of each round


def test_pairs_of_rare_words_need_no_count(spark):
    """The listed terms are those of counting every term, with ties, however few are asked for."""
    rng = random.Random(2)
    words = [f"w{k}" for k in range(60)]
    texts = [(i, [rng.choice(words[: rng.randrange(1, 60)]) for _ in range(30)]) for i in range(80)]
    df = md.terms_of_words(spark.createDataFrame(texts, "id bigint, __words array<string>")).persist()
    for n, spare in ((5, 2), (30, 5), (200, 20), (5000, 1000)):
        for share in (0.95, 0.3):
            assert ft.frequent_terms(df, n, share, spare, paired=True) == ft.frequent_terms(df, n, share, spare)
