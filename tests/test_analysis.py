"""All steps of the analysis over hand-made rows, each with its own failure; titles; topic mixtures."""

import pytest
from pyspark.sql import functions as F

from pagelens.operators import lexicon as lx
from pagelens.operators.models import topic_model
from pagelens.plans.enrichment import STEPS, analyse

LONG = "The quick river runs to a small town. " * 2 + "People of the town love games and music on 2024-05-01. They write to me@site.org about it."


@pytest.fixture(scope="module")
def found(spark):
    rows = [(1, LONG, "Machine software"), (2, "tiny", "t"), (3, None, None), (4, "ten letters and zebra", None), (5, "zzzz yyyy xxxx wwww", "game")]
    df = spark.createDataFrame(rows, "id bigint, text string, title string")
    out = analyse(
        df, "id", "text", stop_words=["the", "a"], title="title", emotions=(("love", "joy"), ("zebra", "fear")),
        categories={"technology": ["software", "river"], "sports": ["games", "game", "town"]}, gazetteer=(("town", "PLACE"),),
    )
    return {r["id"]: r for r in out.collect()}


def test_ten_steps(found):
    r = found[1]
    assert len(STEPS) == 10 and all(r[s] is not None for s in STEPS) and r["failures"] == {}
    assert r["emotions"]["dominant"] == "joy" and {(e["label"], e["text"]) for e in r["entities"]} >= {("PLACE", "town"), ("DATE", "2024-05-01"), ("EMAIL", "me@site.org")}
    assert r["summary"]["summary"] and sum(r["topics"]) == pytest.approx(1)


def test_each_step_fails_for_itself(found):
    assert set(found[4]["failures"]) == {"summary"} and found[4]["emotions"]["dominant"] == "fear"
    assert set(found[5]["failures"]) == {"summary", "emotions"} and found[5]["emotions"] is None and found[5]["statistics"] is not None
    for i in (2, 3):
        assert found[i]["error"] == "Text too short for analysis" and found[i]["failures"] == {}
        assert all(found[i][s] is None for s in STEPS)


def test_title_counts_for_the_category_only(spark, found):
    assert found[1]["category"]["technology"] == pytest.approx(3 / 7) and found[5]["category"]["predicted_category"] == "sports"
    df = spark.createDataFrame([(1, "river river town", "town town"), (2, "river", None)], "id bigint, text string, title string")
    lists = {"water": ["river"], "place": ["town"]}
    by = {r["id"]: r["predicted_category"] for r in lx.token_categories(df, "id", "text", lists, "title").collect()}
    assert by == {1: "place", 2: "water"}
    assert {r["id"]: r["predicted_category"] for r in lx.token_categories(df, "id", "text", lists).collect()} == {1: "water", 2: "water"}


def test_topic_mixtures_belong_to_their_documents(spark):
    sea, hill = "wave ship sail harbour tide", "slope peak ridge valley summit"
    rows = [(i, " ".join([(sea, hill)[i % 2]] * 4)) for i in range(40)] + [(98, "unrelated words alone here"), (99, "")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    out = topic_model(df, "id", "text", [], k=2, vocab_size=18)
    got = {r["id"]: r["topics"] for r in out.mixtures.collect()}
    assert len(got) == 42 and got[99] is None and all(sum(t) == pytest.approx(1) for t in got.values() if t)
    top = {i: t.index(max(t)) for i, t in got.items() if i < 90}
    assert len({top[i] for i in range(0, 40, 2)}) == 1 and len({top[i] for i in range(1, 40, 2)}) == 1 and top[0] != top[1]
    assert out.words.filter(F.col("rank") == 1).count() == 2
