"""Prose of unlisted languages stays; licences in their real forms are found; leftovers merge in bounded groups; letterless texts."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagelens.llm import language_id, license_forms, licenses, packing, quality_rules, tool_calls

PROSE = {
    "ru": "Старый дом стоял у реки, где вечером собирались рыбаки, чтобы рассказать друг другу длинные истории про море, ветер, далёкие"
    " острова, пропавшие корабли, тёплый хлеб, детей, которые ждали своих отцов каждую осень.",
    "it": "Ogni mattina nonno Pietro usciva presto, prendeva cestino, coltello, pane, formaggio; saliva verso boschi umidi cercando funghi porcini,"
    " poi tornava stanco, felice, raccontando storie vecchie mentre fuori pioveva sempre più forte.",
    "fi": "Vanha mies asui metsän reunassa, kalasti järvellä joka aamu, keitti kahvia, luki kirjoja, korjasi verkkoja sekä odotti kärsivällisesti"
    " talvea. Lumi peitti lopulta pihan, polut, katot, laiturin, veneen sekä hiljaisen kylän.",
    "th": " ".join(["บ้านเก่าตั้งอยู่ริมแม่น้ำ", "ชาวประมงมาพบกัน", "เล่าเรื่องยาวให้กันฟัง"] + [f"ทะเลลม{c}" for c in "กขคงจฉชซฌญฎฏฐฑฒณดตถทธนบปผฝพ"]),
}


def test_prose_of_unlisted_languages_is_kept(spark):
    numbers = " ".join(f"{i}-{i * 7}/{i % 3}" for i in range(60))
    bare = " ".join(f"{a}{b}" for a in "bcdfg" for b in ("ole", "une", "ita", "arn", "eps", "olt", "ack", "imp"))
    df = spark.createDataFrame([*PROSE.items(), ("numbers", numbers), ("bare", bare)], "k string, text string")
    got = {r["row"]["k"]: (r.base_failed, r.failed) for r in quality_rules.judged(df, "text").collect()}
    assert all(got[k] == (False, []) for k in PROSE), got
    assert got["numbers"] == (False, ["no_stop_words"]) and got["bare"] == (False, ["no_stop_words"])


def commented(text, mark="# ", width=60):
    """A form as it stands in a file: wrapped, each line after a comment mark."""
    lines, line = [], ""
    for word in text.split():
        if len(line) + len(word) > width:
            lines.append(line)
            line = ""
        line += word + " "
    return "\n".join(mark + x.rstrip() for x in [*lines, line])


def test_licences_in_their_real_forms(spark):
    rows, want = [], {}
    for i, (name, text) in enumerate(license_forms.FORMS):
        rows += [(f"/h{i}/main.py", f"#!/usr/bin/env python\n# Copyright 2020 A. Person\n#\n{commented(text)}\n\nimport os\n" + "x = os.path\n" * 300)]
        rows += [(f"/f{i}/LICENSE", f"Copyright (c) 2021 Some Body\n\n{commented(text, '   ', 75)}\n\n" + "Further terms follow here in many words.\n" * 50)]
        rows += [(f"/f{i}/sub/deep/a.txt", "plain text")]
        want |= {f"/h{i}/main.py": (name, "own"), f"/f{i}/LICENSE": (name, "own"), f"/f{i}/sub/deep/a.txt": (name, "inherited")}
    rows += [("/s/a.c", "// SPDX-License-Identifier: GPL-2.0-only\nint x;"), ("/s/b.c", "/* SPDX-License-Identifier: MIT */"), ("/s/c.c", "// SPDX-License-Identifier: Zlib")]
    rows += [("/s/d.txt", "Permission to enter the house is hereby granted to all guests of the hotel who hold a licence for their dog."), ("/s/e.txt", None)]
    want |= {"/s/a.c": ("GPL-2.0", "own"), "/s/b.c": ("MIT", "own"), "/s/c.c": (None, "none"), "/s/d.txt": (None, "none"), "/s/e.txt": (None, "none")}
    df = spark.createDataFrame(rows, "path string, text string")
    got = {r["row"]["path"]: (r.license, r.how) for r in licenses.scan(df, "path", "text").collect()}
    assert got == want


def test_form_scores_equal_a_plain_computation(spark):
    forms = licenses.Forms()
    text = "x y z " + license_forms.FORMS[0][1].replace("restriction", "limit of any kind") + " the end"
    terms = re.findall(licenses.TERM, text.lower())
    best = 0.0
    for opening, n in forms.starts:
        k = opening.split()
        for i in range(len(terms)):
            if terms[i : i + len(k)] == k:
                c = Counter(terms[i : i + n])
                norm = math.sqrt(sum((x * forms.index.idf[t]) ** 2 if t in forms.index.idf else x * forms.index.other**2 for t, x in c.items()))
                best = max(best, *(sum(w.get(t, 0) * x * forms.index.idf.get(t, 0) for t, x in c.items()) / norm for w in forms.index.weights))
    got = licenses.scan(spark.createDataFrame([("/a", text)], "path string, text string"), "path", "text").first()
    assert got.license == "MIT" and got.score == pytest.approx(best, abs=1e-9) and 0.7 < best < 1


def test_forms_need_a_hint():
    with pytest.raises(ValueError):
        licenses.Forms((("X", "do as you like with it"),))


def test_leftovers_merge_over_several_rounds(spark):
    n_parts, each = 27, 5
    rows = [((p << 32) | i, (p * 7 + i * 13) % 60 + 1) for p in range(n_parts) for i in range(each)]
    rest = spark.createDataFrame(rows, "window bigint, length bigint")
    moved = packing._merged_leftovers(rest, 64, 3).collect()
    assert len(moved) == len(rows) and {r.window for r in moved} == {w for w, _ in rows}
    length, spans = dict(rows), {}
    for r in moved:
        spans.setdefault(r.into, []).append((r.shift, r.shift + length[r.window]))
    halves = 0
    for own in spans.values():
        own.sort()
        assert own[0][0] == 0 and all(a[1] == b[0] for a, b in zip(own, own[1:])) and own[-1][1] <= 64
        halves += own[-1][1] <= 32
    # At most one window is left that two could have shared.
    assert halves <= 1


def test_plain_messages_of_one_conversation_do_not_meet(spark):
    n = 500
    call = tool_calls.CALL
    df = spark.range(n).select(
        F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("hello").alias("text"),
        F.lit(None).cast(call).alias("calls"), F.when(F.col("id") == 7, "a").alias("result_of"),
    )
    got = tool_calls.link(df, {})
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "isnotnull(id" in plan
    rows = {r.turn: r.status for r in got.collect()}
    assert len(rows) == n and rows[7] == "orphan" and all(s == "message" for t, s in rows.items() if t != 7)


def test_a_host_does_not_speak_for_letterless_texts(spark):
    words = "the river runs slowly past old houses and green fields"
    rows = [(i, words + f" {'abcdefgh'[i % 8]}", "en", "a.example") for i in range(20)] + [(99, "12 34 !!", None, "a.example"), (98, None, None, "a.example"), (97, "55", "en", "a.example")]
    df = spark.createDataFrame(rows, "id bigint, text string, lang string, host string")
    got = {r["row"]["id"]: (r.accepted, r.language) for r in language_id.identify(df, "text", "lang", None, "host").collect()}
    assert got[0] == (True, "en") and got[97] == (True, "en") and not got[99][0] and not got[98][0]
