"""Registered queries of this subpackage, as their contract gives them."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelens.llm import centroids, class_model, decontamination, language_id, licenses, near_duplicates, packing, periodic_runs, quality_rules, rule_ensemble, token_codes, tool_calls, toxicity
from pagelens.llm.tokens import read_model
from pagelens.plans.entry import Registry
from pagelens.session import scratch_path
from pagelens.sources.tables import table

ENTRIES = Registry()
#: The id that ends each text.
END = 1


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file lies on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


@ENTRIES.add("op2_decontamination", "llm")
def op2_decontamination(spark, folder):
    found = decontamination.contamination(
        table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "benchmark"), "item_id", "text", slop=1
    )
    return decontamination.marked(found).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", F.size("near").cast("bigint").alias("n_near")
    )


@ENTRIES.add("op3_near_duplicates", "llm")
def op3_near_duplicates(spark, folder):
    return near_duplicates.near_duplicates(table(spark, folder, "documents"), "doc_id", "text")


@ENTRIES.add("op8_token_codes", "llm")
def op8_token_codes(spark, folder):
    files = token_codes.write_files(
        table(spark, folder, "documents"), "doc_id", "text", read_model(tokenizer("word_bpe_49k.json")), "word", END
    )
    return token_codes.read_files(files, "doc_id").select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@ENTRIES.add("op9_packing", "llm")
def op9_packing(spark, folder):
    return packed(table(spark, folder, "documents"))


def packed(docs):
    pieces = packing.pack(docs, "doc_id", "text", read_model(tokenizer("byte_bpe_50k.json")), "blank", END)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@ENTRIES.add("op10_class_model", "llm")
def op10_class_model(spark, folder):
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return class_model.score_texts(table(spark, folder, "documents"), "doc_id", "text", held_out)


@ENTRIES.add("op1_quality_rules", "llm", quality_rules.SQL)
def op1_quality_rules(spark, folder):
    out = quality_rules.judged(table(spark, folder, "documents").select("doc_id", "text"), "text")
    return out.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("failed", ",").alias("failed_rules"),
    )


def remainder(key, by):
    return F.crc32(F.col(key).cast("string")) % by


def toxicity_model(docs, labels):
    """Labels of held-out documents are never read."""
    return toxicity.train(docs, "doc_id", "text", labels.filter(remainder("doc_id", 3) != 1), "doc_id", "toxic")


TOXIC_FROM = 0.7


@ENTRIES.add("op4_toxicity", "llm")
def op4_toxicity(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = toxicity.with_scores(docs, "text", toxicity_model(docs, table(spark, folder, "labels")))
    return scored.select(
        "row.doc_id", F.coalesce(remainder("row.doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
    )


@ENTRIES.add("op6_language_id", "llm")
def op6_language_id(spark, folder):
    html = F.col("html")
    body = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>", " ")
    pages = table(spark, folder, "pages").select(
        "page_id", body.alias("body"), language_id.markup_language(html).alias("declared"),
        language_id.address_language(F.col("url")).alias("address"), language_id.address_host(F.col("url")).alias("host"),
    )
    found = language_id.identify(pages, "body", "declared", "address", "host")
    return found.select(
        "row.page_id", "row.host", "row.declared", "language", F.round("probability", 6).alias("probability"), "text_language", "accepted"
    )


#: Tools of the calls that `op5` reads into transcripts.
TOOLS = {
    "look_up": {
        "type": "object", "required": ["query"], "additionalProperties": False,
        "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1, "maximum": 60}},
    },
    "summarise": {
        "type": "object", "required": ["words", "style"],
        "properties": {"words": {"type": "integer", "minimum": 1}, "style": {"enum": ["short", "long"]}},
    },
}


def transcripts(conversations):
    """Assistant turns read as tool calls that need the call before, user turns after them as results.

    The given table has plain text only; names and arguments are made from each turn's own text.
    """
    text, turn = F.coalesce(F.col("text"), F.lit("")), F.col("turn")
    words = F.size(F.split(text, r"\s+"))
    call_id = lambda t: F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), t.cast("string"))
    style = F.when(F.length(text) < 200, "short").when(F.length(text) < 2000, "long").otherwise("whole")
    arguments = F.when(F.length(text) % 2 == 0, F.to_json(F.struct(words.alias("limit"), text.alias("query")))).otherwise(
        F.to_json(F.struct(words.alias("words"), style.alias("style")))
    )
    name = F.when(F.length(text) % 2 == 0, "look_up").otherwise("summarise")
    after = F.when(turn >= 2, F.array(call_id(turn - 2))).otherwise(F.array().cast("array<string>"))
    call = F.struct(call_id(turn).alias("id"), name.alias("name"), arguments.alias("arguments"), after.alias("after"))
    return conversations.select(
        "conv_id", "turn", "role", "text",
        F.when(F.col("role") == "assistant", F.array(call)).otherwise(F.array().cast(tool_calls.CALL)).alias("calls"),
        F.when((F.col("role") == "user") & (turn > 0), call_id(turn - 1)).alias("result_of"),
    )


@ENTRIES.add("op5_tool_calls", "llm")
def op5_tool_calls(spark, folder):
    return tool_calls.link(transcripts(table(spark, folder, "conversations")), TOOLS)


def as_files(docs):
    """Documents as files of a source: two levels of directories, and texts that open with a licence line as licence files of the first."""
    opens = F.coalesce(F.col("text").rlike(r"^[^\n]{0,40}[Ll]icen[cs]e"), F.lit(False))
    name = F.when(opens, F.concat(F.lit("LICENSE."), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    folders = [F.floor(F.col("doc_id") / 400).cast("string"), F.floor(F.pmod("doc_id", F.lit(400)) / 20).cast("string")]
    inner = F.concat_ws("/", F.lit(""), F.col("source"), *folders, name)
    path = F.when(opens, F.concat_ws("/", F.lit(""), F.col("source"), folders[0], name)).otherwise(inner)
    return docs.select("doc_id", path.alias("path"), "text")


@ENTRIES.add("op7_licenses", "llm")
def op7_licenses(spark, folder):
    found = licenses.scan(as_files(table(spark, folder, "documents")), "path", "text")
    return found.select("row.doc_id", "row.path", "license", F.round("score", 6).alias("score"), "how", "inherited_from")


def with_planted_rounds(docs):
    """`op13`'s texts: in one document of ten the words from a place of its id on come round with a period of its id.

    Words are joined by blanks, which leaves the words of a text as they are; other texts are not touched.
    """
    code = F.crc32(F.col("doc_id").cast("string"))
    part = F.floor(code / 10)
    chosen = F.coalesce(code % 10 == 0, F.lit(False)) & F.col("text").isNotNull()
    words = F.filter(F.split(F.regexp_replace("text", r"[\t-\r]", " "), " "), lambda w: w != "")
    out = docs.select("doc_id", "text", part.alias("g"), F.when(chosen, words).alias("words"))
    n = F.size("words")
    out = out.withColumn("a", F.when(n > 0, F.col("g") % n))
    out = out.withColumn("p", F.lit(1) + F.floor((n - F.col("a")) / (F.lit(3) + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    planted = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(F.col("words"), place(i))), " ")
    return out.select("doc_id", F.when(n > 0, planted).otherwise(F.col("text")).alias("text"))


@ENTRIES.add("op13_periodic_runs", "llm")
def op13_periodic_runs(spark, folder):
    found = periodic_runs.with_runs(with_planted_rounds(table(spark, folder, "documents").select("doc_id", "text")), "text")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "row.doc_id", F.size("runs").cast("bigint").alias("n_runs"), "top.start", "top.length", "top.period",
        F.expr("top.length * 1000 div top.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


CLUSTERS, ROUNDS, COMPONENTS = 8, 10, 64


def clusters_sql(k=CLUSTERS, rounds=ROUNDS, size=COMPONENTS):
    """The rounds written out: each assigns all vectors and takes the floor of each component's mean."""
    finite = "x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x)"
    steps = [
        f"""k AS MATERIALIZED (
  SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: {finite})) = {size})""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM
    (SELECT sha256('3:' || vec_id) AS h, v FROM k WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k}))""",
    ]
    for n in range(rounds + 1):
        apart = "list_sum(list_transform(list_zip(k.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
        steps.append(f"""a{n} AS MATERIALIZED (
  SELECT row_no, any_value(vec_id) AS vec_id, any_value(k.v) AS v, min({apart} * {k} + m.c) AS best FROM k, c{n} m GROUP BY row_no)""")
        if n < rounds:
            steps.append(f"""c{n + 1} AS MATERIALIZED (
  SELECT c, coalesce(new.v, old.v) AS v FROM c{n} old LEFT JOIN
    (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM
      (SELECT best % {k} AS c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{n}, range(1, {size + 1}) r(i) GROUP BY ALL) GROUP BY c) new USING (c))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, (best % {k})::INTEGER AS cluster, (best // {k})::BIGINT AS distance,
  (sum(best // {k}) OVER (PARTITION BY best % {k}))::BIGINT AS cluster_inertia, (sum(best // {k}) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} m ON m.c = best % {k}"""


@ENTRIES.add("op11_centroids", "llm", clusters_sql())
def op11_centroids(spark, folder):
    first = F.sha2(F.concat(F.lit("3:"), F.col("key").cast("string")), 256)
    found = centroids.cluster(table(spark, folder, "embeddings"), "vec_id", "embedding", COMPONENTS, CLUSTERS, ROUNDS, first)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


GOOD_FROM = 0.3


def quality_statistics(docs):
    """(doc_id, statistics) of every document, measured once and written."""
    spark = docs.sparkSession
    path = scratch_path(spark, "statistics")
    found = rule_ensemble.with_statistics(docs.select("doc_id", "text"), "text").select("row.doc_id", *rule_ensemble.STATISTICS)
    found.write.parquet(path)
    return spark.read.schema(found.schema).parquet(path)


@ENTRIES.add("op12_rule_ensemble", "llm")
def op12_rule_ensemble(spark, folder):
    measures = quality_statistics(table(spark, folder, "documents"))
    labels = table(spark, folder, "labels").filter(remainder("doc_id", 5) != 0)
    scored = rule_ensemble.with_scores(measures, rule_ensemble.train(measures, "doc_id", labels, "doc_id", "quality"))
    return scored.select(
        "doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"),
    )
