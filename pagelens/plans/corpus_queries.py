"""Queries over the whole corpus: features, models, similarity, duplicates, and the incremental jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelens import seeds
from pagelens.operators import duplicates as dup
from pagelens.operators import features as ft
from pagelens.operators import lexicon as lx
from pagelens.operators import models as md
from pagelens.operators import pair_model as pm
from pagelens.operators.reports import job_status as status_of
from pagelens.plans import parameters as P
from pagelens.plans import sql as S
from pagelens.plans.entry import Registry, docs
from pagelens.plans.job_queries import cancelled
from pagelens.session import scratch_path, written
from pagelens.sources import tables as tb
from pagelens.streaming import ingest

ENTRIES = Registry()
STOP = seeds.all_stop_words()
THRESHOLD = 0.8

_FEATURES = rf"""w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'),
        lambda x: NOT list_contains({S.STOP}, x)) AS ws FROM documents),
    terms AS (SELECT doc_id, unnest(ws) AS word FROM w UNION ALL
        SELECT doc_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w),
    tf AS (SELECT doc_id, word, count(*) AS n FROM terms GROUP BY ALL),
    nd AS (SELECT count(*)::DOUBLE AS docs FROM documents),
    vocab AS (SELECT word, ln((1.0::DOUBLE + any_value(docs)) / (1.0::DOUBLE + count(*))) + 1.0::DOUBLE AS idf FROM tf, nd GROUP BY word
        HAVING count(*) <= any_value(docs) * 0.95::DOUBLE ORDER BY sum(n) DESC, word LIMIT 5000),
    raw AS (SELECT doc_id, word, n * idf AS x FROM tf JOIN vocab USING (word)),
    weights AS (SELECT doc_id, word, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""


@ENTRIES.add("tfidf_features", "M1 T5", f"WITH {_FEATURES} SELECT doc_id, word, round(weight, 6) AS weight FROM weights")
def tfidf_features(spark, sf):
    return ft.tfidf(docs(spark, sf), "doc_id", "text", STOP).withColumn("weight", F.round("weight", 6))


@ENTRIES.add(
    "tfidf_cosine",
    "M6 J8",
    f"""WITH {_FEATURES}, p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)
    SELECT p.a, p.b, round(coalesce(sum(x.weight * y.weight), 0.0::DOUBLE), 6) AS cosine FROM p LEFT JOIN weights x ON x.doc_id = p.a
        LEFT JOIN weights y ON y.doc_id = p.b AND y.word = x.word GROUP BY p.a, p.b""",
)
def tfidf_cosine(spark, sf):
    d = docs(spark, sf)
    ids = tb.table(spark, sf, "documents").select("doc_id")
    pairs = ids.select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b")).join(
        ids.select(F.col("doc_id").alias("b")), "b"
    )
    return ft.pair_cosine(ft.tfidf(d, "doc_id", "text", STOP), pairs.select("a", "b"), "doc_id")


@ENTRIES.add(
    "embedding_cosine",
    "M6",
    """SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def embedding_cosine(spark, sf):
    e = tb.table(spark, sf, "embeddings")
    left = e.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), F.col("embedding").alias("x"))
    right = e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return left.join(right, "b").select("a", "b", F.round(dup.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


_WS = S.words("lower(text)")


@ENTRIES.add(
    "turn_jaccard",
    "M7 U2",
    f"""WITH t AS (SELECT conv_id, turn, list_distinct({_WS}) AS w FROM conversations)
    SELECT a.conv_id, a.turn, len(list_intersect(a.w, b.w)) AS shared, {S.ratio('len(list_intersect(a.w, b.w))',
        'len(list_distinct(list_concat(a.w, b.w)))')} AS jaccard FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""",
)
def turn_jaccard(spark, sf):
    t = tb.table(spark, sf, "conversations").select("conv_id", "turn", dup.word_set(F.col("text")).alias("w"))
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return t.join(after, ["conv_id", "turn"]).select(
        "conv_id",
        "turn",
        F.size(F.array_intersect("w", "v")).cast("bigint").alias("shared"),
        dup.jaccard(F.col("w"), F.col("v")).alias("jaccard"),
    )


@ENTRIES.add(
    "exact_duplicates",
    "M9",
    """SELECT sha256(lower(trim(text))) AS hash, min(doc_id) AS keeper, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1""",
)
def exact_duplicates(spark, sf):
    return dup.exact_groups(docs(spark, sf), "doc_id", "text")


_CLUSTERS = f"""sets AS (SELECT doc_id AS id, list_distinct({_WS}) AS w FROM documents),
    tok AS (SELECT id, len(w) AS k, unnest(w) AS t FROM sets),
    pairs AS (SELECT a.id AS a, b.id AS b FROM tok a JOIN tok b ON a.t = b.t AND a.id < b.id AND least(a.k, b.k) >= 0.8 * greatest(a.k, b.k) - 1e-9
        GROUP BY a.id, b.id, a.k, b.k HAVING count(*)::DOUBLE / (a.k + b.k - count(*))::DOUBLE >= 0.8),
    edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
    reach(id, label) AS (SELECT id, id FROM sets UNION SELECT e.b, r.label FROM reach r JOIN edges e ON e.a = r.id),
    clusters AS (SELECT id, min(label) AS keeper FROM reach GROUP BY id)"""


@ENTRIES.add("duplicate_clusters", "M9 M10 J8", f"WITH RECURSIVE {_CLUSTERS} SELECT id, keeper FROM clusters")
def duplicate_clusters(spark, sf):
    return dup.clusters(docs(spark, sf), "doc_id", "text", THRESHOLD)


@ENTRIES.add(
    "deduplicated_documents",
    "M10",
    f"WITH RECURSIVE {_CLUSTERS} SELECT d.doc_id, d.lang, d.n_chars FROM documents d JOIN clusters c ON c.id = d.doc_id WHERE c.keeper = c.id",
)
def deduplicated_documents(spark, sf):
    d = tb.table(spark, sf, "documents")
    return dup.keep_lowest(d, "doc_id", dup.clusters(docs(spark, sf), "doc_id", "text", THRESHOLD)).select("doc_id", "lang", "n_chars")


@ENTRIES.add(
    "duplicate_rows",
    "M7 M8 J3",
    f"""WITH RECURSIVE {_CLUSTERS}, {_FEATURES}, r AS (SELECT c.keeper, c.id, x.w AS w1, y.w AS w2, len(list_intersect(x.w, y.w)) AS s FROM clusters c
        JOIN sets x ON x.id = c.keeper JOIN sets y ON y.id = c.id WHERE c.id <> c.keeper),
    q AS (SELECT *, s::DOUBLE / (len(w1) + len(w2) - s)::DOUBLE AS j FROM r),
    dots AS (SELECT keeper, id, round(coalesce(sum(x.weight * y.weight), 0.0::DOUBLE), 6) AS dot FROM r LEFT JOIN weights x ON x.doc_id = keeper
        LEFT JOIN weights y ON y.doc_id = id AND y.word = x.word GROUP BY ALL)
    SELECT keeper AS content1_id, id AS content2_id, dot AS cosine_similarity,
        j AS jaccard_similarity, j >= 0.8::DOUBLE AS is_duplicate, abs(j - 0.8::DOUBLE) AS confidence, 0.8::DOUBLE AS threshold_used,
        a.source AS source1, b.source AS source2 FROM q JOIN dots USING (keeper, id) JOIN documents a ON a.doc_id = q.keeper
        JOIN documents b ON b.doc_id = q.id""",
)
def duplicate_rows(spark, sf):
    d = tb.table(spark, sf, "documents")
    rows = dup.duplicate_rows(d, "doc_id", "text", dup.clusters(docs(spark, sf), "doc_id", "text", THRESHOLD), THRESHOLD, stop_words=STOP)
    # Both sides of every duplicate meet their content row again.
    one = d.select(F.col("doc_id").alias("content1_id"), F.col("source").alias("source1"))
    two = d.select(F.col("doc_id").alias("content2_id"), F.col("source").alias("source2"))
    return rows.withColumn("cosine_similarity", F.round("cosine_similarity", 6)).join(one, "content1_id").join(
        two, "content2_id"
    )


@ENTRIES.add("learned_duplicates", "M8")
def learned_duplicates(spark, sf):
    return pm.learned(docs(spark, sf), "doc_id", "text", STOP)[0]


@ENTRIES.add("learned_duplicates_report", "M8 M11")
def learned_duplicates_report(spark, sf):
    return pm.learned(docs(spark, sf), "doc_id", "text", STOP)[1]


_NAMES = [(f"n_{c}", c) for c in seeds.LANGUAGES]


@ENTRIES.add(
    "evaluation",
    "M11 J9",
    f"""WITH t AS (SELECT doc_id, unnest({S.tokens('text')}) AS word FROM documents),
    v AS (SELECT doc_id, {', '.join(f"count(*) FILTER (profile = '{c}') AS n_{c}" for c in seeds.LANGUAGES)} FROM t
        LEFT JOIN {seeds.sql_values([(w, lang) for lang, ws in seeds.STOP_WORDS.items() for w in ws], 'word, profile')} l USING (word) GROUP BY doc_id),
    p AS (SELECT d.doc_id, d.lang AS y, coalesce(CASE WHEN greatest({', '.join(c for c, _ in _NAMES)}) > 0 THEN {S.first_best(_NAMES)} END, 'general') AS yhat
        FROM documents d LEFT JOIN v USING (doc_id)),
    classes AS (SELECT y AS class FROM p UNION SELECT yhat FROM p),
    m AS (SELECT class, count(*) FILTER (y = class) AS support, count(*) FILTER (yhat = class) AS claimed,
        count(*) FILTER (y = class AND yhat = class) AS hit FROM classes, p GROUP BY class),
    r AS (SELECT class, support, hit, CASE WHEN claimed > 0 THEN hit::DOUBLE / claimed ELSE 0 END AS precision,
        CASE WHEN support > 0 THEN hit::DOUBLE / support ELSE 0 END AS recall FROM m),
    f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM r)
    SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f
    UNION ALL SELECT 'accuracy', round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), sum(support)::BIGINT FROM f
    UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM f
    UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
        round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM f""",
)
def evaluation(spark, sf):
    d = docs(spark, sf)
    votes = lx.language(d, "doc_id", "text", seeds.STOP_WORDS).filter("votes > 0").select("doc_id", "language")
    # Documents without a vote keep their place and count as the fallback class.
    joined = tb.table(spark, sf, "documents").select("doc_id", "lang").join(votes, "doc_id", "left")
    return md.evaluation(joined, "lang", "language")


def _prepared(spark: SparkSession, sf: str) -> DataFrame:
    return md.prepared(docs(spark, sf).select("doc_id", "text", "lang"), "text", STOP)


@ENTRIES.add("classifier_training", "M2 M11")
def classifier_training(spark, sf):
    train, test = md.split_rows(_prepared(spark, sf), "doc_id")
    model = md.train_classifier(train, "lang")
    predicted = md.predict(model, test, ["doc_id", "lang"])
    rows = md.evaluation(predicted, "lang", "predicted")
    losses = md.history(model)
    return rows.withColumns({"first_loss": F.lit(losses[0]), "last_loss": F.lit(losses[-1])})


@ENTRIES.add("network_training", "M2")
def network_training(spark, sf):
    train, test = md.split_rows(_prepared(spark, sf), "doc_id")
    model = md.train_classifier(train, "lang", layers=(256, 128, 64))
    return md.evaluation(md.predict(model, test, ["doc_id", "lang"]), "lang", "predicted")


@ENTRIES.add("classifier_predictions", "M3 J9")
def classifier_predictions(spark, sf):
    rows = _prepared(spark, sf)
    model = md.train_classifier(md.split_rows(rows, "doc_id")[0], "lang")
    out = md.predict(model, rows, ["doc_id"])
    return out.select("doc_id", "predicted", F.round("confidence", 6).alias("confidence"), "error")


@ENTRIES.add("quality_model", "M4 N15")
def quality_model(spark, sf):
    labels = tb.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("good"))
    words = written(md.with_words(docs(spark, sf).select("doc_id", "text"), "text", STOP).drop("text"), "words", "zstd")
    # Words meet their labels once; terms, of which there are twice as many, are made after that.
    labelled = written(words.join(labels, "doc_id"), "labelled", "zstd")
    model = md.train_classifier(md.terms_of_words(labelled), "good")
    return md.quality_scores(model, md.terms_of_words(words), ["doc_id"])


@ENTRIES.add("training_history", "M2")
def training_history(spark, sf):
    train, test = md.split_rows(_prepared(spark, sf), "doc_id")
    rows = [
        md.training_history(train, test, "lang", layers=layers, epochs=6, max_terms=1000)[0].select(F.lit(name).alias("model"), "*")
        for name, layers in (("linear", ()), ("network", (64, 32)))
    ]
    return rows[0].union(rows[1])


@ENTRIES.add(
    "model_registry",
    "M12 M13",
    # Metrics come of training; that they are there, that the choice follows them and that a version reloads as it was do not.
    """SELECT 'language_classifier' AS model_name, v::INTEGER AS version, (SELECT count(*) FROM documents WHERE doc_id % 5 <> 0) AS training_data_size,
        (SELECT count(DISTINCT lang) FROM documents WHERE doc_id % 5 <> 0) AS num_classes, CASE v WHEN 1 THEN '1' ELSE '10' END AS epochs,
        TRUE AS has_metrics, TRUE AS choice_follows_metric, 1.0::DOUBLE AS reload_agreement FROM range(1, 3) t(v)""",
)
def model_registry(spark, sf):
    rows, registry = _prepared(spark, sf), scratch_path(spark, "registry")
    train, test = rows.filter("doc_id % 5 <> 0"), rows.filter("doc_id % 5 = 0")
    size, name, kept = train.count(), "language_classifier", {}
    for epochs in (1, 10):
        model = md.train_classifier(train, "lang", epochs=epochs)
        scored = md.predict(model, test, ["doc_id", "lang"])
        kept[md.register(registry, name, model, {"epochs": epochs, "max_terms": md.MAX_TERMS}, size, scored, "lang")] = scored
    version, loaded = md.best_version(spark, registry, name)
    before = kept[version].select("doc_id", F.col("predicted").alias("p"))
    after = md.predict(loaded, test, ["doc_id"]).select("doc_id", F.col("predicted").alias("q"))
    same = before.join(after, "doc_id").agg(F.avg(F.col("p").eqNullSafe(F.col("q")).cast("double"))).first()[0]
    measures = [F.col(m).between(0, 1) for m in ("accuracy", "precision", "recall", "f1")]
    return md.registered(spark, registry).select(
        "model_name", "version", "training_data_size", "num_classes", F.element_at("settings", "epochs").alias("epochs"),
        (measures[0] & measures[1] & measures[2] & measures[3]).alias("has_metrics"),
        ((F.row_number().over(W.orderBy(F.desc("f1"), F.desc("version"))) == 1) == (F.col("version") == version)).alias("choice_follows_metric"),
        F.lit(float(same)).alias("reload_agreement"),
    )


@ENTRIES.add("topic_model", "N7")
def topic_model(spark, sf):
    rows, perplexity = md.topics(docs(spark, sf), "doc_id", "text", STOP)
    return rows.withColumn("log_perplexity", F.lit(perplexity))


@ENTRIES.add(
    "document_topics",
    "N7",
    # Which topic a document is of depends on the model; that every document with a counted term has shares that add up does not.
    f"""WITH {_FEATURES.split('nd AS')[0].rstrip().rstrip(',')}, n AS (SELECT count(*)::DOUBLE AS docs FROM documents),
    top AS (SELECT word FROM tf, n GROUP BY word HAVING count(*) <= any_value(docs) * 0.8::DOUBLE ORDER BY sum(n.docs * 0 + tf.n) DESC, word LIMIT 100)
    SELECT d.doc_id, d.doc_id IN (SELECT doc_id FROM tf JOIN top USING (word)) AS has_topics FROM documents d""",
)
def document_topics(spark, sf):
    found = md.topic_model(docs(spark, sf), "doc_id", "text", STOP).mixtures
    whole = F.abs(F.aggregate("topics", F.lit(0.0), lambda s, x: s + x) - 1) < 1e-6
    return found.select("doc_id", (F.col("topics").isNotNull() & whole & (F.size("topics") == 3)).alias("has_topics"))


# --- incremental jobs ----------------------------------------------------------------------------


@ENTRIES.add(
    "page_ingest",
    "R1",
    f"""WITH {S.MARKUP}, t AS (SELECT page_id, url, {S.title('m')} AS title, {S.visible('m')} AS text_content FROM markup)
    SELECT page_id, url, title, text_content, len({S.words('text_content')}) AS word_count,
        coalesce({S.url_reason('url')}, {S.content_reason('text_content')}) AS error FROM t""",
)
def page_ingest(spark, sf):
    out = scratch_path(spark, "ingest")
    stream = ingest.landed(spark, f"{sf}/pages.parquet", "pages")
    ingest.ingest_pages(stream, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@ENTRIES.add(
    "live_progress",
    "R2 R3",
    f"WITH {S.JOBS} SELECT job_id, status, total_urls, processed_urls, failed_urls FROM jobs",
)
def live_progress(spark, sf):
    out = scratch_path(spark, "progress")
    rows = tb.job_rows(ingest.landed(spark, f"{sf}/documents.parquet", "documents"))

    def keep(batch: DataFrame, batch_id: int) -> None:
        # Each batch goes to its own folder, so a repeated batch overwrites itself.
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batches/{batch_id}")

    ingest.publish_progress(rows, keep, f"{out}/checkpoint").awaitTermination()
    changes = spark.read.parquet(f"{out}/batches/*")
    latest = changes.groupBy("job_id").agg(
        F.max_by(F.struct("processed_urls", "failed_urls"), "batch").alias("x")
    ).select("job_id", "x.*")
    jobs = latest.withColumn("total_urls", F.col("processed_urls") + F.col("failed_urls"))
    return status_of(jobs, cancelled(spark, sf)).select(
        "job_id", "status", "total_urls", "processed_urls", "failed_urls"
    )


@ENTRIES.add(
    "cancelled_jobs_stop",
    "R4",
    f"""WITH {S.JOBS} SELECT job_id, count(*) AS rows_taken FROM job_rows WHERE job_id NOT IN (SELECT job_id FROM cancelled) GROUP BY job_id""",
)
def cancelled_jobs_stop(spark, sf):
    out = scratch_path(spark, "cancel")
    rows = tb.job_rows(ingest.landed(spark, f"{sf}/documents.parquet", "documents")).select("job_id", "content_id")
    taken = ingest.without_cancelled(rows, cancelled(spark, sf))
    ingest.to_table(taken, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema("job_id string, content_id bigint").parquet(f"{out}/rows").groupBy("job_id").agg(
        F.count(F.lit(1)).alias("rows_taken")
    )


@ENTRIES.add(
    "replayed_events",
    "R5",
    "SELECT event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY event_type",
)
def replayed_events(spark, sf):
    out = scratch_path(spark, "replay")
    schema = "event_id bigint, ts timestamp, event_type string, value double"

    def once() -> DataFrame:
        rows = ingest.landed(spark, f"{sf}/events.parquet", "events")
        return rows.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")

    # The first stream delivers every event twice; the second, with a checkpoint of its own, delivers all of them once more.
    for stream, rows in (("first", once().union(once())), ("again", once())):
        ingest.take_new(rows, "event_id", f"{out}/keys", f"{out}/rows", f"{out}/checkpoint-{stream}", stream, buckets=16).awaitTermination()
    rows = spark.read.schema(schema).parquet(f"{out}/rows")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
