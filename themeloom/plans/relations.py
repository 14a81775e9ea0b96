"""The library's relations derived from the given test tables.

Each function reads one or two of the given tables and shapes them like a relation of the
library, by arithmetic on the ids, so that every relation grows with its table.  A third of the
inputs share one topic on purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.functions import text as tx

EPOCH = "TIMESTAMP '2024-01-01 00:00:00'"
AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def after_epoch(seconds: str) -> F.Column:
    return F.expr(f"timestamp_micros(unix_micros({EPOCH}) + CAST({seconds} AS BIGINT) * 1000000)")


def as_of() -> F.Column:
    return F.expr(AS_OF)


STATUS = """CASE WHEN doc_id % 16 = 0 THEN 'ready_for_analysis' WHEN doc_id % 16 = 8 THEN 'ready_for_embedding'
    WHEN doc_id % 16 = 7 THEN 'ineligible' WHEN doc_id % 16 = 15 THEN 'new' ELSE 'completed' END"""
TOPIC = """CASE WHEN doc_id % 16 IN (7, 15) THEN NULL
    WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'GENERAL' ELSE 'General' END
    WHEN doc_id % 2 = 0 THEN upper(concat(source, ' ', lang)) ELSE concat(source, ' ', lang) END"""
LANG = "CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END"
BLOCK = "CAST((doc_id - doc_id % 1000) / 1000 AS BIGINT)"
QUESTION_ID = f"""CASE WHEN doc_id % 5 <> 0 THEN
    ((({BLOCK} * 20 + CAST(substr(source, 4) AS BIGINT)) * 4 + {LANG}) * 3 + doc_id % 3) * 2 + doc_id % 2 + 1 END"""


def inputs(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("original_text"), "source",
        F.expr(STATUS).alias("status"), F.expr(TOPIC).alias("topic"),
        F.expr(QUESTION_ID).alias("question_id"),
        F.expr("CASE WHEN doc_id % 5 <> 0 THEN concat('s', CAST((doc_id - doc_id % 4) / 4 AS BIGINT)) END").alias("submission_key"),
        after_epoch("doc_id").alias("created_at"),
    )


def questions(spark: SparkSession, folder: str) -> DataFrame:
    identity = read(spark, folder, "documents").where("doc_id % 5 <> 0").select(
        F.expr(QUESTION_ID).alias("id"), "source",
        F.expr(f"concat(lang, '-f', {BLOCK})").alias("form_key"),
        F.expr("concat('q', doc_id % 3)").alias("question_key"),
        F.expr("1 + doc_id % 2").alias("question_version"),
    ).distinct()
    wording = "concat('What about ', question_key, ' in ', form_key, ' v', question_version, '?')"
    return identity.withColumn("question_text", F.expr(wording))


def segments(spark: SparkSession, folder: str) -> DataFrame:
    lines = F.filter(F.transform(F.split("text", "\n"), tx.strip), lambda x: x != "")
    usable = (F.size("_l") >= 2) & (F.size(F.array_distinct("_l")) == F.size("_l"))
    topic = """CASE WHEN (doc_id + segment_order) % 11 = 0 THEN NULL
        ELSE concat(CASE WHEN doc_id % 2 = 0 THEN 'Topic ' ELSE 'topic ' END,
                    CASE WHEN segment_order % 2 = 0 THEN (doc_id + segment_order) % 7
                         ELSE 7 + CAST((doc_id - doc_id % 20) / 20 AS BIGINT) END) END"""
    return (
        read(spark, folder, "documents").where("doc_id % 16 NOT IN (7, 15)")
        .select("doc_id", lines.alias("_l")).where(usable)
        .select("doc_id", F.posexplode("_l").alias("segment_order", "segment_text"))
        .select(
            (F.col("doc_id") * 100_000 + F.col("segment_order")).alias("id"),
            F.col("doc_id").alias("original_input_id"),
            F.col("segment_order").cast("long").alias("segment_order"),
            "segment_text", F.expr(topic).alias("topic"),
        )
    )


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings of originals and segments, some missing, some of another model or dimension."""
    own = inputs(spark, folder).where("status IN ('ready_for_analysis', 'completed') AND id % 9 <> 0").select(
        (F.col("id") * 2).alias("id"), F.col("id").alias("original_input_id"),
        F.lit(None).cast("long").alias("segment_input_id"),
        F.expr("array_repeat(CAST(0.5 AS FLOAT), 8)").alias("embedding"),
        F.expr("CASE WHEN id % 10 = 0 THEN 'b' ELSE 'a' END").alias("embedding_model"),
        F.expr("""CASE WHEN id % 31 = 0 THEN 'answer-only' WHEN question_id IS NULL THEN 'answer-only'
                  ELSE 'question-answer' END""").alias("embedding_representation"),
    )
    pieces = segments(spark, folder).where("id % 17 <> 0").select(
        (F.col("id") * 2 + 1).alias("id"), F.lit(None).cast("long").alias("original_input_id"),
        F.col("id").alias("segment_input_id"),
        F.expr("array_repeat(CAST(0.5 AS FLOAT), CASE WHEN id % 19 = 0 THEN 4 ELSE 8 END)").alias("embedding"),
        F.expr("""CASE WHEN (original_input_id % 10 = 0) <> (id % 13 = 0) THEN 'b' ELSE 'a' END""").alias("embedding_model"),
        F.expr("CASE WHEN original_input_id % 5 = 0 THEN 'answer-only' ELSE 'question-answer' END").alias("embedding_representation"),
    )
    return own.unionByName(pieces)


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Embedded segments with real vectors: two per input, a third of the inputs on one question."""
    parent = "CAST((vec_id - vec_id % 2) / 2 AS BIGINT)"
    return read(spark, folder, "embeddings").select(
        F.col("vec_id").alias("segment_id"), F.expr(parent).alias("original_input_id"), "embedding",
        F.expr("concat('topic_', label)").alias("topic"),
        F.expr("CASE WHEN vec_id % 10 = 0 THEN 'b' ELSE 'a' END").alias("embedding_model"),
        F.expr("CASE WHEN vec_id % 4 = 0 THEN 'No' ELSE concat('Segment number ', vec_id) END").alias("segment_text"),
        F.expr(f"""CASE WHEN {parent} % 5 = 0 THEN NULL WHEN {parent} % 3 = 1 THEN 1
                   ELSE 2 + {parent} % 40 END""").alias("question_id"),
        F.expr(f"{parent} % 3 <> 0").alias("completed"),
    )


def vector_targets(spark: SparkSession, folder: str) -> DataFrame:
    return vectors(spark, folder).select(
        F.lit("segment").alias("target_type"), F.col("segment_id").alias("target_id"),
        "original_input_id", "question_id", F.col("segment_text").alias("text"), "embedding", "embedding_model",
    )


def vector_evidence(spark: SparkSession, folder: str) -> DataFrame:
    return vectors(spark, folder).where("completed").drop("completed")


MERGED_INTO = """CASE WHEN id % 100 = 21 THEN id + 1 WHEN id % 100 IN (22, 23) THEN id - 1
    WHEN id % 100 BETWEEN 60 AND 95 THEN id + 1 WHEN id % 4 = 0 THEN NULL
    WHEN id % 3 = 0 THEN 4 ELSE id + 1 END"""


def themes(spark: SparkSession, folder: str) -> DataFrame:
    """Live themes, short and long alias chains, one root with a quarter of the aliases, cycles."""
    base = read(spark, folder, "customer").select(
        (F.col("c_custkey") + 1).alias("id"), F.concat(F.lit("About "), "c_mktsegment").alias("description")
    )
    return base.select(
        "id", F.concat(F.lit("Theme "), "id").alias("name"), "description",
        F.expr(MERGED_INTO).alias("merged_into_id"),
        after_epoch("(id % 50) * 86400").alias("updated_at"),
    )


def theme_topics(spark: SparkSession, folder: str) -> DataFrame:
    """One to three topics per theme, from a single pass."""
    links = """array_compact(array(
        concat(CASE WHEN id % 3 = 0 THEN 'TOPIC ' ELSE 'topic ' END, CAST((id - id % 25) / 25 AS BIGINT)),
        CASE WHEN id % 7 = 0 THEN concat('src', id % 20, ' ',
            CASE id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END) END,
        CASE WHEN id % 500 IN (20, 40, 61) THEN 'general' END))"""
    return themes(spark, folder).select(F.col("id").alias("theme_id"), F.explode(F.expr(links)).alias("topic"))


def suggestions(spark: SparkSession, folder: str) -> DataFrame:
    """One suggestion per supplier; every third one has been applied."""
    base = read(spark, folder, "supplier").select((F.col("s_suppkey") + 1).alias("id"))
    ids = """CASE id % 4 WHEN 0 THEN array() WHEN 1 THEN array(4 * id + 1) WHEN 2 THEN array(4 * id)
             ELSE array(4 * id, 4 * (id + 4), 4 * id + 1) END"""
    name = """CASE WHEN id % 10 = 4 THEN concat('THEME ', 4 * id) WHEN id % 10 = 6 THEN concat('theme ', id)
              WHEN id % 4 = 0 THEN concat('Fresh ', id % 24) ELSE concat('Renamed ', id) END"""
    return base.select(
        "id", F.expr("CASE id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'reuse' WHEN 2 THEN 'update' ELSE 'merge' END").alias("action"),
        F.expr(name).alias("proposed_name"), F.expr("concat('Description ', id)").alias("proposed_description"),
        F.expr("concat('Because ', id)").alias("rationale"),
        F.expr("sha2(concat('fp', id), 256)").alias("group_fingerprint"),
        F.expr(f"CAST({ids} AS ARRAY<BIGINT>)").alias("existing_theme_ids"),
        F.expr("array(concat(CASE WHEN id % 2 = 0 THEN 'Topic ' ELSE 'topic ' END, id % 60))").alias("topics"),
        F.expr("CASE WHEN id % 3 = 0 THEN 4 * id END").alias("materialized_theme_id"),
        F.when(F.expr("id % 3 = 0"), after_epoch("id * 3600")).alias("materialized_at"),
    )


def suggestion_themes(spark: SparkSession, folder: str) -> DataFrame:
    """The links of suggestions to themes as rows, a few of them twice."""
    base = suggestions(spark, folder)
    links = base.select(F.col("id").alias("suggestion_id"), F.explode("existing_theme_ids").alias("theme_id")).distinct()
    return links.union(base.where("id % 30 = 2").selectExpr("id", "4 * id"))


def suggestion_topics(spark: SparkSession, folder: str) -> DataFrame:
    """The topics of suggestions as rows, some blank, some on a suggestion that has them or does not exist."""
    base = suggestions(spark, folder)
    extra = base.where("id % 20 = 1").selectExpr("id + 3", "CASE WHEN id % 3 = 0 THEN upper(topics[0]) ELSE ' ' END")
    return base.select(F.col("id").alias("suggestion_id"), F.explode("topics").alias("topic")).union(extra)


def evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence for every suggestion, and for some that do not exist."""
    none, count = F.lit(None).cast("long"), read(spark, folder, "supplier").count()
    own = inputs(spark, folder).where("topic IS NOT NULL").select(
        F.expr(f"1 + id % {count}").alias("suggestion_id"), F.col("id").alias("original_input_id"), none.alias("segment_input_id")
    )
    pieces = segments(spark, folder).where("topic IS NOT NULL").select(
        F.expr(f"1 + id % {count + 8}").alias("suggestion_id"), none.alias("original_input_id"), F.col("id").alias("segment_input_id")
    )
    return own.union(pieces)


JOB_TYPE = """CASE CAST(get_json_object(props, '$.k') AS BIGINT) % 4 WHEN 0 THEN 'eligibility_segmentation'
    WHEN 1 THEN 'embeddings' WHEN 2 THEN 'topics' ELSE 'themes' END"""


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type",
        F.col("user_id").alias("original_input_id"), F.expr(JOB_TYPE).alias("job_type"),
    )


def failures(spark: SparkSession, folder: str) -> DataFrame:
    return attempts(spark, folder).where("event_type = 'error'").select(
        "event_id", "job_type", "original_input_id", F.col("ts").alias("failed_at")
    )


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """The job table as the log leaves it: one row per job, status by arithmetic on its last event."""
    last = attempts(spark, folder).groupBy("job_type", "original_input_id").agg(
        F.max("event_id").alias("id"), F.max("ts").alias("last_ts"),
        F.count(F.when(F.col("event_type") == "error", 1)).alias("attempts"),
    )
    status = "CASE id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed' ELSE 'failed' END"
    shaped = last.withColumn("status", F.expr(status))
    return shaped.select(
        "id", "job_type", "original_input_id", "status", "attempts",
        F.col("last_ts").alias("available_at"),
        F.when(F.expr("id % 4 = 1"), F.col("last_ts")).alias("locked_at"),
        F.expr("CASE WHEN id % 4 = 1 THEN concat('worker-', id % 3) END").alias("locked_by"),
        F.expr("CASE WHEN id % 4 = 3 THEN concat('error ', id) END").alias("last_error"),
        F.when(F.expr("id % 4 = 2"), F.col("last_ts")).alias("completed_at"),
    )


def raw_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records as they arrive: padded strings, blank fields, missing versions, changed wordings."""
    key, version = "concat('q', doc_id % 3)", "1 + doc_id % 2"
    form = f"concat(lang, '-f', {BLOCK})"
    wording = f"""CASE WHEN doc_id % 50 = 1 THEN 'Changed wording?'
        ELSE concat('What about ', {key}, ' in ', {form}, ' v', {version}, '?') END"""
    context = f"""CASE WHEN doc_id % 5 <> 0 THEN named_struct(
        'form_key', concat(' ', {form}),
        'question_key', CASE WHEN doc_id % 47 = 0 THEN ' ' ELSE {key} END,
        'question_version', CAST(CASE WHEN doc_id % 53 = 0 THEN 0 WHEN doc_id % 2 = 0 THEN NULL ELSE 2 END AS INT),
        'question_text', concat({wording}, ' ')) END"""
    return read(spark, folder, "documents").select(
        F.col("doc_id").alias("record_id"),
        F.expr(r"CASE WHEN doc_id % 41 = 0 THEN ' \t\n ' ELSE concat('  ', text, ' \n') END").alias("original_text"),
        F.expr("CASE WHEN doc_id % 43 = 0 THEN ' ' ELSE concat(' ', source) END").alias("source"),
        F.expr("CASE WHEN doc_id % 7 = 0 THEN concat('s', doc_id, ' ') END").alias("submission_key"),
        F.expr(context).alias("question_context"),
    )


def dialog(spark: SparkSession, folder: str) -> DataFrame:
    """Assistant turns with the user turn right before them, found by an equi-join on the turn."""
    turns = read(spark, folder, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question_text"))
    return turns.where("role = 'assistant'").join(asked, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.col("text").alias("answer_text"), "question_text"
    )
