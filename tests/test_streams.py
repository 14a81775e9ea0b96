"""Streams end where the batch transforms end, and take only what is new."""

import os

import pytest
from pyspark.sql import functions as F

from themeloom.operators import jobs
from themeloom.plans import catalog
from themeloom.plans import relations as rel
from themeloom.session import cut_lineage, scratch, shared_folder
from themeloom.sources import tables
from themeloom.streaming import stages

FOLDER = "/root/testdata/sf0.001"


def test_inputs_stream_in_pieces(spark, tmp_path):
    docs = rel.read(spark, FOLDER, "documents")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    columns = ["id", "original_text", "question_id"]
    shaped = rel.inputs(spark, FOLDER).select(*columns)
    for part in range(2):
        shaped.where(f"id % 3 = {part}").coalesce(1).write.mode("append").parquet(source)
    schema = "id long, original_text string, question_id long"
    questions = rel.questions(spark, FOLDER)

    def run():
        stages.stream_inputs(stages.read_stream(spark, source, schema, 1), questions, out)

    run()
    assert tables.read_stage(spark, out, "inputs").count() == shaped.where("id % 3 < 2").count()
    run()  # nothing new
    assert tables.read_stage(spark, out, "inputs").count() == shaped.where("id % 3 < 2").count()
    shaped.where("id % 3 = 2").coalesce(1).write.mode("append").parquet(source)
    run()
    done = tables.read_stage(spark, out, "inputs")
    assert done.count() == done.select("id").distinct().count() == docs.count()
    segments, ready = stages.new_segments(shaped)
    streamed = tables.read_stage(spark, out, "segments")
    keys = ["original_input_id", "segment_order", "segment_text"]
    assert {tuple(r) for r in streamed.select(*keys).collect()} == {tuple(r) for r in segments.select(*keys).collect()}
    assert sorted(r["id"] for r in streamed.select("id").collect()) == list(range(1, segments.count() + 1))
    vectors = tables.read_stage(spark, out, "embeddings")
    assert vectors.count() == segments.count() + ready.count()


def test_retry_state_equals_batch(spark, tmp_path):
    failures = rel.failures(spark, FOLDER)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    failures.repartition(3).write.parquet(source)
    stream = stages.read_stream(
        spark, source, "event_id long, job_type string, original_input_id long, failed_at timestamp", 1)
    got = stages.stream_retry_state(stream, out)
    batch = jobs.retry_state(failures)
    columns = ["job_type", "original_input_id", "attempts", "status", "available_at"]
    assert {tuple(r) for r in got.select(*columns).collect()} == {tuple(r) for r in batch.select(*columns).collect()}
    assert got.count() == batch.count()


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    rows = spark.range(5).withColumn("v", F.col("id") * 2)
    for _ in range(2):
        tables.append_batch(rows, str(tmp_path), "s", 3)
    assert tables.read_stage(spark, str(tmp_path), "s").count() == 5


def test_an_input_of_any_number_of_segments_gets_unique_ids(spark):
    many = spark.createDataFrame([(1, "\n".join(f"line {n}" for n in range(100_003)), None), (2, "a\nb", None)], "id long, original_text string, question_id long")
    segments, _ = stages.new_segments(many, 7)
    assert segments.agg(F.count("*"), F.countDistinct("id"), F.min("id"), F.max("id")).first()[:] == (100_005, 100_005, 7, 100_011)
    assert segments.where("original_input_id = 2").agg(F.min("id")).first()[0] == 100_010


def test_pipeline_in_batches(spark, tmp_path):
    """Eight records over three batches: rejects, a conflict, segments, evidence of earlier batches, themes that grow."""
    context = lambda key, text: {"form_key": "f", "question_key": key, "question_version": None, "question_text": text}
    schema = ("record_id long, original_text string, source string, submission_key string, "
              "question_context struct<form_key: string, question_key: string, question_version: int, question_text: string>")
    batches = [
        [(1, "the kettle was far too slow\nthe cups were cold", " web ", None, context("q1", "How was it?")), (2, " ", "web", None, None),
         (3, "the kettle leaked on the table", "web", None, context("q1", "How was it?"))],
        [(4, "wrong wording for the same question", "web", None, context("q1", "Something else?")), (5, "a quiet room with a nice view", "web", None, None),
         (6, "the kettle was never clean at all", "web", "s1", context("q2", "What else?"))],
        [(7, "the room was quiet and large", "web", None, context("q2", "What else?")), (8, "no question but a submission", "web", "s2", None)],
    ]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def choose(asked, votes):
        word = F.when(F.col("text").contains("kettle"), "Kettle").when(F.col("text").contains("room"), "Room").otherwise("Other")
        return catalog.arithmetic_topics(asked, votes).drop("response").join(
            asked.withColumn("w", word).groupBy(F.col("original_input_id").alias("input_id")).agg(F.to_json(F.struct(
                F.max(F.when(F.col("entity_type") == "original", F.struct(F.col("w").alias("name"), F.lit(False).alias("reused_existing")))).alias("original_topic"),
                F.collect_list(F.when(F.col("entity_type") == "segment", F.struct(F.col("entity_id").alias("segment_id"), F.struct(
                    F.col("w").alias("name"), F.lit(False).alias("reused_existing")).alias("topic")))).alias("segment_topics"))).alias("response")), "input_id")

    def run():
        stages.stream_pipeline(stages.read_stream(spark, source, schema, 1), out, choose=choose, rounds=1)

    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        run()
    run()  # nothing new
    done = {r["id"]: r for r in tables.read_stage(spark, out, "inputs").collect()}
    assert sorted(done) == [1, 3, 5, 6, 7] and {r["status"] for r in done.values()} == {"completed"}
    assert (done[1]["question_id"], done[3]["question_id"], done[5]["question_id"], done[6]["question_id"], done[7]["question_id"]) == (1, 1, None, 2, 2)
    topics = {(r["entity_type"], r["entity_id"]): r["topic"] for r in tables.read_stage(spark, out, "topics").collect()}
    assert topics == {("original", 1): "Kettle", ("segment", 1): "Kettle", ("segment", 2): "Other", ("original", 3): "Kettle",
                      ("original", 5): "Room", ("original", 6): "Kettle", ("original", 7): "Room"}
    themes = {b: sorted(r["name"] for r in stages.read_state(spark, out, b + 1).themes.collect()) for b in range(3)}
    assert themes == {0: ["Kettle"], 1: ["Kettle"], 2: ["Kettle", "Room"]}
    changed = {b: sorted(r["name"] for r in tables.read_stage(spark, out, "themes").where(F.col("batch_id") == b).collect()) for b in range(3)}
    assert changed == {0: ["Kettle"], 1: ["Kettle"], 2: ["Room"]}  # a batch writes what it changed
    asked = {r["action"]: r["topic_key"] for r in tables.read_stage(spark, out, "suggestions").where("batch_id = 1").collect()}
    assert asked == {"reuse": "kettle"}  # its membership grew
    assert tables.read_stage(spark, out, "embeddings").count() == 7


def test_tables_of_a_block_go_with_it(spark):
    rows = spark.range(5)
    with pytest.raises(ZeroDivisionError):
        with scratch(spark) as keep:
            with scratch(spark) as keep_inner:
                gone, until_outer = cut_lineage(rows), keep_inner(rows)
            stays = keep(rows)
            assert not os.path.exists(gone.inputFiles()[0].removeprefix("file:"))
            assert until_outer.count() == 5
            1 // 0
    assert not os.path.exists(until_outer.inputFiles()[0].removeprefix("file:"))
    assert stays.count() == 5


def test_a_batch_leaves_no_tables_behind(spark, tmp_path):
    """Records, segments and units of a batch hold its texts many times over; only its stages and state stay."""
    source = str(tmp_path / "in")
    records = spark.createDataFrame(
        [(n, f"text {n}\nand more of {n}", "web", None, None) for n in range(6)],
        "record_id long, original_text string, source string, submission_key string, question_context struct<form_key:string,question_key:string,question_version:int,question_text:string>",
    )
    records.write.parquet(source)
    at = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}".removeprefix("file:")
    tables_there = lambda: {f"{top}/{f}" for top, _, names in os.walk(at) for f in names if f.endswith(".parquet")}
    before = tables_there()
    stages.stream_pipeline(stages.read_stream(spark, source, records.schema), str(tmp_path / "out"))
    assert tables.read_stage(spark, str(tmp_path / "out"), "inputs").count() == 6
    assert tables_there() == before
