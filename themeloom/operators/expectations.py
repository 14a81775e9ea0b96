"""Expectations on a stage, counted while it is written.

An expectation is a row: a name, a measure (an SQL aggregate over the rows of the stage that adds up over tasks, such as
``count_if(...)``, ``sum(...)``, ``min(...)`` or ``max(...)``) and the least and highest value that it may have; NULL is no
bound.  All measures are observed in the one pass that writes the stage, so checking costs no further scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

RESULT = "name string, measured long, at_least long, at_most long, met boolean"


class Expectation(NamedTuple):
    name: str
    measure: str
    at_least: int | None = None
    at_most: int | None = None


def none_of(name: str, condition: str) -> Expectation:
    """No row for which ``condition`` is true; NULL is not true."""
    return Expectation(name, f"count_if({condition})", 0, 0)


def some_of(name: str, condition: str, at_least: int = 1, at_most: int | None = None) -> Expectation:
    """At least (and at most) so many rows for which ``condition`` is true."""
    return Expectation(name, f"count_if({condition})", at_least, at_most)


def from_table(rows: DataFrame) -> list[Expectation]:
    """Expectations kept as a table (name, measure, at_least, at_most); as many as a person writes."""
    return [Expectation(*row) for row in rows.select("name", "measure", "at_least", "at_most").orderBy("name").collect()]


def write_checked(df: DataFrame, expectations: Sequence[Expectation], write: Callable[[DataFrame], None]) -> DataFrame:
    """Hand ``df`` to ``write`` and return (name, measured, at_least, at_most, met), a row for each expectation.

    The measures count what is written, once: they are observed in the tasks that write.  Without rows a
    count is 0 and a minimum NULL; a NULL measure meets only an expectation without bounds.
    """
    spark = df.sparkSession
    names = [e.name for e in expectations]
    if len(set(names)) < len(names):
        raise ValueError("names of expectations repeat")
    if not expectations:
        write(df)
        return spark.createDataFrame([], RESULT)
    seen = Observation()
    # Named by place: an expectation may have the name of a column.
    write(df.observe(seen, *[F.expr(e.measure).cast("long").alias(f"m{n}") for n, e in enumerate(expectations)]))
    return _judged(spark, expectations, seen.get)


def _judged(spark: SparkSession, expectations: Sequence[Expectation], measured: dict) -> DataFrame:
    rows = [(e.name, measured[f"m{n}"], e.at_least, e.at_most) for n, e in enumerate(expectations)]
    bounded = spark.createDataFrame(rows, "name string, measured long, at_least long, at_most long")
    low = F.col("at_least").isNull() | F.coalesce(F.col("measured") >= F.col("at_least"), F.lit(False))
    high = F.col("at_most").isNull() | F.coalesce(F.col("measured") <= F.col("at_most"), F.lit(False))
    return bounded.withColumn("met", low & high)


def outcomes(inputs: DataFrame, questions: DataFrame, segments: DataFrame, embeddings: DataFrame) -> DataFrame:
    """A row for each input with its question, number of segments and own representation: what outcomes are checked on.

    Segments and embeddings are counted by input before they are joined, so no text travels with them.
    """
    asked = questions.select(F.col("id").alias("question_id"), "form_key", "question_key", "question_version")
    pieces = segments.groupBy(F.col("original_input_id").alias("id")).agg(F.count(F.lit(1)).alias("segments"))
    own = embeddings.where("original_input_id IS NOT NULL").groupBy(F.col("original_input_id").alias("id")).agg(
        F.count(F.lit(1)).alias("embeddings"),
        F.count_if(F.col("embedding_representation") == "question-answer").alias("contextual"),
        F.count_if(F.col("embedding_representation") == "answer-only").alias("generic"),
    )
    rows = inputs.select("id", "status", "submission_key", "question_id").join(asked, "question_id", "left")
    return rows.join(pieces, "id", "left").join(own, "id", "left").fillna(0, ["segments", "embeddings", "contextual", "generic"])
