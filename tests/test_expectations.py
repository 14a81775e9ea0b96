"""Expectations are measured on what is written, in the writing pass."""

import pytest

from themeloom.operators import expectations as ex

SCHEMA = "id long, status string, n long"


def run(spark, rows, expected, path):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    report = ex.write_checked(df, expected, lambda x: x.write.parquet(path))
    assert spark.read.parquet(path).count() == len(rows)
    return {r.name: (r.measured, r.met) for r in report.collect()}


def test_bounds(spark, tmp_path):
    rows = [(1, "done", 3), (2, "open", None), (3, None, 5)]
    expected = [
        ex.none_of("all_done", "status <> 'done'"), ex.some_of("some_done", "status = 'done'"), ex.some_of("exactly_two", "n > 0", 2, 2),
        ex.Expectation("n", "sum(n)", None, 7), ex.Expectation("least", "min(n)", 3), ex.Expectation("free", "max(id)"),
    ]
    assert run(spark, rows, expected, str(tmp_path / "a")) == {
        "all_done": (1, False), "some_done": (1, True), "exactly_two": (2, True), "n": (8, False), "least": (3, True), "free": (3, True)}


def test_no_rows(spark, tmp_path):
    expected = [ex.none_of("none", "status = 'x'"), ex.Expectation("least", "min(n)", 1), ex.Expectation("free", "min(n)")]
    assert run(spark, [], expected, str(tmp_path / "a")) == {"none": (0, True), "least": (None, False), "free": (None, True)}
    assert run(spark, [(1, "a", 1)], [], str(tmp_path / "b")) == {}


def test_a_table_of_expectations(spark):
    table = spark.createDataFrame([("b", "count(1)", 1, None), ("a", "sum(n)", None, 2)], "name string, measure string, at_least long, at_most long")
    assert ex.from_table(table) == [ex.Expectation("a", "sum(n)", None, 2), ex.Expectation("b", "count(1)", 1, None)]
    with pytest.raises(ValueError):
        ex.write_checked(table, [ex.some_of("a", "true")] * 2, lambda x: None)
