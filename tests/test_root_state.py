"""Roots kept up by batches against roots resolved anew, and what a batch writes."""

import random

import pytest
from pyspark.sql import functions as F

from themeloom.operators import graph, root_state
from themeloom.sources import buckets

THEME = "id long, merged_into_id long"


def as_dict(df):
    rows = df.collect()
    assert len({r["theme_id"] for r in rows}) == len(rows)
    return {r["theme_id"]: r["root_id"] for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_batches(spark, tmp_path, seed):
    """New themes, merges of live ones, chains within a batch, ids that arrive late or never, cycles."""
    rng, themes, seen = random.Random(seed), {}, {}
    for version in range(3):
        batch = {}
        for _ in range(25):
            i = rng.randrange(70)
            if i not in themes or themes[i] is None:
                batch[i] = rng.randrange(75) if rng.random() < 0.6 else None
        themes |= {i: p for i, p in batch.items() if p is not None or i not in themes}
        spoilt = [(i, rng.randrange(70)) for i, p in themes.items() if p is not None and i not in batch][:3]  # merged already
        frame = spark.createDataFrame([*batch.items(), *spoilt, (None, 3)], THEME)
        for _ in range(1 + version % 2 * (seed == 1)):  # a repeated batch gives the same
            changed = as_dict(root_state.update_roots(frame, str(tmp_path), version, 8))
        got = as_dict(root_state.read_roots(spark, str(tmp_path)))
        assert got == as_dict(graph.resolve_roots(spark.createDataFrame(list(themes.items()), THEME)))
        assert {i: r for i, r in (seen | changed).items() if r is not None} == got
        seen = got


def test_a_merge_writes_what_it_changes(spark, tmp_path):
    """A merge of a theme with two aliases among a thousand rewrites the buckets of three themes."""
    folder = str(tmp_path)
    first = [(i, None if i % 10 == 0 or i > 900 else i - i % 10) for i in range(1000)]
    root_state.update_roots(spark.createDataFrame([*first, (2000, None), (2001, 2000), (2002, 2001)], THEME), folder, 0)
    before = buckets.manifest(spark, f"{folder}/ends")
    changed = as_dict(root_state.update_roots(spark.createDataFrame([(2000, 10)], THEME), folder, 1))
    after = buckets.manifest(spark, f"{folder}/ends")
    assert changed == {2000: 10, 2001: 10, 2002: 10}
    assert 1 <= sum(before.get(b) != after[b] for b in after) <= 3
    parts = buckets.read_buckets(spark, f"{folder}/members", root_state.MEMBERS).where("end = 10")
    assert parts.count() == 13 and parts.where(F.col("theme_id") >= 2000).count() == 3


def test_no_rows(spark, tmp_path):
    assert root_state.update_roots(spark.createDataFrame([], THEME), str(tmp_path), 0).collect() == []
    assert root_state.read_roots(spark, str(tmp_path)).collect() == []
