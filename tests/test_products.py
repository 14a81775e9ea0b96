"""Read models whose rows are pairs: a hot topic with many themes is dealt over tasks and its pairs are not shuffled."""

import os
import random
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from themeloom.operators import intake, products, reports
from themeloom.plans import catalog
from themeloom.session import long_dictionaries
from themeloom.sources import schema

THEMES = "id long, name string, description string, merged_into_id long"
LINKS = "theme_id long, topic string"
INPUTS, MANY = 40, 60


@pytest.fixture
def small_strips(monkeypatch):
    monkeypatch.setattr(products, "LEFT", 4)
    monkeypatch.setattr(products, "RIGHT", 8)
    monkeypatch.setattr(products, "WIDE", 16)


def relations(spark):
    """Inputs on one hot topic, half of them on others too; themes of the hot topic share others, some twice."""
    rng = random.Random(5)
    links = [(i, "general") for i in range(MANY)] + [(i, f"Rare {i % 7}") for i in range(0, MANY + 20)] + [(3, "GENERAL")]
    said = {i: {"General"} | {f"rare {rng.randrange(9)}" for _ in range(i % 4)} for i in range(INPUTS)} | {99: set(), 98: {"nobody"}}
    base = [(i, f"Theme {i}", None if i % 2 else "d", None) for i in range(MANY + 20)]
    inputs = [(i, f"text {i}", "s", "completed", "General" if i < INPUTS else None, 1 + i % 2 if i % 3 else None, None, None) for i in said]
    pieces = [(100 * i + n, i, n, "x", t, None) for i, topics in said.items() for n, t in enumerate(sorted(topics - {"General"}))]
    asked = [(i, "s", f"f{i}", "q", 1, "Q?", None) for i in (1, 2)]
    frames = [spark.createDataFrame(*x) for x in (
        (inputs, schema.INPUTS), (pieces, schema.SEGMENTS), (asked, schema.QUESTIONS), (base, THEMES), (links, LINKS))]
    of = defaultdict(set)
    for theme, topic in links:
        of[topic.lower()].add(theme)
    return frames, said, of


def watched(monkeypatch, name):
    """Rows on both sides and of the result of every such join."""
    seen, real = [], getattr(reports, name)

    def join(left, right, *rest, **more):
        found = real(left, right, *rest, **more)
        seen.append((left.count(), right.count(), found.count()))
        return found

    monkeypatch.setattr(reports, name, join)
    return seen


def test_strips_hold_every_pair_once_and_are_dealt(spark, small_strips):
    left = spark.createDataFrame([("hot", i) for i in range(50)] + [("hot", 1), ("cold", 7), (None, 8)], "k string, a long")
    right = spark.createDataFrame([("hot", i) for i in range(33)] + [("hot", 1), ("cold", 5), (None, 6)], "k string, b long")
    got = products.join_in_strips(left, right, "k")
    assert Counter(map(tuple, got.select("k", "a", "b").collect())) == Counter(map(tuple, left.join(right, "k").select("k", "a", "b").collect()))
    dealt = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) > 1 and max(r["count"] for r in dealt) < 51 * 34


def test_links_of_a_hot_topic_are_distinct_without_a_shuffle(spark, small_strips, monkeypatch):
    (inputs, segments, _, base, links), said, of = relations(spark)
    seen = watched(monkeypatch, "join_in_strips")
    linked = reports.topic_themes(base, links, base.select(F.col("id").alias("theme_id"), F.col("id").alias("root_id")))
    got = Counter((r["input_id"], r["theme"]["id"]) for r in reports.input_theme_links(inputs, segments, linked).collect())
    assert got == Counter((i, t) for i, topics in said.items() for t in set().union(*[of[x.lower()] for x in topics]))
    assert seen == [(INPUTS, MANY + 80, INPUTS * MANY)]  # one row for an input


def test_lists_of_a_hot_topic_come_last(spark, small_strips, monkeypatch):
    (inputs, segments, questions, base, links), said, of = relations(spark)
    seen = watched(monkeypatch, "join_one_in_strips")
    roots = base.select(F.col("id").alias("theme_id"), F.col("id").alias("root_id"))
    rows = reports.inputs_with_themes(inputs, segments, questions, base, links, roots, intake.check_scope(limit=None)).collect()
    name = lambda t: (f"theme {t}", t)
    assert {r["id"]: [t["id"] for t in r["themes"]] for r in rows} == {
        i: sorted(set().union(*[of[x.lower()] for x in topics]), key=name) for i, topics in said.items()}
    assert len(rows) == len(said) and seen == [(len(said), 8, len(said))]


def test_chains_keep_every_row(spark, small_strips, monkeypatch):
    (inputs, segments, questions, base, links), said, of = relations(spark)
    seen = watched(monkeypatch, "join_in_strips")
    live = base.where("id <> 3").select(F.col("id").alias("theme_id"), F.col("id").alias("root_id"))
    linked = reports.linked_or_dead(base, links, live)
    got = Counter((r["answer_id"], r["topic"], r["theme_id"], r["theme_name"]) for r in reports.answer_topic_theme_chain(inputs, segments, questions, linked).collect())
    ends = lambda topic: [(t, f"Theme {t}") if t != 3 else (None, None) for t in of[topic.lower()]] or [(None, None)]
    assert got == Counter((i, t, *end) for i, topics in said.items() for t in topics or [None] for end in (ends(t) if t else [(None, None)]))
    assert seen[0][0] == sum(bool(of[t.lower()]) for topics in said.values() for t in topics)


def test_repeated_texts_are_written_once(spark, tmp_path):
    rng = random.Random(1)
    texts = spark.createDataFrame([("".join(rng.choices("abcdefghijklmnop", k=4000)),) for _ in range(600)], "t string")
    rows = texts.select("t", F.explode(F.sequence(F.lit(1), F.lit(300))).alias("n")).coalesce(1)
    before = spark.conf.get("parquet.dictionary.page.size", None)
    try:
        long_dictionaries(spark)
        rows.write.parquet(str(tmp_path / "out"))
    finally:
        spark.conf.unset("parquet.dictionary.page.size") if before is None else spark.conf.set("parquet.dictionary.page.size", before)
    assert sum(f.stat().st_size for f in os.scandir(tmp_path / "out")) < 2 * 600 * 4000


@pytest.mark.parametrize("minimum", [1, 2, 3])
def test_convergence_pairs_only_rarer_topics(spark, small_strips, monkeypatch, minimum):
    rng = random.Random(3)
    topics = {i: {"general"} | {f"t{rng.randrange(12)}" for _ in range(rng.randrange(4))} for i in [*range(50), None]}
    said = [(n, "General" if n % 2 else "general", [f"T{(n + k) % 12}" for k in range(n % 3)]) for n in range(60)]
    inputs = spark.createDataFrame([(n, "x", "s", "completed", t, n % 20, None, None) for n, t, _ in said], schema.INPUTS)
    segments = spark.createDataFrame([(100 * n + k, n, k, "x", t, None) for n, _, ts in said for k, t in enumerate(ts)], schema.SEGMENTS)
    questions = spark.createDataFrame([(i, None if i == 3 else "s", None if i == 4 else f"f{i}", "q", 1, "Q?", None) for i in range(20)], schema.QUESTIONS)
    links = spark.createDataFrame([(i, t) for i, ts in topics.items() for t in ts], LINKS)
    seen = watched(monkeypatch, "join_in_strips")
    got = {(r["source"], r["form_key"], r["theme_id"]): r["topics"] for r in reports.theme_convergence(inputs, segments, questions, links, minimum).collect()}
    spoken = defaultdict(set)
    for n, t, ts in said:
        spoken[None if n % 20 == 3 else "s", None if n % 20 == 4 else f"f{n % 20}"] |= {x.lower() for x in (t, *ts)}
    expected = {(*form, i): len(ts & mine) for form, mine in spoken.items() for i, ts in topics.items()}
    assert got == {k: n for k, n in expected.items() if n >= minimum}
    if minimum > 1:  # the hot topic takes no part in the product
        assert seen[0][2] <= sum(expected.values()) - 20 * 51


def test_long_rows_after_short_ones_leave_the_writer(spark, tmp_path):
    """Inputs without themes and then inputs with long texts of them: the writer may not hold thousands of these before it looks."""
    catalog.QUERIES["inputs_with_themes"](spark, "/root/testdata/sf0.001")
    words = F.transform(F.sequence(F.lit(1), F.lit(1600)), lambda n: F.sha2(F.concat(F.col("id").cast("string"), F.lit("-"), n.cast("string")), 256))
    rows = spark.range(0, 6200, 1, 1).select(F.when(F.col("id") < 6000, "").otherwise(F.array_join(words, "")).alias("themes"))
    rows.write.option("parquet.block.size", 1 << 20).parquet(str(tmp_path / "out"))
    (file,) = (tmp_path / "out").glob("*.parquet")
    found = pq.ParquetFile(file).metadata
    assert found.num_rows == 6200
    assert max(found.row_group(n).total_byte_size for n in range(found.num_row_groups)) < 4 << 20
