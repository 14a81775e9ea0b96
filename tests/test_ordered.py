"""The distributed scan against plain Python, with one group holding most rows."""

import random

from pyspark.sql import functions as F

from themeloom.operators import ordered


def rows(seed, n):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.6 else f"g{rng.randrange(9)}", i * 3, rng.randrange(-5, 9)) for i in range(n)]


def test_scan_sums_maxima_and_previous_values(spark):
    data = rows(1, 800)
    df = spark.createDataFrame(data, "g string, t long, v long").repartition(5)
    got = ordered.scan(
        df, ["g"], ["t"], sums={"total": F.col("v")}, maxes={"top": F.col("v")}, previous={"before": "v"}
    ).collect()
    state, expected = {}, {}
    for g, t, v in sorted(data, key=lambda r: r[1]):
        total, top, before = state.get(g, (0, None, None))
        total, top = total + v, v if top is None else max(top, v)
        expected[(g, t)] = (total, top, before)
        state[g] = (total, top, v)
    assert {(r["g"], r["t"]): (r["total"], r["top"], r["before"]) for r in got} == expected
    assert len(got) == len(data)


def test_positions_number_groups_and_whole_tables(spark):
    data = rows(2, 500)
    df = spark.createDataFrame(data, "g string, t long, v long").repartition(7)
    whole = ordered.positions(df, [], ["t"], "n").collect()
    assert sorted((r["t"], r["n"]) for r in whole) == [(t, i + 1) for i, t in enumerate(sorted(r[1] for r in data))]
    grouped = ordered.positions(df, ["g"], ["t"], "n", start=0).collect()
    for g in {r[0] for r in data}:
        mine = sorted((r["t"], r["n"]) for r in grouped if r["g"] == g)
        assert [n for _, n in mine] == list(range(len(mine)))


def test_positions_of_an_empty_table(spark):
    assert ordered.positions(spark.createDataFrame([], "t long"), [], ["t"], "n").collect() == []


def test_a_hot_group_spreads_over_partitions(spark):
    df = spark.range(4000).select(F.lit("hot").alias("g"), F.col("id").alias("t"))
    ranged = df.repartitionByRange(4, "g", "t").withColumn("p", F.spark_partition_id())
    assert ranged.select("p").distinct().count() == 4


def test_first_and_last_per_key(spark):
    data = rows(3, 300)
    df = spark.createDataFrame(data, "g string, t long, v long")
    firsts = {r["g"]: r["t"] for r in ordered.first_per_key(df, ["g"], [F.col("t")]).collect()}
    lasts = {r["g"]: r["t"] for r in ordered.last_per_key(df, ["g"], [F.col("t")]).collect()}
    for g in {r[0] for r in data}:
        times = [r[1] for r in data if r[0] == g]
        assert (firsts[g], lasts[g]) == (min(times), max(times))


def test_first_rows_beyond_the_window_limit(spark):
    data = rows(5, 6000)
    df = spark.createDataFrame(data, "g string, t long, v long")
    got = ordered.first_rows(df, ["g"], [F.desc("v"), F.col("t")], 1500).collect()
    for g in {r[0] for r in data}:
        mine = sorted((r for r in data if r[0] == g), key=lambda r: (-r[2], r[1]))[:1500]
        assert [(r["v"], r["t"]) for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["rank"])] == [(r[2], r[1]) for r in mine]
