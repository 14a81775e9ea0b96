"""Roots of merge pointers kept up by batches of new themes and merges.

``ends`` holds for each theme where its pointers end; ``members`` is the reverse index, from an end to the themes that lead to it.
A batch follows its own pointers from end to end and relabels what leads to an end that it moved: no other bucket is read or written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.operators.graph import resolve_roots
from themeloom.session import cut_lineage
from themeloom.sources import buckets as state

ENDS = "theme_id long, end long, live boolean"
MEMBERS = "end long, part int, theme_id long"
PARTS = 16
"""Parts that the members of an end are dealt to, so that a theme that takes in a third of all others is no single bucket."""


def read_roots(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """(theme_id, root_id) of every theme that leads to a live one, as ``resolve_roots`` gives them."""
    ends = state.read_buckets(spark, f"{folder}/ends", ENDS, before)
    return ends.where("live").select("theme_id", F.col("end").alias("root_id"))


def _part():
    return F.pmod(F.xxhash64("theme_id"), F.lit(PARTS)).cast("int").alias("part")


def update_roots(changes: DataFrame, folder: str, version: int, buckets: int = state.BUCKETS) -> DataFrame:
    """Write ``version`` of the roots below ``folder`` with ``changes`` (id, merged_into_id) in it; returns the rows that changed.

    A change is a new theme or the merge of a live one, several in a batch may chain. Merges are final: a row for a theme that is
    merged already changes nothing, nor does one without an id; of rows that repeat an id the smallest pointer counts. Themes that
    lead to an id that is not known yet have a root as soon as it arrives; those on or behind a cycle never have one (null end).
    """
    spark = changes.sparkSession
    arrived = cut_lineage(changes.where("id IS NOT NULL").groupBy("id").agg(F.min("merged_into_id").alias("target")))
    named = cut_lineage(arrived.select(F.col("id").alias("theme_id")).union(arrived.where("target IS NOT NULL").select("target")).distinct())
    looked = state.touched_buckets(named, ["theme_id"], buckets)
    known = cut_lineage(state.read_touched(spark, f"{folder}/ends", ENDS, looked, version).join(named, "theme_id", "left_semi"))

    merged = known.where("end IS NULL OR end <> theme_id").select(F.col("theme_id").alias("id"))
    there = known.where("end = theme_id").select(F.col("theme_id").alias("id"), F.lit(True).alias("there"))
    free = arrived.join(merged, "id", "left_anti").join(there, "id", "left").where("target IS NOT NULL OR there IS NULL").drop("there")
    free = cut_lineage(free)
    moved = free.where("target IS NOT NULL")

    # The pointers of the batch, from end to end; what else they name is an end that stays.
    of_target = known.select(F.col("theme_id").alias("target"), "end", F.lit(True).alias("seen"))
    pointers = cut_lineage(moved.join(of_target, "target", "left").select("id", F.when(F.col("seen"), F.col("end")).otherwise(F.col("target")).alias("merged_into_id")))
    pointers = pointers.where("merged_into_id IS NOT NULL")
    stay = pointers.select(F.col("merged_into_id").alias("id")).distinct().join(moved.select("id"), "id", "left_anti")
    led = resolve_roots(pointers.unionByName(stay.withColumn("merged_into_id", F.lit(None).cast("long"))))
    ended = moved.select("id").join(led.select(F.col("theme_id").alias("id"), F.col("root_id").alias("end")), "id", "left")
    ended = ended.unionByName(free.where("target IS NULL").select("id", F.col("id").alias("end")))
    alive = known.where("live").select("end").union(free.where("target IS NULL").select("id")).distinct()
    alive = alive.join(moved.select(F.col("id").alias("end")), "end", "left_anti").withColumn("alive", F.lit(True))
    settled = cut_lineage(ended.join(alive, "end", "left").select("id", "end", F.coalesce("alive", F.lit(False)).alias("live")))

    # All that led to an id of the batch now leads where that id does.
    old = settled.select(F.col("id").alias("end"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    sources = state.touched_buckets(old, ["end", "part"], buckets)
    leading = state.read_touched(spark, f"{folder}/members", MEMBERS, sources, version).select("theme_id", F.col("end").alias("id"))
    rows = leading.where("theme_id <> id").unionByName(settled.select(F.col("id").alias("theme_id"), "id")).join(settled, "id")
    changed = cut_lineage(rows.select("theme_id", F.col("id").alias("old"), "end", "live"))

    state.change_buckets(
        spark, f"{folder}/ends", ENDS, ["theme_id"], state.touched_buckets(changed, ["theme_id"], buckets), version,
        lambda held: held.join(changed, "theme_id", "left_anti").unionByName(changed.select(*held.columns)), buckets,
    )
    left = changed.select(F.col("old").alias("end"), _part(), "theme_id")
    joined = changed.where("end IS NOT NULL").select("end", _part(), "theme_id")
    places = state.touched_buckets(left.unionByName(joined), ["end", "part"], buckets)
    state.change_buckets(
        spark, f"{folder}/members", MEMBERS, ["end", "part"], places, version,
        lambda held: held.join(left, held.columns, "left_anti").unionByName(joined), buckets,
    )
    return changed.select("theme_id", F.when(F.col("live"), F.col("end")).alias("root_id"))
