"""Theme graph: live roots of merge pointers, alias compression, merge components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.session import cut_lineage


HOPS = 3  # pointers followed per written round: each round multiplies the distance by HOPS + 1


def _advance(aliases: DataFrame) -> DataFrame:
    """Move every open pointer along HOPS known ones; a pointer to a missing id drops out."""
    known = aliases.select(
        F.col("theme_id").alias("target"),
        F.col("target").alias("next_target"),
        F.col("root_id").alias("next_root"),
    )
    moving = aliases.where(F.col("root_id").isNull())
    for _ in range(HOPS):
        # A pointer that has arrived has no target any more and matches nothing.
        moving = moving.join(known, "target", "left").select(
            "theme_id",
            F.when(F.col("next_root").isNull(), F.col("next_target")).alias("target"),
            F.coalesce("root_id", "next_root").alias("root_id"),
        )
    alive = moving.where(F.col("root_id").isNotNull() | F.col("target").isNotNull())
    return aliases.where(F.col("root_id").isNotNull()).unionByName(alive)


def resolve_roots(themes: DataFrame) -> DataFrame:
    """(theme_id, root_id) for every theme whose merge pointers lead to a live theme.

    Pointer jumping: the distance covered grows by a constant factor each round, so depth d takes
    about log4(d) rounds.  Ids on a cycle, or behind a missing parent, never reach a root and are
    left out.  Distances to a root are contiguous, so a round that settles nothing settles nothing
    ever after.
    """
    roots = themes.where(F.col("merged_into_id").isNull()).select(
        F.col("id").alias("theme_id"), F.col("id").alias("root_id")
    )
    pointers = themes.where(F.col("merged_into_id").isNotNull()).select(
        F.col("id").alias("theme_id"), F.col("merged_into_id").alias("target")
    )
    aliases = cut_lineage(
        pointers.join(roots.withColumnRenamed("theme_id", "target"), "target", "left")
        .select("theme_id", "target", "root_id")
    )
    settled = -1
    while True:
        counts = aliases.agg(
            F.count("root_id").alias("settled"), F.count(F.lit(1)).alias("total")
        ).first()
        if counts["settled"] == counts["total"] or counts["settled"] == settled:
            break
        settled = counts["settled"]
        aliases = cut_lineage(_advance(aliases))
    found = aliases.where(F.col("root_id").isNotNull()).select("theme_id", "root_id")
    return roots.unionByName(found)


def unresolved_ids(requested: DataFrame, roots: DataFrame) -> DataFrame:
    """Requested theme ids that lead to no live theme."""
    return requested.select("theme_id").distinct().join(roots, "theme_id", "left_anti")


def compress_aliases(themes: DataFrame, roots: DataFrame) -> DataFrame:
    """Every alias points straight at its live root; unresolvable aliases keep their pointer."""
    target = roots.select(F.col("theme_id").alias("id"), "root_id")
    direct = F.when(F.col("root_id") != F.col("id"), F.col("root_id"))
    return (
        themes.join(target, "id", "left")
        .withColumn("merged_into_id", F.when(F.col("root_id").isNull(), F.col("merged_into_id")).otherwise(direct))
        .select(*themes.columns)
    )


def merge_components(edges: DataFrame) -> DataFrame:
    """(node, component) with component the lowest node id reachable over edges (a, b).

    Alternates large-star and small-star steps; each only needs the minimum neighbour of a node,
    so a hub aggregates map-side and no neighbour list is ever built.
    """
    pairs = edges.select(F.col("a").cast("long"), F.col("b").cast("long"))
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    links = cut_lineage(
        pairs.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    state = None
    while True:
        # Large star: every larger neighbour of u is tied to the least node around u.
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where(F.col("v") > F.col("u")).join(lowest, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        # Small star: u and its smaller neighbours are tied to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u")
        small = (
            tied.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .where(F.col("u") != F.col("v")).distinct()
        )
        links = cut_lineage(small)
        seen = links.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    found = links.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return nodes.join(found, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
