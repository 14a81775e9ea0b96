"""Analysis units, topic clusters over their complete membership, and evidence samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions.text import casefold, low_information
from themeloom.operators.ordered import first_rows, left_join_spread, positions

MEMBER = ["entity_type", "entity_id"]


def analysis_units(inputs: DataFrame, segments: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """Topic-bearing originals and segments of completed inputs.

    An input with segments counts as itself and as each segment.  Pass ``questions`` only where
    the wording is needed; the join is left out otherwise.
    """
    done = inputs.where(F.col("status") == "completed")
    parents = done.select(F.col("id").alias("original_input_id"), "question_id")
    pieces = (
        segments.where(F.col("topic").isNotNull())
        .join(parents, "original_input_id")
        .select(
            F.lit("segment").alias("entity_type"), F.col("id").alias("entity_id"),
            "original_input_id", F.col("segment_text").alias("text"), "topic", "question_id",
        )
    )
    originals = done.where(F.col("topic").isNotNull()).select(
        F.lit("original").alias("entity_type"), F.col("id").alias("entity_id"),
        F.col("id").alias("original_input_id"), F.col("original_text").alias("text"),
        "topic", "question_id",
    )
    units = pieces.unionByName(originals).withColumn("topic_key", casefold(F.col("topic")))
    if questions is None:
        return units
    wording = questions.select(F.col("id").alias("question_id"), "question_text")
    return left_join_spread(units, wording, "question_id", MEMBER)


def first_member(df: DataFrame, *keys: str | Column, **aggregates: Column) -> DataFrame:
    """The lowest member per key as (entity_type, entity_id), with further aggregates.

    Two numeric minima instead of the minimum of a struct: fixed-width buffers keep this a hash
    aggregation, where a struct or string buffer would sort every row first.
    """
    kind, number = F.col("entity_type"), F.col("entity_id")
    grouped = df.groupBy(*keys).agg(
        F.min(F.when(kind == "original", number)).alias("_original"),
        F.min(F.when(kind == "segment", number)).alias("_segment"),
        *[expr.alias(name) for name, expr in aggregates.items()],
    )
    return grouped.withColumns({
        "entity_type": F.when(F.col("_original").isNotNull(), "original").otherwise("segment"),
        "entity_id": F.coalesce("_original", "_segment"),
    }).drop("_original", "_segment")


def spellings(units: DataFrame) -> DataFrame:
    """What ``clusters_of`` needs of units, one row per topic, spelling and question; rows of several sets of units add up."""
    judged = units.select(
        "topic_key", "topic", "question_id", *MEMBER,
        F.when(low_information(F.col("text")), 0).otherwise(1).alias("_rich"),
    )
    kind, number = F.col("entity_type"), F.col("entity_id")
    return judged.groupBy("topic_key", "topic", "question_id").agg(
        F.min(F.when(kind == "original", number)).alias("original"),
        F.min(F.when(kind == "segment", number)).alias("segment"),
        F.count(F.lit(1)).alias("members"), F.sum("_rich").alias("richness"),
    )


def add_spellings(parts: DataFrame) -> DataFrame:
    """``spellings`` of several disjoint sets of units as those of all of them."""
    return parts.groupBy("topic_key", "topic", "question_id").agg(
        F.min("original").alias("original"), F.min("segment").alias("segment"),
        F.sum("members").alias("members"), F.sum("richness").alias("richness"),
    )


def clusters_of(spelled: DataFrame) -> DataFrame:
    """One row per topic from its spellings, as ``topic_clusters`` returns it."""
    kind = F.when(F.col("original").isNotNull(), "original").otherwise("segment")
    first_seen = F.struct(F.lower("topic"), kind, F.coalesce("original", "segment"), "topic")
    return spelled.groupBy("topic_key").agg(
        F.min_by("topic", first_seen).alias("topic_name"),
        F.sum("members").alias("member_count"),
        F.sum("richness").alias("rich_member_count"),
        F.countDistinct("question_id").alias("distinct_question_count"),
    )


def topic_clusters(units: DataFrame) -> DataFrame:
    """One row per topic: display name, member count, rich members, distinct questions.

    Only aggregates are kept per topic, so a topic holding a third of all units is reduced
    map-side; the members stay exploded in ``units``.  Texts are judged before the aggregation and
    go no further.
    """
    return clusters_of(spellings(units))


def eligible(clusters: DataFrame, min_rich: int = 2, min_questions: int = 3) -> DataFrame:
    """Enough rich members, or none at all but enough distinct questions."""
    if min_rich < 1 or min_questions < 1:
        raise ValueError("thresholds start at 1")
    rich = F.col("rich_member_count")
    return clusters.where(
        (rich >= min_rich) | ((rich == 0) & (F.col("distinct_question_count") >= min_questions))
    )


def distinct_questions(units: DataFrame) -> DataFrame:
    """(topic_key, pos, question_text): wordings in the order members first bring them up."""
    asked = units.where(F.col("question_id").isNotNull() & F.col("question_text").isNotNull())
    firsts = first_member(asked, "topic_key", "question_text")
    return positions(firsts, ["topic_key"], [*MEMBER, "question_text"], "pos", start=0).select(
        "topic_key", "pos", "question_text"
    )


IDS_PER_DIGEST = 10_000
"""Part of the definition of a fingerprint: ids hashed as one range, and ranges hashed as one block."""


def cluster_fingerprints(units: DataFrame) -> DataFrame:
    """(topic_key, fingerprint): a digest of the topic and its complete membership.

    One definition for every size.  Members are hashed in ranges of IDS_PER_DIGEST ids of a type, the
    ranges in blocks of as many, and the fingerprint is the SHA-256 of the folded topic and the
    blocks.  Ranges are cut by id, never by count, so equal members give equal fingerprints, and no
    task holds more of a topic than one range, one block, or one line for 10^8 ids.
    """
    return topic_digests(block_digests(range_digests(units)))


def range_digests(members: DataFrame) -> DataFrame:
    """(topic_key, entity_type, range, digest) of the members of each range."""
    ranged = members.select("topic_key", *MEMBER, F.expr(f"entity_id div {IDS_PER_DIGEST}").alias("range"))
    return _digests(ranged, ["topic_key", "entity_type", "range"], "entity_id", F.concat(F.lit("|"), F.col("entity_id").cast("string")))


def block_digests(ranges: DataFrame) -> DataFrame:
    """(topic_key, entity_type, block, digest) of the ranges of each block."""
    line = F.concat(F.lit("|"), F.col("range").cast("string"), F.lit(":"), F.col("digest"))
    blocked = ranges.withColumn("block", F.expr(f"range div {IDS_PER_DIGEST}"))
    return _digests(blocked, ["topic_key", "entity_type", "block"], "range", line)


def topic_digests(blocks: DataFrame) -> DataFrame:
    """(topic_key, fingerprint) of the blocks of each topic."""
    line = F.concat(F.lit("|"), F.col("entity_type"), F.lit(":"), F.col("block").cast("string"), F.lit(":"), F.col("digest"))
    lines = F.array_sort(F.collect_list(F.struct("entity_type", "block", line.alias("line"))))
    whole = F.array_join(F.transform(lines, lambda x: x["line"]), "")
    return blocks.groupBy("topic_key").agg(F.sha2(F.concat("topic_key", whole), 256).alias("fingerprint"))


def _digests(df: DataFrame, key: list[str], order: str, line: Column) -> DataFrame:
    """SHA-256 of the lines of each key in order, as ``digest``."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    return df.groupBy(*key).agg(F.sha2(F.array_join(F.transform(lines, lambda x: x["line"]), ""), 256).alias("digest"))


def sample_evidence(units: DataFrame, limit: int = 5) -> DataFrame:
    """(topic_key, pos, text): first the first member of each distinct question, then the rest.

    At most ``limit`` members come from the first pass, so the first ``2 * limit`` members of a
    topic always hold enough to fill up: neither branch ranks a whole topic.  Members are chosen by
    id alone; only the chosen few fetch their texts.
    """
    if limit < 1:
        raise ValueError("limit starts at 1")
    ids = units.select("topic_key", "question_id", *MEMBER)
    openers = first_member(ids.where(F.col("question_id").isNotNull()), "topic_key", "question_id")
    opening = first_rows(openers, ["topic_key"], MEMBER, limit)
    others = first_rows(ids, ["topic_key"], MEMBER, 2 * limit)
    # A member of both passes keeps the first.
    chosen = (
        opening.select("topic_key", *MEMBER, F.lit(0).alias("_pass"))
        .unionByName(others.select("topic_key", *MEMBER, F.lit(1).alias("_pass")))
        .groupBy("topic_key", *MEMBER).agg(F.min("_pass").alias("_pass"))
    )
    ranked = first_rows(chosen, ["topic_key"], ["_pass", *MEMBER], limit)
    places = ranked.select(*MEMBER, F.col("topic_key").alias("_key"), F.col("rank").alias("pos"))
    texts = units.select(*MEMBER, "text")
    return texts.join(places, MEMBER).select(F.col("_key").alias("topic_key"), "pos", "text")
