"""Constraint counts, outcome checks, and the one-off backfills of older data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.operators.jobs import next_job
from themeloom.operators.ordered import positions
from themeloom.sources import schema


def _blank(name: str) -> Column:
    """The stored rule trims spaces only and treats NULL as missing."""
    return F.col(name).isNull() | (F.trim(F.col(name)) == "")


def _bad_optional(name: str, longest: int | None = None) -> Column:
    bad = F.trim(F.col(name)) == ""
    if longest is not None:
        bad = bad | (F.char_length(name) > longest)
    return F.col(name).isNotNull() & bad


def _both_or_none(left: str, right: str) -> Column:
    """Exactly one of the two is set."""
    return F.col(left).isNull() != F.col(right).isNull()


def row_rules() -> dict[str, dict[str, Column]]:
    """table -> rule -> condition a row breaks it by."""
    return {
        "questions": {
            "source_nonempty": _blank("source"),
            "form_key_nonempty": _blank("form_key"),
            "question_key_nonempty": _blank("question_key"),
            "text_nonempty": _blank("question_text"),
            "version_positive": F.col("question_version").isNull() | (F.col("question_version") < 1),
        },
        "inputs": {
            "text_nonempty": _blank("original_text"),
            "source_nonempty": _blank("source"),
            "status_valid": ~F.coalesce(F.col("status").isin(*schema.STATUSES), F.lit(False)),
            "topic_valid": _bad_optional("topic", schema.MAX_NAME),
            "submission_key_nonempty": _bad_optional("submission_key"),
            "completed_has_topic": (F.col("status") == "completed") & F.col("topic").isNull(),
        },
        "segments": {
            "order_nonnegative": F.col("segment_order").isNull() | (F.col("segment_order") < 0),
            "text_nonempty": _blank("segment_text"),
            "topic_valid": _bad_optional("topic", schema.MAX_NAME),
        },
        "embeddings": {
            "one_target": ~_both_or_none("original_input_id", "segment_input_id"),
            "model_nonempty": _blank("embedding_model"),
            "representation_nonempty": _blank("embedding_representation"),
        },
        "themes": {
            "name_valid": _blank("name") | (F.char_length("name") > schema.MAX_NAME),
            "description_length": F.coalesce(F.char_length("description") > schema.MAX_TEXT, F.lit(False)),
            "not_self_merged": F.coalesce(F.col("merged_into_id") == F.col("id"), F.lit(False)),
        },
        "theme_topics": {
            "topic_valid": _blank("topic") | (F.char_length("topic") > schema.MAX_NAME),
        },
        "suggestions": {
            "action_valid": ~F.coalesce(F.col("action").isin(*schema.ACTIONS), F.lit(False)),
            "name_valid": _blank("proposed_name") | (F.char_length("proposed_name") > schema.MAX_NAME),
            "description_valid": _blank("proposed_description")
            | (F.char_length("proposed_description") > schema.MAX_TEXT),
            "rationale_valid": _blank("rationale") | (F.char_length("rationale") > schema.MAX_TEXT),
            "fingerprint_valid": ~F.coalesce(F.col("group_fingerprint").rlike("^[0-9a-f]{64}$"), F.lit(False)),
            "materialization_consistent": _both_or_none("materialized_theme_id", "materialized_at"),
        },
        "suggestion_topics": {
            "topic_valid": _blank("topic") | (F.char_length("topic") > schema.MAX_NAME),
        },
        "evidence": {
            "one_target": ~_both_or_none("original_input_id", "segment_input_id"),
        },
        "jobs": {
            "type_valid": ~F.coalesce(F.col("job_type").isin(*schema.JOB_TYPES), F.lit(False)),
            "status_valid": ~F.coalesce(F.col("status").isin(*schema.JOB_STATUSES), F.lit(False)),
            "attempts_nonnegative": F.col("attempts").isNull() | (F.col("attempts") < 0),
            "lock_consistent": (F.col("status") == "processing")
            != (F.col("locked_at").isNotNull() & F.col("locked_by").isNotNull()),
        },
    }


# table -> rule -> unique columns; ``lower:`` compares case-insensitively.
UNIQUE: dict[str, dict[str, Sequence[str]]] = {
    "questions": {"id_unique": ["id"], "identity_unique": ["source", "form_key", "question_key", "question_version"]},
    "inputs": {"id_unique": ["id"]},
    "segments": {"id_unique": ["id"], "position_unique": ["original_input_id", "segment_order"]},
    "embeddings": {"id_unique": ["id"], "original_unique": ["original_input_id"], "segment_unique": ["segment_input_id"]},
    "themes": {"id_unique": ["id"], "name_unique": ["lower:name"]},
    "theme_topics": {"link_unique": ["theme_id", "lower:topic"]},
    "suggestions": {"id_unique": ["id"], "fingerprint_unique": ["group_fingerprint"]},
    "suggestion_themes": {"link_unique": ["suggestion_id", "theme_id"]},
    "suggestion_topics": {"link_unique": ["suggestion_id", "lower:topic"]},
    "evidence": {
        "original_unique": ["suggestion_id", "original_input_id"],
        "segment_unique": ["suggestion_id", "segment_input_id"],
    },
    "jobs": {"id_unique": ["id"], "input_stage_unique": ["job_type", "original_input_id"]},
}

# table -> column -> table it refers to.
REFERENCES: dict[str, dict[str, str]] = {
    "inputs": {"question_id": "questions"},
    "segments": {"original_input_id": "inputs"},
    "embeddings": {"original_input_id": "inputs", "segment_input_id": "segments"},
    "themes": {"merged_into_id": "themes"},
    "theme_topics": {"theme_id": "themes"},
    "suggestions": {"materialized_theme_id": "themes"},
    "suggestion_themes": {"suggestion_id": "suggestions", "theme_id": "themes"},
    "suggestion_topics": {"suggestion_id": "suggestions"},
    "evidence": {"suggestion_id": "suggestions", "original_input_id": "inputs", "segment_input_id": "segments"},
    "jobs": {"original_input_id": "inputs"},
}


def _key(column: str) -> Column:
    return F.lower(column[6:]) if column.startswith("lower:") else F.col(column)


def constraint_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, rule, violations) for every rule of the given tables.

    A table is read once for its row rules and its ids that must be there, once for its unique rules,
    and once for each table it refers to.  Unique rules count the rows beyond the first of a key; keys
    holding NULL are exempt.  References to one table, from wherever, share one anti-join on the ids.
    """
    parts: list[DataFrame] = []
    rules = row_rules()
    for table, df in tables.items():
        checks = dict(rules.get(table, {}))
        if "id_unique" in UNIQUE.get(table, {}):
            checks["id_present"] = F.col("id").isNull()
        if checks:
            sums = [F.coalesce(F.sum(F.when(bad, 1)), F.lit(0)).cast("long").alias(rule) for rule, bad in checks.items()]
            entries = F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(rule).alias("violations")) for rule in checks])
            parts.append(
                df.agg(*sums).select(F.lit(table).alias("table_name"), F.inline(entries))
            )
        unique = UNIQUE.get(table, {})
        if unique:
            keys = F.array(*[
                F.struct(F.lit(rule).alias("rule"), F.when(
                    reduce(and_, [F.col(column.removeprefix("lower:")).isNotNull() for column in columns]),
                    F.to_json(F.struct(*[_key(column).alias(f"k{i}") for i, column in enumerate(columns)])),
                ).alias("key")) for rule, columns in unique.items()
            ])
            extra = df.select(F.inline(keys)).where(F.col("key").isNotNull()).groupBy("rule", "key").agg((F.count(F.lit(1)) - 1).alias("extra"))
            parts.append(_listed(extra.groupBy("rule").agg(F.sum("extra").alias("violations")), [(table, rule) for rule in unique], table))
    for parent in tables:
        named, refs = [], []
        for table, columns in REFERENCES.items():
            own = [column for column, to in columns.items() if to == parent]
            if table in tables and own:
                named += [(table, f"{column}_exists") for column in own]
                refs.append(tables[table].select(F.inline(F.array(*[
                    F.struct(F.lit(f"{table}.{column}_exists").alias("rule"), F.col(column).cast("long").alias("ref")) for column in own
                ]))))
        if refs:
            ids = tables[parent].select(F.col("id").alias("ref"))
            orphans = reduce(DataFrame.unionByName, refs).where(F.col("ref").isNotNull()).join(ids, "ref", "left_anti")
            parts.append(_listed(orphans.groupBy("rule").agg(F.count(F.lit(1)).alias("violations")), named, None))
    return reduce(DataFrame.unionByName, parts)


def _listed(found: DataFrame, rules: list[tuple[str, str]], table: str | None) -> DataFrame:
    """The violations of every rule, 0 where none was found; without ``table`` rules are named table.rule."""
    name = lambda t, rule: rule if table else f"{t}.{rule}"
    counts = F.map_from_entries(F.collect_list(F.struct("rule", "violations")))  # one entry a rule
    entries = F.array(*[
        F.struct(F.lit(t).alias("table_name"), F.lit(rule).alias("rule"),
                 F.coalesce(F.try_element_at("_c", F.lit(name(t, rule))), F.lit(0)).cast("long").alias("violations"))
        for t, rule in rules
    ])
    return found.agg(counts.alias("_c")).select(F.inline(entries))


def immutable_report(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(rule, violations): rows of ``before`` that are gone from ``after``, and those changed, column by column."""
    new = after.select(F.col(key), F.lit(True).alias("_there"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    both = before.select(key, *columns).join(new, key, "left")
    kept = F.col("_there").isNotNull()
    counts = [F.count(F.when(~kept, 1)).alias("kept")]
    counts += [F.count(F.when(kept & ~F.col(c).eqNullSafe(F.col(f"_new_{c}")), 1)).alias(f"{c}_unchanged") for c in columns]
    names = ["kept", *[f"{c}_unchanged" for c in columns]]
    entries = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("violations")) for name in names])
    return both.agg(*counts).select(F.inline(entries))


def outcome_checks(
    inputs: DataFrame, embeddings: DataFrame, conflicts: DataFrame | None = None
) -> DataFrame:
    """(check_name, bad_rows) over finished data: 0 everywhere means the run ended well."""
    unfinished = inputs.agg(
        F.lit("terminal_status").alias("check_name"),
        F.count(F.when(~F.col("status").isin("completed", "ineligible"), 1)).alias("bad_rows"),
    )
    contexts = inputs.select(F.col("id").alias("original_input_id"), "question_id")
    own = embeddings.where(F.col("original_input_id").isNotNull()).join(contexts, "original_input_id")
    tag = F.col("embedding_representation")
    entries = F.array(
        F.struct(F.lit("contextual_representation").alias("check_name"), F.col("a").alias("bad_rows")),
        F.struct(F.lit("generic_representation").alias("check_name"), F.col("b").alias("bad_rows")),
    )
    tags = own.agg(
        F.count(F.when(F.col("question_id").isNotNull() & (tag != "question-answer"), 1)).alias("a"),
        F.count(F.when(F.col("question_id").isNull() & (tag != "answer-only"), 1)).alias("b"),
    ).select(F.inline(entries))
    checks = unfinished.unionByName(tags)
    if conflicts is not None:
        leaked = conflicts.select("record_id").join(inputs.select(F.col("id").alias("record_id")), "record_id", "left_semi")
        checks = checks.unionByName(leaked.agg(
            F.lit("conflict_created_no_input").alias("check_name"), F.count(F.lit(1)).alias("bad_rows")
        ))
    return checks


def backfill_themes(tagged: DataFrame, themes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New themes (id, name) and links (theme_id, topic) from legacy (theme, topic) tags.

    Names are trimmed and compared case-insensitively; the lowest spelling in binary order stands.
    """
    name, topic = F.trim("theme"), F.trim("topic")
    named = tagged.where(F.col("theme").isNotNull() & (name != ""))
    spellings = named.groupBy(F.lower(name).alias("name_key")).agg(F.min(name).alias("name"))
    stored = themes.select(F.lower("name").alias("name_key"))
    fresh = positions(spellings.join(stored, "name_key", "left_anti"), [], ["name_key"], "_n")
    highest = themes.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long")).scalar()
    created = fresh.select((F.col("_n") + highest).alias("id"), "name")
    known = themes.select("id", "name").unionByName(created).select(
        F.col("id").alias("theme_id"), F.lower("name").alias("name_key")
    )
    pairs = named.where(F.col("topic").isNotNull() & (topic != "")).select(
        F.lower(name).alias("name_key"), topic.alias("topic")
    ).distinct()
    links = pairs.join(known, "name_key").groupBy("theme_id", F.lower("topic").alias("_k")).agg(
        F.min("topic").alias("topic")
    ).select("theme_id", "topic")
    return created, links


def blank_to_null(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.when(F.trim(F.col(column)) != "", F.col(column)))


def fill_default(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(value)))


def eligible_to_status(eligible: Column) -> Column:
    """The status a legacy ``eligible`` flag stands for; an unset flag is still new."""
    return F.when(eligible, "ready_for_embedding").otherwise("new")


def jobs_from_status(inputs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs to add so that every input with a next stage has one; existing jobs stay."""
    due = inputs.select(next_job(F.col("status")).alias("job_type"), F.col("id").alias("original_input_id"))
    missing = due.where(F.col("job_type").isNotNull()).join(
        jobs.select("job_type", "original_input_id"), ["job_type", "original_input_id"], "left_anti"
    )
    return missing.distinct()
