"""Read models: inputs with their current themes, answers, chains, and listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.operators.intake import MAX_LIMIT, Scope
from themeloom.operators.ordered import first_rows, left_join_spread
from themeloom.operators.products import join_in_strips, join_one_in_strips
from themeloom.session import cut_lineage

THEME = "struct<id:bigint,name:string,description:string>"


def with_question(inputs: DataFrame, questions: DataFrame) -> DataFrame:
    """Every input with its question's columns, NULL for inputs without one."""
    dimension = questions.select(
        F.col("id").alias("question_id"), F.col("source").alias("question_source"),
        "form_key", "question_key", "question_version", "question_text",
    )
    return left_join_spread(inputs, dimension, "question_id", ["id"])


def in_scope(rows: DataFrame, scope: Scope) -> DataFrame:
    predicates = scope.predicates()
    return rows.where(reduce(lambda a, b: a & b, predicates)) if predicates else rows


def page(rows: DataFrame, scope: Scope) -> DataFrame:
    """One page in id order, or the whole table when the scope has no limit."""
    if scope.limit is None:
        return rows.orderBy("id").offset(scope.offset) if scope.offset else rows
    return rows.orderBy("id").offset(scope.offset).limit(scope.limit)


def input_topics(inputs: DataFrame, segments: DataFrame) -> DataFrame:
    """Distinct (input_id, topic) over an input and its segments."""
    own = inputs.where(F.col("topic").isNotNull()).select(F.col("id").alias("input_id"), "topic")
    pieces = segments.where(F.col("topic").isNotNull()).select(
        F.col("original_input_id").alias("input_id"), "topic"
    )
    return own.unionByName(pieces).distinct()


def topic_themes(themes: DataFrame, theme_topics: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct (topic_key, theme): the live theme behind every link of a topic."""
    live = themes.where(F.col("merged_into_id").isNull()).select(
        F.col("id").alias("root_id"), "name", "description"
    )
    pairs = (
        theme_topics.select("theme_id", F.lower("topic").alias("topic_key"))
        .join(roots, "theme_id")
        .select("topic_key", "root_id").distinct()
    )
    return pairs.join(live, "root_id").select(
        "topic_key",
        F.struct(F.col("root_id").alias("id"), "name", "description").alias("theme"),
    )


def main_topics(keyed: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct (input_id, topic_key) rows in two parts: of each input the topic with most links, and (input_id, main_key, topic_key) of the others.

    Topics without links drop out.  An input meets the links of its main topic in one step, so what it
    reaches through that needs no comparison with itself, only the few rows of the other topics do.
    """
    weights = links.groupBy("topic_key").agg(F.count(F.lit(1)).alias("_links"))
    own = Window.partitionBy("input_id").orderBy(F.desc("_links"), "topic_key")
    ranked = cut_lineage(
        keyed.join(weights, "topic_key")
        .withColumns({"main_key": F.first("topic_key").over(own), "_rank": F.row_number().over(own)})
        .select("input_id", "main_key", "topic_key", "_rank")
    )
    return ranked.where("_rank = 1").select("input_id", "topic_key"), ranked.where("_rank > 1").drop("_rank")


def beside_main(others: DataFrame, links: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct (input_id, main_key, ``columns``) that inputs reach by their other topics and not by the main one."""
    reached = others.join(links, "topic_key").select("input_id", "main_key", *columns).distinct()
    by_main = links.select(F.col("topic_key").alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns]
    return reached.join(by_main, reduce(lambda a, b: a & b, same, F.col("main_key") == F.col("_key")), "left_anti")


def input_theme_links(inputs: DataFrame, segments: DataFrame, linked: DataFrame) -> DataFrame:
    """Distinct (input_id, theme) rows, the exploded form of ``inputs_with_themes``.

    The pairs of inputs with the themes of their main topics are by far the most; they are distinct
    as they are made and are not shuffled.
    """
    keyed = input_topics(inputs, segments).select("input_id", F.lower("topic").alias("topic_key")).distinct()
    links = cut_lineage(linked.distinct())
    main, others = main_topics(keyed, links)
    return join_in_strips(main, links, "topic_key").select("input_id", "theme").unionByName(
        beside_main(others, links, ["theme"]).select("input_id", "theme")
    )


def by_name(themes: Column) -> Column:
    """Sort an array of theme structs by lower(name), then id."""
    keyed = F.transform(themes, lambda t: F.struct(F.lower(t["name"]).alias("k"), t["id"].alias("i"), t.alias("t")))
    return F.transform(F.array_sort(keyed), lambda e: e["t"])


def inputs_with_themes(
    inputs: DataFrame,
    segments: DataFrame,
    questions: DataFrame,
    themes: DataFrame,
    theme_topics: DataFrame,
    roots: DataFrame,
    scope: Scope,
) -> DataFrame:
    """Each input in scope with its question and its distinct current themes in name order.

    A page is cut and written before any theme is looked up, since filters and order only concern
    inputs; segments and links are then read for its ids and topics alone.  An input takes the themes
    of its main topic as one list, as long as its own result, in the last step; only the few themes
    that its other topics add are gathered by input.
    """
    rows = page(in_scope(with_question(inputs, questions), scope), scope)
    if scope.limit is not None:
        rows = cut_lineage(rows)
    spoken = inputs.where(F.col("topic").isNotNull()).select(
        F.col("id").alias("input_id"), F.lower("topic").alias("topic_key")
    ).unionByName(
        segments.where(F.col("topic").isNotNull()).select(
            F.col("original_input_id").alias("input_id"), F.lower("topic").alias("topic_key")
        )
    )
    links = theme_topics.select("theme_id", F.lower("topic").alias("topic_key"))
    if scope.limit is not None:
        ids = rows.select(F.col("id").alias("input_id"))
        if scope.limit <= MAX_LIMIT:  # at most one page of ids
            ids = F.broadcast(ids)
        spoken = cut_lineage(spoken.join(ids, "input_id", "left_semi"))
        links = links.join(spoken.select("topic_key").distinct(), "topic_key", "left_semi")
    live = themes.where(F.col("merged_into_id").isNull()).select(F.col("id").alias("root_id"), "name", "description")
    reached = cut_lineage(links.join(roots, "theme_id").select("topic_key", "root_id").distinct())
    theme = F.struct(F.col("root_id").alias("id"), "name", "description")
    main, others = main_topics(spoken.distinct(), reached)
    beside = beside_main(others, reached, ["root_id"]).join(live, "root_id").groupBy(F.col("input_id").alias("id")).agg(F.collect_list(theme).alias("_beside"))
    lists = cut_lineage(reached.join(live, "root_id").groupBy("topic_key").agg(by_name(F.collect_list(theme)).alias("_main"), F.count(F.lit(1)).alias("_size")))
    context = F.when(
        F.col("question_id").isNotNull(),
        F.struct("form_key", "question_key", "question_version", "question_text"),
    )
    keyed = rows.join(main.withColumnRenamed("input_id", "id"), "id", "left").join(beside, "id", "left")
    joined = join_one_in_strips(keyed, lists, "topic_key", "_size", "id", main).withColumn(
        "themes", F.when(F.col("_beside").isNull(), F.col("_main")).when(F.col("_main").isNull(), by_name(F.col("_beside")))
        .otherwise(by_name(F.concat("_main", "_beside")))
    )
    return joined.select(
        *inputs.columns,
        context.alias("question_context"),
        F.coalesce("themes", F.array().cast(f"array<{THEME}>")).alias("themes"),
    )


def answers(inputs: DataFrame, questions: DataFrame, scope: Scope) -> DataFrame:
    """Answers that belong to a question, filtered by any part of its identity or by submission."""
    dimension = questions.select(
        F.col("id").alias("question_id"), F.col("source").alias("question_source"),
        "form_key", "question_key", "question_version", "question_text",
    )
    joined = inputs.join(dimension, "question_id")
    return in_scope(joined, scope).select(
        F.col("question_source").alias("source"), "form_key", "question_key", "question_version",
        "question_text", F.col("id").alias("answer_id"), "submission_key", "original_text",
        "topic", "status",
    )


def answers_by_submission(inputs: DataFrame, questions: DataFrame, scope: Scope) -> DataFrame:
    return answers(inputs.where(F.col("submission_key").isNotNull()), questions, scope)


def answer_topic_theme_chain(
    inputs: DataFrame, segments: DataFrame, questions: DataFrame, linked: DataFrame
) -> DataFrame:
    """Form, question, submission, answer, topic, current theme; answers without a topic or theme stay.

    ``linked`` is ``linked_or_dead``: a topic linked to a theme without a live root keeps a row with
    a NULL theme.  Topics and links are distinct before the join, so the texts need no distinct.  Rows
    meet their themes last, so that only rows with one topic each are shuffled.
    """
    linked = cut_lineage(linked)
    known = linked.select("topic_key").distinct().withColumn("linked", F.lit(True))
    topics = cut_lineage(
        input_topics(inputs, segments).withColumn("topic_key", F.lower("topic")).join(known, "topic_key", "left")
        .select(F.col("input_id").alias("id"), F.col("topic").alias("answer_topic"), "topic_key", "linked")
    )
    chain = with_question(inputs, questions).join(topics, "id", "left").select(
        F.col("question_source").alias("source"), "form_key", "question_key", "question_version",
        "submission_key", F.col("id").alias("answer_id"), "original_text",
        F.col("answer_topic").alias("topic"), "topic_key", "linked",
    )
    found = join_in_strips(chain.where("linked").drop("linked"), linked, "topic_key", topics.where("linked"), wide=True)
    alone = chain.where("linked IS NULL").withColumn("theme", F.lit(None).cast(THEME))
    return found.unionByName(alone.drop("linked")).drop("topic_key").select(
        "*", F.col("theme.id").alias("theme_id"), F.col("theme.name").alias("theme_name")
    ).drop("theme")


def linked_or_dead(themes: DataFrame, theme_topics: DataFrame, roots: DataFrame) -> DataFrame:
    """``topic_themes`` plus a NULL theme for every topic linked to a theme without live root."""
    dead = (
        theme_topics.select("theme_id", F.lower("topic").alias("topic_key"))
        .join(roots, "theme_id", "left_anti").select("topic_key").distinct()
    )
    linked = topic_themes(themes, theme_topics, roots)
    return linked.unionByName(dead.withColumn("theme", F.lit(None).cast(THEME)))


def embedding_owners(segments: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Embeddings with the input they belong to, directly or through a segment.

    The OR condition becomes two equi-joins; the two kinds of embedding never overlap.
    """
    own = embeddings.where(F.col("original_input_id").isNotNull()).select(
        F.col("original_input_id").alias("input_id"), F.col("id").alias("embedding_id"),
        "embedding_representation",
    )
    parents = segments.select(F.col("id").alias("segment_input_id"), F.col("original_input_id").alias("input_id"))
    pieces = (
        embeddings.where(F.col("segment_input_id").isNotNull())
        .select("segment_input_id", F.col("id").alias("embedding_id"), "embedding_representation")
        .join(parents, "segment_input_id")
        .select("input_id", "embedding_id", "embedding_representation")
    )
    return own.unionByName(pieces)


def input_results(
    inputs: DataFrame, questions: DataFrame, segments: DataFrame, embeddings: DataFrame
) -> DataFrame:
    """Per input: segments, embeddings and the representations used.

    Each child is counted on its own before the join, so nothing fans out.
    """
    pieces = segments.groupBy(F.col("original_input_id").alias("id")).agg(
        F.countDistinct("id").alias("segments")
    )
    vectors = embedding_owners(segments, embeddings).groupBy(F.col("input_id").alias("id")).agg(
        F.countDistinct("embedding_id").alias("embeddings"),
        F.array_sort(F.collect_set("embedding_representation")).alias("embedding_representations"),
    )
    return (
        with_question(inputs, questions)
        .join(pieces, "id", "left").join(vectors, "id", "left")
        .select(
            "id", "form_key", "question_key", "submission_key", "status", "topic",
            F.coalesce("segments", F.lit(0)).cast("long").alias("segments"),
            F.coalesce("embeddings", F.lit(0)).cast("long").alias("embeddings"),
            "embedding_representations", "original_text",
        )
    )


def segments_report(inputs: DataFrame, questions: DataFrame, segments: DataFrame) -> DataFrame:
    parents = with_question(inputs, questions).select(
        F.col("id").alias("original_input_id"), "form_key", "question_key", "source"
    )
    return segments.join(parents, "original_input_id").select(
        "original_input_id", "source", "form_key", "question_key", "segment_order", "topic", "segment_text"
    )


def jobs_report(inputs: DataFrame, jobs: DataFrame) -> DataFrame:
    parents = inputs.select(F.col("id").alias("original_input_id"), "source")
    return jobs.join(parents, "original_input_id").select(
        "original_input_id", "source", "id", "job_type", "status", "attempts", "last_error"
    )


def failed_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status") == "failed").select(
        "id", "job_type", "original_input_id", "attempts", "last_error"
    )


def suggestion_status(suggestions: DataFrame) -> DataFrame:
    state = F.when(F.col("materialized_at").isNull(), "pending").otherwise("materialized")
    return suggestions.select(
        "id", "action", "proposed_name", "materialized_theme_id", "materialized_at",
        state.alias("materialization_status"),
    )


def evidence_inputs(evidence: DataFrame, segments: DataFrame) -> DataFrame:
    """(suggestion_id, input_id): the input behind each evidence row, directly or through a segment."""
    parents = segments.select(
        F.col("id").alias("segment_input_id"), F.col("original_input_id").alias("_parent")
    )
    return left_join_spread(evidence, parents, "segment_input_id", ["suggestion_id", "original_input_id"]).select(
        "suggestion_id", F.coalesce("original_input_id", "_parent").alias("input_id")
    )


def suggestions_by_source(
    suggestions: DataFrame, evidence: DataFrame, segments: DataFrame, inputs: DataFrame, source: str | None = None
) -> DataFrame:
    """Suggestions with evidence from a source; without one, (suggestion, source) for every source."""
    origin = evidence_inputs(evidence, segments).join(
        inputs.select(F.col("id").alias("input_id"), "source"), "input_id"
    ).select(F.col("suggestion_id").alias("id"), "source")
    listed = suggestion_status(suggestions)
    if source is not None:
        return listed.join(origin.where(F.col("source") == source), "id", "left_semi")
    return listed.join(origin.distinct(), "id")


def theme_convergence(
    inputs: DataFrame, segments: DataFrame, questions: DataFrame, theme_topics: DataFrame, minimum: int = 2
) -> DataFrame:
    """(source, form_key, theme_id, topics): themes that gather several topics within one form.

    A theme with ``minimum`` topics in a form has one there that is not among its ``minimum`` - 1
    commonest, so only forms of such rarer topics are paired with the theme; its commonest topics are
    then looked up in those forms.  A topic of all forms and many themes is never paired with them.
    """
    forms = questions.select(F.col("id").alias("question_id"), F.col("source").alias("question_source"), "form_key")
    asked = inputs.select(F.col("id").alias("input_id"), "question_id").join(forms, "question_id")
    spoken = cut_lineage(
        input_topics(inputs, segments).join(asked, "input_id")
        .select(F.col("question_source").alias("source"), "form_key", F.lower("topic").alias("topic_key")).distinct()
    )
    forms_of = spoken.groupBy("topic_key").agg(F.count(F.lit(1)).alias("forms"))
    links = cut_lineage(theme_topics.select("theme_id", F.lower("topic").alias("topic_key")).distinct().join(forms_of, "topic_key"))
    common = cut_lineage(first_rows(links, ["theme_id"], [F.desc("forms"), "topic_key"], minimum - 1).select("theme_id", "topic_key"))
    taken = common.select(F.col("theme_id").alias("_theme"), F.col("topic_key").alias("_key"))
    of_theme = F.col("theme_id").eqNullSafe(F.col("_theme"))
    rare = links.join(taken, of_theme & (F.col("topic_key") == F.col("_key")), "left_anti")
    group = ["source", "form_key", "theme_id"]
    paired = cut_lineage(join_in_strips(spoken, rare.drop("forms"), "topic_key").groupBy(*group).agg(F.count(F.lit(1)).alias("n")))
    there = spoken.select(F.col("source").alias("_source"), F.col("form_key").alias("_form"), F.col("topic_key").alias("_topic"))
    in_form = F.col("source").eqNullSafe(F.col("_source")) & F.col("form_key").eqNullSafe(F.col("_form")) & (F.col("_key") == F.col("_topic"))
    also = paired.join(taken, of_theme).join(there, in_form, "left_semi").select(*group, F.lit(1).cast("long").alias("n"))
    return (
        paired.unionByName(also).groupBy(*group).agg(F.sum("n").alias("topics"))
        .where(F.col("topics") >= minimum)
    )


def question_versions(inputs: DataFrame, questions: DataFrame) -> DataFrame:
    """Per question key: its versions, and the questions that were actually answered."""
    answered = inputs.where(F.col("question_id").isNotNull()).groupBy("question_id").agg(
        F.count(F.lit(1)).alias("_answers")
    )
    return (
        questions.join(answered.withColumnRenamed("question_id", "id"), "id", "left")
        .groupBy("source", "form_key", "question_key")
        .agg(
            F.countDistinct("question_version").alias("versions"),
            F.countDistinct(F.when(F.col("_answers").isNotNull(), F.col("id"))).alias("answered_questions"),
            F.coalesce(F.sum("_answers"), F.lit(0)).cast("long").alias("answers"),
        )
    )
