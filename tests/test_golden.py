"""Small cases with known answers for text, intake, segments, clusters, topics, themes and jobs."""

import datetime
import hashlib
import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from themeloom import providers
from themeloom.functions import text as tx
from themeloom.functions import vectors as vec
from themeloom.operators import clusters, intake, jobs, organise, quality, reports, theme_state, themes, topics
from themeloom.operators import graph
from themeloom.operators import segments as seg
from themeloom.sources import schema

NOW = datetime.datetime(2024, 1, 1)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# ---- text and vectors

@pytest.mark.parametrize("text,low", [
    (" nO ", True), ("Colour", True), ("abcdefghijklmno", False), ("It rained for three days", False),
    (" UNSURE ", True), ("12345678901234", True), ("éééééééééééééé", True), ("ééééééééééééééé", False),
])
def test_low_information(spark, text, low):
    assert one(spark, tx.low_information(F.lit(text))) is low


def test_low_information_with_a_short_limit_still_knows_closed_answers(spark):
    assert one(spark, tx.low_information(F.lit("Maybe"), 2)) is True
    assert one(spark, tx.low_information(F.lit("Perhaps"), 2)) is False


@pytest.mark.parametrize("text", ["Straße", "ΣΊΣΥΦΟΣ", "ﬁne", "İstanbul", "plain ASCII", "ŉ ſ µ", "Ꭰꭰ"])
def test_casefold_equals_python(spark, text):
    rows = spark.createDataFrame([(text,)], "t string").select(tx.casefold(F.col("t")).alias("x")).first()
    assert rows["x"] == text.casefold()


def test_strip_equals_python(spark):
    text = "\t    a b \x1f　\n"
    assert one(spark, tx.strip(F.lit(text))) == text.strip()


def test_embedding_text(spark):
    question = F.lit("Where did the train stop?")
    assert one(spark, tx.embedding_input(F.lit("Halfway"), question)) == "Question: Where did the train stop?\nAnswer: Halfway"
    assert one(spark, tx.embedding_input(F.lit("Halfway"), F.lit(None).cast("string"))) == "Halfway"


@pytest.mark.parametrize("text,found", [('```json\n{"a": 1}\n```', '{"a": 1}'), ('["a"]', None), ("} {", None)])
def test_json_object(spark, text, found):
    assert one(spark, tx.json_object(F.lit(text))) == found


def test_vector_text_round_trip_and_distance(spark):
    df = spark.createDataFrame([([0.1, -2.5], [1.0, 0.0])], "a array<double>, b array<double>")
    row = df.select(vec.from_text(vec.to_text(F.col("a"))).alias("a"), vec.cosine_distance(F.col("a"), F.col("b")).alias("d")).first()
    assert row["a"] == [0.1, -2.5]
    assert row["d"] == pytest.approx(1 - 0.1 / (0.01 + 6.25) ** 0.5)
    zero = spark.createDataFrame([([0.0], [1.0])], "a array<double>, b array<double>")
    assert zero.select(vec.cosine_distance(F.col("a"), F.col("b")).alias("d")).first()["d"] is None


# ---- intake

def raw(spark, *records):
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(records, 1)], f"record_id long, {schema.RAW_INPUT}")


CONTEXT = Row(form_key=" f ", question_key="k", question_version=None, question_text=" Why? ")


def test_intake_strips_defaults_and_rejects(spark):
    df = raw(
        spark, (" ok ", " web ", None, None), ("ok", "web", " s ", CONTEXT), (" ", "web", None, None),
        ("ok", "web", "s", None), ("ok", "web", " ", CONTEXT),
        ("ok", "web", None, Row(form_key="f", question_key=" ", question_version=1, question_text="t")),
        ("ok", "web", None, Row(form_key="f", question_key="k", question_version=0, question_text="t")))
    accepted, rejected = intake.clean_inputs(df)
    rows = {r["record_id"]: r for r in accepted.collect()}
    assert (rows[1]["original_text"], rows[1]["source"], rows[1]["form_key"]) == ("ok", "web", None)
    assert (rows[2]["submission_key"], rows[2]["form_key"], rows[2]["question_version"], rows[2]["question_text"]) == ("s", "f", 1, "Why?")
    assert {r["record_id"]: r["error_code"] for r in rejected.collect()} == {
        3: "blank_text", 4: "submission_without_question", 5: "blank_submission_key",
        6: "partial_question_context", 7: "bad_question_version"}


def records(spark, rows):
    return spark.createDataFrame(
        rows, "record_id long, original_text string, source string, submission_key string, form_key string,"
              "question_key string, question_version int, question_text string")


def test_questions_are_created_once_reused_and_guarded(spark):
    stored = spark.createDataFrame([(7, "s", "f", "old", 1, "Old?")], "id long, source string, form_key string, question_key string, question_version int, question_text string")
    rows = [(i, f"a{i}", "s", None, "f", "new", 1, "New?") for i in range(1, 21)]
    rows += [(21, "a", "s", None, "f", "old", 1, "Old?"), (22, "a", "s", None, "f", "old", 1, "Other?"),
             (23, "a", "s", None, "f", "new", 1, "Changed?"), (24, "a", "s", None, None, None, None, None),
             (25, "a", "s", None, "f", "new", 2, "Changed?")]
    resolved = intake.resolve_questions(records(spark, rows), stored)
    assert [(r["id"], r["question_key"], r["question_version"]) for r in resolved.new_questions.orderBy("id").collect()] == [
        (8, "new", 1), (9, "new", 2)]
    ids = {r["record_id"]: r["question_id"] for r in resolved.records.collect()}
    assert ids == {**{i: 8 for i in range(1, 21)}, 21: 7, 24: None, 25: 9}
    assert sorted(r["record_id"] for r in resolved.conflicts.collect()) == [22, 23]


@pytest.mark.parametrize("bad", [
    {"source": " "}, {"source": "s"}, {"form_key": "f"}, {"question_key": "q"}, {"submission_key": "x"},
    {"source": "s", "form_key": "f", "question_version": 1}, {"limit": 0}, {"limit": 101}, {"offset": -1}, {"offset": 100_001},
    {"source": "s", "form_key": "f", "question_key": "q", "question_version": 0},
])
def test_scope_rules(bad):
    with pytest.raises(ValueError):
        intake.check_scope(**bad)


def test_scope_is_stripped():
    assert intake.check_scope(source=" s ", form_key="f", question_key=" q ", question_version=2).question_key == "q"


# ---- segments and embeddings

def test_segmentation_rules(spark):
    said = [(1, '{"eligible": true, "segments": [" a ", "b"]}'), (2, '{"eligible": true, "segments": []}'),
            (3, '{"eligible": false, "segments": []}'), (4, '{"eligible": true, "segments": ["a"]}'),
            (5, '{"eligible": false, "segments": ["a", "b"]}'), (6, '{"eligible": true, "segments": ["a", "a "]}'),
            (7, "no"), (8, '{"segments": []}'), (9, '{"eligible": true, "segments": ["a", " "]}')]
    done = seg.apply_segmentation(spark.createDataFrame(said, "input_id long, response string"))
    assert [(r["original_input_id"], r["segment_order"], r["segment_text"]) for r in done.segments.orderBy("segment_order").collect()] == [
        (1, 0, "a"), (1, 1, "b")]
    assert {r["input_id"]: r["status"] for r in done.status_updates.collect()} == {
        1: "ready_for_embedding", 2: "ready_for_embedding", 3: "ineligible"}
    assert {r["input_id"]: r["error_code"] for r in done.rejects.collect()} == {
        4: "single_segment", 5: "ineligible_with_segments", 6: "repeated_segment", 7: "no_json_object",
        8: "missing_eligible", 9: "blank_segment"}


def test_embedding_batches_keep_order_and_size(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "id long, text string").coalesce(1)

    def provider(texts):
        assert len(texts) <= 16
        return providers.letter_counter(texts)

    for row in providers.embed(df, "m", provider).collect():
        expected = [1.0 + row["text"].count(letter) for letter in providers.LETTERS]
        assert row["embedding"] == pytest.approx(expected, abs=1e-6) and row["embedding_model"] == "m"


@pytest.mark.parametrize("provider", [
    lambda texts: [[1.0]] * (len(texts) - 1),
    lambda texts: [[1.0] * (1 + i % 2) for i, _ in enumerate(texts)],
    lambda texts: [[float("nan")] for _ in texts],
    lambda texts: [[True] for _ in texts],
    lambda texts: [[] for _ in texts],
])
def test_bad_embeddings_are_refused(spark, provider):
    df = spark.createDataFrame([(f"text {i}",) for i in range(4)], "text string").coalesce(1)
    with pytest.raises(Exception, match="vector|dimension"):
        providers.embed(df, "m", provider).collect()


# ---- clusters

def units(spark, rows):
    df = spark.createDataFrame(rows, "entity_type string, entity_id long, text string, topic string, question_id long, question_text string")
    return df.withColumn("original_input_id", F.col("entity_id")).withColumn("topic_key", tx.casefold(F.col("topic")))


LONG = "A long and telling answer"


def test_clusters_fold_names_and_count_rich_members(spark):
    rows = [("original", 3, LONG, "Housing", None, None), ("original", 1, LONG, "housing", None, None),
            ("original", 2, "No", "Transport", None, None), ("segment", 9, LONG, "HOUSING", 1, "Q")]
    got = {r["topic_key"]: r for r in clusters.topic_clusters(units(spark, rows)).collect()}
    assert (got["housing"]["topic_name"], got["housing"]["member_count"], got["housing"]["rich_member_count"]) == ("housing", 3, 3)
    assert got["housing"]["distinct_question_count"] == 1 and got["transport"]["rich_member_count"] == 0


def test_low_information_clusters_need_three_questions(spark):
    rows = [("original", i, "No", "T", i % 2, "q") for i in range(5)]
    assert clusters.eligible(clusters.topic_clusters(units(spark, rows))).count() == 0
    rows.append(("original", 9, "No", "T", 7, "q"))
    assert clusters.eligible(clusters.topic_clusters(units(spark, rows))).count() == 1
    one_rich = rows + [("original", 10, LONG, "T", 8, "q")]
    assert clusters.eligible(clusters.topic_clusters(units(spark, one_rich))).count() == 0
    two_rich = one_rich + [("original", 11, LONG, "T", 8, "q")]
    assert clusters.eligible(clusters.topic_clusters(units(spark, two_rich))).count() == 1


def fingerprint(spark, rows):
    return {r["topic_key"]: r["fingerprint"] for r in clusters.cluster_fingerprints(units(spark, rows)).collect()}


def plain_fingerprint(topic, members):
    """Ranges of 10,000 ids, blocks of 10,000 ranges, then the whole."""
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    ranges, blocks = {}, {}
    for kind, number in sorted(members):
        ranges[kind, number // 10_000] = ranges.get((kind, number // 10_000), "") + f"|{number}"
    for (kind, number), text in sorted(ranges.items()):
        blocks[kind, number // 10_000] = blocks.get((kind, number // 10_000), "") + f"|{number}:{digest(text)}"
    return digest(topic + "".join(f"|{kind}:{number}:{digest(text)}" for (kind, number), text in sorted(blocks.items())))


def test_fingerprints_follow_membership(spark):
    members = [("segment", 10), ("original", 2), ("original", 11), ("original", 25_000), ("original", 3 * 10**8)]
    rows = [(kind, number, "x", name, None, None) for (kind, number), name in zip(members, ("Tea", "tea", "TEA", "tea", "tea"))]
    expected = plain_fingerprint("tea", members)
    assert fingerprint(spark, rows) == {"tea": expected} == fingerprint(spark, rows[::-1])
    assert fingerprint(spark, rows + [("segment", 12, "x", "tea", None, None)]) != {"tea": expected}


def test_fingerprints_have_one_definition_at_every_size(spark):
    members = [("original", 3 * i) for i in range(100_001)]
    big = units(spark, [("original", 0, "x", "Hot", None, None)]).drop("entity_id").crossJoin(spark.range(100_001).select((F.col("id") * 3).alias("entity_id")))
    got = clusters.cluster_fingerprints(big).first()["fingerprint"]
    assert got == plain_fingerprint("hot", members)


def test_sample_takes_each_question_first(spark):
    rows = [("original", 1, "one", "T", 1, "q1"), ("original", 2, "two", "T", 1, "q1"), ("original", 3, "three", "T", 2, "q2")]
    got = [r["text"] for r in clusters.sample_evidence(units(spark, rows), 2).orderBy("pos").collect()]
    assert got == ["one", "three"]


def test_sample_against_a_plain_loop_on_a_hot_topic(spark):
    rows = [("original" if i % 3 else "segment", i, f"text {i}", "Hot", None if i % 4 == 0 else i % 9, "q") for i in range(120)]
    members = sorted(rows, key=lambda r: (r[0], r[1]))
    for limit in (1, 5, 7, 12, 200):
        chosen, seen = [], set()
        for m in members:
            if m[4] is not None and m[4] not in seen and len(chosen) < limit:
                seen.add(m[4])
                chosen.append(m)
        chosen += [m for m in members if m not in chosen][: limit - len(chosen)]
        got = [r["text"] for r in clusters.sample_evidence(units(spark, rows), limit).orderBy("pos").collect()]
        # pass one stays ahead of pass two
        assert got == [m[2] for m in chosen]


def test_questions_in_member_order(spark):
    rows = [("segment", 1, "x", "T", 1, "A"), ("original", 5, "x", "T", 2, "B"), ("original", 2, "x", "T", 3, "C"), ("original", 9, "x", "T", 4, "C")]
    got = clusters.distinct_questions(units(spark, rows)).orderBy("pos").collect()
    assert [r["question_text"] for r in got] == ["C", "B", "A"]


# ---- topics

def test_offers_put_evidence_first(spark):
    inputs = spark.createDataFrame([(1,), (2,)], "id long")
    evidence = spark.createDataFrame(
        [(1, "original", 1, 1, "Tax"), (1, "original", 1, 2, "TAX"), (1, "segment", 4, 1, "Rent"), (1, "segment", 4, 2, " ")],
        "original_input_id long, target_type string, target_id long, rank long, topic string")
    usage = spark.createDataFrame([("rent", 9), ("Food", 5), ("FOOD", 3), ("Art", 3)], "topic string, usage_count long")
    got = {r["input_id"]: r["topics"] for r in topics.existing_topics(inputs, evidence, usage, 4).collect()}
    assert got == {1: ["Tax", "Rent", "Food", "Art"], 2: ["rent", "Food", "Art"]}
    cut = {r["input_id"]: r["topics"] for r in topics.existing_topics(inputs, evidence, usage, 1).collect()}
    assert cut == {1: ["Tax"], 2: ["rent"]}


def test_topic_decisions_use_known_spelling_or_are_refused(spark):
    def choice(name, reused):
        return {"name": name, "reused_existing": reused}

    def said(original, *pieces):
        return json.dumps({"original_topic": original, "segment_topics": [{"segment_id": i, "topic": t} for i, t in pieces]})

    decisions = [
        (1, said(choice(" housing ", True), (11, choice("Noise", False)))),
        (2, said(choice("housing", False))),
        (3, said(choice("Unheard", True))),
        (4, said(choice("A", False), (41, choice("B", False)), (41, choice("B", False)))),
        (5, said(choice("A", False))),
        (6, said(choice("A", False), (99, choice("B", False)))),
        (7, "nothing"), (8, said(choice(" ", False))), (9, said(choice("x" * 121, False)))]
    segments = spark.createDataFrame([(11, 1), (41, 4), (51, 5)], "id long, original_input_id long")
    existing = spark.createDataFrame([(i, ["Housing"]) for i in range(1, 10)], "input_id long, topics array<string>")
    out = topics.apply_topics(segments, spark.createDataFrame(decisions, "input_id long, response string"), existing)
    assert {(r["entity_type"], r["entity_id"]): r["topic"] for r in out.topics.collect()} == {
        ("original", 1): "Housing", ("segment", 11): "Noise", ("original", 2): "Housing"}
    assert {r["input_id"] for r in out.completed.collect()} == {1, 2}
    assert {r["input_id"]: r["error_code"] for r in out.rejects.collect()} == {
        3: "unknown_reused_topic", 4: "duplicate_segment", 5: "segment_mismatch", 6: "segment_mismatch",
        7: "no_json_object", 8: "malformed_choice", 9: "malformed_choice"}


# ---- themes

def test_theme_decision_rules(spark):
    names = ["a", "b", "c", "d", "e", "f", "g"]
    found = spark.createDataFrame([(n, n.upper(), 2) for n in names], "topic_key string, topic_name string, member_count long")
    offered = spark.createDataFrame([(n, r, i, t) for n in names for r, i, t in ((1, 10, "Buying"), (2, 20, "Selling"))],
                                    "topic_key string, rank long, theme_id long, name string")
    rows = [("a", "merge", [10], "N", ["A"]), ("b", "new", [], "BUYING", ["b"]), ("c", "update", [10], "selling", ["C"]),
            ("d", "merge", [10, 20], "selling", ["D"]), ("e", "reuse", [30], "N", ["E"]), ("f", "new", [], "N", ["F", "Other"]),
            ("g", "new", [10], "N", ["G"])]
    decisions = spark.createDataFrame(
        [(k, a, i, n, "text", "why", t) for k, a, i, n, t in rows],
        "topic_key string, action string, existing_theme_ids array<long>, proposed_name string, proposed_description string, rationale string, topics array<string>")
    got = {r["topic_key"]: r["error_code"] for r in themes.check_theme_decisions(decisions, found, offered).collect()}
    assert got == {"a": "needs_two_themes", "b": "name_exists", "c": "name_of_unrelated_theme", "d": None,
                   "e": "unknown_theme", "f": "foreign_topic", "g": "new_with_themes"}


def test_offered_themes_are_relevant_then_recent(spark):
    rows = [(i, f"T{i}", "d", None, NOW + datetime.timedelta(days=i)) for i in range(1, 9)] + [(9, "T9", "d", 1, NOW)]
    base = spark.createDataFrame(rows, "id long, name string, description string, merged_into_id long, updated_at timestamp")
    links = spark.createDataFrame([(2, "TEA"), (5, "tea"), (9, "tea")], "theme_id long, topic string")
    found = spark.createDataFrame([("tea",), ("rum",)], "topic_key string")
    got = themes.rank_existing_themes(found, base, links, 4).orderBy("rank").collect()
    assert [r["theme_id"] for r in got if r["topic_key"] == "tea"] == [5, 2, 8, 7]
    assert [r["theme_id"] for r in got if r["topic_key"] == "rum"] == [8, 7, 6, 5]


def test_long_contexts_come_in_pieces(spark):
    context = spark.createDataFrame(
        [("a", "topic", 0, "A"), ("a", "member_count", 0, "2"), ("a", "evidence", 0, "x"), ("b", "topic", 0, "B"), ("b", "member_count", 0, "3")]
        + [("b", "question", i, f"q{i}") for i in range(9)], "topic_key string, part string, pos long, item string")
    bodies = {(r["prompt_id"], r["piece"]): json.loads(r["prompt"]) for r in themes.theme_prompts(context, piece_items=4).collect()}
    assert bodies["a", 0] == {
        "topic": "A", "questions": [], "sample_evidence": ["x"], "member_count": 2, "existing_themes": [], "theme_topics": []}
    assert sorted(bodies) == [("a", 0), ("b", 0), ("b", 1), ("b", 2)] and bodies["b", 0]["topic"] == "B"
    asked = [q["question_text"] for n in range(3) for q in bodies["b", n]["questions"]]
    assert asked == [f"q{i}" for i in range(9)]


# ---- read models

def test_current_themes_of_an_input(spark):
    base = spark.createDataFrame([(1, "Purchasing", None, None), (2, "Buying", None, 1), (3, "Digital Experience", "d", None)],
                                 "id long, name string, description string, merged_into_id long")
    links = spark.createDataFrame([(1, "Price"), (2, "price"), (3, "PRICE")], "theme_id long, topic string")
    inputs = spark.createDataFrame([(5, "t", "s", "completed", "price", None, None, NOW), (6, "t", "s", "new", None, None, None, NOW)], schema.INPUTS)
    segments = spark.createDataFrame([], schema.SEGMENTS)
    questions = spark.createDataFrame([], schema.QUESTIONS)
    rows = reports.inputs_with_themes(inputs, segments, questions, base, links, graph.resolve_roots(base), intake.check_scope()).collect()
    got = {r["id"]: [(t["id"], t["name"]) for t in r["themes"]] for r in rows}
    assert got == {5: [(3, "Digital Experience"), (1, "Purchasing")], 6: []}
    assert all(r["question_context"] is None for r in rows)


def test_versions_and_pages(spark):
    questions = spark.createDataFrame([(1, "s", "f", "q", 1, "A?", NOW), (2, "s", "f", "q", 2, "B?", NOW)], schema.QUESTIONS)
    inputs = spark.createDataFrame([(i, "t", "s", "new", None, 1 + i % 2 if i else None, f"k{i}", NOW) for i in range(7)], schema.INPUTS)
    rows = reports.with_question(inputs, questions)
    both = intake.check_scope(source="s", form_key="f", question_key="q")
    second = intake.check_scope(source="s", form_key="f", question_key="q", question_version=2, offset=1, limit=1)
    assert {r["id"] for r in reports.in_scope(rows, both).collect()} == {1, 2, 3, 4, 5, 6}
    assert [r["id"] for r in reports.page(reports.in_scope(rows, second), second).collect()] == [3]


# ---- jobs and constraints

def test_backoff_and_dead_letter(spark):
    moments = [(i, "topics", 1, NOW + datetime.timedelta(hours=i)) for i in range(1, 7)]
    df = spark.createDataFrame(moments, "event_id long, job_type string, original_input_id long, failed_at timestamp")
    got = {r["attempts"]: r for r in jobs.retry_fold(df, base=5, cap=30, max_attempts=5).collect()}
    assert [got[n]["delay_seconds"] for n in range(1, 5)] == [5.0, 10.0, 20.0, 30.0]
    assert got[3]["available_at"] == NOW + datetime.timedelta(hours=3, seconds=20)
    assert [got[n]["status"] for n in range(1, 7)] == ["pending"] * 4 + ["failed"] * 2
    assert got[5]["available_at"] is None
    assert jobs.retry_state(df).first()["attempts"] == 6


def test_constraints_are_counted(spark):
    inputs = spark.createDataFrame([(1, " ", "s", "done", "x" * 121, 9, " ", NOW), (2, "t", "s", "completed", None, None, None, NOW)], schema.INPUTS)
    questions = spark.createDataFrame([(1, "s", "f", "q", 1, "A?", NOW), (2, "s", "f", "q", 1, "B?", NOW), (3, "s", "f", "q", 0, "", NOW)], schema.QUESTIONS)
    embeddings = spark.createDataFrame([(1, 1, None, [1.0], "m", "r"), (2, 1, None, [1.0], "m", "r"), (3, 1, 4, [1.0], "", "r")], schema.EMBEDDINGS)
    report = quality.constraint_report({"inputs": inputs, "questions": questions, "embeddings": embeddings})
    got = {(r["table_name"], r["rule"]): r["violations"] for r in report.collect() if r["violations"]}
    assert got == {
        ("inputs", "text_nonempty"): 1, ("inputs", "status_valid"): 1, ("inputs", "topic_valid"): 1,
        ("inputs", "submission_key_nonempty"): 1, ("inputs", "completed_has_topic"): 1, ("inputs", "question_id_exists"): 1,
        ("questions", "identity_unique"): 1, ("questions", "version_positive"): 1, ("questions", "text_nonempty"): 1,
        ("embeddings", "original_unique"): 2, ("embeddings", "one_target"): 1, ("embeddings", "model_nonempty"): 1}


def test_a_round_sees_the_themes_of_the_rounds_before(spark):
    names = ["tea", "rum", "milk", "soup"]
    rows = [("original", 10 * n + i, LONG, name, i, f"q{i}") for n, name in enumerate(names) for i in range(3)]
    none = spark.createDataFrame([], "id long, name string, description string, merged_into_id long, updated_at timestamp")
    stored = spark.createDataFrame([], "id long, group_fingerprint string")
    seen = []

    def decide(found, offered):
        seen.append(({r["topic_key"] for r in found.collect()}, {r["name"] for r in offered.collect()}))
        return providers.suggest_themes(found, offered)

    state = theme_state.ThemeState(none, spark.createDataFrame([], "theme_id long, topic string"))
    done = organise.organise_themes(units(spark, rows), state, stored, decide, F.lit(NOW), rounds=3)
    created = set()
    for turn, (found, offered) in enumerate(seen):
        assert offered == (created if found else set())
        created |= found
    assert created == set(names) == {r["name"] for r in done.state.themes.collect()}
    assert sorted(r["id"] for r in done.suggestions.collect()) == [1, 2, 3, 4] and done.evidence.count() == 12 and done.rejects.count() == 0
    again = organise.organise_themes(units(spark, rows), done.state, done.suggestions, providers.suggest_themes, F.lit(NOW), rounds=1)
    assert again.suggestions.count() == 0 and again.state.themes.count() == 4
