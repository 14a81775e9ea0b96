"""DuckDB SQL for the same relations, and the equivalent SQL of every query that has one."""

from __future__ import annotations

import re

from themeloom.functions.text import WHITESPACE

WS = "concat(" + ", ".join(f"chr({ord(char)})" for char in WHITESPACE) + ")"
EPOCH = "TIMESTAMP '2024-01-01 00:00:00'"
AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"


def strip(text: str) -> str:
    return f"trim({text}, {WS})"


def stamp(ts: str) -> str:
    """Timestamps are compared as text."""
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S.%f')"


def low(text: str) -> str:
    return (f"(length({strip(text)}) < 15 OR lower({strip(text)}) IN "
            "('yes', 'no', 'n/a', 'na', 'none', 'maybe', 'unsure', 'idk'))")


VIEWS = {
    "q_inputs": f"""
SELECT doc_id AS id, text AS original_text, source,
  CASE WHEN doc_id % 16 = 0 THEN 'ready_for_analysis' WHEN doc_id % 16 = 8 THEN 'ready_for_embedding'
    WHEN doc_id % 16 = 7 THEN 'ineligible' WHEN doc_id % 16 = 15 THEN 'new' ELSE 'completed' END AS status,
  CASE WHEN doc_id % 16 IN (7, 15) THEN NULL
    WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'GENERAL' ELSE 'General' END
    WHEN doc_id % 2 = 0 THEN upper(source || ' ' || lang) ELSE source || ' ' || lang END AS topic,
  CASE WHEN doc_id % 5 <> 0 THEN
    ((((doc_id // 1000) * 20 + CAST(substr(source, 4) AS BIGINT)) * 4
      + CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END) * 3
      + doc_id % 3) * 2 + doc_id % 2 + 1 END AS question_id,
  CASE WHEN doc_id % 5 <> 0 THEN 's' || (doc_id // 4) END AS submission_key,
  {EPOCH} + to_seconds(doc_id) AS created_at, lang
FROM documents""",
    "q_questions": """
SELECT id, source, form_key, question_key, question_version,
  'What about ' || question_key || ' in ' || form_key || ' v' || question_version || '?' AS question_text
FROM (SELECT DISTINCT question_id AS id, source, lang || '-f' || (id // 1000) AS form_key,
        'q' || (id % 3) AS question_key, 1 + id % 2 AS question_version
      FROM q_inputs WHERE id % 5 <> 0)""",
    "q_lines": f"""
SELECT doc_id, [{strip('x')} FOR x IN string_split(text, chr(10)) IF {strip('x')} <> ''] AS ls FROM documents""",
    "q_segments": """
SELECT doc_id * 100000 + o AS id, doc_id AS original_input_id, o AS segment_order, ls[o + 1] AS segment_text,
  CASE WHEN (doc_id + o) % 11 = 0 THEN NULL
    ELSE (CASE WHEN doc_id % 2 = 0 THEN 'Topic ' ELSE 'topic ' END)
      || (CASE WHEN o % 2 = 0 THEN (doc_id + o) % 7 ELSE 7 + doc_id // 20 END) END AS topic
FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS o FROM q_lines
      WHERE doc_id % 16 NOT IN (7, 15) AND len(ls) >= 2 AND len(list_distinct(ls)) = len(ls))""",
    "q_embeddings": """
SELECT id * 2 AS id, id AS original_input_id, NULL::BIGINT AS segment_input_id, 8 AS dim,
  CASE WHEN id % 10 = 0 THEN 'b' ELSE 'a' END AS embedding_model,
  CASE WHEN id % 31 = 0 OR question_id IS NULL THEN 'answer-only' ELSE 'question-answer' END AS embedding_representation
FROM q_inputs WHERE status IN ('ready_for_analysis', 'completed') AND id % 9 <> 0
UNION ALL
SELECT id * 2 + 1, NULL, id, CASE WHEN id % 19 = 0 THEN 4 ELSE 8 END,
  CASE WHEN (original_input_id % 10 = 0) <> (id % 13 = 0) THEN 'b' ELSE 'a' END,
  CASE WHEN original_input_id % 5 = 0 THEN 'answer-only' ELSE 'question-answer' END
FROM q_segments WHERE id % 17 <> 0""",
    "q_vectors": """
SELECT vec_id AS segment_id, vec_id // 2 AS original_input_id, embedding, 'topic_' || label AS topic,
  CASE WHEN vec_id % 10 = 0 THEN 'b' ELSE 'a' END AS embedding_model,
  CASE WHEN vec_id % 4 = 0 THEN 'No' ELSE 'Segment number ' || vec_id END AS segment_text,
  CASE WHEN (vec_id // 2) % 5 = 0 THEN NULL WHEN (vec_id // 2) % 3 = 1 THEN 1
    ELSE 2 + (vec_id // 2) % 40 END AS question_id,
  (vec_id // 2) % 3 <> 0 AS completed
FROM embeddings""",
    "q_themes": f"""
SELECT id, 'Theme ' || id AS name, 'About ' || seg AS description,
  CASE WHEN id % 100 = 21 THEN id + 1 WHEN id % 100 IN (22, 23) THEN id - 1
    WHEN id % 100 BETWEEN 60 AND 95 THEN id + 1 WHEN id % 4 = 0 THEN NULL
    WHEN id % 3 = 0 THEN 4 ELSE id + 1 END AS merged_into_id,
  {EPOCH} + to_days(CAST(id % 50 AS INTEGER)) AS updated_at
FROM (SELECT c_custkey + 1 AS id, c_mktsegment AS seg FROM customer)""",
    "q_theme_topics": """
SELECT id AS theme_id, (CASE WHEN id % 3 = 0 THEN 'TOPIC ' ELSE 'topic ' END) || (id // 25) AS topic FROM q_themes
UNION ALL
SELECT id, 'src' || (id % 20) || ' ' || (CASE id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END)
FROM q_themes WHERE id % 7 = 0
UNION ALL
SELECT id, 'general' FROM q_themes WHERE id % 500 IN (20, 40, 61)""",
    "q_roots": """
SELECT id AS theme_id, id AS root_id FROM q_themes WHERE merged_into_id IS NULL
UNION ALL
SELECT alias.id, q_roots.root_id FROM q_roots JOIN q_themes alias ON alias.merged_into_id = q_roots.theme_id""",
    "q_suggestions": f"""
SELECT id, CASE id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'reuse' WHEN 2 THEN 'update' ELSE 'merge' END AS action,
  CASE WHEN id % 10 = 4 THEN 'THEME ' || (4 * id) WHEN id % 10 = 6 THEN 'theme ' || id
    WHEN id % 4 = 0 THEN 'Fresh ' || (id % 24) ELSE 'Renamed ' || id END AS proposed_name,
  'Description ' || id AS proposed_description, 'Because ' || id AS rationale,
  sha256('fp' || id) AS group_fingerprint,
  CASE id % 4 WHEN 0 THEN []::BIGINT[] WHEN 1 THEN [4 * id + 1] WHEN 2 THEN [4 * id]
    ELSE [4 * id, 4 * (id + 4), 4 * id + 1] END AS existing_theme_ids,
  [(CASE WHEN id % 2 = 0 THEN 'Topic ' ELSE 'topic ' END) || (id % 60)] AS topics,
  CASE WHEN id % 3 = 0 THEN 4 * id END AS materialized_theme_id,
  CASE WHEN id % 3 = 0 THEN {EPOCH} + to_hours(id) END AS materialized_at
FROM (SELECT s_suppkey + 1 AS id FROM supplier)""",
    "q_suggestion_themes": """
SELECT DISTINCT id AS suggestion_id, unnest(existing_theme_ids) AS theme_id FROM q_suggestions
UNION ALL SELECT id, 4 * id FROM q_suggestions WHERE id % 30 = 2""",
    "q_suggestion_topics": """
SELECT id AS suggestion_id, unnest(topics) AS topic FROM q_suggestions
UNION ALL SELECT id + 3, CASE WHEN id % 3 = 0 THEN upper(topics[1]) ELSE ' ' END FROM q_suggestions WHERE id % 20 = 1""",
    "q_evidence": """
SELECT 1 + id % (SELECT count(*) FROM supplier) AS suggestion_id, id AS original_input_id, NULL::BIGINT AS segment_input_id
FROM q_inputs WHERE topic IS NOT NULL
UNION ALL
SELECT 1 + id % (SELECT count(*) + 8 FROM supplier), NULL, id FROM q_segments WHERE topic IS NOT NULL""",
    "q_attempts": """
SELECT event_id, ts, event_type, user_id AS original_input_id,
  CASE CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 WHEN 0 THEN 'eligibility_segmentation'
    WHEN 1 THEN 'embeddings' WHEN 2 THEN 'topics' ELSE 'themes' END AS job_type
FROM events""",
    "q_failures": """
SELECT event_id, job_type, original_input_id, ts AS failed_at FROM q_attempts WHERE event_type = 'error'""",
    "q_jobs": """
SELECT id, job_type, original_input_id,
  CASE id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed' ELSE 'failed' END AS status,
  attempts, last_ts AS available_at,
  CASE WHEN id % 4 = 1 THEN last_ts END AS locked_at,
  CASE WHEN id % 4 = 1 THEN 'worker-' || (id % 3) END AS locked_by,
  CASE WHEN id % 4 = 3 THEN 'error ' || id END AS last_error,
  CASE WHEN id % 4 = 2 THEN last_ts END AS completed_at
FROM (SELECT job_type, original_input_id, max(event_id) AS id, max(ts) AS last_ts,
        count(*) FILTER (WHERE event_type = 'error') AS attempts
      FROM q_attempts GROUP BY 1, 2)""",
    "q_records": f"""
SELECT doc_id AS record_id,
  CASE WHEN doc_id % 41 = 0 THEN ' ' || chr(9) || chr(10) || ' ' ELSE '  ' || text || ' ' || chr(10) END AS original_text,
  CASE WHEN doc_id % 43 = 0 THEN ' ' ELSE ' ' || source END AS source,
  CASE WHEN doc_id % 7 = 0 THEN 's' || doc_id || ' ' END AS submission_key,
  doc_id % 5 <> 0 AS has_context,
  CASE WHEN doc_id % 5 <> 0 THEN ' ' || lang || '-f' || (doc_id // 1000) END AS form_key,
  CASE WHEN doc_id % 5 <> 0 THEN CASE WHEN doc_id % 47 = 0 THEN ' ' ELSE 'q' || (doc_id % 3) END END AS question_key,
  CASE WHEN doc_id % 5 <> 0 THEN CASE WHEN doc_id % 53 = 0 THEN 0 WHEN doc_id % 2 = 0 THEN NULL ELSE 2 END END AS question_version,
  CASE WHEN doc_id % 5 <> 0 THEN (CASE WHEN doc_id % 50 = 1 THEN 'Changed wording?'
    ELSE 'What about q' || (doc_id % 3) || ' in ' || lang || '-f' || (doc_id // 1000) || ' v' || (1 + doc_id % 2) || '?' END) || ' ' END AS question_text
FROM documents""",
    "q_checked": f"""
SELECT record_id, nullif({strip('original_text')}, '') AS original_text, nullif({strip('source')}, '') AS source,
  nullif({strip('submission_key')}, '') AS submission_key,
  nullif({strip('form_key')}, '') AS form_key, nullif({strip('question_key')}, '') AS question_key,
  CASE WHEN has_context THEN coalesce(question_version, 1) END AS question_version,
  nullif({strip('question_text')}, '') AS question_text,
  CASE WHEN {strip('original_text')} = '' THEN 'blank_text'
    WHEN {strip('source')} = '' THEN 'blank_source'
    WHEN submission_key IS NOT NULL AND {strip('submission_key')} = '' THEN 'blank_submission_key'
    WHEN has_context AND ({strip('form_key')} = '' OR {strip('question_key')} = '' OR {strip('question_text')} = '')
      THEN 'partial_question_context'
    WHEN has_context AND coalesce(question_version, 1) < 1 THEN 'bad_question_version'
    WHEN submission_key IS NOT NULL AND NOT has_context THEN 'submission_without_question' END AS error_code
FROM q_records""",
    "q_units": """
SELECT 'segment' AS entity_type, s.id AS entity_id, i.id AS original_input_id, s.segment_text AS text, s.topic,
  lower(s.topic) AS topic_key, i.question_id, q.question_text
FROM q_inputs i JOIN q_segments s ON s.original_input_id = i.id LEFT JOIN q_questions q ON q.id = i.question_id
WHERE i.status = 'completed' AND s.topic IS NOT NULL
UNION ALL
SELECT 'original', i.id, i.id, i.original_text, i.topic, lower(i.topic), i.question_id, q.question_text
FROM q_inputs i LEFT JOIN q_questions q ON q.id = i.question_id
WHERE i.status = 'completed' AND i.topic IS NOT NULL""",
    "q_clusters": f"""
SELECT topic_key, arg_min(topic, (entity_type, entity_id, topic)) AS topic_name, count(*) AS member_count,
  count(*) FILTER (WHERE NOT {low('text')}) AS rich_member_count,
  count(DISTINCT question_id) AS distinct_question_count
FROM q_units GROUP BY topic_key""",
    "q_input_topics": """
SELECT id AS input_id, topic FROM q_inputs WHERE topic IS NOT NULL
UNION SELECT original_input_id, topic FROM q_segments WHERE topic IS NOT NULL""",
    "q_topic_themes": """
SELECT DISTINCT lower(l.topic) AS topic_key, t.id AS theme_id, t.name, t.description
FROM q_theme_topics l JOIN q_roots r ON r.theme_id = l.theme_id JOIN q_themes t ON t.id = r.root_id""",
    "q_targets": """
SELECT 'original' AS entity_type, i.id AS entity_id, i.id AS original_input_id, i.original_text AS text, i.question_id, q.question_text
FROM q_inputs i LEFT JOIN q_questions q ON q.id = i.question_id
UNION ALL
SELECT 'segment', s.id, i.id, s.segment_text, i.question_id, q.question_text
FROM q_segments s JOIN q_inputs i ON i.id = s.original_input_id LEFT JOIN q_questions q ON q.id = i.question_id""",
    "q_pairs": """
SELECT t.segment_id AS target_id, e.segment_id, e.topic,
  round(1 - list_cosine_similarity(t.embedding::DOUBLE[], e.embedding::DOUBLE[]), 12) AS distance,
  t.question_id AS target_question, e.question_id AS evidence_question, t.segment_text AS target_text
FROM q_vectors t JOIN q_vectors e
  ON e.embedding_model = t.embedding_model AND len(e.embedding) = len(t.embedding)
  AND e.original_input_id <> t.original_input_id AND e.completed""",
    "q_tiered": f"""
SELECT target_id, rank, segment_id, topic, round(1 - distance, 6) AS similarity,
  CASE WHEN tier = 0 THEN 'same_question' ELSE 'global' END AS scope
FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY tier, distance, segment_id) AS rank
      FROM (SELECT *, CASE WHEN target_question = evidence_question THEN 0 ELSE 1 END AS tier FROM q_pairs)
      WHERE tier = 0 OR target_question IS NULL OR NOT {low('target_text')})
WHERE rank <= 5""",
    "q_ranked": """
SELECT topic_key, rank, theme_id, name, description, relevance FROM (
  SELECT *, row_number() OVER (PARTITION BY topic_key ORDER BY relevance DESC, updated_at DESC, theme_id) AS rank
  FROM (SELECT c.topic_key, t.id AS theme_id, t.name, t.description, t.updated_at, count(l.topic) AS relevance
        FROM q_clusters c CROSS JOIN q_themes t
        LEFT JOIN q_theme_topics l ON l.theme_id = t.id AND lower(l.topic) = c.topic_key
        WHERE t.merged_into_id IS NULL GROUP BY 1, 2, 3, 4, 5))
WHERE rank <= 50""",
}


def sql(body: str) -> str:
    """``body`` with exactly the views it needs, in dependency order, as common table expressions."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bq_\w+", text):
            if name in VIEWS and name not in needed and name not in open_names:
                open_names.append(name)
                need(VIEWS[name])
                open_names.remove(name)
                needed.append(name)

    open_names: list[str] = []
    need(body)
    parts = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    return f"WITH RECURSIVE {parts}\n{body}" if parts else body


def constraint_sql() -> str:
    """Every stored rule counted on its own, one SELECT each."""
    def blank(name: str) -> str:
        return f"({name} IS NULL OR trim({name}) = '')"

    def set_but(name: str, longest: int = 0) -> str:
        long = f" OR length({name}) > {longest}" if longest else ""
        return f"({name} IS NOT NULL AND (trim({name}) = ''{long}))"

    def text(name: str, longest: int) -> str:
        return f"({blank(name)} OR length({name}) > {longest})"

    def not_one(a: str, b: str) -> str:
        return f"(({a} IS NULL) = ({b} IS NULL))"

    def outside(name: str, *values: str) -> str:
        return f"({name} IS NULL OR {name} NOT IN ({', '.join(repr(v) for v in values)}))"

    rows = {
        "questions": {
            "source_nonempty": blank("source"), "form_key_nonempty": blank("form_key"),
            "question_key_nonempty": blank("question_key"), "text_nonempty": blank("question_text"),
            "version_positive": "(question_version IS NULL OR question_version < 1)"},
        "inputs": {
            "text_nonempty": blank("original_text"), "source_nonempty": blank("source"),
            "status_valid": outside("status", "new", "ineligible", "ready_for_embedding", "ready_for_analysis", "completed"),
            "topic_valid": set_but("topic", 120), "submission_key_nonempty": set_but("submission_key"),
            "completed_has_topic": "(status = 'completed' AND topic IS NULL)"},
        "segments": {
            "order_nonnegative": "(segment_order IS NULL OR segment_order < 0)",
            "text_nonempty": blank("segment_text"), "topic_valid": set_but("topic", 120)},
        "embeddings": {
            "one_target": not_one("original_input_id", "segment_input_id"), "model_nonempty": blank("embedding_model"),
            "representation_nonempty": blank("embedding_representation")},
        "themes": {
            "name_valid": text("name", 120), "description_length": "length(description) > 2000",
            "not_self_merged": "merged_into_id = id"},
        "theme_topics": {"topic_valid": text("topic", 120)},
        "suggestions": {
            "action_valid": outside("action", "reuse", "new", "merge", "update"),
            "name_valid": text("proposed_name", 120), "description_valid": text("proposed_description", 2000),
            "rationale_valid": text("rationale", 2000),
            "fingerprint_valid": "NOT regexp_full_match(group_fingerprint, '[0-9a-f]{64}')",
            "materialization_consistent": "((materialized_theme_id IS NULL) <> (materialized_at IS NULL))"},
        "evidence": {"one_target": not_one("original_input_id", "segment_input_id")},
        "jobs": {
            "type_valid": outside("job_type", "eligibility_segmentation", "embeddings", "topics", "themes"),
            "status_valid": outside("status", "pending", "processing", "completed", "failed"),
            "attempts_nonnegative": "(attempts IS NULL OR attempts < 0)",
            "lock_consistent": "((status = 'processing') <> (locked_at IS NOT NULL AND locked_by IS NOT NULL))"},
    }
    numbered = ("questions", "inputs", "segments", "embeddings", "themes", "suggestions", "jobs")
    rows["suggestion_topics"] = {"topic_valid": text("topic", 120)}
    for table in numbered:
        rows[table]["id_present"] = "id IS NULL"
    unique = [
        *[(table, "id_unique", "id") for table in numbered],
        ("suggestion_themes", "link_unique", "suggestion_id, theme_id"), ("suggestion_topics", "link_unique", "suggestion_id, lower(topic)"),
        ("questions", "identity_unique", "source, form_key, question_key, question_version"),
        ("segments", "position_unique", "original_input_id, segment_order"),
        ("embeddings", "original_unique", "original_input_id"), ("embeddings", "segment_unique", "segment_input_id"),
        ("themes", "name_unique", "lower(name)"), ("theme_topics", "link_unique", "theme_id, lower(topic)"),
        ("suggestions", "fingerprint_unique", "group_fingerprint"),
        ("evidence", "original_unique", "suggestion_id, original_input_id"),
        ("evidence", "segment_unique", "suggestion_id, segment_input_id"),
        ("jobs", "input_stage_unique", "job_type, original_input_id")]
    foreign = [
        ("suggestion_themes", "suggestion_id", "suggestions"), ("suggestion_themes", "theme_id", "themes"),
        ("suggestion_topics", "suggestion_id", "suggestions"),
        ("inputs", "question_id", "questions"), ("segments", "original_input_id", "inputs"),
        ("embeddings", "original_input_id", "inputs"), ("embeddings", "segment_input_id", "segments"),
        ("themes", "merged_into_id", "themes"), ("theme_topics", "theme_id", "themes"),
        ("suggestions", "materialized_theme_id", "themes"), ("evidence", "suggestion_id", "suggestions"),
        ("evidence", "original_input_id", "inputs"), ("evidence", "segment_input_id", "segments"),
        ("jobs", "original_input_id", "inputs")]
    parts = [
        f"SELECT '{table}' AS table_name, '{rule}' AS rule, count(*) FILTER (WHERE {bad}) AS violations FROM q_{table}"
        for table, rules in rows.items() for rule, bad in rules.items()
    ]
    for table, rule, key in unique:
        known = " AND ".join(f"{part} IS NOT NULL" for part in key.split(", "))
        parts.append(
            f"SELECT '{table}', '{rule}', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM "
            f"(SELECT count(*) AS n FROM q_{table} WHERE {known} GROUP BY {key})")
    for table, column, parent in foreign:
        parts.append(
            f"SELECT '{table}', '{column}_exists', count(*) FROM q_{table} "
            f"WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT id FROM q_{parent})")
    return "\nUNION ALL ".join(parts)
