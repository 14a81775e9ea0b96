"""Every registered query: the Spark plan over the given tables, and its equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom import providers
from themeloom.functions import text as tx
from themeloom.functions import vectors as vec
from themeloom.operators import clusters, expectations, graph, intake, jobs, neighbors, organise, ordered, products, quality, reports, root_state
from themeloom.operators import segments as seg
from themeloom.operators import theme_state, themes, topics
from themeloom.plans import reference_sql as ref
from themeloom.plans import relations as rel
from themeloom.session import configure, cut_lineage, long_dictionaries, long_rows, work_folder
from themeloom.sources import buckets, tables
from themeloom.streaming import stages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(configure(spark), folder)

        run.__doc__ = function.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = ref.sql(sql)
        return run

    return register


def stamp(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


# ---- sources, sinks ---------------------------------------------------------------------------

@query("ingest_inputs", """SELECT record_id, original_text, source, submission_key, form_key, question_key,
  CAST(question_version AS BIGINT) AS question_version, question_text, error_code FROM q_checked""")
def ingest_inputs(spark, d):
    checked = intake.check_inputs(rel.raw_records(spark, d))
    return checked.withColumn("question_version", F.col("question_version").cast("long"))


@query("read_tables", "SELECT id, source, status, topic, question_id FROM q_inputs")
def read_tables(spark, d):
    return rel.inputs(spark, d).select("id", "source", "status", "topic", "question_id")


@query("stream_inputs", f"""SELECT i.id, 'ready_for_analysis' AS status, coalesce(s.n, 0) AS segments
FROM q_inputs i LEFT JOIN (
  SELECT doc_id, CASE WHEN len(ls) >= 2 AND len(list_distinct(ls)) = len(ls) THEN len(ls) ELSE 0 END AS n
  FROM q_lines) s ON s.doc_id = i.id
WHERE {ref.strip('i.original_text')} <> ''""")
def stream_inputs(spark, d):
    folder = work_folder(spark)
    schema = rel.read(spark, d, "documents").schema
    raw = stages.read_stream(spark, f"{d}/documents*.parquet", schema)
    incoming = raw.select(
        F.col("doc_id").alias("id"), F.col("text").alias("original_text"),
        F.expr(rel.QUESTION_ID).alias("question_id"),
    )
    stages.stream_inputs(incoming, rel.questions(spark, d), folder)
    done = tables.read_stage(spark, folder, "inputs").select("id", "status")
    pieces = tables.read_stage(spark, folder, "segments").groupBy(
        F.col("original_input_id").alias("id")).agg(F.count(F.lit(1)).alias("segments"))
    return done.join(pieces, "id", "left").fillna(0, ["segments"])


def arithmetic_topics(asked, votes):
    """Topic responses by the id of the input, whatever the votes say, in place of a model."""
    choice = F.struct(F.expr("concat('Subject ', original_input_id % 7)").alias("name"), F.lit(False).alias("reused_existing"))
    pieces = F.collect_list(F.when(F.col("entity_type") == "segment", F.struct(F.col("entity_id").alias("segment_id"), choice.alias("topic"))))
    body = F.to_json(F.struct(F.max(F.when(F.col("entity_type") == "original", choice)).alias("original_topic"), pieces.alias("segment_topics")))
    return asked.groupBy(F.col("original_input_id").alias("input_id")).agg(body.alias("response"))


WAVES = 2


@query("stream_pipeline", f"""SELECT c.record_id AS id, c.record_id * {WAVES} // (SELECT max(doc_id) + 1 FROM documents) AS batch_id, 'completed' AS status, 'Subject ' || (c.record_id % 7) AS topic, 'Subject ' || (c.record_id % 7) AS theme,
  CASE WHEN len(l.ls) >= 2 AND len(list_distinct(l.ls)) = len(l.ls) THEN len(l.ls) ELSE 0 END AS segments, c.form_key IS NOT NULL AS asked
FROM (SELECT *, first_value(question_text) OVER (PARTITION BY source, form_key, question_key, question_version ORDER BY record_id) AS first_text
      FROM q_checked WHERE error_code IS NULL) c JOIN q_lines l ON l.doc_id = c.record_id
WHERE c.form_key IS NULL OR c.question_text = c.first_text""")
def stream_pipeline(spark, d):
    """Records to themes as a stream that stops and goes on: intake, questions, segments, embeddings, topics, themes.

    Records arrive in two waves by id, each in as many files as it has, and each is a batch that meets the state of those before.
    """
    folder, source = work_folder(spark), work_folder(spark)
    records = rel.raw_records(spark, d)
    past = (records.agg(F.max("record_id")).first()[0] or 0) + 1
    for wave in range(WAVES):
        records.where((F.col("record_id") * WAVES >= wave * past) & (F.col("record_id") * WAVES < (wave + 1) * past)).write.mode("append").parquet(source)
        stages.stream_pipeline(stages.read_stream(spark, source, records.schema), folder, choose=arithmetic_topics)
    done, named = tables.read_stage(spark, folder, "inputs"), tables.read_stage(spark, folder, "topics").where("entity_type = 'original'")
    pieces = tables.read_stage(spark, folder, "segments").groupBy(F.col("original_input_id").alias("id")).agg(F.count(F.lit(1)).alias("segments"))
    state = stages.read_state(spark, folder)
    links = state.theme_topics.join(state.themes.select(F.col("id").alias("theme_id"), F.col("name").alias("theme")), "theme_id")
    shown = done.join(named.select(F.col("entity_id").alias("id"), "topic"), "id").join(links.select("topic", "theme"), "topic")
    return shown.join(pieces, "id", "left").select(
        "id", F.col("batch_id").cast("long").alias("batch_id"), "status", "topic", "theme", F.coalesce("segments", F.lit(0)).alias("segments"), F.col("question_id").isNotNull().alias("asked"))


@query("append_sink", "SELECT id, original_input_id, segment_order, topic FROM q_segments")
def append_sink(spark, d):
    folder = work_folder(spark)
    rows = rel.segments(spark, d)
    for attempt in range(2):  # a repeated batch replaces itself
        tables.append_batch(rows, folder, "segments", 0)
    return tables.read_stage(spark, folder, "segments").select(
        "id", "original_input_id", "segment_order", "topic")


@query("snapshot_sink", "SELECT id, name, merged_into_id FROM q_themes")
def snapshot_sink(spark, d):
    folder = work_folder(spark)
    tables.write_snapshot(rel.themes(spark, d), folder, "themes", 1)
    return tables.read_snapshot(spark, folder, "themes", 1).select("id", "name", "merged_into_id")


@query("upsert_do_nothing", """SELECT r.source, r.form_key, r.question_key, CAST(r.question_version AS BIGINT) AS question_version,
  arg_min(r.question_text, r.record_id) AS question_text
FROM q_checked r WHERE r.error_code IS NULL AND r.form_key IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM q_questions q WHERE q.id % 2 = 0 AND q.source = r.source AND q.form_key = r.form_key
    AND q.question_key = r.question_key AND q.question_version = r.question_version)
GROUP BY 1, 2, 3, 4""")
def upsert_do_nothing(spark, d):
    stored = rel.questions(spark, d).where("id % 2 = 0")
    accepted = intake.clean_inputs(rel.raw_records(spark, d)).accepted.where("form_key IS NOT NULL")
    incoming = accepted.withColumn("question_version", F.col("question_version").cast("long")).select(
        *intake.IDENTITY, "question_text", "record_id")
    return tables.insert_missing(stored, incoming, intake.IDENTITY, ["record_id"]).drop("record_id")


@query("upsert_do_update", """SELECT job_type, original_input_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type
FROM q_attempts GROUP BY 1, 2""")
def upsert_do_update(spark, d):
    log = rel.attempts(spark, d).select("job_type", "original_input_id", "event_id", "event_type")
    return tables.upsert_latest(log.where("event_id % 2 = 0"), log.where("event_id % 2 = 1"), jobs.JOB, "event_id")


@query("bucketed_upsert", """SELECT job_type, original_input_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type
FROM q_attempts GROUP BY 1, 2""")
def bucketed_upsert(spark, d):
    """The attempt log in two versions of a bucketed table, the second of them written twice."""
    folder = work_folder(spark)
    log = rel.attempts(spark, d).select("job_type", "original_input_id", "event_id", "event_type")
    for version, part in ((0, 0), (1, 1), (1, 1)):
        buckets.upsert_buckets(log.where(f"event_id % 2 = {part}"), folder, jobs.JOB, ["event_id"], version, 16)
    return buckets.read_buckets(spark, folder, "job_type string, original_input_id long, event_id long, event_type string")


@query("vector_codec", """SELECT vec_id, len(embedding) AS dims, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings""")
def vector_codec(spark, d):
    back = vec.from_text(vec.to_text(F.col("embedding")))
    return rel.read(spark, d, "embeddings").select("vec_id", back.alias("v")).select(
        "vec_id", F.size("v").cast("long").alias("dims"),
        F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


# ---- projections, filters, predicates ---------------------------------------------------------

@query("status_filter", "SELECT id, original_text FROM q_inputs WHERE status = 'ready_for_embedding'")
def status_filter(spark, d):
    return rel.inputs(spark, d).where(F.col("status") == "ready_for_embedding").select("id", "original_text")


SCOPE = intake.check_scope(source="src3", form_key="en-f0", limit=None)


@query("optional_scope_filter", """SELECT i.id, q.question_key, q.question_version FROM q_inputs i JOIN q_questions q ON q.id = i.question_id
WHERE q.source = 'src3' AND q.form_key = 'en-f0'""")
def optional_scope_filter(spark, d):
    rows = reports.with_question(rel.inputs(spark, d), rel.questions(spark, d))
    return reports.in_scope(rows, SCOPE).select("id", "question_key", "question_version")


@query("distinct_from", """SELECT s.id, s.topic, i.topic AS input_topic FROM q_segments s JOIN q_inputs i ON i.id = s.original_input_id
WHERE lower(s.topic) IS DISTINCT FROM lower(i.topic)""")
def distinct_from(spark, d):
    parents = rel.inputs(spark, d).select(F.col("id").alias("original_input_id"), F.col("topic").alias("input_topic"))
    joined = rel.segments(spark, d).join(parents, "original_input_id")
    return joined.where(~F.lower("topic").eqNullSafe(F.lower("input_topic"))).select("id", "topic", "input_topic")


@query("build_embedding_input", """SELECT a.conv_id, a.turn,
  CASE WHEN q.text IS NULL THEN a.text ELSE 'Question: ' || q.text || chr(10) || 'Answer: ' || a.text END AS text
FROM conversations a LEFT JOIN conversations q ON q.conv_id = a.conv_id AND q.turn = a.turn - 1 AND q.role = 'user'
WHERE a.role = 'assistant'""")
def build_embedding_input(spark, d):
    return rel.dialog(spark, d).select(
        "conv_id", "turn", tx.embedding_input(F.col("answer_text"), F.col("question_text")).alias("text"))


@query("representation_tag", """SELECT entity_type, entity_id,
  CASE WHEN question_text IS NULL THEN 'answer-only' ELSE 'question-answer' END AS embedding_representation FROM q_targets""")
def representation_tag(spark, d):
    rows = seg.embedding_inputs(rel.inputs(spark, d), rel.segments(spark, d), rel.questions(spark, d))
    return rows.select("entity_type", "entity_id", "embedding_representation")


@query("materialization_status", """SELECT id, CASE WHEN materialized_at IS NULL THEN 'pending' ELSE 'materialized' END AS materialization_status
FROM q_suggestions""")
def materialization_status(spark, d):
    return reports.suggestion_status(rel.suggestions(spark, d)).select("id", "materialization_status")


@query("targets", "SELECT entity_type, entity_id, original_input_id, length(text) AS chars, question_id, question_text FROM q_targets")
def targets(spark, d):
    rows = seg.targets(rel.inputs(spark, d), rel.segments(spark, d), rel.questions(spark, d))
    return rows.select("entity_type", "entity_id", "original_input_id",
                       F.char_length("text").cast("long").alias("chars"), "question_id", "question_text")


@query("low_information", f"""SELECT doc_id, o AS line, {ref.low('x')} AS low FROM (
  SELECT doc_id, generate_subscripts(l, 1) AS o, unnest(l) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))""")
def low_information(spark, d):
    lines = rel.read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("o", "x"))
    return lines.select("doc_id", (F.col("o") + 1).cast("long").alias("line"), tx.low_information(F.col("x")).alias("low"))


@query("scalar_functions", f"""SELECT id, lower(name) AS name_key, length(description) AS chars,
  left(name, 80) || ' [merged #' || id || ']' AS merged_name, sha256(name) AS digest,
  regexp_matches(sha256(name), '^[0-9a-f]{{64}}$') AS hex64,
  (merged_into_id IS NULL) <> (description IS NULL) AS one_set,
  {ref.stamp("updated_at + to_seconds(90)")} AS later
FROM q_themes""")
def scalar_functions(spark, d):
    """The scalar functions of the relations: case, length, clipping, digests, seconds arithmetic."""
    name = F.col("name")
    return rel.themes(spark, d).select(
        "id", F.lower(name).alias("name_key"), F.char_length("description").cast("long").alias("chars"),
        tx.merged_name(name, F.col("id")).alias("merged_name"), F.sha2(name, 256).alias("digest"),
        F.sha2(name, 256).rlike("^[0-9a-f]{64}$").alias("hex64"),
        (F.col("merged_into_id").isNull() != F.col("description").isNull()).alias("one_set"),
        F.date_format(F.expr("updated_at + INTERVAL 90 SECONDS"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("later"))


@query("json_slice", """SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE doc_id END AS parsed_id FROM documents""")
def json_slice(spark, d):
    """A JSON object fished out of the chatter around it; an array or plain text holds none."""
    said = F.expr(r"""CASE doc_id % 3 WHEN 0 THEN concat('Sure!\n```json\n', to_json(named_struct('id', doc_id, 'text', text)), '\n```')
        WHEN 1 THEN to_json(named_struct('id', doc_id)) ELSE concat('[', doc_id, ']') END""")
    body = F.from_json(tx.json_object(said), "id BIGINT")
    return rel.read(spark, d, "documents").select("doc_id", body["id"].alias("parsed_id"))


@query("vector_validation", """SELECT vec_id, vec_id % 5 = 0 AS valid FROM embeddings""")
def vector_validation(spark, d):
    spoilt = F.expr("""CASE vec_id % 5 WHEN 1 THEN array() WHEN 2 THEN concat(embedding, array(CAST('NaN' AS FLOAT)))
        WHEN 3 THEN concat(embedding, array(CAST('Infinity' AS FLOAT))) WHEN 4 THEN concat(embedding, array(CAST(NULL AS FLOAT)))
        ELSE embedding END""")
    return rel.read(spark, d, "embeddings").select("vec_id", vec.is_valid(spoilt).alias("valid"))


# ---- joins ------------------------------------------------------------------------------------

@query("left_question_join", """SELECT i.id, q.form_key, q.question_key, q.question_version, q.question_text
FROM q_inputs i LEFT JOIN q_questions q ON q.id = i.question_id""")
def left_question_join(spark, d):
    return reports.with_question(rel.inputs(spark, d), rel.questions(spark, d)).select(
        "id", "form_key", "question_key", "question_version", "question_text")


@query("segments_inner", """SELECT s.id AS segment_id, s.original_input_id, s.topic, e.embedding_model, i.question_id
FROM q_embeddings e JOIN q_segments s ON s.id = e.segment_input_id JOIN q_inputs i ON i.id = s.original_input_id
WHERE s.topic IS NOT NULL AND i.status = 'completed'""")
def segments_inner(spark, d):
    rows = neighbors.evidence_rows(rel.inputs(spark, d), rel.segments(spark, d), rel.embeddings(spark, d))
    return rows.select("segment_id", "original_input_id", "topic", "embedding_model", "question_id")


def _knn(spark, d, tiered):
    found = neighbors.knn_evidence(rel.vector_targets(spark, d), rel.vector_evidence(spark, d), 5, tiered=tiered)
    return found.select("target_id", "rank", "segment_id", "topic", F.round("similarity", 6).alias("similarity"), "scope")


@query("knn_evidence", """SELECT target_id, rank, segment_id, topic, round(1 - distance, 6) AS similarity, 'global' AS scope
FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY distance, segment_id) AS rank FROM q_pairs) WHERE rank <= 5""")
def knn_evidence(spark, d):
    return _knn(spark, d, tiered=False)


@query("knn_tiered", "SELECT target_id, rank, segment_id, topic, similarity, scope FROM q_tiered")
def knn_tiered(spark, d):
    return _knn(spark, d, tiered=True)


@query("ci_topic_join", """SELECT t.input_id, t.topic, l.theme_id FROM q_input_topics t JOIN q_theme_topics l ON lower(l.topic) = lower(t.topic)""")
def ci_topic_join(spark, d):
    spoken = cut_lineage(reports.input_topics(rel.inputs(spark, d), rel.segments(spark, d)).withColumn("k", F.lower("topic")))
    links = cut_lineage(rel.theme_topics(spark, d).select("theme_id", F.lower("topic").alias("k")))
    return products.join_in_strips(spoken, links, "k").select("input_id", "topic", "theme_id")


@query("or_join", """SELECT e.original_input_id AS input_id, e.id AS embedding_id, e.embedding_representation FROM q_embeddings e
WHERE e.original_input_id IS NOT NULL
UNION ALL SELECT s.original_input_id, e.id, e.embedding_representation FROM q_embeddings e JOIN q_segments s ON s.id = e.segment_input_id""")
def or_join(spark, d):
    return reports.embedding_owners(rel.segments(spark, d), rel.embeddings(spark, d))


@query("coalesce_key_join", """SELECT e.suggestion_id, i.source, count(*) AS pieces
FROM q_evidence e LEFT JOIN q_segments s ON s.id = e.segment_input_id
JOIN q_inputs i ON i.id = coalesce(e.original_input_id, s.original_input_id) GROUP BY 1, 2""")
def coalesce_key_join(spark, d):
    behind = reports.evidence_inputs(rel.evidence(spark, d), rel.segments(spark, d))
    sources = rel.inputs(spark, d).select(F.col("id").alias("input_id"), "source")
    return behind.join(sources, "input_id").groupBy("suggestion_id", "source").agg(F.count(F.lit(1)).alias("pieces"))


@query("exists_semi", """SELECT g.id, g.action FROM q_suggestions g WHERE EXISTS (
  SELECT 1 FROM q_evidence e LEFT JOIN q_segments s ON s.id = e.segment_input_id
  JOIN q_inputs i ON i.id = coalesce(e.original_input_id, s.original_input_id)
  WHERE e.suggestion_id = g.id AND i.source = 'src3')""")
def exists_semi(spark, d):
    return reports.suggestions_by_source(
        rel.suggestions(spark, d), rel.evidence(spark, d), rel.segments(spark, d), rel.inputs(spark, d), "src3"
    ).select("id", "action")


def _units(spark, d, wording=False):
    return clusters.analysis_units(
        rel.inputs(spark, d), rel.segments(spark, d), rel.questions(spark, d) if wording else None)


FINGERPRINT = """SELECT topic_key, sha256(topic_key || string_agg('|' || entity_type || ':' || b || ':' || d, '' ORDER BY entity_type, b)) AS fingerprint FROM (
  SELECT topic_key, entity_type, r // 10000 AS b, sha256(string_agg('|' || r || ':' || d, '' ORDER BY r)) AS d FROM (
    SELECT topic_key, entity_type, entity_id // 10000 AS r, sha256(string_agg('|' || entity_id, '' ORDER BY entity_id)) AS d
    FROM q_units GROUP BY 1, 2, 3) GROUP BY 1, 2, 3) GROUP BY topic_key"""
ref.VIEWS["q_fingerprints"] = FINGERPRINT


def _stored(spark, d):
    """The stored suggestions, plus one for every cluster with a member count divisible by three."""
    units = _units(spark, d)
    prints = clusters.cluster_fingerprints(units).join(clusters.topic_clusters(units), "topic_key")
    known = prints.where("member_count % 3 = 0").select(F.col("fingerprint").alias("group_fingerprint"))
    stored = rel.suggestions(spark, d).select("id", "group_fingerprint")
    return stored.unionByName(known.withColumn("id", F.lit(0).cast("long")))


@query("not_exists_anti", """SELECT c.topic_key, c.member_count, f.fingerprint FROM q_clusters c JOIN q_fingerprints f USING (topic_key)
WHERE c.member_count % 3 <> 0""")
def not_exists_anti(spark, d):
    units = _units(spark, d)
    found = clusters.topic_clusters(units).join(clusters.cluster_fingerprints(units), "topic_key")
    return themes.without_stored(found, _stored(spark, d)).select("topic_key", "member_count", "fingerprint")


@query("decision_membership", """SELECT original_input_id AS owner_id,
  CAST(sum(CASE WHEN segment_order = 0 AND original_input_id % 3 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS duplicated,
  CAST(max(CASE WHEN original_input_id % 5 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS unknown,
  CAST(sum(CASE WHEN segment_order = 1 AND original_input_id % 4 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS missing
FROM q_segments GROUP BY 1""")
def decision_membership(spark, d):
    supplied = rel.segments(spark, d).select(
        F.col("original_input_id").alias("owner_id"), F.col("id").alias("member_id"), "segment_order")
    kept = supplied.where("NOT (segment_order = 1 AND owner_id % 4 = 1)")
    twice = supplied.where("segment_order = 0 AND owner_id % 3 = 1")
    foreign = supplied.where("segment_order = 0 AND owner_id % 5 = 1").withColumn("member_id", -F.col("member_id") - 1)
    returned = kept.union(twice).union(foreign).drop("segment_order")
    return topics.decision_membership(returned, supplied.drop("segment_order"))


# ---- graph ------------------------------------------------------------------------------------

@query("resolve_roots", "SELECT theme_id, root_id FROM q_roots")
def resolve_roots(spark, d):
    return graph.resolve_roots(rel.themes(spark, d))


@query("root_deltas", "SELECT theme_id, root_id FROM q_roots")
def root_deltas(spark, d):
    """Themes arrive in two batches, and of the pointers of the first half only a third with them: the others are merges of the second."""
    folder, themes_ = work_folder(spark), cut_lineage(rel.themes(spark, d).select("id", "merged_into_id"))
    early = F.col("id") % 2 == 0
    first = themes_.where(early).withColumn("merged_into_id", F.when(F.col("id") % 3 == 0, F.col("merged_into_id")))
    later = themes_.where(~early | ((F.col("id") % 3 != 0) & F.col("merged_into_id").isNotNull()))
    for version, batch in enumerate((first, later)):
        root_state.update_roots(batch, folder, version)
    return root_state.read_roots(spark, folder)


@query("unresolved_ids", "SELECT id AS theme_id FROM q_themes WHERE id NOT IN (SELECT theme_id FROM q_roots)")
def unresolved_ids(spark, d):
    base = rel.themes(spark, d)
    return graph.unresolved_ids(base.select(F.col("id").alias("theme_id")), graph.resolve_roots(base))


@query("compress_aliases", """SELECT t.id, t.name, CASE WHEN r.root_id IS NULL THEN t.merged_into_id WHEN r.root_id <> t.id THEN r.root_id END AS merged_into_id
FROM q_themes t LEFT JOIN q_roots r ON r.theme_id = t.id""")
def compress_aliases(spark, d):
    base = rel.themes(spark, d)
    return graph.compress_aliases(base, graph.resolve_roots(base)).select("id", "name", "merged_into_id")


ref.VIEWS["q_merge_edges"] = """
SELECT x AS a, y AS b FROM (
  SELECT r1.root_id AS x, r2.root_id AS y FROM (SELECT existing_theme_ids AS e FROM q_suggestions WHERE action = 'merge')
  CROSS JOIN unnest([1, 2]) u(i) JOIN q_roots r1 ON r1.theme_id = e[i] JOIN q_roots r2 ON r2.theme_id = e[i + 1])"""
ref.VIEWS["q_edge_nodes"] = "SELECT a AS node FROM q_merge_edges UNION SELECT b FROM q_merge_edges"
ref.VIEWS["q_reach"] = """
SELECT node, node AS other FROM q_edge_nodes
UNION SELECT p.node, CASE WHEN e.a = p.other THEN e.b ELSE e.a END
FROM q_reach p JOIN q_merge_edges e ON e.a = p.other OR e.b = p.other"""


@query("merge_components", "SELECT node, min(other) AS component FROM q_reach GROUP BY node")
def merge_components(spark, d):
    roots = cut_lineage(graph.resolve_roots(rel.themes(spark, d)))
    ids = rel.suggestions(spark, d).where("action = 'merge'").select(
        F.explode(F.array(*[F.struct(F.col("existing_theme_ids")[i].alias("x"), F.col("existing_theme_ids")[i + 1].alias("y"))
                            for i in (0, 1)])).alias("e")).select("e.*")
    left = roots.select(F.col("theme_id").alias("x"), F.col("root_id").alias("a"))
    right = roots.select(F.col("theme_id").alias("y"), F.col("root_id").alias("b"))
    return graph.merge_components(ids.join(left, "x").join(right, "y").select("a", "b"))


# ---- aggregations -----------------------------------------------------------------------------

USAGE = """SELECT topic, sum(n) AS usage_count FROM (
  SELECT topic, count(*) AS n FROM q_segments GROUP BY ALL UNION ALL SELECT topic, count(*) FROM q_inputs GROUP BY ALL)
GROUP BY topic HAVING length(trim(topic)) > 0"""
ref.VIEWS["q_usage"] = USAGE


@query("topic_usage", "SELECT topic, CAST(usage_count AS BIGINT) AS usage_count FROM q_usage")
def topic_usage(spark, d):
    return topics.topic_usage(rel.inputs(spark, d), rel.segments(spark, d))


@query("topk_global", "SELECT topic, usage_count FROM q_usage ORDER BY usage_count DESC, lower(topic), topic LIMIT 50")
def topk_global(spark, d):
    return topics.topic_usage(rel.inputs(spark, d), rel.segments(spark, d), 50)


@query("most_used", "SELECT topic, usage_count FROM q_usage ORDER BY usage_count DESC, lower(topic), topic LIMIT 20")
def most_used(spark, d):
    return topics.most_used(rel.inputs(spark, d), rel.segments(spark, d), 20)


@query("topic_clusters", "SELECT topic_key, topic_name, member_count, rich_member_count, distinct_question_count FROM q_clusters")
def topic_clusters(spark, d):
    return clusters.topic_clusters(_units(spark, d))


@query("ordered_distinct_questions", """SELECT topic_key, row_number() OVER (PARTITION BY topic_key ORDER BY f) - 1 AS pos, question_text
FROM (SELECT topic_key, question_text, min((entity_type, entity_id)) AS f FROM q_units
      WHERE question_id IS NOT NULL AND question_text IS NOT NULL GROUP BY 1, 2)""")
def ordered_distinct_questions(spark, d):
    return clusters.distinct_questions(_units(spark, d, wording=True))


@query("eligible_clusters", """SELECT topic_key, member_count, rich_member_count, distinct_question_count FROM q_clusters
WHERE rich_member_count >= 2 OR (rich_member_count = 0 AND distinct_question_count >= 3)""")
def eligible_clusters(spark, d):
    return clusters.eligible(clusters.topic_clusters(_units(spark, d))).drop("topic_name")


@query("cluster_fingerprint", "SELECT topic_key, fingerprint FROM q_fingerprints")
def cluster_fingerprint(spark, d):
    return clusters.cluster_fingerprints(_units(spark, d))


def _ranked(spark, d, units=None):
    found = clusters.topic_clusters(units if units is not None else _units(spark, d))
    return themes.rank_existing_themes(found, rel.themes(spark, d), rel.theme_topics(spark, d))


@query("existing_themes_ranked", "SELECT topic_key, rank, theme_id, name, relevance FROM q_ranked")
def existing_themes_ranked(spark, d):
    return _ranked(spark, d).drop("description")


@query("filtered_aggs", """SELECT t.id AS theme_id, count(l.topic) AS topics, count(*) FILTER (WHERE lower(l.topic) LIKE 'src%') AS source_topics,
  min(l.topic) FILTER (WHERE l.topic LIKE 'TOPIC%') AS first_upper
FROM q_themes t LEFT JOIN q_theme_topics l ON l.theme_id = t.id WHERE t.merged_into_id IS NULL GROUP BY 1""")
def filtered_aggs(spark, d):
    live = rel.themes(spark, d).where("merged_into_id IS NULL").select(F.col("id").alias("theme_id"))
    linked = live.join(rel.theme_topics(spark, d), "theme_id", "left")
    return linked.groupBy("theme_id").agg(
        F.count("topic").alias("topics"),
        F.count_if(F.lower("topic").like("src%")).alias("source_topics"),
        F.min(F.when(F.col("topic").like("TOPIC%"), F.col("topic"))).alias("first_upper"))


@query("theme_topic_list", """SELECT theme_id, pos, topic FROM (
  SELECT l.theme_id, row_number() OVER (PARTITION BY l.theme_id ORDER BY lower(l.topic), l.topic) - 1 AS pos, l.topic
  FROM q_theme_topics l JOIN q_themes t ON t.id = l.theme_id WHERE t.merged_into_id IS NULL
  UNION ALL SELECT id, NULL, NULL FROM q_themes WHERE merged_into_id IS NULL AND id NOT IN (SELECT theme_id FROM q_theme_topics))""")
def theme_topic_list(spark, d):
    return themes.theme_topic_list(rel.themes(spark, d), rel.theme_topics(spark, d))


@query("input_results", """SELECT i.id, q.form_key, q.question_key, i.submission_key, i.status, i.topic, coalesce(s.n, 0) AS segments,
  coalesce(e.n, 0) AS embeddings, e.tags AS embedding_representations
FROM q_inputs i LEFT JOIN q_questions q ON q.id = i.question_id
LEFT JOIN (SELECT original_input_id AS id, count(DISTINCT id) AS n FROM q_segments GROUP BY 1) s ON s.id = i.id
LEFT JOIN (SELECT input_id AS id, count(DISTINCT embedding_id) AS n,
    string_agg(DISTINCT embedding_representation, ',' ORDER BY embedding_representation) AS tags
  FROM (SELECT e.original_input_id AS input_id, e.id AS embedding_id, e.embedding_representation FROM q_embeddings e
        WHERE e.original_input_id IS NOT NULL
        UNION ALL SELECT s.original_input_id, e.id, e.embedding_representation
        FROM q_embeddings e JOIN q_segments s ON s.id = e.segment_input_id) GROUP BY 1) e ON e.id = i.id""")
def input_results(spark, d):
    rows = reports.input_results(
        rel.inputs(spark, d), rel.questions(spark, d), rel.segments(spark, d), rel.embeddings(spark, d))
    tags = F.array_join("embedding_representations", ",")
    return rows.drop("original_text").withColumn("embedding_representations", tags)


@query("theme_convergence", """SELECT q.source, q.form_key, l.theme_id, count(DISTINCT lower(t.topic)) AS topics
FROM q_input_topics t JOIN q_inputs i ON i.id = t.input_id JOIN q_questions q ON q.id = i.question_id
JOIN q_theme_topics l ON lower(l.topic) = lower(t.topic) GROUP BY 1, 2, 3 HAVING count(DISTINCT lower(t.topic)) >= 2""")
def theme_convergence(spark, d):
    return reports.theme_convergence(
        rel.inputs(spark, d), rel.segments(spark, d), rel.questions(spark, d), rel.theme_topics(spark, d))


@query("queue_summary", "SELECT job_type, status, count(*) AS jobs FROM q_jobs GROUP BY 1, 2")
def queue_summary(spark, d):
    return jobs.queue_summary(rel.jobs(spark, d))


@query("distinct_question_versions", """SELECT q.source, q.form_key, q.question_key, count(DISTINCT q.question_version) AS versions,
  count(DISTINCT i.question_id) AS answered_questions, count(i.id) AS answers
FROM q_questions q LEFT JOIN q_inputs i ON i.question_id = q.id GROUP BY 1, 2, 3""")
def distinct_question_versions(spark, d):
    return reports.question_versions(rel.inputs(spark, d), rel.questions(spark, d))


# ---- ordered logic, top-k ---------------------------------------------------------------------

ref.VIEWS["q_samples"] = """
SELECT topic_key, pos, text FROM (
  SELECT topic_key, text, row_number() OVER (PARTITION BY topic_key ORDER BY pass, entity_type, entity_id) AS pos
  FROM (SELECT *, CASE WHEN question_id IS NOT NULL AND row_number() OVER (
          PARTITION BY topic_key, question_id ORDER BY entity_type, entity_id) = 1 THEN 0 ELSE 1 END AS pass FROM q_units))
WHERE pos <= 5"""


@query("sample_evidence", "SELECT topic_key, pos, text FROM q_samples")
def sample_evidence(spark, d):
    return clusters.sample_evidence(_units(spark, d), 5)


ref.VIEWS["q_popular"] = """
SELECT topic, row_number() OVER (ORDER BY usage_count DESC, lower(topic), topic) AS place FROM q_usage
QUALIFY place <= 50"""
ref.VIEWS["q_offers"] = """
SELECT input_id, row_number() OVER (PARTITION BY input_id ORDER BY src, target, place) AS pos, topic, topic_key FROM (
  SELECT input_id, lower(topic) AS topic_key, arg_min(topic, (src, target, place)) AS topic,
    arg_min(src, (src, target, place)) AS src, arg_min(target, (src, target, place)) AS target,
    arg_min(place, (src, target, place)) AS place
  FROM (SELECT original_input_id AS input_id, 0 AS src, id AS target, 0 AS place, topic FROM q_segments WHERE topic IS NOT NULL
        UNION ALL SELECT i.id, 1, 0, p.place, p.topic FROM q_inputs i CROSS JOIN q_popular p) GROUP BY 1, 2)
QUALIFY pos <= 50"""


def _offers(spark, d):
    inputs, pieces = rel.inputs(spark, d), rel.segments(spark, d)
    evidence = pieces.where("topic IS NOT NULL").select(
        "original_input_id", F.lit("segment").alias("target_type"), F.col("id").alias("target_id"),
        F.lit(1).cast("long").alias("rank"), "topic")
    return topics.existing_topics(inputs, evidence, topics.topic_usage(inputs, pieces, 50), 50)


@query("unique_topics", "SELECT input_id, pos, topic FROM q_offers")
def unique_topics(spark, d):
    listed = _offers(spark, d).select("input_id", F.posexplode("topics").alias("pos", "topic"))
    return listed.withColumn("pos", (F.col("pos") + 1).cast("long"))


@query("segment_order", """SELECT doc_id AS original_input_id, o AS segment_order, ls[o + 1] AS segment_text
FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS o FROM q_lines WHERE len(ls) >= 2 AND len(list_distinct(ls)) = len(ls))""")
def segment_order(spark, d):
    decided = seg.apply_segmentation(providers.split_lines(rel.inputs(spark, d)))
    return decided.segments.withColumn("segment_order", F.col("segment_order").cast("long"))


@query("first_seen_name", "SELECT lower(topic) AS topic_key, arg_min(topic, id) AS topic FROM q_inputs WHERE topic IS NOT NULL GROUP BY 1")
def first_seen_name(spark, d):
    named = rel.inputs(spark, d).where("topic IS NOT NULL").groupBy(
        "topic", tx.casefold(F.col("topic")).alias("topic_key")).agg(F.min("id").alias("id"))
    return ordered.first_per_key(named, ["topic_key"], [F.col("id")]).select("topic_key", "topic")


HISTORY = """CASE event_id % 7 WHEN 0 THEN 'new' WHEN 1 THEN 'ready_for_embedding' WHEN 2 THEN 'ready_for_embedding'
  WHEN 3 THEN 'ready_for_analysis' WHEN 4 THEN 'completed' WHEN 5 THEN 'completed' ELSE 'ineligible' END"""


@query("status_transitions", f"""SELECT input_id, version, previous_status, status,
  CASE status WHEN 'new' THEN 'eligibility_segmentation' WHEN 'ready_for_embedding' THEN 'embeddings'
    WHEN 'ready_for_analysis' THEN 'topics' WHEN 'completed' THEN 'themes' END AS job_type
FROM (SELECT input_id, version, status, lag(status) OVER (PARTITION BY input_id ORDER BY version) AS previous_status
      FROM (SELECT user_id AS input_id, event_id AS version, {HISTORY} AS status FROM events))
WHERE status IS DISTINCT FROM previous_status""")
def status_transitions(spark, d):
    history = rel.read(spark, d, "events").select(
        F.col("user_id").alias("input_id"), F.col("event_id").alias("version"), F.expr(HISTORY).alias("status"))
    return jobs.status_transitions(history)


@query("lease_expired", f"""SELECT id, job_type, original_input_id, locked_by FROM q_jobs
WHERE status = 'processing' AND locked_at < {ref.AS_OF} - INTERVAL 300 SECONDS""")
def lease_expired(spark, d):
    return jobs.lease_expired(rel.jobs(spark, d), rel.as_of()).select("id", "job_type", "original_input_id", "locked_by")


PAGE = intake.check_scope(offset=10, limit=50)


@query("paginate", "SELECT id, source, status FROM q_inputs ORDER BY id LIMIT 50 OFFSET 10")
def paginate(spark, d):
    return reports.page(rel.inputs(spark, d).select("id", "source", "status"), PAGE)


@query("topk_per_group", """SELECT topic_key, rank, entity_type, entity_id FROM (
  SELECT topic_key, entity_type, entity_id, row_number() OVER (PARTITION BY topic_key ORDER BY length(text) DESC, entity_type, entity_id) AS rank
  FROM q_units) WHERE rank <= 3""")
def topk_per_group(spark, d):
    longest = _units(spark, d).select("topic_key", "entity_type", "entity_id", F.char_length("text").alias("n"))
    return ordered.first_rows(longest, ["topic_key"], [F.desc("n"), "entity_type", "entity_id"], 3).drop("n")


@query("nulls_first_sort", f"""SELECT id, {ref.stamp('materialized_at')} AS materialized_at FROM q_suggestions ORDER BY materialized_at NULLS FIRST, id""")
def nulls_first_sort(spark, d):
    return reports.suggestion_status(rel.suggestions(spark, d)).orderBy(
        F.col("materialized_at").asc_nulls_first(), "id").select("id", stamp("materialized_at"))


# ---- set operations ---------------------------------------------------------------------------

@query("analysis_units", """SELECT entity_type, entity_id, original_input_id, topic, topic_key, question_id, question_text, length(text) AS chars FROM q_units""")
def analysis_units(spark, d):
    return _units(spark, d, wording=True).withColumn("chars", F.char_length("text").cast("long")).drop("text")


@query("input_topics", "SELECT input_id, topic FROM q_input_topics")
def input_topics(spark, d):
    return reports.input_topics(rel.inputs(spark, d), rel.segments(spark, d))


@query("id_difference", """SELECT DISTINCT g.id, u.x AS theme_id FROM (SELECT id, unnest(existing_theme_ids) AS x FROM q_suggestions) u
JOIN q_suggestions g ON g.id = u.id WHERE u.x NOT IN (SELECT id FROM q_themes WHERE merged_into_id IS NULL)""")
def id_difference(spark, d):
    named = rel.suggestions(spark, d).select("id", F.explode("existing_theme_ids").alias("theme_id"))
    live = rel.themes(spark, d).where("merged_into_id IS NULL").select(F.col("id").alias("theme_id"))
    return named.distinct().join(live, "theme_id", "left_anti").select("id", "theme_id")


# ---- decisions --------------------------------------------------------------------------------

def _segmentation_responses(spark, d):
    """Model responses for every document, some fenced, some breaking a rule."""
    lines = F.filter(F.transform(F.split("text", "\n"), tx.strip), lambda x: x != "")
    labels = rel.read(spark, d, "labels")
    judged = rel.read(spark, d, "documents").join(labels, "doc_id", "left").select(
        "doc_id", lines.alias("l"),
        F.expr("coalesce(quality, 1) = 1 AND coalesce(toxic, 0) = 0").alias("eligible"))
    pieces = F.expr("CASE WHEN eligible OR doc_id % 10 = 3 THEN l ELSE CAST(array() AS ARRAY<STRING>) END")
    body = F.to_json(F.struct("eligible", pieces.alias("segments")))
    said = (F.when(F.expr("doc_id % 29 = 0"), F.lit("I cannot tell."))
            .when(F.expr("doc_id % 4 = 0"), F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body))
    return judged.select(F.col("doc_id").alias("input_id"), said.alias("response"))


ref.VIEWS["q_segmented"] = """
SELECT doc_id AS input_id, eligible, pieces, CASE WHEN doc_id % 29 = 0 THEN 'no_json_object'
  WHEN NOT eligible AND len(pieces) > 0 THEN 'ineligible_with_segments' WHEN len(pieces) = 1 THEN 'single_segment'
  WHEN len(list_distinct(pieces)) < len(pieces) THEN 'repeated_segment' END AS error_code
FROM (SELECT doc_id, coalesce(quality, 1) = 1 AND coalesce(toxic, 0) = 0 AS eligible,
        CASE WHEN (coalesce(quality, 1) = 1 AND coalesce(toxic, 0) = 0) OR doc_id % 10 = 3 THEN ls ELSE [] END AS pieces
      FROM q_lines LEFT JOIN labels USING (doc_id))"""


@query("segmentation_decisions", """SELECT input_id, error_code,
  CASE WHEN error_code IS NULL THEN CASE WHEN eligible THEN 'ready_for_embedding' ELSE 'ineligible' END END AS status,
  CASE WHEN error_code IS NULL AND eligible THEN len(pieces) ELSE 0 END AS segments FROM q_segmented""")
def segmentation_decisions(spark, d):
    decided = seg.apply_segmentation(_segmentation_responses(spark, d))
    counted = decided.segments.groupBy(F.col("original_input_id").alias("input_id")).agg(F.count(F.lit(1)).alias("segments"))
    good = decided.status_updates.join(counted, "input_id", "left").select(
        "input_id", F.lit(None).cast("string").alias("error_code"), "status",
        F.coalesce("segments", F.lit(0)).cast("long").alias("segments"))
    bad = decided.rejects.select(
        "input_id", "error_code", F.lit(None).cast("string").alias("status"), F.lit(0).cast("long").alias("segments"))
    return good.union(bad)


@query("answered_segmentation", """SELECT i.id AS input_id, CASE WHEN len(ls) >= 2 AND len(list_distinct(ls)) = len(ls) THEN len(ls) ELSE 0 END AS segments
FROM q_inputs i JOIN q_lines l ON l.doc_id = i.id""")
def answered_segmentation(spark, d):
    """Segments from a model's answers: the even inputs first, then all, of which known answers are not asked again."""
    prompts = providers.segmentation_prompts(rel.inputs(spark, d))
    _, results = providers.answer_once(prompts.where("prompt_id % 2 = 0"), "offline", providers.line_model)
    said, _ = providers.answer_once(prompts, "offline", providers.line_model, results)
    decided = seg.apply_segmentation(said.select(F.col("prompt_id").alias("input_id"), "response"))
    counted = decided.segments.groupBy(F.col("original_input_id").alias("input_id")).agg(F.count(F.lit(1)).alias("segments"))
    return decided.status_updates.select("input_id").join(counted, "input_id", "left").fillna(0, ["segments"])


def _vector_context(spark, d):
    found = neighbors.knn_evidence(rel.vector_targets(spark, d), rel.vector_evidence(spark, d), 5)
    texts = rel.vectors(spark, d).select("segment_id", "segment_text")
    wording = F.when(F.col("question_id").isNotNull(), F.concat(F.lit("Question "), F.col("question_id")))
    asked = rel.vector_targets(spark, d).select(
        F.col("target_type").alias("entity_type"), F.col("target_id").alias("entity_id"),
        "original_input_id", "text", wording.alias("question_text"))
    return topics.topic_context(asked, found.join(texts, "segment_id"))


@query("topic_context", """SELECT v.segment_id AS entity_id, v.original_input_id, count(t.rank) AS evidence,
  coalesce(string_agg(t.segment_id || ':' || t.scope, ',' ORDER BY t.rank), '') AS listed
FROM q_vectors v LEFT JOIN q_tiered t ON t.target_id = v.segment_id GROUP BY 1, 2""")
def topic_context(spark, d):
    listed = F.transform("similar_segments", lambda s: F.concat(s["segment_id"], F.lit(":"), s["scope"]))
    return _vector_context(spark, d).select(
        "entity_id", "original_input_id",
        F.coalesce(F.size("similar_segments"), F.lit(0)).cast("long").alias("evidence"),
        F.coalesce(F.array_join(listed, ","), F.lit("")).alias("listed"))


TOPIC_PROMPT = """targets array<struct<kind: string, id: bigint, text: string, question_text: string, similar_segments: array<struct<
  segment_id: bigint, text: string, topic: string, similarity: double, scope: string>>>>, existing_topics array<string>"""


@query("topic_prompts", """SELECT v.original_input_id AS prompt_id, 'segment' AS kind, v.segment_id AS entity_id, v.segment_text AS text,
  CASE WHEN v.question_id IS NOT NULL THEN 'Question ' || v.question_id END AS question_text, o.offered,
  coalesce(string_agg(t.segment_id || ':' || t.topic || ':' || t.scope || ':' || e.segment_text, '|' ORDER BY t.rank), '') AS similar
FROM q_vectors v JOIN (SELECT input_id, string_agg(topic, '|' ORDER BY pos) AS offered FROM q_offers GROUP BY 1) o ON o.input_id = v.original_input_id
LEFT JOIN q_tiered t ON t.target_id = v.segment_id LEFT JOIN q_vectors e ON e.segment_id = t.segment_id GROUP BY ALL""")
def topic_prompts(spark, d):
    """Prompts read back into one row for each target."""
    prompts = topics.topic_prompts(_vector_context(spark, d), _offers(spark, d))
    rows = prompts.select("prompt_id", F.from_json("prompt", TOPIC_PROMPT).alias("p")).select("prompt_id", F.explode("p.targets").alias("t"), "p.existing_topics")
    similar = F.transform("t.similar_segments", lambda s: F.concat_ws(":", s["segment_id"].cast("string"), s["topic"], s["scope"], s["text"]))
    return rows.select("prompt_id", "t.kind", F.col("t.id").alias("entity_id"), "t.text", "t.question_text",
                       F.array_join("existing_topics", "|").alias("offered"), F.array_join(similar, "|").alias("similar"))


def _topic_responses(spark, d):
    """A response per analysed input: reused, respelt, new and unknown names, missing and doubled segments."""
    inputs = rel.inputs(spark, d).where("status IN ('completed', 'ready_for_analysis')").select("id")
    name = "CASE id % 6 WHEN 0 THEN 'general' WHEN 1 THEN concat('Fresh ', id) WHEN 2 THEN concat('Unknown ', id) ELSE 'TOPIC 1' END"
    original = F.struct(F.expr(name).alias("name"), F.expr("id % 6 IN (0, 2) AND id % 12 <> 8").alias("reused_existing"))
    choice = F.struct(F.expr("concat(' TOPIC ', segment_id % 9)").alias("name"), F.lit(False).alias("reused_existing"))
    pieces = rel.segments(spark, d).select(
        F.col("original_input_id"), F.col("id").alias("segment_id"), "segment_order")
    said = pieces.where("NOT (segment_order = 0 AND original_input_id % 13 = 0)").union(
        pieces.where("segment_order = 0 AND original_input_id % 17 = 0"))
    listed = said.groupBy(F.col("original_input_id").alias("id")).agg(
        F.collect_list(F.struct("segment_id", choice.alias("topic"))).alias("segment_topics"))
    body = F.to_json(F.struct(original.alias("original_topic"), "segment_topics"))
    return inputs.join(listed, "id", "left").select(F.col("id").alias("input_id"), body.alias("response"))


ref.VIEWS["q_choices"] = """
SELECT id AS input_id, 'original' AS entity_type, id AS entity_id,
  CASE id % 6 WHEN 0 THEN 'general' WHEN 1 THEN 'Fresh ' || id WHEN 2 THEN 'Unknown ' || id ELSE 'TOPIC 1' END AS name,
  id % 6 IN (0, 2) AND id % 12 <> 8 AS reused FROM q_inputs WHERE status IN ('completed', 'ready_for_analysis')
UNION ALL SELECT s.original_input_id, 'segment', s.id, 'TOPIC ' || (s.id % 9), false
FROM q_segments s JOIN q_inputs i ON i.id = s.original_input_id AND i.status IN ('completed', 'ready_for_analysis')"""
ref.VIEWS["q_choice_errors"] = """
SELECT i.id AS input_id, CASE WHEN max(s.id) IS NOT NULL AND i.id % 17 = 0 AND i.id % 13 <> 0 THEN 'duplicate_segment'
    WHEN max(s.id) IS NOT NULL AND i.id % 13 = 0 THEN CASE WHEN i.id % 17 = 0 THEN NULL ELSE 'segment_mismatch' END END AS shape,
  CASE WHEN bool_or(c.reused AND o.topic IS NULL) THEN 'unknown_reused_topic' END AS unknown
FROM q_inputs i LEFT JOIN q_segments s ON s.original_input_id = i.id
JOIN q_choices c ON c.input_id = i.id AND c.entity_type = 'original'
LEFT JOIN q_offers o ON o.input_id = i.id AND o.topic_key = lower(c.name)
WHERE i.status IN ('completed', 'ready_for_analysis') GROUP BY i.id"""


@query("topic_decisions", """SELECT c.input_id, c.entity_type, c.entity_id, coalesce(o.topic, c.name) AS topic, NULL::VARCHAR AS error_code
FROM q_choices c JOIN q_choice_errors e ON e.input_id = c.input_id AND e.shape IS NULL AND e.unknown IS NULL
LEFT JOIN q_offers o ON o.input_id = c.input_id AND o.topic_key = lower(c.name)
UNION ALL SELECT input_id, NULL, NULL, NULL, coalesce(shape, unknown) FROM q_choice_errors WHERE shape IS NOT NULL OR unknown IS NOT NULL""")
def topic_decisions(spark, d):
    outcome = topics.apply_topics(rel.segments(spark, d), _topic_responses(spark, d), _offers(spark, d))
    good = outcome.topics.select(
        F.col("original_input_id").alias("input_id"), "entity_type", "entity_id", "topic",
        F.lit(None).cast("string").alias("error_code"))
    none = F.lit(None)
    bad = outcome.rejects.select(
        "input_id", none.cast("string").alias("entity_type"), none.cast("long").alias("entity_id"),
        none.cast("string").alias("topic"), "error_code")
    return good.union(bad)


VOTES = """SELECT target_id, topic, score FROM (
  SELECT target_id, topic, round(sum(s), 6) AS score, row_number() OVER (
    PARTITION BY target_id ORDER BY round(sum(s), 9) DESC, lower(topic)) AS rank
  FROM (SELECT t.target_id, t.topic, 1 - p.distance AS s FROM q_tiered t
        JOIN q_pairs p ON p.target_id = t.target_id AND p.segment_id = t.segment_id) GROUP BY target_id, topic) WHERE rank = 1"""
ref.VIEWS["q_votes"] = VOTES


@query("topic_vote", "SELECT target_id, topic, score FROM q_votes")
def topic_vote(spark, d):
    found = neighbors.knn_evidence(rel.vector_targets(spark, d), rel.vector_evidence(spark, d), 5)
    return neighbors.topic_vote(found).select("target_id", "topic", F.round("score", 6).alias("score"))


def _theme_inputs(spark, d, wording=False):
    units = _units(spark, d, wording)
    # Both are one row per topic or a few, and several steps read them again.
    found = cut_lineage(clusters.eligible(clusters.topic_clusters(units)))
    offered = cut_lineage(themes.rank_existing_themes(found, rel.themes(spark, d), rel.theme_topics(spark, d)))
    return units, found, offered


ELIGIBLE = "(rich_member_count >= 2 OR (rich_member_count = 0 AND distinct_question_count >= 3))"
ref.VIEWS["q_eligible"] = f"SELECT * FROM q_clusters WHERE {ELIGIBLE}"


CONTEXT = """SELECT topic_key, 'topic' AS part, 0::BIGINT AS pos, topic_name AS item FROM q_eligible
UNION ALL SELECT topic_key, 'member_count', 0, member_count::VARCHAR FROM q_eligible
UNION ALL SELECT topic_key, 'question', row_number() OVER (PARTITION BY topic_key ORDER BY f) - 1, question_text
  FROM (SELECT topic_key, question_text, min((entity_type, entity_id)) AS f FROM q_units JOIN q_eligible USING (topic_key)
        WHERE question_id IS NOT NULL AND question_text IS NOT NULL GROUP BY 1, 2)
UNION ALL SELECT topic_key, 'evidence', pos - 1, text FROM q_samples JOIN q_eligible USING (topic_key)
UNION ALL SELECT topic_key, 'existing_theme', rank - 1,
  '{"id":' || theme_id || ',"name":"' || name || '","description":"' || description || '"}' FROM q_ranked JOIN q_eligible USING (topic_key)
UNION ALL SELECT r.topic_key, 'theme_topic', row_number() OVER (PARTITION BY r.topic_key ORDER BY r.rank, lower(l.topic), l.topic) - 1,
  '{"id":' || r.theme_id || ',"topic":"' || l.topic || '"}' FROM q_ranked r JOIN q_eligible USING (topic_key) JOIN q_theme_topics l USING (theme_id)"""
ref.VIEWS["q_context"] = CONTEXT


@query("theme_context", "SELECT topic_key, part, pos, item FROM q_context")
def theme_context(spark, d):
    units, found, offered = _theme_inputs(spark, d, wording=True)
    return themes.theme_context(
        found, clusters.distinct_questions(units), clusters.sample_evidence(units), offered, rel.theme_topics(spark, d))


PROMPT = """topic string, questions array<struct<question_text: string>>, sample_evidence array<string>, member_count bigint,
  existing_themes array<struct<id: bigint, name: string, description: string>>, theme_topics array<struct<id: bigint, topic: string>>"""


@query("theme_prompts", """SELECT topic_key AS prompt_id, CASE WHEN part IN ('question', 'theme_topic') THEN pos // 3 ELSE 0 END AS piece, part,
  CASE WHEN part IN ('question', 'theme_topic') THEN pos % 3 ELSE pos END AS place, item FROM q_context""")
def theme_prompts(spark, d):
    """Prompts in pieces of three questions or topics, read back into rows."""
    read = themes.theme_prompts(theme_context(spark, d), 3).select("prompt_id", "piece", F.from_json("prompt", PROMPT).alias("p"))
    json = lambda items: F.transform(items, lambda x: F.to_json(x, {"ignoreNullFields": "false"}))
    one = lambda item: F.when(item.isNotNull(), F.array(item.cast("string")))
    parts = F.create_map(*[part for name, items in (
        ("topic", one(F.col("p.topic"))), ("member_count", one(F.col("p.member_count"))), ("question", F.col("p.questions.question_text")),
        ("evidence", F.col("p.sample_evidence")), ("existing_theme", json(F.col("p.existing_themes"))), ("theme_topic", json(F.col("p.theme_topics"))),
    ) for part in (F.lit(name), items)])
    return read.select("prompt_id", "piece", F.explode(parts).alias("part", "items")).select(
        "prompt_id", "piece", "part", F.posexplode("items").alias("place", "item")).withColumn("place", F.col("place").cast("long"))


def _theme_responses(found, offered):
    """One decision per cluster, of every kind and every mistake."""
    pick = lambda n, c: F.max(F.when(F.col("rank") == n, F.col(c)))
    heads = offered.groupBy("topic_key").agg(
        pick(1, "theme_id").alias("a"), pick(2, "theme_id").alias("b"), pick(1, "name").alias("an"), pick(2, "name").alias("bn"))
    return found.join(heads, "topic_key").selectExpr(
        "topic_key", "member_count % 8 AS v", "topic_name", "a", "b", "an", "bn").selectExpr(
        "topic_key",
        "CASE v WHEN 0 THEN 'new' WHEN 1 THEN 'reuse' WHEN 2 THEN 'update' WHEN 3 THEN 'merge' WHEN 4 THEN 'new' WHEN 5 THEN 'merge' WHEN 6 THEN 'update' ELSE 'reuse' END AS action",
        "CAST(CASE v WHEN 0 THEN array() WHEN 3 THEN array(b, a) WHEN 4 THEN array() WHEN 7 THEN array(-1) ELSE array(a) END AS ARRAY<BIGINT>) AS existing_theme_ids",
        "CASE v WHEN 0 THEN concat('Brand new ', topic_name) WHEN 3 THEN lower(an) WHEN 4 THEN an WHEN 6 THEN bn ELSE concat('Updated ', topic_name) END AS proposed_name",
        "'What people say' AS proposed_description", "'Evidence' AS rationale",
        "CASE WHEN topic_key LIKE '%9' THEN array(upper(topic_name), 'Elsewhere') ELSE array(upper(topic_name)) END AS topics")


ref.VIEWS["q_decisions"] = """
SELECT topic_key, member_count % 8 AS v, topic_name,
  CASE WHEN topic_key LIKE '%9' THEN true ELSE false END AS foreign_topic,
  max(theme_id) FILTER (WHERE rank = 1) AS a, max(theme_id) FILTER (WHERE rank = 2) AS b
FROM q_eligible JOIN q_ranked USING (topic_key) GROUP BY 1, 2, 3, 4"""
ref.VIEWS["q_judged"] = """
SELECT *, CASE v WHEN 0 THEN 'new' WHEN 1 THEN 'reuse' WHEN 2 THEN 'update' WHEN 3 THEN 'merge' WHEN 4 THEN 'new'
    WHEN 5 THEN 'merge' WHEN 6 THEN 'update' ELSE 'reuse' END AS action,
  CASE v WHEN 4 THEN 'name_exists' WHEN 5 THEN 'needs_two_themes' WHEN 6 THEN 'name_of_unrelated_theme' WHEN 7 THEN 'unknown_theme'
    ELSE CASE WHEN foreign_topic THEN 'foreign_topic' END END AS error_code FROM q_decisions"""


@query("theme_decisions", "SELECT topic_key, topic_name, action, error_code FROM q_judged")
def theme_decisions(spark, d):
    _, found, offered = _theme_inputs(spark, d)
    decided = _theme_responses(found, offered)
    said = decided.select("topic_key", F.to_json(F.struct(*decided.columns[1:])).alias("response"))
    checked = themes.check_theme_decisions(themes.parse_theme_decisions(said), found, offered)
    return checked.select("topic_key", "topic_name", "action", "error_code")


@query("save_suggestions", """SELECT id, topic_key, action, fingerprint AS group_fingerprint,
  (SELECT count(*) FROM q_units u WHERE u.topic_key = s.topic_key) AS evidence
FROM (SELECT topic_key, action, fingerprint, (SELECT max(id) FROM q_suggestions) + row_number() OVER (ORDER BY topic_key) AS id
      FROM q_judged JOIN q_fingerprints USING (topic_key) JOIN q_clusters c USING (topic_key)
      WHERE error_code IS NULL AND c.member_count % 3 <> 0) s""")
def save_suggestions(spark, d):
    units, found, offered = _theme_inputs(spark, d)
    checked = themes.check_theme_decisions(_theme_responses(found, offered), found, offered)
    saved = themes.save_suggestions(checked, clusters.cluster_fingerprints(units), units, _stored(spark, d))
    pieces = saved.evidence.groupBy(F.col("suggestion_id").alias("id")).agg(F.count(F.lit(1)).alias("evidence"))
    return saved.suggestions.join(pieces, "id").select("id", "topic_key", "action", "group_fingerprint", "evidence")


# ---- theme state ------------------------------------------------------------------------------

def _state(spark, d):
    return theme_state.ThemeState(rel.themes(spark, d), rel.theme_topics(spark, d))


def _apply(spark, d, action=None):
    chosen = rel.suggestions(spark, d)
    if action is not None:
        chosen = chosen.where(F.col("action") == action)
    return theme_state.apply_suggestions(_state(spark, d), chosen, rel.as_of())


def _outcome(outcome):
    none = F.lit(None)
    return outcome.applied.select("suggestion_id", "theme_id", none.cast("string").alias("error_code")).union(
        outcome.rejects.select("suggestion_id", none.cast("long").alias("theme_id"), "error_code"))


ref.VIEWS["q_new"] = """
SELECT s.id, lower(s.proposed_name) AS k, t.id AS holder, t.merged_into_id IS NULL AS live
FROM q_suggestions s LEFT JOIN q_themes t ON lower(t.name) = lower(s.proposed_name)
WHERE s.action = 'new' AND s.materialized_at IS NULL"""


@query("apply_new", """SELECT n.id AS suggestion_id,
  CASE WHEN holder IS NULL THEN c.new_id WHEN live THEN holder END AS theme_id,
  CASE WHEN holder IS NOT NULL AND NOT live THEN 'name_held_by_alias' END AS error_code
FROM q_new n LEFT JOIN (SELECT k, (SELECT max(id) FROM q_themes) + row_number() OVER (ORDER BY min(id)) AS new_id
  FROM q_new WHERE holder IS NULL GROUP BY k) c ON c.k = n.k""")
def apply_new(spark, d):
    return _outcome(_apply(spark, d, "new"))


@query("apply_reuse", """SELECT theme_id, arg_min(topic, place) AS topic FROM (
  SELECT theme_id, topic, 0 AS place FROM q_theme_topics
  UNION ALL SELECT r.root_id, s.topics[1], s.id FROM q_suggestions s JOIN q_roots r ON r.theme_id = s.existing_theme_ids[1]
  WHERE s.action = 'reuse' AND s.materialized_at IS NULL) GROUP BY theme_id, lower(topic)""")
def apply_reuse(spark, d):
    return _apply(spark, d, "reuse").state.theme_topics


ref.VIEWS["q_updates"] = """
SELECT s.id, r.root_id, s.proposed_name, s.proposed_description FROM q_suggestions s
JOIN q_roots r ON r.theme_id = s.existing_theme_ids[1]
LEFT JOIN q_themes h ON lower(h.name) = lower(s.proposed_name)
WHERE s.action = 'update' AND s.materialized_at IS NULL AND (h.id IS NULL OR h.id = r.root_id)"""


@query("apply_update", f"""SELECT t.id, coalesce(u.name, t.name) AS name, coalesce(u.description, t.description) AS description,
  {ref.stamp(f"CASE WHEN u.root_id IS NULL THEN t.updated_at ELSE {ref.AS_OF} END")} AS updated_at
FROM q_themes t LEFT JOIN (SELECT root_id, arg_max(proposed_name, id) AS name, arg_max(proposed_description, id) AS description
  FROM q_updates GROUP BY 1) u ON u.root_id = t.id""")
def apply_update(spark, d):
    return _apply(spark, d, "update").state.themes.select("id", "name", "description", stamp("updated_at"))


ref.VIEWS["q_merges"] = """
SELECT s.id, list_sort([r.root_id FOR r IN l]) AS roots, s.proposed_name FROM (
  SELECT s.id, s.proposed_name, list(struct_pack(root_id := r.root_id)) AS l, count(*) AS found, max(len(s.existing_theme_ids)) AS wanted
  FROM (SELECT id, proposed_name, existing_theme_ids, unnest(existing_theme_ids) AS x FROM q_suggestions
        WHERE action = 'merge' AND materialized_at IS NULL) s JOIN q_roots r ON r.theme_id = s.x GROUP BY 1, 2) s
WHERE found = wanted"""
ref.VIEWS["q_joined"] = """
SELECT DISTINCT roots[1] AS a, unnest(roots) AS b FROM q_merges"""
ref.VIEWS["q_joined_reach"] = """
SELECT DISTINCT b AS node, b AS other FROM q_joined
UNION SELECT p.node, CASE WHEN e.a = p.other THEN e.b ELSE e.a END
FROM q_joined_reach p JOIN q_joined e ON e.a = p.other OR e.b = p.other"""
ref.VIEWS["q_component"] = "SELECT node, min(other) AS winner FROM q_joined_reach GROUP BY node"


@query("apply_merge", """SELECT t.id, coalesce(c.winner, r.root_id) AS root_id,
  CASE WHEN t.id = coalesce(c.winner, r.root_id) THEN coalesce(m.name, t.name) END AS live_name
FROM q_themes t JOIN q_roots r ON r.theme_id = t.id LEFT JOIN q_component c ON c.node = r.root_id
LEFT JOIN (SELECT c.winner, arg_max(m.proposed_name, m.id) AS name FROM q_merges m JOIN q_component c ON c.node = m.roots[1]
  GROUP BY 1) m ON m.winner = t.id""")
def apply_merge(spark, d):
    after = _apply(spark, d, "merge").state.themes
    roots = graph.resolve_roots(after).withColumnRenamed("theme_id", "id")
    live = F.when(F.col("merged_into_id").isNull(), F.col("name"))
    return after.join(roots, "id").select("id", "root_id", live.alias("live_name"))


@query("replay_pending")
def replay_pending(spark, d):
    return _outcome(_apply(spark, d))


@query("organise_themes", """SELECT e.topic_key, CASE WHEN r.theme_id IS NULL THEN 'new' ELSE 'reuse' END AS action, coalesce(r.name, e.topic_name) AS theme,
  (SELECT count(*) FROM q_units u WHERE u.topic_key = e.topic_key) AS evidence
FROM q_eligible e LEFT JOIN (SELECT topic_key, theme_id, name FROM q_ranked WHERE rank = 1 AND relevance > 0) r USING (topic_key)
WHERE e.member_count % 3 <> 0""")
def organise_themes(spark, d):
    """The whole theme stage in two rounds: the theme that each new suggestion ended in, and its evidence."""
    units = cut_lineage(_units(spark, d))
    done = organise.organise_themes(units, _state(spark, d), _stored(spark, d), providers.suggest_themes, rel.as_of(), 2)
    pieces = done.evidence.groupBy(F.col("suggestion_id").alias("id")).agg(F.count(F.lit(1)).alias("evidence"))
    named = done.state.themes.select(F.col("id").alias("materialized_theme_id"), F.col("name").alias("theme"))
    return done.suggestions.join(named, "materialized_theme_id").join(pieces, "id").select("topic_key", "action", "theme", "evidence")


@query("link_topics", """SELECT theme_id, arg_min(topic, input_id) AS topic FROM (
  SELECT DISTINCT t.id AS theme_id, i.topic, i.id AS input_id FROM q_inputs i JOIN q_themes t ON t.id = 1 + i.id % (SELECT count(*) + 5 FROM customer) WHERE i.topic IS NOT NULL) o
WHERE NOT EXISTS (SELECT 1 FROM q_theme_topics l WHERE l.theme_id = o.theme_id AND lower(l.topic) = lower(o.topic))
GROUP BY theme_id, lower(topic)""")
def link_topics(spark, d):
    count = rel.read(spark, d, "customer").count() + 5  # a few of the themes offered to do not exist
    offered = rel.inputs(spark, d).where("topic IS NOT NULL").select(
        F.expr(f"1 + id % {count}").alias("theme_id"), "topic", F.col("id").alias("input_id"))
    known = rel.themes(spark, d).select(F.col("id").alias("theme_id"))
    return theme_state.link_topics(
        rel.theme_topics(spark, d), offered.join(known, "theme_id", "left_semi"), ["input_id"])


@query("mark_materialized", f"""SELECT s.id, CASE WHEN s.materialized_at IS NULL THEN r.root_id ELSE s.materialized_theme_id END AS materialized_theme_id,
  {ref.stamp(f"CASE WHEN s.materialized_at IS NULL AND r.root_id IS NOT NULL THEN {ref.AS_OF} ELSE s.materialized_at END")} AS materialized_at
FROM q_suggestions s LEFT JOIN q_roots r ON r.theme_id = s.existing_theme_ids[1]""")
def mark_materialized(spark, d):
    roots = graph.resolve_roots(rel.themes(spark, d)).withColumnsRenamed({"theme_id": "x", "root_id": "theme_id"})
    applied = rel.suggestions(spark, d).select(
        F.col("id").alias("suggestion_id"), F.try_element_at("existing_theme_ids", F.lit(1)).alias("x")
    ).join(roots, "x")
    marked = theme_state.mark_materialized(rel.suggestions(spark, d), applied, rel.as_of())
    return marked.select("id", "materialized_theme_id", stamp("materialized_at"))


# ---- read models ------------------------------------------------------------------------------

WHOLE = intake.check_scope(limit=None)


def _with_themes(spark, d, scope):
    long_rows(spark)  # an input of a topic of many themes has a long text of them, one without has none
    base = rel.themes(spark, d)
    rows = reports.inputs_with_themes(
        rel.inputs(spark, d), rel.segments(spark, d), rel.questions(spark, d), base,
        rel.theme_topics(spark, d), graph.resolve_roots(base), scope)
    shown = F.transform("themes", lambda t: F.concat_ws("|", t["id"].cast("string"), t["name"], t["description"]))
    return rows.select(
        "id", "original_text", "source", "status", "topic", "question_id", "submission_key", stamp("created_at"),
        F.col("question_context.form_key").alias("form_key"),
        F.col("question_context.question_key").alias("question_key"),
        F.col("question_context.question_version").alias("question_version"),
        F.col("question_context.question_text").alias("question_text"),
        F.array_join(shown, "; ").alias("themes"))


WITH_THEMES = f"""SELECT i.id, i.original_text, i.source, i.status, i.topic, i.question_id, i.submission_key,
  {ref.stamp('i.created_at')} AS created_at, q.form_key, q.question_key, q.question_version, q.question_text,
  coalesce(t.themes, '') AS themes
FROM q_inputs i LEFT JOIN q_questions q ON q.id = i.question_id
LEFT JOIN (SELECT input_id, string_agg(theme_id || '|' || name || '|' || description, '; ' ORDER BY lower(name), theme_id) AS themes
  FROM (SELECT DISTINCT s.input_id, tt.theme_id, tt.name, tt.description
        FROM q_input_topics s JOIN q_topic_themes tt ON tt.topic_key = lower(s.topic)) GROUP BY 1) t ON t.input_id = i.id"""


@query("inputs_with_themes", WITH_THEMES)
def inputs_with_themes(spark, d):
    """Flagship: the whole corpus with its questions and current themes (arrays shown as text)."""
    return _with_themes(spark, d, WHOLE)


@query("inputs_page", WITH_THEMES + """ WHERE q.source = 'src3' AND q.form_key = 'en-f0' ORDER BY i.id LIMIT 20 OFFSET 5""")
def inputs_page(spark, d):
    """One page of the listing within a source and form."""
    return _with_themes(spark, d, intake.check_scope(source="src3", form_key="en-f0", offset=5, limit=20))


@query("input_theme_links", """SELECT DISTINCT s.input_id, tt.theme_id, tt.name FROM q_input_topics s JOIN q_topic_themes tt ON tt.topic_key = lower(s.topic)""")
def input_theme_links(spark, d):
    base = rel.themes(spark, d)
    linked = reports.topic_themes(base, rel.theme_topics(spark, d), graph.resolve_roots(base))
    rows = reports.input_theme_links(rel.inputs(spark, d), rel.segments(spark, d), linked)
    return rows.select("input_id", F.col("theme.id").alias("theme_id"), F.col("theme.name").alias("name"))


ANSWERS = """SELECT q.source, q.form_key, q.question_key, q.question_version, q.question_text, i.id AS answer_id, i.submission_key,
  i.original_text, i.topic, i.status FROM q_questions q JOIN q_inputs i ON i.question_id = q.id"""


@query("answers_by_question", ANSWERS)
def answers_by_question(spark, d):
    return reports.answers(rel.inputs(spark, d), rel.questions(spark, d), WHOLE)


@query("answers_by_submission", ANSWERS + " WHERE i.submission_key IS NOT NULL")
def answers_by_submission(spark, d):
    return reports.answers_by_submission(rel.inputs(spark, d), rel.questions(spark, d), WHOLE)


@query("suggestion_status", f"""SELECT id, action, proposed_name, materialized_theme_id, {ref.stamp('materialized_at')} AS materialized_at,
  CASE WHEN materialized_at IS NULL THEN 'pending' ELSE 'materialized' END AS materialization_status FROM q_suggestions""")
def suggestion_status(spark, d):
    return reports.suggestion_status(rel.suggestions(spark, d)).withColumn("materialized_at", stamp("materialized_at"))


# Where the links of a topic end: live themes, or nothing for those whose theme leads nowhere.
ref.VIEWS["q_ends"] = """SELECT topic_key, theme_id, name AS theme_name FROM q_topic_themes
UNION SELECT lower(topic), NULL, NULL FROM q_theme_topics WHERE theme_id NOT IN (SELECT theme_id FROM q_roots)"""
ref.VIEWS["q_said"] = "SELECT input_id, topic, theme_id, theme_name FROM q_input_topics LEFT JOIN q_ends ON topic_key = lower(topic)"


@query("answer_topic_theme_chain", """SELECT source, form_key, question_key, question_version, submission_key, id AS answer_id, original_text, topic, theme_id, theme_name
FROM (SELECT i.id, i.original_text, i.submission_key, q.source, q.form_key, q.question_key, q.question_version
      FROM q_inputs i LEFT JOIN q_questions q ON i.question_id = q.id) LEFT JOIN q_said ON input_id = id""")
def answer_topic_theme_chain(spark, d):
    long_dictionaries(spark)  # a text comes with every theme of its topics
    base, links = rel.themes(spark, d), rel.theme_topics(spark, d)
    linked = reports.linked_or_dead(base, links, graph.resolve_roots(base))
    return reports.answer_topic_theme_chain(
        rel.inputs(spark, d), rel.segments(spark, d), rel.questions(spark, d), linked)


@query("segments_report", """SELECT s.original_input_id, i.source, q.form_key, q.question_key, s.segment_order, s.topic, s.segment_text
FROM q_segments s JOIN q_inputs i ON i.id = s.original_input_id LEFT JOIN q_questions q ON q.id = i.question_id""")
def segments_report(spark, d):
    return reports.segments_report(rel.inputs(spark, d), rel.questions(spark, d), rel.segments(spark, d))


@query("jobs_report", """SELECT j.original_input_id, i.source, j.id, j.job_type, j.status, j.attempts, j.last_error
FROM q_jobs j JOIN q_inputs i ON i.id = j.original_input_id""")
def jobs_report(spark, d):
    return reports.jobs_report(rel.inputs(spark, d), rel.jobs(spark, d))


@query("failed_jobs", "SELECT id, job_type, original_input_id, attempts, last_error FROM q_jobs WHERE status = 'failed'")
def failed_jobs(spark, d):
    return reports.failed_jobs(rel.jobs(spark, d))


@query("suggestions_by_source", """SELECT DISTINCT g.id, g.action, i.source,
  CASE WHEN g.materialized_at IS NULL THEN 'pending' ELSE 'materialized' END AS materialization_status
FROM q_suggestions g JOIN q_evidence e ON e.suggestion_id = g.id LEFT JOIN q_segments s ON s.id = e.segment_input_id
JOIN q_inputs i ON i.id = coalesce(e.original_input_id, s.original_input_id)""")
def suggestions_by_source(spark, d):
    rows = reports.suggestions_by_source(
        rel.suggestions(spark, d), rel.evidence(spark, d), rel.segments(spark, d), rel.inputs(spark, d))
    return rows.select("id", "action", "source", "materialization_status")


# ---- data quality, backfill, attempt log, providers, streams ----------------------------------

@query("constraint_report", ref.constraint_sql())
def constraint_report(spark, d):
    names = ("questions", "inputs", "segments", "embeddings", "themes", "theme_topics", "suggestions",
             "suggestion_themes", "suggestion_topics", "evidence", "jobs")
    return quality.constraint_report({name: getattr(rel, name)(spark, d) for name in names})


@query("immutable_report", """SELECT 'questions' AS table_name, 'kept' AS rule, count(*) FILTER (WHERE id % 37 = 0) AS violations FROM q_questions
UNION ALL SELECT 'questions', 'question_text_unchanged', count(*) FILTER (WHERE id % 37 <> 0 AND id % 5 = 1) FROM q_questions
UNION ALL SELECT 'questions', 'question_version_unchanged', 0 FROM q_questions WHERE id = (SELECT min(id) FROM q_questions)
UNION ALL SELECT 'inputs', 'kept', 0 FROM q_inputs WHERE id = (SELECT min(id) FROM q_inputs)
UNION ALL SELECT 'inputs', 'question_id_unchanged', count(*) FILTER (WHERE id % 29 = 0 AND question_id IS NOT NULL) FROM q_inputs""")
def immutable_report(spark, d):
    """What a later snapshot changed of what never changes: wordings, and the question of an input."""
    asked, given = rel.questions(spark, d), rel.inputs(spark, d).select("id", "question_id")
    later = asked.where("id % 37 <> 0").withColumn("question_text", F.expr("CASE WHEN id % 5 = 1 THEN upper(question_text) ELSE question_text END"))
    moved = given.withColumn("question_id", F.expr("CASE WHEN id % 29 = 0 THEN NULL ELSE question_id END"))
    report = quality.immutable_report(asked, later, "id", ["question_text", "question_version"]).withColumn("table_name", F.lit("questions"))
    return report.unionByName(quality.immutable_report(given, moved, "id", ["question_id"]).withColumn("table_name", F.lit("inputs")))


ref.VIEWS["q_waiting"] = """
SELECT i.id, e.embedding_model, e.dim FROM q_inputs i LEFT JOIN q_embeddings e ON e.original_input_id = i.id
WHERE i.status = 'ready_for_analysis'"""


@query("embedding_readiness", """SELECT id AS original_input_id, 'original' AS entity_type, id AS entity_id, 'missing_embedding' AS problem
FROM q_waiting WHERE embedding_model IS NULL
UNION ALL SELECT * FROM (SELECT s.original_input_id, 'segment', s.id, CASE WHEN e.id IS NULL THEN 'missing_embedding'
    WHEN e.embedding_model <> w.embedding_model THEN 'model_mismatch' WHEN e.dim <> w.dim THEN 'dimension_mismatch' END AS problem
  FROM q_waiting w JOIN q_segments s ON s.original_input_id = w.id LEFT JOIN q_embeddings e ON e.segment_input_id = s.id)
WHERE problem IS NOT NULL""")
def embedding_readiness(spark, d):
    return seg.embedding_readiness(rel.inputs(spark, d), rel.segments(spark, d), rel.embeddings(spark, d))


ref.VIEWS["q_accepted"] = """
SELECT r.*, q.id AS stored_id, q.question_text AS stored_text FROM q_checked r LEFT JOIN q_questions q
  ON q.id % 2 = 0 AND q.source = r.source AND q.form_key = r.form_key AND q.question_key = r.question_key
  AND q.question_version = r.question_version WHERE r.error_code IS NULL"""
ref.VIEWS["q_created"] = """
SELECT source, form_key, question_key, question_version, arg_min(question_text, record_id) AS question_text,
  (SELECT max(id) FROM q_questions WHERE id % 2 = 0) + row_number() OVER (ORDER BY min(record_id)) AS id
FROM q_accepted WHERE form_key IS NOT NULL AND stored_id IS NULL GROUP BY 1, 2, 3, 4"""


ref.VIEWS["q_resolved"] = """
SELECT a.record_id, coalesce(a.stored_id, c.id) AS question_id,
  coalesce(coalesce(a.stored_text, c.question_text) <> a.question_text, false) AS conflict
FROM q_accepted a LEFT JOIN q_created c ON c.source = a.source AND c.form_key = a.form_key AND c.question_key = a.question_key
  AND c.question_version = a.question_version"""


def _resolved(spark, d):
    stored = rel.questions(spark, d).where("id % 2 = 0")
    accepted = intake.clean_inputs(rel.raw_records(spark, d)).accepted
    accepted = accepted.withColumn("question_version", F.col("question_version").cast("long"))
    return intake.resolve_questions(accepted, stored)


@query("resolve_questions", "SELECT record_id, question_id, conflict FROM q_resolved")
def resolve_questions(spark, d):
    resolved = _resolved(spark, d)
    return resolved.records.select("record_id", "question_id", F.lit(False).alias("conflict")).union(
        resolved.conflicts.select("record_id", "question_id", F.lit(True).alias("conflict")))


@query("outcome_checks", """SELECT 'terminal_status' AS check_name, count(*) FILTER (WHERE status NOT IN ('completed', 'ineligible')) AS bad_rows FROM q_inputs
UNION ALL SELECT 'contextual_representation', count(*) FROM q_embeddings e JOIN q_inputs i ON i.id = e.original_input_id
  WHERE i.question_id IS NOT NULL AND e.embedding_representation <> 'question-answer'
UNION ALL SELECT 'generic_representation', count(*) FROM q_embeddings e JOIN q_inputs i ON i.id = e.original_input_id
  WHERE i.question_id IS NULL AND e.embedding_representation <> 'answer-only'
UNION ALL SELECT 'conflict_created_no_input', count(*) FROM q_resolved r JOIN q_inputs i ON i.id = r.record_id WHERE r.conflict""")
def outcome_checks(spark, d):
    """The given documents all became inputs, so conflicting records show up as leaked here."""
    conflicts = _resolved(spark, d).conflicts
    return quality.outcome_checks(rel.inputs(spark, d), rel.embeddings(spark, d), conflicts)


OUTCOMES = [
    expectations.none_of("all_terminal", "status NOT IN ('completed', 'ineligible')"),
    expectations.some_of("ineligible", "status = 'ineligible'"),
    expectations.some_of("answers_of_a_form", "form_key = 'en-f0' AND submission_key IS NOT NULL", 4),
    expectations.some_of("answers_of_a_submission", "submission_key = 's1'", 3, 4),
    expectations.some_of("in_two_segments", "question_id IS NOT NULL AND segments >= 2"),
    expectations.some_of("first_version", "question_key = 'q1' AND question_version = 1"),
    expectations.some_of("second_version", "question_key = 'q1' AND question_version = 2"),
    expectations.none_of("question_in_vector", "question_id IS NOT NULL AND contextual < embeddings"),
    expectations.none_of("no_question_in_vector", "question_id IS NULL AND generic < embeddings"),
    expectations.some_of("completed_generic", "question_id IS NULL AND status = 'completed' AND generic > 0"),
    expectations.Expectation("most_segments", "max(segments)", 2),
]
_NUMBER = lambda n: "NULL" if n is None else str(n)


ref.VIEWS["q_outcomes"] = """
SELECT i.id, i.status, i.submission_key, i.question_id, q.form_key, q.question_key, q.question_version,
    (SELECT count(*) FROM q_segments s WHERE s.original_input_id = i.id) AS segments,
    (SELECT count(*) FROM q_embeddings e WHERE e.original_input_id = i.id) AS embeddings,
    (SELECT count(*) FROM q_embeddings e WHERE e.original_input_id = i.id AND e.embedding_representation = 'question-answer') AS contextual,
    (SELECT count(*) FROM q_embeddings e WHERE e.original_input_id = i.id AND e.embedding_representation = 'answer-only') AS generic
FROM q_inputs i LEFT JOIN q_questions q ON q.id = i.question_id"""


@query("expected_outcomes", f"""SELECT name, measured, at_least, at_most,
  coalesce(measured >= at_least, at_least IS NULL) AND coalesce(measured <= at_most, at_most IS NULL) AS met FROM (
{" UNION ALL ".join(f"SELECT '{e.name}' AS name, CAST({e.measure} AS BIGINT) AS measured, CAST({_NUMBER(e.at_least)} AS BIGINT) AS at_least, CAST({_NUMBER(e.at_most)} AS BIGINT) AS at_most FROM q_outcomes" for e in OUTCOMES)})""")
def expected_outcomes(spark, d):
    """Outcomes written as a table, with what is expected of them counted on the way."""
    found = expectations.outcomes(rel.inputs(spark, d), rel.questions(spark, d), rel.segments(spark, d), rel.embeddings(spark, d))
    return expectations.write_checked(found, OUTCOMES, lambda rows: rows.write.parquet(work_folder(spark)))


ref.VIEWS["q_tagged"] = """
SELECT CASE id % 6 WHEN 0 THEN '  ' WHEN 1 THEN NULL WHEN 2 THEN ' Theme ' || (id // 10) || ' ' WHEN 3 THEN 'legacy ' || (id // 12)
  ELSE 'Legacy ' || (id // 12) END AS theme, CASE WHEN id % 7 = 0 THEN ' ' ELSE topic END AS topic FROM q_inputs"""
ref.VIEWS["q_new_themes"] = """
SELECT min(trim(theme)) AS name, lower(trim(theme)) AS k,
  (SELECT max(id) FROM q_themes) + row_number() OVER (ORDER BY lower(trim(theme))) AS id
FROM q_tagged WHERE trim(theme) <> '' AND lower(trim(theme)) NOT IN (SELECT lower(name) FROM q_themes) GROUP BY 2"""


@query("backfill_themes", """SELECT t.id AS theme_id, t.name, min(trim(g.topic)) AS topic
FROM q_tagged g JOIN (SELECT id, name, k FROM q_new_themes UNION ALL SELECT id, name, lower(name) FROM q_themes) t ON t.k = lower(trim(g.theme))
WHERE trim(g.topic) <> '' GROUP BY t.id, t.name, lower(trim(g.topic))""")
def backfill_themes(spark, d):
    legacy = """CASE id % 6 WHEN 0 THEN '  ' WHEN 1 THEN NULL WHEN 2 THEN concat(' Theme ', CAST((id - id % 10) / 10 AS BIGINT), ' ')
        WHEN 3 THEN concat('legacy ', CAST((id - id % 12) / 12 AS BIGINT)) ELSE concat('Legacy ', CAST((id - id % 12) / 12 AS BIGINT)) END"""
    tagged = rel.inputs(spark, d).select(
        F.expr(legacy).alias("theme"), F.expr("CASE WHEN id % 7 = 0 THEN ' ' ELSE topic END").alias("topic"))
    base = rel.themes(spark, d)
    created, links = quality.backfill_themes(tagged, base)
    known = base.select("id", "name").unionByName(created).withColumnRenamed("id", "theme_id")
    return links.join(known, "theme_id").select("theme_id", "name", "topic")


@query("blank_to_null", """SELECT id, CASE WHEN id % 9 = 0 THEN NULL ELSE topic END AS topic,
  CASE WHEN id % 4 = 0 THEN 'legacy' ELSE 'model-' || (id % 4) END AS embedding_model FROM q_inputs""")
def blank_to_null(spark, d):
    old = rel.inputs(spark, d).select(
        "id", F.expr("CASE WHEN id % 9 = 0 THEN '   ' ELSE topic END").alias("topic"),
        F.expr("CASE WHEN id % 4 <> 0 THEN concat('model-', id % 4) END").alias("embedding_model"))
    return quality.fill_default(quality.blank_to_null(old, "topic"), "embedding_model", "legacy")


@query("bool_to_status", """SELECT doc_id, CASE WHEN quality = 1 THEN 'ready_for_embedding' ELSE 'new' END AS status
FROM documents LEFT JOIN labels USING (doc_id)""")
def bool_to_status(spark, d):
    flags = rel.read(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("eligible"))
    joined = rel.read(spark, d, "documents").select("doc_id").join(flags, "doc_id", "left")
    return joined.select("doc_id", quality.eligible_to_status(F.col("eligible")).alias("status"))


@query("jobs_from_status", """SELECT job_type, id AS original_input_id FROM (
  SELECT id, CASE status WHEN 'new' THEN 'eligibility_segmentation' WHEN 'ready_for_embedding' THEN 'embeddings'
    WHEN 'ready_for_analysis' THEN 'topics' WHEN 'completed' THEN 'themes' END AS job_type FROM q_inputs) i
WHERE job_type IS NOT NULL AND NOT EXISTS (SELECT 1 FROM q_jobs j WHERE j.job_type = i.job_type AND j.original_input_id = i.id)""")
def jobs_from_status(spark, d):
    return quality.jobs_from_status(rel.inputs(spark, d), rel.jobs(spark, d))


RETRY = f"""attempts, CASE WHEN attempts < 5 THEN least(5.0 * pow(2, attempts - 1), 300)::DOUBLE END AS delay_seconds,
  CASE WHEN attempts >= 5 THEN 'failed' ELSE 'pending' END AS status,
  {ref.stamp("CASE WHEN attempts < 5 THEN failed_at + to_seconds(CAST(least(5.0 * pow(2, attempts - 1), 300) AS BIGINT)) END")} AS available_at"""


@query("retry_fold", f"""SELECT event_id, job_type, original_input_id, {RETRY} FROM (
  SELECT *, row_number() OVER (PARTITION BY job_type, original_input_id ORDER BY failed_at, event_id) AS attempts FROM q_failures)""")
def retry_fold(spark, d):
    return jobs.retry_fold(rel.failures(spark, d)).select(
        "event_id", "job_type", "original_input_id", "attempts", "delay_seconds", "status", stamp("available_at"))


@query("store_failures", """SELECT j.id, CASE WHEN j.status <> 'processing' THEN j.status WHEN j.attempts + 1 >= 5 THEN 'failed' ELSE 'pending' END AS status,
  j.attempts + (j.status = 'processing')::INT AS attempts,
  CASE WHEN j.status = 'processing' THEN left(i.original_text, 4000) ELSE j.last_error END AS last_error
FROM q_jobs j LEFT JOIN q_inputs i ON i.id = j.original_input_id WHERE j.status <> 'processing' OR i.id IS NOT NULL""")
def store_failures(spark, d):
    """Jobs in processing fail with their whole input as the error, of which the first 4,000 characters are kept."""
    known = rel.inputs(spark, d).select(F.col("id").alias("original_input_id"), F.col("original_text").alias("error"))
    held = rel.jobs(spark, d)
    errors = held.join(known, "original_input_id").select("id", "error", F.col("available_at").alias("failed_at"))
    kept = held.join(errors.select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left").where("status <> 'processing' OR _id IS NOT NULL").drop("_id")
    return jobs.store_failures(kept, errors).select("id", "status", "attempts", "last_error")


RETRY_STATE = f"""SELECT job_type, original_input_id, {RETRY} FROM (
  SELECT job_type, original_input_id, count(*) AS attempts, max(failed_at) AS failed_at FROM q_failures GROUP BY 1, 2)"""


@query("retry_state", RETRY_STATE)
def retry_state(spark, d):
    return jobs.retry_state(rel.failures(spark, d)).select(
        "job_type", "original_input_id", "attempts", "delay_seconds", "status", stamp("available_at"))


@query("claimable", f"""SELECT job_type, rank, id FROM (
  SELECT *, row_number() OVER (PARTITION BY job_type ORDER BY available_at, id) AS rank FROM q_jobs
  WHERE available_at <= {ref.AS_OF} AND (status = 'pending' OR (status = 'processing' AND locked_at < {ref.AS_OF} - INTERVAL 300 SECONDS)))
WHERE rank <= 10""")
def claimable(spark, d):
    return jobs.claimable(rel.jobs(spark, d), rel.as_of(), 10).select("job_type", "rank", "id")


@query("requeue_failed", f"""SELECT id, job_type, original_input_id,
  CASE WHEN status = 'failed' AND original_input_id % 2 = 0 THEN 'pending' ELSE status END AS status,
  CASE WHEN status = 'failed' AND original_input_id % 2 = 0 THEN 0 ELSE attempts END AS attempts,
  {ref.stamp(f"CASE WHEN status = 'failed' AND original_input_id % 2 = 0 THEN {ref.AS_OF} ELSE available_at END")} AS available_at,
  CASE WHEN status = 'failed' AND original_input_id % 2 = 0 THEN NULL ELSE last_error END AS last_error FROM q_jobs""")
def requeue_failed(spark, d):
    table = rel.jobs(spark, d)
    chosen = table.where("original_input_id % 2 = 0").select("id")
    return jobs.requeue_failed(table, chosen, rel.as_of()).select(
        "id", "job_type", "original_input_id", "status", "attempts", stamp("available_at"), "last_error")


@query("embed_texts", """SELECT entity_type, entity_id, embedding_representation,
  array_to_string([1 + length(sent) - length(replace(sent, letter, '')) FOR letter IN ['e', 't', 'a', 'o', 'i', 'n', 's', 'r']], ',') AS vector
FROM (SELECT entity_type, entity_id, CASE WHEN question_text IS NULL THEN 'answer-only' ELSE 'question-answer' END AS embedding_representation,
  CASE WHEN question_text IS NULL THEN text ELSE 'Question: ' || question_text || chr(10) || 'Answer: ' || text END AS sent FROM q_targets)""")
def embed_texts(spark, d):
    """Whole texts through the embedding provider, 16 at a time."""
    texts = seg.embedding_inputs(rel.inputs(spark, d), rel.segments(spark, d), rel.questions(spark, d))
    done = providers.embed(texts, "offline")
    shown = F.transform("embedding", lambda x: x.cast("int").cast("string"))
    return done.select("entity_type", "entity_id", "embedding_representation", F.array_join(shown, ",").alias("vector"))


@query("decision_provider", f"""SELECT id::VARCHAR AS prompt_id, 'eligible' AS action, NULL AS name, CASE WHEN len(ls) >= 2 AND len(list_distinct(ls)) = len(ls)
    THEN array_to_string(ls, '|') ELSE '' END AS listed FROM q_inputs JOIN q_lines ON doc_id = id
UNION ALL SELECT topic_key, CASE WHEN theme_id IS NULL THEN 'new' ELSE 'reuse' END, coalesce(r.name, topic_name), topic_name || '|' || coalesce(theme_id::VARCHAR, '')
FROM q_eligible LEFT JOIN (SELECT topic_key, theme_id, name FROM q_ranked WHERE rank = 1 AND relevance > 0) r USING (topic_key)""")
def decision_provider(spark, d):
    """Offline choices in place of a model, read back: segmentation of every input and themes of every cluster."""
    split = providers.split_lines(rel.inputs(spark, d)).withColumn("r", F.from_json("response", "eligible boolean, segments array<string>"))
    _, found, offered = _theme_inputs(spark, d)
    chosen = providers.suggest_themes(found, offered).withColumn(
        "r", F.from_json("response", "action string, existing_theme_ids array<bigint>, proposed_name string, topics array<string>"))
    ids = F.array_join(F.transform("r.existing_theme_ids", lambda x: x.cast("string")), ",")
    return split.select(
        F.col("input_id").cast("string").alias("prompt_id"), F.when(F.col("r.eligible"), "eligible").alias("action"),
        F.lit(None).cast("string").alias("name"), F.array_join("r.segments", "|").alias("listed"),
    ).union(chosen.select("topic_key", "r.action", "r.proposed_name", F.concat(F.array_join("r.topics", "|"), F.lit("|"), ids)))


@query("vote_provider", """SELECT v.original_input_id AS input_id, v.segment_id, coalesce(w.topic, 'Unsorted') AS name, w.topic IS NOT NULL AS reused
FROM q_vectors v LEFT JOIN q_votes w ON w.target_id = v.segment_id""")
def vote_provider(spark, d):
    """Offline topic responses of every embedded input, from the votes of its neighbours, read back."""
    asked = rel.vector_targets(spark, d)
    votes = neighbors.topic_vote(neighbors.knn_evidence(asked, rel.vector_evidence(spark, d), 5))
    named = asked.withColumnsRenamed({"target_type": "entity_type", "target_id": "entity_id"})
    kind = "segment_topics array<struct<segment_id: bigint, topic: struct<name: string, reused_existing: boolean>>>"
    rows = providers.vote_topics(named, votes).select("input_id", F.explode(F.from_json("response", kind)["segment_topics"]).alias("s"))
    return rows.select("input_id", "s.segment_id", "s.topic.name", F.col("s.topic.reused_existing").alias("reused"))


@query("stream_retry_state", RETRY_STATE)
def stream_retry_state(spark, d):
    schema = rel.read(spark, d, "events").schema
    raw = stages.read_stream(spark, f"{d}/events*.parquet", schema)
    failed = raw.where("event_type = 'error'").select(
        F.expr(rel.JOB_TYPE).alias("job_type"), F.col("user_id").alias("original_input_id"),
        F.col("ts").cast("timestamp").alias("failed_at"))
    return stages.stream_retry_state(failed, work_folder(spark)).select(
        "job_type", "original_input_id", "attempts", "delay_seconds", "status", stamp("available_at"))
