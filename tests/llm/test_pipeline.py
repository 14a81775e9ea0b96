"""The stages of the pipeline against plain versions, one after the other."""

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from themeloom.llm import bpe, decontaminate, quality
from themeloom.session import cut_lineage

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, after = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, FOLDER))
        after.append({r.doc_id: r for r in docs.collect()})
        assert docs.columns == columns or stage is corpus_pipeline.tokenise
    good, single, cut, clean, tokens = after
    accepted = {r.doc_id for r in quality.op2_quality(spark, FOLDER).collect() if r.predicted}
    assert set(good) == accepted
    groups = brute.components([(d, r.text) for d, r in good.items()], 5, 80)
    assert set(single) == {d for d, _, c in groups if d == c}
    left = {d: kept.decode("utf-8", "ignore") for d, kept, _ in brute.repeats([(d, r.text) for d, r in single.items()])}
    assert {d: r.text for d, r in cut.items()} == {d: t for d, t in left.items() if t.strip() or not (single[d].text or "").strip()}
    assert all(r.n_chars == len(r.text) and r.source == single[d].source for d, r in cut.items())
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert not any(i in r.text for i in items for r in clean.values()) and set(clean) <= set(cut)
    found = decontaminate.leaks(spark.createDataFrame([(d, r.text) for d, r in cut.items()], "doc_id long, text string"), spark.read.parquet(f"{FOLDER}/benchmark.parquet"))
    assert set(cut) - set(clean) == {r.doc_id for r in found.collect() if r.leaks}
    with open(bpe.VOCABULARY, "rb") as file:
        encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(file.read()), special_tokens={}).encode_ordinary
    assert {d: r.n_tokens for d, r in tokens.items()} == {d: len(encode(r.text)) for d, r in clean.items()}
    assert all(r.decoded_sha256 == brute.digest(clean[d].text.encode()) for d, r in tokens.items())


def test_odd_rows(spark):
    text = "The quick fox and the dog went to town. " * 5
    docs = spark.createDataFrame(
        [(1, None, "en", 1, "a"), (1, None, "en", 1, "a"), (None, "hello world", "en", 1, "b"), (2, "", "en", 1, "c"), (3, text, None, 1, "d"), (4, text, None, 1, "d"), (3, text, None, 1, "d")],
        "doc_id long, text string, lang string, n_chars long, score string",
    ).withColumns({c: F.lit(c) for c in ("removed", "row", "left", "leaks", "ids", "component_id", "__row")})
    rows = docs
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        rows = cut_lineage(stage(spark, rows, FOLDER))
        assert rows.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id, r.removed, r.score) for r in rows.where("doc_id IS NOT NULL").collect()) == [(False, 1, "removed", "a"), (False, 2, "removed", "c"), (False, 3, "removed", "d")]
    assert rows.where("doc_id IS NULL").count() == 1
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = cut_lineage(stage(spark, empty, FOLDER))
        assert empty.count() == 0


def test_texts_of_one_id_are_kept(spark):
    docs = spark.createDataFrame([(1, ""), (1, "one two three four five six"), (1, "one two three four five six"), (2, "one two three four five six"), (3, "x")], "doc_id long, text string")
    rows = corpus_pipeline.keep_one_of_near_copies(spark, docs, FOLDER).collect()
    assert sorted((r.doc_id, r.text) for r in rows) == [(1, ""), (1, "one two three four five six"), (3, "x")]
