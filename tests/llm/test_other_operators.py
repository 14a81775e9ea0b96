"""Tokens, archives, shards, pages, vectors, quality and language against plain versions, round trips and accuracy."""

import gzip
import html as entities
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tests.llm import brute
from themeloom.llm import bpe, html, language, quality, sharding, topk, warc

FOLDER, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def ranks():
    with open(bpe.VOCABULARY, "rb") as file:
        return bpe.load_ranks(file.read())


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_transducer(ranks, reference):
    encoder, decoder, rng = bpe.Encoder(ranks, public_tokenizers.PATTERN), bpe.Decoder(ranks, block=3), random.Random(1)
    texts = ["".join(rng.choice("aaabcdeth  \n\t'ſs0123.!?éßλ漢字🙂 ​\x1c\x85") for _ in range(rng.randrange(50))) for _ in range(3000)]
    for text in [*texts, "a" * 20_000, " " * 9_000 + "x", "!?" * 6_000, "ab" * 5_000, "the" * 4_000]:
        ids = encoder.encode(text)
        assert bpe.unpack(ids) == reference(text)
        assert decoder.text(ids) == text


def test_utf8_stream():
    data = "aé漢🙂".encode() * 5
    for step in range(1, 9):
        stream = bpe.Utf8Stream()
        pieces = [stream.feed(data[at:at + step]) for at in range(0, len(data), step)]
        assert "".join(pieces) + stream.close() == data.decode()
    stream = bpe.Utf8Stream()
    assert stream.feed(b"a\xf0\x9f") + stream.feed(b"b\xe9") + stream.close() == "a�b�"


def test_byte_bpe_query(spark, reference):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in bpe.op9_byte_bpe(spark, FOLDER).collect():
        ids = reference(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), brute.digest(np.array(ids, "<u4").tobytes()), brute.digest(docs[r.doc_id].encode()))


def test_bpe_edges(spark):
    df = spark.createDataFrame([(1, None, b"x"), (None, "", None), (2, "a b", b"y"), (2, "a b", b"y"), (3, "long word " * 90_000, None)], "doc_id long, text string, ids binary")
    rows = bpe.decode(bpe.encode(df)).collect()
    assert Counter(r.decoded for r in rows) == Counter(r.text or "" for r in df.collect())
    assert bpe.encode(df.limit(0)).collect() == []


def pages(spark):
    return spark.createDataFrame(
        [(1, "u", None), (2, None, ""), (3, "u\r\nX: y", "é" * 60), (4, "u", "é" * 60), (None, "u", "é" * 60), (4, "u", "é" * 60), (5, "", "x" * 99), (6, "", "x" * 99),
         (7, "u", "a\r\n\r\nWARC/1.1\r\n" * 30), (8, "u", "long " * 700_000)], "page_id long, url string, html string")


def test_archives(spark, tmp_path):
    archives, index = warc.archive(pages(spark), str(tmp_path))
    found = warc.read(spark, archives).collect()
    expected = {(r.page_id, (r.html or "").encode()) for r in pages(spark).collect()}
    first = {}
    for page, payload in sorted(expected, key=lambda x: (x[0] is None, x[0] or 0)):
        first.setdefault(payload if len(payload) >= 100 else (page, payload), page)
    digests = {brute.digest(p): p for _, p in expected}
    assert len(found) == 10
    for r in found:
        payload = digests[r.payload_digest]
        response = first[payload if len(payload) >= 100 else (r.page_id, payload)]
        assert r.payload_bytes == len(payload) and r.refers_to == (None if r.page_id == response else response)
        assert (r.record_type, r.payload) == (("response", payload) if r.page_id == response else ("revisit", None))
    content = {p.name: p.read_bytes() for p in tmp_path.glob("archives/part-*")}
    for r in spark.read.parquet(index).collect():  # each record is a gzip member of its own, where the index says
        member = zlib.decompressobj(31)
        record = member.decompress(content[r.archive][r.offset:r.offset + r.length])
        assert member.eof and not member.unused_data and warc.parse(record)["page_id"] == r.page_id
    together = b"".join(gzip.decompress(data) for data in content.values())
    assert len(list(warc.split_records(iter([together])))) == 10
    with pytest.raises(ValueError):
        list(warc.split_records(iter([together[:-9]])))


def test_archives_of_nothing(spark, tmp_path):
    assert warc.read(spark, warc.archive(pages(spark).limit(0), str(tmp_path))[0]).collect() == []


def shards_of(rows, shards):
    size, slots = Counter({n: 0 for n in range(shards)}), defaultdict(list)
    for r in rows:
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return size


def test_shards(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    rows = sharding.op8_sharding(spark, LARGER).collect()
    sizes = shards_of(rows, 24)
    assert sorted(r.doc_id for r in rows) == sorted(docs) and max(sizes.values()) <= 1.01 * min(sizes.values())
    assert all((r["size"], r.text_crc32) == (len(docs[r.doc_id].encode()) + 8, zlib.crc32(docs[r.doc_id].encode())) for r in rows)
    copies = defaultdict(set)
    for r in rows:
        copies[docs[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in copies.values())


def test_hot_group_and_edges(spark):
    hot = [(n, "hot text " * 20) for n in range(3000)] + [(3000 + n, f"text {n} " * (n % 50)) for n in range(3000)]
    df = spark.createDataFrame(hot, "doc_id long, text string").withColumn("shard", F.lit("x"))
    sizes = shards_of(sharding.shard(df).collect(), 24)
    assert max(sizes.values()) <= 1.01 * min(sizes.values())
    odd = spark.createDataFrame([(None, None), (None, None), (1, ""), (1, ""), (2, "a b")], "doc_id long, text string")
    rows = sharding.shard(odd, 2).collect()
    shards_of(rows, 2)
    assert sorted(r["size"] for r in rows) == [8, 8, 8, 8, 11]
    assert sharding.shard(odd.limit(0)).collect() == []


def article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = (" ".join(entities.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inner))
    return "\n".join(b for b in blocks if b)


def test_html_query(spark):
    source = {r.page_id: r for r in spark.read.parquet(f"{LARGER}/pages.parquet").collect()}
    for r in html.op10_html(spark, LARGER).collect():
        assert (r.url, r.text, r.n_chars) == (source[r.page_id].url, article(source[r.page_id].html), len(r.text))


def test_html_cases(spark):
    none = html.Weights({}, {})
    body = "one two three four five six seven eight nine ten"
    around = "<header>site name</header><nav><ul><li>a<li>b</ul></nav>{}<aside>more</aside><div id='comments'><p>first comment here</p></div><footer>end</footer>"
    assert html.extract(around.format(f"<main><h1>T &amp; U</h1><p>{body}<p><a href='x>y'>li</a>nk&nbsp; x<form>f</form><ul><li>p<li>q</ul></main>"), none) == f"T & U\n{body}\nlink x\np\nq"
    assert html.extract(around.format(f"<div class='cookie-notice'>we use</div><p>{body}</p><script>var a='<p>';</script><!-- <p>no -->"), none) == body
    assert html.extract(None, none) == html.extract("", none) == html.extract("<nav>only menu</nav>", none) == ""
    for odd in ("<a " * 3000, "<" * 3000, '<p "' * 900, "<!-- " * 900, "</p>" * 3000, "<div>" * 3000 + "x"):
        html.extract(odd, none)
    df = spark.createDataFrame([(1, None, "t"), (1, None, "t"), (None, "<p>a b</p>" * 50_000, "u")], "page_id long, html string, text string")
    rows = html.main_text(df, html.learn(df)).collect()
    assert sorted(r.n_chars for r in rows) == [0, 0, 4 * 50_000 - 1] and html.main_text(df.limit(0), none).collect() == []


def test_html_keeps_all_of_the_article():
    body = "one two three four five six seven eight nine ten " * 3
    weights = html.Weights({"p": 1.0, "li": -2.0, "td": -2.0, "h3": -1.0}, {})
    inside = f"<p>{body}</p><h3>head</h3><ul><li>first<li>second</ul><table><tr><td>cell</table><p>{body}</p>"
    wanted = [body.strip(), "head", "first", "second", "cell", body.strip()]
    assert html.extract(f"<nav><li>menu</nav><article>{inside}</article><footer>end</footer>", weights).split("\n") == wanted
    assert html.extract(f"<nav><li>menu</nav><div>{inside}</div><footer>end</footer>", weights).split("\n") == wanted


def nearest(vectors, queries, k):
    out = []
    for q in sorted(queries):
        scored = sorted((-sum(a * b for a, b in zip(queries[q], v)), i) for i, v in vectors if i != q and len(v) == len(queries[q]))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return out


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(n, rng.normal(0, 0.2, 8).round(3).tolist()) for n in range(700)] + [(700 + n, [0.5] * 8) for n in range(200)]
    rows += [(900, None), (901, [float("nan")] * 8), (902, [float("inf")] * 8), (903, []), (904, [None] * 8), (905, [1.0, 2.0]), (920, [3.0, -1e9]), (906, [0.1, 0.1]), (None, [0.5] * 8), (20, [9.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).repartition(5)
    whole = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    queries = {}
    for i, v in whole:
        if i % 20 == 0:
            queries[i] = min(queries.get(i, v), v)
    got = sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 20 = 0"), 7).collect())
    assert got == nearest(whole, queries, 7)
    assert topk.top_k(df.limit(0), df.limit(0)).collect() == []


def test_top_k_of_many_blocks_and_beyond_64_bits(spark, monkeypatch):
    """Floors carried from a first block, identical blocks, components that no long holds."""
    rng = np.random.default_rng(4)
    rows = [(n, rng.normal(0, 0.2, 6).round(2).tolist()) for n in range(1, 500)] + [(7, [0.25] * 6)] * 60
    rows += [(600, [1e300, -1e300, 1.0, 0.0, 0.0, 2.0]), (601, [1e17, 3e16, 1.0, 0.0, -5.0, 0.5]), (620, [-1.7e308] * 6), (602, [1e6] * 6), (640, [2.0**40 + 1] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    whole = [(i, [64 * int(x) if abs(x) > 1e15 else int(np.floor(64 * x)) for x in v]) for i, v in rows]
    top = int(np.finfo(float).max)
    whole = [(i, [max(-top, min(top, x)) for x in v]) for i, v in whole]
    monkeypatch.setattr(topk, "CANDIDATES", 16)
    monkeypatch.setattr(topk, "QUERIES", 8)
    got = sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 20 = 0"), 7).collect())
    expected = []
    for q, query in ((i, v) for i, v in whole if i % 20 == 0):
        scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(query, v)))), i) for i, v in whole if i != q)[:7]
        expected += [(q, rank, i, -score) for rank, (score, i) in enumerate(scores, 1)]
    assert got == sorted(expected)


def test_copies_of_queries_are_not_broadcast(spark, monkeypatch):
    """Blocks of queries are copied for every group; however few bytes they are by Spark's estimate, the driver holds none of the copies."""
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(n, rng.normal(0, 0.2, 6).tolist()) for n in range(200)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(topk, "CANDIDATES", 16)
    found = topk.top_k(df, df.where("vec_id % 20 = 0"), 7)
    assert found.count() == 70
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join [group#" in plan
    assert "BroadcastHashJoin [group#" not in plan


def test_search_reads_few_vectors():
    rng = np.random.default_rng(5)
    vectors = np.floor(64 * rng.normal(0, 0.125, (4000, 32))).astype(np.int64)
    cells, low, high = topk._ranges(None, vectors)

    class Counted:
        read = 0

        def __getitem__(self, rows):
            Counted.read += len(rows)
            return vectors[rows]

    ids = np.arange(4000)
    list(topk.search_block((ids[:50], vectors[:50].astype(float)), ids, Counted(), cells, low, high, 20))
    assert Counted.read < 0.1 * 50 * 4000


def test_quality(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    rows = quality.op2_quality(spark, LARGER).collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.97 * len(held) > 50
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "s"), (None, "", "s"), (2, "x " * 200_000, "s"), (2, "x", "s")], "doc_id long, text string, score string")
    none = spark.createDataFrame([(None, 1), (5, None)], "doc_id long, quality int")
    vectors, network = quality.train(docs, none)
    assert {r.score for r in quality.score(docs, vectors, network).collect()} == {0.5}
    assert quality.score(docs.limit(0), *quality.train(docs.limit(0), none.limit(0))).collect() == []


def test_language(spark):
    rows = language.op3_language(spark, LARGER).collect()
    path = {r.page_id: re.search(r"/(en|de|fr|es)/", r.url)[1] for r in spark.read.parquet(f"{LARGER}/pages.parquet").collect()}
    assert sum(r.lang == path[r.page_id] for r in rows) >= 0.99 * len(rows) == 0.99 * len(path)
    assert all(0 < r.probability <= 1 for r in rows)


def test_language_evidence(spark):
    model = language.text_model(spark.read.parquet(f"{FOLDER}/documents.parquet").select("lang", "text"))
    texts = {r.lang: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").where("length(text) > 900").collect()}
    rows = [(n, "http://a.example.org/x", f"<p>{texts['fr']}</p>") for n in range(30)] + [
        (100, "http://a.example.org/y", ""), (101, "http://other.net", '<html lang="de"><p></p>'), (102, None, None), (None, "http://[bad", "<p>?"), (103, "x", texts["es"] * 30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r for r in language.identify(df, *model).collect()}
    assert found[100].lang == "fr" and found[101].lang == "de" and found[103].lang == "es" and found[102].text_lang is None
    assert language.identify(df.limit(0), *model).collect() == []
    assert {r.lang for r in language.identify(df, [], model[1][:0]).collect()} == {None}


def test_a_region_ends_with_the_article_that_holds_its_words():
    weights = html.Weights({}, {})
    words = " ".join(f"word{n}" for n in range(40))
    page = f"<body><article><h1>Top</h1><p>{words}</p><p>a <math><mi>x</mi></math> b</p></article><section id='responses'><p>{words}</p><p>more</p></section></body>"
    assert html.extract(page, weights) == f"Top\n{words}\na x b"
    two = f"<article><p>{words} one</p></article><div><p>between</p></div><article><p>{words} two</p></article>"
    assert html.extract(two, weights) == f"{words} one\n{words} two"
    teaser = f"<div><p>{words}</p><p>{words}</p></div><article><p>see also</p></article>"
    assert html.extract(teaser, weights).startswith(f"{words}\n{words}")
