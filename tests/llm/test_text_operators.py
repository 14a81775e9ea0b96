"""Jaccard join, suffix dedup and decontamination against plain versions."""

import random

import numpy as np
import pytest

from tests.llm import brute
from themeloom.llm import decontaminate, jaccard, suffixes

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n long"


def changed(base, rate, rng, vocabulary):
    return " ".join(rng.choice(vocabulary) if rng.random() < rate else w for w in base)


def family(rng, count, size, rates=(0.002, 0.01, 0.02)):
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    base = [rng.choice(vocabulary) for _ in range(size)]
    return [changed(base, rng.choice(rates), rng, vocabulary) for _ in range(count)]


def edge_cases():
    return [(900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "ONE  two"), (None, "one two"), (905, "a b c"), (906, "a b c d"), (906, "a b c d"),
            (907, "x " * 3000), (908, "é à " * 40), (909, "é à " * 41), (None, None)]


@pytest.mark.parametrize("length, num, hot", [(4, 85, 2048), (5, 80, 60)])
def test_components(spark, length, num, hot):
    rng = random.Random(length)
    texts = family(rng, 330, 60) + family(rng, 40, 12) + family(rng, 60, 300) + family(rng, 30, 7) + ["same text for all of these"] * 50
    docs = [*enumerate(rng.sample(texts, len(texts))), *edge_cases()]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], SCHEMA)
    rule = jaccard.Rule(length, num, 100)
    rule.hot = hot
    got = jaccard.components(df, rule)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute.components(docs, length, num)


def test_one_deletion_neighbourhoods(spark, monkeypatch):
    rule = jaccard.Rule(4, 85, 100).fitted([(60, 10**6), (12, 10**6), (300, 10**6)], 0.9)
    assert rule.deletes.any() and not rule.deletes.all()
    monkeypatch.setattr(jaccard, "_fitted", lambda *_: rule)
    rng = random.Random(6)
    docs = [*enumerate(family(rng, 80, 60) + family(rng, 40, 12) + family(rng, 40, 300)), *edge_cases()]
    got = jaccard.components(spark.createDataFrame([(d, t, 1) for d, t in docs], SCHEMA))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute.components(docs)


def test_every_size_has_enough_segments():
    busy = jaccard.Rule().fitted([(size, 10**6) for size in range(1, 400)], 0.9)
    for rule in (jaccard.Rule(), jaccard.Rule(5, 80, 100), busy):
        for small in range(1, 400):
            for large in range(small, small * rule.den // rule.num + 1):
                both = small + large
                scheme = int(np.searchsorted(rule.starts, small, side="right")) - 1
                assert int(np.searchsorted(rule.starts, large, side="right")) - 1 in (scheme, scheme + 1)
                assert both - 2 * rule.least_common(both) < rule.needed[scheme]


def test_parity_bits_never_exceed_the_difference():
    rng = np.random.default_rng(1)
    rule = jaccard.Rule()
    for _ in range(200):
        tokens = rng.integers(0, 1 << 63, 300).astype(np.uint64)
        a, b = np.sort(tokens[: rng.integers(1, 300)]), np.sort(tokens[rng.integers(0, 20):])
        bits = [jaccard.parities(x, np.zeros(len(x), np.int64), np.array([len(x)]))[0] for x in (a, b)]
        common = len(np.intersect1d(a, b))
        if 100 * common >= 85 * (len(a) + len(b) - common):
            assert jaccard._possible(rule, len(a), len(b), *bits)


def test_what_sizes_and_parity_bits_connect():
    rng, rule = np.random.default_rng(1), jaccard.Rule(5, 80, 100)
    for _ in range(20):
        bases, sets = [rng.integers(0, 1 << 63, rng.integers(5, 200)).astype(np.uint64) for _ in range(4)], []
        for _ in range(40):
            base = bases[rng.integers(0, 4)]
            sets.append(np.unique(np.concatenate((base[rng.random(len(base)) > rng.choice([0, 0.02, 0.1, 0.3])], rng.integers(0, 1 << 63, rng.integers(0, 30)).astype(np.uint64)))))
        sizes = np.array([len(x) for x in sets])
        bits = [jaccard.parities(x, np.zeros(len(x), np.int64), np.array([len(x)]))[0] for x in sets]
        expected = list(range(40))
        for i in range(40):
            for j in range(i):
                if jaccard._possible(rule, int(sizes[i]), int(sizes[j]), bits[i], bits[j]):
                    pair = expected[i], expected[j]
                    expected = [min(pair) if x in pair else x for x in expected]
        assert jaccard._connected(rule, sizes, bits).tolist() == expected


def test_components_of_nothing(spark):
    assert jaccard.components(spark.createDataFrame([], SCHEMA)).collect() == []


def repeated(rng):
    phrase = "".join(rng.choice("abc d") for _ in range(300))
    docs = []
    for n in range(120):
        own = "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(0, 200)))
        start = rng.randrange(0, 200)
        docs.append((n // 2 if n % 7 == 0 else n, own + phrase[start:start + rng.randrange(30, 120)] + own[:40] + "é" * rng.randrange(0, 60)))
    docs += [(500 + n, "xyz " * 40) for n in range(20)] + [(600, "x" * 49), (601, "x" * 49), (602, "y" * 50), (603, "y" * 50), (604, None), (605, ""), (None, phrase), (None, phrase), (606, phrase * 30)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("hot_from", [None, 3])
def test_repeats(spark, hot_from):
    docs = repeated(random.Random(5))
    df = spark.createDataFrame([(d, t, "z") for d, t in docs], "doc_id long, text string, removed string")
    got = [(brute.LAST if r.doc_id is None else r.doc_id, bytes(r.kept), [(s.start, s.end) for s in r.removed]) for r in suffixes.repeats(df, hot_from=hot_from).collect()]
    assert sorted(got, key=str) == sorted(brute.repeats(docs), key=str)


@pytest.mark.parametrize("ids", [(1, 2), (5, brute.LAST), (None, None)])
def test_repeats_among_rows_without_an_id(spark, ids):
    rng = random.Random(6)
    same, own = ("".join(rng.choice("abcdefgh ") for _ in range(90)) for _ in range(2))
    rows = [(ids[0], own), (ids[1], own[:70]), *[(None, same + str(n % 3)) for n in range(30)], (None, own), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = suffixes.repeats(df).collect()
    assert len(got) == len(rows) and sum(same.encode() in bytes(r.kept) for r in got) == 1
    if ids[0]:
        assert [bytes(r.kept) for r in got if r.doc_id == ids[0]] == [own.encode()] and [bytes(r.kept) for r in got if r.doc_id == ids[1]] == [b""]


def test_suffix_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.op5_suffix_dedup(spark, FOLDER).collect()}
    sizes = {d: len((t or "").encode()) for d, t in docs}
    assert got == {d: (sizes[d], sizes[d] - len(kept), len(spans), brute.digest(kept)) for d, kept, spans in brute.repeats(docs)}


def test_multikey_quicksort():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    starts = np.arange(4000 - 50 + 1)
    live, group = suffixes.suffix_groups(data, starts, 11)
    names = {}
    for at, n in zip(live, group):
        names.setdefault(int(n), []).append(data[starts[at]:starts[at] + 11].tobytes())
    assert all(len(set(same)) == 1 and len(same) > 1 for same in names.values())
    ordered = [names[n][0] for n in sorted(names)]
    assert ordered == sorted(set(ordered))


def test_documents_of_a_cell():
    for doc in ([-brute.LAST - 1, -5, -5, 0, 7, brute.LAST], [3, 3, 4, 200], [9], [0, 0, 1 << 40]):
        doc = np.array(doc, np.int64)
        assert suffixes._at(suffixes._docs(doc)).tolist() == doc.tolist()
    assert len(suffixes._docs(np.arange(0, 1000, 3))) < 1_100


def test_cells_stay_small_when_there_are_many(spark):
    """At thousands of cells a document has an entry in each at most: naming it may not take more than the entry itself."""
    rng = random.Random(7)
    lines = ["".join(rng.choice("abcdefgh ") for _ in range(90)) for _ in range(400)]
    docs = [(d, "\n".join(rng.sample(lines, 20)), 1) for d in range(600)]
    texts = spark.createDataFrame(docs, SCHEMA).selectExpr("doc_id AS doc", "CAST(text AS BINARY) AS text")
    cells = suffixes._shared_anchors(texts, 100, 4096, 50).where("kind = 0").drop("kind").toArrow()
    size = lambda name: sum(len(x) for x in cells.column(name).to_pylist())
    entries = size("data") // 4
    assert entries > 10 * cells.num_rows
    assert sum(size(c) for c in cells.column_names if c not in ("part", "data")) < 3 * entries


def test_lists_of_anchors_travel_once(spark):
    """Every use of the lists has the same exchange: the plan of one that leaves out documents without a list has no filter below it."""
    rng = random.Random(8)
    lines = ["".join(rng.choice("abcdefgh ") for _ in range(90)) for _ in range(40)]
    found = suffixes.repeats(spark.createDataFrame([(d, "\n".join(rng.sample(lines, 20)), 1) for d in range(50)], SCHEMA))
    assert "isnotnull(anchors" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_repeats_of_nothing(spark):
    assert suffixes.repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_infix_distance():
    rng = random.Random(2)
    for _ in range(400):
        item, text = (bytes(rng.choice(b"ab c") for _ in range(rng.randrange(low, 25))) for low in (1, 0))
        distance = brute.infix_distance(item, text)
        assert decontaminate.infix_distance(item, text) == distance
        assert decontaminate.may_hold(item, text, distance)


def edited(text, rate, rng):
    text = list(text)
    for _ in range(int(rate * len(text))):
        at, kind = rng.randrange(len(text)), rng.randrange(3)
        text[at:at + (kind != 0)] = [] if kind == 2 else [rng.choice("abcdefgh")]
    return "".join(text)


def test_leaks(spark):
    rng = random.Random(4)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    hosts = [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 80").orderBy("doc_id").collect()]
    docs, planted = [], {}
    for n, host in enumerate(hosts):
        words = host.split(" ")
        at = rng.randrange(len(words) + 1)
        docs.append((2 * n, host))
        item = items[n % len(items)]
        docs.append((2 * n + 1, " ".join([*words[:at], edited(item[1].upper() if n % 3 else item[1], (0, 0.04, 0.08)[n % 3], rng), *words[at:]])))
        planted[2 * n + 1] = item[0]
    docs += [(1000, None), (1001, ""), (None, items[0][1]), (1002, items[1][1]), (1002, items[1][1])]
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, leaks int")
    bench = spark.createDataFrame([*items, (None, "no id " * 9), (77, None), (78, "too short")], "item_id long, text string")
    got = [(r.doc_id, {x.item_id: x.distance for x in r.leaks}) for r in decontaminate.leaks(df, bench).collect()]
    assert sum(planted.get(d) in found for d, found in got if d in planted) >= 0.99 * len(planted)
    norm = lambda t: b" ".join(bytes(w) for w in __import__("re").findall(rb"[0-9a-z\x80-\xff]+", (t or "").lower().encode()))
    lengths = {i: len(norm(t)) for i, t in items}
    texts = {d: norm(t) for d, t in docs}
    for d, found in got:
        for item, distance in found.items():  # nothing is reported that is not there
            assert distance <= decontaminate.EDITS * lengths[item]
            if len(texts[d]) < 3000:
                assert brute.infix_distance(norm(dict(items)[item]), texts[d]) <= distance
    assert all(found == {} for d, found in got if d in (1000, 1001)) and [f for d, f in got if d == 1002] == [{1: 0}, {1: 0}]
    assert decontaminate.leaks(df.limit(0), bench).collect() == [] and all(r.leaks == [] for r in decontaminate.leaks(df, bench.limit(0)).collect())


def leaks_of(spark, texts, items):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    return {r.doc_id: {x.item_id: x.distance for x in r.leaks} for r in decontaminate.leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}


def test_leaks_without_a_whole_word(spark):
    rng = random.Random(7)
    common = ["".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(60)]
    items = [(n, " ".join(rng.choice(common) for _ in range(12 + 4 * n))) for n in range(12)]
    slip = lambda w: w[:(at := rng.randrange(8))] + "z" + w[at + 1:]
    host = lambda: " ".join(rng.choice(common) for _ in range(150))
    got = leaks_of(spark, [" ".join((host(), *map(slip, text.split()), host())) for _, text in items], items)
    assert all(n in got[n] and got[n][n] <= len(text.split()) for n, text in items)


def test_leaks_at_the_greatest_distance(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 10)))
    items = [(n, " ".join(word() for _ in range(9 + 2 * n))) for n in range(40)]
    texts = [" ".join((*(word() for _ in range(30)), edited(text, 0.15, rng), *(word() for _ in range(30)))) for _, text in items]
    texts += ["z".join((texts[3], texts[5])), texts[6] + " " + items[6][1]]
    got = leaks_of(spark, texts, items)
    squeeze = lambda t: " ".join(t.split()).encode()
    for d, text in enumerate(texts):  # what is there is found, at its least distance, and nothing else
        distances = {n: decontaminate.infix_distance(squeeze(i), squeeze(text)) for n, i in items}
        assert got[d] == {n: x for n, x in distances.items() if x <= int(decontaminate.EDITS * len(squeeze(items[n][1])))}


def test_a_passage_is_verified_once(monkeypatch):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    items = [" ".join(word() for _ in range(40)) for _ in range(12)]
    index = decontaminate.Index.build(list(range(12)), items)
    calls, verify = [], decontaminate.Index._verify
    monkeypatch.setattr(decontaminate.Index, "_verify", lambda self, data, numbers, bounds, n, *rest: calls.append(n) or verify(self, data, numbers, bounds, n, *rest))
    texts = [" ".join((*(word() for _ in range(50)), edited(item, 0.02, rng), *(word() for _ in range(50)))) for item in items]
    found = index.matches(*decontaminate.joined(texts))
    assert [(t, n) for t, n, _ in found] == [(n, n) for n in range(12)] and len(calls) < 1.5 * len(items)


def test_leaks_of_short_and_unspaced_items(spark):
    chinese = "".join(chr(0x4E00 + (n * n * 31 + 7 * n) % 4000) for n in range(60))
    slipped = "".join("一" if n % 15 == 7 else c for n, c in enumerate(chinese))
    items = [(1, "What is art?"), (2, "no"), (3, "東京"), (4, chinese), (5, "ñu"), (6, "?!"), (7, chinese * 60)]
    texts = ["so WHAT, is art", "what is artful", "snow, no", "nowhere", "私は東京にいます", f"前{slipped}後", "añu", "a ñu", "so what is", "art no? !", ""]
    wanted = [{1: 0}, {}, {2: 0}, {}, {3: 0}, {4}, {}, {5: 0}, {}, {2: 0}, {}]
    got = leaks_of(spark, texts, items)
    assert set(got[5]) == {4} and got[5][4] > 0
    assert [got[n] for n in range(len(texts)) if n != 5] == wanted[:5] + wanted[6:]
    assert set(leaks_of(spark, ["前" + chinese * 60], items)[0]) == {4, 7}


def test_decontaminate_query(spark):
    norm = lambda t: " " + " ".join(w.decode() for w in __import__("re").findall(rb"[0-9a-z\x80-\xff]+", (t or "").lower().encode())) + " "
    docs = {r.doc_id: norm(r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    items = [norm(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    got = {r.doc_id for r in decontaminate.op7_decontaminate(spark, FOLDER).collect() if r.contaminated}
    assert {d for d, t in docs.items() if any(i in t for i in items)} <= got and len(got) < 0.1 * len(docs)
