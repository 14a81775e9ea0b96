"""Roots and components against plain Python on random graphs."""

import random

import pytest

from themeloom.operators import graph

THEME = "id long, merged_into_id long"


def walk(parents, start):
    seen, node = {start}, start
    while True:
        if node not in parents:
            return None
        if parents[node] is None:
            return node
        node = parents[node]
        if node in seen:
            return None
        seen.add(node)


@pytest.mark.parametrize("seed", [1, 2])
def test_roots_of_random_pointers(spark, seed):
    rng = random.Random(seed)
    parents = {i: (None if rng.random() < 0.1 else rng.randrange(0, 130)) for i in range(120)}
    parents = {i: None if p == i else p for i, p in parents.items()}
    got = graph.resolve_roots(spark.createDataFrame(list(parents.items()), THEME)).collect()
    expected = {i: walk(parents, i) for i in parents if walk(parents, i) is not None}
    assert {r["theme_id"]: r["root_id"] for r in got} == expected
    assert len(got) == len(expected)


def test_a_long_chain_resolves(spark):
    chain = [(0, None)] + [(i, i - 1) for i in range(1, 200)]
    got = graph.resolve_roots(spark.createDataFrame(chain, THEME)).collect()
    assert len(got) == 200 and {r["root_id"] for r in got} == {0}


@pytest.mark.parametrize("seed", [3, 4])
def test_components_of_random_edges(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(90, 90)]
    edges += [(200 + i, 201 + i) for i in range(25)]
    label = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    got = graph.merge_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == label
