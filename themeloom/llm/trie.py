"""The prefix trie of conversations, rolled up by centroid decomposition of its parent edges.

A node is a distinct sequence of first turns, named by a chained 128-bit hash, so nodes are found by grouping. What a
node's subtree adds up to is found by splitting: a component (a connected part of the forest, hanging from its top) is
split at its centroid, the deepest node that holds at least half of it. The centroid's subtree there is its own weight and
the totals of the components below it; that sum is added along the path from the centroid to the component's top. Parts
halve, so there are at most log2 rounds, in which all components are split at once.

Subtrees of bounded mass are components of one task each; mass, the turns of all members from a node on, is known from
grouping alone. The nodes above them are few, at most the total mass through the bound at each depth, and go in layers of
bounded size, deepest first, with what hangs below them as weight.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from themeloom.llm.common import CRC_SQL, crc_sql, table, tidy
from themeloom.session import cut_lineage

MASS = 50_000
"""Turns of all members that a subtree of one task may have; so many nodes at most."""
LAYER = 200_000
"""Nodes above those subtrees that are rolled up at a time."""
ROOT = b"\0" * 16
HEAD = 8
"""The most turns that a conversation takes from another."""
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def centroid_sums(parent: np.ndarray, depth: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each node of a forest the weights (rows) of its subtree added up; ``parent`` is -1 at tops, children lie one deeper."""
    count = len(parent)
    sums, alive = np.zeros_like(weights), np.arange(count)
    top = np.full(count, -1)
    for node in _by_depth(alive, depth):
        top[node] = np.where(parent[node] < 0, node, top[parent[node]])
    while len(alive):
        layers = _by_depth(alive, depth - depth[top])
        size = np.zeros(count, np.int64)
        size[alive] = 1
        for node in reversed(layers[1:]):
            np.add.at(size, parent[node], size[node])
        half = alive[2 * size[alive] >= size[top[alive]]]  # a path from each top: its deepest node is the centroid
        half = half[np.lexsort((-depth[half], top[half]))]
        centroid = half[np.unique(top[half], return_index=True)[1]]
        gone = np.zeros(count, bool)
        gone[centroid] = True
        above, new = top[centroid], top.copy()
        for node in layers[1:]:
            new[node] = np.where(gone[parent[node]], node, new[parent[node]])
        new[centroid] = centroid
        alive = alive[~gone[alive]]
        totals = np.zeros_like(weights)
        np.add.at(totals, new[alive], weights[alive])
        below = alive[(new[alive] == alive) & (parent[alive] >= 0)]
        below = below[gone[parent[below]]]
        found = weights.copy()
        np.add.at(found, parent[below], totals[below])
        at, to, value = centroid, above, found[centroid]
        sums[at] += value
        while len(at):  # a step up all the paths at once; paths of different components share no node
            climb = at != to
            at, to, value = parent[at[climb]], to[climb], value[climb]
            sums[at] += value
        top = new
    return sums


def _by_depth(nodes: np.ndarray, depth: np.ndarray) -> list[np.ndarray]:
    """The nodes of each depth from the least to the greatest, layers without nodes left out."""
    nodes = nodes[np.argsort(depth[nodes], kind="stable")]
    return np.split(nodes, np.flatnonzero(np.diff(depth[nodes])) + 1) if len(nodes) else []


def rebuild(rows: DataFrame, group: int = 5) -> DataFrame:
    """conv_id, depth, n_turns, digest, bytes of the turns of rebuilt conversations, with a row of depth 0 for each.

    Conversation c takes the first h = crc32(c) % 9 turns of conversation c - c % ``group`` (the remainder has the sign of c)
    and then its own from the one after its h-th on. Turns are ordered by turn, nulls first, ties by the digest of
    role and text; null roles and texts are empty. Rows without conv_id take no part.
    """
    role, text, c = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")), F.col("conv_id")
    rows = rows.where("conv_id IS NOT NULL").select(
        c.cast("long"), F.col("turn").cast("long"), F.octet_length(text).cast("long").alias("bytes"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
    )
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")))
    taken = lambda x: F.crc32(x.cast("string").cast("binary")) % (HEAD + 1)
    first = F.when(c > 0, c).otherwise(F.coalesce(F.try_subtract(c, F.lit(group - 1)), F.lit(-(1 << 63))))
    last = F.when(c < 0, c).otherwise(F.coalesce(F.try_add(c, F.lit(group - 1)), F.lit((1 << 63) - 1)))
    heirs = F.filter(F.sequence(first, last), lambda x: (x - x % group == c) & (taken(x) >= F.col("rank")))
    none = F.array().cast("array<struct<conv_id:bigint,place:int>>")
    place = lambda x, n: F.struct(x.alias("conv_id"), n.cast("int").alias("place"))
    to = F.concat(
        F.when(F.col("rank") == 1, F.array(place(c, F.lit(0)))).otherwise(none),
        F.when((F.col("rank") <= HEAD) & (c % group == 0), F.transform(heirs, lambda x: place(x, F.col("rank")))).otherwise(none),
        F.when(F.col("rank") > taken(c), F.array(place(c, F.col("rank")))).otherwise(none),
    )
    dealt = ranked.select(F.explode(to).alias("to"), "digest", "bytes").select("to.conv_id", "to.place", "digest", "bytes")
    own = Window.partitionBy("conv_id")
    dealt = dealt.withColumns({
        "depth": F.row_number().over(own.orderBy("place")) - 1, "n_turns": F.count("*").over(own) - 1, "there": F.min("place").over(own) == 0,
    })
    return dealt.where("there").select(
        "conv_id", F.col("depth").cast("long"), F.col("n_turns").cast("long"),
        F.when(F.col("depth") > 0, F.col("digest")).alias("digest"), F.when(F.col("depth") > 0, F.col("bytes")).otherwise(0).alias("bytes"),
    )


def paths(turns: DataFrame) -> DataFrame:
    """Each turn of ``rebuild`` with the key of its node and that of the node above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = ROOT
        for batch in batches:
            keys, parents = [], []
            for depth, digest in zip(batch.column("depth").to_pylist(), batch.column("digest").to_pylist()):
                parents.append(key if depth else None)
                key = hashlib.blake2b(key + digest, digest_size=16).digest() if depth else ROOT
                keys.append(key)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary()), pa.array(parents, pa.binary())], [*batch.schema.names, "key", "parent"])

    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    return turns.mapInArrow(tidy(run), turns.withColumns({"key": F.lit(b""), "parent": F.lit(None).cast("binary")}).schema).drop("digest")


def _ends(steps: DataFrame) -> DataFrame:
    """key, ends_sha256: the hash of the ids of the conversations that end at a node. They pass one task a node as a stream, as the hash takes them in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done = []
            for key, conv_id in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
                if key != now:
                    if now is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256(str(conv_id).encode())
                else:
                    digest.update(f",{conv_id}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in done], t) for n, t in enumerate((pa.binary(), pa.string()))], ["key", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], ["key", "ends_sha256"])

    ends = steps.where("depth = n_turns").select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")
    return ends.mapInArrow(tidy(run), "key binary, ends_sha256 string")


def _component_sums(rows: DataFrame) -> DataFrame:
    """key, parent, top, n_leaves, saved_tokens of (component, key, parent, depth, leaves, saved): sums within each component."""

    def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held)
        keys, above = whole.column("key").to_pylist(), whole.column("parent").to_pylist()
        at = {key: n for n, key in enumerate(keys)}
        parent = np.array([at.get(key, -1) for key in above])
        weights = np.column_stack([whole.column(c).to_numpy() for c in ("leaves", "saved")])
        sums = centroid_sums(parent, whole.column("depth").to_numpy(), weights)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), pa.array(above, pa.binary()), pa.array(parent < 0), pa.array(sums[:, 0]), pa.array(sums[:, 1])],
            ["key", "parent", "top", "n_leaves", "saved_tokens"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows_held, now = [], 0, None
        for batch in batches:
            own = batch.column("component").to_pylist()
            first = 0
            for n, component in enumerate(own):
                if component != now:
                    if rows_held + n - first >= MASS:  # small components go together
                        held.append(batch.slice(first, n - first))
                        yield done(held)
                        held, rows_held, first = [], 0, n
                    now = component
            held.append(batch.slice(first))
            rows_held += len(own) - first
        if rows_held:
            yield done(held)

    rows = rows.select("component", "key", "parent", "depth", "leaves", "saved").repartition("component").sortWithinPartitions("component", "depth")
    return rows.mapInArrow(tidy(run), "key binary, parent binary, top boolean, n_leaves long, saved_tokens long")


def _subtree_sums(nodes: DataFrame, steps: DataFrame, mass: int, layer: int) -> DataFrame:
    """key, n_leaves, saved_tokens of ``nodes`` (key, parent, depth, conv_id, mass, leaves, saved)."""
    heavy = cut_lineage(nodes.where(F.col("mass") > mass).select("key", "parent", "depth", "leaves", "saved"))
    count = heavy.count()
    if count:  # the path of each conversation leaves the heavy nodes at one place: there its light subtree hangs
        keys = heavy.select("key")
        deepest = steps.select("key", "conv_id", "depth").join(F.broadcast(keys) if count <= layer else keys, "key", "left_semi")
        deepest = deepest.groupBy("conv_id").agg(F.max("depth").alias("heavy"))
        tops = steps.select("conv_id", "depth", F.col("key").alias("component")).join(deepest, "conv_id").where("depth = heavy + 1").drop("depth", "heavy")
    else:
        tops = steps.where("depth = 0").select("conv_id", F.col("key").alias("component"))
    light = nodes.where(F.col("mass") <= mass).join(tops, "conv_id")
    sums = cut_lineage(_component_sums(light))
    results, below = [sums], sums.where("top").select(F.col("parent").alias("key"), "n_leaves", "saved_tokens")
    while count:
        least, most = heavy.agg(F.min("depth"), F.max("depth")).first()
        width = -(-(most - least + 1) // 1000)
        held, cut = 0, most + 1
        for bucket, n in heavy.groupBy(F.expr(f"CAST(({most} - depth) DIV {width} AS LONG)").alias("bucket")).count().orderBy("bucket").collect():  # at most 1,000
            if held + n > layer:
                break
            held, cut = held + n, max(least, most + 1 - (bucket + 1) * width)
        cut = min(cut, most)  # one depth at least; its nodes hang together nowhere
        extra = below.groupBy("key").agg(F.sum("n_leaves").alias("more"), F.sum("saved_tokens").alias("more_saved"))
        here = heavy.where(F.col("depth") >= cut).join(extra, "key", "left").select(
            (F.col("key") if cut == most else F.lit(ROOT)).alias("component"), "key", "parent", "depth",
            (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
        )
        sums = cut_lineage(_component_sums(here))
        results.append(sums)
        below = cut_lineage(below.unionByName(sums.where("top").select(F.col("parent").alias("key"), "n_leaves", "saved_tokens")))
        heavy = heavy.where(F.col("depth") < cut)
        count = heavy.count()
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    return found.select("key", "n_leaves", "saved_tokens")


def trie(turns: DataFrame, mass: int = MASS, layer: int = LAYER) -> DataFrame:
    """A row for each node of the trie of ``turns`` (conv_id, depth, n_turns, digest, bytes, as ``rebuild`` gives them).

    key, conv_id (the least member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. Conversations without turns are members of the root; a table without conversations has no nodes. Equal
    conversations are members of the same nodes, however many.
    """
    steps = cut_lineage(paths(turns))
    nodes = steps.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("depth").alias("depth"), F.first("parent").alias("parent"),
        F.first("bytes").alias("bytes"), F.sum(F.col("n_turns") - F.col("depth") + 1).alias("mass"),
    )
    nodes = cut_lineage(nodes)
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = cut_lineage(nodes.join(children, "key", "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0)), "leaves": F.col("n_children").isNull().cast("long"), "saved": (F.col("n_convs") - 1) * F.col("bytes"),
    }))
    sums = _subtree_sums(nodes, steps, mass, layer)
    above = nodes.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    rows = nodes.join(above, "parent", "left").join(sums, "key").join(_ends(steps), "key", "left")
    return rows.select(
        "key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of ``conversations`` as ``rebuild`` makes them; nulls, ties and empty tables as ``rebuild`` and ``trie`` say."""
    return trie(rebuild(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))).drop("key")


OP12_SQL = f"""
WITH RECURSIVE {CRC_SQL}, own AS (
  SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS entry,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS rank
  FROM conversations WHERE conv_id IS NOT NULL
), heads AS (
  SELECT conv_id, {crc_sql("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM own), crc_bytes
), turns AS (
  SELECT h.conv_id, o.rank, o.entry FROM heads h JOIN own o ON o.conv_id = h.conv_id - h.conv_id % 5 AND o.rank <= h.h
  UNION ALL SELECT h.conv_id, o.rank, o.entry FROM heads h JOIN own o ON o.conv_id = h.conv_id AND o.rank > h.h
), rebuilt AS (
  SELECT h.conv_id, coalesce(list(entry ORDER BY rank) FILTER (rank IS NOT NULL), []) AS entries FROM heads h LEFT JOIN turns USING (conv_id) GROUP BY h.conv_id
), steps AS (
  SELECT conv_id, CAST(d AS BIGINT) AS depth, entries[1:d] AS prefix, d = len(entries) AS ends FROM (SELECT *, unnest(range(len(entries) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT prefix, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
    (count(*) - 1) * coalesce(strlen(prefix[-1].text), 0) AS saved FROM steps GROUP BY prefix
), counted AS (
  SELECT p.*, (SELECT count(*) FROM nodes c WHERE c.depth = p.depth + 1 AND c.prefix[1:c.depth - 1] = p.prefix) AS n_children FROM nodes p
), above AS (
  SELECT unnest(range(depth + 1)) AS d, prefix, n_children, saved FROM counted
), sums AS (
  SELECT prefix[1:d] AS prefix, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM above GROUP BY ALL
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM counted n JOIN sums s USING (prefix) LEFT JOIN nodes p ON n.depth > 0 AND p.prefix = n.prefix[1:n.depth - 1]
"""
