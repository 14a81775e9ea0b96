"""Exact top-k inner products by vector-approximation files."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import nsmallest
from operator import mul

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from themeloom.llm.common import table, tidy
from themeloom.session import cut_lineage, tasks

BITS = 5
"""Bits of a cell number: each component is quantised to one of 2**BITS ranges."""
FIT = 4_096
"""Vectors at most that the ranges are fitted to. They bear on speed alone: the outer ranges are widened to each block's extremes."""
CANDIDATES, QUERIES = 8_192, 1_024
"""Vectors of a block of candidates and about those of a block of queries: what a task holds at a time."""
SCALE = 64.0
LEAST, MOST = -(2**63), 2**63 - 1


def integers(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension the numbers of the rows that take part and their vectors, integers as doubles, which hold them exactly."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = pc.fill_null(pc.cast(column.flatten(), pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    found = {}
    for dim in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == dim)
        components = values[starts[rows][:, None] + np.arange(dim)]
        good = np.isfinite(components).all(axis=1)
        with np.errstate(over="ignore"):
            scaled = np.floor(SCALE * components[good])
        # 64 times the largest doubles is beyond doubles; the largest double stands for it.
        found[int(dim)] = rows[good], np.clip(scaled, -np.finfo(float).max, np.finfo(float).max)
    return found


def widest(dim: int) -> float:
    """The largest component with which the products of two vectors of ``dim`` add up within 62 bits."""
    return min(2.0**30, float(int((2.0**62 / dim) ** 0.5)))


def _narrow(vectors: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest type that holds them; doubles where 64 bits do not."""
    for kind in (np.int8, np.int16, np.int32):
        if vectors.size == 0 or (vectors.min() >= np.iinfo(kind).min and vectors.max() <= np.iinfo(kind).max):
            return vectors.astype(kind)
    return vectors


def _ranges(marks: np.ndarray | None, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell numbers of vectors, and the lowest and highest integer of each cell (dimension by cell)."""
    if marks is None or marks.shape[0] != vectors.shape[1]:
        marks = np.quantile(vectors, np.linspace(0, 1, 2**BITS + 1)[1:-1], axis=0, method="nearest").T
    cells = np.empty(vectors.shape, np.uint8)
    low = np.concatenate((vectors.min(axis=0)[:, None], marks), axis=1).astype(np.float64)
    high = np.concatenate((marks - 1, vectors.max(axis=0)[:, None]), axis=1).astype(np.float64)
    for d in range(vectors.shape[1]):
        cells[:, d] = np.searchsorted(marks[d], vectors[:, d], side="right")
    return cells, low, np.maximum(low, high)


def blocks(df: DataFrame, size: int, marks: dict[int, np.ndarray], id: str, vector: str) -> DataFrame:
    """Rows of up to ``size`` vectors of one dimension: ids, exact integers, cell numbers and the ranges of the cells.

    Vectors with components beyond ``widest`` lie in blocks of their own (``wide``), without cells.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(dim: int, wide: bool) -> pa.RecordBatch:
            parts = held.pop((dim, wide))
            ids, vectors = (np.concatenate([part[n] for part in parts]) for n in (0, 1))
            exact = _narrow(vectors)
            cells, low, high = (np.zeros(0),) * 3 if wide else _ranges(marks.get(dim), vectors)
            binary = lambda x: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array([int(ids[0])], pa.int64()), pa.array([dim], pa.int32()), pa.array([wide]), binary(ids), pa.array([exact.dtype.str]), binary(exact), binary(cells), binary(low), binary(high)],
                ["block", "dim", "wide", "ids", "kind", "exact", "cells", "low", "high"],
            )

        for batch in batches:
            named = batch.column(id).is_valid().to_numpy(zero_copy_only=False)
            ids = pc.fill_null(batch.column(id), 0).to_numpy(zero_copy_only=False)
            for dim, (rows, vectors) in integers(batch.column(vector)).items():
                beyond = np.abs(vectors).max(axis=1, initial=0) > widest(dim)
                for wide in (False, True):
                    chosen = named[rows] & (beyond == wide)
                    mine, theirs = ids[rows[chosen]], vectors[chosen]
                    for at in range(0, len(mine), size):
                        held.setdefault((dim, wide), []).append((mine[at:at + size], theirs[at:at + size]))
                        if sum(len(part[0]) for part in held[dim, wide]) >= size:
                            yield block(dim, wide)
        for key in list(held):
            yield block(*key)

    return df.select(id, vector).mapInArrow(tidy(run), "block long, dim int, wide boolean, ids binary, kind string, exact binary, cells binary, low binary, high binary")


def search_block(
    queries: tuple[np.ndarray, np.ndarray], ids: np.ndarray, exact: np.ndarray, cells: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, floors: np.ndarray | None = None
):
    """The k best candidates of a block for each query: yields (query id, vec ids, scores).

    First the cells alone bound every score from both sides; a candidate is out if its upper bound is below the k-th best
    lower bound, or below the query's floor, a score that k others are known to reach. Then exact vectors are read by falling
    upper bound until the next one is below the k-th best score. What is below the floor is not returned.
    """
    dims = np.arange(cells.shape[1])
    middle, radius = (low + high) / 2, (high - low) / 2
    middle, radius = middle[dims, cells], radius[dims, cells]
    floors = np.full(len(queries[0]), LEAST) if floors is None else floors
    for at in range(0, len(queries[0]), 128):
        names, vectors, least = queries[0][at:at + 128], queries[1][at:at + 128], floors[at:at + 128]
        center, spread = vectors @ middle.T, np.abs(vectors) @ radius.T
        spread += 1e-9 * (np.abs(vectors).sum(axis=1)[:, None] * max(1.0, float(np.abs(middle).max(initial=0) + radius.max(initial=0))))  # rounding
        lower = center - spread
        own = names[:, None] == ids[None, :]
        lower[own] = -np.inf
        sure = np.partition(lower, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(names), -np.inf)
        sure = np.maximum(sure, np.where(least > LEAST, least - 1e-9 * np.abs(least.astype(np.float64)), -np.inf))
        upper = center + spread
        upper[own] = -np.inf
        for n, name in enumerate(names):
            live = np.flatnonzero((upper[n] >= sure[n]) & (upper[n] > -np.inf))
            live = live[np.argsort(-upper[n][live], kind="stable")]
            query = vectors[n].astype(np.int64)
            read, scores, step = 0, np.zeros(0, np.int64), 2 * k
            while read < len(live):
                if read >= k and upper[n][live[read]] < np.partition(scores, read - k)[read - k]:
                    break
                scores = np.concatenate((scores, exact[live[read:read + step]].astype(np.int64) @ query))
                read, step = len(scores), 2 * step
            best = np.lexsort((ids[live[:read]], -scores))[:k]
            best = best[scores[best] >= least[n]]
            yield int(name), ids[live[best]], scores[best]


def search_wide(queries: tuple[np.ndarray, np.ndarray], ids: np.ndarray, exact: np.ndarray, k: int):
    """The same where products go beyond 62 bits, in integers of any size; a score beyond 64 bits becomes the nearest long."""
    vectors = [[int(x) for x in row] for row in exact.tolist()]
    for name, row in zip(queries[0].tolist(), queries[1].tolist()):
        query = [int(x) for x in row]
        scores = ((max(LEAST, min(MOST, sum(map(mul, query, vector)))), vec) for vec, vector in zip(ids.tolist(), vectors) if vec != name)
        best = nsmallest(k, ((-score, vec) for score, vec in scores))
        yield name, np.array([vec for _, vec in best], np.int64), np.array([-score for score, _ in best], np.int64)


def _search(pairs: DataFrame, k: int, id: str) -> DataFrame:
    """The k best candidates of each pair of blocks, of those that reach a query's floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                pair = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                dim, view = pair["dim"], lambda name, kind: np.frombuffer(pair[name], kind)  # noqa: B023
                asked = view("q_ids", np.int64), view("q_exact", pair["q_kind"]).reshape(-1, dim).astype(np.float64)
                ids, exact = view("ids", np.int64), view("exact", pair["kind"]).reshape(-1, dim)
                if pair["wide"] or pair["q_wide"]:
                    out = list(search_wide(asked, ids, exact, k))
                else:
                    known = dict(zip(pair["f_ids"], pair["f_scores"])) if pair["f_ids"] else {}
                    floors = np.array([known.get(name, LEAST) for name in asked[0].tolist()], np.int64)
                    cells = view("cells", np.uint8).reshape(-1, dim), view("low", np.float64).reshape(dim, -1), view("high", np.float64).reshape(dim, -1)
                    out = list(search_block(asked, ids, exact, *cells, k, floors))
                yield pa.RecordBatch.from_arrays([
                    pa.array([pair["q_block"]] * sum(len(found) for _, found, _ in out), pa.int64()),
                    pa.array(np.repeat([name for name, _, _ in out], [len(found) for _, found, _ in out]).astype(np.int64)),
                    pa.array(np.concatenate([np.zeros(0, np.int64), *[found for _, found, _ in out]])), pa.array(np.concatenate([np.zeros(0, np.int64), *[scores for _, _, scores in out]])),
                ], ["q_block", "query_id", id, "score"])

    return pairs.mapInArrow(tidy(run), f"q_block long, query_id long, {id} long, score long")


def top_k(df: DataFrame, queries: DataFrame, k: int = 20, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best inner products of every query with rows of another id.

    Components become floor(64 * x), exactly, also beyond 64 bits; a score beyond 64 bits counts as the nearest long. Vectors
    that are null, empty or hold null or non-finite components take no part, nor
    do rows without an id; vectors meet only those of their dimension. Of queries that repeat an id the smallest vector
    counts; candidates that repeat an id each count. Ties go to the smaller id. Fewer candidates give fewer rows.

    Every block of queries meets one block of candidates first. The k-th scores found there are floors in all other blocks, which
    return only what reaches them.
    """
    spark = df.sparkSession
    sample = df.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(id), id).limit(FIT).select(vector).toArrow().column(vector)
    quantiles = np.linspace(0, 1, 2**BITS + 1)[1:-1]
    marks = {}
    for dim, (_, vectors) in (integers(sample) if len(sample) else {}).items():
        narrow = vectors[np.abs(vectors).max(axis=1, initial=0) <= widest(dim)]
        if len(narrow):
            marks[dim] = np.quantile(narrow, quantiles, axis=0, method="nearest").T
    candidates = cut_lineage(blocks(df, CANDIDATES, marks, id, vector))
    count = queries.count()
    asked = queries.groupBy(id).agg(F.min(vector).alias(vector)).repartition(max(1, round(count / QUERIES)), id)
    asked = cut_lineage(blocks(asked, 2 * QUERIES, marks, id, vector).select(
        "dim", F.col("block").alias("q_block"), F.col("wide").alias("q_wide"), F.col("ids").alias("q_ids"), F.col("kind").alias("q_kind"), F.col("exact").alias("q_exact"),
    ))
    # One block of candidates for each dimension, full if there is a full one; a block's first id can repeat, its ids cannot be told apart by more.
    name = F.struct(F.length("ids").alias("n"), "block", F.md5("ids").alias("hash"), F.md5("exact").alias("of"))
    of_name = candidates.where("NOT wide").groupBy("dim").agg(F.max(name).alias("first"))
    marked = candidates.join(of_name, "dim", "left").withColumn("is_first", ~F.col("wide") & (name == F.col("first"))).drop("first")
    none = {"f_ids": F.lit(None).cast("array<bigint>"), "f_scores": F.lit(None).cast("array<bigint>")}

    def spread(some: DataFrame, asked: DataFrame) -> DataFrame:
        """Pairs of blocks of one dimension: blocks of candidates are dealt to groups, blocks of queries copied to each.

        The copies are not counted in Spark's estimate of their size, so a broadcast would bring all of them to the driver.
        """
        groups = max(1, min(tasks(spark), blocks_in_all))
        copies = asked.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        return some.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).join(copies.hint("merge"), ["group", "dim"])

    blocks_in_all = candidates.count()
    first = marked.where("is_first") if blocks_in_all > 1 else marked
    opened = cut_lineage(_search(first.join(asked.withColumns(none), "dim").repartition(tasks(spark), "q_block"), k, id))
    found = opened
    if blocks_in_all > 1:
        reached = opened.groupBy("q_block", "query_id").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") >= k)
        floors = reached.groupBy("q_block").agg(F.collect_list(F.struct("query_id", "score")).alias("f")).select(
            "q_block", F.col("f.query_id").alias("f_ids"), F.col("f.score").alias("f_scores")
        )
        others = marked.where("NOT is_first")
        found = found.unionByName(_search(spread(others, asked.join(floors, "q_block", "left")), k, id))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", id, "score")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of every vec_id divisible by 20; vectors that are null or hold no finite number take no part, ties go to the smaller id (see ``top_k``)."""
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS vector FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.vector, c.vector) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.vector) = len(c.vector)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
