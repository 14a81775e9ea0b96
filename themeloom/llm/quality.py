"""Document quality: random-indexing word vectors, pooled, and a two-layer network with calibrated probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm.common import LOWER, documents, hashes, mix, slices, table, text_bytes, tidy, words

FORMS, SHAPES, DIM = 1 << 14, 1 << 12, 32
"""Hashed word forms and word shapes that have a vector, and its length: the whole table is 2.6 MB whatever the corpus."""
NONZERO, WINDOW = 2, 2
"""Signed ones of an index vector, and words on either side that count as context."""
LABELLED = 20_000
"""Labelled documents at most that the network is fitted to: those of smallest hash."""
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 128, 0.01, 1e-4
ACCEPT = 0.7
PIECES = 16
U = np.uint64

# Upper case, digits, and other signs of ASCII as themselves; lower case and everything beyond ASCII as one class.
CLASS = np.arange(256, dtype=np.uint8)
CLASS[65:91], CLASS[97:123], CLASS[128:], CLASS[48:58] = ord("X"), ord("x"), ord("x"), ord("9")


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the ones in the index vector of every form, shape and the mark of a repeated word."""
    h = mix(np.arange((FORMS + SHAPES + 1) * NONZERO, dtype=U) + U(0x9E3779B97F4A7C15)).reshape(-1, NONZERO)
    return (h % U(DIM)).astype(np.int64), np.where((h >> U(40)) & U(1), 1.0, -1.0)


def word_ids(blob: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Form, shape (numbered on from the forms), whether it repeats the word before, and text of each word."""
    starts, ends, text = words(blob, offsets)
    form = hashes(LOWER[blob], starts, ends)
    again = np.zeros(len(form), bool)
    again[1:] = (form[1:] == form[:-1]) & (text[1:] == text[:-1])
    kind = CLASS[blob]
    change = np.ones(len(blob), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[starts] = True
    place = np.concatenate(([0], np.cumsum(change)))
    shape = hashes(kind[change], place[starts], place[ends], 1)
    return (form % U(FORMS)).astype(np.int64), FORMS + (shape % U(SHAPES)).astype(np.int64), again, text


def contexts(blob: np.ndarray, offsets: np.ndarray, places: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """For every form and shape the sum of the index vectors of the shapes around it."""
    form, shape, again, text = word_ids(blob, offsets)
    total = np.zeros((FORMS + SHAPES) * DIM)
    marks = np.where(again, FORMS + SHAPES, shape)
    for far in range(-WINDOW, WINDOW + 1):
        here, there = (slice(None, len(form) - far), slice(far, None)) if far >= 0 else (slice(-far, None), slice(None, len(form) + far))
        same = text[here] == text[there]
        beside = marks[there][same]
        for word in (form[here][same], shape[here][same]):
            for n in range(NONZERO):
                total += np.bincount(word * DIM + places[beside, n], weights=signs[beside, n], minlength=len(total))
    return total.reshape(-1, DIM)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The unit vector of every form and shape, from its contexts in all texts."""
    places, signs = index_vectors()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FORMS + SHAPES, DIM))
        for _, blob, offsets in slices(batches):
            if len(blob):
                total += contexts(blob, offsets, places, signs)
        parts = [p.astype(np.float32).tobytes() for p in np.array_split(total, PIECES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array(parts, pa.binary())], ["piece", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, sums in zip(batch.column("piece").to_pylist(), batch.column("sums").to_pylist()):
                totals[piece] = totals.get(piece, 0.0) + np.frombuffer(sums, np.float32).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(totals.keys(), pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], ["piece", "sums"])

    schema = "piece int, sums binary"
    rows = docs.select(text_bytes().alias("text")).mapInArrow(tidy(gather), schema).repartition(PIECES, "piece").mapInArrow(tidy(add), schema).collect()
    shapes = [len(p) for p in np.array_split(np.zeros(FORMS + SHAPES), PIECES)]
    found = {row.piece: np.frombuffer(row.sums).reshape(-1, DIM) for row in rows}
    vectors = np.concatenate([found.get(n, np.zeros((size, DIM))) for n, size in enumerate(shapes)])
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


FEATURES = 2 * DIM + 4


def pooled(blob: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """One row for each text: mean vectors of its forms and shapes, its length, repeated and distinct words. Zeros if it has no words."""
    form, shape, again, text = word_ids(blob, offsets)
    count = len(offsets) - 1
    out = np.zeros((count, FEATURES))
    number = np.bincount(text, minlength=count)
    some = np.flatnonzero(number)
    if not len(some):
        return out
    step = 1 << 17
    for n, word in enumerate((form, shape)):
        for at in range(0, len(word), step):
            part, of = vectors[word[at:at + step]], text[at:at + step]
            first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            out[of[first], n * DIM:(n + 1) * DIM] += np.add.reduceat(part, first, axis=0)
    out[:, :2 * DIM] /= np.maximum(number, 1)[:, None]
    out[:, 2 * DIM] = np.log1p(number)
    out[:, 2 * DIM + 1] = np.bincount(text[again], minlength=count) / np.maximum(number, 1)
    for n, word in enumerate((form, shape)):
        distinct = np.unique(text * (FORMS + SHAPES) + word) // (FORMS + SHAPES)
        out[:, 2 * DIM + 2 + n] = np.log1p(np.bincount(distinct, minlength=count)) / np.maximum(np.log1p(number), 1e-9)
    return out


@dataclass
class Network:
    """Standardised inputs, a hidden layer, one output divided by a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    second: np.ndarray
    temperature: float = 1.0

    def logits(self, inputs: np.ndarray) -> np.ndarray:
        inputs = np.clip((inputs - self.mean) / self.scale, -8, 8)
        hidden = np.maximum(inputs @ self.first[:-1] + self.first[-1], 0)
        return hidden @ self.second[:-1] + self.second[-1]

    def probabilities(self, inputs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(inputs) / self.temperature, -40, 40)))


def fit(inputs: np.ndarray, labels: np.ndarray, seed: int = 7) -> Network:
    """Adam on the log loss over nine tenths of the rows; the temperature is the one of least loss on the rest.

    Without rows every probability is one half; with one class alone it is that class's smoothed share.
    """
    if len(labels) < 20 or labels.min() == labels.max():
        share = (labels.sum() + 1) / (len(labels) + 2)
        flat = np.zeros(2)
        flat[1] = np.log(share / (1 - share))
        return Network(np.zeros(inputs.shape[1]), np.ones(inputs.shape[1]), np.zeros((inputs.shape[1] + 1, 1)), flat)
    random = np.random.default_rng(seed)
    order = random.permutation(len(labels))
    held, used = order[:len(labels) // 10], order[len(labels) // 10:]
    mean, scale = inputs[used].mean(axis=0), inputs[used].std(axis=0) + 1e-6
    net = Network(mean, scale, random.normal(0, np.sqrt(2 / inputs.shape[1]), (inputs.shape[1] + 1, HIDDEN)), random.normal(0, np.sqrt(1 / HIDDEN), HIDDEN + 1))
    x, y = np.clip((inputs - mean) / scale, -8, 8), labels
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (net.first, net.second)]
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        shuffled = random.permutation(used)
        for at in range(0, len(shuffled), BATCH):
            rows = shuffled[at:at + BATCH]
            hidden = np.maximum(x[rows] @ net.first[:-1] + net.first[-1], 0)
            error = (1 / (1 + np.exp(-(hidden @ net.second[:-1] + net.second[-1]))) - y[rows]) / len(rows)
            back = np.outer(error, net.second[:-1]) * (hidden > 0)
            slopes = (np.vstack((x[rows].T @ back, back.sum(axis=0))), np.append(hidden.T @ error, error.sum()))
            step += 1
            for weights, slope, (m, v) in zip((net.first, net.second), slopes, moments):
                m += 0.1 * (slope + DECAY * weights - m)
                v += 0.001 * (slope**2 - v)
                weights -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    z, y = net.logits(inputs[held]), labels[held]
    if len(held):
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=lambda t: np.logaddexp(0, -np.where(y > 0, z, -z) / t).mean()))
    return net


def held_out(id: str = "doc_id"):
    """Whether a row belongs to the fold that labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> tuple[np.ndarray, Network]:
    """Word vectors from all texts of ``docs`` (doc_id, text), and a network from at most ``limit`` rows of ``labels``
    (doc_id, quality) outside the held-out fold. Null ids and labels are left out; of labels that contradict, the higher counts."""
    vectors = word_vectors(docs)
    named = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    chosen = named.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.join(F.broadcast(chosen), "doc_id").select("quality", text_bytes().alias("text"))  # limit rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, blob, offsets in slices(batches):
            inputs = [row.tobytes() for row in pooled(blob, offsets, vectors)]
            yield pa.RecordBatch.from_arrays([part.column("quality").cast(pa.float64()), pa.array(inputs, pa.binary())], ["quality", "inputs"])

    found = sorted(rows.mapInArrow(tidy(run), "quality double, inputs binary").collect(), key=lambda row: (row.inputs, row.quality))
    inputs = np.array([np.frombuffer(row.inputs) for row in found]).reshape(-1, FEATURES)
    return vectors, fit(inputs, np.array([float(row.quality >= 1) for row in found]))


def score(df: DataFrame, vectors: np.ndarray, network: Network, text: str = "text") -> DataFrame:
    """``df`` with ``score``, the probability of label 1, from the whole text alone; null and empty texts have that of no
    words. Rows may repeat; a column named ``score`` is replaced; an empty table gives an empty table."""
    kept = [c for c in df.columns if c != "score"]
    model = df.sparkSession.sparkContext.broadcast((vectors, network))
    schema = df.select(*kept, F.lit(0.5).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = model.value
        for part, blob, offsets in slices(batches, "__text"):
            scores = network.probabilities(pooled(blob, offsets, vectors))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(scores)], [*kept, "score"])

    return df.select(*kept, text_bytes(text).alias("__text")).mapInArrow(tidy(run), schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every row of ``documents``; null and empty texts are scored as texts without words (see ``score``)."""
    docs = documents(spark, sf_dir)
    scored = score(docs, *train(docs, table(spark, sf_dir, "labels", "doc_id", "quality")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
