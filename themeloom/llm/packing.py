"""Best-fit packing of documents into sequences of a fixed number of tokens, with certified counts.

Pieces are dealt to partitions; each partition packs its own by best-fit decreasing and proves a lower bound of its count
by dual feasible functions. A partition whose count equals its bound keeps its sequences, all but the emptiest. One with a
gap keeps only the full ones. What is not kept is exchanged: dealt anew among fewer partitions, and packed again, until
the count of all sequences equals the bound of all pieces, or one partition holds all that is left, or nothing is won.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from themeloom.llm.common import documents, tidy
from themeloom.session import cut_lineage

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
CAPACITY = 2048
END = 0
"""The id after each document."""
PART_ROWS = 200_000
"""Pieces that a partition packs, about: what a task holds in memory."""
ROUNDS = 12
FAMILIES = 64
"""Dual feasible functions of the rounding kind, beside those that cut off small and large pieces."""
CHUNKS = 300_000
"""Words that a worker remembers in each of two generations; beyond it they are encoded anew, with the same results."""


PACK = [struct.Struct(f"<{n}I").pack for n in range(65)]


def _packed_ids(ids: list[int]) -> bytes:
    return PACK[len(ids)](*ids) if len(ids) < len(PACK) else np.array(ids, "<u4").tobytes()


class Words(dict):
    """Chunks between blanks and line ends to their ids as packed little-endian 32-bit integers.

    No match of the split pattern spans white space, so a text's ids are those of its chunks in a row. A chunk of ASCII signs
    and Latin letters needs no normalising but for case; its parts go to the BPE model directly. All others go through the
    whole tokenizer, as do all chunks if the file describes a tokenizer of other steps.
    """

    plain = re.compile("[!-~À-ÖØ-öø-ÿ]{1,64}").fullmatch

    def __init__(self, vocabulary: str):
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_str(vocabulary)
        steps = json.loads(vocabulary)
        kinds = [[x["type"] for x in (steps[s] or {}).get(f"{s}s".replace("pre_tokenizers", "pretokenizers"), [])] for s in ("normalizer", "pre_tokenizer")]
        self.direct = kinds == [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]]
        self.added = [x["content"] for x in steps["added_tokens"]]
        if self.direct:
            split, last = steps["pre_tokenizer"]["pretokenizers"]
            self.direct = split["behavior"] == "Removed" and split["invert"] and not last["add_prefix_space"] and not last["use_regex"]
            self.parts = regex.compile(split["pattern"]["Regex"]).findall
            letter = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
            self.letters = {x: letter(chr(x))[0][0] for x in range(0xC0, 0x100)}
            self.special = regex.compile("|".join(map(regex.escape, self.added)) or "(?!)").search

    def _ids(self, chunk: str) -> bytes:
        ascii_, alpha = chunk.isascii(), chunk.isalpha()
        if not self.direct or not (ascii_ and alpha or self.plain(chunk)) or not alpha and self.special(chunk):
            return _packed_ids(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        lower = chunk.lower()
        if not alpha:
            parts = self.parts(lower)
            if len(parts) > 1:
                return b"".join([self[part] for part in parts])
        if lower != chunk:
            return self[lower]
        return _packed_ids([x.id for x in self.tokenizer.model.tokenize(chunk if ascii_ else chunk.translate(self.letters))])

    def __missing__(self, chunk: str) -> bytes:
        found = self.older.get(chunk)
        if found is None:
            found = self._ids(chunk)
        if len(chunk) <= 64:
            if len(self) >= CHUNKS:
                self.older = dict(self)
                self.clear()
            self[chunk] = found
        return found

    def encode(self, text: str) -> bytes:
        return b"".join([self[chunk] for chunk in text.replace("\n", " ").split(" ")])


_WORKERS: dict[int, Words] = {}  # words remembered by one task serve the next


def _words(vocabulary: str) -> Words:
    key = zlib.crc32(vocabulary.encode())
    if key not in _WORKERS:
        _WORKERS[key] = Words(vocabulary)
    return _WORKERS[key]


def pieces(df: DataFrame, capacity: int = CAPACITY, id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id (a long), piece, start, length, ids_crc32, deal, and packed ``ids`` if asked for.

    A document is the ids of its text and END; only one of more than ``capacity`` ids is cut. Null and empty texts are END
    alone. Rows are documents by themselves, so ids may be null or repeat; other columns are not read. An empty table
    gives an empty table. ``deal`` numbers the pieces of a task: it spreads equal rows over partitions.
    """
    with open(vocabulary, encoding="utf-8") as file:  # an installed file of a few megabytes, not an input
        content = df.sparkSession.sparkContext.broadcast(file.read())
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "deal"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, deal, end = _words(content.value), 0, END.to_bytes(4, "little")
        for batch in batches:
            rows, held = [], 0
            for doc, own in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = words.encode(own.as_py() or "") + end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((doc, n, at // 4, len(part) // 4, zlib.crc32(part), deal, part))
                    deal, held = deal + 1, held + len(part) * with_ids
                if held > 8 << 20:
                    yield _batch(rows, names, types, with_ids)
                    rows, held = [], 0
            yield _batch(rows, names, types, with_ids)

    return df.select(F.col(id).cast("long"), F.col(text)).mapInArrow(tidy(run), schema)


def _batch(rows: list[tuple], names: list[str], types: list, with_ids: bool) -> pa.RecordBatch:
    columns = [pa.array([row[n] for row in rows], kind) for n, kind in enumerate([*types, pa.binary()][:len(types) + with_ids])]
    return pa.RecordBatch.from_arrays(columns, [*names, "ids"][:len(columns)])


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each length, and the number of sequences, by best-fit decreasing.

    Each piece goes where the least room is left that holds it. Pieces of one length are placed together: the fullest
    sequence that takes one takes as many as it can, as its room is then still the least.
    """
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    rooms: list[list[np.ndarray]] = [[] for _ in range(capacity + 1)]
    held, count = np.zeros(capacity + 1, np.int64), 0
    values, firsts = np.unique(-lengths[order], return_index=True)
    for length, at, end in zip(-values, firsts, [*firsts[1:], len(order)]):
        while at < end:
            fitting = np.flatnonzero(held[length:])
            if len(fitting):
                room = int(length + fitting[0])
                open_ = np.concatenate(rooms[room])
            else:
                room = capacity
                open_ = count + np.arange(-(-(end - at) // (capacity // length)))
                count += len(open_)
            each = room // length
            some = order[at:min(end, at + each * len(open_))]
            used, left = -(-len(some) // each), len(some) % each
            sequence[some] = np.repeat(open_[:used], each)[:len(some)]
            offset[some] = capacity - room + np.tile(np.arange(each) * length, used)[:len(some)]
            if room != capacity or len(fitting):
                rooms[room] = [open_[used:]] if used < len(open_) else []
                held[room] = len(open_) - used
            for sequences, rest in ((open_[:used - (left > 0)], room - each * length), (open_[used - 1:used] if left else open_[:0], room - left * length)):
                if len(sequences) and rest:
                    rooms[rest].append(sequences)
                    held[rest] += len(sequences)
            at += len(some)
    return sequence, offset, count


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """The least number of sequences that can hold ``counts[n]`` pieces of each length n, by dual feasible functions.

    A dual feasible function maps lengths so that whatever fits a sequence still fits; so the mapped total is a bound. Two
    kinds: drop pieces below a cut and raise those above its complement to a whole sequence; round to multiples of 1 / k.
    """
    lengths = np.arange(capacity + 1)
    number, tokens = np.cumsum(counts), np.cumsum(counts * lengths)
    cut = np.arange(1, capacity // 2 + 1)
    whole = number[-1] - number[capacity - cut]
    kept = tokens[capacity - cut] - tokens[cut - 1]
    bound = int(max(-(-tokens[-1] // capacity), np.max(whole - (-kept // capacity), initial=0)))
    for k in range(1, FAMILIES + 1):
        scaled = (k + 1) * lengths
        mapped = np.where(scaled % capacity == 0, k * lengths, scaled // capacity * capacity)
        bound = max(bound, -(-int((counts * mapped).sum()) // (k * capacity)))
    return bound


def _packed(dealt: DataFrame, capacity: int, round_: int, parts: int) -> DataFrame:
    """Rows of (part, length, ...) with sequence_id, offset, and whether the sequence is kept whatever the other partitions hold."""
    names = [c for c in dealt.columns if c not in ("sequence_id", "offset", "kept")]
    dealt = dealt.select(*names)
    schema = dealt.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "kept": F.lit(True)}).schema

    def done(part: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held).combine_chunks()
        lengths = whole.column("length").to_numpy()
        sequence, offset, count = best_fit(lengths, capacity)
        filled = np.bincount(sequence, weights=lengths, minlength=count).astype(np.int64)
        kept = filled == capacity
        if count == lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity):
            kept |= np.arange(count) != np.argmin(filled)
        ids = (np.int64(round_) << np.int64(58)) + (np.int64(part) << np.int64(32)) + sequence
        for name, values in (("sequence_id", ids), ("offset", offset), ("kept", kept[sequence])):
            whole = whole.append_column(name, pa.array(values))
        yield from whole.to_batches(max_chunksize=20_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            own = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1), len(own)]
            for first, last in zip(cuts, cuts[1:]):
                if first == last:
                    continue
                if current is not None and own[first] != current:
                    yield from done(current, held)
                    held = []
                current = int(own[first])
                held.append(batch.slice(first, last - first))
        if held:
            yield from done(current, held)

    return dealt.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(tidy(run), schema)


def pack(rows: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS) -> DataFrame:
    """``rows`` (columns length and deal, and any others) with ``sequence_id`` and ``offset``, in as few sequences as found.

    Lengths are 1 to ``capacity``. Offsets in a sequence run from 0 without gaps; sequence ids are unique, nothing more.
    Ties, repeated rows and null ids change nothing: each row is placed by itself. The driver sees one count a length and
    two numbers a round. Rows are written before they are dealt, so a lost executor repeats the same deal.
    """
    rows = cut_lineage(rows)
    others = rows.columns
    counts = np.zeros(capacity + 1, np.int64)
    for length, count in rows.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[length] = count
    bound, left, done, open_, parts_before = lower_bound(counts, capacity), int(counts.sum()), [], rows, 1 << 30
    total = released = None
    settled = 0  # sequences of earlier rounds that are kept
    for round_ in range(ROUNDS):
        parts = min(-(-max(left, 1) // part_rows), max(1, parts_before // 2) if round_ else parts_before)
        salted = F.pmod(F.xxhash64("deal", "length", *[c for c in ("doc_id", "piece") if c in others], F.lit(round_)), F.lit(parts)).cast("int")
        packed = cut_lineage(_packed(open_.withColumn("part", salted), capacity, round_, parts))
        by_kind = {kept: (n, sequences) for kept, n, sequences in packed.groupBy("kept").agg(F.count("*"), F.sum((F.col("offset") == 0).cast("long"))).collect()}
        here = sum(sequences for _, sequences in by_kind.values())
        if released is not None and here > released:
            done.append(open_)  # nothing won: the arrangement before stays
            break
        total = settled + here
        left, released = by_kind.get(False, (0, 0))
        if parts == 1 or total <= bound or released <= 1 or round_ == ROUNDS - 1:
            done.append(packed)
            break
        done.append(packed.where("kept"))
        settled += here - released
        open_, parts_before = packed.where("NOT kept"), parts
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found.select(*others, "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (packed, at most a sequence's capacity) of pieces that carry their ``ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.unhex(F.array_join(F.transform("parts", lambda x: F.hex(x["ids"])), "")).alias("ids"),
    )


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of ``documents`` with its place; null texts are empty, null and repeated ids are documents of their own."""
    return pack(pieces(documents(spark, sf_dir))).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
