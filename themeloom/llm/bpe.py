"""Byte-level BPE: encoding by a lazily determinised transducer, decoding by an incremental UTF-8 machine.

A sequence of tokens is the BPE encoding of its bytes exactly when each neighbouring pair is the encoding of its own
bytes. Encoding is therefore a finite-state relation: the state is the longest end of the input that begins a token, and
the token that ends a prefix is the one output of the state that may follow the encoding before it. The machine is
determinised as texts need it. Encodings of neighbouring prefixes soon share all but their last tokens, so that what
they share can be emitted after a bounded lookahead.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm.common import documents, text_bytes, tidy

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
FOLLOWERS = 20_000
"""Verdicts remembered for a token; beyond it they are worked out anew, with the same results."""
LOOKAHEAD = 4096
"""Bytes after which tokens that nothing can change any more are emitted, whatever the length of the pre-token."""
CHUNKS = 300_000
"""Encoded chunks that a worker remembers in each of two generations; the older one is then forgotten, with the same results."""
PACK = [struct.Struct(f"<{n}I").pack for n in range(65)]


def load_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


class State(dict):
    """One state: bytes to the states that follow, worked out when first needed, and the outputs (back, verdicts, token) here."""

    __slots__ = ("owner", "name", "outputs")

    def __init__(self, owner: Transducer, name: bytes):
        self.owner, self.name, self.outputs = owner, name, []
        for n in range(len(name)):
            if (token := owner.ranks.get(name[n:])) is not None:
                verdicts = owner.verdicts.setdefault(token, Verdicts(owner, token))
                if verdicts[-1]:
                    self.outputs.append((n - len(name), verdicts, token))

    def __missing__(self, byte: int) -> State:
        name, states = self.name + bytes((byte,)), self.owner.states
        target = next(name[n:] for n in range(len(name) + 1) if name[n:] in states)
        if states[target] is None:
            states[target] = State(self.owner, target)
        self[byte] = states[target]
        return states[target]


class Verdicts(dict):
    """Tokens (-1: none) to whether one token may follow them, worked out when first needed."""

    __slots__ = ("owner", "token")

    def __init__(self, owner: Transducer, token: int):
        self.owner, self.token = owner, token

    def __missing__(self, left: int) -> bool:
        if len(self) >= FOLLOWERS:
            self.clear()
        tokens, before = self.owner.tokens, [left] if left >= 0 else []
        known = self[left] = self.owner.merged(tokens.get(left, b"") + tokens[self.token]) == [*before, self.token]
        return known


class Transducer:
    """Bytes of one pre-token to the ids of its BPE encoding.

    A state is the longest end of what was read that begins some token; its outputs are the tokens that end there. Moves
    and outputs are worked out when first needed, at most one state for each node of the trie. Every prefix of the input
    has one encoding, so among the outputs one token at most may follow the encoding of what stands before it.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.verdicts: dict[int, Verdicts] = {}
        self.states: dict[bytes, State | None] = {token[:n]: None for token in ranks for n in range(1, len(token) + 1)}
        self.start = self.states[b""] = State(self, b"")

    def merged(self, data: bytes) -> list[int]:
        """The definition: join the neighbours of lowest rank, leftmost first, until none can be joined."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, rank = -1, 1 << 60
            for i in range(len(parts) - 1):
                found = self.ranks.get(parts[i] + parts[i + 1], rank)
                if found < rank:
                    best, rank = i, found
            if best < 0:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[part] for part in parts]

    def encode(self, data: bytes) -> list[int]:
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        state, last, out = self.start, [-1], []  # last[i]: the token that ends the encoding of the first i bytes not yet emitted
        for at in range(0, len(data), LOOKAHEAD):
            for byte in data[at:at + LOOKAHEAD]:
                state = state[byte]
                for back, verdicts, token in state.outputs:
                    if verdicts[last[back]]:
                        last.append(token)
                        break
            if at + LOOKAHEAD < len(data):
                self._emit(last, out)
        return out + self._chain(last, len(last) - 1)

    def _chain(self, last: list[int], end: int) -> list[int]:
        ids, tokens = [], self.tokens
        while end > 0:
            ids.append(last[end])
            end -= len(tokens[last[end]])
        return ids[::-1]

    def _emit(self, last: list[int], out: list[int]) -> None:
        """Moves the tokens on which the encodings of all recent prefixes agree to ``out``."""
        ends = {len(last) - 1 - n for n in range(self.longest)}  # every later token begins at one of these
        while len(ends) > 1:
            end = max(ends)
            ends.remove(end)
            ends.add(end - len(self.tokens[last[end]]))
        cut = ends.pop()
        out += self._chain(last, cut)
        del last[:cut]


class Encoder(dict):
    """Chunks of text to their ids as little-endian 32-bit integers, remembered in two generations of CHUNKS.

    A blank between two characters that are no white space always starts a match, so texts are cut there. A chunk that
    shows its blanks to stand otherwise is remembered as None, and its text is matched as a whole. Under the public pattern a
    blank and letters are one match, so such chunks need no matching.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.older: dict[str, bytes | None] = {}
        self.transducer = Transducer(ranks)
        self.matches = regex.compile(pattern).findall
        self.letters_match = pattern == public_tokenizers.PATTERN

    def _packed(self, match: str) -> bytes:
        ids = self.transducer.encode(match.encode())
        return PACK[len(ids)](*ids) if len(ids) < len(PACK) else struct.pack(f"<{len(ids)}I", *ids)

    def _matched(self, text: str) -> bytes:
        return b"".join([self._packed(match) if match[-1].isspace() or match[1:2].isspace() else self[match] for match in self.matches(text)])

    def __missing__(self, chunk: str) -> bytes | None:
        if chunk in self.older:
            found = self.older[chunk]
        elif self.letters_match and chunk[:1] == " " and chunk[1:].isalpha():
            found = self._packed(chunk)
        elif not chunk or chunk[-1].isspace() or chunk[1:2].isspace():
            found = None
        else:
            parts = self.matches(chunk)
            found = self._packed(chunk) if parts == [chunk] else self._matched(chunk)
        if len(chunk) <= 64:
            if len(self) >= CHUNKS:
                self.older = dict(self)
                self.clear()
            self[chunk] = found
        return found

    def forget(self) -> None:
        """Drop the chunks, not the machine: a worker outlives its task and shares its executor's memory."""
        self.clear()
        self.older = {}

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = text.split(" ")
        try:
            return b"".join([self[first], *[self[" " + chunk] for chunk in rest]])
        except TypeError:  # a None among them
            return self._matched(text)


class Utf8Stream:
    """An incremental UTF-8 machine: takes bytes in any pieces, gives back whole characters.

    Its state is the unfinished character at the end of what was fed. Malformed bytes become U+FFFD.
    """

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for back in range(1, min(4, len(data)) + 1):
            byte = data[-back]
            if byte >= 0xC0:
                if back < (2 if byte < 0xE0 else 3 if byte < 0xF0 else 4):
                    cut -= back
                break
            if byte < 0x80:
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class Decoder:
    """Ids back to bytes and text, a block of ids at a time."""

    def __init__(self, ranks: dict[bytes, int], block: int = 1 << 16):
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.block = block

    def text(self, packed: bytes) -> str:
        ids, stream, out = np.frombuffer(packed, "<u4"), Utf8Stream(), []
        for at in range(0, len(ids), self.block):
            out.append(stream.feed(b"".join([self.tokens[i] for i in ids[at:at + self.block].tolist()])))
        return "".join([*out, stream.close()])


_WORKERS: dict[tuple, object] = {}  # a machine determinised by one task serves the next


def _worker(kind, content: bytes, *rest):
    key = (kind, hash(content), *rest)
    if key not in _WORKERS:
        _WORKERS[key] = kind(load_ranks(content), *rest)
    return _WORKERS[key]


def _content(spark: SparkSession, vocabulary: str):
    with open(vocabulary, "rb") as file:  # an installed file of under a megabyte, not an input
        return spark.sparkContext.broadcast(file.read())


def encode(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``df`` with ``n_tokens`` and ``ids``, the ids as packed little-endian unsigned 32-bit integers (``unpack`` gives an array).

    Null and empty texts have no ids. Every row is encoded by itself, so rows may repeat and other columns may hold
    anything; columns of ``df`` named ``n_tokens`` or ``ids`` are replaced. An empty table gives an empty table.
    """
    content = _content(df.sparkSession, vocabulary)
    kept = df.drop("n_tokens", "ids")
    schema = kept.withColumns({"n_tokens": F.lit(0).cast("long"), "ids": F.lit(b"")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker(Encoder, content.value, pattern)
        for batch in batches:
            at, rows = 0, batch.column(text)
            while at < len(rows):
                ids, size = [], 0
                while at + len(ids) < len(rows) and size < 8 << 20:
                    ids.append(encoder.encode(rows[at + len(ids)].as_py() or ""))
                    size += len(ids[-1])
                part = batch.slice(at, len(ids))
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, counts, pa.array(ids, pa.binary())], [*part.schema.names, "n_tokens", "ids"])
                at += len(ids)
        encoder.forget()

    return kept.mapInArrow(tidy(run), schema)


def decode(df: DataFrame, ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with ``decoded``, the text of packed ids; null ids give an empty text. A column of that name is replaced."""
    content = _content(df.sparkSession, vocabulary)
    kept = df.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _worker(Decoder, content.value)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, size = [], 0
                while at + len(texts) < batch.num_rows and size < 8 << 20:
                    texts.append(decoder.text(batch.column(ids)[at + len(texts)].as_py() or b""))
                    size += len(texts[-1])
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])
                at += len(texts)

    return kept.mapInArrow(tidy(run), kept.withColumn("decoded", F.lit("")).schema)


def unpack(packed: bytes) -> list[int]:
    return np.frombuffer(packed or b"", "<u4").tolist()


def digests(encoded: DataFrame) -> DataFrame:
    """Hashes of the ids and of what they decode to."""
    return decode(encoded).withColumns({"ids_sha256": F.sha2("ids", 256), "decoded_sha256": F.sha2(text_bytes("decoded"), 256)})


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every whole text of ``documents``; null and empty texts have no ids, no row is merged (see ``encode``)."""
    return digests(encode(documents(spark, sf_dir))).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
