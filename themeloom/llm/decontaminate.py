"""Benchmark decontamination: counts of shared byte runs by diagonal, exact edit verification.

Texts and items are compared as lower-cased words joined by single spaces. An edit spoils at most GRAM of an item's runs of
GRAM bytes, so a passage within the allowed edits keeps a known number of them, all within that many diagonals (place in
the text less place in the item). Runs are counted by item and band of diagonals; every band that reaches the number is
verified by exact edit distance. The commonest runs of an item are not counted and the number falls by as many, so that no
passage is lost at any place, of any wording.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm.common import LOWER, documents, slices, table, tidy, words

EDITS = 0.15
"""Greatest edit distance of a match as a share of the item's length."""
LEAST_WORDS, LEAST_CHARS = 8, 32
"""Items under both are looked for letter for letter only, as whole words where their script parts words."""
GRAM = 5
"""Bytes of a run. An item of 15 bytes or more keeps at least one run at the allowed edits."""
CELLS, EVENTS, STEP = 1 << 22, 1 << 21, 1 << 18
"""Bands counted at a time, runs added at a time, and bytes of text at a time: they bound memory only."""
ITEM_BYTES = 1 << 20
"""Bytes of items that one pass over the texts looks for; more items take more passes."""
LONG, LONG_CHARS = 200, 1_600
"""Words of an item that are looked for as one: longer items are cut into pieces of about equal length, and one piece found is the item found. An item with a word of more than LONG_CHARS is cut by characters."""
U = np.uint64
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
"""Code points of scripts without blanks between words."""


def normalised(blob: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, lower-cased and each with a blank behind it, as one array, and where each text begins in it, and its end."""
    blob = LOWER[blob]
    starts, ends, text = words(blob, offsets, BETWEEN)
    size = ends - starts + 1
    place = np.cumsum(size) - size
    source = np.repeat(starts - place, size) + np.arange(int(size.sum()))
    out = np.concatenate((blob, np.zeros(1, np.uint8)))[source]
    out[place + size - 1] = 32
    number = np.bincount(text, minlength=len(offsets) - 1)
    return out, np.append(place, len(out))[np.concatenate(([0], np.cumsum(number)))]


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)


def runs(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """The ``size`` (8 at most) bytes from each place on as one number, zeros beyond the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eights = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), shape=(len(data),), strides=(1,), writeable=False)
    return eights & (U(0xFFFFFFFFFFFFFFFF) >> U(64 - 8 * size))


class Runs:
    """Numbers with their rows: a table of slots, in each of which the numbers lie side by side."""

    BITS = 20

    def __init__(self, numbers: np.ndarray):
        """``rows``: the order of the rows in which equal numbers are neighbours; ``pairs`` counts rows in it."""
        self.rows = np.argsort(numbers, kind="stable")
        self.numbers, self.first, self.count = np.unique(numbers[self.rows], return_index=True, return_counts=True)
        order = np.argsort(self.slot(self.numbers), kind="stable")
        self.numbers, self.first, self.count = self.numbers[order], self.first[order], self.count[order]
        slots = self.slot(self.numbers)
        self.table = np.full(1 << self.BITS, -1, np.int32)
        self.table[slots[::-1]] = np.arange(len(slots), dtype=np.int32)[::-1]
        self.deep = int(np.bincount(slots).max()) if len(slots) else 0

    def slot(self, numbers: np.ndarray) -> np.ndarray:
        return ((numbers * U(0x9E3779B97F4A7C15)) >> U(64 - self.BITS)).astype(np.int64)

    def find(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``numbers`` of those held, and which of the distinct ones each is."""
        slot = self.table[self.slot(numbers)]
        near = np.flatnonzero(slot >= 0)
        slot, wanted = slot[near], numbers[near]
        places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for deep in range(self.deep):
            at = np.minimum(slot + deep, len(self.numbers) - 1)
            same = self.numbers[at] == wanted
            places.append(near[same])
            found.append(at[same])
            if deep + 1 < self.deep:
                near, slot, wanted = near[~same], slot[~same], wanted[~same]
        return np.concatenate(places), np.concatenate(found)

    def pairs(self, places: np.ndarray, found: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place, row) of all rows of the numbers found, about EVENTS at a time."""
        count = self.count[found]
        sums = np.cumsum(count)
        start = 0
        while start < len(places):
            base = sums[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sums, base + EVENTS, side="right")))
            n = count[start:stop]
            total = int(n.sum())
            row = np.repeat(self.first[found[start:stop]] - (np.cumsum(n) - n), n) + np.arange(total)
            yield np.repeat(places[start:stop], n), row
            start = stop


def unspaced(char: str) -> bool:
    return any(low <= ord(char) <= high for low, high in UNSPACED)


@dataclass
class Index:
    """Items in their normalised form, the counted runs of the long ones and one run of each short one."""

    ids: list[int]
    items: list[bytes]
    most: np.ndarray
    long: np.ndarray
    least: np.ndarray
    item: np.ndarray
    place: np.ndarray
    counted: Runs
    runs_of: list[list[int]]
    short: list[tuple[int, np.ndarray, np.ndarray, Runs]]

    @classmethod
    def build(cls, ids: list[int], texts: list[str], edits: float = EDITS) -> Index:
        data, bounds = normalised(*joined(texts))
        items = [data[a:max(a, b - 1)].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        size = np.array([len(i) for i in items], np.int64)
        short = np.array([i.count(b" ") + 1 < LEAST_WORDS and len(i.decode("utf-8", "replace")) < LEAST_CHARS for i in items], bool)
        most = np.where(short, 0, (edits * size).astype(np.int64))
        long = np.flatnonzero(~short & (size >= GRAM))
        item = np.repeat(long, size[long] - GRAM + 1)
        place = np.concatenate([np.arange(size[n] - GRAM + 1) for n in long]) if len(long) else np.zeros(0, np.int64)
        number = runs(data)[bounds[item] + place]
        _, which, often = np.unique(number, return_inverse=True, return_counts=True)
        often = often[which]
        # Of the runs that must be left, a third may go uncounted: those that occur most in the items.
        needed = np.maximum(1, size - GRAM + 1 - GRAM * most)
        order = np.lexsort((place, -often, item))
        rank = np.empty(len(item), np.int64)
        begin = np.searchsorted(item, item, side="left")
        rank[order] = np.arange(len(item)) - begin[order]
        keep = rank >= (needed // 3)[item]
        least = needed - needed // 3
        shorts = []
        for width in range(1, GRAM + 1):
            some = np.flatnonzero(short & (np.minimum(size, GRAM) == width))
            if len(some):
                at = np.array([cls._rarest(runs(data[bounds[n]:bounds[n] + size[n]], width)[:size[n] - width + 1]) for n in some])
                held = Runs(runs(data, width)[bounds[some] + at])
                shorts.append((width, some[held.rows], at[held.rows], held))
        counted = Runs(number[keep])
        return cls(ids, items, most, long, least, item[keep][counted.rows], place[keep][counted.rows], counted, [runs(data[a:a + n])[:max(0, n - GRAM + 1)].tolist() if n else [] for a, n in zip(bounds, size)], shorts)

    @staticmethod
    def _rarest(numbers: np.ndarray) -> int:
        """The place of the run with most letters that are not blanks; any would do."""
        blanks = np.array([int(n).to_bytes(8, "little").count(32) for n in numbers])
        return int(blanks.argmin())

    def matches(self, blob: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, item, distance) of every item found in a text; the distance is the least to any part of the text."""
        data, bounds = normalised(blob, offsets)
        found: dict[tuple[int, int], int] = {}
        if len(self.item) and len(data):
            self._near(data, bounds, found)
        if self.short and len(data):
            self._equal(data, bounds, found)
        return [(*key, distance) for key, distance in sorted(found.items())]

    def _near(self, data: np.ndarray, bounds: np.ndarray, found: dict[tuple[int, int], int]) -> None:
        size = np.array([len(i) for i in self.items], np.int64)
        longest, width = int(size[self.long].max()), self.most + 1
        reach = int((size + self.most)[self.long].max()) + GRAM
        step = max(reach, min(STEP, len(data), int(CELLS / (1 / width[self.long]).sum())))
        bands = np.zeros(len(size), np.int64)
        bands[self.long] = (step + reach + longest) // width[self.long] + 2
        base = np.cumsum(bands) - bands
        least, numbers = np.repeat(self.least, bands), runs(data)
        # The band is the diagonal by the width, rounded down: the half keeps products of floats off whole numbers.
        share = 1 / width[self.item]
        ahead = (longest - self.place + 0.5) * share + base[self.item]
        # Of two neighbours that reach the number together one has at least half of it.
        half = (int(self.least[self.long].min()) + 1) // 2
        for start in range(0, len(data), step):
            counts = None
            for at, row in self.counted.pairs(*self.counted.find(numbers[start:start + step + reach])):
                cell = share[row]
                cell *= at
                cell += ahead[row]
                more = np.bincount(cell.astype(np.int64), minlength=len(least) + 1)
                counts = more if counts is None else np.add(counts, more, out=counts)
            if counts is None:
                continue
            some = counts >= half
            some = np.flatnonzero(some[:-1] | some[1:])
            some = some[counts[some] + counts[some + 1] >= least[some]]
            which = np.searchsorted(base, some, side="right") - 1
            # What lies in one band makes two pairs of neighbours reach the number: they are verified as one.
            after = np.zeros(len(some), bool)
            after[1:] = (some[1:] == some[:-1] + 1) & (which[1:] == which[:-1])
            run = np.arange(len(some)) - np.maximum.accumulate(np.where(after, 0, np.arange(len(some))))
            first = run % 2 == 0
            both = np.append(after[1:] & first[:-1], np.zeros(min(1, len(some)), bool))
            for cell, n, more in zip(some[first].tolist(), which[first].tolist(), both[first].tolist()):
                low = start + (cell - int(base[n])) * int(width[n]) - longest
                self._verify(data, numbers, bounds, n, low - int(self.most[n]), low + (2 + more) * int(width[n]) + int(size[n] + self.most[n]), found)

    def _verify(self, data: np.ndarray, numbers: np.ndarray, bounds: np.ndarray, n: int, low: int, high: int, found: dict[tuple[int, int], int]) -> None:
        """The texts between two places against item ``n``."""
        item, most = self.items[n], int(self.most[n])
        text = int(np.searchsorted(bounds, max(low, 0), side="right")) - 1
        while text < len(bounds) - 1 and bounds[text] < high:
            left, right = max(low, int(bounds[text])), min(high, int(bounds[text + 1]) - 1)
            best = found.get((text, n), most + 1)
            if best and right - left >= len(item) - most:
                there = set(numbers[left:max(left, right - GRAM + 1)].tolist())
                if sum(map(there.__contains__, self.runs_of[n])) >= len(self.runs_of[n]) - GRAM * (best - 1):
                    distance = infix_distance(item, data[left:right].tobytes())
                    if distance < best:
                        found[text, n] = distance
            text += 1

    def _equal(self, data: np.ndarray, bounds: np.ndarray, found: dict[tuple[int, int], int]) -> None:
        whole = data.tobytes()
        for width, some, place, held in self.short:
            for at, row in held.pairs(*held.find(runs(data, width))):
                start = at - place[row]
                text = np.searchsorted(bounds, start, side="right") - 1
                for begin, t, n in zip(start.tolist(), text.tolist(), some[row].tolist()):
                    item = self.items[n]
                    end = begin + len(item)
                    if (t, n) in found or begin < 0 or end >= bounds[t + 1] or not whole.startswith(item, begin):
                        continue
                    chars = item.decode("utf-8", "replace")
                    if (begin == bounds[t] or whole[begin - 1] == 32 or unspaced(chars[0])) and (whole[end] == 32 or unspaced(chars[-1])):
                        found[t, n] = 0


def pieces(text: str) -> list[str]:
    """The words of a lower-cased text in runs of about equal number, LONG at most; the characters if a word has more than
    LONG_CHARS. None without any letter or digit."""
    found = WORD.findall(text)
    if max(map(len, found), default=0) > LONG_CHARS:
        whole = " ".join(found)
        count = -(-len(whole) // LONG_CHARS)
        return [whole[n * len(whole) // count:(n + 1) * len(whole) // count] for n in range(count)]
    count = -(-len(found) // LONG)
    return [" ".join(found[n * len(found) // count:(n + 1) * len(found) // count]) for n in range(count)]


def may_hold(item: bytes, text: bytes, edits: int, size: int = 5) -> bool:
    """Whether enough short runs of ``item`` occur in ``text`` for that many edits, each of which spoils ``size`` runs at most."""
    if item in text:
        return True
    runs = {text[n:n + size] for n in range(len(text) - size + 1)}
    spare = size * edits
    for n in range(len(item) - size + 1):
        if item[n:n + size] not in runs:
            spare -= 1
            if spare < 0:
                return False
    return True


def infix_distance(item: bytes, text: bytes) -> int:
    """The least edit distance of ``item`` to any part of ``text``: columns of differences as the bits of integers."""
    if item in text:
        return 0
    size = len(item)
    full, top = (1 << size) - 1, 1 << (size - 1)
    places: dict[int, int] = {}
    for n, byte in enumerate(item):
        places[byte] = places.get(byte, 0) | 1 << n
    plus, minus, score, best = full, 0, size, size
    for byte in text:
        equal = places.get(byte, 0)
        flat = equal | minus
        across = (((equal & plus) + plus) ^ plus) | equal
        up, down = minus | (full & ~(across | plus)), plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(flat | up)), up & flat
        best = min(best, score)
    return best


def leaks(df: DataFrame, items: DataFrame, edits: float = EDITS, text: str = "text") -> DataFrame:
    """``df`` with ``leaks``, the items (item_id, distance) found in each text, by item; none for null and empty texts.

    ``items``: item_id, text. Items without an id, or without any letter or digit, are not looked for; those under
    LEAST_WORDS words and LEAST_CHARS characters are found where a text holds them letter for letter (distance 0). Of items
    that repeat an id each is looked for, and the least distance counts. A column named ``leaks`` is replaced; an empty table gives an
    empty table. Items are read to the driver and sent to all tasks ITEM_BYTES at a time, whatever their number.
    """
    kept = [c for c in df.columns if c != "leaks"]
    spark = df.sparkSession
    kind = "array<struct<item_id: long, distance: int>>"
    arrow = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())]))

    def search(frame: DataFrame, ids: list[int], texts: list[str]) -> DataFrame:
        index = spark.sparkContext.broadcast(Index.build(ids, texts, edits))
        schema = frame.select(*kept, F.col("__text"), F.expr(f"cast(null as {kind})").alias("leaks")).schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, blob, offsets in slices(batches, "__text"):
                rows = [{row["item_id"]: row["distance"] for row in found or ()} for found in part.column("leaks").to_pylist()]
                for n, item, distance in index.value.matches(blob, offsets):
                    name = index.value.ids[item]
                    rows[n][name] = min(distance, rows[n].get(name, distance))
                found = pa.array([[{"item_id": i, "distance": d} for i, d in sorted(row.items())] for row in rows], arrow)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], part.column("__text"), found], [*kept, "__text", "leaks"])

        return frame.mapInArrow(tidy(run), schema)

    lower = F.coalesce(F.lower(F.col(text)).cast("binary"), F.lit(b"")).alias("__text")
    frame = df.select(*kept, lower, F.expr(f"cast(array() as {kind})").alias("leaks"))
    ids, texts, size = [], [], 0
    for row in items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", F.lower("text").alias("text")).orderBy("item_id", "text").toLocalIterator():
        for piece in pieces(row.text):
            ids.append(row.item_id)
            texts.append(piece)
            size += len(piece)
        if size >= ITEM_BYTES:
            frame = search(frame, ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        frame = search(frame, ids, texts)
    return frame.select(*kept, "leaks")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: whether it is contaminated, by which items, and the least distance."""
    found = leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select(
        "doc_id", (F.size("leaks") > 0).alias("contaminated"), F.transform("leaks", lambda x: x["item_id"]).alias("item_ids"),
        F.array_min(F.transform("leaks", lambda x: x["distance"])).alias("distance"),
    )
