"""Jaccard join of word shingle sets by universe partition and the pigeonhole principle, and its components.

Two linked sets of sizes x <= y differ in at most h tokens. Hash the tokens into more than h segments: in one segment at
least the two sets are equal. Sizes are cut into bands so that linked sets lie in one band or in neighbouring ones, and
each band has its own number of segments. A band may instead use half as many segments and add, for each, the segment
without one of its tokens (one-deletion neighbourhoods): then one segment differs by a token at most. The cheaper of the
two is taken, from the sets that the band holds and from how often two of them have a token in common by chance. Sets that
share a key are candidates.

Empty segments are not indexed. With s segments more than needed, a set with at most s empty ones still has enough; a set
with more is indexed under further hash seeds too until it has enough, so two such sets meet under one of those.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from themeloom.llm.common import LOWER, documents, hashes, mix, slices, text_bytes, tidy, words
from themeloom.operators.graph import merge_components
from themeloom.session import cut_lineage, tasks

GROUP = 32
"""Sets that share a key are paired with each other up to this many; larger groups go through ``_block_links``, as exactly."""
HOT = 2048
"""Up to this many sets under a key are first split by their sizes and parity bits into those that can be connected at all."""
PAIR, MEMBER, STAR = 0, 1, 2
BLOCK = 256
"""Sets that a task compares with each other at a time in a large group."""
PIVOTS = 16
"""Sets of a large group that are compared with all others first."""
KEYS = 1_000_000
"""Keys that a task gathers before it sends them on."""
BUCKET_KEYS = 400_000
"""Keys of a bucket, about: a bucket is held in memory as a whole, so their number follows from the keys expected."""
SEEDS = 12
PAIR_KEYS = 8
"""Bytes that a candidate pair moves (two names, two sizes, parity bits) over those of a key."""
SAMPLE_BITS = 6
"""Tokens whose hash begins with so many zero bits stand for all when chance matches are estimated."""
U = np.uint64


class Rule:
    """Shingle length, the threshold ``num / den`` as a fraction, and the index plan of each size band.

    ``sets`` tells how many sets there are of a size, and ``rate`` how often two token occurrences of different sets are equal;
    they only choose between plans that find the same links.
    """

    def __init__(self, length: int = 4, num: int = 85, den: int = 100, sets: list[tuple[float, int]] = (), rate: float = 0.0):
        self.length, self.num, self.den, self.hot = length, num, den, HOT
        self.starts, self.segments, self.needed, self.deletes, self.keys = self._plan(1 << 40, sets, rate)

    def fitted(self, sets: list[tuple[float, int]], rate: float) -> Rule:
        rule = Rule(self.length, self.num, self.den, sets, rate)
        rule.hot = self.hot
        return rule

    def least_common(self, sizes):
        """The least intersection of linked sets whose sizes add up to this."""
        return -(-self.num * sizes // (self.num + self.den))

    def _plan(self, most: int, sets: list[tuple[float, int]], rate: float) -> tuple[np.ndarray, ...]:
        starts = [1]
        while starts[-1] <= most:
            starts.append(starts[-1] * self.den // self.num + 1)
        held = np.zeros(len(starts))
        for size, count in sets:
            held[np.searchsorted(starts, size, side="right") - 1] += count
        segments, needed, deletes, keys = [], [], [], 0.0
        for k in range(len(starts) - 2):
            large = starts[k + 1] - 1
            total = large + min(starts[k + 2] - 1, large * self.den // self.num)
            # The difference bound rises with the sum but for steps of one, so the last few sums hold its maximum.
            h = max(s - 2 * self.least_common(s) for s in range(max(2 * starts[k], total - 4), total + 1))
            exact, per = h + 1, starts[k] / (h + 1)
            empty = exact * math.exp(-per)
            exact += math.ceil(empty + 2.5 * math.sqrt(empty)) if h > 0 else 0  # seldom is a set short of segments then
            half = -(-(h + 1) // 2)
            # A band's own sets and those of the band above are filed under its plan. Two segments meet by chance when
            # neither holds a token that the other lacks, or one at most where a token may be left out.
            filed, common = held[k] + held[k + 1], min(1.0, starts[k] * rate)
            apart = lambda parts: starts[k] / parts * (1 - common)
            pairs = exact * math.exp(-2 * apart(exact)) * -math.expm1(-starts[k] / exact * common) * filed * filed / 2
            pairs_deletes = half * math.exp(-2 * apart(half)) * (1 + apart(half)) ** 2 * filed * filed / 2
            cost, cost_deletes = exact * filed + PAIR_KEYS * pairs, (half + starts[k]) * filed + PAIR_KEYS * pairs_deletes
            use = h > 0 and cost_deletes < cost
            segments.append(half if use else exact)
            needed.append(h + 1)
            deletes.append(use)
            keys += filed * (half + starts[k] if use else exact)
        return np.array(starts), np.array(segments), np.array(needed), np.array(deletes), keys


def shingle_sets(blob: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes, sorted within their texts; the text of each; how many each text has."""
    blob, count = LOWER[blob], len(offsets) - 1
    starts, ends, text = words(blob, offsets)
    word = hashes(blob, starts, ends)
    held = np.bincount(text, minlength=count)
    found, of = np.zeros(0, U), np.zeros(0, np.int64)
    if len(word) >= length:
        found = word[:len(word) - length + 1].copy()
        for n in range(1, length):
            found = mix(found) + word[n:len(word) - length + 1 + n]
        inside = text[:len(found)] == text[length - 1:]
        found, of = mix(found[inside]), text[:len(inside)][inside]
    first = np.concatenate(([0], np.cumsum(held)))
    for n in range(1, length):  # texts with fewer words than a shingle
        short = np.flatnonzero(held == n)
        if len(short):
            whole = word[first[short]].copy()
            for k in range(1, n):
                whole = mix(whole) + word[first[short] + k]
            found, of = np.concatenate((found, mix(whole + U(n)))), np.concatenate((of, short))
    order = np.lexsort((found, of))
    found, of = found[order], of[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
    found, of = found[new], of[new]
    return found, of, np.bincount(of, minlength=count)


def signatures(found: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, as signed integers."""
    ends = np.cumsum(sizes)
    sums = np.concatenate((np.zeros(1, U), np.cumsum(mix(found ^ U(0x51ED270B3A7C0F65)))))
    return mix(sums[ends] - sums[ends - sizes] + mix(sizes.astype(U))).view(np.int64)


def parities(found: np.ndarray, of: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """For each set the parity of its tokens in 2**k buckets, k growing with its size. Sets differ in at least as many tokens as bits."""
    bits = np.maximum(6, np.ceil(np.log2(np.maximum(sizes, 1) * 2))).astype(np.int64)
    width = 1 << bits
    base = np.concatenate(([0], np.cumsum(width)))
    flips = np.bincount(base[of] + (mix(found) >> (64 - bits[of]).astype(U)).astype(np.int64), minlength=base[-1]) & 1
    packed = np.packbits(flips.astype(np.uint8)).tobytes()
    return [packed[base[n] >> 3:base[n + 1] >> 3] for n in range(len(sizes))]


def segment_keys(rule: Rule, found: np.ndarray, of: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of sets and the set of each: under the scheme of its size band and under that of the band below."""
    band = np.searchsorted(rule.starts, sizes, side="right") - 1
    keys, owners = [], []
    for below in (0, 1):
        scheme = band - below
        todo = (sizes > 0) & (scheme >= 0)
        for seed in range(SEEDS):
            if not todo.any():
                break
            segments = np.where(todo, rule.segments[np.maximum(scheme, 0)], 0)
            base = np.concatenate(([0], np.cumsum(segments)))
            use = todo[of]
            token, owner = found[use], of[use]
            salt = mix((scheme[owner] * SEEDS + seed).astype(U))
            slot = base[owner] + (mix(token ^ salt) % segments[owner].astype(U)).astype(np.int64)
            share = mix(token ^ U(0x2545F4914F6CDD1D))
            content = np.zeros(base[-1], U)
            np.add.at(content, slot, share)
            full = np.zeros(base[-1], bool)
            full[slot] = True
            of_slot = np.repeat(np.arange(len(sizes)), segments)
            name = mix(((scheme[of_slot] * SEEDS + seed) << 32).astype(U) + (np.arange(base[-1]) - base[of_slot]).astype(U))
            deletes = rule.deletes[np.maximum(scheme, 0)]
            lacking = todo & ~deletes & (np.bincount(of_slot, weights=full, minlength=len(sizes)) < rule.needed[np.maximum(scheme, 0)])
            kept = full | deletes[of_slot] | (lacking[of_slot] if seed == SEEDS - 1 else False)
            keys.append(mix(content[kept] + name[kept]))
            owners.append(of_slot[kept])
            less = deletes[owner]
            keys.append(mix(content[slot[less]] - share[less] + name[slot[less]]))
            owners.append(owner[less])
            todo = lacking
    return (np.concatenate(keys), np.concatenate(owners)) if keys else (np.zeros(0, U), np.zeros(0, np.int64))


def _groups(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, node) in order, with the start and length of each key."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    keys, nodes = keys[new], nodes[new]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return keys, nodes, first, np.diff(np.append(first, len(keys)))


def _stars(nodes: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(least node, node) of every other node of each group."""
    at = np.repeat(first, size - 1) + np.concatenate([np.zeros(0, np.int64), *[np.arange(1, n) for n in size]])
    return np.unique(np.column_stack((np.repeat(nodes[first], size - 1), nodes[at])), axis=0)


def _candidates(docs: DataFrame, rule: Rule, parts: int) -> DataFrame:
    """(a, b, kind): PAIRs of sets that share a key; the MEMBERs b of keys a of more than GROUP sets; a STAR over those of more than HOT."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            keys, nodes, first, size = _groups(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))
            held.clear()
            # A hot key leaves the task as a star over its sets, and as just enough sets to be known as hot.
            rank = np.arange(len(keys)) - np.repeat(first, size)
            stars = _stars(nodes, first[size > rule.hot], size[size > rule.hot])
            keys, nodes = keys[rank <= rule.hot], nodes[rank <= rule.hot]
            bucket = ((keys >> U(20)) % U(parts)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            keys, nodes, bucket = keys[order], nodes[order], bucket[order]
            cuts = np.searchsorted(bucket, np.arange(parts + 1))
            rows = []
            for n in np.flatnonzero(np.diff(cuts)):
                own, at = np.unique(nodes[cuts[n]:cuts[n + 1]], return_inverse=True)
                rows.append((int(n), own.tobytes(), at.astype(np.uint16 if len(own) < 1 << 16 else np.uint32).tobytes(), keys[cuts[n]:cuts[n + 1]].tobytes()))
            rows += [(int(n % parts), stars[n::parts].tobytes(), b"", b"") for n in range(min(parts, len(stars)))]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "nodes", "at", "keys"])

        for _, blob, offsets in slices(batches):
            found, of, sizes = shingle_sets(blob, offsets, rule.length)
            names = signatures(found, sizes)
            own, first, which = np.unique(names, return_index=True, return_inverse=True)
            distinct = np.isin(np.arange(len(names)), first)  # equal sets are one node
            use = distinct[of]
            keys, owners = segment_keys(rule, found[use], of[use], np.where(distinct, sizes, 0))
            if len(keys):
                held.append((keys, names[owners]))
            if sum(len(k) for k, _ in held) >= KEYS:
                yield flush()
        if held:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, small, stars = [np.zeros(0, U)], [np.zeros(0, np.int64)], [], []
        for batch in batches:
            for own, at, some in zip(*(batch.column(c).to_pylist() for c in ("nodes", "at", "keys"))):
                own, some = np.frombuffer(own, np.int64), np.frombuffer(some, U)
                if len(some):
                    keys.append(some)
                    nodes.append(own[np.frombuffer(at, np.uint16 if len(own) < 1 << 16 else np.uint32)])
                else:
                    stars.append(own.reshape(-1, 2))
        keys, nodes = np.concatenate(keys), np.concatenate(nodes)
        order = np.argsort(keys, kind="stable")
        same = np.diff(keys[order]) == 0
        order = order[np.concatenate((same, [False])) | np.concatenate(([False], same))] if len(order) else order  # most keys are one set's
        keys, nodes, first, size = _groups(keys[order], nodes[order])
        stars.append(_stars(nodes, first[size > rule.hot], size[size > rule.hot]))
        middle = np.repeat((size > GROUP) & (size <= rule.hot), size)
        members = np.column_stack((keys.view(np.int64)[middle], nodes[middle]))
        for n in range(2, GROUP + 1):
            of = nodes[first[size == n][:, None] + np.arange(n)]
            a, b = np.triu_indices(n, 1)
            small.append(np.column_stack((of[:, a].ravel(), of[:, b].ravel())))
        for pairs, kind in ((np.unique(np.concatenate(small), axis=0), PAIR), (members, MEMBER), (np.unique(np.concatenate(stars), axis=0), STAR)):
            for at in range(0, len(pairs), 100_000):
                part = pairs[at:at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1]), pa.array([kind] * len(part), pa.int32())], ["a", "b", "kind"])

    cells = docs.mapInArrow(tidy(send), "bucket int, nodes binary, at binary, keys binary")
    return cells.repartition(parts, "bucket").mapInArrow(tidy(meet), "a long, b long, kind int").distinct()


def _describe(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles, node (null without words), parity bits and sampled tokens of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, blob, offsets in slices(batches):
            found, of, sizes = shingle_sets(blob, offsets, rule.length)
            nodes = pa.array(signatures(found, sizes), mask=sizes == 0)
            some = found >> U(64 - SAMPLE_BITS) == 0
            cuts = np.concatenate(([0], np.cumsum(np.bincount(of[some], minlength=part.num_rows)))).astype(np.int32)
            sample = pa.ListArray.from_arrays(pa.array(cuts), pa.array(found[some].view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes.astype(np.int64)), nodes, pa.array(parities(found, of, sizes), pa.binary()), sample], ["doc_id", "n_shingles", "node", "parity", "sample"])

    return docs.mapInArrow(tidy(run), "doc_id long, n_shingles long, node long, parity binary, sample array<long>")


def _fitted(rule: Rule, info: DataFrame) -> Rule:
    """The rule with plans that fit the distinct sets (size, sample): a row for each size class and two sums reach the driver."""
    classes = F.floor(F.log(F.col("size").cast("double")) / math.log(rule.den / rule.num)) if rule.num < rule.den else F.floor(F.log2(F.col("size").cast("double")))
    sets = [(row.size, row.sets) for row in info.groupBy(classes.alias("class")).agg(F.avg("size").alias("size"), F.count("*").alias("sets")).collect()]
    often = info.select(F.explode("sample").alias("token")).groupBy("token").agg(F.count("*").cast("double").alias("n"))
    all_, equal = often.agg(F.sum("n"), F.sum(F.col("n") * (F.col("n") - 1))).first()
    return rule.fitted(sets, equal / all_ / all_ / (1 << SAMPLE_BITS) if all_ else 0.0)


def _possible(rule: Rule, size_a: int, size_b: int, parity_a: bytes, parity_b: bytes) -> bool:
    """Whether sizes and parity bits leave room for a link."""
    if rule.den * min(size_a, size_b) < rule.num * max(size_a, size_b):
        return False
    a, b = np.frombuffer(parity_a, np.uint8), np.frombuffer(parity_b, np.uint8)
    while len(a) != len(b):  # the top bits of a hash number its bucket, so neighbours fold into one
        wide = np.unpackbits(a if len(a) > len(b) else b)
        folded = np.packbits(wide[::2] ^ wide[1::2])
        a, b = (folded, b) if len(a) > len(b) else (a, folded)
    both = size_a + size_b
    return int(np.bitwise_count(a ^ b).sum()) <= both - 2 * rule.least_common(both)


def _promising(pairs: DataFrame, rule: Rule) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("size_a", "size_b", "parity_a", "parity_b")))
            keep = pa.array([_possible(rule, *row) for row in rows], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    return pairs.mapInArrow(tidy(run), "a long, b long")


def _connected(rule: Rule, sizes: np.ndarray, parities: list[bytes]) -> np.ndarray:
    """For each set the first of those that possible links connect it with."""
    folded = {}  # sets whose parity bits are at least so many bytes, and these bits folded to that
    lengths = np.array([len(p) for p in parities])
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths >= length)
        rows = np.zeros((len(at), length), np.uint8)
        for n, i in enumerate(at):
            bits = np.frombuffer(parities[i], np.uint8)
            while len(bits) > length:
                wide = np.unpackbits(bits)
                bits = np.packbits(wide[::2] ^ wide[1::2])
            rows[n] = bits
        folded[length] = at, rows
    first = np.full(len(sizes), -1)
    for start in range(len(sizes)):
        if first[start] >= 0:
            continue
        first[start], todo = start, [start]
        while todo:
            i = todo.pop()
            for length, (at, rows) in folded.items():
                if length > lengths[i]:
                    continue
                # Shorter sets are compared at their own length, all others at this one's.
                some = first[at] < 0
                if length < lengths[i]:
                    some &= lengths[at] == length
                if not some.any():
                    continue
                mine = rows[np.searchsorted(at, i)]
                both = sizes[at[some]] + sizes[i]
                near = rule.den * np.minimum(sizes[at[some]], sizes[i]) >= rule.num * np.maximum(sizes[at[some]], sizes[i])
                near &= np.bitwise_count(rows[some] ^ mine).sum(axis=1, dtype=np.int64) <= both - 2 * rule.least_common(both)
                found = at[some][near]
                first[found] = start
                todo += found.tolist()
    return first


def _possible_stars(members: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): stars over the sets of each key (key, node, size, parity; at most HOT) that possible links connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            nodes = np.array([row[0] for row in held], np.int64)
            first = _connected(rule, np.array([row[1] for row in held], np.int64), [row[2] for row in held])
            other = first != np.arange(len(first))
            return pa.RecordBatch.from_arrays([pa.array(nodes[first[other]]), pa.array(nodes[other])], ["a", "b"])

        for batch in batches:
            for key, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "node", "size", "parity"))):
                if key != now:
                    if held:
                        yield done()
                    now, held = key, []
                held.append(row)
        if held:
            yield done()

    rows = members.select("key", "node", "size", "parity").repartition(tasks(members.sparkSession), "key").sortWithinPartitions("key", "node")
    return rows.mapInArrow(tidy(run), "a long, b long").distinct()


def _common(rows_a: np.ndarray, a: np.ndarray, rows_b: np.ndarray, b: np.ndarray, count: int) -> np.ndarray:
    """Sizes of the intersections of the sets of two columns, row by row."""
    rows, tokens = np.concatenate((rows_a, rows_b)), np.concatenate((a, b))
    order = np.lexsort((tokens, rows))
    rows, tokens = rows[order], tokens[order]
    return np.bincount(rows[1:][(tokens[1:] == tokens[:-1]) & (rows[1:] == rows[:-1])], minlength=count)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))


def _verified(pairs: DataFrame, rule: Rule) -> DataFrame:
    """Of (doc_a, text_a, doc_b, text_b) the linked (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, blob, offsets in slices(batches, "text_a"):
            found_a, of_a, size_a = shingle_sets(blob, offsets, rule.length)
            found_b, of_b, size_b = shingle_sets(*_joined(part.column("text_b").to_pylist()), rule.length)
            common = _common(of_a, found_a, of_b, found_b, part.num_rows)
            linked = pa.array(rule.den * common >= rule.num * (size_a + size_b - common))
            yield pa.RecordBatch.from_arrays([part.column("doc_a"), part.column("doc_b")], ["a", "b"]).filter(linked)

    return pairs.mapInArrow(tidy(run), "a long, b long")


def _links_within(rule: Rule, docs: np.ndarray, texts: list[bytes], left: np.ndarray) -> np.ndarray:
    """(a, b): a forest of the links between the texts marked ``left`` and all texts of a block."""
    found, of, sizes = shingle_sets(*_joined(texts), rule.length)
    tokens, at, times = np.unique(found, return_inverse=True, return_counts=True)
    often = np.flatnonzero(times > 1)
    place = np.full(len(tokens), -1)
    place[often] = np.arange(len(often))
    column = place[at]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    common = np.zeros((int(left.sum()), len(docs)))
    for start in range(0, len(often), 8_192):
        some = slice(*np.searchsorted(column, (start, start + 8_192)))
        held = np.zeros((len(docs), 8_192), np.float32)
        held[of[some], column[some] - start] = 1
        common += held[left] @ held.T
    union = sizes[left][:, None] + sizes[None, :] - common
    rows, columns = np.nonzero((rule.den * common >= rule.num * union) & (sizes[left][:, None] > 0))
    rows = np.flatnonzero(left)[rows]
    parent = np.arange(len(docs))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for x, y in zip(rows.tolist(), columns.tolist()):
        a, b = root(x), root(y)
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append((docs[x], docs[y]))
    return np.array(kept, np.int64).reshape(-1, 2)


def _within(blocks: DataFrame, rule: Rule) -> DataFrame:
    """Links within every block of (block, doc, text, side): of those of side 0 with all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, docs, texts, sides = None, [], [], []

        def done() -> pa.RecordBatch:
            links = _links_within(rule, np.array(docs, np.int64), texts, np.array(sides) == 0)
            return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

        for batch in batches:
            for block, doc, text, side in zip(*(batch.column(c) for c in ("block", "doc", "text", "side"))):
                if current is not None and block.as_py() != current:
                    yield done()
                    docs, texts, sides = [], [], []
                current = block.as_py()
                docs.append(doc.as_py())
                texts.append(text.as_py())
                sides.append(side.as_py())
        if docs:
            yield done()

    parts = tasks(blocks.sparkSession)
    return blocks.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(tidy(run), "a long, b long")


def _block_links(stars: DataFrame, texts: DataFrame, known: DataFrame, rule: Rule) -> DataFrame:
    """Links that settle the components of the sets that share a key with more than GROUP others.

    Groups that share sets are one family, cut into blocks by hash. In a block all pairs are compared, together with the
    pivots of the family. What is then not in the family's largest component is compared with every block. So each pair
    that is not in one component already is compared, and nothing is but blocks of a family. ``texts``: node, doc, text.
    """
    family = cut_lineage(merge_components(stars.select("a", "b")).withColumnRenamed("component", "family"))
    sizes = family.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = family.join(sizes, "family").withColumn("at", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = cut_lineage(members.join(texts, "node").select("family", "blocks", "at", "node", "doc", "text"))
    pick = Window.partitionBy("family").orderBy(F.xxhash64("node"), "node")
    pivots = members.select("family", "blocks", "node").where("blocks > 1").withColumn("n", F.row_number().over(pick)).where(F.col("n") <= PIVOTS)
    pivots = pivots.select("node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("at")).join(members.drop("at"), "node")
    name = lambda *c: F.concat_ws("/", *c)
    rows = members.unionByName(pivots.select(*members.columns)).select(name("family", "at").alias("block"), "doc", "text", F.lit(0).alias("side"))
    links = cut_lineage(_within(rows, rule))
    component = merge_components(known.unionByName(links))
    states = members.where("blocks > 1").select("family", "blocks", "at", "node", "doc").join(component.withColumnRenamed("node", "doc"), "doc", "left")
    states = cut_lineage(states.withColumn("component", F.coalesce("component", "doc")))
    largest = states.groupBy("family", "component").agg(F.count("*").alias("n")).groupBy("family").agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
    strays = states.join(largest, "family").where("component <> largest")
    chunks = strays.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks"))
    strays = strays.join(chunks, "family").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int"))
    left = strays.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("family", "at", "chunk", "node", F.lit(0).alias("side"))
    right = members.where("blocks > 1").select("family", "at", "node").join(chunks, "family")
    right = right.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("family", "at", "chunk", "node", F.lit(1).alias("side"))
    rows = left.unionByName(right).join(members.select("node", "doc", "text"), "node")
    return links.unionByName(_within(rows.select(name("family", "at", "chunk").alias("block"), "doc", "text", "side"), rule))


def components(df: DataFrame, rule: Rule | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``df`` (``id`` comes back as doc_id, a long).

    The set of a row holds the distinct shingles of ``rule.length`` words (lower-cased A-Z, split at white space) of its
    text, or all of its words as one where there are fewer. Rows link when ``den * common >= num * union``; component_id is
    the smallest id reachable. Null, empty and blank texts have no shingles and no links. Rows of one id count as one
    document. Rows without an id take no part, their component_id is null. Equal sets are one node, named by 64 bits of
    hash, as shingles are by theirs. Other columns are not looked at; an empty table gives an empty table.
    """
    rule = rule or Rule()
    spark = df.sparkSession
    docs = df.select(F.col(id).cast("long").alias("doc_id"), text_bytes(text).alias("text"))
    described = cut_lineage(_describe(docs, rule))
    named = described.where(F.col("doc_id").isNotNull() & F.col("node").isNotNull())
    info = cut_lineage(named.groupBy("node").agg(F.min("doc_id").alias("doc"), F.max("n_shingles").alias("size"), F.max("parity").alias("parity"), F.first("sample").alias("sample")))
    rule = _fitted(rule, info)
    parts = max(tasks(spark), math.ceil(rule.keys / BUCKET_KEYS))
    found = cut_lineage(_candidates(docs.where(F.col("doc_id").isNotNull()).select("text"), rule, parts))
    side = lambda x: info.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("parity").alias(f"parity_{x}"))
    pairs = cut_lineage(_promising(found.where(F.col("kind") == PAIR).select("a", "b").join(side("a"), "a").join(side("b"), "b"), rule))
    members = found.where(F.col("kind") == MEMBER).select(F.col("a").alias("key"), F.col("b").alias("node")).join(info, "node")
    stars = cut_lineage(found.where(F.col("kind") == STAR).select("a", "b").unionByName(_possible_stars(members, rule)))
    needed = pairs.select("a").union(pairs.select("b")).union(stars.select("a")).union(stars.select("b")).toDF("node").distinct()
    needed = needed.join(info.select("node", "doc"), "node")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # a repeated id may have other texts
        for part, blob, offsets in slices(batches):
            found, _, sizes = shingle_sets(blob, offsets, rule.length)
            yield part.filter(pa.array(signatures(found, sizes) == part.column("node").to_numpy()))

    texts = docs.join(needed.withColumnRenamed("doc", "doc_id"), "doc_id").select("node", F.col("doc_id").alias("doc"), "text")
    texts = cut_lineage(texts.mapInArrow(tidy(own), "node long, doc long, text binary").dropDuplicates(["node"]))
    text_of = lambda x: texts.select(F.col("node").alias(x), F.col("doc").alias(f"doc_{x}"), F.col("text").alias(f"text_{x}"))
    links = cut_lineage(_verified(pairs.join(text_of("a"), "a").join(text_of("b"), "b"), rule))
    if not stars.isEmpty():
        links = cut_lineage(links.unionByName(_block_links(stars, texts, links, rule)))
    component = merge_components(links).withColumnRenamed("node", "doc")
    least = info.select("node", "doc").join(component, "doc", "left").select("node", F.coalesce("component", "doc").alias("least"))
    joined = described.join(least, "node", "left")
    # Rows of one id may have several sets: the document is where the least of them is.
    return joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every row of ``documents``; blank and null texts are linked with nothing, ids that repeat are one document (see ``components``)."""
    return components(documents(spark, sf_dir))


OP1_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN coalesce(len(words), 0) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS shingles FROM w
), tokens AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS t FROM sets),
counts AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n_a, b.n AS n_b, count(*) AS common
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n GROUP BY ALL
), links AS (SELECT a, b FROM counts WHERE 100 * common >= 85 * (n_a + n_b - common)),
pairs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN pairs l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id FROM sets JOIN least USING (doc_id)
"""
