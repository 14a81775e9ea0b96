"""Conversation structure repair: the cheapest edits, and among these the least audit, by one integer shortest path.

A repaired conversation is empty, or an optional system turn followed by pairs of a user and an assistant turn. Rows may be
kept, given another role, or deleted, and empty turns inserted. Where a repair stands is one of four states, and each edit
has one successor, so the audit (the initials of the edits) tells the whole repair.

Costs and audits are one integer: high digits hold the cost, below them stand the letters, first letter highest, each three
bits wide, zeros at the end. The order of these integers is that of (cost, audit), so the shortest path through the graph
of (row, state), from the last row back, decides by plain minimum. A path over all rows would make numbers of all rows; it
is cut into blocks of rows. Inserts stand before the row that follows them, so the letters of a block end at a row: two
different ones differ within the block, and of what follows only the cost is needed there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from themeloom.llm.common import CRC_SQL, crc_sql, table, tidy

BLOCK = 256
"""Rows whose letters share one integer."""
WHITE = " \t\n\v\f\r"
START, OPEN, CLOSED, SYSTEM = range(4)
"""Before any turn; after a user turn; after a pair; after the system turn."""
NEEDS = {START: "user", OPEN: "assistant", CLOSED: "user", SYSTEM: "user"}
AFTER = {START: OPEN, OPEN: CLOSED, CLOSED: OPEN, SYSTEM: OPEN}
TAIL = {START: "", OPEN: "I", CLOSED: "", SYSTEM: "II"}
"""What completes a repair after the last row."""
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
LETTERS = "DIKR"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3


def kept_state(state: int, initial: str) -> int | None:
    """Where a row of this role initial leads if it is kept, None if it can't be."""
    if initial == "s":
        return SYSTEM if state == START else None
    return AFTER[state] if initial == NEEDS[state][0] else None


def block_paths(rows: list[tuple[str, int]], ends: list[int]) -> tuple[list[int], list[str]]:
    """Least costs from each state over (initial, fault) rows to ``ends``, the costs after them, and the audits of these."""
    width = 3 * len(rows)
    unit, top = 1 << 3 * width, 3 * (width - 1)

    def edge(cost: int, letter: str, rest: int) -> int:
        low = rest & unit - 1
        return rest - low + cost * unit + (LETTERS.index(letter) + 1 << top) + (low >> 3)

    values = [cost * unit for cost in ends]
    for initial, fault in reversed(rows):
        taken = [edge(DELETE, "D", value) for value in values]
        if fault not in (BLANK, DUPLICATE):
            more = fault == TRUNCATED
            for state in NEEDS:
                choices = [taken[state], edge(REROLE + more, "R", values[AFTER[state]])]
                if (to := kept_state(state, initial)) is not None:
                    choices.append(edge(KEEP + more, "K", values[to]))
                taken[state] = min(choices)
        once = [min(taken[state], edge(INSERT, "I", taken[AFTER[state]])) for state in NEEDS]
        values = [min(taken[state], edge(INSERT, "I", once[AFTER[state]])) for state in NEEDS]
    letters = str.maketrans("1234", LETTERS)
    return [value >> 3 * width for value in values], [f"{value & unit - 1:0{width}o}".rstrip("0").translate(letters) for value in values]


def cheapest(initials: str, faults: bytes) -> tuple[int, str]:
    """Cost and audit of the best repair of rows with these role initials (a blank for none) and faults."""
    costs, blocks = [INSERT * len(TAIL[state]) for state in NEEDS], []
    for first in reversed(range(0, len(faults), BLOCK)):
        costs, audits = block_paths(list(zip(initials[first:first + BLOCK], faults[first:first + BLOCK])), costs)
        blocks.append(audits)
    state, audit, at = START, [], 0
    for audits in reversed(blocks):
        audit.append(audits[state])
        for letter in audits[state]:
            state = state if letter == "D" else kept_state(state, initials[at]) if letter == "K" else AFTER[state]
            at += letter != "I"
    return costs[START], "".join(audit) + TAIL[state]


class Conversation:
    """One conversation as its rows pass: first their roles and faults, then, once the audit is known, their texts."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.initials, self.faults = conv_id, [], bytearray()
        self.illegal = self.distinct = 0
        self.least = self.most = None
        self.audit = None
        self.place = self.at = 0
        self.state = START
        self.digest = hashlib.sha256()

    def look(self, turn: int | None, role: str, fault: int) -> None:
        initial = role[:1]
        if self.initials and self.initials[-1].strip() + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initials.append(initial or " ")
        self.faults.append(fault)
        if turn is not None:
            self.distinct += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn

    def decide(self) -> None:
        if self.audit is None:
            self.cost, self.audit = cheapest("".join(self.initials), bytes(self.faults))

    def _turn(self, letter: str, turn: int | None, role: str, text: str) -> tuple:
        self.digest.update(("\n" * (self.place > 0) + f"{role}:{text}").encode())
        row = (self.conv_id, self.place, letter, turn, role, text)
        self.place += 1
        return row

    def _inserted(self) -> Iterator[tuple]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield self._turn("I", None, NEEDS[self.state], "")
            self.state, self.at = AFTER[self.state], self.at + 1

    def edit(self, turn: int | None, role: str, text: str) -> Iterator[tuple]:
        """The repaired turns up to and with this row's."""
        self.decide()
        yield from self._inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            yield self._turn("K", turn, role, text)
            self.state = kept_state(self.state, role[:1])
        elif letter == "R":
            yield self._turn("R", turn, NEEDS[self.state], text)
            self.state = AFTER[self.state]

    def close(self) -> Iterator[tuple]:
        self.decide()
        yield from self._inserted()

    def summary(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        counts = [self.faults.count(fault) for fault in (BLANK, DUPLICATE, TRUNCATED)]
        return (self.conv_id, min(gaps, (1 << 63) - 1), *counts, self.illegal, self.cost, self.audit, self.digest.hexdigest())


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present of rows damaged by the checksum of their key; rows that are dropped stay as not present.

    Null roles and texts become one blank, in the key null ids and turns do.
    """
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(":") for c in ("conv_id", ":", "turn")])
    kind, role, text = F.crc32(key) % 20, F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind != 0).alias("present"), F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def _streamed(rows: DataFrame) -> DataFrame:
    """Rows of whole conversations, in order, in one task each: without texts first, then with them.

    One exchange by conv_id; the numbering of equal (role, text) needs no other. What a task holds is one letter a row.
    """
    trimmed = F.rtrim("text", F.lit(WHITE))
    rows = rows.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        F.col("present") if "present" in rows.columns else F.lit(True).alias("present"),
    ).withColumn("digest", F.md5("text")).repartition("conv_id")
    order = Window.partitionBy("conv_id", "role", "digest", "present").orderBy(F.col("turn").asc_nulls_first())
    fault = F.when(trimmed == "", BLANK).when(F.col("copy") > 1, DUPLICATE).when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    rows = rows.withColumn("copy", F.row_number().over(order)).withColumn("fault", fault.cast("int"))
    passes = F.explode(F.when(F.col("present"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))).alias("pass")
    rows = rows.select("conv_id", passes, "turn", "role", "digest", "copy", "fault", "text")
    rows = rows.withColumn("text", F.when(F.col("pass") == 2, F.col("text")))
    return rows.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "pass", F.col("turn").asc_nulls_first(), "role", "digest", "copy")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Conversation, tuple | None]]:
    """Conversations with their repaired turns, and each with None at its end."""
    now = None
    for batch in batches:
        for conv_id, pass_, turn, role, fault, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "pass", "turn", "role", "fault", "text"))):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    yield from ((now, row) for row in now.close())
                    yield now, None
                now = Conversation(conv_id)
            if pass_ == 1:
                now.look(turn, role, fault)
            elif pass_ == 2:
                yield from ((now, row) for row in now.edit(turn, role, text))
    if now is not None:
        yield from ((now, row) for row in now.close())
        yield now, None


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    """Batches of rows whose strings (the column ``size``) add up to some megabytes."""
    held, bytes_ = [], 0
    for row in rows:
        held.append(row)
        bytes_ += len(row[size])
        if len(held) >= 10_000 or bytes_ > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema.names)
            held, bytes_ = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema.names)


def repair(rows: DataFrame) -> DataFrame:
    """The repaired turns of ``rows`` (conv_id, turn, role, text): conv_id, place, edit (K, R or I), turn, role, text.

    Rows of a conversation are taken by turn, nulls first, ties by role and by the digest of the text. Null roles and texts
    are one blank; a null conv_id is a conversation like others. A boolean column ``present`` may mark rows that only name
    their conversation. Other columns are not read, an empty table gives an empty table.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((row for _, row in _each(batches) if row is not None), schema, 5)

    return _streamed(rows).mapInArrow(tidy(run), "conv_id long, place long, edit string, turn long, role string, text string")


def report(rows: DataFrame) -> DataFrame:
    """What ``repair`` found and did, a row for each conversation, those without present rows among them.

    A conversation's rows pass one task as a stream, because the hash of its repaired turns takes them in order.
    """
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    schema = pa.schema([(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((now.summary() for now, row in _each(batches) if row is None), schema, 7)

    return _streamed(rows).mapInArrow(tidy(run), ", ".join(f"{n} {'string' if n in ('audit', 'repaired_sha256') else 'long'}" for n in names))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of ``conversations``, damaged and repaired; nulls, ties and empty tables as ``damage`` and ``repair`` say."""
    return report(damage(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")))


def _op11_sql() -> str:
    """The same by strings: a cost of nine digits before the audit, rows taken from the last one, a column for each state."""
    initial = {START: "u", OPEN: "a", CLOSED: "u", SYSTEM: "u"}

    def step(state: int) -> str:
        def path(cost: str, letter: str, to: int, text: str) -> str:
            joined = f"CASE WHEN p.t{to} = '' THEN {text} ELSE {text} || chr(10) || p.t{to} END" if text else f"p.t{to}"
            return f"{{'k': lpad(CAST(CAST(p.k{to}[1:9] AS BIGINT) + {cost} AS VARCHAR), 9, '0') || '{letter}' || p.k{to}[10:], 't': {joined}}}"

        none = "{'k': '999999999', 't': ''}"
        own, role = "r.role || ':' || r.text", "'user'" if initial[state] == "u" else "'assistant'"
        keeps = [path("(r.fault = 3)::INT", "K", AFTER[state], own), f"r.initial = '{initial[state]}'"]
        extra = f", CASE WHEN r.fault IN (0, 3) AND r.initial = 's' THEN {path('(r.fault = 3)::INT', 'K', SYSTEM, own)} ELSE {none} END" if state == START else ""
        rerole = role + " || ':' || r.text"
        return (f"list_min([{path('3', 'D', state, '')}, CASE WHEN r.fault IN (0, 3) THEN {path('2 + (r.fault = 3)::INT', 'R', AFTER[state], rerole)} ELSE {none} END, "
                f"CASE WHEN r.fault IN (0, 3) AND {keeps[1]} THEN {keeps[0]} ELSE {none} END{extra}])")

    def inserted(state: int, source: str) -> str:
        to = AFTER[state]
        role = "user:" if initial[state] == "u" else "assistant:"
        longer = f"{{'k': lpad(CAST(CAST({source}{to}.k[1:9] AS BIGINT) + 2 AS VARCHAR), 9, '0') || 'I' || {source}{to}.k[10:], 't': '{role}' || CASE WHEN {source}{to}.t = '' THEN '' ELSE chr(10) || {source}{to}.t END}}"
        return f"list_min([x{state}, {longer}])"

    ends = "'000000000', '', '000000002I', 'assistant:', '000000000', '', '000000004II', 'user:' || chr(10) || 'assistant:'"
    return f"""
WITH RECURSIVE {CRC_SQL}, keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations, crc_bytes
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM keyed, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) copies(n)
), numbered AS (
  SELECT conv_id, turn, role, role[1] AS initial, text, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS n,
    count(*) OVER (PARTITION BY conv_id) AS rows FROM damaged
), faulty AS (
  SELECT *, CASE WHEN trimmed = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 2
    WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM numbered
), paths AS (
  SELECT conv_id, max(n) AS n, k0, t0, k1, t1, k2, t2, k3, t3 FROM faulty, (VALUES ({ends})) e(k0, t0, k1, t1, k2, t2, k3, t3) GROUP BY ALL
  UNION ALL
  SELECT conv_id, n - 1, y0.k, y0.t, y1.k, y1.t, y2.k, y2.t, y3.k, y3.t FROM (
    SELECT *, {', '.join(f"{inserted(s, 'z')} AS y{s}" for s in NEEDS)} FROM (
      SELECT *, {', '.join(f"{inserted(s, 'x')} AS z{s}" for s in NEEDS)} FROM (
        SELECT p.conv_id, p.n, {', '.join(f"{step(s)} AS x{s}" for s in NEEDS)}
        FROM paths p JOIN faulty r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.n = p.n)))
), found AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (n > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(CAST(k0[1:9] AS BIGINT), 0) AS cost, coalesce(k0[10:], '') AS audit, sha256(coalesce(t0, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN found f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN (SELECT * FROM paths WHERE n = 0) p ON p.conv_id IS NOT DISTINCT FROM c.conv_id
"""


OP11_SQL = _op11_sql()
