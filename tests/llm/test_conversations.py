"""Structure repair and the prefix trie against plain versions."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from themeloom.llm import repair, trie

SCHEMA = "conv_id long, turn long, role string, text string, pass int, key string, digest string"


def table(spark, rows):
    return spark.createDataFrame([(*row, 7, "x", None) for row in rows], SCHEMA)


def all_repairs(rows):
    """(cost, audit, roles) of every edit of (role, fault) rows with at most two inserts in a place."""
    def walk(at, inserted):
        if at == len(rows):
            yield 0, "", ()
        if inserted < 2:
            for cost, audit, roles in walk(at, inserted + 1):
                for role in ("user", "assistant"):
                    yield cost + 2, "I" + audit, (role, *roles)
        if at < len(rows):
            role, fault = rows[at]
            for cost, audit, roles in walk(at + 1, 0):
                yield cost + 3, "D" + audit, roles
                if fault not in (repair.BLANK, repair.DUPLICATE):
                    more = fault == repair.TRUNCATED
                    yield cost + more, "K" + audit, (role, *roles)
                    for new in ("user", "assistant"):
                        yield cost + 2 + more, "R" + audit, (new, *roles)

    def fits(roles):
        initials = "".join(r[:1] for r in roles)
        rest = initials.removeprefix("s")
        return initials == "" or (rest != "" and rest == "ua" * (len(rest) // 2) and all(r in ("system", "user", "assistant", "uncle") for r in roles))

    return min((cost, audit) for cost, audit, roles in walk(0, 0) if fits(roles))


def test_cheapest_repair_is_the_least_of_all():
    roles = ["system", "user", "assistant", "tool", "uncle", " "]
    cases = [list(zip(r, f)) for n in range(2) for r in itertools.product(roles, repeat=n) for f in itertools.product(range(4), repeat=n)]
    draw = random.Random(5)
    cases += [[(draw.choice(roles), draw.choice((0, 0, 1, 2, 3))) for _ in range(draw.choice((2, 3)))] for _ in range(150)]
    for rows in cases:
        assert repair.cheapest("".join(r[:1] for r, _ in rows), bytes(f for _, f in rows)) == all_repairs(rows), rows


@pytest.mark.parametrize("block", [1, 2, 5])
def test_blocks_change_nothing(monkeypatch, block):
    draw = random.Random(block)
    cases = [("".join(draw.choice("suat ") for _ in range(40)), bytes(draw.choice((0, 0, 0, 1, 2, 3)) for _ in range(40))) for _ in range(60)]
    whole = [repair.cheapest(*case) for case in cases]
    monkeypatch.setattr(repair, "BLOCK", block)
    assert [repair.cheapest(*case) for case in cases] == whole


def plain_report(rows):
    """The report of (conv_id, turn, role, text) rows, whole conversations at a time."""
    out = {}
    for conv_id in {r[0] for r in rows}:
        own = [(t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows if c == conv_id]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        faults, seen = [], set()
        for _, role, text in own:
            last = text.rstrip(" \t\n\v\f\r")[-1:]
            faults.append(1 if not last else 2 if (role, text) in seen else 3 if last not in ".!?" else 0)
            seen.add((role, text))
        cost, audit = repair.cheapest("".join(r[:1] or " " for _, r, _ in own), bytes(faults))
        state, at, turns = 0, 0, []
        for letter in audit:
            if letter == "I":
                turns.append((repair.NEEDS[state], ""))
            else:
                role, text = own[at][1:]
                at += 1
                if letter != "D":
                    turns.append((role if letter == "K" else repair.NEEDS[state], text))
            state = state if letter == "D" else repair.kept_state(state, turns[-1][0][:1])
        numbers = [t for t, _, _ in own if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        out[conv_id] = (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, faults.count(1), faults.count(2), faults.count(3),
                        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in turns).encode()).hexdigest())
    return out


def awkward_rows():
    long = "word " * 100_000 + "."
    rows = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, None, "assistant", "No end"), (1, 9, None, None), (1, 3, "", "x."), (1, 3, "", "a."), (None, None, None, None), (None, 2, "user", "A."),
            (2, 0, "system", " \t\n"), (2, 1, "system", "Be brief."), (3, 0, "user", long), (3, 1, "assistant", long), (3, 1, "assistant", long), (4, 5, "tool", "é?"), (5, 1, "user", "a ")]
    draw = random.Random(2)
    return rows + [(draw.randint(10, 30), draw.choice((None, 0, 1, 2, 3, 4)), draw.choice(("system", "user", "assistant", None)), draw.choice(("Yes.", "no", "", None, "Why? "))) for _ in range(200)]


def test_report_and_turns(spark):
    rows = awkward_rows()
    found = {r[0]: tuple(r[1:]) for r in repair.report(table(spark, rows)).collect()}
    assert found == plain_report(rows)
    turns = {}
    for row in repair.repair(table(spark, rows)).orderBy("conv_id", "place").collect():
        turns.setdefault(row.conv_id, []).append(row)
    for conv_id, (*_, audit, digest) in found.items():
        own = turns.get(conv_id, [])
        assert [r.place for r in own] == list(range(len(own))) and "".join(r.edit for r in own) == audit.replace("D", "")
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in own).encode()).hexdigest() == digest


def test_report_of_no_rows_and_of_dropped_ones(spark):
    assert repair.report(table(spark, [])).collect() == []
    gone = repair.damage(table(spark, [(c, 0, "user", "A.") for c in range(60)]))
    report = {r.conv_id: r for r in repair.report(gone).collect()}
    assert set(report) == set(range(60))
    for c, row in report.items():
        if zlib.crc32(f"{c}:0".encode()) % 20 == 0:
            assert tuple(row)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def plain_trie(rows, group=5):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t, r or "", x or ""))
    for turns in own.values():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
    built = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % group) * (1 if c > 0 else -1)
        built[c] = tuple(r[1:] for r in own.get(base, [])[:h] + turns[h:])
    members, ends = {}, {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
        ends.setdefault(turns, []).append(c)
    saved = {p: (len(m) - 1) * len(p[-1][1].encode()) if p else 0 for p, m in members.items()}
    out = []
    for p, m in members.items():
        below = [q for q in members if q[:len(p)] == p]
        leaf = lambda q: not any(len(r) == len(q) + 1 and r[:len(q)] == q for r in members)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), sum(len(q) == len(p) + 1 for q in below), sum(leaf(q) for q in below),
                    sum(saved[q] for q in below), hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("mass, layer", [(50_000, 1000), (30, 4), (1, 2)])
def test_trie(spark, mass, layer):
    draw = random.Random(4)
    rows = [(draw.randint(-8, 25), draw.choice((None, 0, 1, 2, 3)), draw.choice(("user", None)), draw.choice(("a", "b", None, "é"))) for _ in range(130)]
    rows += [(c, t, "user", "same") for c in (100, 101, 102, 103, 104, 200, 201) for t in range(14)] + [(None, 0, "user", "a"), (0, 7, "user", "long " * 50_000)]
    got = trie.trie(trie.rebuild(table(spark, rows)), mass, layer).drop("key").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_trie(rows)


def test_trie_of_nothing_and_of_extreme_ids(spark):
    assert trie.trie(trie.rebuild(table(spark, []))).collect() == []
    rows = [(c, 0, "user", "a") for c in ((1 << 63) - 1, (1 << 63) - 3, -(1 << 63), -(1 << 63) + 3)]
    got = trie.trie(trie.rebuild(table(spark, rows))).drop("key").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_trie(rows)


def test_centroid_sums():
    draw = random.Random(3)
    for _ in range(150):
        parent, depth = [], []
        for n in range(draw.randint(1, 70)):
            above = -1 if n == 0 or draw.random() < 0.1 else draw.randint(max(0, n - draw.choice((1, 3, 50))), n - 1)
            parent.append(above)
            depth.append(4 if above < 0 else depth[above] + 1)
        weights = np.array([[draw.randint(0, 9), 1] for _ in parent])
        expected = weights.copy()
        for n in reversed(range(len(parent))):
            if parent[n] >= 0:
                expected[parent[n]] += expected[n]
        assert (trie.centroid_sums(np.array(parent), np.array(depth), weights) == expected).all()
