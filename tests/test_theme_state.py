"""Applying suggestions as sets against running them one by one."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from themeloom.operators import theme_state
from themeloom.operators.theme_state import ThemeState, apply_suggestions, mark_materialized

THEME = "id long, name string, description string, merged_into_id long, updated_at timestamp"
LINK = "theme_id long, topic string"
SUGGESTION = """id long, action string, proposed_name string, proposed_description string,
    existing_theme_ids array<long>, topics array<string>, materialized_at timestamp"""
OLD, NOW = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 2, 1)


def one_by_one(themes, links, suggestions):
    """Plain sequential application on dictionaries."""
    rows = {t[0]: {"name": t[1], "description": t[2], "into": t[3], "at": t[4]} for t in themes}
    linked = {(i, topic.lower()): topic for i, topic in links}
    applied, rejects, top = {}, {}, max(rows, default=0)

    def root(i):
        seen = set()
        while i in rows and rows[i]["into"] is not None and i not in seen:
            seen.add(i)
            i = rows[i]["into"]
        return i if i in rows and rows[i]["into"] is None else None

    for sid, action, name, description, ids, topics, done in sorted(suggestions):
        if done is not None:
            continue
        roots = [root(i) for i in ids]
        if None in roots:
            rejects[sid] = "unresolved_theme"
            continue
        roots = sorted(set(roots))
        holder = next((i for i, t in rows.items() if t["name"].lower() == name.lower()), None)
        alias = holder is not None and rows[holder]["into"] is not None
        if action == "new":
            if alias:
                rejects[sid] = "name_held_by_alias"
                continue
            target = holder
            if target is None:
                top += 1
                target = top
                rows[target] = {"name": name, "description": description, "into": None, "at": NOW}
        else:
            if action in ("reuse", "update") and len(roots) != 1:
                rejects[sid] = "needs_one_live_theme"
                continue
            if action != "reuse" and holder is not None:
                if alias:
                    rejects[sid] = "name_held_by_alias"
                    continue
                if holder not in roots:
                    rejects[sid] = "name_of_unrelated_theme"
                    continue
            target = roots[0]
            if action == "merge":
                for loser in roots[1:]:
                    if rows[loser]["name"].lower() == name.lower():
                        rows[loser]["name"] = rows[loser]["name"][:80] + f" [merged #{loser}]"
                    for key in sorted(k for k in linked if k[0] == loser):
                        linked.setdefault((target, key[1]), linked.pop(key))
                    for i, t in rows.items():
                        if t["into"] == loser or i == loser:
                            t["into"], t["at"] = target, NOW
            if action != "reuse":
                rows[target]["name"], rows[target]["description"] = name, description
            rows[target]["at"] = NOW
        for topic in sorted(topics, key=lambda t: (t.lower(), t)):
            linked.setdefault((target, topic.lower()), topic)
        applied[sid] = target
    return rows, {(i, t) for (i, _), t in linked.items()}, applied, rejects


def run(spark, themes, links, suggestions, run_rows=50_000):
    state = ThemeState(spark.createDataFrame(themes, THEME), spark.createDataFrame(links, LINK))
    return apply_suggestions(state, spark.createDataFrame(suggestions, SUGGESTION), F.lit(NOW), run_rows)


def check(spark, themes, links, suggestions, run_rows=50_000):
    rows, linked, applied, rejects = one_by_one(themes, links, suggestions)
    out = run(spark, themes, links, suggestions, run_rows)
    assert {r["suggestion_id"]: r["error_code"] for r in out.rejects.collect()} == rejects
    assert {r["suggestion_id"]: r["theme_id"] for r in out.applied.collect()} == applied
    got = {r["id"]: {"name": r["name"], "description": r["description"], "into": r["merged_into_id"], "at": r["updated_at"]}
           for r in out.state.themes.collect()}
    assert got == rows
    pairs = [(r["theme_id"], r["topic"]) for r in out.state.theme_topics.collect()]
    assert set(pairs) == linked and len(pairs) == len(linked)


def theme(i, name, into=None):
    return (i, name, f"about {name}", into, OLD)


@pytest.mark.parametrize("seed, run_rows", [(11, 50_000), (12, 50_000), (13, 50_000), (14, 50_000), (12, 12), (13, 0)])
def test_random_histories(spark, seed, run_rows):
    rng = random.Random(seed)
    themes = [theme(i, f"Name {i}", rng.randrange(1, i) if i > 4 and rng.random() < 0.3 else None) for i in range(1, 16)]
    links = list({(rng.randrange(1, 16), f"t{rng.randrange(5)}") for _ in range(20)})
    suggestions = []
    for sid in range(1, 26):
        action = rng.choice(["new", "reuse", "update", "merge"])
        count = {"new": 0, "reuse": 1, "update": 1, "merge": rng.choice([2, 3])}[action]
        name = rng.choice([f"name {rng.randrange(1, 16)}", f"NEW {rng.randrange(4)}", f"Only {sid}", f"Only {sid}"])
        ids = rng.sample([*range(1, 16), 99], count)
        topic = rng.choice("tT") + str(rng.randrange(6))
        suggestions.append((sid, action, name, f"d{sid}", ids, [topic], None))
    check(spark, themes, links, suggestions, run_rows)


def test_a_much_changed_theme_takes_few_rounds(spark):
    themes = [theme(i, f"Name {i}") for i in range(1, 42)]
    links = [(i, "Shared" if i % 2 else "shared") for i in range(1, 42)]
    suggestions = [(s, "merge", f"Round {s}", f"d{s}", [1, s + 1], ["SHARED", f"t{s}"], None) for s in range(1, 21)]
    suggestions += [(s, "update", f"Round {s}", f"d{s}", [1], [f"T{s - 20}"], None) for s in range(21, 31)]
    suggestions += [(31, "reuse", "ignored", "d", [1], ["more"], None)]
    check(spark, themes, links, suggestions)


def test_a_run_beyond_the_bound_takes_passes_by_its_rows(spark, monkeypatch):
    themes = [theme(i, f"Name {i}") for i in range(1, 45)]
    links = [(i, "Shared" if i % 2 else "shared") for i in range(1, 45)]
    # Each merge shares a theme with the one after it, so rounds would take one each.
    suggestions = [(s, "merge", f"Round {s}", f"d{s}", [1, s + 1, s + 2], ["SHARED"], None) for s in range(1, 13)]
    suggestions += [(13, "new", "name 44", "d", [], ["x"], None), (14, "update", "name 44", "d14", [44], ["X"], None), (15, "reuse", "ignored", "d", [9], ["more"], None)]
    rounds = []
    ready = theme_state._ready
    monkeypatch.setattr(theme_state, "_ready", lambda *given: rounds.append(1) or ready(*given))
    check(spark, themes, links, suggestions, 45)
    assert len(rounds) <= 1


def test_merge_takes_the_name_of_a_loser(spark):
    themes = [theme(1, "Rivers"), theme(2, "Lakes and Rivers"), theme(3, "Old", 2)]
    links = [(1, "Flood"), (2, "flood"), (2, "Depth"), (2, "Fish")]
    suggestions = [(1, "merge", "Lakes and Rivers", "d", [2, 1], ["Flood"], None)]
    check(spark, themes, links, suggestions)
    out = run(spark, themes, links, suggestions)
    rows = {r["id"]: (r["name"], r["merged_into_id"]) for r in out.state.themes.collect()}
    assert rows == {1: ("Lakes and Rivers", None), 2: ("Lakes and Rivers [merged #2]", 1), 3: ("Old", 1)}
    assert out.state.theme_topics.where("theme_id = 1").count() == 3


def test_new_theme_with_a_live_name_links_and_keeps_its_description(spark):
    themes = [theme(4, "Rivers")]
    check(spark, themes, [], [(1, "new", "rivers", "other", [], ["Flood"], None)])


def test_replaying_applies_once(spark):
    themes, suggestions = [theme(1, "A")], [(1, "new", "B", "d", [], ["x"], None), (2, "reuse", "A", "d", [1], ["y"], None)]
    out = run(spark, themes, [], suggestions)
    assert out.applied.count() == 2
    marked = mark_materialized(
        spark.createDataFrame(suggestions, SUGGESTION).withColumn("materialized_theme_id", F.lit(None).cast("long")),
        out.applied, F.lit(NOW))
    again = apply_suggestions(out.state, marked, F.lit(NOW))
    assert again.applied.count() == 0 and again.rejects.count() == 0
    assert again.state.themes.count() == 2


def test_replay_of_the_given_tables(spark):
    """Themes, links, results and errors of every pending suggestion of the relations, one by one."""
    from themeloom.plans import relations as rel

    folder = "/root/testdata/sf0.001"
    state = ThemeState(rel.themes(spark, folder), rel.theme_topics(spark, folder))
    chosen = rel.suggestions(spark, folder)
    columns = ["id", "action", "proposed_name", "proposed_description", "existing_theme_ids", "topics", "materialized_at"]
    themes = [tuple(r) for r in state.themes.select("id", "name", "description", "merged_into_id", "updated_at").collect()]
    links = [tuple(r) for r in state.theme_topics.select("theme_id", "topic").collect()]
    suggestions = [tuple(r) for r in chosen.select(*columns).collect()]
    rows, linked, applied, rejects = one_by_one(themes, links, [(*s[:4], s[4] or [], s[5] or [], s[6]) for s in suggestions])
    out = apply_suggestions(state, chosen, F.lit(NOW))
    assert {r["suggestion_id"]: r["error_code"] for r in out.rejects.collect()} == rejects
    assert {r["suggestion_id"]: r["theme_id"] for r in out.applied.collect()} == applied and applied
    got = {r["id"]: {"name": r["name"], "description": r["description"], "into": r["merged_into_id"], "at": r["updated_at"]} for r in out.state.themes.collect()}
    assert got == rows
    assert sorted((r["theme_id"], r["topic"]) for r in out.state.theme_topics.collect()) == sorted(linked)
