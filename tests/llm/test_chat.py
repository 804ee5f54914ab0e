import json
import random

import pytest

from assayer.llm import chat

CALLS = "conv_id long, call_id string, turn long, tool string, arguments string, depends_on array<string>, level long, message string"
RESULTS = "conv_id long, call_id string, turn long, content string, state string"
TURNS = "conv_id long, turn long, role string, text string, call_id string, values string"


def calls(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], CALLS).repartition(3)


def results(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], RESULTS)


def brute_levels(deps):
    level, open_ = {}, dict(deps)
    while True:
        ready = {k: 1 + max((level[d] for d in ds if d in deps), default=-1) for k, ds in open_.items() if all(d in level for d in ds if d in deps)}
        if not ready:
            return {**level, **dict.fromkeys(open_)}
        level.update(ready)
        open_ = {k: v for k, v in open_.items() if k not in ready}


@pytest.mark.parametrize("seed", range(3))
def test_levels_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    deps = {}
    for conv in range(6):
        names = [f"{k}" for k in range(40)]
        for k, name in enumerate(names):
            pool = names[:k] if conv else names  # the first conversation has cycles
            deps[(conv, name)] = [rng.choice(pool) for _ in range(rng.choice([0, 1, 1, 1, 1, 2, 3]))] if pool else []
    deps |= {(9, str(k)): [str(k - 1), "unknown", str(k - 1)] for k in range(300)} | {(10, "self"): ["self"], (10, "behind"): ["self"], (10, "free"): []}
    want = brute_levels({k: [(k[0], d) for d in v] for k, v in deps.items()})
    frame = spark.createDataFrame([(c, i, d) for (c, i), d in deps.items()], "conv_id long, call_id string, depends_on array<string>")
    got = {(r.conv_id, r.call_id): r.level for r in chat.levels(frame).collect()}
    assert got == want
    assert got[(9, "299")] == 299 and got[(10, "behind")] is None


def test_links_states_and_problems(spark):
    tools = {"f": {"a": ("integer", True), "b": ("string", False), "c": ("array", False), "d": ("number", False), "e": ("null", False)}}
    given = [
        (1, "ok", 3, "f", '{"b":"é\\n","a":2,"d":1.50,"c":[{"z":1,"y":null}],"e":null}', []), (1, "early", 5, "f", '{"a":1}', ["ok"]),
        (1, "open", 6, "f", '{"a":1.5,"x":0,"b":true}', None), (1, "twice", 8, "f", '{"a":2}', []), (1, "twice", 7, "f", '{"a":1}', ["open"]),
        (2, "bad", 1, "f", '{"a":', []), (2, "list", 1, "f", "[1]", []), (2, "tool", 1, "g", '{"a":1}', []), (2, "none", 1, None, None, []),
        (None, "x", 1, "f", '{"a":1}', []), (3, None, 1, "f", "{}", [])]
    told = [(1, "ok", 4, "fine"), (1, "ok", 9, "later"), (1, "early", 2, "before"), (1, "twice", 9, None), (4, "lost", 1, "orphan"), (None, "x", 2, "y"), (3, None, 2, "z")]
    out = {(r.conv_id, r.call_id): r for r in chat.link(calls(spark, given), results(spark, told), chat.schema_table(spark, tools)).collect()}
    assert len(out) == 11
    state = {k[1]: r.state for k, r in out.items()}
    assert state == {"ok": "linked", "early": "early", "open": "unanswered", "twice": "linked", "bad": "unanswered", "list": "unanswered", "tool": "unanswered",
                     "none": "unanswered", "x": "no_id", None: "no_id", "lost": "orphan"}
    assert out[(1, "ok")].message == '{"arguments":{"a":2,"b":"é\\n","c":[{"y":null,"z":1}],"d":1.5,"e":null},"id":"ok","level":0,"result":"fine","tool":"f"}'
    assert (out[(1, "ok")].n_results, out[(1, "twice")].n_calls, out[(1, "twice")].turn, out[(1, "twice")].level, out[(1, "early")].level) == (2, 2, 7, 1, 1)
    problems = {k[1]: r.problems for k, r in out.items()}
    assert problems == {"ok": [], "early": [], "open": ["type:a", "type:b", "unexpected:x"], "twice": [], "bad": ["malformed"], "list": ["not_an_object"],
                        "tool": ["unknown_tool"], "none": ["malformed"], "x": [], None: ["missing:a"], "lost": None}
    assert all(json.loads(r.message)["id"] == r.call_id for r in out.values())


def test_chat_table_with_odd_rows(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, "user", "a\nb\nc\nd"), (1, 4, "user", "É" * 50_000), (1, 4, "user", "É" * 50_000), (1, 5, "assistant", ""),
             (2, 0, "system", "s"), (2, 1, "assistant", "orphan"), (None, 0, "user", "x"), (3, None, "user", "x"), (3, 0, None, "x"), (4, 0, "user", None), (4, 2, "user", "")]
    frame = spark.createDataFrame([(*t, "x", "y") for t in turns], TURNS)
    out = {(r.conv_id, r.call_id): r for r in chat.chat_calls(frame).collect()}
    assert {k: (r.state, r.level, r.problems) for k, r in out.items()} == {
        (1, "1-0"): ("linked", 0, []), (1, "1-2"): ("unanswered", 1, ["unexpected:depth"]), (1, "1-4"): ("linked", 2, ["type:chars"]), (2, "2-0"): ("orphan", None, None),
        (None, None): ("no_id", None, []), (3, None): ("no_id", None, []), (4, "4-0"): ("unanswered", 0, ["type:chars", "type:text"]), (4, "4-2"): ("unanswered", 1, [])}
    assert out[(1, "1-4")].n_calls == 2
    assert chat.chat_calls(frame.where("false")).count() == 0
