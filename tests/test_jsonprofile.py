import json
from collections import Counter

from assayer.operators import jsonprofile as jp

TEXTS = ['{"a": 1, "b": {"c": [1, "x", null, {"d": true}]}, "e": ""}', '{"a": 2.5}', '{"a": "1"}', "[1, [2]]", "7", "null", "{", "", None, '{"b": {}}', '{"b": {"c": []}}', '{"a": 1, "b": {"c": [1, "x", null, {"d": true}]}, "e": ""}']
KIND = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}


def walk(value, path="$", depth=4):
    kind = KIND.get(type(value), "number")
    yield path, kind, None if kind in ("object", "array", "null") else json.dumps(value) if kind == "boolean" else str(value)
    for k, v in (value.items() if kind == "object" else [(None, x) for x in value] if kind == "array" else []) if depth else []:
        yield from walk(v, path + (f".{k}" if k is not None else "[]"), depth - 1)


def brute(texts, depth=4):
    for t in texts:
        if t is not None:
            try:
                value = json.loads(t)
            except ValueError:
                yield "$", "invalid", None
                continue
            yield from walk(value, depth=depth)


def test_paths_equal_a_plain_walk(spark):
    df = spark.createDataFrame([(t, 1, "x") for t in TEXTS], "text string, v int, path string").repartition(3)
    for depth in (0, 1, 4):
        assert Counter(map(tuple, jp.json_paths(df, "text", depth).collect())) == Counter(brute(TEXTS, depth))
    want = {}
    for path, kind, value in brute(TEXTS):
        n, seen = want.get((path, kind), (0, set()))
        want[path, kind] = (n + 1, seen | ({value} - {None}))
    assert {(r.path, r.kind): (r.rows, r.distinct_values) for r in jp.json_profile(df, "text").collect()} == {k: (n, len(s)) for k, (n, s) in want.items()}
    assert jp.json_profile(df.limit(0), "text").count() == 0


def test_contract(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    out = {r.path: (r.status, r.rows) for r in jp.json_contract(df, "text", {"$.a": ("number",), "$.e": ("string",), "$.z": ("string",), "$.b": ("object",)}).collect()}
    assert out["$.a"] == ("mismatch", 4) and out["$.e"] == ("match", 2) and out["$.z"] == ("missing", 0) and out["$.b.c"][0] == "undeclared" and out["$.b"] == ("match", 4)


def test_a_text_is_parsed_once(spark):
    df = spark.createDataFrame([('{"a": [{"b": [[1, "{", null, {}]]}]}',)], "text string")
    out = jp.json_paths(df, "text")
    assert out._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") == 1
    assert sorted(map(tuple, out.collect()), key=str) == sorted(brute([df.first().text]), key=str)
    assert sorted(map(tuple, jp.json_paths(df, "text", 6).collect()), key=str) == sorted(brute([df.first().text], 6), key=str)
