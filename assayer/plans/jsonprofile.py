"""What the JSON of events is made of, as it stands and nested with broken texts among it."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import jsonprofile as jp
from assayer.plans.registry import query, rounded
from assayer.sources.tables import table

NESTED_SQL = """CASE WHEN event_id % 50 = 7 THEN '{"k": ' WHEN event_id % 40 = 3 THEN NULL ELSE '{"props":' || props || ',"who":{"id":' || user_id || ',"kind":"' || event_type || '","note":'
 || CASE WHEN event_id % 3 = 0 THEN 'null' WHEN event_id % 3 = 1 THEN 'true' ELSE '"n' || event_id % 9 || '"' END || '},"steps":[' || event_id % 4 || ',{"at":' || event_id % 6 || '}]}' END"""


def nested(spark, sf):
    e = table(spark, sf, "events")
    i = F.col("event_id")
    note = F.when(i % 3 == 0, "null").when(i % 3 == 1, "true").otherwise(F.concat(F.lit('"n'), (i % 9).cast("string"), F.lit('"')))
    text = F.concat(F.lit('{"props":'), "props", F.lit(',"who":{"id":'), F.col("user_id").cast("string"), F.lit(',"kind":"'), "event_type", F.lit('","note":'), note,
                    F.lit('},"steps":['), (i % 4).cast("string"), F.lit(',{"at":'), (i % 6).cast("string"), F.lit("}]}"))
    return e.select(F.when(i % 50 == 7, '{"k": ').when(i % 40 == 3, None).otherwise(text).alias("text"))


def profile_sql(text: str) -> str:
    return f"""j AS (SELECT {text} AS text FROM events),
 p AS (SELECT regexp_replace(t.fullkey, '\\[[0-9]+\\]', '[]', 'g') AS path, CASE WHEN t.type IN ('OBJECT', 'ARRAY', 'BOOLEAN', 'NULL') THEN lower(t.type) WHEN t.type = 'VARCHAR' THEN 'string' ELSE 'number' END AS kind, t.value->>'$' AS value
  FROM (SELECT text FROM j WHERE json_valid(text)) v, json_tree(v.text) t),
 q AS (SELECT path, kind, CASE WHEN kind IN ('object', 'array', 'null') THEN NULL ELSE value END AS value FROM p UNION ALL SELECT '$', 'invalid', NULL FROM j WHERE NOT json_valid(text)),
 pr AS (SELECT path, kind, count(*) AS rows, count(DISTINCT value) AS distinct_values, min(length(value)) AS shortest, max(length(value)) AS longest FROM q GROUP BY 1, 2)"""


@query("c02_json_profile", f"WITH {profile_sql('props')} SELECT * FROM pr")
def _(spark, sf):
    return rounded(jp.json_profile(table(spark, sf, "events"), "props"))


@query("c02_nested_json_profile", f"WITH {profile_sql(NESTED_SQL)} SELECT * FROM pr")
def _(spark, sf):
    return rounded(jp.json_profile(nested(spark, sf), "text"))


EXPECTED = {"$": ("object",), "$.props": ("object",), "$.props.k": ("number",), "$.who": ("object",), "$.who.id": ("number",), "$.who.kind": ("string",), "$.who.note": ("string", "null"),
            "$.who.mail": ("string",), "$.steps": ("array",), "$.steps[]": ("number", "object")}


@query("b07_json_contract", f"""WITH {profile_sql(NESTED_SQL)}, f AS (SELECT path, string_agg(kind, ',' ORDER BY kind) AS kinds, list(kind) AS ks, sum(rows)::BIGINT AS rows FROM pr GROUP BY 1),
 e AS (SELECT * FROM (VALUES {', '.join(f"('{p}', {list(k)!r})" for p, k in EXPECTED.items())}) AS v(path, wanted))
SELECT path, CASE WHEN rows IS NULL THEN 'missing' WHEN wanted IS NULL THEN 'undeclared' WHEN NOT list_has_all(wanted, ks) THEN 'mismatch' ELSE 'match' END AS status, coalesce(kinds, '') AS kinds, coalesce(rows, 0) AS rows FROM f FULL JOIN e USING (path)""")
def _(spark, sf):
    return rounded(jp.json_contract(nested(spark, sf), "text", EXPECTED))
