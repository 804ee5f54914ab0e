"""Registered queries over the given tables, one per operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import chat, decontaminate, divergence, embeddings, language, lines, mixing, paragraphs, shards, simhash, tokens, warc, whitening
from assayer.sources import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return keep


@query("op3_simhash_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=2)
    return out.select("doc_id", simhash.hexed("fp").alias("fingerprint"), F.col("component").alias("component_id"))


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6 = f"""
WITH l AS (
  SELECT doc_id, t.pos, t.line FROM documents, LATERAL (
    SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos) t),
k AS (SELECT doc_id, pos, line, {LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
s AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.first AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query("op6_line_dedup", OP6)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_shared_lines(table(spark, sf_dir, "documents"), least_chars=10, documents=2)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op9_sharding")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.shard(table(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op10_mixing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0)
    return out.select("doc_id", "size", "source_size", "target", "taken")


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


WORDS = "regexp_extract_all(" + LOWER.format("coalesce({}, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = f"""
WITH i AS (SELECT item_id, {WORDS.format("text")} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS gram
      FROM i, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - 9))) AS p) WHERE len(w) > 0),
n AS (SELECT DISTINCT n FROM g),
d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format("text")} AS w FROM documents),
h AS (SELECT d.r, p.p, n.n, g.item_id FROM d, n, LATERAL (SELECT unnest(generate_series(1, len(d.w) - n.n + 1)) AS p) p
      JOIN g ON g.n = n.n AND g.gram = array_to_string(d.w[p.p:p.p + n.n - 1], ' ')),
s AS (SELECT DISTINCT r, p + k - 1 AS at FROM h, LATERAL (SELECT unnest(generate_series(1, h.n)) AS k)),
c AS (SELECT r, count(*) AS n_hit FROM s GROUP BY r),
e AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN e USING (r)
"""


@query("op2_decontamination", OP2)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    hit = F.transform(F.flatten("spans"), lambda s: F.sequence(s["first"], s["end"] - 1))
    n_hit = F.size(F.array_distinct(F.flatten(hit))).cast("long")
    names = F.array_join(F.sort_array(F.col("item_ids").cast("array<string>")), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP4 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT vec_id, (SELECT count(*) FROM p WHERE p.a = vec_id)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept
FROM (SELECT a AS vec_id, min(b) AS c FROM r GROUP BY a)
"""


@query("op4_embedding_dedup", OP4)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


OP7 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""


@query("op7_warc_conversion", OP7)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"), least_bytes=100)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op8_substring_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs and passages of over 50 words that more than one document holds; documents without any have no row."""
    return paragraphs.repeated(table(spark, sf_dir, "documents"), threshold=0.8, least_words=51).where("n_documents > 1")


OP1 = """
WITH RECURSIVE c AS (
  SELECT conv_id, turn, conv_id || '-' || turn AS call_id, text, len(string_split(text, chr(10))) AS lines, length(text) AS chars,
         octet_length(encode(text)) = length(text) AS plain
  FROM conversations WHERE role = 'user'),
a AS (SELECT *, CASE WHEN lines > 1 THEN 'outline' ELSE 'answer' END AS tool,
             CASE WHEN lines > 3 THEN json_object('depth', 1, 'lines', lines, 'text', text) WHEN lines > 1 THEN json_object('lines', lines, 'text', text)
                  WHEN plain THEN json_object('chars', chars, 'text', text) ELSE json_object('chars', chars::VARCHAR, 'text', text) END AS arguments,
             CASE WHEN lines > 3 THEN 'unexpected:depth' WHEN lines > 1 OR plain THEN '' ELSE 'type:chars' END AS problems FROM c),
e AS (SELECT x.conv_id, x.turn, y.turn AS dep FROM c x JOIN c y ON x.conv_id = y.conv_id
      AND (y.turn = x.turn - 2 OR (x.turn >= 8 AND bit_count(x.turn) = 1 AND y.turn = x.turn // 2))),
p(conv_id, turn, level) AS (
  SELECT conv_id, turn, 0::BIGINT FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.conv_id = c.conv_id AND e.turn = c.turn)
  UNION SELECT e.conv_id, e.turn, p.level + 1 FROM p JOIN e ON e.conv_id = p.conv_id AND e.dep = p.turn),
l AS (SELECT conv_id, turn, max(level) AS level FROM p GROUP BY ALL),
r AS (SELECT conv_id, turn, conv_id || '-' || (turn - 1) AS call_id, text FROM conversations WHERE role = 'assistant')
SELECT coalesce(a.conv_id, r.conv_id) AS conv_id, coalesce(a.call_id, r.call_id) AS call_id, coalesce(a.turn, r.turn) AS turn, tool, level,
       CASE WHEN a.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS state,
       (a.call_id IS NOT NULL)::BIGINT AS n_calls, (r.call_id IS NOT NULL)::BIGINT AS n_results, problems,
       json_object('arguments', arguments, 'id', coalesce(a.call_id, r.call_id), 'level', level, 'result', r.text, 'tool', tool)::VARCHAR AS message
FROM a JOIN l USING (conv_id, turn) FULL JOIN r ON a.call_id = r.call_id AND a.conv_id = r.conv_id
"""


@query("op1_chat_formatting", OP1)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_calls(table(spark, sf_dir, "conversations")).withColumn("problems", F.array_join("problems", ","))


OP11 = fr"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 10),
c AS (SELECT o.lang, o.source, o.term, count(*) AS c FROM o JOIN k USING (lang, term) GROUP BY ALL),
m AS (SELECT g.lang, g.source, coalesce(sum(c), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
l AS (SELECT lang, sum(c)::HUGEINT AS n, count(*)::HUGEINT AS v FROM k GROUP BY ALL),
p AS (SELECT m.lang, m.source, k.term, coalesce(c.c, 0) AS c, (1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 2) // (m.n + 2 * l.v))::BIGINT AS p,
             (1 + 1000000000::HUGEINT * (k.c + 2) // (l.n + 2 * l.v))::BIGINT AS q
      FROM m JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = m.lang AND c.source = m.source AND c.term = k.term),
a AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p))::BIGINT AS value
      FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
b AS (SELECT x.lang, x.source, y.source AS item, coalesce(a.value, 0)::BIGINT AS value
      FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source),
t AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE c > 0 AND p > q),
u AS (SELECT *, 'pair' AS part FROM b UNION ALL SELECT *, 'term' FROM t),
z AS (SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM u)
SELECT * FROM z WHERE part = 'pair' OR rank <= 10
"""


@query("op11_source_divergence", OP11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least_docs=10, top=10)


@query("op12_embedding_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=8)


@query("op13_token_counts")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)
