from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from assayer.llm.decontaminate import words_of
from tests.llm.test_dedup_mix_shard import brute_components, brute_simhash, frame


def brute_near(texts, threshold=0.8):
    """Pairs (i, j), i > j, of texts whose sets of five-word shingles have at least this Jaccard similarity."""
    sets = []
    for t in texts:
        w = words_of(t or "")
        sets.append({tuple(w[a:a + 5]) for a in range(max(1, len(w) - 4))} if w else set())
    posting, common = defaultdict(list), defaultdict(int)
    for i, s in enumerate(sets):
        for g in s:
            for j in posting[g]:
                common[i, j] += 1
            posting[g].append(i)
    return {(i, j) for (i, j), c in common.items() if c >= threshold * (len(sets[i]) + len(sets[j]) - c)}


def stage():
    return dict(corpus_pipeline.STAGES)["simhash"]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_simhash_stage_keeps_no_near_copies_of_given_rows(spark, sf):
    path = f"/root/testdata/{sf}"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {r.doc_id for r in stage()(spark, docs, path).collect()}
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    prints = [brute_simhash(r.text) for r in rows]
    rows = [rows[i] for i in sorted(set(brute_components(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)))]
    pairs = brute_near([r.text for r in rows])
    roots = brute_components(len(rows), lambda i, j: (i, j) in pairs or (j, i) in pairs)
    assert pairs and kept == {rows[i].doc_id for i in set(roots)}


def test_near_copies_of_odd_rows(spark):
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)]
    near = [*words[:60], "changed", *words[61:]]  # 111 of 121 shingles
    far = [w if i % 7 else "changed" for i, w in enumerate(words)]
    rows = [(5, " ".join(words), "a"), (9, "\n".join(near).upper(), "a"), (7, " ".join(far), "a"), (None, " ".join(near), "b"), (5, " ".join(near), "b"), (8, None, "a"),
            (10, "", "a"), (11, "... !", "a"), (12, "a, b", "a"), (13, "a b", "a"), (14, "a c", "a"), (15, " ".join(far), "a"), (15, " ".join(far), "a")]
    out = corpus_pipeline.first_of_near_copies(spark, frame(spark, rows), "").select("doc_id", F.coalesce("text", F.lit("")).alias("t")).collect()
    left = sorted((r.doc_id, r.t) for r in out)
    five = [r for r in left if r[0] == 5]
    assert len(five) == 1 and [r for r in left if r[0] != 5] == [(7, " ".join(far)), (8, ""), (10, ""), (11, "... !"), (12, "a, b"), (14, "a c")]
    assert corpus_pipeline.first_of_near_copies(spark, frame(spark, []).where("false"), "").count() == 0


def test_clean_rows_stay_beside_contaminated_ones_of_their_id(spark):
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").orderBy("item_id").first().text
    rows = [(None, item, "a"), (None, "clean words of a document without an id", "a"), (4, item, "a"), (4, "clean words of the same id", "a"), (5, None, "a"), (6, item, "b")]
    out = corpus_pipeline.without_benchmark(spark, frame(spark, rows), "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in out) == [(0, rows[1][1]), (4, rows[3][1]), (5, "")]
