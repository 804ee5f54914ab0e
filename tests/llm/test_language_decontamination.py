import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from assayer.llm import decontaminate, language, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_words long, score double, segment string, _id long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, 0.5, "x", 9) for i, t, lang in rows], SCHEMA).repartition(3)


def brute_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c.isdigit() and c < ":" or "a" <= c <= "z" or ord(c) >= 128 else " " for c in low).split(" ")


def brute_hits(docs, items, window=10):
    out = []
    for i, text in docs:
        w, hit, found = [x for x in brute_words(text) if x], set(), set()
        for item, it in items:
            v = [x for x in brute_words(it) if x]
            k = min(window, len(v))
            grams = {tuple(v[a:a + k]) for a in range(len(v) - k + 1)} if k else set()
            for a in range(len(w) - k + 1 if k else 0):
                if tuple(w[a:a + k]) in grams:
                    hit.update(range(a, a + k))
                    found.add(item)
        out.append((i, len(w), tuple(sorted(hit)), tuple(sorted(found))))
    return Counter(out)


def as_rows(df):
    return Counter((r.doc_id, r.n_words, tuple(sorted({p for s in r.spans for a, b in s for p in range(a, b)})), tuple(r.item_ids)) for r in df.collect())


ITEMS = [(1, "The quick brown fox jumps over the lazy dog and runs far away from here"), (2, "Zwei, drei; VIER"), (3, None), (4, " .,- "), (2, "zwei drei vier"),
         (None, "no id here"), (5, "a a a a a a a a a a a a")]


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_phrases_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SEGMENT_BYTES", 400)
    rng = random.Random(5)
    vocabulary = brute_words(ITEMS[0][1]) + ["zwei", "drei", "vier", "a", "a", "É", "ß9"]
    docs = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(60)]
    docs += [(100 + k, "x " * k + "QUICK brown fox-jumps over the lazy dog and runs far" + " y" * k) for k in range(3)]
    docs += [(200, None), (201, ""), (202, "a " * 5000), (None, "zwei drei vier"), (203, "zwei drei vier"), (203, "zwei drei vier"), (204, "zwei drei")]
    got = decontaminate.contaminated(frame(spark, [(i, t, None) for i, t in docs]), items(spark, ITEMS))
    assert as_rows(got) == brute_hits(docs, [x for x in ITEMS if x[0] is not None])


def test_phrase_does_not_cross_documents(spark):
    got = decontaminate.contaminated(frame(spark, [(1, "zwei drei", None), (2, "vier zwei", None), (3, "drei vier", None)]).coalesce(1), items(spark, ITEMS))
    assert all(not r.item_ids for r in got.collect())


def test_proximity(spark):
    docs = [(1, "vier x x zwei x drei", None), (2, "vier x x x x x zwei drei", None), (3, "zwei drei", None), (4, "drei drei vier zwei zwei vier", None)]
    got = {r.doc_id: (r.item_ids, [tuple(s) for x in r.spans for s in x])
           for r in decontaminate.contaminated(frame(spark, docs), items(spark, ITEMS), within=6).collect()}
    assert got[1] == ([2], [(0, 6)]) and got[4][1][0][0] == 1
    assert {k: v[0] for k, v in got.items()} == {1: [2], 2: [], 3: [], 4: [2]}


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = as_rows(decontaminate.contaminated(docs, bench))
    assert whole == brute_hits([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 400)
    assert as_rows(decontaminate.contaminated(docs, bench)) == whole


def test_no_documents_or_no_items(spark):
    assert decontaminate.contaminated(frame(spark, []).where("false"), items(spark, ITEMS)).count() == 0
    assert [r.item_ids for r in decontaminate.contaminated(frame(spark, [(1, "a", None)]), items(spark, [])).collect()] == [[]]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op5_language_id"](spark, sf).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and {r.doc_id for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    odd = [(None, "the thing and the other thing", None), (901, None, "en"), (902, "", "en"), (903, "123 .,; \n", "de"), (904, "é", None), (905, "the " * 60000, None),
           (905, "the " * 60000, None)]
    out = defaultdict(list)
    for r in language.identify(frame(spark, [tuple(r) for r in base] + odd)).collect():
        out[r.doc_id].append(r)
    assert all(out[i][0].lang_pred == "und" and out[i][0].score == 0 for i in (901, 902, 903))
    assert out[904][0].lang_pred != "und" and len(out[905]) == 2 and out[905][0] == out[905][1] and out[None][0].held_out is False
    nothing = language.identify(frame(spark, [(1, "text", None), (2, None, None)])).collect()
    assert [r.lang_pred for r in nothing] == ["und", "und"]
    assert language.identify(frame(spark, []).where("false")).count() == 0


@pytest.mark.parametrize("key", [None, 4])
def test_rows_that_share_an_id_or_have_none_are_learned_from(spark, key):
    """60,000 rows under one key, two of three of them one text that repeats."""
    base = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 100").select(F.substring("text", 1, 300).alias("text"), "lang")
    own = base.crossJoin(spark.range(20_000 // base.count() + 1)).limit(20_000).select(F.concat_ws(" ", "text", "id").alias("text"), "lang")
    rows = own.union(base.where("lang = 'de'").limit(1).crossJoin(spark.range(40_000)).select("text", "lang")).select(F.lit(key).cast("long").alias("doc_id"), "text", "lang")
    assert zlib.crc32(b"4") % 4 != 2
    net = language.train(rows)
    assert net.languages == sorted(r.lang for r in base.select("lang").distinct().collect())
    out = rows.select("lang", language.answer(net, F.col("text"))["lang"].alias("found")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("found") == F.col("lang")).alias("right"), F.count_if(F.col("found") == 'und').alias("und")).first()
    assert out.n == 60_000 and out.und == 0 and out.right >= 0.97 * out.n


def slow_answer(net, text):
    """Forward pass in plain loops: every window, every filter of every width at every place."""
    raw = text.encode()
    share, mass = np.zeros(len(net.languages)), 0.0
    for at in range(0, len(raw), language.WINDOW):
        window = raw[at:at + language.WINDOW].ljust(language.WINDOW, b"\0")
        hidden = []
        for f in range(net.filters.shape[1]):
            width = language.WIDTHS[f // language.FILTERS]
            best = max(sum(float(net.embedding[window[p + k]] @ net.filters[k * language.EMBEDDING:(k + 1) * language.EMBEDDING, f]) for k in range(width))
                       for p in range(language.WINDOW - max(language.WIDTHS) + 1))
            hidden.append(max(0.0, best + float(net.bias[f])))
        e = np.exp(np.array(hidden) @ net.out + net.out_bias)
        letters = sum(bytes([b]).isalpha() or b >= 128 for b in window) + 1e-3
        share, mass = share + letters * e / e.sum(), mass + letters
    return net.languages[int(share.argmax())], float((share / mass).max())


def test_answers_equal_a_forward_pass_in_plain_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = language.train(docs)
    rows = docs.where("length(text) between 40 and 1500").orderBy("doc_id").limit(12)
    for r in rows.select("text", language.answer(net, F.col("text")).alias("a")).collect():
        lang, score = slow_answer(net, r.text)
        assert r.a.lang == lang and r.a.score == pytest.approx(score, abs=1e-4)


def test_windows_cover_the_text():
    text = "aé" * 1000
    assert language.windows_of(text).tobytes().rstrip(b"\0").decode() == text
    assert language.windows_of(None).shape == (1, language.WINDOW)


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    windows, labels = rng.integers(97, 110, (12, language.WINDOW)).astype(np.uint8), [str(i % 3) for i in range(12)]
    net = language.fit(windows, labels, steps=2)
    y = np.array([i % 3 for i in range(12)])
    mask = (net.filters != 0).astype(np.float32)
    for name in ("embedding", "filters", "bias", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    parts = [net.embedding, net.filters, net.bias, net.out, net.out_bias]
    grads = language._gradients(net, windows, y, np.ones(12), mask)
    loss = lambda: -np.log(net.probabilities(windows)[np.arange(12), y]).mean()
    for p, g in zip(parts, grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep, step = p[at], 1e-6
        p[at] = keep + step
        up = loss()
        p[at] = keep - step
        down = loss()
        p[at] = keep
        assert g[at] == pytest.approx((up - down) / (2 * step), rel=1e-2)


def test_pipeline_matches_its_stages_by_brute_force(spark):
    from tests.llm.test_dedup_mix_shard import brute_components, brute_simhash, check_shards
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    first = corpus_pipeline.known_language(spark, docs, SF)
    assert first.columns == docs.columns and {r.doc_id for r in rows if any(c.isalpha() for c in r.text)} >= {r.doc_id for r in first.collect()}
    prints = [brute_simhash(r.text) for r in rows]
    roots = brute_components(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    second = corpus_pipeline.first_of_near_duplicates(spark, docs, SF)
    assert second.columns == docs.columns and sorted(r.doc_id for r in second.collect()) == [rows[i].doc_id for i in sorted(set(roots))]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {k[0] for k in brute_hits([(r.doc_id, r.text) for r in rows], bench) if not k[3]}
    third = corpus_pipeline.without_benchmark(spark, docs, SF)
    assert third.columns == docs.columns and {r.doc_id for r in third.collect()} == clean
    fourth = corpus_pipeline.mixed(spark, docs, SF)
    taken = {r.doc_id: r.taken // max(r.size, 1) for r in queries.QUERIES["op10_mixing"](spark, SF).collect() if r.size}
    assert fourth.columns == docs.columns and Counter(r.doc_id for r in fourth.collect() if r.text.split()) == Counter({k: v for k, v in taken.items() if v})
    check_shards(corpus_pipeline.sharded(spark, docs, SF).collect(), [(r.doc_id, r.text) for r in rows], 16)


def test_pipeline_runs_whole_and_on_odd_rows(spark):
    out = corpus_pipeline.run(spark, SF)
    assert set(out.columns) >= {"doc_id", "size", "text_crc32", "shard", "slot"} and out.count() > 100
    odd = frame(spark, [(1, None, None), (None, "the one text of it", "en"), (None, "the one text of it", "en"), (3, "some text here", "en"), (3, "some text here", "en"),
                        (4, "", None), (5, "other words of a longer kind " * 4000, "fr")]).withColumn("text_hash", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, SF).columns == odd.columns
        assert stage(spark, odd.where("false"), SF).count() == 0
        stage(spark, odd, SF).write.format("noop").mode("overwrite").save()
    repeated = corpus_pipeline.first_of_near_duplicates(spark, odd.where("doc_id = 3"), SF)
    assert repeated.count() == 1
