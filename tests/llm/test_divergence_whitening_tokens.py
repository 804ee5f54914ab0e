import random
from collections import Counter, defaultdict
from math import inf, nan

import numpy as np
import public_tokenizers
import pytest
import regex
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from assayer.llm import divergence, queries, tokens, whitening

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
COUNTER = tokens.load(MODEL)
# columns that a caller's table may have and whose names the operators use themselves
DOCS = "doc_id long, text string, lang string, source string, n long, term string, k1 string, p int, token string"
VECTORS = "vec_id long, embedding array<float>, label int, x string, id int, whitened string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1, "x", "y", 2, "z") for i, t, lang, s in rows], DOCS).repartition(3)


def brute_audit(rows, least, top):
    """The contract of the audit in plain Python integers."""
    counts, groups, within = defaultdict(Counter), defaultdict(set), defaultdict(Counter)
    for text, lang, source in ((t or "", la or "", s or "") for t, la, s in rows):
        w = regex.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        groups[lang].add(source)
        counts[lang, source].update(w)
        within[lang].update(set(w))
    out = set()
    for lang, sources in groups.items():
        kept = sorted((t for t, n in within[lang].items() if n >= least), key=lambda t: t.encode())
        v = len(kept)
        total = Counter()
        for s in sources:
            total.update(counts[lang, s])

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10 ** 9 * (c[t] + 2) // (n + 2 * v) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(total)
        for s in sources:
            values = [(sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o) for o in sources if o != s]
            values.sort(key=lambda x: (-x[0], x[1].encode()))
            out |= {(lang, s, "pair", o, value, k) for k, (value, o) in enumerate(values, 1)}
            terms = [((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            terms.sort(key=lambda x: (-x[0], x[1].encode()))
            out |= {(lang, s, "term", t, value, k) for k, (value, t) in enumerate(terms[:top], 1)}
    return out


ODD = ([(i, "the Cat sat; on the mat " * (i % 3 + 1), "en", f"s{i % 4}") for i in range(24)] + [
    (None, None, None, None), (1, "", "en", None), (1, "  \n", "en", "empty"), (2, "ÄÖÜ äöü the", "de", "s1"), (2, "ÄÖÜ äöü the", "de", "s1"), (3, "word " * 4000, "en", "long"),
    (4, "the\x00cat\x7fthe", "en", "s1")])


def test_audit_of_odd_rows_and_ties_equals_brute_force(spark):
    for least, top in ((2, 3), (10, 10), (10 ** 6, 2)):
        got = divergence.audit(docs(spark, ODD), least, top)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert {tuple(r) for r in got.collect()} == brute_audit([r[1:] for r in ODD], least, top)


def test_audit_in_many_shards_and_tiles_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SHARD", 5)
    monkeypatch.setattr(divergence, "TILE", 2)
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(0, 12))), rng.choice(["a", "b"]), f"s{rng.randint(0, 6)}") for i in range(150)]
    rows += [(i, "a b c a", "a", "hot") for i in range(300)]
    out = [tuple(r) for r in divergence.audit(docs(spark, rows), 10, 4).collect()]
    assert len(out) == len(set(out)) and set(out) == brute_audit([r[1:] for r in rows], 10, 4)


def test_audit_of_nothing(spark):
    assert divergence.audit(docs(spark, []).limit(0)).count() == 0


@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.text(alphabet="ab .,1▁\n\tß中é\U0001F600", max_size=60)), max_size=8))
@settings(max_examples=200, deadline=None)
def test_parts_of_texts_have_the_tokens_of_the_whole(texts):
    import pyarrow as pa
    owner, parts = COUNTER.pretokens(pa.array(texts, pa.string()))
    sums = np.bincount(owner, COUNTER.pieces(parts), minlength=len(texts)) if len(parts) else np.zeros(len(texts))
    assert sums.tolist() == [len(LIBRARY.encode(t or "")) for t in texts]


@pytest.mark.parametrize("most", [0, 5, tokens.HEAD])
def test_token_counts_equal_the_library_whatever_the_head(spark, monkeypatch, most):
    monkeypatch.setattr(tokens, "head", lambda vocab, f=tokens.head: f(vocab, most))
    rows = [*ODD, (7, "<s> special </s> <unk> <0x0A>", "en", "a"), (8, "x" * 30000, "en", "a"), (9, " lead\u2581mark  two   ", "en", "a"), (10, "中文 テスト 1234567 \r\n", "zh", None)]
    rows += [(100 + i, "a copy that many rows hold", "en", "hot") for i in range(50)] + [(None, "no id", None, None)] * 2
    out = tokens.count_tokens(docs(spark, rows), MODEL, limit=50).collect()
    want = Counter((i, len((t or "").encode()), len(LIBRARY.encode(t or "")), len(LIBRARY.encode(t or "")) > 50) for i, t, _, _ in rows)
    assert Counter(map(tuple, out)) == want


def test_token_query_equals_the_library(spark):
    given_rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = Counter((r.doc_id, len((r.text or "").encode()), len(LIBRARY.encode(r.text or "")), len(LIBRARY.encode(r.text or "")) > 4096) for r in given_rows)
    assert Counter(map(tuple, queries.QUERIES["op13_token_counts"](spark, SF).collect())) == want
    assert tokens.count_tokens(docs(spark, []).limit(0), MODEL).count() == 0


def whitened_by_numpy(x, k):
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    v = c.T @ c / n
    values, axes = np.linalg.eigh(v)
    return values[::-1][:k], axes[:, ::-1][:, :k], c, np.trace(v), [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for r in x]


def whole(rows):
    return np.array([np.floor(1024 * np.asarray(e, np.float32).astype(float)).astype(np.int64) + 100000 for e in rows])


def test_whitening_query_equals_numpy(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    values, axes, c, trace, apart = whitened_by_numpy(whole([r.embedding for r in rows]), 8)
    out = queries.QUERIES["op12_embedding_whitening"](spark, SF).toPandas().sort_values(["vec_id", "component"])
    assert len(out) == 8 * len(rows) and out.component.tolist() == list(range(1, 9)) * len(rows) and set(out.n) == {len(rows)}
    got = out.whitened.to_numpy().reshape(-1, 8)
    want = c @ axes / np.sqrt(values)
    want *= np.sign((want * got).sum(axis=0))  # either sign, the same for all rows
    assert np.abs(got - want).max() < 1e-9
    assert np.allclose(out.explained.to_numpy().reshape(-1, 8)[0], values / trace, rtol=1e-10) and out.deviation.tolist() == [v for v in apart for _ in range(8)]
    assert out.identity_error.nunique() == 1 and 0 <= out.identity_error.iloc[0] < 1e-10


def test_whitening_leaves_out_what_is_no_vector_and_takes_equal_and_few_ones(spark):
    rng = np.random.default_rng(5)
    sound = [(i, rng.normal(size=4).astype(float).tolist()) for i in range(30)] + [(30, [1.0, 2.0, 3.0, 4.0])] * 2
    bad = [(40, None), (41, [1.0, None, 2.0, 3.0]), (42, [nan, 1.0, 1.0, 1.0]), (43, [inf, 1.0, 1.0, 1.0]), (44, []), (45, [1.0, 2.0]), (46, [3e38, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(i, e, 1, "x", 2, "y") for i, e in sound + bad], VECTORS).repartition(3)
    out = whitening.whiten(frame).toPandas()
    assert sorted(set(out.vec_id)) == list(range(31)) and len(out) == 4 * 32 and out.identity_error.max() < 1e-10
    few = whitening.whiten(frame.where("vec_id < 2")).toPandas().sort_values(["component", "vec_id"])
    assert few.whitened.notna().tolist() == [True, True] + [False] * 6 and np.allclose(np.abs(few.whitened[:2]), 1) and few.explained[2:].max() == 0
    one = whitening.whiten(frame.where("vec_id = 30")).toPandas()
    assert len(one) == 8 and one.whitened.isna().all() and set(one.deviation) == {0} and one.identity_error.isna().all()
    assert whitening.whiten(frame.where("vec_id >= 40 and vec_id < 45")).count() == 0 and whitening.whiten(frame.limit(0)).count() == 0


def test_deviation_beyond_a_long_is_told_as_decimal(spark):
    frame = spark.createDataFrame([(i, [float(i) * 2 ** 18, 1.0], 1, "x", 2, "y") for i in range(40)], VECTORS)
    out = {r.vec_id: r for r in whitening.whiten(frame, components=1).collect()}
    x = whole([[float(i) * 2 ** 18, 1.0] for i in range(40)])
    apart = whitened_by_numpy(x, 1)[4]
    assert [int(out[i].deviation_exact) for i in range(40)] == apart
    assert all(out[i].deviation == (apart[i] if apart[i] < 2 ** 63 else None) for i in range(40)) and out[0].deviation is None


def test_equal_eigenvalues_and_inertia(spark):
    rng = np.random.default_rng(6)
    q, _ = np.linalg.qr(rng.normal(size=(40, 40)))
    values = np.array([1e6, 50.0, 50.0, 50.0, *np.linspace(3, 2, 26), *np.zeros(10)])
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    for shift in (-1.0, 1e-3, 2.5001, 49.0, 51.0, 2e6):
        assert whitening.above(a, shift) == (values > shift).sum()
    got, axes = whitening.feast(spark, a, 8)
    assert np.allclose(got, values[:8], rtol=1e-9) and np.abs(axes.T @ axes - np.eye(8)).max() < 1e-12
    assert np.abs(a @ axes - axes * got).max() < 1e-8


def test_products_are_exact_beyond_doubles():
    y = np.random.default_rng(7).integers(-2 ** 40, 2 ** 40, (50, 3))
    parts = whitening.exact_products(y)
    total = sum(g.astype(object) * (1 << power) for power, g in parts.items())
    assert (total == y.astype(object).T @ y.astype(object)).all()


def test_crowded_eigenvalues_are_told_apart(spark):
    rng = np.random.default_rng(8)
    q, _ = np.linalg.qr(rng.normal(size=(64, 64)))
    values = np.sort(np.concatenate([[27000.0, 26600.0], 17000 * (1 + np.sort(rng.uniform(0, 0.02, 62)))]))[::-1]
    a = (q * values) @ q.T
    got, axes = whitening.feast(spark, (a + a.T) / 2, 8)
    assert np.allclose(got, values[:8], rtol=1e-12) and np.abs(np.abs(axes.T @ q[:, :8]) - np.eye(8)).max() < 1e-7


def test_parts_that_start_at_a_multiple_of_eight_count_their_own_texts():
    import pyarrow as pa
    texts = [f"{'Wide ' * (i % 7)}É{chr(65 + i % 26) * (1 + i % 5)}" for i in range(1100)]
    whole = pa.RecordBatch.from_pydict({"lang": ["x"] * 1100, "source": ["s"] * 1100, "text": texts})
    for start, rows in ((0, 1100), (8, 1000), (64, 900)):
        out = pa.Table.from_batches(list(divergence.partial_counts(iter([whole.slice(start, rows)])))).group_by("term").aggregate([("count", "sum")]).to_pylist()
        words = [w for t in texts[start:start + rows] for w in t.translate({i: i + 32 for i in range(65, 91)}).split(" ")]
        assert {r["term"]: r["count_sum"] for r in out if r["term"]} == {w: words.count(w) for w in set(words)}
