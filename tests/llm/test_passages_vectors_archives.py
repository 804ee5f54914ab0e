import gzip
import hashlib
import io
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from assayer.llm import embeddings, paragraphs, queries, warc
from assayer.llm.decontaminate import words_of
from tests.llm.test_dedup_mix_shard import brute_components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, id string, th long, place int, c1 long, key int, kept boolean"


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, 4, True) for i, t in rows], DOCS).repartition(3)


def brute_blocks(text, least):
    """Number of the first line and words of each paragraph: a long line, or shorter ones in a row until they are as long."""
    first, words = None, []
    for k, line in enumerate((text or "").split("\n")):
        w = words_of(line)
        if not w:
            continue
        if len(w) >= least:
            first, words = None, []
        first, words = (k if first is None else first), words + w
        if len(words) >= least:
            yield first, words
            first, words = None, []


def brute_repeats(rows, threshold=0.8, least=25):
    units = [(i, k, w) for i, t in rows for k, w in brute_blocks(t, least)]
    units = [(i, k, w, {tuple(w[a:a + 5]) for a in range(len(w) - 4)}) for i, k, w in units]
    order = sorted(range(len(units)), key=lambda u: (units[u][0] is None, units[u][0] or 0, units[u][1]))
    units = [units[u] for u in order]
    posting = defaultdict(set)
    for u, (_, _, _, s) in enumerate(units):
        for g in s:
            posting[g].add(u)
    pairs = {(a, b) for us in posting.values() if len(us) > 1 for a in us for b in us if a > b}
    linked = {p for p in pairs if len(units[p[0]][3] & units[p[1]][3]) >= threshold * len(units[p[0]][3] | units[p[1]][3])}
    roots = brute_components(len(units), lambda i, j: (i, j) in linked)
    size = Counter(roots)
    return {(units[u][0], units[u][1]): (units[r][0], units[r][1]) for u, r in enumerate(roots) if size[r] > 1}


def got_repeats(df):
    rows = df.where("kind = 'paragraph'").collect()
    assert all(r.kept == ((r.doc_id, r.place) == (r.component_id, r.component_place)) for r in rows)
    return {(r.doc_id, r.place): (r.component_id, r.component_place) for r in rows}


def test_repeated_paragraphs_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").union(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id >= 200 and doc_id < 600"))
    want = brute_repeats([(r.doc_id, r.text) for r in docs.collect()])
    got = got_repeats(paragraphs.repeated(docs))
    assert len(want) > 100
    assert len({k: v for k, v in want.items() if got.get(k) == v}) >= 0.97 * len(want) and set(got) <= set(want)


def test_a_planted_passage_and_its_near_copies(spark, monkeypatch):
    monkeypatch.setattr(paragraphs, "TILE", 6)
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    passage = [word() for _ in range(120)]
    rows = []
    for i in range(60):
        copy = list(passage)
        if i % 3:
            copy[rng.randrange(120)] = word()
        rows.append((i, "\n".join([" ".join(word() for _ in range(40)), ", ".join(copy).upper(), "short line"])))
    rows += [(100 + i, " ".join(word() for _ in range(60))) for i in range(20)] + [(200, None), (201, ""), (None, "\n" + " ".join(passage)), (202, "a " * 30), (203, "a " * 30)]
    rows += [(0, rows[0][1])]
    got = got_repeats(paragraphs.repeated(docs_frame(spark, rows)))
    assert got == {**{(i, 1): (0, 1) for i in [*range(60), None]}, (202, 0): (202, 0), (203, 0): (202, 0), (0, 0): (0, 0)}
    assert paragraphs.repeated(docs_frame(spark, []).where("false")).count() == 0


def brute_runs(rows, run=51):
    """Document -> stretches of its words that lie in runs of `run` words which another document holds as well."""
    texts = [(i, words_of(t)) for i, t in rows]
    holders = defaultdict(set)
    for i, w in texts:
        for p in range(len(w) - run + 1):
            holders[tuple(w[p:p + run])].add(i)
    out = Counter()
    for i, w in texts:
        covered = {q for p in range(len(w) - run + 1) if len(holders[tuple(w[p:p + run])]) > 1 for q in range(p, p + run)}
        out.update((i, a, next(b for b in range(a, len(w) + 1) if b not in covered)) for a in covered if a - 1 not in covered)
    return out


def got_runs(out):
    return Counter((r.doc_id, r.start, r.end) for r in out if r.kind == "passage")


def test_equal_runs_of_given_rows_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").union(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id >= 200 and doc_id < 600"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = paragraphs.repeated(docs, least_words=51).collect()
    assert got_runs(out) == brute_runs(rows) and len(out) > 100
    texts = dict(rows)
    for r in out[::7]:
        lines = [words_of(line) for line in texts[r.doc_id].split("\n")]
        before = [sum(map(len, lines[:k])) for k in range(len(lines) + 1)]
        assert before[r.place] <= r.start < before[r.place + 1] and before[r.last_place] < r.end <= before[r.last_place + 1]


@pytest.mark.parametrize("group", [3, paragraphs.GROUP])  # surroundings of a passage beyond which they meet by a shuffle
def test_runs_in_any_context_and_layout_equal_brute_force(spark, monkeypatch, group):
    """Runs of 45 to 60 words beside chance ones of 20 words, inside lines, over lines, repeated in a text, in copies, without ids."""
    monkeypatch.setattr(paragraphs, "GROUP", group)
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    fill = lambda n: [word() for _ in range(n)]
    wrapped = lambda w: "".join(x + rng.choice([" ", " ", " ", "\n", ", "]) for x in w)
    common, rows = fill(20), []
    for p in range(25):
        passage = [*fill(rng.randrange(45)), *common, *fill(45)][:45 + p % 16] if p % 2 else fill(45 + p % 16)
        for k in range(3):
            rows.append((10 * p + k, wrapped([*fill(rng.choice([0, 3, 80])), *passage, *fill(rng.choice([0, 5, 90])), *(passage if k == 2 and p % 3 == 0 else [])])))
    rows += [(1000 + i, wrapped([*fill(40), *common, *fill(70)])) for i in range(30)]
    copy = wrapped(fill(200)).split(" ")
    rows += [(2000 + i, " ".join(copy)) for i in range(40)] + [(2100 + i, " ".join([*copy[:50 + i], "edit", *copy[51 + i:]])) for i in range(40)]
    rows += [(3000, "w " * 400), (3001, "w " * 300), (3002, None), (3003, ""), (3004, "only once"), (3005, "w " * 50), (2000, " ".join(copy)), (2001, "x " * 60), (2001, "x " * 60)]
    out = paragraphs.repeated(docs_frame(spark, rows), least_words=51).where("n_documents > 1").collect()
    assert got_runs(out) == brute_runs(rows)
    runs = [r for r in out if r.kind == "passage"]
    assert all(r.component_id <= r.doc_id and r.kept == (r.doc_id == r.component_id and r.start == min(x.start for x in runs if (x.component_id, x.component_place, x.doc_id) == (
        r.component_id, r.component_place, r.doc_id))) for r in runs if r.doc_id >= 2000 and r.doc_id < 2200 and r.doc_id != 2000)
    copies = {r.component_id for r in runs if 2000 <= r.doc_id < 2200 and r.doc_id != 2001 or r.doc_id == 2001 and r.end > 60}
    assert copies == {2000} and {r.component_id for r in runs if r.doc_id >= 3000} == {3000}
    nobody = paragraphs.repeated(docs_frame(spark, [(None, wrapped(copy)), (None, wrapped(copy)), (7, " ".join(copy))]), least_words=51).collect()
    assert {(r.doc_id, r.component_id, r.n_documents, r.kept) for r in nobody if r.kind == "passage"} == {(7, 7, 2, True), (None, 7, 2, False)}


def test_anchors_depend_on_the_passage_alone():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=7)).encode()
    for _ in range(50):
        passage = [word() for _ in range(51)]
        keys = []
        for _ in range(2):
            text = b" ".join([*(word() for _ in range(rng.randrange(60))), *passage, *(word() for _ in range(rng.randrange(60)))])
            keys.append(set(paragraphs.Units([text.replace(b" ", b"\n", 9)], 25).passages()[1].tolist()))
        assert keys[0] & keys[1]


def test_equal_passages_of_a_text_are_together():
    text, keys, starts = paragraphs.Units([b"word " * 500, b"one two " * 300], 25).passages()
    assert len(set(zip(text.tolist(), keys.tolist(), strict=True))) == len(keys) <= 3 and starts[0].tolist() == list(range(481))


def test_many_whole_groups_at_once_equal_each_by_itself():
    """Names of runs tell the same whatever groups lie in a table, and only another document counts."""
    import pyarrow as pa
    rng = random.Random(4)
    rows = []
    for key in range(1, 40):
        base = [rng.randrange(1, 1 << 32) for _ in range(2 * paragraphs.AROUND)]
        for i in range(rng.randrange(2, 9)):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.randrange(1, 1 << 32)
            if rng.random() < 0.3:
                words[rng.randrange(5, paragraphs.AROUND):paragraphs.AROUND] = []
                words = words[:paragraphs.AROUND] if len(words) < 2 * paragraphs.AROUND else words
                words = (words + [0] * 2 * paragraphs.AROUND)[:2 * paragraphs.AROUND]
            rows.append((key, rng.randrange(3), words))
    rows = [(k, d, i, w) for i, (k, d, w) in enumerate(rows)]

    def table(part):
        return pa.table({"key": pa.array([r[0] for r in part], pa.int64()), "id": pa.array([r[1] for r in part], pa.int64()), "most": pa.array([r[1] for r in part], pa.int64()),
                         "t1": pa.array([r[2] for r in part], pa.int64()), "t2": pa.array([0] * len(part), pa.int64()), "s": pa.array([0] * len(part), pa.int32()),
                         "words": pa.array([np.array(r[3], np.uint32).tobytes() for r in part], pa.binary())})

    def lengths(a, b):
        same = [0, 0]
        for side in (0, 1):
            for x, y in zip(a[side * paragraphs.AROUND:(side + 1) * paragraphs.AROUND], b[side * paragraphs.AROUND:(side + 1) * paragraphs.AROUND], strict=True):
                if x != y or not x:
                    break
                same[side] += 1
        return same

    got = {r["t1"]: (r["before"], r["behind"]) for r in paragraphs.compare_contexts(table(rows)).to_pylist()}
    want = {}
    for k, d, i, w in rows:
        near = [lengths(w, o[3]) for o in rows if o[0] == k and o[1] != d and sum(lengths(w, o[3])) >= paragraphs.AROUND]
        if near:
            want[i] = (max(x for x, _ in near), max(y for _, y in near))
    assert got == want


def test_bands_reach_the_recall():
    for threshold in (0.7, 0.8, 0.9):
        for rows in (3, 4, 6):
            n = paragraphs.bands(threshold, rows, 0.99)
            assert 1 - (1 - threshold ** rows) ** n >= 0.99 > 1 - (1 - threshold ** rows) ** (n - 1)


VECTORS = "vec_id long, embedding array<float>, label int, c string, links long, n_links long"


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, v, k, "x", 1, 2) for i, v, k in rows], VECTORS).repartition(4)


def brute_vectors(rows, threshold=0.98):
    ok = [v is not None and len(v) > 0 and k is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, k in rows]

    def linked(i, j):
        if not (ok[i] and ok[j]) or rows[i][2] != rows[j][2] or len(rows[i][1]) != len(rows[j][1]):
            return False
        a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
        return a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold
    n = len(rows)
    links = [sum(linked(i, j) for j in range(n) if j != i) for i in range(n)]
    roots = brute_components(n, linked)
    return links, roots


def test_vectors_of_clusters_copies_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 8)
    rng = np.random.default_rng(4)
    rows = []
    for c in range(6):
        centre = rng.standard_normal(32)
        for _ in range(12):
            rows.append([len(rows), (centre + rng.standard_normal(32) * 0.05).astype(np.float32).tolist(), c % 2])
    rows += [[len(rows) + i, rows[0][1], 0] for i in range(20)]
    rows += [[500 + i, rng.standard_normal(32).astype(np.float32).tolist(), 0] for i in range(30)]
    rows += [[600, None, 0], [601, [0.0] * 32, 0], [602, [float("nan")] * 32, 0], [603, [None] + [1.0] * 31, 0], [604, rows[0][1], None], [605, [], 0], [606, [1.0, 2.0], 0],
             [607, [2.0, 4.0], 0], [608, [float("inf")] + [1.0] * 31, 0], [609, [3e38] * 32, 1], [610, [1e-30] * 32, 1]]
    links, roots = brute_vectors(rows)
    out = {r.vec_id: r for r in embeddings.near_duplicates(vector_frame(spark, rows)).collect()}
    assert len(out) == len(rows)
    found = sum(out[r[0]].n_links for r in rows)
    assert 0.97 * sum(links) <= found <= sum(links) and all(out[r[0]].n_links <= n for r, n in zip(rows, links, strict=True))
    assert [out[r[0]].component_id for r in rows] == [rows[k][0] for k in roots]
    assert all(r.kept == (r.vec_id == r.component_id) for r in out.values())


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(8)
    rows = []
    for p in range(400):
        a = rng.standard_normal(64)
        b = rng.standard_normal(64)
        b -= a * (a @ b) / (a @ a)
        angle = math.acos(0.9805)
        near = math.cos(angle) * a / np.linalg.norm(a) + math.sin(angle) * b / np.linalg.norm(b)
        rows += [[2 * p, a.astype(np.float32).tolist(), 1], [2 * p + 1, near.astype(np.float32).tolist(), 1]]
    links, _ = brute_vectors(rows)
    out = embeddings.near_duplicates(vector_frame(spark, rows)).collect()
    assert sum(r.n_links for r in out) >= 0.98 * sum(links) > 700


def test_no_vectors_and_repeated_rows(spark):
    assert embeddings.near_duplicates(vector_frame(spark, []).where("false")).count() == 0
    out = embeddings.near_duplicates(vector_frame(spark, [[1, [1.0, 0.0], 3], [1, [1.0, 0.0], 3], [None, [1.0, 0.0], 3]])).collect()
    assert [(r.n_links, r.component_id, r.kept) for r in sorted(out, key=lambda r: r.vec_id or 9)] == [(2, 1, True), (2, 1, True), (2, 1, False)]


PAGES = "page_id long, url string, html string, path string, content binary, number int, record_type string"


def test_pages_come_back(spark):
    same, crlf = "<p>" + "é" * 60, "<b>x</b>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 5
    rows = [(7, "http://a b/c\td", same), (3, "http://x/", same), (9, None, same), (4, "http://y", None), (5, "http://y", ""), (6, "u", "short"), (8, "u", "short"),
            (10, "v", crlf), (11, "w", crlf), (None, "w", crlf), (3, "again", same), (12, "long", "long page\n" * 200_000)]
    frame = spark.createDataFrame([(*r, "x", b"y", 1, "z") for r in rows], PAGES).repartition(3)
    out = warc.round_trip(frame).collect()
    body = {i: (h or "").encode() for i, _, h in rows}
    assert Counter(r.page_id for r in out) == Counter(r[0] for r in rows)
    assert all(r.payload_bytes == len(body[r.page_id]) and r.payload_digest == hashlib.sha256(body[r.page_id]).hexdigest() for r in out)
    told = Counter((r.page_id, r.record_type, r.refers_to) for r in out)
    assert told == Counter([(3, "response", None), (3, "revisit", 3), (7, "revisit", 3), (9, "revisit", 3), (4, "response", None), (5, "response", None), (6, "response", None),
                            (8, "response", None), (10, "response", None), (11, "revisit", 10), (None, "revisit", 10), (12, "response", None)])
    assert warc.round_trip(frame.where("false")).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_records_of_both_versions(version):
    blocks = [b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody\nhttp://fake 1.2.3.4 20000101000000 text/html 5\n", b"", b"\x00\xff binary", b"HTTP/1.1 204 No Content"]
    data = warc.arc_head(version, "f.arc", "20010203040506") + b"\n" + b"".join(
        warc.arc_record(version, f"http://h/{i} x", "1.2.3.4", "20010203040506", "text/html", b) + b"\n" for i, b in enumerate(blocks))
    got = list(warc.read_arc(io.BytesIO(data)))
    assert [r.block for r in got] == blocks and [r.url for r in got] == [f"http://h/{i}%20x" for i in range(4)]
    assert [r.parts()[1] for r in got] == [blocks[0][24 + 2:], b"", blocks[2], b""] or got[0].parts()[1].startswith(b"body")
    cut = list(warc.read_arc(io.BytesIO(data[:-40])))
    assert len(cut) >= 2 and len(cut[-1].block) <= cut[-1].declared


def test_version_line_decides_the_fields():
    one = warc.arc_head(1, "a", "2001") + b"\n" + warc.arc_record(1, "http://one two three four five six", "-", "2001", "text/plain", b"x") + b"\n"
    two = warc.arc_head(2, "b", "2001") + b"\n" + warc.arc_record(2, "http://two", "-", "2001", "text/dns", b"yz") + b"\n"
    got = list(warc.read_arc(io.BytesIO(one + b"garbage line\n" + two)))
    assert [(r.url.count("%20"), r.mime, r.block) for r in got] == [(5, "text/plain", b"x"), (0, "text/dns", b"yz")]


def test_converted_records_are_well_formed():
    r = warc.ArcRecord(4, "http://h/", "1.2.3.4", "20010203040506", "text/html", b"HTTP/1.1 200 OK\r\nContent-Length: 4\r\n\r\nbody", 41)
    data = warc.converted("arc", r, None) + b"\r\n\r\n" + warc.converted("arc", r, ("<urn:uuid:1>", "http://o", "2000-01-01T00:00:00Z")) + b"\r\n\r\n"
    (first, block), (second, head) = warc.read_warc(gzip.open(io.BytesIO(gzip.compress(data))))
    assert first["warc-type"] == "response" and first["warc-date"] == "2001-02-03T04:05:06Z" and block == r.block
    assert first["warc-payload-digest"] == "sha256:" + hashlib.sha256(b"body").hexdigest() == second["warc-payload-digest"]
    assert second["warc-type"] == "revisit" and second["warc-refers-to"] == "<urn:uuid:1>" and head.endswith(b"\r\n\r\n")
    assert first["warc-record-id"] == warc.record_id("arc", 4) != warc.record_id("arc", 5)
    assert warc.timestamp("1999") == "1999-01-01T00:00:00Z" and warc.timestamp("19991399000000") == warc.EPOCH == warc.timestamp("x")


def test_queries_match_brute_force_on_given_rows(spark):
    rows = [[r.vec_id, list(r.embedding), r.label] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    links, roots = brute_vectors(rows)
    out = {r.vec_id: (r.n_links, r.component_id) for r in queries.QUERIES["op4_embedding_dedup"](spark, SF).collect()}
    assert out == {r[0]: (n, rows[k][0]) for r, n, k in zip(rows, links, roots, strict=True)}


def test_page_ids_up_to_the_limits_of_a_long_are_read_back(spark):
    most, html = (1 << 63) - 1, "<p>" + "x" * 200
    rows = [(most, "http://a/", html), (10 ** 18 + 5, "http://b/", html), (10 ** 18 + 7, "http://c/", html), (-most - 1, "http://d/", "<p>short"), (-1, "http://e/", html + "y"), (most - 1, "http://f/", html + "y")]
    out = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), least_bytes=100).collect()}
    first = 10 ** 18 + 5
    assert out == {most: ("revisit", first), first: ("response", None), first + 2: ("revisit", first), -most - 1: ("response", None), -1: ("response", None), most - 1: ("revisit", -1)}
    assert [warc._whole(x) for x in ("9223372036854775808", "-9223372036854775809", "\u0661", "1.0", "", None, "12")] == [None] * 6 + [12]
