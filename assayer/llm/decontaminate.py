"""Benchmark decontamination: a stored positional inverted index of the training words, searched for phrases and proximity."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.shared import store

SEGMENT_BYTES = 4_000_000  # of text; a longer text is a segment of its own
BLOCK_WORDS = 2_000_000  # of test items that are searched for in one pass
# Bytes that are words (digits, a-z, all of non-ASCII characters); A-Z count as a-z.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

INDEX_SCHEMA = "segment string, ids array<long>, n_words array<long>, starts binary, terms string, offsets binary, postings binary"
# ids: of the segment's documents; starts: word number at which each begins, and the end; terms: line by line;
# offsets: where each term's postings begin, and the end; postings: ascending word numbers. Numbers are 32-bit, little-endian.


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


def _segment(ids: list, texts: list) -> dict:
    words = pc.ascii_split_whitespace(pa.array([t or b"" for t in texts], pa.large_binary()).cast(pa.large_string()))
    counts = np.array([0 if not t else n for t, n in zip(texts, pc.list_value_length(words).to_pylist(), strict=True)], np.int64)
    flat = pc.list_flatten(words).filter(pa.array(np.repeat(np.array([bool(t) for t in texts]), pc.list_value_length(words).to_numpy())))
    coded = flat.dictionary_encode()
    codes, terms = coded.indices.to_numpy(), coded.dictionary
    if len(terms) < 1 << 16:
        codes = codes.astype(np.uint16)  # sorted by radix
    return {
        "segment": uuid.uuid4().hex, "ids": ids, "n_words": counts, "starts": np.concatenate(([0], np.cumsum(counts))).astype("<i4").tobytes(),
        "terms": "\n".join(terms.to_pylist()), "offsets": np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=len(terms))))).astype("<i4").tobytes(),
        "postings": np.argsort(codes, kind="stable").astype("<i4").tobytes()}


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("segment", pa.string()), ("ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("starts", pa.binary()), ("terms", pa.string()), ("offsets", pa.binary()),
                        ("postings", pa.binary())])
    for batch in batches:
        ids, texts, size = [], [], 0
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            if ids and size + len(t or b"") > SEGMENT_BYTES:
                yield pa.RecordBatch.from_pylist([_segment(ids, texts)], schema)
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t and t.translate(WORD_BYTES).strip())
            size += len(t or b"")
        if ids:
            yield pa.RecordBatch.from_pylist([_segment(ids, texts)], schema)


def build_index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The stored index: one row per segment of documents, with the positions of every word in it, none left out.

    It is distributed by documents, so a very common word is spread over all segments and no shuffle is needed.
    """
    slim = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return store(slim.mapInArrow(_segments, INDEX_SCHEMA), "index")


class Postings:
    """One segment of the index, read back."""

    def __init__(self, row: dict):
        self.segment, self.ids = row["segment"], row["ids"]
        self.starts, self.offsets, self.postings = (np.frombuffer(row[k], "<i4") for k in ("starts", "offsets", "postings"))
        self.terms = pa.array(row["terms"].split("\n") if row["terms"] else [], pa.string())
        self.counts = np.diff(self.offsets)

    def numbers(self, terms: pa.Array) -> np.ndarray:
        """The segment's numbers of the terms, -1 where it has none."""
        return pc.fill_null(pc.index_in(terms, value_set=self.terms), -1).to_numpy(zero_copy_only=False)

    def of(self, term: int) -> np.ndarray:
        return self.postings[self.offsets[term]:self.offsets[term + 1]]

    def documents(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document of each span, and whether the span lies in it as a whole."""
        doc = np.searchsorted(self.starts, first, "right") - 1
        return doc, (first >= 0) & (last < self.starts[doc + 1])

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """First positions of all occurrences: lists moved by their offset are intersected from the rarest term on."""
        order = np.argsort(self.counts[terms], kind="stable")
        found = self.of(terms[order[0]]) - order[0]
        for k in order[1:]:
            if not len(found):
                break
            near = self.of(terms[k])
            at = np.searchsorted(near, found + k)
            found = found[near[np.minimum(at, len(near) - 1)] == found + k]
        doc, inside = self.documents(found, found + len(terms) - 1)
        return found[inside]

    def proximity(self, terms: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last positions of spans of at most `within` words of one document that hold all the terms.

        Each span is the shortest around an occurrence of the rarest term. Occurrences without every other term near
        them are dropped list by list, from the rarest on; the few that are left are searched word by word.
        """
        distinct = np.unique(terms)
        order = distinct[np.argsort(self.counts[distinct], kind="stable")]
        found = self.of(order[0])
        near = lambda p: (
            (doc := np.searchsorted(self.starts, p, "right") - 1), np.maximum(p - within + 1, self.starts[doc]),
            np.minimum(p + within - 1, self.starts[doc + 1] - 1))[1:]
        for term in order[1:]:
            low, high = near(found)
            found = found[np.searchsorted(self.of(term), high, "right") > np.searchsorted(self.of(term), low, "left")]
        spans = []
        for p in found.tolist():
            low, high = near(np.int64(p))
            places = [(int(x), t) for t in order[1:] for x in self.of(t)[np.searchsorted(self.of(t), low):np.searchsorted(self.of(t), high, "right")]]
            best = None
            for first in sorted({p, *(x for x, _ in places if x < p)}):
                ends = [min((x for x, u in places if u == t and x >= first), default=None) for t in order[1:]]
                if None not in ends:
                    last = max([p, *ends])
                    if last - first < within and (best is None or last - first < best[1] - best[0]):
                        best = (first, last)
            if best:
                spans.append(best)
        return np.array([a for a, _ in spans], np.int64), np.array([b for _, b in spans], np.int64)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


HITS = "segment string, slot int, item_id long, spans array<struct<first: int, end: int>>"


def _searcher(items: list[tuple[int, list[bytes]]], window: int, within: int | None):
    """items: (id, words). Windows of one length are one matrix of word numbers."""
    lookup: dict[bytes, int] = {}
    grouped: dict[int, tuple[list, list]] = {}
    for item, words in items:
        k = min(window, len(words))
        numbers = [lookup.setdefault(w, len(lookup)) for w in words]
        for a in range(len(words) - k + 1 if k else 0):
            whose, rows = grouped.setdefault(k, ([], []))
            whose.append(item)
            rows.append(numbers[a:a + k])
    matrices = {k: (np.array(whose), np.array(rows)) for k, (whose, rows) in grouped.items()}
    terms = [w.decode() for w in lookup]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("segment", pa.string()), ("slot", pa.int32()), ("item_id", pa.int64()),
                            ("spans", pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))])
        asked = pa.array(terms, pa.string())
        for batch in batches:
            for row in batch.to_pylist():
                held, hits = Postings(row), {}
                numbers = held.numbers(asked)
                for k, (whose, rows) in matrices.items():
                    local = numbers[rows]
                    for w in np.flatnonzero((local >= 0).all(axis=1)):
                        if within is None:
                            first = held.phrase(local[w])
                            last = first + k
                        else:
                            first, last = held.proximity(local[w], within)
                            last = last + 1
                        if len(first):
                            docs, _ = held.documents(first, first)
                            for d, a, b in zip(docs.tolist(), first.tolist(), last.tolist(), strict=True):
                                hits.setdefault((d, int(whose[w])), []).append((a - int(held.starts[d]), b - int(held.starts[d])))
                yield pa.RecordBatch.from_pylist([
                    {"segment": held.segment, "slot": d, "item_id": item, "spans": [{"first": a, "end": b} for a, b in merged(s)]}
                    for (d, item), s in sorted(hits.items())], schema)
    return run


def _blocks(items: DataFrame, id_column: str, text_column: str) -> Iterator[list[tuple[int, list[bytes]]]]:
    block, size = [], 0
    for r in items.select(F.col(id_column).cast("long"), text_column).where(F.col(id_column).isNotNull()).toLocalIterator():
        words = words_of(r[1])
        if block and size + len(words) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((r[0], words))
        size += len(words)
    if block:
        yield block


def search(index: DataFrame, items: DataFrame, window: int = 10, within: int | None = None, id_column: str = "item_id",
           text_column: str = "text") -> DataFrame:
    """`segment, slot, item_id, spans`: where windows of the test items occur, as word numbers of the document.

    A window is `window` consecutive words of an item; an item of fewer, but not none, is one window. Without `within`
    the whole phrase has to occur; with it, all its distinct words have to occur, in any order, in a span of at most
    that many words. The items are the query: they are taken in blocks of bounded size, one pass over the index
    for each. Items without an id or words find nothing; items that repeat count once.
    """
    out = None
    for block in _blocks(items, id_column, text_column):
        hits = index.mapInArrow(_searcher(block, window, within), HITS)
        out = hits if out is None else out.unionByName(hits)
    return out if out is not None else index.sparkSession.createDataFrame([], HITS)


def contaminated(docs: DataFrame, items: DataFrame, window: int = 10, within: int | None = None, id_column: str = "doc_id",
                 text_column: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """`id, n_words, spans, item_ids` of every row; no other column of docs is read.

    spans are the hit parts of the document, one array of merged `first, end` for each item in item_ids. Null and empty
    texts have no words. Rows that repeat, or without an id, each have their own result.
    """
    index = build_index(docs, id_column, text_column)
    lengths = index.select(
        "segment", F.posexplode(F.arrays_zip("ids", "n_words")).alias("slot", "doc")).select(
        "segment", "slot", F.col("doc.ids").alias(id_column), F.col("doc.n_words").alias("n_words"))
    hits = search(index, items, window, within, item_id, item_text).groupBy("segment", "slot", "item_id").agg(F.flatten(F.collect_list("spans")).alias("s"))
    each = hits.groupBy("segment", "slot").agg(F.sort_array(F.collect_list(F.struct("item_id", "s"))).alias("found"))
    return lengths.join(each, ["segment", "slot"], "left").select(
        id_column, "n_words", F.coalesce("found.s", F.array().cast("array<array<struct<first: int, end: int>>>")).alias("spans"),
        F.coalesce("found.item_id", F.array().cast("array<long>")).alias("item_ids"))
