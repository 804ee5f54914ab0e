"""Token counts: pieces counted once per distinct pre-token, joined to the pre-token frequencies of each text, and summed."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from assayer.llm.shared import slices, store

SPACE_MARK = "▁"  # how the vocabulary writes a space
HEAD = 50_000  # most frequent pre-tokens, looked up where the texts are read; all others are joined by a shuffle
HEAD_BYTES = 64  # longer ones never belong to the head, so it has at most HEAD * HEAD_BYTES bytes
PER_DOUBLING = 16  # classes of frequency by which the head is found


class PieceModel:
    """A BPE model of whole texts, cut where no piece of its vocabulary can reach across.

    Two bytes that stand side by side in no piece are never merged into one, and merges on both sides of such a place
    do not see each other. So a text may be cut there, and its tokens are those of its parts: words, runs of spaces,
    single digits, line ends. The space that the library puts before a text is put there before the text is cut.
    """

    def __init__(self, model: bytes):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        rules = proto.normalizer_spec
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE:
            raise ValueError("only BPE models can be counted by parts")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the model changes its text in ways that depend on more than a part of it")
        self.prefix = rules.add_dummy_prefix
        rules.add_dummy_prefix = False
        self.bare = proto.SerializeToString()
        self.cuts = np.ones((256, 256), bool)
        self.cuts[:, 0x80:0xC0] = False  # never inside a character
        whole = [p.piece for p in proto.pieces if p.type in (p.NORMAL, p.USER_DEFINED, p.UNUSED)]
        for piece in whole:
            raw = piece.replace(SPACE_MARK, " ").encode()
            for a, b in zip(raw, raw[1:], strict=False):
                self.cuts[a, b] = False

    def __getstate__(self):
        return {"prefix": self.prefix, "bare": self.bare, "cuts": self.cuts}

    @cached_property
    def processor(self) -> sentencepiece.SentencePieceProcessor:
        return sentencepiece.SentencePieceProcessor(model_proto=self.bare)

    def pretokens(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Number of the text and the pre-token, for all pre-tokens of a batch of texts in order. Null is empty."""
        plain = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), SPACE_MARK, " ")
        if self.prefix:
            plain = pc.if_else(pc.equal(pc.binary_length(plain), 0), plain, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), plain, pa.scalar("", pa.large_string())))
        plain = pa.concat_arrays([plain])
        ends = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset:plain.offset + len(plain) + 1]
        data = np.frombuffer(plain.buffers()[2], np.uint8) if ends[-1] > ends[0] else np.zeros(0, np.uint8)
        data = data[ends[0]:ends[-1]]
        ends = ends - ends[0]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = self.cuts[data[:-1], data[1:]] if len(data) > 1 else False
        cut[ends] = True
        places = np.flatnonzero(cut)
        if not len(data):
            return np.zeros(0, np.int64), pa.array([], pa.large_string())
        parts = pa.LargeStringArray.from_buffers(len(places) - 1, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        return np.searchsorted(ends, places[:-1], "right") - 1, parts

    def pieces(self, parts: pa.Array) -> np.ndarray:
        """Number of pieces of each pre-token."""
        return np.fromiter((len(x) for x in self.processor.encode(parts.to_pylist(), num_threads=1)), np.int64, len(parts))


def load(path: str) -> PieceModel:
    with open(path, "rb") as f:
        return PieceModel(f.read())


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, "text")


def vocabulary(texts: DataFrame, model: PieceModel) -> DataFrame:
    """`token, n, pieces` of every distinct pre-token of the column `text`, each given to the library once; stored."""
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            coded = model.pretokens(part.column("text"))[1].dictionary_encode()
            n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), pa.array(n)], ["token", "n"])

    def count_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token = batch.column("token")
            yield pa.RecordBatch.from_arrays([token, batch.column("n"), pa.array(model.pieces(token))], ["token", "n", "pieces"])

    distinct = texts.mapInArrow(counts, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return store(distinct.mapInArrow(count_pieces, "token string, n long, pieces long"), "vocabulary")


def head(vocab: DataFrame, most: int = HEAD) -> dict[str, int]:
    """Pieces of the most frequent pre-tokens, `most` at most: whole classes of frequency from the highest down."""
    short = vocab.where(F.octet_length("token") <= HEAD_BYTES).withColumn("_class", F.floor(F.log2("n") * PER_DOUBLING).cast("int"))
    total, least = 0, None
    for r in short.groupBy("_class").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("_class")).collect():
        total += r.c
        if total > most:
            break
        least = r["_class"]
    return {} if least is None else {r.token: r.pieces for r in short.where(F.col("_class") >= least).select("token", "pieces").collect()}


def split_counts(texts: DataFrame, model: PieceModel, known: dict[str, int]) -> DataFrame:
    """`k1, k2, token, n` of rows `k1, k2, text`: the tokens of all known pre-tokens of a text in one row without token, and
    the frequency of every other one. Rows of one text in a batch are one."""
    names = pa.array(list(known), pa.large_string())
    worth = np.array([*known.values(), 0], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            owner, parts = model.pretokens(part.column("text"))
            coded = parts.dictionary_encode()
            code, size = coded.indices.to_numpy(), max(1, len(coded.dictionary))
            both, n = np.unique(owner * size + code, return_counts=True)
            owner, code = both // size, both % size
            found = pc.fill_null(pc.index_in(coded.dictionary, names), len(names)).to_numpy()[code]
            sums = np.zeros(part.num_rows, np.int64)
            np.add.at(sums, owner, n * worth[found])
            rest = found == len(names)
            k1, k2 = part.column("k1"), part.column("k2")
            whose = pa.array(owner[rest])
            yield pa.RecordBatch.from_arrays([k1, k2, pa.nulls(len(k1), pa.string()), pa.array(sums)], ["k1", "k2", "token", "n"])
            yield pa.RecordBatch.from_arrays(
                [k1.take(whose), k2.take(whose), coded.dictionary.take(pa.array(code[rest])).cast(pa.string()), pa.array(n[rest])], ["k1", "k2", "token", "n"])
    return texts.mapInArrow(run, "k1 long, k2 long, token string, n long")


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`id, n_bytes, n_tokens, over_limit` of every row: the number of tokens of its whole text, as the library gives them.

    Distinct pre-tokens are counted and given to the library once. The most frequent ones (a bounded head) are then
    summed where a text is read; frequencies of all others meet their pieces in a shuffle by pre-token, where each text
    has at most one row per pre-token, and the products are combined per text before they move. Texts are known by 128
    bits of their hashes, so that rows which repeat share their work: their sums add up and are divided by their number.

    Null is an empty text: no bytes, no tokens. Rows that repeat and rows without an id have a row each. No other
    column of docs is read. An empty table gives an empty result.
    """
    model = load(model_path)
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column), text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(13), text).alias("k2"))
    vocab = vocabulary(rows.select("text"), model)
    told = split_counts(rows.select("k1", "k2", "text"), model, head(vocab))
    tail = told.where("token is not null").join(vocab.select("token", "pieces").hint("merge"), "token").select("k1", "k2", (F.col("n") * F.col("pieces")).alias("n"))
    keyed = [F.col("k1").alias("_k1"), F.col("k2").alias("_k2")]
    # a row of the head stands for each row of docs, so their number is that of the rows with this text
    sums = told.where("token is null").select("k1", "k2", "n", F.lit(1).alias("c")).union(tail.withColumn("c", F.lit(0)))
    totals = sums.groupBy(*keyed).agg(F.sum("n").alias("_n"), F.sum("c").alias("_c"))
    slim = rows.select(id_column, F.octet_length("text").cast("long").alias("n_bytes"), "k1", "k2")
    joined = slim.join(totals.hint("merge"), (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")))
    n_tokens = F.expr("_n div _c")
    return joined.select(id_column, "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
