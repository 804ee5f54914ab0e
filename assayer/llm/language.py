"""Language ID: a byte convolutional network, trained in numpy on a bounded sample, applied to windows of whole texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

UNDETERMINED = "und"
WINDOW = 256  # bytes
WIDTHS = (2, 3, 4)  # bytes that a filter sees
FILTERS = 16  # of each width
EMBEDDING = 8  # dimensions of a byte
BATCH = 64  # windows


@dataclass
class Network:
    """Embedded bytes, one linear filter bank (narrow filters are zero beyond their width), max over positions, softmax."""

    languages: list[str]
    embedding: np.ndarray  # 256 x EMBEDDING
    filters: np.ndarray  # widest * EMBEDDING x filters
    bias: np.ndarray
    out: np.ndarray  # filters x languages
    out_bias: np.ndarray

    def columns(self, windows: np.ndarray) -> np.ndarray:
        x = self.embedding[windows]
        return np.concatenate([x[:, k:x.shape[1] - max(WIDTHS) + 1 + k] for k in range(max(WIDTHS))], axis=2)

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """Max over all positions; bias and rectifier do not change the order, so they follow."""
        columns = self.columns(windows)
        raw = columns.reshape(-1, columns.shape[2]) @ self.filters
        return np.maximum(raw.reshape(*columns.shape[:2], -1).max(axis=1) + self.bias, 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        return softmax(self.pooled(windows) @ self.out + self.out_bias)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(text: str | None) -> np.ndarray:
    """All bytes of the text in consecutive windows, the last one filled up with zero bytes; at least one window."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    n = max(1, -(-len(raw) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[:len(raw)] = raw
    return out.reshape(n, WINDOW)


def fit(windows: np.ndarray, labels: list[str], epochs: int = 12, rate: float = 0.01, seed: int = 7, steps: int = 1500) -> Network | None:
    """Adam on the cross entropy, classes weighted alike; at most `steps` batches. None without labelled windows."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    y = np.searchsorted(np.array(languages), labels)
    weight = (1 / np.bincount(y))[y] * len(y) / len(languages)
    shape = (max(WIDTHS) * EMBEDDING, FILTERS * len(WIDTHS))
    mask = np.zeros(shape, np.float32)
    for i, width in enumerate(WIDTHS):
        mask[:width * EMBEDDING, i * FILTERS:(i + 1) * FILTERS] = 1
    net = Network(languages, *(a.astype(np.float32) for a in (
        rng.normal(0, 0.5, (256, EMBEDDING)), rng.normal(0, 0.3, shape) * mask, np.zeros(shape[1]), rng.normal(0, 0.2, (shape[1], len(languages))),
        np.zeros(len(languages)))))
    parts = [net.embedding, net.filters, net.bias, net.out, net.out_bias]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    done = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            if done == steps:
                return net
            done += 1
            pick = order[at:at + BATCH]
            for p, g, m, v in zip(parts, _gradients(net, windows[pick], y[pick], weight[pick], mask), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9 ** done)) / (np.sqrt(v / (1 - 0.99 ** done)) + 1e-8)
    return net


def _gradients(net: Network, windows: np.ndarray, y: np.ndarray, weight: np.ndarray, mask: np.ndarray) -> list[np.ndarray]:
    n, f = len(y), net.filters.shape[1]
    columns = net.columns(windows)
    raw = (columns.reshape(-1, columns.shape[2]) @ net.filters).reshape(n, -1, f)
    best = raw.argmax(axis=1)
    hidden = np.maximum(np.take_along_axis(raw, best[:, None], 1)[:, 0] + net.bias, 0)
    error = softmax(hidden @ net.out + net.out_bias)
    error[np.arange(n), y] -= 1
    error *= (weight / n)[:, None].astype(np.float32)
    back = (error @ net.out.T) * (hidden > 0)
    seen = columns[np.arange(n)[:, None], best]
    to_input = (back[:, :, None] * net.filters.T[None]).reshape(n, f, max(WIDTHS), EMBEDDING)
    embedding = np.zeros_like(net.embedding)
    where = windows[np.arange(n)[:, None, None], best[:, :, None] + np.arange(max(WIDTHS))]
    np.add.at(embedding, where, to_input)
    return [embedding, np.einsum("bfk,bf->kf", seen, back) * mask, back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]


def predict(net: Network, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Most probable language and its probability: the mean over all windows of a text, weighted by bytes that are letters."""
    windows = [windows_of(t) for t in texts]
    counts = np.array([len(w) for w in windows])
    owner, rows = np.repeat(np.arange(len(texts)), counts), np.concatenate(windows)
    total, mass = np.zeros((len(texts), len(net.languages))), np.zeros(len(texts))
    for at in range(0, len(rows), BATCH):
        part, whose = rows[at:at + BATCH], owner[at:at + BATCH]
        lower = part | 32
        letters = (((lower >= 97) & (lower <= 122)) | (part >= 128)).sum(axis=1) + 1e-3
        np.add.at(total, whose, net.probabilities(part) * letters[:, None])
        np.add.at(mass, whose, letters)
    share = total / mass[:, None]
    best = share.argmax(axis=1)
    return [net.languages[b] for b in best], np.clip(np.round(share[np.arange(len(texts)), best], 6), 0, 1).tolist()


def sample_windows(labelled: DataFrame, key: Column, lang_column: str, text_column: str, sample: int, each: int) -> tuple[np.ndarray, list[str]]:
    """Up to `each` evenly spread windows of at most `sample` labelled rows, as many of each language as there are.

    What is sampled are distinct pairs of key and text, known by their hash: rows that repeat, or share a key or have
    none, are told apart by their text. The number of distinct pairs of a language (a sketch) thins it to about twice the
    sample before anything is sorted; the rows are then those first in the hash, by language and then overall. Only the
    `sample` languages with most of them take part. The driver gets at most sample x each x WINDOW bytes.
    """
    known = labelled.where(F.col(lang_column).isNotNull()).select(
        F.xxhash64(key, F.coalesce(F.col(text_column), F.lit(""))).alias("_h"), F.col(lang_column).alias("_lang"), F.col(text_column).alias("_text"))
    slim = known.select("_h", "_lang")
    share = slim.groupBy(F.col("_lang").alias("_l")).agg(F.approx_count_distinct("_h", 0.02).alias("_n")).orderBy(F.desc("_n"), "_l").limit(sample)
    low = F.pmod("_h", F.lit(1 << 20)) * F.col("_n") <= F.lit(2 * sample << 20)
    thinned = slim.join(F.broadcast(share), F.col("_lang") == F.col("_l")).where(low).select("_h", "_lang").distinct()
    ranked = thinned.withColumn("_r", F.row_number().over(Window.partitionBy("_lang").orderBy("_h"))).where(F.col("_r") <= sample)
    chosen = ranked.orderBy("_r", "_h", "_lang").limit(sample).select(F.col("_h").alias("_k"), F.col("_lang").alias("_l"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for h, lang, text in zip(b["_h"], b["_lang"], b["_text"], strict=True):
                w = windows_of(text)
                picks = sorted({round(i) for i in np.linspace(0, len(w) - 1, each)})
                out += [(h, i, lang, w[i].tobytes()) for i in picks if any(c.isalpha() for c in text or "")]
            yield pd.DataFrame(out, columns=["h", "i", "lang", "bytes"])

    rows = (
        known.join(F.broadcast(chosen), (F.col("_h") == F.col("_k")) & (F.col("_lang") == F.col("_l"))).select("_h", "_lang", "_text")
        .mapInPandas(cut, "h long, i int, lang string, bytes binary").distinct().orderBy("h", "i", "lang", "bytes").limit(sample * each).collect())
    return np.array([np.frombuffer(r.bytes, np.uint8) for r in rows]).reshape(len(rows), WINDOW), [r.lang for r in rows]


def train(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", sample: int = 1200,
          each: int = 4) -> Network | None:
    """The network, from text and language of at most `sample` rows that are not held out, of each up to `each` windows."""
    key = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return fit(*sample_windows(docs.where(~held_out(F.col(id_column))), key, lang_column, text_column, sample, each))


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: the CRC-32 of the id, as text, leaves 2 by 4. Rows without an id are not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def answer(net: Network | None, text: Column) -> Column:
    """Struct `lang, score` of a text column, all of each text read; `und` and 0 for null, without a letter or a network."""
    unknown = F.struct(F.lit(UNDETERMINED).alias("lang"), F.lit(0.0).alias("score"))
    if net is None:
        return unknown

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            langs, scores = predict(net, texts.tolist()) if len(texts) else ([], [])
            yield pd.DataFrame({"lang": langs, "score": scores})

    result = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
    return F.when(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), F.pandas_udf(run, result)(text)).otherwise(unknown)


def identify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", sample: int = 1200,
             each: int = 4) -> DataFrame:
    """`id, held_out, lang_pred, score` of every row; no other column of docs is read.

    Prediction sees the text alone. `und` and score 0 where the text is null or holds no letter, or where nothing could
    be learned. Rows that repeat get the same answer. An empty table gives an empty result.
    """
    net = train(docs, id_column, text_column, lang_column, sample, each)
    rows = docs.select(F.col(id_column), held_out(F.col(id_column)).alias("held_out"), answer(net, F.col(text_column)).alias("_answer"))
    return rows.select(id_column, "held_out", F.col("_answer.lang").alias("lang_pred"), F.col("_answer.score").alias("score"))
