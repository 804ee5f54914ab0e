"""Substring dedup: paragraph MinHash banding, exact Jaccard of colliding paragraphs, removals clustered by components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayer.llm.decontaminate import WORD_BYTES
from assayer.llm.shared import components, each_group, local_roots, slices, store, tile_pairs

SHINGLE = 5  # words
ROWS = 4  # hash minima of a band
RECALL = 0.995  # of pairs at the threshold itself
TILE = 512  # paragraphs; a task compares at most two tiles
# Runs of equal words: PASSAGE words from each place whose hash of ANCHOR words is the least of REACH in a row (a MinHash band of
# one row). Of any PASSAGE + REACH + ANCHOR - 2 = 50 equal words, at least one such passage is equal as well.
PASSAGE, ANCHOR, REACH = 20, 4, 28
RUN = 51  # words: repeats of over 50 words count
AROUND = RUN - PASSAGE  # words on each side that decide whether a passage is part of an equal run
GROUP = 65_536  # surroundings of one passage that a task compares at once (about 40 MB); those of a more frequent one meet by a shuffle
SEED = 5


def bands(threshold: float, rows: int = ROWS, recall: float = RECALL) -> int:
    """Least number of bands with which a pair at the threshold collides with at least the wanted probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([SEED, seed]).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread all bits of a sum of products over the word, so that comparing sizes is as good as chance."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def rolling(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over each `width` values in a row, by doubling."""
    done, reach = x, 1
    while reach < width:
        step = min(reach, width - reach)
        done = pick(done[:len(done) - step], done[step:])
        reach += step
    return done


def blocks(counts: np.ndarray, owner: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of each paragraph of at least `least` words: a line that long, or shorter ones in a row until they are."""
    first, last, begun, total = [], [], -1, 0
    for i, n in enumerate(counts.tolist()):
        if begun >= 0 and (owner[i] != owner[begun] or n >= least):
            begun, total = -1, 0
        begun, total = (i, n) if begun < 0 else (begun, total + n)
        if total >= least:
            first.append(begun)
            last.append(i)
            begun, total = -1, 0
    return np.array(first, np.int64), np.array(last, np.int64)


class Units:
    """The paragraphs of a batch of texts that have at least `least` words, as hashes of words and of shingles.

    With `least` None each text with a word is one unit; one of under five words has a single shingle, all its words.
    `all_words`, `text_starts`, `text_counts`: the word hashes of whole texts, whatever their lines; `line_words`: where lines begin.
    """

    def __init__(self, texts: list[bytes | None], least: int | None):
        owner, place, lines = [], [], []
        for i, text in enumerate(texts):
            for k, line in enumerate((text or b"").split(b"\n") if least else [text or b""]):
                if line:
                    owner.append(i)
                    place.append(k)
                    lines.append(line.translate(WORD_BYTES).strip())
        words = pc.ascii_split_whitespace(pa.array(lines, pa.large_binary()).cast(pa.large_string()))
        counts = np.array([n if line else 0 for n, line in zip(pc.list_value_length(words).to_pylist(), lines, strict=True)], np.int64)
        enough = counts > 0
        words = words.filter(pa.array(enough))
        owner, place, counts = np.array(owner, np.int64)[enough], np.array(place, np.int32)[enough], counts[enough]
        coded = pc.list_flatten(words).dictionary_encode()
        known = np.fromiter((xxhash.xxh64_intdigest(w.encode()) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        self.all_words = known[coded.indices.to_numpy()]
        self.text_counts = np.bincount(owner, counts, minlength=len(texts)).astype(np.int64)
        self.text_starts = np.cumsum(self.text_counts) - self.text_counts
        begins = np.cumsum(counts) - counts
        self.line_owner, self.line_place, self.line_words = owner, place, begins - self.text_starts[owner]
        first, last = blocks(counts, owner, least) if least else (np.arange(len(counts)), np.arange(len(counts)))
        self.owner, self.place, self.last_place = owner[first], place[first], place[last]
        self.start = (begins[first] - self.text_starts[owner[first]]).astype(np.int32)
        self.counts = begins[last] + counts[last] - begins[first]
        self.starts = np.cumsum(self.counts) - self.counts
        self.words = self.all_words[np.arange(self.counts.sum()) + np.repeat(begins[first] - self.starts, self.counts)]
        n = max(0, len(self.words) - SHINGLE + 1)
        sums = np.zeros(n, np.uint64)
        for k, factor in enumerate(odd_numbers(SHINGLE, 1)):
            sums += self.words[k:k + n] * factor
        self.sizes = np.maximum(1, self.counts - SHINGLE + 1)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        at = np.arange(self.sizes.sum()) + np.repeat(self.starts - self.offsets, self.sizes)  # shingles that do not run into the next paragraph
        self.shingles = mixed(np.concatenate([sums, np.zeros(SHINGLE, np.uint64)]))[at]
        few = self.counts < SHINGLE
        self.shingles[self.offsets[few]] = self.names()[0].view(np.uint64)[few]

    def names(self) -> list[np.ndarray]:
        """128 bits of each paragraph's words in order, as two columns."""
        at = np.arange(len(self.words)) - np.repeat(self.starts, self.counts)
        out = []
        for seed in (2, 3):
            weights = mixed((at.astype(np.uint64) + np.uint64(1)) * odd_numbers(1, seed)[0]) | np.uint64(1)
            sums = np.add.reduceat(mixed(self.words * odd_numbers(1, seed + 10)[0]) * weights, self.starts) if len(self.starts) else np.zeros(0, np.uint64)
            out.append(mixed(sums + self.counts.astype(np.uint64)).view(np.int64))
        return out

    def keys(self, n_bands: int, rows: int) -> np.ndarray:
        """One number per paragraph and band, made from the band and its minima."""
        out = np.zeros((len(self.starts), n_bands), np.uint64)
        if not len(self.starts):
            return out.view(np.int64)
        factors, adds, joins = odd_numbers(n_bands * rows, 4), odd_numbers(n_bands * rows, 6), odd_numbers(n_bands * rows, 7)
        for b in range(n_bands):
            total = np.full(len(self.starts), b + 1, np.uint64) * joins[b]
            for k in range(b * rows, (b + 1) * rows):
                least = np.minimum.reduceat(mixed(self.shingles * factors[k] + adds[k]), self.offsets)
                total = mixed(total + least * joins[k])
            out[:, b] = total
        return out.view(np.int64)

    def passages(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Text and hash of each passage, and the words at which it starts in the text; equal ones of a text are together."""
        n = len(self.all_words) - PASSAGE + 1
        if n < REACH:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), []
        marks = np.zeros(n, np.uint64)
        for k, factor in enumerate(odd_numbers(ANCHOR, 8)):
            marks += self.all_words[k:k + n] * factor
        marks = mixed(marks)
        least = rolling(marks, REACH, np.minimum)  # of the places i to i + REACH - 1
        most = rolling(np.concatenate([np.zeros(REACH - 1, np.uint64), least, np.zeros(REACH - 1, np.uint64)]), REACH, np.maximum)
        at = np.flatnonzero(marks == most)
        text = np.searchsorted(self.text_starts, at, "right") - 1
        start = at - self.text_starts[text]
        inside = (start + PASSAGE <= self.text_counts[text]) & (self.text_counts[text] >= RUN)
        at, text, start = at[inside], text[inside], start[inside]
        keys = self.passage_keys(at)
        order = np.lexsort((start, keys, text))
        text, keys, start = text[order], keys[order], start[order].astype(np.int32)
        new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (keys[1:] != keys[:-1])])) if len(order) else np.zeros(0, np.int64)
        return text[new], keys[new], np.split(start, new[1:]) if len(new) else []

    def passage_keys(self, at: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(at), np.uint64)
        for k, factor in enumerate(odd_numbers(PASSAGE, 9)):
            sums += mixed(self.all_words[at + k]) * factor
        return mixed(sums).view(np.int64)

    def spans(self, at: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """128 bits of the `lengths` words from each place of the batch, as two columns."""
        out = []
        for seed in (12, 13):
            coded, sums = mixed(self.all_words * odd_numbers(1, seed)[0]), np.zeros(len(at), np.uint64)
            for k, factor in enumerate(odd_numbers(int(lengths.max(initial=0)), seed + 10)):
                inside = k < lengths
                sums[inside] += coded[at[inside] + k] * factor
            out.append(mixed(sums + lengths.astype(np.uint64)).view(np.int64))
        return out

    def set_of(self, i: int) -> np.ndarray:
        return np.unique(self.shingles[self.offsets[i]:self.offsets[i] + self.sizes[i]])


UNITS = "id long, th long, place int, last_place int, start int, n_words int, c1 long, c2 long, keys array<long>, starts array<int>"
SETS = "c1 long, c2 long, shingles array<long>"
NAMES = ["id", "th", "place", "last_place", "start", "n_words", "c1", "c2", "keys", "starts"]


def _texts(part: pa.RecordBatch) -> list[bytes | None]:
    return part.column("text").cast(pa.binary()).to_pylist()


def _units(least: int | None, n_bands: int, rows: int):
    """Paragraphs with the keys of their bands; with `least` also passages, whose hash is c1 and which have starts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, "text")):
            u = Units(_texts(part), least)
            owner = pa.array(u.owner)
            c1, c2 = u.names()
            keys = u.keys(n_bands, rows)
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(owner), part.column("th").take(owner), pa.array(u.place, pa.int32()), pa.array(u.last_place, pa.int32()),
                 pa.array(u.start), pa.array(u.counts.astype(np.int32)), pa.array(c1), pa.array(c2),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * n_bands), pa.array(keys.ravel())), pa.nulls(len(owner), pa.list_(pa.int32()))], NAMES)
            if least is None:
                continue
            text, key, starts = u.passages()
            owner, none = pa.array(text), pa.nulls(len(text), pa.int32())
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in starts])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(owner), part.column("th").take(owner), none, none, none, none, pa.array(key), none.cast(pa.int64()),
                 pa.nulls(len(owner), pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(starts) if starts else np.zeros(0, np.int32)))], NAMES)
    return run


def _sets(least: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("c1", pa.int64()), ("c2", pa.int64()), ("shingles", pa.list_(pa.int64()))])
        for part in (p for batch in batches for p in slices(batch, "text")):
            u = Units(_texts(part), least)
            c1, c2 = u.names()
            asked = [set(x) for x in part.column("places").to_pylist()]
            out = [{"c1": int(c1[i]), "c2": int(c2[i]), "shingles": u.set_of(i).view(np.int64)}
                   for i in range(len(u.owner)) if int(u.place[i]) in asked[u.owner[i]]]
            yield pa.RecordBatch.from_pylist(out, schema)
    return run


CONTEXTS = "t1 long, t2 long, key long, c1 long, c2 long, s int, left int, right int, lines array<int>"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each wanted passage with the hash of its words and the AROUND words on both sides; and per text where its lines begin."""
    names = ["t1", "t2", "key", "c1", "c2", "s", "left", "right", "lines"]
    for part in (p for batch in batches for p in slices(batch, "text")):
        u = Units(_texts(part), 1)
        asked = [np.unique(np.array([k for k in x if k + PASSAGE <= n], np.int64)) for x, n in zip(part.column("starts").to_pylist(), u.text_counts.tolist(), strict=True)]
        text, s = np.repeat(np.arange(len(asked)), [len(x) for x in asked]), np.concatenate(asked)
        left, right = np.minimum(s, AROUND), np.minimum(u.text_counts[text] - s - PASSAGE, AROUND)
        c1, c2 = u.spans(u.text_starts[text] + s - left, left + PASSAGE + right)
        # where in the context the passage stands is part of its name
        c1 = mixed(c1.view(np.uint64) + left.astype(np.uint64)).view(np.int64)
        t1, t2, whose = part.column("th"), part.column("t2"), pa.array(text)
        yield pa.RecordBatch.from_arrays(
            [t1.take(whose), t2.take(whose), pa.array(u.passage_keys(u.text_starts[text] + s)), pa.array(c1), pa.array(c2), pa.array(s.astype(np.int32)), pa.array(left.astype(np.int32)),
             pa.array(right.astype(np.int32)), pa.nulls(len(s), pa.list_(pa.int32()))], names)
        lines = [np.zeros(0, np.int32)] * part.num_rows
        for i in range(part.num_rows):
            mine = u.line_owner == i
            begins = np.zeros(int(u.line_place[mine].max(initial=0)) + 1, np.int32)
            begins[u.line_place[mine]] = u.line_words[mine]
            lines[i] = np.maximum.accumulate(begins)
        none = pa.nulls(part.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([t1, t2, none, none, none, *[none.cast(pa.int32())] * 3, pa.array([x.tolist() for x in lines], pa.list_(pa.int32()))], names)


CHAINS = "key long, id long, most long, t1 long, t2 long, s int, words binary"


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The AROUND words before and after each wanted passage, the nearest first, as 32 bits each; 0 where the text ends."""
    names = ["key", "id", "most", "t1", "t2", "s", "words"]
    for part in (p for batch in batches for p in slices(batch, "text")):
        u = Units(_texts(part), 1)
        rows = [(i, x["id"], x["most"], x["s"]) for i, xs in enumerate(part.column("reps").to_pylist()) for x in xs]
        text, ids, most, s = (np.array(c, np.int64) for c in zip(*rows, strict=True))
        at, begin, end = u.text_starts[text] + s, u.text_starts[text], u.text_starts[text] + u.text_counts[text]
        steps = np.arange(AROUND)
        places = np.hstack([at[:, None] - 1 - steps, at[:, None] + PASSAGE + steps])
        inside = (places >= begin[:, None]) & (places < end[:, None])
        words = np.where(inside, (u.all_words[np.where(inside, places, 0)] >> np.uint64(32)) | np.uint64(1), np.uint64(0)).astype(np.uint32)
        whose = pa.array(text)
        flat = pa.py_buffer(np.ascontiguousarray(words))
        offsets = pa.py_buffer((np.arange(len(s) + 1) * 8 * AROUND).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(u.passage_keys(at)), pa.array(ids), pa.array(most), part.column("th").take(whose), part.column("t2").take(whose), pa.array(s.astype(np.int32)),
             pa.BinaryArray.from_buffers(pa.binary(), len(s), [None, offsets, flat])], names)


def run_names(group: pa.RecordBatch | pa.Table) -> np.ndarray:
    """Names of the runs of RUN words that hold each passage, by the number of words before it; 0 where the text has none."""
    n = len(group["key"])
    words = np.frombuffer(b"".join(group["words"].to_pylist()), np.uint32).reshape(n, 2, AROUND)
    sides = []
    for side, factor in enumerate(odd_numbers(2, 14)):
        now = [np.asarray(group["key"]).view(np.uint64)]
        for k in range(AROUND):
            word = words[:, side, k].astype(np.uint64)
            now.append(np.where((word == 0) | (now[-1] == 0), np.uint64(0), mixed(now[-1] * factor + word) | np.uint64(1)))
        sides.append(now)
    both = [np.where((x == 0) | (y == 0), np.uint64(0), mixed(x + mixed(y)) | np.uint64(1)) for x, y in zip(sides[0], reversed(sides[1]), strict=True)]
    return np.stack(both, axis=1)


HITS = "t1 long, t2 long, s int, before int, behind int, b1 long, b2 long, bs int"


def compare_contexts(group: pa.Table) -> pa.Table:
    """Of passages with equal keys, those in a run of RUN words which another document holds: how far such runs reach before
    and behind them, and a passage that stands for all they are linked with. Any number of whole groups at once."""
    n, names = len(group), run_names(group)
    low, high = group["id"].to_numpy(), group["most"].to_numpy()
    before, behind, firsts = np.full(n, -1, np.int32), np.full(n, -1, np.int32), []
    for l in range(AROUND + 1):
        order = np.argsort(names[:, l], kind="stable")
        order = order[np.searchsorted(names[order, l], 1):]
        if not len(order):
            continue
        ranked = names[order, l]
        starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        sizes = np.diff(np.append(starts, len(order)))
        shared = np.repeat(np.minimum.reduceat(low[order], starts) != np.maximum.reduceat(high[order], starts), sizes)
        members, first = order[shared], np.repeat(order[starts], sizes)[shared]
        before[members] = np.maximum(before[members], l)
        behind[members] = np.maximum(behind[members], AROUND - l)
        firsts.append((members, first))
    root, last = np.arange(n), None
    while firsts and (last is None or (root != last).any()):
        last = root.copy()
        for members, first in firsts:
            np.minimum.at(root, first, root[members])
            root[members] = np.minimum(root[members], root[first])
    hit = before >= 0
    out = {c: group[c].combine_chunks().filter(pa.array(hit)) for c in ("t1", "t2", "s")}
    by = group.take(pa.array(root[hit]))
    return pa.table({**out, "before": pa.array(before[hit]), "behind": pa.array(behind[hit]), "b1": by["t1"], "b2": by["t2"], "bs": by["s"]})


def whole_groups(df: DataFrame, key: str, work, schema: str) -> DataFrame:
    """work on tables of one or more whole groups of rows with an equal key, about a batch at a time. Groups have to be bounded."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            marks = batch.column(key).to_numpy(zero_copy_only=False)
            if len(marks) and rest and marks[0] != rest[-1].column(key)[-1].as_py():
                yield from work(pa.Table.from_batches(rest)).to_batches()
                rest = []
            cut = np.flatnonzero(marks[1:] != marks[:-1])
            cut = int(cut[-1]) + 1 if len(cut) else 0
            if cut:
                yield from work(pa.Table.from_batches([*rest, batch.slice(0, cut)])).to_batches()
                rest = []
            if batch.num_rows > cut:
                rest.append(batch.slice(cut))
        if rest:
            yield from work(pa.Table.from_batches(rest)).to_batches()
    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The names of `run_names`, one per row."""
    columns = ["t1", "t2", "s", "id", "most"]
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            names = run_names(part)
            i, l = np.nonzero(names)
            yield pa.RecordBatch.from_arrays([*[part.column(c).take(pa.array(i)) for c in columns], pa.array(l.astype(np.int32)), pa.array(names[i, l].view(np.int64))], [*columns, "l", "h"])


def _hot_contexts(chains: DataFrame) -> DataFrame:
    """What `compare_contexts` tells, for groups of any size: runs with one name meet in a combined aggregate."""
    every = store(chains.mapInArrow(_windows, "t1 long, t2 long, s int, id long, most long, l int, h long"), "windows")
    held = every.groupBy("h").agg(F.min(F.struct("id", "t1", "t2", "s")).alias("by"), F.max("most").alias("_most")).where("by.id <> _most").select("h", "by")
    return every.join(held, "h").groupBy("t1", "t2", "s", F.col("by.t1").alias("b1"), F.col("by.t2").alias("b2"), F.col("by.s").alias("bs")).agg(
        F.max("l").alias("before"), F.max(AROUND - F.col("l")).alias("behind")).select("t1", "t2", "s", "before", "behind", "b1", "b2", "bs")


def link_tile(threshold: float):
    """Links among the paragraphs of a tile pair, as stars: Jaccard of the shingle sets, exact."""
    def work(group: pa.Table) -> pa.Table:
        sets = group["shingles"].combine_chunks()
        c1, c2 = group["c1"].to_numpy(), group["c2"].to_numpy()
        sizes = pc.list_value_length(sets).to_numpy().astype(np.int64)
        flat = sets.flatten().to_numpy().view(np.uint64)
        offsets = np.cumsum(sizes) - sizes

        def linked(k: int, rest: np.ndarray) -> np.ndarray:
            own = flat[offsets[k]:offsets[k] + sizes[k]]
            at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            common = np.add.reduceat((own[at] == flat).astype(np.int64), offsets)[rest]
            return common >= threshold * (sizes[k] + sizes[rest] - common)

        root = local_roots(len(sizes), linked) if len(sizes) > 1 else np.zeros(len(sizes), np.int64)
        tied = root != np.arange(len(sizes))
        return pa.table({"a1": c1[tied], "a2": c2[tied], "b1": c1[root[tied]], "b2": c2[root[tied]]})
    return work


LAST = (1 << 63) - 1  # stands for a missing id, which comes after all others


def _first() -> Column:
    return F.struct(F.col("id").isNull().alias("no_id"), "id", "place", "th")


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column), F.lit(""))
    return docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("th"), F.xxhash64(F.lit(8), text).alias("t2"), text.alias("text"))


def _candidates(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct units `c1, c2, first, n`, and those that collide in a band, `c1, c2, key`; both stored."""
    classes = store(units.groupBy("c1", "c2").agg(
        F.first("keys").alias("keys"), F.min(_first()).alias("first"), F.count(F.lit(1)).alias("n")), "classes")
    buckets = classes.select("c1", "c2", F.explode("keys").alias("key"))
    shared = store(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("key").alias("_key")), "shared")
    return classes, store(buckets.join(shared, F.col("key") == F.col("_key")).drop("_key"), "colliding")


def _wanted(classes: DataFrame, colliding: DataFrame) -> DataFrame:
    """`_id, _th, place` of a text that holds each colliding unit."""
    return classes.join(colliding.select("c1", "c2").distinct(), ["c1", "c2"]).select(
        F.col("first.id").alias("_id"), F.col("first.th").alias("_th"), F.col("first.place").alias("place"))


def _fetched(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    return rows.join(wanted, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).drop("_id", "_th")


def _linked(classes: DataFrame, colliding: DataFrame, texts: DataFrame, threshold: float, least: int | None) -> DataFrame:
    """`c1, c2, root, first, n_paragraphs` of the names of all units in a component of two or more, stored.

    texts: those that hold a colliding unit, with its places.
    """
    members = colliding.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("c1", "c2")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "c1", "c2")).alias("y"))
    distinct = members.groupBy("n", "x", "y").agg(F.min("key").alias("_key")).select("_key")
    tiles = store(tile_pairs(colliding.join(distinct, F.col("key") == F.col("_key")).drop("_key"), ["key"], ["c1", "c2"], TILE), "tiles")
    sets = store(texts.select("text", "places").mapInArrow(_sets(least), SETS).dropDuplicates(["c1", "c2"]), "shingles")
    told = each_group(
        tiles.join(sets, ["c1", "c2"]).select("key", "_i", "_j", "c1", "c2", "shingles"), ["key", "_i", "_j"], link_tile(threshold),
        "a1 long, a2 long, b1 long, b2 long")
    roots = components(told.select(F.struct(F.col("a1").alias("c1"), F.col("a2").alias("c2")).alias("a"),
                                   F.struct(F.col("b1").alias("c1"), F.col("b2").alias("c2")).alias("b")))
    named = classes.select("c1", "c2", "first", "n").join(
        roots.select(F.col("node.c1").alias("_c1"), F.col("node.c2").alias("_c2"), "component"), (F.col("c1") == F.col("_c1")) & (F.col("c2") == F.col("_c2")), "left")
    named = named.select("c1", "c2", "first", "n", F.coalesce("component", F.struct("c1", "c2")).alias("root"))
    whole = named.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("n_paragraphs")).where("n_paragraphs > 1")
    return store(named.select("c1", "c2", "root").join(whole, "root"), "repeated")


def near_copies(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9999, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`id, th` (hash of the text) of all rows with a near copy that comes before them.

    Texts link where the Jaccard similarity of their sets of five-word shingles is at least the threshold, which is
    exact for all that collide in a band; bands are as many as the recall at the threshold asks for. The first row of
    a component (smallest id, those without an id last, then th) is not listed. Texts without a word have no copies.
    """
    rows = _rows(docs, id_column, text_column)
    units = store(rows.mapInArrow(_units(None, bands(threshold, recall=recall), ROWS), UNITS), "texts")
    classes, colliding = _candidates(units)
    wanted = _wanted(classes, colliding).groupBy("_id", "_th").agg(F.collect_set("place").alias("places"))
    lookup = _linked(classes, colliding, _fetched(rows, wanted), threshold, None)
    return units.drop("keys").join(lookup, ["c1", "c2"]).where(~_first().eqNullSafe(F.col("first"))).select("id", "th").distinct()


def _equal_runs(texts: DataFrame, holders: DataFrame, id_column: str) -> DataFrame:
    """Rows like those of `repeated` for runs of at least RUN equal words in several documents.

    texts: one row `th, t2, text, starts, least, most` per distinct text, starts of its shared passages, least and most
    of its ids; holders: `th, t2, id` of all rows.

    A passage and the words around it are one class, named by 128 bits; a class in two documents is a run by itself. If a
    passage has more than one class, the first of each is compared with the others: for each number of words before the
    passage, the RUN words that begin there are named by them (64 bits, of the key and 32 bits of each word around it).
    What two documents name alike is a run.
    """
    every = store(texts.select("th", "t2", "text", "starts").mapInArrow(_contexts, CONTEXTS), "contexts")
    ends = texts.select(F.col("th").alias("t1"), "t2", "least", "most").dropDuplicates(["t1", "t2"])
    places = every.where("key is not null").drop("lines").join(ends, ["t1", "t2"])
    classes = store(places.groupBy("key", "c1", "c2").agg(
        F.min(F.struct(F.col("least").alias("id"), "t1", "t2", "s")).alias("first"), F.max("most").alias("most"), F.first("left").alias("left"), F.first("right").alias("right")), "classes")
    several = store(classes.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "several")

    def chains(wanted: DataFrame) -> DataFrame:
        reps = classes.join(wanted.select("key"), "key").groupBy(F.col("first.t1").alias("_t1"), F.col("first.t2").alias("_t2")).agg(
            F.collect_list(F.struct(F.col("first.id").alias("id"), "most", F.col("first.s").alias("s"))).alias("reps"))
        return texts.select("th", "t2", "text").join(reps, (F.col("th") == F.col("_t1")) & (F.col("t2") == F.col("_t2"))).select(
            "th", "t2", "text", "reps").mapInArrow(_chains, CHAINS)

    hits = store(whole_groups(chains(several.where(F.col("_n") <= GROUP)), "key", compare_contexts, HITS).unionByName(
        _hot_contexts(chains(several.where(F.col("_n") > GROUP)))), "hits")
    reach = hits.groupBy(*[F.col(c).alias(f"_{c}") for c in ("t1", "t2", "s")]).agg(F.max("before").alias("before"), F.max("behind").alias("behind"))
    own = F.col("first.id") != F.col("most")
    same = (F.col("first.t1") == F.col("_t1")) & (F.col("first.t2") == F.col("_t2")) & (F.col("first.s") == F.col("_s"))
    covers = store(classes.join(reach, same, "left").where(own | F.col("before").isNotNull()).select(
        "key", "c1", "c2", "first", F.when(own, F.col("left")).otherwise(F.col("before")).alias("before"),
        (F.when(own, F.col("right")).otherwise(F.col("behind")) + PASSAGE).alias("after")), "covers")
    pieces = places.join(covers, ["key", "c1", "c2"]).select("t1", "t2", "s", "first", (F.col("s") - F.col("before")).alias("a"), (F.col("s") + F.col("after")).alias("b"))
    text = Window.partitionBy("t1", "t2").orderBy("a", "b", "s")
    reached = F.max("b").over(text.rowsBetween(Window.unboundedPreceding, -1))
    islands = pieces.withColumn("_new", F.coalesce(F.col("a") > reached, F.lit(True)).cast("int")).withColumn("_span", F.sum("_new").over(text.rowsBetween(Window.unboundedPreceding, 0)))
    spanned = store(islands.withColumns({c: f.over(Window.partitionBy("t1", "t2", "_span")) for c, f in (("a", F.min("a")), ("b", F.max("b")))}).select("t1", "t2", "s", "a", "b", "first"), "spans")
    place = spanned.select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), F.col("s").alias("_s"), F.struct("t1", "t2", "a").alias("node"))
    links = spanned.select(F.struct("t1", "t2", "a").alias("a"), F.struct("first.t1", "first.t2", "first.s").alias("to")).union(
        hits.select("t1", "t2", "s", F.struct(F.col("b1").alias("t1"), F.col("b2").alias("t2"), F.col("bs").alias("s")).alias("to")).join(
            place, (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2")) & (F.col("s") == F.col("_s"))).select(F.col("node").alias("a"), "to")).distinct()
    edges = links.join(place, (F.col("to.t1") == F.col("_t1")) & (F.col("to.t2") == F.col("_t2")) & (F.col("to.s") == F.col("_s"))).select("a", F.col("node").alias("b")).distinct()
    roots = components(edges).select(F.col("node.t1").alias("_t1"), F.col("node.t2").alias("_t2"), F.col("node.a").alias("_a"), F.col("component").alias("_root"))
    spans = spanned.select("t1", "t2", "a", "b").distinct().join(roots, (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2")) & (F.col("a") == F.col("_a")), "left").select(
        "t1", "t2", "a", "b", F.coalesce("_root", F.struct("t1", "t2", "a")).alias("root"))
    lines = every.where("lines is not null").select("t1", "t2", "lines").dropDuplicates(["t1", "t2"])
    line = lambda c: (F.size(F.filter("lines", lambda x: x <= F.col(c))) - 1).cast("int")
    told = spans.join(lines, ["t1", "t2"]).withColumn("_last", F.col("b") - 1).select("t1", "t2", "a", "b", "root", line("a").alias("place"), line("_last").alias("last_place"))
    rows = store(holders.select(F.col("th").alias("t1"), "t2", "id").join(told, ["t1", "t2"]), "holders")
    whole = rows.groupBy("root").agg(
        F.min(F.struct("id", "a", "place", "t1", "t2")).alias("first"), F.count(F.lit(1)).alias("n_paragraphs"), F.count_distinct("id").alias("n_documents"))
    own = (F.col("id") == F.col("first.id")) & (F.col("a") == F.col("first.a")) & (F.col("t1") == F.col("first.t1")) & (F.col("t2") == F.col("first.t2"))
    return rows.join(whole, "root").select(
        F.nullif("id", F.lit(LAST)).alias(id_column), "place", "last_place", F.lit("passage").alias("kind"), F.col("a").alias("start"), F.col("b").alias("end"),
        F.nullif("first.id", F.lit(LAST)).alias("component_id"), F.col("first.place").alias("component_place"), "n_paragraphs", "n_documents", own.alias("kept"))


def repeated(docs: DataFrame, threshold: float = 0.8, least_words: int = 25, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`id, place, last_place, kind, start, end, component_id, component_place, n_paragraphs, n_documents, kept` of all repeats.

    Kind `paragraph`: a line with at least `least_words` words (digits, A-Z as a-z, other letters), or shorter lines in a
    row until they have as many. Paragraphs link where the Jaccard similarity of their sets of five-word shingles is at
    least the threshold and they collide in a band; bands are as many as the recall at the threshold asks for. A
    component is a set of paragraphs reachable by links, named by its first one: smallest id (those without an id come
    last), then place. That one is kept. Components of one paragraph are not listed.

    Kind `passage`: a text may repeat only in part, or wrapped otherwise. The words of the whole text, whatever its
    lines, are therefore also cut at minima of word hashes into passages of 20 words: 51 equal words hold at least one
    equal passage. Around passages of several documents all that belongs to a run of 51 or more words which another
    document holds as well is one span per stretch, from start to end; spans that share a run form a component.

    place and last_place: numbers of the lines on which it begins and ends; start and end: words of the text. Equal
    paragraphs, equal texts, and equal passages in equal surroundings are one item from the first shuffle on. Only what
    collides has its text fetched; large buckets are cut into tiles. Null and empty texts have no repeats; rows with the
    same id are one document; rows that repeat repeat their rows. An empty table gives an empty result.
    """
    rows = _rows(docs, id_column, text_column)
    every = store(rows.mapInArrow(_units(least_words, bands(threshold), ROWS), UNITS), "paragraphs")
    units = every.where("starts is null").drop("starts")
    classes, colliding = _candidates(units)
    passages = every.where("starts is not null").select(F.coalesce("id", F.lit(LAST)).alias("id"), "th", F.col("c1").alias("key"), "starts")
    ends = rows.groupBy("th").agg(*[f(F.coalesce("id", F.lit(LAST))).alias(c) for f, c in ((F.min, "least"), (F.max, "most"))])
    shared = store(passages.groupBy("key").agg(F.min("id").alias("_a"), F.max("id").alias("_b")).where("_a <> _b").select("key"), "shared")
    starts = passages.join(shared, "key").groupBy("th").agg(F.array_distinct(F.flatten(F.collect_set("starts"))).alias("starts"))
    cut = starts.join(ends, "th").select(F.nullif("least", F.lit(LAST)).alias("_id"), F.col("th").alias("_th"), F.struct("starts", "least", "most").alias("cut"))
    both = _wanted(classes, colliding).withColumn("cut", F.lit(None).cast("struct<starts:array<int>,least:long,most:long>")).unionByName(
        cut.withColumn("place", F.lit(None).cast("int")))
    wanted = both.groupBy("_id", "_th").agg(F.collect_set("place").alias("places"), F.any_value("cut", True).alias("cut"))
    fetched = store(_fetched(rows, wanted), "fetched")
    lookup = _linked(classes, colliding, fetched.where(F.size("places") > 0), threshold, least_words)
    found = units.drop("keys").join(lookup, ["c1", "c2"])
    many = found.select("root", "id").distinct().groupBy("root").agg(F.count(F.lit(1)).alias("n_documents"))
    blocks_found = found.join(many, "root").select(
        F.col("id").alias(id_column), "place", "last_place", F.lit("paragraph").alias("kind"), "start", (F.col("start") + F.col("n_words")).alias("end"),
        F.col("first.id").alias("component_id"), F.col("first.place").alias("component_place"), "n_paragraphs", "n_documents",
        _first().eqNullSafe(F.col("first")).alias("kept"))
    texts = fetched.where("cut is not null").select("th", "t2", "text", "cut.starts", "cut.least", "cut.most")
    holders = rows.select("th", "t2", F.coalesce("id", F.lit(LAST)).alias("id"))
    return blocks_found.unionByName(_equal_runs(texts, holders, id_column))
