"""Source divergence audit: terms counted by Arrow kernels inside the tasks, merged shards compared in columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayer.llm.shared import each_group, slices, store

BREAKS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"  # everything between two terms
PARTS = 1_000_000_000  # shares are whole numbers of this
SHARD = 256  # terms that are compared at once
TILE = 256  # sources on each side of a comparison; a task holds two tiles of one shard
COUNTS = "lang string, source string, term string, count long, docs long"


def partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and texts of each term by language and source, one batch at a time; the term '' counts the texts."""
    for batch in batches:
        for part in slices(batch, "text"):
            lists = pc.split_pattern_regex(pc.ascii_lower(part.column("text").cast(pa.large_string())), BREAKS)
            terms, owner = pc.list_flatten(lists), pc.list_parent_indices(lists)
            real = pc.not_equal(terms, "")
            coded = terms.filter(real).dictionary_encode()
            per_text = pa.table({"text": owner.filter(real), "term": coded.indices}).group_by(["text", "term"], use_threads=False).aggregate([([], "count_all")])
            whose = per_text["text"]
            grouped = pa.table({
                "lang": part.column("lang").take(whose.combine_chunks()), "source": part.column("source").take(whose.combine_chunks()),
                "term": per_text["term"], "count": per_text["count_all"]}).group_by(["lang", "source", "term"], use_threads=False).aggregate(
                    [("count", "sum"), ([], "count_all")])
            texts = pa.table({"lang": part.column("lang"), "source": part.column("source")}).group_by(["lang", "source"], use_threads=False).aggregate([([], "count_all")])
            for found, term, count, docs in (
                    (grouped, coded.dictionary.take(grouped["term"].combine_chunks()), grouped["count_sum"], grouped["count_all"]),
                    (texts, pa.array([""] * len(texts)), pa.array(np.zeros(len(texts), np.int64)), texts["count_all"])):
                out = pa.table({"lang": found["lang"], "source": found["source"], "term": term.cast(pa.string()),
                                "count": count.cast(pa.int64()), "docs": docs.cast(pa.int64())}).combine_chunks()
                yield from out.to_batches()


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(PARTS * (count + 2) / (n + 2 v)) as a long; 1 where nothing is kept."""
    wide = "decimal(38,0)"
    whole = (count.cast(wide) + F.lit(2).cast(wide)) * F.lit(PARTS).cast("decimal(10,0)")
    total = (n.cast(wide) + F.lit(2).cast(wide) * v.cast(wide)).cast(wide)
    return F.lit(1).cast("long") + F.when(v > 0, F.call_function("div", whole.cast(wide), total)).otherwise(F.lit(0)).cast("long")


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); both are at most PARTS + 1, so the square fits into a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def compare_shard(group: pa.Table) -> pa.Table:
    """Divergence of each pair of sources of a tile pair over the terms of one shard.

    Rows without a term tell the share of a term that a source lacks, and how many terms the shard has; terms that no
    source of the tiles has are one product. Sources are numbered, `a` from the first tile and `b` from the second.
    """
    source, code, p = group["number"].to_numpy(), group["code"], group["p"].to_numpy()
    side, terms = group["side"].to_numpy(), pc.max(group["terms"]).as_py()
    heads = code.is_null().to_numpy()
    lone = {s: p[heads & (side == s)] for s in (0, 1)}
    names = {s: source[heads & (side == s)] for s in (0, 1)}
    present = np.unique(code.drop_null().to_numpy()) if not heads.all() else np.zeros(0, np.int64)
    rows, sides = np.searchsorted(present, pc.fill_null(code, 0).to_numpy()), {}
    for s in (0, 1):
        order = np.argsort(names[s])
        names[s], lone[s] = names[s][order], lone[s][order]
        sides[s] = np.repeat(lone[s][:, None], len(present), axis=1)
        mine = ~heads & (side == s)
        sides[s][np.searchsorted(names[s], source[mine]), rows[mine]] = p[mine]
    same = not len(names[1])
    right, right_lone, right_names = (sides[0], lone[0], names[0]) if same else (sides[1], lone[1], names[1])
    out = {"a": [], "b": [], "value": []}
    for i, name in enumerate(names[0]):
        later = slice(i + 1 if same else 0, None)
        d, t = right[later] - sides[0][i], right[later] + sides[0][i]
        e, u = right_lone[later] - lone[0][i], right_lone[later] + lone[0][i]
        value = (d * d // t).sum(axis=1) + (terms - len(present)) * (e * e // u)
        out["a"].append(np.full(len(value), name))
        out["b"].append(right_names[later])
        out["value"].append(value)
    return pa.table({k: pa.array(np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64)) for k, v in out.items()}).append_column(
        "lang_no", pa.array(np.full(sum(map(len, out["a"])), group["lang_no"].to_numpy()[0]))).select(["lang_no", "a", "b", "value"])


def shares(docs: DataFrame, least_docs: int = 10, id_columns: tuple[str, str] = ("lang", "source"), text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Kept terms `lang, source, term, count, lang_count, first` and groups `lang, source, n, lang_n, v`, both stored.

    Counts of a task are combined before they are shuffled by all three keys, so a term of every text is one row per
    task; what is merged then meets by language and term, which tells in how many texts of the language a term occurs.
    Only kept terms are stored. first marks one row of each term of a language.
    """
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in id_columns)
    rows = docs.select(lang.alias("lang"), source.alias("source"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    merged = rows.mapInArrow(partial_counts, COUNTS).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    every = merged.withColumns({"_in": F.sum("docs").over(whole), "lang_count": F.sum("count").over(whole), "first": F.min("source").over(whole) == F.col("source")})
    kept = store(every.where((F.col("term") == "") | (F.col("_in") >= least_docs)).select("lang", "source", "term", "count", "lang_count", "first"), "terms")
    terms = kept.where("term <> ''")
    by_group = terms.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    by_lang = terms.groupBy("lang").agg(F.sum("count").alias("lang_n"), F.count_if("first").alias("v"))
    groups = kept.where("term = ''").select("lang", "source").join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left").select(
        "lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "lang_n", "v")])
    return terms, store(groups, "groups")


def pairs(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """`lang, source, item, value` of every two sources of a language, in both directions.

    Terms are dealt to shards by a hash of the term, sources to tiles by their number; a row goes to each tile that its
    own is compared with. Sums of shards are added up per pair, and mirrored.
    """
    by_lang = Window.partitionBy("lang").orderBy("source")
    langs = groups.select("lang", "v").distinct().select("lang", F.xxhash64("lang").alias("lang_no"), F.greatest(F.lit(1), F.ceil(F.col("v") / SHARD)).alias("shards"))
    last = F.count(F.lit(1)).over(Window.partitionBy("lang")) - 1
    numbered = store(groups.withColumns({"number": F.row_number().over(by_lang) - 1, "_last": last}).select(
        "lang", "source", "n", "v", F.col("number").cast("long").alias("number"), F.expr(f"number div {TILE}").cast("int").alias("tile"),
        F.expr(f"_last div {TILE}").cast("int").alias("last")).join(langs, "lang"), "numbered")
    shard = F.pmod(F.xxhash64("term"), F.col("shards"))
    told = terms.select("lang", "source", "term", "count").join(numbered, ["lang", "source"]).select(
        "lang_no", shard.alias("shard"), "number", "tile", "last", F.xxhash64(F.lit(11), F.col("term")).alias("code"), share(F.col("count"), F.col("n"), F.col("v")).alias("p"))
    sizes = terms.where("first").select("lang", "term").join(langs, "lang").groupBy("lang_no", shard.alias("shard")).agg(F.count(F.lit(1)).alias("terms"))
    heads = numbered.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).select(
        "lang_no", "shard", "number", "tile", "last", F.lit(None).cast("long").alias("code"), share(F.lit(0), F.col("n"), F.col("v")).alias("p"))
    placed = told.withColumn("terms", F.lit(None).cast("long")).unionByName(
        heads.join(sizes, ["lang_no", "shard"], "left").withColumn("terms", F.coalesce("terms", F.lit(0))))
    other = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), "last")))
    dealt = other.select(
        "lang_no", "shard", F.least("tile", "_other").alias("i"), F.greatest("tile", "_other").alias("j"), (F.col("tile") > F.col("_other")).cast("int").alias("side"),
        "number", "code", "p", "terms")
    told = each_group(dealt, ["lang_no", "shard", "i", "j"], compare_shard, "lang_no long, a long, b long, value long")
    sums = told.groupBy("lang_no", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.unionByName(sums.select("lang_no", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    left = numbered.select("lang_no", F.col("number").alias("a"), "lang", "source")
    right = numbered.select("lang_no", F.col("number").alias("b"), F.col("source").alias("item"))
    return both.join(left, ["lang_no", "a"]).join(right, ["lang_no", "b"]).select("lang", "source", "item", "value")


def over_represented(terms: DataFrame, groups: DataFrame, most: int) -> DataFrame:
    """`lang, source, item, value, rank` of the terms that a source has with a larger share than its language, `most` at most."""
    p, q = share(F.col("count"), F.col("n"), F.col("v")), share(F.col("lang_count"), F.col("lang_n"), F.col("v"))
    found = terms.join(groups, ["lang", "source"]).where("count > 0").withColumns({"_p": p, "_q": q}).where("_p > _q").select(
        "lang", "source", F.col("term").alias("item"), gap(F.col("_p"), F.col("_q")).alias("value"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= most)


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10, columns: tuple[str, str] = ("lang", "source"), text_column: str = "text") -> DataFrame:
    """`lang, source, part, item, value, rank`: how far the sources of each language are apart, and by which terms.

    A term is a run of letters (A-Z as a-z, every character beyond ASCII as it is). A language keeps the terms of at
    least `least_docs` of its texts, V in number. A source's share of a term is 1 + floor(10^9 (count + 2) / (N + 2 V)),
    N the occurrences of all kept terms in it. Part `pair`: each other source of the language with the sum of
    floor((p - q)^2 / (p + q)) over all kept terms. Part `term`: the `top` terms whose share is above that of the
    language, with that term's value. Ranks go by value, then by the item's bytes. All arithmetic is in whole numbers.

    Null text, language and source count as ''. A source without terms, and a language that keeps none (all values 0),
    have their pairs. A source alone in its language has no pair. Rows that repeat count each time. No other column is
    read. An empty table gives an empty result.
    """
    terms, groups = shares(docs, least_docs, columns, text_column)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    between = pairs(terms, groups).withColumn("rank", rank).withColumn("part", F.lit("pair"))
    above = over_represented(terms, groups, top).withColumn("part", F.lit("term"))
    return between.unionByName(above).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
