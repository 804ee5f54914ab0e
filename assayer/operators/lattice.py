"""Minimal keys and functional dependencies over sets of columns, level by level."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from assayer.functions.shape import spread
from assayer.sources.tables import stored

FOUND = "kind string, columns string, dependent string, width bigint, classes bigint"
MOST_SETS = 20_000
FIRST_LOOK = 5_000  # rows of each column's part in the first look, about
LAST_SHARE = 512  # parts of more than one in so many rows are not looked at: what is left is cheaper to look for in all
CLASSES = 64  # a part is made of whole values of a column if that leaves it so many of them
MOST_SHARED = 200_000  # names that are broadcast
FILE_ROWS = 1_000_000  # so that an input of one split is more than one task of the passes after the first

Claim = tuple[tuple[int, ...], tuple[int, ...]]  # columns, and those that they may determine


def _name(seed: int, columns: Sequence[str]) -> Column:
    """64 bits of the values of columns; NULL is a value, NaN equals NaN and -0.0 equals 0.0."""
    return F.xxhash64(F.lit(seed), *[x for c in columns for x in (F.col(c), F.col(c).isNull())])


class Claims:
    """What is claimed of sets of columns, looked for in the rows: classes, rows beyond the first of each, and whether one has two values beside it."""

    def __init__(self, rows: DataFrame, columns: Sequence[str], distinct: Sequence[int], width: int):
        self.rows, self.columns, self.distinct, self.width = rows, list(columns), distinct, width
        self.row, self.kept, self.found = len(self.columns), {}, {}

    def owner(self, s: tuple[int, ...], share: int) -> int:
        """A part is one in `share` values of this column: that of the set with most values, or the row itself if those are few."""
        widest = max(s, key=lambda i: self.distinct[i])
        return widest if self.distinct[widest] >= CLASSES * share else self.row

    def chosen(self, share: int) -> dict[int, Column]:
        """By owner, whether a row is of its part."""
        owners = sorted({self.owner((i,), share) for i in range(self.row)} | {self.row})
        return {i: F.pmod(_name(4, self.columns[i:i + 1] or self.columns), F.lit(share)) == 0 for i in owners}

    def parts(self, share: int) -> DataFrame:
        """The rows that any part of this share has, stored if they are fewer than all."""
        if share < self.row:
            return self.rows
        if share not in self.kept:
            within = next((part for larger, part in self.kept.items() if share % larger == 0), self.rows)
            self.kept[share] = stored(spread(within.where(reduce(lambda a, b: a | b, self.chosen(share).values()))), "parts")
        return self.kept[share]

    def name(self, seed: int, s: Sequence[int]) -> Column:
        return _name(seed, [self.columns[i] for i in s])

    def named(self, s: tuple[int, ...], names: DataFrame) -> DataFrame | None:
        """The rows with one of these 64-bit names of a set's values; None if there are too many names."""
        many = names.count()
        if many > MOST_SHARED:
            return None
        return self.rows.join(F.broadcast(names), self.name(5, s) == F.col("_name"), "leftsemi") if many else self.rows.limit(0)

    def sharing(self, s: tuple[int, ...]) -> DataFrame | None:
        """The rows whose values in these columns another row has too, by name, so perhaps a few more; None if there are too many such values."""
        if s not in self.found:
            names = self.rows.groupBy(self.name(5, s).alias("_name")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
            self.found[s] = self.named(s, stored(names.select("_name"), "shared"))
        return self.found[s]

    def breaking(self, s: tuple[int, ...], beside: tuple[int, ...]) -> tuple[int, DataFrame | None]:
        """The rows beyond the first of each class of these columns, and the rows of the classes that have two values beside them; None if there are too many such classes."""
        counted, value = Observation(), self.name(7, beside)
        classes = self.rows.groupBy(self.name(5, s).alias("_name"), self.name(6, s)).agg(
            F.count(F.lit(1)).alias("n"), F.min(value).alias("a"), F.max(value).alias("b"))
        names = classes.observe(counted, F.sum(F.col("n") - 1).alias("repeated")).where(F.col("a") != F.col("b"))
        rows = self.named(s, stored(names.select("_name"), "broken"))
        return counted.get["repeated"], rows

    def look(self, claims: Sequence[Claim], share: int = 1, rows: DataFrame | None = None) -> dict[Claim, tuple[int, int, bool]]:
        """`classes, repeated, broken` of each claim in one in `share` of the rows, or in the given ones. What is repeated or broken there is so in the whole."""
        if not claims:
            return {}
        nothing = self.row
        held = [(i, self.owner(s, share), list(beside), *s, *[nothing] * (self.width - len(s))) for i, (s, beside) in enumerate(claims)]
        sides = [f"s{i}" for i in range(self.width)]
        asked = F.broadcast(self.rows.sparkSession.createDataFrame(held, "claim int, owner int, beside array<int>, " + ", ".join(f"{c} int" for c in sides)))
        names = [F.array(*[_name(seed, [c]) for c in self.columns], F.lit(0).cast("long")).alias(v) for seed, v in ((1, "x"), (2, "y"))]
        if share > 1:
            owners = F.array_compact(F.array(*[F.when(mine, F.lit(i)) for i, mine in self.chosen(share).items()]))
            pairs = self.parts(share).select(*names, F.explode(owners).alias("owner")).join(asked, "owner")
        else:
            pairs = (self.rows if rows is None else rows).select(*names).crossJoin(asked)
        name = lambda v: F.xxhash64(*[F.col(v)[F.col(c)] for c in sides]).alias(f"h{v}")
        value = (F.when(F.size("beside") == 0, F.lit(0).cast("long")).when(F.size("beside") == 1, F.col("x")[F.col("beside")[0]])
                 .otherwise(F.xxhash64(F.transform("beside", lambda i: F.col("x")[i]))))
        classes = pairs.select("claim", name("x"), name("y"), value.alias("r")).groupBy("claim", "hx", "hy").agg(
            F.count(F.lit(1)).alias("n"), F.min("r").alias("a"), F.max("r").alias("b"))
        seen = {r.claim: r for r in classes.groupBy("claim").agg(
            F.count(F.lit(1)).alias("c"), F.sum(F.col("n") - 1).alias("repeated"), F.max(F.col("a") != F.col("b")).alias("broken")).collect()}
        return {c: (seen[i].c, seen[i].repeated, seen[i].broken) if i in seen else (0, 0, False) for i, c in enumerate(claims)}

    def told(self, claims: Sequence[Claim], rows: DataFrame | None = None) -> dict[Claim, tuple[int, int, bool]]:
        """What `look` says of claims in all or the given rows, and of each of several columns that are not all determined."""
        seen = self.look(claims, rows=rows)
        return {**seen, **self.look([(s, (a,)) for (s, beside), (_, _, broken) in seen.items() if broken and len(beside) > 1 for a in beside], rows=rows)}


def _shares(rows: int) -> list[int]:
    """Shares of the growing parts, each of which holds the one before."""
    share, times = max(1, rows // FIRST_LOOK), 0
    while share >= LAST_SHARE:
        share, times = share // 16, times + 1
    return [share * 16 ** i for i in range(times, -1, -1)] if share > 1 else []


def _together(claims: Sequence[Claim], shared: dict[tuple[int, ...], int]) -> tuple[tuple[int, ...] | None, list[Claim]]:
    """The set of columns with few shared values that is within most claims, and these; no set and all claims if there is none."""
    within: dict[tuple[int, ...], list[Claim]] = {}
    for claim in claims:
        for k in range(1, len(claim[0]) + 1):
            for t in combinations(claim[0], k):
                if shared.get(t, MOST_SHARED + 1) <= MOST_SHARED:
                    within.setdefault(t, []).append(claim)
    if not within:
        return None, list(claims)
    best = max(within, key=lambda t: (len(within[t]), len(t), -shared[t]))
    return best, within[best]


def _settle(table: Claims, open_: dict[tuple[int, ...], set[int]], rows: int, shared: dict[tuple[int, ...], int]) -> tuple[list[tuple[int, ...]], list[tuple[tuple[int, ...], int, int]]]:
    """Keys among the sets of a level, and the columns that each of the others determines of those named for it, with its classes.

    Claims are looked for in growing parts of the rows: what a part refutes is refuted in the whole. What no part refutes
    is looked for in all rows, so a claim that holds has been compared on every row: by the names of one set for all claims
    with its columns if few rows share its values, as only those can share more. `shared` has about how many do, by set.
    If many do, the classes of a claim are counted, and the columns beside them told apart in the classes with two values.
    """
    may_key, alive = set(open_), {s: set(b) for s, b in open_.items()}
    shares = _shares(rows)
    for share in reversed(shares):
        table.parts(share)
    for share in shares:
        one_by_one = [(s, (a,)) for s, b in alive.items() for a in sorted(b)]
        todo = [(s, ()) for s in may_key if not alive[s]] + one_by_one
        for (s, beside), (_, repeated, broken) in table.look(todo, share).items():
            shared[s] = (repeated + 1) * share
            if repeated:
                may_key.discard(s)
            if broken:
                alive[s] -= set(beside)
        alive = {s: b for s, b in alive.items() if b or s in may_key}
    keys, found = [], []
    left = [(s, tuple(sorted(b))) for s, b in sorted(alive.items())]
    while left:
        within, claims = _together(left, shared)
        some = table.sharing(within) if within else None
        if within and some is None:
            shared[within] = MOST_SHARED + 1
            continue
        left = [c for c in left if c not in claims]
        if within or not shares:
            told = table.told(claims, some)
        else:
            told = table.told([c for c in claims if not c[1]])
            for s, beside in (c for c in claims if c[1]):
                repeated, some = table.breaking(s, beside)
                told |= {c: (rows - repeated, repeated, broken) for c, (_, _, broken) in table.told([(s, beside)], some).items()}
        for (s, beside), (_, repeated, broken) in told.items():
            if not repeated:
                keys.append(s)
            elif not broken:
                found += [(s, a, rows - repeated) for a in beside]
    return keys, found


def keys_and_dependencies(df: DataFrame, columns: Sequence[str] | None = None, width: int = 3) -> DataFrame:
    """All minimal keys of at most `width` columns and all minimal dependencies of one column on fewer than `width` others.

    `kind, columns, dependent, width, classes`: kind `key` or `dependency`; columns joined by commas in the table's order;
    classes is the number of distinct values of the columns. A constant column depends on no columns (width 0). What
    depends on a key is not listed. NULL is a value like any other. A table of at most one row has the empty key.

    Two rows refute a key or a dependency, so each is first looked for in parts of the rows that hold whole classes, and
    only what no part refutes is looked for in all rows. Claims that (nearly) hold have columns in common whose values few
    rows share: one 64-bit name per row is shuffled for all claims with these columns, and the rows that share a name are
    compared by 128-bit names of the values. Only sets with many such rows are counted on their own. Sets that hold a key
    or the two sides of a dependency are settled without a look. The columns are stored once and each pass reads them again.
    Equal rows of a set are combined before they are shuffled. The driver holds a few numbers per set.
    """
    columns = list(columns or df.columns)
    m = len(columns)
    if sum(len(list(combinations(range(m), k))) for k in range(1, width + 1)) > MOST_SETS:
        raise ValueError(f"more than {MOST_SETS} sets of columns")
    spark = df.sparkSession
    rows = stored(spread(df.select(*columns)), "values", FILE_ROWS)
    first = rows.agg(F.count(F.lit(1)), *[F.approx_count_distinct(_name(1, [c])) for c in columns], *[F.min(_name(1, [c])) == F.max(_name(1, [c])) for c in columns]).first()
    n = first[0]
    if n <= 1:
        return spark.createDataFrame([("key", "", None, 0, n)], FOUND)
    claims, shared = Claims(rows, columns, first[1:m + 1], width), {}
    keys: list[tuple[int, ...]] = []
    dependencies: list[tuple[tuple[int, ...], int, int]] = [((), a, 1) for a in range(m) if width > 0 and first[m + 1 + a]]
    for k in range(1, width + 1):
        open_ = {}
        for s in combinations(range(m), k):
            whole = set(s)
            if not any(whole.issuperset(key) for key in keys) and not any(a in whole and whole.issuperset(left) for left, a, _ in dependencies):
                known = {a for left, a, _ in dependencies if whole.issuperset(left)}
                open_[s] = set(range(m)) - whole - known if k < width else set()
        new_keys, found = _settle(claims, open_, n, shared)
        keys += new_keys
        dependencies += found
    text = lambda s: ",".join(columns[i] for i in s)
    out = [("key", text(s), None, len(s), n) for s in keys]
    out += [("dependency", text(s), columns[a], len(s), c) for s, a, c in dependencies]
    return spark.createDataFrame(out, FOUND)
