"""Embedding whitening: exact covariance sums, and its leading eigenvectors by contour integration (FEAST)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE, SHIFT = 1024.0, 100_000  # an entry c becomes floor(SCALE * c) + SHIFT
LARGEST = 2.0 ** 40  # an entry beyond, once scaled, counts as not finite: its products would leave 38 digits
LIMB = 18  # bits; products of two limbs of LIMB bits over CHUNK rows are exact in a double
CHUNK = 1 << 14
NODES = 16  # quadrature points on the upper half of a contour
MOST = 6  # eigenvalues that an interval is divided down to, unless they cannot be told apart
ROUNDS = 40
PATIENCE = 4  # rounds after which the block of an interval that has not settled gets new columns
TINY = 1e-12  # of the largest eigenvalue: less counts as no spread


def fitting(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """`id, x` (longs) of the vectors that take part: none null, empty, with a null or non-finite entry, or of another
    length than the most frequent one (of equally frequent ones the longer)."""
    e = F.col(vector_column).cast("array<double>")
    sound = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda c: F.coalesce(F.abs(c) * SCALE < LARGEST, F.lit(False)))
    rows = vectors.where(sound).select(F.col(id_column).alias("id"), F.transform(e, lambda c: F.floor(c * SCALE) + F.lit(SHIFT).cast("long")).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("x") == (lengths.d if lengths else 0))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    return pc.list_flatten(x).to_numpy(zero_copy_only=False).reshape(len(x), -1)


@dataclass
class Moments:
    n: int
    sums: list[int]
    covariance: np.ndarray

    @property
    def middle(self) -> np.ndarray:
        """The whole numbers nearest to the means."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    @property
    def left(self) -> list[int]:
        """n times what the means are above these."""
        return [s - self.n * int(m) for s, m in zip(self.sums, self.middle, strict=True)]


def moments(rows: DataFrame) -> Moments:
    """Number, sums per dimension and covariance (divisor n) of all rows, from whole-number sums.

    The second pass subtracts the whole number nearest to each mean before multiplying; what that leaves of the mean is
    taken off exactly. A task tells one number per pair of dimensions, which Spark adds up.
    """
    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for batch in batches:
            x = _matrix(batch)
            n, total = n + len(x), total + x.sum(axis=0).astype(object)
        if n:
            yield pa.RecordBatch.from_pydict({"i": [-1, *range(len(total))], "v": [str(n), *map(str, total)]}, pa.schema([("i", pa.int32()), ("v", pa.string())]))

    found = rows.select("x").mapInArrow(first_pass, "i int, v string").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    if not found:
        return Moments(0, [], np.zeros((0, 0)))
    by_place = {r.i: int(r.v) for r in found}
    n, sums = by_place.pop(-1), [by_place[i] for i in range(len(by_place))]
    out = Moments(n, sums, np.zeros((len(sums), len(sums))))
    middle, left = out.middle, out.left

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            y = _matrix(batch) - middle
            for at in range(0, len(y), CHUNK):
                for power, g in exact_products(y[at:at + CHUNK]).items():
                    total[power] = total.get(power, 0) + g.astype(object)
        for power, g in total.items():
            i, j = np.triu_indices(len(middle))
            yield pa.RecordBatch.from_pydict(
                {"i": i.astype(np.int32), "j": j.astype(np.int32), "v": [str(int(v) << power) for v in g[i, j]]}, pa.schema([("i", pa.int32()), ("j", pa.int32()), ("v", pa.string())]))

    products = rows.select("x").mapInArrow(second_pass, "i int, j int, v string").groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    for r in products:
        out.covariance[r.i, r.j] = out.covariance[r.j, r.i] = (n * int(r.v) - left[r.i] * left[r.j]) / (n * n)
    return out


def exact_products(y: np.ndarray) -> dict[int, np.ndarray]:
    """y^T y by power of two: sizes are cut into limbs of LIMB bits, so all sums of at most CHUNK rows are exact in doubles."""
    limbs, rest, sign = [], np.abs(y), np.where(y < 0, -1.0, 1.0)
    while True:
        limbs.append((rest & ((1 << LIMB) - 1)).astype(np.float64) * sign)
        rest = rest >> LIMB
        if not rest.any():
            break
    out: dict[int, np.ndarray] = {}
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            out[(i + j) * LIMB] = out.get((i + j) * LIMB, 0) + (a.T @ b).astype(np.int64)
    return out


def above(a: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of the symmetric matrix above the shift: the positive ones of the pivots of its LDL^T.

    Pivots are single entries or 2 x 2 blocks chosen from all that is left, so no shift makes the factors blow up
    (Bunch and Parlett 1971); by Sylvester's law their signs are those of the eigenvalues.
    """
    m = a - shift * np.eye(len(a))
    alpha, positive = (1 + np.sqrt(17)) / 8, 0
    while len(m):
        size = np.abs(m)
        p, q = divmod(int(size.argmax()), len(m))
        r = int(size.diagonal().argmax())
        if size[r, r] >= alpha * size[p, q]:
            pick, signs = [r], np.array([m[r, r]])
        else:
            pick, signs = [p, q], np.linalg.eigvalsh(m[np.ix_([p, q], [p, q])])
        positive += int((signs > 0).sum())
        rest = np.setdiff1d(np.arange(len(m)), pick)
        block, side = m[np.ix_(pick, pick)], m[np.ix_(rest, pick)]
        if not np.any(block):
            break
        m = m[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
        m = (m + m.T) / 2
    return positive


def intervals(a: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """Disjoint intervals (low, high, eigenvalues inside) from the top down that hold at least the `wanted` largest.

    Each is halved by inertia counts until it holds at most MOST, or is too narrow to divide: equal eigenvalues stay together.
    """
    bound = float(np.abs(a).sum(axis=1).max())
    top = bound * (1 + 1e-6)
    found: list[tuple[float, float, int]] = []
    todo = [(-1e-3 * top, top, above(a, -1e-3 * top))]
    while todo and sum(x[2] for x in found) < wanted:
        low, high, inside = todo.pop()
        if not inside:
            continue
        missing = wanted - sum(x[2] for x in found)
        if (inside <= MOST and (inside <= missing or high - low < 0.5 * abs(low))) or high - low < 1e-9 * top:
            found.append((low, high, inside))
            continue
        near = 1e-12 * top
        middle = next((m for m in (low + (high - low) * t for t in (0.5, 0.42, 0.59, 0.36, 0.65)) if above(a, m - near) == above(a, m + near)), (low + high) / 2)
        upper = above(a, middle) - above(a, high)
        todo += [(low, middle, inside - upper), (middle, high, upper)]
    return found


def _solved(matrix: np.ndarray, guesses: dict[int, np.ndarray]):
    """Quadrature terms of one contour per interval: one solve with a complex shifted matrix per row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for nodes in batches:
            out = []
            for k, re, im, wre, wim in nodes[["interval", "re", "im", "wre", "wim"]].itertuples(index=False):
                y = guesses[k]
                term = (complex(wre, wim) * np.linalg.solve(complex(re, im) * np.eye(len(matrix)) - matrix, y.astype(complex))).real
                out.append((k, term.ravel().tolist()))
            yield pd.DataFrame(out, columns=["interval", "term"])
    return run


def feast(spark: SparkSession, matrix: np.ndarray, wanted: int, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues, falling, and their unit eigenvectors as columns (Polizzi 2009).

    Inertia counts cut the real line into intervals. A circle around each is integrated by Gauss-Legendre quadrature of
    (z - V)^-1 Y, which keeps of the random block Y what lies in the span of the eigenvectors inside. The points of all
    circles are tasks of one Spark job. Rayleigh-Ritz on the span gives eigenvalues and the next block, until there are
    as many as the count says and the residuals are rounding errors. A block that does not settle, as where eigenvalues
    crowd on both sides of a circle, is widened. Fewer eigenvalues than the count says are an error.
    """
    rng, d = np.random.default_rng(seed), len(matrix)
    parts = dict(enumerate(intervals(matrix, wanted)))
    blocks = {k: rng.standard_normal((d, min(d, 2 * inside + 6))) for k, (_, _, inside) in parts.items()}
    x, w = np.polynomial.legendre.leggauss(NODES)
    size = float(np.abs(matrix).sum(axis=1).max())
    done: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for turn in range(1, ROUNDS + 1):
        nodes = []
        for k in blocks:
            low, high, _ = parts[k]
            middle, radius = (low + high) / 2, (high - low) / 2
            for xi, wi in zip(x, w, strict=True):
                point = np.exp(1j * np.pi / 2 * (1 - xi))
                z, weight = middle + radius * point, wi / 2 * radius * point
                nodes.append((k, float(z.real), float(z.imag), float(weight.real), float(weight.imag)))
        frame = spark.createDataFrame(nodes, "interval int, re double, im double, wre double, wim double").repartition(len(nodes))
        terms: dict[int, np.ndarray] = {}
        for r in frame.mapInPandas(_solved(matrix, blocks), "interval int, term array<double>").collect():
            terms[r.interval] = terms.get(r.interval, 0) + np.array(r.term)
        for k in list(blocks):
            low, high, inside = parts[k]
            u, s, _ = np.linalg.svd(terms[k].reshape(d, -1), full_matrices=False)
            span = u[:, s > s[0] * 1e-14] if s[0] > 0 else u
            values, turned = np.linalg.eigh(span.T @ matrix @ span)
            vectors = span @ turned
            within = (values > low) & (values <= high)
            residual = np.abs(matrix @ vectors - vectors * values).max(axis=0)
            if within.sum() == inside and residual[within].max(initial=0.0) <= 1e-14 * size * np.sqrt(d):
                done[k] = values[within], vectors[:, within]
                del blocks[k]
            else:
                more = min(d - vectors.shape[1], vectors.shape[1]) if turn % PATIENCE == 0 else 0
                blocks[k] = np.hstack([vectors, rng.standard_normal((d, more))])
        if not blocks:
            break
    if blocks:
        raise ArithmeticError(f"eigenvalues missing in {[parts[k] for k in blocks]}")
    values, vectors = np.concatenate([v for v, _ in done.values()]), np.concatenate([u for _, u in done.values()], axis=1)
    order = np.argsort(-values, kind="stable")[:wanted]
    q, r = np.linalg.qr(vectors[:, order])  # vectors of different intervals: orthogonal but for rounding
    return values[order], q * np.sign(np.diag(r))


def squared_distances(y: np.ndarray, n: int, left: Sequence[int]) -> list[int]:
    """Sum over dimensions of (n y - left)^2 of each row, exact, as n^2 sum(y^2) - 2 n sum(y left) + sum(left^2)."""
    most, d = int(np.abs(y).max(initial=0)), y.shape[1]
    whole = np.array(left, dtype=object)
    squares = (y * y if most * most * d < 1 << 62 else y.astype(object) ** 2).sum(axis=1)
    fits = most * max(map(abs, left), default=0) * d < 1 << 62
    mixed = y @ whole.astype(np.int64) if fits else y.astype(object) @ whole
    own = sum(v * v for v in left)
    return [n * n * int(a) - 2 * n * int(b) + own for a, b in zip(squares, mixed, strict=True)]


def _projected(m: Moments, values: np.ndarray, vectors: np.ndarray):
    mean = np.array([s / m.n for s in m.sums])
    scale = np.where(values > TINY * max(values.max(initial=0.0), 1e-300), values, np.nan) ** -0.5
    schema = pa.schema([("id", pa.int64()), ("deviation_exact", pa.string()), ("whitened", pa.list_(pa.float64()))])
    middle, left = m.middle, m.left

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch)
            w = (x - mean) @ vectors * scale
            apart = [str(v) for v in squared_distances(x - middle, m.n, left)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(apart, pa.string()),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel(), from_pandas=True))], schema=schema)
    return run


def whiten(vectors: DataFrame, components: int = 8, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """`id, component, n, deviation, deviation_exact, whitened, explained, identity_error` of each vector and component.

    Entries become whole numbers x = floor(1024 c) + 100000. whitened is x minus its mean, projected on an eigenvector
    of the covariance (divisor n) and divided by the root of its eigenvalue; components are numbered by falling
    eigenvalue, `components` at most and not more than there are dimensions. explained is the eigenvalue's part of the
    trace. deviation is the sum over dimensions of (n x - S)^2, exact; null where it does not fit into a long, which
    deviation_exact (decimal) then has. identity_error is the largest entry of whitened's covariance minus the identity,
    measured in another pass over what was returned.

    Vectors that are null, empty, or hold a null or a non-finite entry have no row; so have those of another length than
    the most frequent one, and with an entry of 2^30 or more. Components without spread (equal vectors, fewer vectors
    than dimensions) have whitened null and explained 0. Rows that repeat count each time. No other column is read. An
    empty table gives an empty result. The driver holds sums per pair of dimensions, never vectors.
    """
    spark = vectors.sparkSession
    rows = fitting(vectors, id_column, vector_column)
    m = moments(rows)
    k = min(components, len(m.sums))
    if not m.n:
        values, axes, total = np.zeros(0), np.zeros((0, 0)), 0.0
    elif not m.covariance.any():
        values, axes, total = np.zeros(k), np.eye(len(m.sums))[:, :k], 0.0
    else:
        values, axes = feast(spark, m.covariance, k)
        values, total = np.maximum(values, 0.0), float(np.trace(m.covariance))
    whitened = rows.mapInArrow(_projected(m, values, axes), "id long, deviation_exact string, whitened array<double>") if m.n else spark.createDataFrame(
        [], "id long, deviation_exact string, whitened array<double>")
    live = [i for i in range(k) if values[i] > TINY * values.max()]
    entries = [F.abs(F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]) - (1.0 if i == j else 0.0)) for i in live for j in live if i <= j]
    error = whitened.agg(F.greatest(*entries, F.lit(0.0))).first()[0] if entries else None
    explained = F.array(*[F.lit(float(v / total) if i in live else 0.0) for i, v in enumerate(values)]) if k else F.array().cast("array<double>")
    long = whitened.select("id", F.col("deviation_exact").cast("decimal(38,0)").alias("deviation_exact"), F.posexplode("whitened").alias("_i", "whitened"))
    return long.select(
        F.col("id").alias(id_column), (F.col("_i") + 1).alias("component"), F.lit(m.n).cast("long").alias("n"), F.col("deviation_exact").try_cast("long").alias("deviation"),
        "deviation_exact", "whitened", F.get(explained, F.col("_i")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
