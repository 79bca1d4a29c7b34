"""Whitening of embeddings by shifted CholeskyQR.

Entries become integers floor(256 c), so the mean and every centred row are known exactly before anything is rounded. The
centred rows A of the distinct vectors are orthogonalised by passes over the table: each pass adds up the Gram matrix
G = Q'Q of the rows made so far, factors G + sI = R'R, and replaces Q by Q R^-1 through triangular solves. The shift s lets
the first factorisation go through however badly conditioned the rows are, and even where columns depend on each other; it
is left out once G is near the identity. A = Q R with R the product of all factors, so the singular values and right
singular vectors of the small matrix R are those of A: the components, with eigenvalues s^2 / n.

Only matrices of d x d numbers reach the driver, d being the length of the vectors. Every task adds up its rows first; the
tasks' matrices are then added row by row of the matrix, by key, never in one task. Distinct vectors are found by one
shuffle of the narrowest integers that hold them, with equal ones merged in the map tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillforge.llm.common import stage_table, table, tuned

SCALE = 256
#: Most components that are returned for a row.
COMPONENTS = 4
#: The most passes of CholeskyQR; three are enough unless columns depend on each other.
PASSES = 6
#: Gram matrices have d x d entries, in every task and on the driver.
MAX_DIMENSIONS = 8_192
_ROWS = 2_048
_LONG = 1 << 63
_EPS = np.finfo(float).eps


class Moments(NamedTuple):
    """Of the distinct vectors: how many, their sums in each dimension, and the largest absolute entry."""

    n: int
    sums: list[int]
    largest: int


class Whitening(NamedTuple):
    """Components as columns of `directions`, with their eigenvalues and shares of the variance."""

    moments: Moments
    directions: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    error: float


def integers(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """rows with `x`, the integers of their vector, filled with zeros to the longest length; rows without a usable vector go."""
    entries = F.col(vector).cast("array<double>")
    finite = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(entries, lambda c: F.floor(c * SCALE).cast("long"))
    rows = rows.where(entries.isNotNull() & finite).withColumn("x", x)
    longest, low, high = rows.agg(F.max(F.size("x")), F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    if longest is not None and longest > MAX_DIMENSIONS:
        raise ValueError(f"a vector has {longest} entries; {MAX_DIMENSIONS} are the most")
    kind = next((k for k, bits in (("smallint", 15), ("int", 31)) if low is not None and -(1 << bits) <= low and high < 1 << bits), "bigint")
    filled = F.when(F.size("x") == (longest or 0), F.col("x")).otherwise(F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(longest or 0) - F.size("x"))))
    return rows.withColumn("x", filled.cast(f"array<{kind}>"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def moments(fit: DataFrame) -> Moments:
    """Exact counts and sums: longs inside a block, decimals across blocks."""

    def part(at: list[int], totals: list[int], largest: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(map(str, totals)), pa.array([str(largest)] * len(at))], names=["i", "total", "largest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"))
            if not x.size:
                yield part([-1], [len(batch)], 0)
                continue
            largest = max(abs(int(x.min())), abs(int(x.max())))
            sums = x.sum(axis=0).tolist() if largest * len(x) < _LONG else [sum(c) for c in x.T.tolist()]
            yield part([-1, *range(len(sums))], [len(x), *sums], largest)

    parts = fit.select("x").mapInArrow(run, "i int, total string, largest string")
    found = parts.groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.max(F.col("largest").cast("decimal(38,0)")).alias("largest")).orderBy("i").collect()
    if not found:
        return Moments(0, [], 0)
    return Moments(int(found[0]["total"]), [int(r["total"]) for r in found[1:]], max(int(r["largest"]) for r in found))


def centred(x: np.ndarray, m: Moments) -> tuple[np.ndarray, np.ndarray | None]:
    """The rows x - S/n as doubles, each rounded once, and the integers n x - S; the latter None if a long can't hold them."""
    if m.n * m.largest + max(map(abs, m.sums), default=0) < _LONG:
        whole = x * m.n - np.array(m.sums, np.int64)
        return whole / m.n, whole
    rows = [[(m.n * v - s) / m.n for v, s in zip(row, m.sums, strict=True)] for row in x.tolist()]
    return np.array(rows, float).reshape(x.shape), None


def summed_products(fit: DataFrame, m: Moments, through: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of q'q, q being through(centred row): by block, by task, then by key of the matrix's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _matrix(batch.column("x"))
            for first in range(0, len(x), _ROWS):
                q = through(centred(x[first : first + _ROWS], m)[0])
                total = q.T @ q if total is None else total + q.T @ q
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([row.tobytes() for row in total])], names=["i", "row"])

    parts = fit.select("x").coalesce(max(1, fit.sparkSession.sparkContext.defaultParallelism)).mapInArrow(run, "i int, row binary")
    # a matrix row has one part for each task; they are added as they come
    dealt = parts.repartition(F.col("i")).sortWithinPartitions("i")

    def by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            for i, row in zip(batch.column("i").to_pylist(), batch.column("row"), strict=True):
                if i != key:
                    if key is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([total.tobytes()])], names=["i", "row"])
                    key, total = i, np.zeros(len(row.as_py()) // 8)
                total = total + np.frombuffer(row.as_py())
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([total.tobytes()])], names=["i", "row"])

    rows = dealt.mapInArrow(by_row, "i int, row binary").collect()
    return np.array([np.frombuffer(r["row"]) for r in sorted(rows, key=lambda r: r["i"])])


def solved(factors: list[np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """Rows to rows R1^-1 R2^-1 ..., one triangular solve a factor."""
    return lambda a: _through(a, factors)


def _through(a: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    for r in factors:
        # q R = a for all rows at once, R upper triangular: column by column in blocks
        q = np.empty_like(a)
        for first in range(0, len(r), 64):
            end = min(first + 64, len(r))
            left = a[:, first:end] - q[:, :first] @ r[:first, first:end]
            q[:, first:end] = np.linalg.solve(r[first:end, first:end].T, left.T).T
        a = q
    return a


def cholesky_qr(products: Callable[[list[np.ndarray]], np.ndarray], n: int) -> np.ndarray:
    """R of A = Q R, from the Gram matrices of the rows that products(factors) gives for A R1^-1 R2^-1 ...

    Directions in which A has no variance keep none in any pass; R is then about 10^-6 of its size there after each of them."""
    factors: list[np.ndarray] = []
    whole = None
    for k in range(PASSES):
        gram = products(factors)
        gram = (gram + gram.T) / 2
        d, size = len(gram), float(np.trace(gram))
        if not size > 0:
            return np.zeros((d, d))
        values = np.linalg.eigvalsh(gram) if k else np.zeros(d)
        # rows of a block and blocks of a task are added one after another: that, not n, bounds the rounding
        least = 11 * (min(n, _ROWS) * d + d * (d + 1)) * _EPS
        shift = 0.0 if values.min() > 0.5 else least * (size if k == 0 else max(1.0, float(values.max())))
        r = np.linalg.cholesky(gram + shift * np.eye(d)).T
        factors.append(r)
        whole = r if whole is None else r @ whole
        # done: all directions have length one, but for those without variance, which stay at nothing
        if k and np.all((np.abs(values - 1) < 1e-11) | (values < 1e-6)):
            break
    return whole


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Components of the rows of fit (x), each different vector once.

    Signs: of each component the entry of largest absolute value is positive."""
    m = moments(fit)
    d = len(m.sums)
    k = min(components, d)
    if not m.n or not d:
        return Whitening(m, np.zeros((d, k)), np.zeros(k), np.zeros(k), 0.0)
    r = cholesky_qr(lambda factors: summed_products(fit, m, solved(factors)), m.n)
    _, sizes, right = np.linalg.svd(r)
    values = sizes * sizes / m.n
    values[values <= values[0] * (128 * d * _EPS) ** 2] = 0  # no more than the rounding of the centred rows
    right = right[:k]
    right = right * np.where(right[np.arange(k), np.abs(right).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    known = values[:k] > 0
    directions = np.where(known, right.T / np.sqrt(np.where(known, values[:k], 1)), 0.0)
    error = 0.0
    if known.any():
        mean_free = summed_products(fit, m, lambda a: a @ directions[:, known]) / m.n
        error = float(np.abs(mean_free - np.eye(known.sum())).max())
    return Whitening(m, directions, values[:k], np.where(known, values[:k], 0) / max(values.sum(), np.finfo(float).tiny), error)


def whiten(rows: DataFrame, model: Whitening, key: str = "vec_id") -> DataFrame:
    """A row for each row and component: key, component, n, deviation, whitened, explained, identity_error."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        m, k = model.moments, model.directions.shape[1]
        for whole in batches:
            for first in range(0, len(whole), _ROWS):
                batch = whole.slice(first, _ROWS)
                x = _matrix(batch.column("x"))
                a, exact = centred(x, m)
                b = len(batch)
                most = 0 if exact is None else max(-int(exact.min(initial=0)), int(exact.max(initial=0)))
                if exact is not None and most * most * exact.shape[1] < _LONG:
                    deviation = (exact * exact).sum(axis=1).tolist()
                else:
                    sums = [sum((m.n * v - s) ** 2 for v, s in zip(row, m.sums, strict=True)) for row in x.tolist()]
                    deviation = [v if v < _LONG else None for v in sums]
                white = a @ model.directions
                columns = [
                    batch.column(key).take(pa.array(np.repeat(np.arange(b), k))),
                    pa.array(np.tile(np.arange(1, k + 1), b), pa.int32()),
                    pa.array(np.full(b * k, m.n), pa.int64()),
                    pa.array([v for v in deviation for _ in range(k)], pa.int64()),
                    pa.array(white.reshape(-1), pa.float64(), mask=np.tile(model.eigenvalues <= 0, b)),
                    pa.array(np.tile(model.explained, b)),
                    pa.array(np.full(b * k, model.error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(key, "x").mapInArrow(run, f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whitened(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitened components of every row whose vector is not null and holds no null or non-finite entry.

    Defined cases: a vector that is shorter than the longest is filled with zeros, an empty one too; repeated rows and null
    keys keep their rows; equal vectors count once in the fit; a component without variance (all vectors equal, or fewer
    vectors than components) has explained 0 and whitened null; deviation is null where a long can't hold it; there are as
    many components as dimensions if those are fewer; without any row, or with empty vectors only, the result is empty.
    Other columns are ignored."""
    tuned(embeddings.sparkSession, _ROWS)
    rows = integers(embeddings.select(F.col(key), F.col(vector)).toDF(key, "embedding")).select(key, "x")
    fit = stage_table(rows.select("x").distinct(), "vectors")
    return whiten(rows, fit_whitening(fit, components), key)


def op12_cholesky_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
