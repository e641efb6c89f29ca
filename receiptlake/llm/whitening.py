"""Embedding whitening by FEAST contour integration.

Entries become whole numbers x = floor(1024 c) + 100000. One pass sums them per dimension,
a second one sums the products of the entries centred at a whole number next to their mean;
both add up per task before anything is shuffled, and only d and d x d sums reach the
driver, whatever the number of rows. As long as the sums stay below 2^53 they are exact, so
neither depends on how rows are dealt to tasks; the rest of the centring is a correction by
less than half a unit.

The components are found on the d x d covariance. Inertia, the signs of the pivots of
V - s I, counts the eigenvalues above any s. Bisection by it gives intervals that hold the
greatest eigenvalues, a few each. For each interval a Gauss-Legendre quadrature along a
circle through its ends, each node a complex solve of the shifted covariance, projects
random vectors onto its eigenvectors, and Rayleigh-Ritz takes the pairs out, again and again
until the residuals are at rounding and the number found is the one that inertia counts. A
last Rayleigh-Ritz over all intervals makes the components orthogonal.

Rows whose vector is null or holds null or non-finite entries are left out, and so are
vectors whose length is not the commonest one (of equally common ones the greatest), for
which there is no covariance, and empty vectors. Entries beyond 2^40 count as 2^40. Repeated
rows and null ids count each. Directions without variance (an eigenvalue not above
rounding) are no components: one row, or rows all alike, give no rows, as an empty table
does. ``deviation`` is null where it exceeds the range of long. Other input columns are
ignored.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from receiptlake.llm.common import short_batches

# How an entry becomes a whole number.
SCALE, SHIFT = 1024, 100_000
MOST = float(1 << 40)
NODES = 8
PER_INTERVAL = 4
ROUNDS = 40
# Rounds in which all pairs of an interval have to be at rounding.
POLISH = 3


def usable(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """Columns __id and __vector (doubles) of the rows with finite vectors of the commonest
    length, and that length (0 if there are none)."""
    vector = F.col("__vector")
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = df.select(F.col(id_col).alias("__id"), F.col(vector_col).cast("array<double>").alias("__vector"))
    rows = rows.filter(vector.isNotNull() & (F.size(vector) > 0) & ~bad)
    sizes = rows.groupBy(F.size(vector).alias("size")).count()
    commonest = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    d = commonest["size"] if commonest else 0
    return rows.filter(F.size(vector) == d), d


def whole(column: pa.Array, d: int) -> np.ndarray:
    """The rows of an Arrow list column as a matrix of whole numbers."""
    entries = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.floor(np.clip(entries * SCALE, -MOST, MOST)) + SHIFT


def _summed(rows: DataFrame, d: int, sums, count: int) -> np.ndarray:
    """The ``count`` numbers that ``sums`` (matrix of whole numbers to a vector) gives, added
    up over all rows: per task first, then by a shuffle of one row per task and number."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(count)
        for batch in batches:
            total += sums(whole(batch.column(0), d))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["place", "part"])

    parts = short_batches(rows).select("__vector").mapInArrow(of_task, "place bigint, part double")
    out = np.zeros(count)
    for row in parts.groupBy("place").agg(F.sum("part").alias("total")).collect():
        out[row["place"]] = row["total"]
    return out


@dataclass
class Moments:
    """n, a whole number near the mean of each dimension, what the sum exceeds n times that
    number by, and the covariance."""

    n: int
    near: np.ndarray
    rest: list[int]
    covariance: np.ndarray

    @property
    def shift(self) -> np.ndarray:
        """What the mean exceeds the whole number by."""
        return np.array([r / self.n for r in self.rest])


def moments(rows: DataFrame, d: int) -> Moments | None:
    """Of usable rows of ``d`` entries; None if there are none."""
    if not d:
        return None
    first = _summed(rows, d, lambda x: np.append(x.sum(axis=0), len(x)), d + 1)
    n = int(first[d])
    near = np.round(first[:d] / n)

    def products(x: np.ndarray) -> np.ndarray:
        y = x - near
        return np.concatenate([y.sum(axis=0), (y.T @ y).ravel()])

    second = _summed(rows, d, products, d + d * d)
    rest = [int(r) for r in second[:d]]
    shift = second[:d] / n
    covariance = second[d:].reshape(d, d) / n - np.outer(shift, shift)
    return Moments(n, near, rest, (covariance + covariance.T) / 2)


def above(matrix: np.ndarray, shift: float) -> int:
    """The number of eigenvalues above ``shift``: by Sylvester's law the positive pivots of
    the shifted matrix, pivoted by its largest entries (one or two at a time)."""
    a = matrix - shift * np.eye(len(matrix))
    count = 0
    while len(a):
        diagonal = np.abs(np.diag(a))
        i = int(diagonal.argmax())
        p, q = divmod(int(np.abs(a).argmax()), len(a))
        largest = abs(a[p, q])
        if largest == 0:
            return count
        if diagonal[i] >= 0.6404 * largest:  # (1 + sqrt 17) / 8 bounds the growth
            count += a[i, i] > 0
            chosen = [i]
        else:
            count += 1  # a pivot of two has a negative determinant: one of each sign
            chosen = [p, q]
        rest = np.delete(np.arange(len(a)), chosen)
        side = a[np.ix_(rest, chosen)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(a[np.ix_(chosen, chosen)], side.T)
        a = (a + a.T) / 2
    return int(count)


def intervals(matrix: np.ndarray, k: int, least: float) -> list[tuple[float, float, int]]:
    """(low, high, number of eigenvalues) from the top down, which hold the k greatest
    eigenvalues above ``least`` (or all of these). Cut until each holds a few, or cannot be
    cut since its eigenvalues agree."""
    top = float(np.abs(matrix).sum(axis=1).max()) * (1 + 1e-9) + least
    available = above(matrix, least)
    if not available:
        return []
    k = min(k, available)
    low, high = least, top
    for _ in range(100):  # the greatest low that has k above it
        middle = (low + high) / 2
        if high - low <= 1e-10 * top:
            break
        if above(matrix, middle) >= k:
            low = middle
        else:
            high = middle
    open_, done = [(low, top, above(matrix, low))], []
    while open_:
        a, b, count = open_.pop()
        middle = (a + b) / 2
        if count <= PER_INTERVAL or b - a <= 1e-8 * top:
            done.append((a, b, count))
            continue
        upper = above(matrix, middle) - above(matrix, b)
        open_ += [x for x in ((a, middle, count - upper), (middle, b, upper)) if x[2]]
    return sorted(done, reverse=True)


def ritz(matrix: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rayleigh-Ritz pairs of a subspace, by falling value."""
    q, _ = np.linalg.qr(basis)
    values, vectors = np.linalg.eigh(q.T @ matrix @ q)
    return values[::-1], (q @ vectors)[:, ::-1]


def filtered(matrix: np.ndarray, low: float, high: float, basis: np.ndarray) -> np.ndarray:
    """The projection of ``basis`` onto the eigenvectors of the interval, by quadrature of
    the resolvent along the upper half of the circle through both ends."""
    centre, radius = (low + high) / 2, (high - low) / 2
    points, weights = np.polynomial.legendre.leggauss(NODES)
    out = np.zeros_like(basis)
    unit = np.eye(len(matrix))
    for point, weight in zip(points, weights):
        turn = np.exp(-0.5j * np.pi * (point - 1))
        solved = np.linalg.solve((centre + radius * turn) * unit - matrix, basis.astype(complex))
        out += weight / 2 * np.real(radius * turn * solved)
    return out


def feast(matrix: np.ndarray, low: float, high: float, count: int, seed: int = 5) -> np.ndarray:
    """The ``count`` eigenvectors of an interval, as inertia has counted them. The subspace
    grows where rounds of it do not find them, at last to all dimensions."""
    d, scale = len(matrix), np.linalg.norm(matrix)
    wide = (high - low) * 1e-3
    rng = np.random.default_rng(seed)
    size = min(d, count + max(4, count // 2))
    while size < d:
        basis, good = rng.normal(size=(d, size)), 0
        for _ in range(ROUNDS):
            values, vectors = ritz(matrix, filtered(matrix, low - wide, high + wide, basis))
            off = np.linalg.norm(matrix @ vectors - vectors * values, axis=0)
            # A pair that is no eigenpair may lie inside; its residual tells.
            found = (values > low) & (values <= high) & (off <= 1e-14 * scale * d)
            good = good + 1 if found.sum() == count else 0
            if good == POLISH:
                return vectors[:, found]
            basis = vectors
        size = min(d, 2 * size)
    _, vectors = ritz(matrix, rng.normal(size=(d, d)))
    first = above(matrix, high)
    return vectors[:, first : first + count]


def components(covariance: np.ndarray, k: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenvalues above rounding, and their unit eigenvectors as columns. The
    sign of each makes its largest entry positive."""
    d = len(covariance)
    trace = float(np.trace(covariance))
    least = max(trace, 0.0) * d * 1e-13
    found = intervals(covariance, k, least) if trace > 0 else []
    if not found:
        return np.zeros(0), np.zeros((d, 0))
    basis = np.concatenate([feast(covariance, *interval) for interval in found], axis=1)
    values, vectors = ritz(covariance, basis)
    if len(values) != sum(count for _, _, count in found):
        raise ArithmeticError("the number of components is not the one that inertia counts")
    values, vectors = values[:k], vectors[:, :k]
    margin = 1e-9 * trace
    if above(covariance, values[-1] + margin) > len(values) or above(covariance, values[-1] - margin) < len(values):
        raise ArithmeticError("inertia counts components that were not found")
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))]
    return values, vectors * np.sign(largest)


def deviations(y: np.ndarray, n: int, rest: list[int]) -> list[int | None]:
    """Per row the sum of (n x - S)^2 = (n y - rest)^2, y being x less the whole number next
    to the mean. Exact; None beyond the range of long."""
    about = ((n * y - np.array(rest, dtype=np.float64)) ** 2).sum(axis=1)
    out: list[int | None] = [None] * len(y)
    sure = about < 2.0**62
    off = n * y[sure].astype(np.int64) - np.array(rest, dtype=np.int64)
    for place, value in zip(np.flatnonzero(sure), (off * off).sum(axis=1).tolist()):
        out[place] = value
    for place in np.flatnonzero(~sure & (about < 2.0**63 * 1.001)):
        value = sum((n * int(c) - r) ** 2 for c, r in zip(y[place], rest))
        out[place] = value if value < 2**63 else None
    return out


def whiten(
    df: DataFrame, k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per usable vector and component: ``id_col``, component (from 1), n, deviation,
    whitened, explained, identity_error. The last is measured on the whitened numbers of all
    rows, not derived from the fit."""
    rows, d = usable(df, id_col, vector_col)
    kind = df.schema[id_col].dataType.simpleString()
    shape = (
        f"`{id_col}` {kind}, component int, n bigint, deviation bigint, whitened double, "
        "explained double, identity_error double"
    )
    found = moments(rows, d)
    if found is None:
        return df.sparkSession.createDataFrame([], shape)
    values, vectors = components(found.covariance, k)
    k = len(values)
    if not k:
        return df.sparkSession.createDataFrame([], shape)
    near, rest, shift, n = found.near, found.rest, found.shift, found.n
    map_ = vectors / np.sqrt(values)

    def project(x: np.ndarray) -> np.ndarray:
        return (x - near - shift) @ map_

    def spread(x: np.ndarray) -> np.ndarray:
        w = project(x)
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    total = _summed(rows, d, spread, k + k * k)
    mean = total[:k] / n
    error = float(np.abs(total[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    explained = values / np.trace(found.covariance)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole(batch.column(1), d)
            m = len(x)
            each = np.repeat(np.arange(m), k)
            number = np.tile(np.arange(k), m)
            columns = [
                batch.column(0).take(pa.array(each)),
                pa.array(number + 1, pa.int32()),
                pa.array(np.full(m * k, n, np.int64)),
                pa.array(deviations(x - near, n, rest), pa.int64()).take(pa.array(each)),
                pa.array(project(x).ravel()),
                pa.array(explained[number]),
                pa.array(np.full(m * k, error)),
            ]
            names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return short_batches(rows).select("__id", "__vector").mapInArrow(out, shape)
