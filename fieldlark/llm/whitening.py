"""Embedding whitening: sums and a covariance by Spark, its leading eigenvectors by spectrum slicing.

The driver holds one matrix of dimensions by dimensions. LDL' inertia counts of the shifted matrix tell how many
eigenvalues exceed a shift; bisection on counts isolates each leading eigenvalue, Rayleigh quotient iteration converges to it
cubically, and counts on both sides of it certify its number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OFFSET, STEPS = 1_000_000, 64
#: Rows that are multiplied at once; what floor(64 c) stays below, so that x and n x fit where they are made.
ROWS, LARGEST = 4096, 2.0**62


def inertia(matrix: np.ndarray, shift: float) -> tuple[int, int, int]:
    """(eigenvalues above ``shift``, at it, below it): signs of D in LDL' of the shifted matrix, with complete pivoting (1 by 1 and 2 by 2)."""
    m = matrix - shift * np.eye(len(matrix))
    n, k, above, below = len(m), 0, 0, 0
    least = (1 + np.sqrt(17)) / 8
    while k < n:
        rest = np.abs(m[k:, k:])
        diagonal = rest.diagonal().copy()
        r = int(diagonal.argmax())
        np.fill_diagonal(rest, 0)
        i, j = divmod(int(rest.argmax()), n - k)
        if diagonal[r] == 0 and rest[i, j] == 0:
            break
        if diagonal[r] >= least * rest[i, j]:
            _swap(m, k, k + r)
            above, below = above + (m[k, k] > 0), below + (m[k, k] < 0)
            m[k + 1 :, k + 1 :] -= np.outer(m[k + 1 :, k] / m[k, k], m[k, k + 1 :])
            k += 1
        else:  # a 2 by 2 pivot here has a negative determinant
            i, j = min(i, j), max(i, j)
            _swap(m, k, k + i)
            _swap(m, k + 1, k + j)
            above, below = above + 1, below + 1
            c = m[k + 2 :, k : k + 2]
            m[k + 2 :, k + 2 :] -= c @ np.linalg.solve(m[k : k + 2, k : k + 2], c.T)
            k += 2
    return int(above), n - int(above) - int(below), int(below)


def _swap(m: np.ndarray, a: int, b: int) -> None:
    if a != b:
        m[[a, b]] = m[[b, a]]
        m[:, [a, b]] = m[:, [b, a]]


def leading(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(the ``count`` largest eigenvalues that are not 0 to rounding, falling; their unit eigenvectors as columns).

    Eigenvalues that agree to rounding are one cluster: of it, any orthonormal vectors of its space.
    """
    d = len(matrix)
    bound = float(np.abs(matrix).sum(axis=1).max(initial=0))
    tiny = 8 * max(d, 1) * np.finfo(float).eps * bound
    if not bound:
        return np.zeros(0), np.zeros((d, 0))
    seen: dict[float, int] = {}

    def above(x: float) -> int:
        if x not in seen:
            seen[x] = inertia(matrix, x)[0]
        return seen[x]

    count = min(count, above(tiny))
    values, vectors = np.zeros(0), np.zeros((d, 0))
    while len(values) < count:
        found, many = len(values), 1
        lo, hi = tiny, min((values[-1] if found else bound) + 2 * tiny, bound + 2 * tiny)
        for x, n in seen.items():  # what earlier counts know of eigenvalue number found + 1
            lo, hi = (max(lo, x), hi) if n > found else (lo, min(hi, x))
        while hi - lo > tiny:
            one = above(lo) - found == 1
            if one and (pair := _rayleigh(matrix, (lo + hi) / 2, vectors, lo, hi, tiny)):
                e, v = pair
                if above(e - tiny) == found + 1 and above(e + tiny) == found:
                    break
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if above(mid) > found else (lo, mid)
        else:  # a cluster narrower than rounding
            many = above(lo) - found
            e, v = np.full(many, (lo + hi) / 2), _space(matrix, (lo + hi) / 2, many, vectors, tiny)
        values, vectors = np.append(values, e), np.column_stack([vectors, v])
    return values[:count], vectors[:, :count]


def _apart(v: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Orthonormal columns of what is apart from ``vectors``."""
    for _ in range(2):
        v = np.linalg.qr(v - vectors @ (vectors.T @ v))[0]
    return v


def _solved(matrix: np.ndarray, shift: float, v: np.ndarray, tiny: float) -> np.ndarray:
    for more in (0.0, 0.25, 0.5):
        try:
            return np.linalg.solve(matrix - (shift + more * tiny) * np.eye(len(matrix)), v)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
            continue
    raise np.linalg.LinAlgError("no shift near the eigenvalue could be solved")


def _rayleigh(matrix: np.ndarray, shift: float, vectors: np.ndarray, lo: float, hi: float, tiny: float) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration from inverse iteration at ``shift``; None if it leaves (lo, hi) or does not settle."""
    v = _apart(np.random.default_rng(7).standard_normal((len(matrix), 1)), vectors)
    for _ in range(2):
        v = _apart(_solved(matrix, shift, v, tiny), vectors)
    best = None
    for _ in range(12):
        e = float((v.T @ matrix @ v).item())
        if not lo - tiny <= e <= hi + tiny:
            return None
        error = float(np.abs(matrix @ v - e * v).max())
        if best and error >= best[0] / 2:  # no digit is gained any more
            break
        best = (error, e, v)
        v = _apart(_solved(matrix, e, v, tiny), vectors)
    return best[1:] if best[0] <= tiny else None


def _space(matrix: np.ndarray, shift: float, many: int, vectors: np.ndarray, tiny: float) -> np.ndarray:
    """Orthonormal vectors of a cluster's space, by inverse iteration of as many vectors."""
    v = _apart(np.random.default_rng(7).standard_normal((len(matrix), many)), vectors)
    for _ in range(4):
        v = _apart(_solved(matrix, shift, v, tiny), vectors)
    return v


@dataclass(frozen=True)
class Whitening:
    """What ``fit`` learns: vectors, their sums by dimension, e of each component, its unit vector (a column), trace of V, the identity error."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: both lose what all x have in common first, so that no digit is lost."""
        return (x - OFFSET).astype(float) - (self.sums - self.n * OFFSET).astype(float) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)


def _rows(vectors: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the rows that count, x of each of these rows)."""
    values, ends = vectors.flatten(), np.concatenate([[0], np.cumsum(vectors.value_lengths().fill_null(0).to_numpy())])
    entries = values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(np.diff(ends) == dims)
    c = entries[ends[at][:, None] + np.arange(dims)] if len(at) else np.zeros((0, dims))
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(c * STEPS)
    fine = (np.abs(scaled) < LARGEST).all(axis=1)
    return at[fine], scaled[fine].astype(np.int64) + OFFSET


def _over(vectors: pa.Array, dims: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for first in range(0, len(vectors), ROWS):
        at, x = _rows(vectors.slice(first, ROWS), dims)
        if len(at):
            yield first, at, x


def dimensions(embeddings: DataFrame, column: str = "embedding") -> int:
    """The most frequent length of the vectors without null and non-finite entries, the larger of equally frequent ones; 0 if there are none."""
    v = F.col(f"`{column}`")
    fine = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    most = embeddings.where(fine & (F.size(v) > 0)).groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return most["d"] if most else 0


def _gram(embeddings: DataFrame, column: str, dims: int, size: int, values) -> np.ndarray:
    """Sums of products of what ``values`` makes of each x, ``size`` numbers a row: partial ones by task, summed by cell."""
    upper = np.triu_indices(size)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for part in parts:
            for _, _, x in _over(part.column(0), dims):
                z = values(x)
                total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(upper[0]), pa.array(upper[1]), pa.array(total[upper])], ["i", "j", "v"])

    cells = embeddings.select(F.col(f"`{column}`")).mapInArrow(batches, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((size, size))
    for i, j, v in cells.collect():  # one row a cell of the matrix
        out[i, j] = out[j, i] = v
    return out


def fit(embeddings: DataFrame, count: int = 32, column: str = "embedding") -> Whitening:
    """The ``count`` leading components of the covariance of all vectors that count (see ``whiten``), divisor n.

    Four passes over one column: the dimension, exact sums, the covariance of centred vectors, the covariance of the whitened ones, from which
    the largest entry beside the identity is the error. The driver gets sums of dimensions squared.
    """
    dims = dimensions(embeddings, column)

    def sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, object)
        for part in parts:
            for _, at, x in _over(part.column(0), dims):
                n, total = n + len(at), total + (x if np.abs(x).max() < 1 << 50 else x.astype(object)).sum(axis=0)
        cells = [n, *map(int, total)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dims)), pa.array([c >> 32 for c in cells]), pa.array([c & 0xFFFFFFFF for c in cells])], ["i", "high", "low"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    cells = embeddings.select(F.col(f"`{column}`")).mapInArrow(sums, "i long, high long, low long").groupBy("i").agg(exact("high"), exact("low")) if dims else None
    found = {i: (int(high) << 32) + int(low) for i, high, low in cells.collect()} if dims else {}
    n = found.get(-1, 0)
    empty = Whitening(n, np.array([found[i] for i in range(dims)] if n else [0] * dims), np.zeros(0), np.zeros((dims, 0)), 0.0, 0.0)
    if not n:
        return empty
    g = _gram(embeddings, column, dims, dims + 1, lambda x: np.column_stack([empty.centred(x), np.ones(len(x))])) / n
    v, mean = g[:dims, :dims], g[:dims, dims]  # the mean of the centred vectors is 0 to rounding
    values, vectors = leading(v, count)
    made = Whitening(n, empty.sums, values, vectors, float(v.trace()), 0.0)
    if not len(values):
        return made
    rest = mean @ vectors / np.sqrt(values)
    covariance = _gram(embeddings, column, dims, len(values), lambda x: made.whitened(x) - rest) / n
    return Whitening(n, made.sums, values, vectors, made.trace, float(np.abs(covariance - np.eye(len(values))).max()))


def whiten(embeddings: DataFrame, model: Whitening, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(``key``, component, n, deviation, whitened, explained, identity_error) of each row that counts and each component.

    A row counts if its vector is not null, has the model's dimension and holds neither nulls nor non-finite entries; an
    entry of 2^56 or more counts as non-finite, as its x may be no long. An entry c becomes x = floor(64 c) + 1,000,000. Repeated rows
    and null keys count and are returned as often as they are there. Components are numbered from 1 by falling eigenvalue; those whose
    eigenvalue is 0 to rounding are left out, as they cannot be scaled to 1, so equal vectors give no rows. deviation is the exact sum
    of (n x - S)^2 over the dimensions, null where it exceeds a long. An empty table gives no rows. Other columns are not read.
    """
    dims, k, n = len(model.sums), len(model.values), model.n
    share = model.values / model.trace if k else model.values
    kind = embeddings.schema[key].dataType
    far = np.abs(np.array([int(s) for s in model.sums], object) - n * OFFSET).max(initial=0)

    def deviations(x: np.ndarray) -> pa.Array:
        if dims * (n * int(np.abs(x - OFFSET).max()) + int(far)) ** 2 < 1 << 63:
            return pa.array((((x - OFFSET) * n - (model.sums - n * OFFSET)) ** 2).sum(axis=1))
        exact = ((x.astype(object) * n - model.sums.astype(object)) ** 2).sum(axis=1)
        return pa.array([int(e) if e < 1 << 63 else None for e in exact], pa.int64())

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for first, at, x in _over(part.column(1), dims) if k else ():
                rows = pa.array(np.repeat(at + first, k))
                m = len(at)
                columns = [part.column(0).take(rows), np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, n), deviations(x).take(pa.array(np.repeat(np.arange(m), k))), model.whitened(x).ravel(), np.tile(share, m), np.full(m * k, model.error)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [key, *_NAMES])

    schema = f"`{key}` {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return embeddings.select(F.col(f"`{key}`"), F.col(f"`{column}`")).mapInArrow(batches, schema)


_NAMES = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
