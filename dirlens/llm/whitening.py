"""Whitening of embeddings by QDWH spectral divide and conquer.

1. Entries become integers, x = floor(64 c) + 1000000. One pass sums up each dimension (exact longs), a second one the
   products of entries that are centred at the integer nearest the mean; what is left of the mean (half at most) is
   taken off after, so the covariance is as good as exact. Tasks send sums of dimensions and of their pairs alone.
2. The covariance V (dimensions squared, whatever the rows) is split on the driver: the polar factor of V - shift, by
   the dynamically weighted Halley iteration, has eigenvalues -1 and 1, so (U + I) / 2 projects onto the components
   above the shift. An orthonormal basis of either side turns V into two smaller blocks, and so on to single components.
3. Components are sent to all tasks, which whiten their rows; a pass over all rows measures how far the covariance of
   what they give is from the identity.

Nulls: a null vector, and one that holds a null, non-finite or unrepresentable entry (2^40 or more in size), takes no
part. Neither does a vector of another length than most have (of several such lengths, the longest). A null vec_id is
carried. Repeated rows count, and are told, once each. Equal eigenvalues have any basis of their space. A component
without variance (constant dimensions, fewer rows than dimensions) has a null `whitened` and no part in identity_error,
which is null if there is no other one. A deviation beyond a long is null. An empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET, MOST_COMPONENTS, LARGEST = 64.0, 1_000_000, 32, 2.0**40
ROWS = 8192
_EPS = np.finfo(np.float64).eps


def integers(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the column, their vectors as integers), for each length that usable vectors of it have."""
    column = column.cast(pa.large_list(pa.float64()))
    flat = column.flatten()
    good = np.isfinite(flat.to_numpy(zero_copy_only=False)) & (np.abs(flat.to_numpy(zero_copy_only=False)) < LARGEST)
    values = flat.to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    bad = np.concatenate([[0], np.cumsum(~good)])
    usable = (sizes > 0) & (bad[ends] == bad[ends - sizes])
    for size in np.unique(sizes[usable]):
        at = np.flatnonzero(usable & (sizes == size))
        taken = values[(ends[at] - size)[:, None] + np.arange(size)]
        yield at, np.floor(SCALE * taken).astype(np.int64) + OFFSET


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            yield batch.slice(a, ROWS)


def sums(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """How many vectors have the most frequent length, and the sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in _slices(batches):
            for _, x in integers(batch.column(1)):
                told = np.concatenate([x.sum(axis=0), [len(x)]])
                own[x.shape[1]] = own.get(x.shape[1], 0) + told
        for size, told in own.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size + 1, size)), pa.array(np.arange(size + 1)), pa.array(told)], ["size", "dim", "total"])

    told = vectors.mapInArrow(run, "size long, dim long, total long").groupBy("size", "dim").agg(F.sum("total").alias("total"))
    numbers = told.where("dim = size").orderBy(F.desc("total"), F.desc("size")).limit(1).collect()
    if not numbers:
        return 0, np.zeros(0, np.int64)
    size, n = numbers[0]["size"], numbers[0]["total"]
    rows = told.where((F.col("size") == size) & (F.col("dim") < size)).collect()  # a number per dimension
    out = np.zeros(size, np.int64)
    for r in rows:
        out[r["dim"]] = r["total"]
    return n, out


def products(vectors: DataFrame, of, size: int) -> np.ndarray:
    """The sum over all vectors of outer(y, y), for the rows y that `of` makes of the integer vectors."""
    low = np.tril_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((size, size))
        for batch in _slices(batches):
            for _, x in integers(batch.column(1)):
                y = of(x)
                if y is not None:
                    own += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(low[0]), pa.array(low[1]), pa.array(own[low])], ["i", "j", "total"])

    out = np.zeros((size, size))
    for r in vectors.mapInArrow(run, "i long, j long, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect():  # a number per pair of dimensions
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["total"]
    return out


def covariance(vectors: DataFrame, n: int, total: np.ndarray) -> np.ndarray:
    """The covariance of the integer vectors, divisor n."""
    size = len(total)
    centre = np.array([(2 * int(s) + n) // (2 * n) for s in total], np.int64)
    left = np.array([(int(s) - n * int(c)) / n for s, c in zip(total, centre, strict=True)])
    found = products(vectors, lambda x: (x - centre).astype(np.float64) if x.shape[1] == size else None, size)
    return found / n - np.outer(left, left)


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QDWH: QR steps while the weights are large, then Cholesky."""
    n = len(a)
    x = a / (np.abs(a).sum(axis=1).max() or 1.0)
    low = _EPS / n
    for _ in range(30):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        wa = np.sqrt(1 + d) + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + d)), 0))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        before = x
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
            x = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:n] @ q[n:].T
        else:
            w = np.linalg.cholesky(np.eye(n) + wc * x.T @ x)
            x = wb / wc * x + (wa - wb / wc) * np.linalg.solve(w.T, np.linalg.solve(w, x.T)).T
        x = (x + x.T) / 2
        low = min(low * (wa + wb * low**2) / (1 + wc * low**2), 1.0)
        if 1 - low < 1e-15 and np.abs(x - before).max() < _EPS ** (1 / 3):
            break
    return x


def _divided(v: np.ndarray, scale: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of two invariant subspaces of v, parted by a shift between their eigenvalues; None if all are equal."""
    n = len(v)
    middle = np.trace(v) / n
    spread = np.abs(v - middle * np.eye(n)).max()
    if spread <= 4 * n * _EPS * scale:
        return None
    tries = [float(np.median(np.diag(v))), float(middle)]
    tries += [float(middle + spread * t) for t in rng.uniform(-0.5, 0.5, 20)]
    for shift in tries:
        u = polar(v - shift * np.eye(n))
        k = round((np.trace(u) + n) / 2)
        if not 0 < k < n or np.abs(u @ u - np.eye(n)).max() > 1e-10:
            continue  # no eigenvalue on one side, or one at the shift
        up = (u + np.eye(n)) / 2
        q = np.hstack([up @ rng.standard_normal((n, k)), rng.standard_normal((n, n - k)) - up @ rng.standard_normal((n, n - k))])
        for _ in range(2):
            q, _ = np.linalg.qr(np.hstack([up @ q[:, :k], q[:, k:] - up @ q[:, k:]]))
        if np.abs(q[:, :k].T @ v @ q[:, k:]).max() <= 64 * n * _EPS * scale:
            return q[:, :k], q[:, k:]
    return None  # eigenvalues that no shift parts differ by rounding alone


def components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of a symmetric matrix, by falling eigenvalue."""
    rng, scale = np.random.default_rng(3), float(np.abs(v).max())
    found: list[np.ndarray] = []
    todo = [np.eye(len(v))] if len(v) else []
    while todo:
        basis = todo.pop()
        block = basis.T @ v @ basis
        parts = _divided((block + block.T) / 2, scale, rng) if basis.shape[1] > 1 else None
        if parts is None:
            found.append(basis)
        else:
            todo += [np.linalg.qr(basis @ q)[0] for q in parts]
    vectors = np.hstack(found) if found else np.zeros((0, 0))
    vectors, r = np.linalg.qr(vectors)
    vectors = vectors * np.sign(np.diag(r))
    values = np.einsum("ij,ij->j", vectors, v @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, most: int = MOST_COMPONENTS) -> DataFrame:
    """A row for each usable vector and component."""
    spark = embeddings.sparkSession
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    n, total = sums(vectors)
    if not n:
        return spark.createDataFrame([], _OUT)
    size, v = len(total), covariance(vectors, n, total)
    values, axes = components(v)
    k = min(most, size)
    real = values[:k] > 4 * size * _EPS * max(values[0], 0)
    told = values[:k] / np.trace(v) if np.trace(v) > 0 else np.zeros(k)
    scaled = np.where(real, axes[:, :k] / np.sqrt(np.where(real, values[:k], 1)), 0)
    whole = np.array([int(s) // n for s in total], np.int64)
    part = np.array([(int(s) % n) / n for s in total])
    sent = spark.sparkContext.broadcast((scaled, whole, part, total, real, told))  # dimensions x components

    def project(x: np.ndarray) -> np.ndarray | None:
        scaled, whole, part, *_ = sent.value
        return ((x - whole) - part) @ scaled if x.shape[1] == size else None

    error = float(np.abs(products(vectors, project, k) / n - np.eye(k))[np.ix_(real, real)].max()) if real.any() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *_, total, real, told = sent.value
        for batch in _slices(batches):
            for at, x in integers(batch.column(1)):
                w = project(x)
                if w is None:
                    continue
                rows = len(x)
                off = n * x - total  # wraps beyond a long, as do the squares; sums that fit one are exact all the same
                near = ((x - total / n) ** 2).sum(axis=1) * float(n) ** 2
                deviation = pa.array((off * off).sum(axis=1), mask=near >= 2.0**63)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(at, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                        pa.array(np.full(rows * k, n, np.int64)),
                        deviation.take(pa.array(np.repeat(np.arange(rows), k))),
                        pa.array(w.ravel(), mask=np.tile(~real, rows)),
                        pa.array(np.tile(told, rows)),
                        pa.array([error] * (rows * k), pa.float64()),
                    ],
                    [c.split()[0] for c in _OUT.split(", ")],
                )

    return vectors.mapInArrow(run, _OUT)
