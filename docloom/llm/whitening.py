"""Whitening of embeddings: streamed covariance, symmetric QR, projection.

Each task streams its vectors through Welford's recurrence: the mean moves by a part of the
deviation, and the co-moments grow by a rank-one matrix. States are merged by the parallel formula,
FAN_IN at a time, so that no task and no driver holds more than that many matrices of the
dimension's size. The driver solves one matrix: Householder reflections make it tridiagonal, and QR
steps with Wilkinson's shift make it diagonal. Rows then go through the components in their own
tasks. What the whitened rows' covariance lacks to the identity is measured on the rows, by the
same streaming, and not derived from the matrix.

The table is read three times; nothing but states travels.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.scratch import Scratch

#: States that one task merges.
FAN_IN = 16
#: A component whose part of the variance is under this has no direction of its own in double precision.
LEAST_PART = 1e-13
_STATE = "task long, space int, n long, sums binary, mean binary, moments binary"


@dataclass
class Moments:
    """n, the exact sums, the mean, and the sum of outer products of deviations from it."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    moments: np.ndarray

    @classmethod
    def none(cls, dim: int) -> Moments:
        return cls(0, np.zeros(dim, np.int64), np.zeros(dim), np.zeros((dim, dim)))

    def add(self, rows: np.ndarray) -> None:
        """Welford's recurrence, a rank-one update for each row."""
        for x in rows:
            self.n += 1
            before = x - self.mean
            self.mean += before / self.n
            # the product is symmetric: before and after are parallel
            self.moments += np.multiply.outer(before, before * ((self.n - 1) / self.n))

    def merge(self, other: Moments) -> None:
        """The parallel update formula."""
        n = self.n + other.n
        if not n:
            return
        apart = other.mean - self.mean
        self.moments += other.moments + np.multiply.outer(apart, apart * (self.n * other.n / n))
        self.mean += apart * (other.n / n)
        self.sums += other.sums
        self.n = n


def _batch(states: list[tuple[int, int, Moments]]) -> pa.RecordBatch:
    columns = zip(*[(task, space, m.n, m.sums.tobytes(), m.mean.tobytes(), m.moments.tobytes()) for task, space, m in states], strict=True) if states else [[]] * 6
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["task", "space", "n", "sums", "mean", "moments"])


def _read(row: dict) -> Moments:
    whole = lambda name, kind: np.frombuffer(row[name], kind).copy()
    sums = whole("sums", np.int64)
    return Moments(row["n"], sums, whole("mean", np.float64), whole("moments", np.float64).reshape(len(sums), len(sums)))


def _matrices(batch: pa.RecordBatch, at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) of a batch for each length that its vectors have."""
    lists = batch.column(at)
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    length = np.diff(offsets)
    for dim in np.unique(length).tolist():
        rows = np.flatnonzero(length == dim)
        yield rows, values[offsets[:-1][rows][:, None] + np.arange(dim)]


def moments(vectors: DataFrame, column: str, scratch: Scratch, name: str, of: Callable[[np.ndarray], np.ndarray] | None = None) -> dict[int, Moments]:
    """Moments of the vectors of each length, of whole numbers or, with of, of what that makes of a matrix of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found: dict[int, Moments] = {}
        for batch in batches:
            for _, rows in _matrices(batch, 0):
                made = of(rows) if of else rows
                if made is None or not len(made):
                    continue
                state = found.setdefault(rows.shape[1], Moments.none(made.shape[1]))
                state.add(made)
                if not of:
                    state.sums += rows.astype(np.int64).sum(0)
        yield _batch([(TaskContext.get().partitionId(), space, m) for space, m in found.items()])

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        rows.sort(key=lambda r: r["task"])
        state = _read(rows[0])
        for row in rows[1:]:
            state.merge(_read(row))
        return pa.Table.from_batches([_batch([(rows[0]["task"] // FAN_IN, rows[0]["space"], state)])])

    states = scratch.keep(vectors.select(column).mapInArrow(run, _STATE), name)
    level = 0
    while states.groupBy("space").count().where(F.col("count") > 1).limit(1).count():
        level += 1
        states = scratch.keep(states.withColumn("group", F.floor(F.col("task") / FAN_IN)).groupBy("space", "group").applyInArrow(merge, _STATE), f"{name}{level}")
    return {row["space"]: _read(row.asDict()) for row in states.collect()}  # one row for each length of vectors


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, beside it, q) with q' matrix q tridiagonal, by Householder reflections."""
    a = matrix.astype(np.float64).copy()
    n = len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = math.sqrt(x @ x)
        if size == 0 or size == abs(x[0]):
            continue
        x[0] += math.copysign(size, x[0])
        x /= math.sqrt(x @ x)
        part = a[k + 1 :, k:]
        part -= 2 * np.multiply.outer(x, x @ part)
        part = a[k:, k + 1 :]
        part -= 2 * np.multiply.outer(part @ x, x)
        part = q[:, k + 1 :]
        part -= 2 * np.multiply.outer(part @ x, x)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as rows) of a symmetric matrix, by falling eigenvalue.

    Symmetric QR: implicit steps on the tridiagonal form, shifted by the eigenvalue of the last two
    rows that is nearest the last entry. Of each vector the entry of largest size is positive."""
    if not len(matrix):
        return np.zeros(0), np.zeros((0, 0))
    d, e, q = tridiagonal(matrix)
    q = q.T.copy()  # rows, so that a rotation touches two of them
    low_part = np.finfo(np.float64).eps
    hi, turns = len(d) - 1, 0
    while hi > 0:
        small = np.abs(e[:hi]) <= low_part * (np.abs(d[:hi]) + np.abs(d[1 : hi + 1]))
        e[:hi][small] = 0
        if e[hi - 1] == 0:
            hi -= 1
            continue
        turns += 1
        if turns > 60 * len(d):
            raise ArithmeticError("the QR steps do not settle")
        zero = np.flatnonzero(e[:hi] == 0)
        lo = int(zero[-1]) + 1 if len(zero) else 0
        half, beside = (d[hi - 1] - d[hi]) / 2, e[hi - 1]
        shift = d[hi] - beside * beside / (half + math.copysign(math.hypot(half, beside), half))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            size = math.hypot(x, z)
            c, s = (x / size, z / size) if size else (1.0, 0.0)
            if k > lo:
                e[k - 1] = size
            a, b, m = d[k], d[k + 1], e[k]
            d[k] = c * c * a + 2 * c * s * m + s * s * b
            d[k + 1] = s * s * a - 2 * c * s * m + c * c * b
            e[k] = (c * c - s * s) * m + c * s * (b - a)
            x = e[k]
            if k + 1 < hi:
                z = s * e[k + 1]
                e[k + 1] *= c
            upper = c * q[k] + s * q[k + 1]
            q[k + 1] = c * q[k + 1] - s * q[k]
            q[k] = upper
    order = np.argsort(-d, kind="stable")
    q = q[order]
    q *= np.where(q[np.arange(len(q)), np.abs(q).argmax(1)] < 0, -1.0, 1.0)[:, None]
    return d[order], q


@dataclass
class _Fit:
    """What rows of one length need: n, the sums, the mean, the projections (over the root of the
    eigenvalue) and the explained parts."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    project: np.ndarray
    explained: np.ndarray


def _fit(m: Moments, most: int) -> _Fit:
    covariance = m.moments / m.n
    covariance = (covariance + covariance.T) / 2
    values, vectors = eigen(covariance)
    trace = float(np.trace(covariance))
    use = int((values[:most] > LEAST_PART * trace).sum()) if trace > 0 else 0
    return _Fit(m.n, m.sums, m.mean, vectors[:use] / np.sqrt(values[:use])[:, None], values[:use] / trace if use else values[:0])


def _deviations(rows: np.ndarray, fit: _Fit) -> list[int]:
    """The exact sum of (n x - sum)^2 over the entries of each row."""
    apart = rows.astype(np.int64) * fit.n - fit.sums if fit.n * (np.abs(rows).max(initial=0) + 1) < 2**62 else None
    if apart is not None and float(np.abs(apart).max(initial=0)) ** 2 * max(1, rows.shape[1]) < 2**62:
        return (apart * apart).sum(1).tolist()
    sums = fit.sums.tolist()
    return [sum((fit.n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in rows.tolist()]


def whiten(vectors: DataFrame, most: int = 32, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and
    component, up to most of them.

    Rows whose vector is null or holds a null or a non-finite entry are dropped. Entries count as
    floor(64 c), shifted by a constant that no result depends on. Vectors of another length are
    another space, with a fit of their own; empty ones have no components. Components of no variance
    (one row, equal rows, fewer rows than dimensions) cannot be whitened and are left out. deviation
    is null where it is no 64-bit number. A null id is carried; rows that repeat count as rows; an
    empty table gives an empty result. Other columns play no part.
    """
    scratch = Scratch(vectors.sparkSession, "whitening")
    whole = F.transform(F.col(f"`{embedding}`"), lambda c: F.floor(c.cast("double") * 64).cast("long"))
    good = F.forall(f"`{embedding}`", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = vectors.where(F.col(f"`{embedding}`").isNotNull() & good).select(F.col(f"`{vec_id}`").alias("vec_id"), whole.alias("x"))
    rows = scratch.keep(rows, "whole")
    fits = {dim: _fit(m, most) for dim, m in moments(rows, "x", scratch, "moments").items()}

    def project(made: np.ndarray) -> np.ndarray | None:
        fit = fits[made.shape[1]]
        return (made - fit.mean) @ fit.project.T if len(fit.project) else None

    found = moments(rows, "x", scratch, "check", project)
    errors = {dim: float(np.abs(m.moments / m.n - np.eye(len(m.mean))).max()) for dim, m in found.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, made in _matrices(batch, 1):
                fit = fits[made.shape[1]]
                k = len(fit.project)
                if not k:
                    continue
                out = project(made)
                exact = [v if v < 2**63 else None for v in _deviations(made, fit)]
                of = np.repeat(np.arange(len(at)), k)
                ids = batch.column(0).take(pa.array(at[of]))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(len(of), fit.n)), pa.array(exact, pa.int64()).take(pa.array(of)), pa.array(out.ravel()), pa.array(np.tile(fit.explained, len(at))), pa.array(np.full(len(of), errors[made.shape[1]]))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
