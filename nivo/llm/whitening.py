"""Whitening of embeddings: blockwise QR, bidiagonal qd iteration, twisted factorisations."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, LongType

from nivo.llm.shared import Scratch, fresh, workers_find_package
from nivo.llm.vectors import matrix, scaled, usable

OFFSET = 100_000
#: Triangles a task merges at once.
FAN_IN = 32
EPS = np.finfo(float).eps


class Fit(NamedTuple):
    """Whitening of the vectors of one length: ``axes`` has a unit direction per row, ``variances`` fall."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    variances: np.ndarray
    total: float

    @property
    def scales(self) -> np.ndarray:
        """Standard deviations; 0 for directions without variance beyond rounding."""
        least = len(self.sums) * EPS * self.n * self.variances[:1].max(initial=0.0)
        return np.sqrt(np.where(self.variances > least, self.variances, 0.0))


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder reflections from both sides: diagonal, superdiagonal and ``v`` with ``u.T @ r @ v`` bidiagonal."""
    a, d = r.astype(float).copy(), r.shape[1]
    v = np.eye(d)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.abs(x).max(initial=0.0)
        if len(x) < 2 or size == 0.0 or not np.any(x[1:]):
            return None
        w = x / size
        w[0] += np.copysign(np.linalg.norm(w), w[0])
        return w / np.linalg.norm(w)

    for k in range(d):
        if (w := reflector(a[k:, k])) is not None:
            a[k:, k:] -= 2.0 * np.outer(w, w @ a[k:, k:])
        if k + 1 < d and (w := reflector(a[k, k + 1 :])) is not None:
            a[k:, k + 1 :] -= 2.0 * np.outer(a[k:, k + 1 :] @ w, w)
            v[:, k + 1 :] -= 2.0 * np.outer(v[:, k + 1 :] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def dqds(diagonal: np.ndarray, superdiagonal: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix, falling, by shifted differential quotient differences.

    Each sweep subtracts a shift below the least value left, never adding what must cancel, so that
    small values come out to high relative accuracy. A sweep that would lose positivity is
    done again with a smaller shift.
    """
    found: list[float] = []
    todo = [(diagonal.astype(float) ** 2, superdiagonal.astype(float) ** 2, 0.0)]
    while todo:
        q, e, shift = todo.pop()
        lower = 0.0
        while len(q):
            if len(q) == 1:
                found.append(q[0] + shift)
                break
            # Off-diagonals without weight split the matrix; the parts go on by themselves.
            none = e <= (EPS * EPS) * (q[:-1] + shift)
            none |= e <= (EPS * EPS) * (q[1:] + shift)
            if none.any():
                at = int(np.flatnonzero(none)[-1])
                todo.append((q[: at + 1], e[:at], shift))
                q, e = q[at + 1 :], e[at + 1 :]
                lower = 0.0
                continue
            if 1.5 * q[0] < q[-1]:
                q, e = q[::-1].copy(), e[::-1].copy()
                lower = 0.0
            tail = _smaller(q[-2] + (e[-2] if len(q) > 2 else 0.0), q[-1] + e[-1], q[-2] * e[-1])
            step = max(0.0, min(tail, q[-1], lower if lower > 0.0 else tail) * (1.0 - 1e-3))
            while True:
                swept = _sweep(q, e, step)
                if swept is not None or step == 0.0:
                    break
                step = step / 4.0 if step > 1e-300 and step / 4.0 > EPS * q.max() * 1e-3 else 0.0
            q, e, lower = swept
            shift += step
    return np.sort(np.array(found))[::-1]


def _smaller(a: float, c: float, b2: float) -> float:
    """The smaller eigenvalue of [[a, b], [b, c]] for ``b2 = b * b``."""
    half = (a + c) / 2.0
    root = np.sqrt(((a - c) / 2.0) ** 2 + b2)
    return max(0.0, (a * c - b2) / (half + root)) if half + root > 0.0 else 0.0


def _sweep(q: np.ndarray, e: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray, float] | None:
    """One differential transform by ``step``, with the least intermediate; None where that would be negative."""
    new_q, new_e = np.empty_like(q), np.empty_like(e)
    d = least = q[0] - step
    for i in range(len(e)):
        if d < 0.0:
            return None
        new_q[i] = d + e[i]
        ratio = q[i + 1] / new_q[i] if new_q[i] > 0.0 else 1.0
        new_e[i] = e[i] * ratio
        d = d * ratio - step
        least = min(least, d)
    if d < 0.0:
        return None
    new_q[-1] = d
    return new_q, new_e, least


def twisted(alpha: np.ndarray, beta: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of a symmetric tridiagonal matrix for its ``values``, which fall.

    The factorisation from the top and that from the bottom are joined where their pivots leave least
    (the twist), and the vector is read off from there by products only. Vectors of values too
    close to be told apart are made orthogonal; where nothing is left of one, the next best
    twist is taken.
    """
    d, size = len(alpha), max(np.abs(alpha).max(initial=0.0), np.abs(beta).max(initial=0.0), 1e-100)
    tiny = EPS * EPS * size
    out = np.zeros((d, len(values)))
    for k, value in enumerate(values):
        moved = alpha - value
        down, up = np.empty(d), np.empty(d)
        down[0], up[-1] = moved[0], moved[-1]
        for i in range(1, d):
            down[i - 1] = down[i - 1] if abs(down[i - 1]) > tiny else tiny
            down[i] = moved[i] - beta[i - 1] ** 2 / down[i - 1]
        for i in range(d - 2, -1, -1):
            up[i + 1] = up[i + 1] if abs(up[i + 1]) > tiny else tiny
            up[i] = moved[i] - beta[i] ** 2 / up[i + 1]
        left = np.abs(down + up - moved)
        close = [j for j in range(k) if values[j] - value <= 1e-3 * max(abs(values[j]), tiny)]
        for twist in np.argsort(left, kind="stable"):
            z = np.zeros(d)
            z[twist] = 1.0
            for i in range(twist - 1, -1, -1):
                z[i] = -(beta[i] / down[i]) * z[i + 1]
            for i in range(twist, d - 1):
                z[i + 1] = -(beta[i] / up[i + 1]) * z[i]
            z /= np.linalg.norm(z)
            for _ in range(2):
                z -= out[:, close] @ (out[:, close].T @ z)
            if (rest := np.linalg.norm(z)) > 1e-2:
                break
        out[:, k] = z / rest
    return out


def axes_of(r: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values of a triangle, falling, and the right singular vectors (rows) of the first ones.

    The sign is such that the largest entry (the first of equal ones) is positive.
    """
    size = np.abs(r).max(initial=0.0) or 1.0
    a, b, v = bidiagonal(r / size)
    squares = dqds(a, b)
    alpha = a * a
    alpha[1:] += b * b
    found = (v @ twisted(alpha, a[:-1] * b, squares[:components])).T
    found, _ = np.linalg.qr(found.T)  # Leaves orthogonal vectors as they are, up to sign and rounding.
    found = found.T
    strongest = found[np.arange(len(found)), np.abs(found).argmax(axis=1)]
    return squares * size * size, found * np.where(strongest < 0, -1.0, 1.0)[:, None]


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """``x - sums / n``: the whole part is taken off exactly, before rounding."""
    base = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([(s - n * (s // n)) / n for s in sums])
    return (x - base).astype(float) - rest


def _deviation(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    """The exact sum over dimensions of ``(n * x - sums) ** 2``."""
    if not x.size:
        return [0] * len(x)
    widest = max(int(x.max()), -int(x.min())) * n + max(abs(s) for s in sums)
    if widest < 2**62:
        apart = n * x - np.array(sums, dtype=np.int64)
        widest = int(np.abs(apart).max())
    else:
        apart = n * x.astype(object) - np.array(sums, dtype=object)
    if widest * widest * x.shape[1] >= 2**63:
        apart = apart.astype(object)
    return (apart * apart).sum(axis=1).tolist()


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        lists, sizes = batch.column(0), np.array(batch.column(0).value_lengths().to_numpy(zero_copy_only=False))
        for dims in np.unique(sizes):
            at = np.flatnonzero(sizes == dims)
            yield int(dims), matrix(lists if len(at) == len(lists) else lists.take(pa.array(at)), int(dims))


def _totals(x: DataFrame) -> dict[int, tuple[int, tuple[int, ...]]]:
    """Rows and exact sums per dimension, by length of the vectors."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for dims, block in _by_length(batches):
            n, sums = held.get(dims, (0, [0] * dims))
            wide = block.size and max(int(block.max()), -int(block.min())) * len(block) >= 2**62
            own = (block.astype(object) if wide else block).sum(axis=0).tolist()
            held[dims] = (n + len(block), [a + b for a, b in zip(sums, own)])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(held), pa.int32()),
                pa.array([n for n, _ in held.values()], pa.int64()),
                pa.array([[Decimal(s) for s in sums] for _, sums in held.values()], pa.list_(pa.decimal128(38, 0))),
            ],
            ["dims", "n", "sums"],
        )

    parts = x.mapInArrow(add, "dims int, n long, sums array<decimal(38,0)>")
    rows = parts.groupBy("dims").agg(F.sum("n").alias("n"))
    sums = (
        parts.select("dims", F.posexplode("sums").alias("at", "s")).groupBy("dims", "at").agg(F.sum("s").alias("s"))
    )
    # One row per length, and one per length and dimension.
    found = {row.dims: (row.n, [0] * row.dims) for row in rows.collect()}
    for row in sums.collect():
        found[row.dims][1][row.at] = int(row.s)
    return {dims: (n, tuple(s)) for dims, (n, s) in found.items()}


def _triangles(x: DataFrame, totals: dict, scratch: Scratch) -> dict[int, np.ndarray]:
    """The triangular factor of all centred rows, by length: one a partition, merged ``FAN_IN`` at a time."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for dims, block in _by_length(batches):
            rows = _centred(block, *totals[dims])
            held[dims] = np.linalg.qr(np.vstack([held.get(dims, np.zeros((0, dims))), rows]), mode="r")
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()), pa.array([r.tobytes() for r in held.values()], pa.binary())],
            ["dims", "r"],
        )

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        dims = int(parts.dims.iloc[0])
        stacked = [np.frombuffer(r, float).reshape(-1, dims) for r in parts.r]
        merged = np.linalg.qr(np.vstack(stacked), mode="r") if len(stacked) > 1 else stacked[0]
        return pd.DataFrame({"dims": [dims], "r": [merged.tobytes()]})

    parts, turn = scratch.write(x.mapInArrow(reduce, "dims int, r binary"), "r0"), 0
    while (most := parts.groupBy("dims").count().agg(F.max("count")).first()[0] or 0) > 1:
        groups = -(-most // FAN_IN)
        keyed = parts.withColumn("part", F.pmod(F.xxhash64("r"), F.lit(groups)))
        turn += 1
        parts = scratch.write(keyed.groupBy("dims", "part").applyInPandas(merge, "dims int, r binary"), f"r{turn}")
    # One row of at most dims * dims numbers per length.
    return {row.dims: np.frombuffer(bytes(row.r), float).reshape(-1, row.dims) for row in parts.collect()}


def whole(vectors: DataFrame, vector: str, offset: int = OFFSET) -> Column:
    """The vectors as whole numbers, ``floor(1024 * c) + offset``."""
    return scaled(F.col(f"`{vector}`"), 1024.0, offset)


def fit(vectors: DataFrame, vector: str = "embedding", components: int = 8) -> dict[int, Fit]:
    """Means and whitening axes of all usable vectors, by their length.

    The sums are exact, rows are centred by them and each partition reduces its rows block by
    block to a triangle; triangles merge in rounds, so a task holds ``FAN_IN`` of them. The triangle of
    all rows (dims x dims numbers, whatever the rows) is made bidiagonal, its
    singular values are found by dqds and the axes by twisted factorisations: no product of the data with itself
    is ever formed. Vectors of other lengths have a fit of their own; vectors without components have
    none, like an empty table.
    """
    workers_find_package(vectors.sparkSession)
    scratch = Scratch(vectors.sparkSession, "whiten")
    kept = vectors.where(usable(F.col(f"`{vector}`")) & (F.size(f"`{vector}`") > 0))
    x = kept.select(whole(kept, vector).alias("x"))
    totals = _totals(x)
    fits = {}
    for dims, r in _triangles(x, totals, scratch).items():
        n, sums = totals[dims]
        square = np.zeros((max(dims - len(r), 0), dims))
        squares, axes = axes_of(np.vstack([r, square]), min(components, dims))
        fits[dims] = Fit(n, sums, axes, squares[: len(axes)] / n, float(squares.sum()) / n)
    return fits


def whiten(vectors: DataFrame, fits: dict[int, Fit], vector: str = "embedding") -> DataFrame:
    """The usable rows with ``n``, ``deviation``, ``whitened`` and ``explained``.

    ``n`` counts the rows of the fit; ``deviation`` is the exact sum over dimensions of ``(n * x - S) ** 2``;
    ``whitened`` has the projection of the centred vector on each axis over its standard
    deviation, NULL for an axis without variance; ``explained`` has each axis's share of the
    variance, 0 where there is none. Rows whose vector is NULL, holds NULL or non-finite entries or
    is empty are dropped; so are those of a length without a fit. Repeated rows are all kept.
    Columns with the names of the results are replaced. Fits go to the tasks: their size is that
    of the axes, whatever the rows.
    """
    workers_find_package(vectors.sparkSession)
    results, doubles = ("n", "deviation", "whitened", "explained"), ArrayType(DoubleType())
    kept = [c for c in vectors.columns if c.lower() not in results]
    source, at = fresh("_x", vectors), F.col(f"`{vector}`")
    schema = vectors.select(*[F.col(f"`{c}`") for c in kept]).schema
    for name, kind in zip(results, (LongType(), DecimalType(38, 0), doubles, doubles)):
        schema = schema.add(name, kind)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            sizes = np.array(lists.value_lengths().to_numpy(zero_copy_only=False))
            for dims in np.unique(sizes):
                own = fits[int(dims)]
                rows = pa.array(np.flatnonzero(sizes == dims))
                x = matrix(lists.take(rows), int(dims))
                scales = own.scales
                flat = scales == 0.0
                onto = (_centred(x, own.n, own.sums) @ own.axes.T) / np.where(flat, 1.0, scales)
                cells = pa.array(onto.ravel(), mask=np.tile(flat, len(x)))
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(scales))
                shares = own.variances / own.total if own.total else np.zeros(len(scales))
                out = [
                    pa.array(np.full(len(x), own.n), pa.int64()),
                    pa.array([Decimal(v) if v < 10**38 else None for v in _deviation(x, own.n, own.sums)],
                             pa.decimal128(38, 0)),
                    pa.ListArray.from_arrays(ends, cells),
                    pa.ListArray.from_arrays(ends, pa.array(np.tile(shares, len(x)))),
                ]
                columns = [c.take(rows) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, *out], [*batch.schema.names[:-1], *results])

    fitted = usable(at) & F.size(at).isin([int(d) for d in fits])
    rows = vectors.where(fitted) if fits else vectors.where(F.lit(False))
    return rows.select(*[F.col(f"`{c}`") for c in kept], whole(vectors, vector).alias(source)).mapInArrow(
        project, schema
    )


def identity_errors(whitened: DataFrame, vector: str = "embedding") -> dict[int, float]:
    """The largest absolute entry of the covariance of ``whitened`` minus the identity, by length of the vectors.

    Blocks are centred by their own means and merged by the rule for means and centred products,
    within a partition and then over the partitions' rows of bounded size. Axes without variance take no part.
    """
    workers_find_package(whitened.sparkSession)

    def joined(a, b):
        (n, mean, products), (m, other, more) = a, b
        apart = other - mean
        return n + m, mean + apart * (m / (n + m)), products + more + np.outer(apart, apart) * (n * m / (n + m))

    def row(key, held):
        return (*key, held[0], held[1].tobytes(), held[2].tobytes())

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            dims = batch.column(0).to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                lists = batch.column(1).take(pa.array(np.flatnonzero(dims == d)))
                block = matrix(lists, len(lists[0]))
                block = block[:, ~np.isnan(block).any(axis=0)]
                mean = block.mean(axis=0)
                own = (len(block), mean, (block - mean).T @ (block - mean))
                held[int(d)] = joined(held[int(d)], own) if int(d) in held else own
        rows = [row((d,), h) for d, h in held.items()]
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        cells = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cells, kinds)], ["dims", "n", "mean", "products"]
        )

    def merge(block: pd.DataFrame) -> pd.DataFrame:
        held = None
        for n, mean, products in zip(block.n, block["mean"], block.products):
            mean = np.frombuffer(mean, float)
            own = (int(n), mean, np.frombuffer(products, float).reshape(len(mean), len(mean)))
            held = joined(held, own) if held else own
        names = ["dims", "n", "mean", "products"]
        return pd.DataFrame([row((int(block.dims.iloc[0]),), held)], columns=names)

    schema = "dims int, n long, mean binary, products binary"
    narrow = whitened.select(F.size(f"`{vector}`").alias("dims"), "whitened")
    found = narrow.mapInArrow(parts, schema).withColumn("part", F.pmod(F.xxhash64("mean"), F.lit(FAN_IN)))
    found = found.groupBy("dims", "part").applyInPandas(merge, schema).groupBy("dims").applyInPandas(merge, schema)
    errors = {}
    for r in found.collect():  # One row per length.
        k = len(r["mean"]) // 8
        covariance = np.frombuffer(bytes(r.products), float).reshape(k, k) / r.n
        errors[r.dims] = float(np.abs(covariance - np.eye(k)).max(initial=0.0))
    return errors
