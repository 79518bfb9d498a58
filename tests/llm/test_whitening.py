"""Whitening against numpy's eigenvectors, and its solver on hard matrices."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nivo.llm import queries, whitening
from nivo.llm.vectors import scaled, usable

SCHEMA = "vec_id long, embedding array<float>"


def made(kind, rng=None):
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.normal(size=(24, 24)))[0]
    return {
        "normal": lambda: rng.normal(size=(90, 24)),
        "graded": lambda: rng.normal(size=(90, 24)) * np.logspace(0, -12, 24),
        "graded up": lambda: rng.normal(size=(90, 24)) * np.logspace(-12, 0, 24),
        "identity": lambda: np.eye(24),
        "repeated": lambda: np.diag([3.0, 3, 3, 1, 1, 0]),
        "few rows": lambda: rng.normal(size=(5, 24)),
        "zeros": lambda: np.zeros((7, 6)),
        "one": lambda: rng.normal(size=(9, 1)),
        "clusters": lambda: q @ np.diag([1.0] * 9 + [1 + 1e-9] * 3 + [1e-3] * 12) @ q.T,
        "wilkinson": lambda: (
            np.diag(np.abs(np.arange(-10, 11.0))) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
        ),
    }[kind]()


@pytest.mark.parametrize(
    "kind",
    ["normal", "graded", "graded up", "identity", "repeated", "few rows", "zeros", "one", "clusters", "wilkinson"],
)
def test_solver(kind):
    a = made(kind)
    r = np.linalg.qr(a, mode="r")
    r = np.vstack([r, np.zeros((max(a.shape[1] - len(r), 0), a.shape[1]))])
    squares, axes = whitening.axes_of(r, a.shape[1])
    wanted = np.linalg.svd(r, compute_uv=False) ** 2
    top = max(wanted[0], 1.0)
    assert np.allclose(squares, wanted, rtol=0, atol=1e-13 * top)
    assert np.abs(axes @ axes.T - np.eye(len(axes))).max() < 1e-13
    assert np.abs(r.T @ r @ axes.T - axes.T * squares).max() < 1e-13 * top


def test_small_singular_values_are_accurate():
    a, b = np.logspace(0, -9, 30), np.logspace(-1, -10, 29)
    exact = np.linalg.svd(np.diag(a) + np.diag(b, 1), compute_uv=False) ** 2
    assert np.allclose(whitening.dqds(a, b)[:20], exact[:20], rtol=1e-9)
    assert math.isclose(np.prod(whitening.dqds(a, b) / a**2), 1.0, rel_tol=1e-11)  # The squared determinant.


def rows_of(n=300, d=12, seed=3):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * 0.3 + rng.normal(size=d)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(mixed)]
    return rows + [(7, rows[7][1]), (7, rows[7][1]), (None, rows[8][1])]


ODD = [(900, None), (901, [1.0, None] * 6), (902, [float("nan")] * 12), (903, [float("inf")] * 12), (904, [])]


def plain(rows):
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows])
    n, s = len(x), x.sum(axis=0)
    y = x - s / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    deviation = ((n * x - s) ** 2).sum(axis=1)
    return n, deviation, (y @ vectors) / np.sqrt(np.where(values > 0, values, 1)), values / values.sum()


def test_query_by_brute_force(spark, tmp_path):
    rows = rows_of()
    path = str(tmp_path)
    spark.createDataFrame(rows + ODD, SCHEMA).repartition(7).write.parquet(f"{path}/embeddings.parquet")
    found = queries.QUERIES["op13_embedding_whitening"](spark, path).collect()
    n, deviation, white, explained = plain(rows)
    assert len(found) == 8 * len(rows) and {r.n for r in found} == {n}
    own = {r.component: r for r in found if r.vec_id == 0}
    signs = np.array([np.sign(own[c + 1].whitened * white[0, c]) for c in range(8)])
    place = {key: i for i, (key, _) in enumerate(rows)}
    for r in found:
        at, c = place[r.vec_id], r.component - 1
        assert r.deviation == deviation[at]
        assert math.isclose(r.whitened, signs[c] * white[at, c], rel_tol=1e-8, abs_tol=1e-9)
        assert math.isclose(r.explained, explained[c], rel_tol=1e-9)
        assert 0 <= r.identity_error < 1e-9
    assert len({r.identity_error for r in found}) == 1


def test_many_parts_give_the_fit_of_one(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 3)
    df = spark.createDataFrame(rows_of(), SCHEMA)
    (one,) = whitening.fit(df.coalesce(1)).values()
    (many,) = whitening.fit(df.repartition(29)).values()
    assert one.sums == many.sums and one.n == many.n
    assert np.allclose(one.axes, many.axes, atol=1e-11) and np.allclose(one.variances, many.variances)


def test_odd_tables(spark):
    def run(rows, **more):
        df = spark.createDataFrame(rows, SCHEMA).withColumns({k: F.lit(v) for k, v in more.items()})
        fits = whitening.fit(df)
        return fits, whitening.whiten(df, fits), whitening.identity_errors(whitening.whiten(df, fits))

    assert run([])[1].count() == 0 and run(ODD)[1].count() == 0
    # One row, and rows that are all alike: no variance, so nothing to scale by.
    for rows in ([(1, [0.5, 2.0])], [(i, [0.5, 2.0]) for i in range(4)]):
        fits, white, errors = run(rows, n="x", dims=3, _x=4)
        assert [(r.whitened, r.explained, int(r.deviation), r.n, r.dims, r._x) for r in white.collect()] == [
            ([None, None], [0.0, 0.0], 0, len(rows), 3, 4)
        ] * len(rows)
        assert errors == {2: 0.0}
    # Vectors of two lengths are two fits; a constant entry has no variance.
    rows = [(i, [float(i), 1.0]) for i in range(5)] + [(i, [float(i)] * 3) for i in range(5, 9)]
    fits, white, errors = run(rows)
    assert sorted(fits) == [2, 3] and sorted(errors) == [2, 3] and max(errors.values()) < 1e-9
    assert white.count() == 9 and {len(r.whitened) for r in white.collect()} == {2, 3}
    # Huge entries are cut; the deviation stays exact or has no value.
    rows = [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 0.0])]
    white = run(rows)[1].collect()
    assert len(white) == 3 and all(np.isfinite(r.whitened[0]) for r in white)


def test_whole_numbers(spark):
    df = spark.createDataFrame([(1, [-0.1, 1e300, 0.5]), (2, [None]), (3, None)], "id int, v array<double>")
    out = df.where(usable(F.col("v"))).select(scaled(F.col("v"), 1024.0, 5).alias("x")).collect()
    assert [r.x for r in out] == [[-103 + 5, (1 << 62) + 5, 512 + 5]]
