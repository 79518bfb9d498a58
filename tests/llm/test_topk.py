"""Exact inner-product search against a comparison of all pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nivo.llm import topk

SCHEMA = "vec_id long, vector array<long>"


def plain(rows, asks, k):
    """(query, rank, candidate, score) by comparing each query row with every other row of its length."""
    kept = [(i, key, v) for i, (key, v) in enumerate(rows) if v is not None and None not in v]
    out = []
    for i, key, v in kept:
        if not asks(key):
            continue
        scored = [
            (-sum(a * b for a, b in zip(v, w)), other is None, other or 0, j)
            for j, other, w in kept
            if j != i and len(w) == len(v)
        ]
        for rank, (score, none, other, _) in enumerate(sorted(scored)[:k]):
            out.append((key, rank + 1, None if none else other, -score))
    return sorted(out, key=repr)


def found(df, k, every=10):
    out = topk.search(df, F.col("vec_id") % every == 0, k)
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in out.collect()), key=repr)


def hundredth(every):
    return lambda key: key is not None and key % every == 0


def spread(n, d, seed, lengths):
    """Directions in a few tight clusters, so that thresholds are high, with lengths of a wide range."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, d))
    x = centres[rng.integers(0, 5, n)] + 0.15 * rng.normal(size=(n, d))
    x *= (rng.pareto(1.5, n) + 0.1)[:, None] if lengths else 1 / np.linalg.norm(x, axis=1)[:, None]
    return np.floor(1024 * x).astype(int).tolist()


@pytest.mark.parametrize("lengths", [True, False])
@pytest.mark.parametrize("d", [3, 24])
def test_search_by_brute_force(spark, monkeypatch, lengths, d):
    monkeypatch.setattr(topk, "LANE_BYTES", 8_000)
    monkeypatch.setattr(topk, "LEAST_LANE_BYTES", 4_000)
    monkeypatch.setattr(topk, "GROUP_BYTES", 1_500)
    rows = list(enumerate(spread(400, d, d, lengths)))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(df, 10) == plain(rows, hundredth(10), 10)


def test_ties_repeats_and_odd_rows(spark, clashing):
    hot = [512, -100, 7]
    rows = [(i, hot) for i in range(150)] + [(10, hot), (10, hot), (None, hot), (None, None), (20, None)]
    rows += [(30, [1, None, 2]), (40, [5, 5]), (50, [0, 0, 0]), (60, []), (61, []), (70, [7]), (200, [-3, -2, -900])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df, 4) == plain(rows, hundredth(10), 4)
    more = df.withColumns({c: F.lit(1) for c in ("id", "x", "number", "dims", "lane", "part", "norm", "asks", "need")})
    assert found(more, 4) == plain(rows, hundredth(10), 4)
    assert found(df, 500) == plain(rows, hundredth(10), 500)
    assert found(spark.createDataFrame([], SCHEMA), 3) == []
    assert found(spark.createDataFrame([(0, [1, 2])], SCHEMA), 3) == []


def test_numbers_too_large_for_doubles(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [int(c) for c in rng.integers(-(2**30), 2**30, 5)]) for i in range(60)]
    rows += [(100 + i, [2**30 - i, 2**30, 2**30, -(2**30), 3]) for i in range(20)]
    assert found(spark.createDataFrame(rows, SCHEMA), 5) == plain(rows, hundredth(10), 5)
    beyond = [(0, [2**62, 2**62]), (1, [2**62, 2**62]), (2, [-(2**62), -(2**62)])]
    assert found(spark.createDataFrame(beyond, SCHEMA), 2, 2) == [
        (0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63)), (2, 1, 0, -(2**63)), (2, 2, 1, -(2**63)),
    ]


def table(ids, x, need=None):
    kinds = {"dims": pa.int32(), "id": pa.int64(), "number": pa.int64(), "x": pa.list_(pa.int64()), "need": pa.float64()}
    columns = [[len(x[0])] * len(x), ids, ids, x, [need] * len(x)]
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds.values())], list(kinds))


@pytest.mark.parametrize("lengths", [True, False])
def test_prunings_take_part(monkeypatch, lengths):
    monkeypatch.setattr(topk, "BUCKET", 50)
    x = spread(900, 16, 8, lengths)
    seen, cuts = [], []
    survivors, of_block = topk._survivors, topk.search_block
    monkeypatch.setattr(topk, "_survivors", lambda *a: seen.append(survivors(*a)) or seen[-1])
    monkeypatch.setattr(topk, "search_block", lambda *a: cuts.extend(a[-1]) or of_block(*a))
    out = topk.search_cell(table(list(range(900)), x), table(list(range(0, 900, 10)), x[::10]), 10).to_pydict()
    got = {}
    for q, v, s in zip(out["query_id"], out["vec_id"], out["score"]):
        got.setdefault(q, []).append((-s, v))
    rows = [(q, r + 1, v, -s) for q, o in got.items() for r, (s, v) in enumerate(sorted(o))]
    assert sorted(rows, key=repr) == plain(list(enumerate(x)), hundredth(10), 10)
    if lengths:  # Norms of a wide range: most buckets are never opened by any query.
        assert len(cuts) > 10 and len(seen) < 90 * len(cuts) / 10
    else:  # Norms alike, clusters tight: coordinates leave few of each bucket.
        assert len(seen) > 90 * len(cuts) / 2 and np.mean([len(s) for s in seen]) < 15


def test_thresholds_from_another_lane_leave_out_what_cannot_enter():
    x = [[10, 0], [9, 0], [1, 0]]
    out = topk.search_cell(table([1, 2, 3], x), table([100], [[1, 0]], need=9.5), 2).to_pydict()
    assert 10 in out["score"] and 1 not in out["score"]


def test_buckets_are_of_similar_length():
    cuts = topk.buckets(np.array([100.0] * 3_000 + [50.0] * 40 + [1.0, 0.0, 0.0]))
    assert cuts[0] == (0, 1024) and cuts[-1][1] == 3_043
    assert all(a[1] == b[0] for a, b in zip(cuts, cuts[1:])) and topk.buckets(np.array([])) == []
