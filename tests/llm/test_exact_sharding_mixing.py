import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from nivo.llm import exact, mixing, sharding
from nivo.llm.shared import Scratch, running, words

ROWS = [
    (1, "a b", "en", "s1"),
    (2, "a b", "en", "s1"),
    (3, "a  b", "en", "s2"),
    (4, None, "en", "s2"),
    (5, "", "en", None),
    (6, "x" * 200_000, "en", "s1"),
    (7, "é", None, "s3"),
    (7, "é", None, "s3"),
    (None, "a b", None, None),
]


def test_filters_merge_without_loss():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**63, 3_000, dtype=np.int64)
    prints = np.concatenate([prints, prints[:500], prints[:100]]).view(np.uint64)
    rng.shuffle(prints)
    parts = []
    for part in np.array_split(prints, 7):
        batch = exact.slabs(*exact.count_sorted(part, np.ones(len(part), np.int64)))
        parts.append(batch.to_pandas())
    import pandas as pd

    found = pd.concat([exact.merge(g) for _, g in pd.concat(parts).groupby("quotient")])
    expected = {np.uint64(k).view(np.int64): n for k, n in Counter(prints.tolist()).items() if n > 1}
    assert dict(zip(found.fingerprint, found.copies)) == expected


def test_build_hands_on_full_filters(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(exact, "CAPACITY", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(list(range(25)), pa.int64())], ["fingerprint"])
    out = list(exact.build(iter([batch, batch])))
    assert len(out) == 3
    assert sum(len(np.frombuffer(x.as_py(), np.int64)) for b in out for x in b.column(2)) == 50


def test_exact_groups(docs_of, clashing):
    found = exact.exact(clashing(docs_of(ROWS))).collect()
    assert len(found) == len(ROWS)
    by = defaultdict(list)
    for row in found:
        by[row.doc_id].append(row)
    assert [(r.keep_id, r.group_size, r.kept) for r in by[1]] == [(2, 3, False)]
    assert [(r.keep_id, r.group_size, r.kept) for r in by[2]] == [(2, 3, True)]
    assert [(r.keep_id, r.group_size, r.kept) for r in by[None]] == [(2, 3, False)]
    assert [(r.keep_id, r.group_size, r.kept) for r in by[3]] == [(3, 1, True)]
    assert [(r.keep_id, r.kept) for r in by[4] + by[5]] == [(5, False), (5, True)]
    assert [(r.keep_id, r.group_size, r.kept) for r in by[7]] == [(7, 2, True)] * 2
    assert by[6][0].text_sha256 == hashlib.sha256(b"x" * 200_000).hexdigest()
    assert by[1][0].window == 13  # A column of the input that is called like one used inside.


def test_exact_of_nothing(docs_of):
    assert exact.exact(docs_of([])).count() == 0


def test_running_sums_cut_a_frequent_key(spark):
    df = spark.range(1_000).select(F.lit("hot").alias("k"), F.col("id").alias("v"))
    out = running(Scratch(spark, "t"), df.repartition(7), "r", [F.col("k"), F.col("v")], F.col("v"))
    rows = sorted(out.collect(), key=lambda r: r.v)
    assert [r.position for r in rows] == list(range(1_000))
    assert [r.before for r in rows] == [v * (v - 1) // 2 for v in range(1_000)]


@pytest.mark.parametrize("shards", [1, 4, 40])
def test_shards_match_the_mixture(spark, docs_of, shards):
    rows = [(i, f"t{i}", "en", "big" if i % 3 else f"s{i % 4}") for i in range(400)]
    out = sharding.shard(docs_of(rows), shards).collect()
    by = defaultdict(list)
    for row in out:
        by[row.shard].append(row)
    assert sorted(r.doc_id for r in out) == list(range(400))
    sizes = [len(by[n]) for n in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in by[n]) == list(range(len(by[n]))) for n in by)
    for source, total in Counter(r[3] for r in rows).items():
        each = [sum(r.source == source for r in by[n]) for n in range(shards)]
        assert all(abs(n - total / shards) <= 3 for n in each)


def test_shards_by_brute_force(spark, docs_of):
    docs = docs_of([(i, "t", None, f"s{i % 5}" if i % 7 else None) for i in range(120)])
    plain = docs.select("doc_id", "source", F.xxhash64(F.lit(sharding.SEED), F.col("doc_id").cast("string"))).collect()
    strata = defaultdict(list)
    for doc_id, source, hashed in plain:
        strata[source].append((hashed, doc_id))
    order = []
    for rows in strata.values():
        rows.sort()
        order += [((rank + 0.5) / len(rows), *row) for rank, row in enumerate(rows)]
    expected = {doc_id: at * 7 // 120 for at, (_, _, doc_id) in enumerate(sorted(order))}
    assert {r.doc_id: r.shard for r in sharding.shard(docs, 7).collect()} == expected


def test_shards_of_odd_rows(docs_of, clashing):
    out = sharding.shard(clashing(docs_of(ROWS)), 20)
    assert out.count() == len(ROWS) and out.where("shard >= 9 * 20 / 9").count() == 0
    again = sharding.shard(docs_of(ROWS).repartition(5), 20)
    key = lambda df: sorted(map(str, df.select("doc_id", "shard", "slot").collect()))
    assert key(sharding.shard(docs_of(ROWS), 20)) == key(again)
    assert sharding.shard(docs_of([]), 4).count() == 0
    with pytest.raises(ValueError):
        sharding.shard(docs_of(ROWS), 0)


def _targets(sizes, budget):
    """Resharing the excess until no source is above its cap."""
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    target, free, left = {}, set(sizes), budget
    while True:
        total = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] / total > 2 * sizes[s]}
        if not above:
            return target | {s: left * weight[s] / total for s in free}
        for s in above:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= above


def test_mix_meets_targets(docs_of):
    sizes = {"a": 40, "b": 300, "c": 900, "d": 20, "e": 500, None: 60}
    rows, number = [], 0
    for source, total in sizes.items():
        while total > 0:
            n = min(total, 1 + number % 7)
            rows.append((number, " ".join(["w"] * n), None, source))
            total, number = total - n, number + 1
    out = mixing.mix(docs_of(rows), F.size(words(F.col("text")))).collect()
    expected = _targets(sizes, 1.5 * sum(sizes.values()))
    assert len(out) == len(rows)
    for source in sizes:
        own = [r for r in out if r.source == source]
        assert {r.source_size for r in own} == {sizes[source]}
        assert own[0].target == pytest.approx(expected[source])
        assert abs(sum(r.size * r.taken for r in own) - expected[source]) <= 14
    assert max(r.taken for r in out) <= 2
    assert sum(r.size * r.taken for r in out) <= 1.5 * sum(sizes.values())


def test_mix_of_odd_rows(docs_of, clashing):
    size = F.size(words(F.col("text")))
    out = mixing.mix(clashing(docs_of(ROWS)), size).collect()
    assert len(out) == len(ROWS)
    assert all(r.taken == 0 for r in out if not (r.text or "").strip())
    again = mixing.mix(docs_of(ROWS).repartition(3), size).collect()
    view = lambda rows: sorted((str(r.doc_id), r.size, r.taken) for r in rows)
    assert view(out) == view(again)
    assert mixing.mix(docs_of([]), size).count() == 0
    blank = mixing.mix(docs_of([(1, None), (2, " ")]), size).collect()
    assert [r.taken for r in blank] == [0, 0]


def test_query_columns(spark):
    from nivo.llm.queries import QUERIES

    rows = QUERIES["op5_sharding"](spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for row in rows:
        body = docs[row.doc_id].encode()
        assert (row.size, row.text_crc32) == (len(body) + 16, zlib.crc32(body))
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
