"""Importance resampling against a plain computation of the same numbers."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from nivo.llm import resampling

WORDS = "river Stone LAMP ürge naïve x1 42 zebra quilt vapor Ωmega".split()
ROWS = [(i, " -".join(WORDS[(i * j) % len(WORDS)] for j in range(1, 3 + i % 40))) for i in range(120)]
ROWS += [(200, None), (201, ""), (202, " .,\u0000\t"), (203, "river " * 60_000), (None, "stone " * 25)]
ROWS += [(50, ROWS[50][1]), (50, ROWS[50][1])]
TARGET = [(1, "river lamp zebra"), (2, "Zebra quilt 42"), (3, None)]


def plain_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def features(text, longest):
    words = plain_words(text)
    return [
        zlib.crc32(" ".join(words[i : i + n]).encode()) for n in range(1, longest + 1) for i in range(len(words) - n + 1)
    ]


def plain(rows, target, longest, buckets, percent, least):
    s = Counter(f % buckets for _, text in rows for f in features(text, longest))
    t = Counter(f % buckets for _, text in target for f in features(text, longest))
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(buckets)]
    out = []
    for key, text in rows:
        found = features(text, longest)
        weight = sum(gain[f % buckets] for f in found)
        h = int(hashlib.sha256(f"2024:{'null' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, len(found), weight, score, None, len(plain_words(text))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, row in enumerate(able[: percent * len(able) // 100]):
        row[4] = place + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def rows_of(df):
    return sorted(
        ((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr
    )


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame(TARGET, "item_id long, text string")


@pytest.mark.parametrize("longest,buckets,percent,least", [(1, 10_000, 10, 20), (3, 64, 35, 1), (2, 7, 100, 0)])
def test_resample_by_brute_force(docs_of, clashing, target, longest, buckets, percent, least):
    docs = clashing(docs_of(ROWS)).repartition(5)
    found = resampling.resample(
        docs, target, longest=longest, buckets=buckets, percent=percent, least_words=least
    )
    assert rows_of(found) == plain(ROWS, TARGET, longest, buckets, percent, least)
    assert set(docs.columns) <= set(found.columns) and found.where("window = 13").count() == len(ROWS) - 1


def test_results_replace_columns_of_their_names(docs_of, target):
    docs = docs_of(ROWS).selectExpr("*", "1 as rank", "2 as Score", "3 as weight", "4 as _row", "5 as _text")
    found = resampling.resample(docs, target)
    assert rows_of(found) == plain(ROWS, TARGET, 1, 10_000, 10, 20)
    assert found.where("_row = 4 and _text = 5").count() == len(ROWS)


def test_empty_tables(docs_of, spark, target):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(docs_of([]), target).count() == 0
    assert rows_of(resampling.resample(docs_of(ROWS), nothing)) == plain(ROWS, [], 1, 10_000, 10, 20)
    with pytest.raises(ValueError):
        resampling.draw(docs_of([]), "doc_id", percent=101)


def test_runs_extend_checksums():
    words = [b"a", b"bc", b"d"]
    wanted = [zlib.crc32(x) for x in (b"a", b"bc", b"d", b"a bc", b"bc d", b"a bc d")]
    assert list(resampling.runs(words, 4)) == wanted
    assert list(resampling.runs([], 3)) == []
