"""Importance resampling towards a target: byte-level hashed n-grams, bucket gains, seeded exponential races."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nivo.llm.shared import Scratch, fresh, running, workers_find_package

BUCKETS = 10_000
SEED = "2024"


def _table() -> bytes:
    """What becomes of each byte: A-Z is lower-cased, digits, a-z and bytes of longer code points stay, the rest is blank."""
    kept = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
    return kept.lower()


TABLE = _table()


def split(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8."""
    return text.encode("utf-8", "replace").translate(TABLE).split() if text else []


def runs(words: list[bytes], longest: int) -> Iterator[int]:
    """The crc32 of every run of 1 to ``longest`` words joined by a blank.

    A run's checksum is that of the run without its last word, carried on over the blank and that word.
    """
    level = list(map(zlib.crc32, words))
    yield from level
    if longest > 1:
        spaced = [b" " + word for word in words]
        for length in range(2, longest + 1):
            level = list(map(zlib.crc32, islice(spaced, length - 1, None), level))
            yield from level


def bucket_counts(docs: DataFrame, text: Column, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``bucket`` and ``n``, the features of all texts in it: one Counter a partition, then one sum a bucket."""
    workers_find_package(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[int] = Counter()
        for batch in batches:
            # Words are counted before they are hashed where a run is one word, which most often repeats.
            if longest == 1:
                words: Counter[bytes] = Counter()
                for value in batch.column(0):
                    words.update(split(value.as_py()))
                for word, n in words.items():
                    found[zlib.crc32(word) % buckets] += n
            else:
                for value in batch.column(0):
                    found.update(crc % buckets for crc in runs(split(value.as_py()), longest))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())], ["bucket", "n"]
        )

    parts = docs.select(text.alias("text")).mapInArrow(count, "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket, ``floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets))))`` in doubles.

    ``raw`` and ``target`` are counts by bucket; ``buckets`` rows at most come to the driver.
    """
    sides = raw.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(
        target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))
    )
    both = sides.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()
    s, t = [0] * buckets, [0] * buckets
    for row in both:
        s[row.bucket], t[row.bucket] = row.s, row.t
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return [
        math.floor(1000.0 * math.log(((t[b] + 1.0) * all_s) / ((s[b] + 1.0) * all_t))) for b in range(buckets)
    ]


def weigh(docs: DataFrame, text: str, gained: list[int], longest: int = 1) -> DataFrame:
    """The rows with ``n_words``, ``n_features`` and ``weight``, the sum of the gains of their features.

    Gains are one list of fixed length that goes to each task. NULL and blank texts have no
    features and weigh 0. Input columns with the names of the results are replaced.
    """
    workers_find_package(docs.sparkSession)
    results = ("n_words", "n_features", "weight")
    kept = [c for c in docs.columns if c.lower() not in results]
    source = fresh("_text", docs)
    buckets = len(gained)

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, weight = [], [], []
            known: dict[bytes, int] = {}
            for value in batch.column(batch.num_columns - 1):
                words = split(value.as_py())
                if longest == 1:
                    for word in set(words).difference(known):
                        known[word] = gained[zlib.crc32(word) % buckets]
                    total, n = sum(map(known.__getitem__, words)), len(words)
                else:
                    each = [gained[crc % buckets] for crc in runs(words, longest)]
                    total, n = sum(each), len(each)
                n_words.append(len(words))
                n_features.append(n)
                weight.append(total)
            own = [pa.array(v, pa.int64()) for v in (n_words, n_features, weight)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *own], [*batch.schema.names[:-1], *results]
            )

    picked = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = picked.schema
    for name in results:
        schema = schema.add(name, "long")
    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(source)).mapInArrow(
        of_batch, schema
    )


def race(key: Column, weight: Column, seed: str = SEED) -> Column:
    """``weight`` plus 1000 times a Gumbel number drawn from the seed and the key; the largest are a weighted draw."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("long")
    gumbel = F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))
    return (weight + F.floor(gumbel)).cast("long")


def draw(weighed: DataFrame, key: str, percent: int = 10, least_words: int = 20, seed: str = SEED) -> DataFrame:
    """The rows with ``score`` and ``rank``: 1, 2, 3 ... by falling score for those drawn, else NULL.

    Of the rows with ``least_words`` words, ``floor(percent * rows / 100)`` are drawn; ties go to
    the smaller key, NULL keys last, rows alike in both in any order. The order is a
    distributed running count, so no task ranks more than its range.
    """
    if not 0 <= percent <= 100:
        raise ValueError("percent must be 0 to 100")
    scratch = Scratch(weighed.sparkSession, "resample")
    row, at = fresh("_row", weighed), F.col(f"`{key}`")
    kept = [F.col(f"`{c}`") for c in weighed.columns if c.lower() not in ("score", "rank")]
    scored = weighed.select(
        F.struct(*kept).alias(row),
        at.alias("_key"),
        race(at, F.col("weight"), seed).alias("_score"),
        (F.col("n_words") >= least_words).alias("_able"),
    )
    scored = scratch.write(scored, "scored")
    line = running(
        scratch,
        scored.where("_able"),
        "line",
        [F.col("_score").desc(), F.col("_key").asc_nulls_last()],
        F.lit(1),
    )
    drawn = percent * scored.where("_able").count() // 100
    place = F.col("position") + 1
    ranked = line.select(row, "_score", F.when(place <= drawn, place).cast("long").alias("_rank"))
    others = scored.where("not _able").select(row, "_score", F.lit(None).cast("long").alias("_rank"))
    return ranked.unionByName(others).select(
        f"{row}.*", F.col("_score").alias("score"), F.col("_rank").alias("rank")
    )


def resample(
    docs: DataFrame,
    target: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    longest: int = 1,
    buckets: int = BUCKETS,
    percent: int = 10,
    least_words: int = 20,
    seed: str = SEED,
    carry: tuple[str, ...] | None = None,
) -> DataFrame:
    """The rows of ``docs`` with ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank``, drawn towards ``target``.

    Words are runs of digits, letters a-z (A-Z lower-cased) and code points above ASCII in whole
    texts; features are all runs of 1 to ``longest`` words, by crc32 in ``buckets`` buckets. A
    bucket gains what its share in ``target`` exceeds that in ``docs`` by, in thousandths of a
    natural logarithm. Counts cover all rows of both tables. ``carry`` names the columns to
    return (all by default), so that an order need not move whole texts.

    NULL and empty texts have no words: weight 0, never drawn unless ``least_words`` is 0. NULL
    keys draw as the word ``null`` and sort last among ties. Repeated rows draw the same
    number and are ranked one after the other. An empty ``docs`` gives no rows; an empty
    ``target`` makes rare features gain. Columns with the names of the results are replaced.
    """
    column = F.col(f"`{text}`")
    gained = gains(
        bucket_counts(docs, column, longest, buckets), bucket_counts(target, column, longest, buckets), buckets
    )
    weighed = weigh(docs, text, gained, longest)
    if carry is not None:
        weighed = weighed.select(*carry, "n_words", "n_features", "weight")
    return draw(weighed, key, percent, least_words, seed)
