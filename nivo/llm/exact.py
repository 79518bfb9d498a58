"""Exact deduplication by mergeable counting quotient filters and byte verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nivo.llm.shared import Scratch, packed, workers_find_package

#: A fingerprint's high bits are its quotient and name its slab of the filter, the rest its remainder.
SLAB_BITS = 10
REMAINDER_BITS = 64 - SLAB_BITS
#: Fingerprints a task holds before it hands its filter on and begins another.
CAPACITY = 2_000_000


def count_sorted(fingerprints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints in order with their summed counts."""
    order = np.argsort(fingerprints, kind="stable")
    fingerprints, counts = fingerprints[order], counts[order]
    starts = np.flatnonzero(np.r_[True, fingerprints[1:] != fingerprints[:-1]])
    if not len(fingerprints):
        return fingerprints, counts
    return fingerprints[starts], np.add.reduceat(counts, starts)


def slabs(fingerprints: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A filter as one row per quotient in use: its sorted remainders and their counts."""
    quotients = (fingerprints >> np.uint64(REMAINDER_BITS)).astype(np.int32)
    remainders = fingerprints & np.uint64((1 << REMAINDER_BITS) - 1)
    starts = np.flatnonzero(np.r_[True, quotients[1:] != quotients[:-1]]) if len(quotients) else []
    ends = np.r_[starts[1:], len(quotients)].astype(int) if len(quotients) else []
    return pa.RecordBatch.from_arrays(
        [
            pa.array(quotients[starts] if len(quotients) else [], pa.int32()),
            pa.array([remainders[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
            pa.array([counts[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
        ],
        names=["quotient", "remainders", "counts"],
    )


def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition's filter, handed on in parts of bounded size."""
    held, more, n = (np.empty(0, np.uint64), np.empty(0, np.int64)), [], 0
    for batch in batches:
        more.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        n += len(more[-1])
        if n >= CAPACITY:
            held = _absorb(held, more)
            more, n = [], 0
            if len(held[0]) >= CAPACITY:
                yield slabs(*held)
                held = (np.empty(0, np.uint64), np.empty(0, np.int64))
    yield slabs(*_absorb(held, more))


def _absorb(held, more):
    new = np.concatenate([held[0], *more])
    counts = np.concatenate([held[1], np.ones(len(new) - len(held[0]), np.int64)])
    return count_sorted(new, counts)


def merge(slab: pd.DataFrame) -> pd.DataFrame:
    """The filters' parts of one quotient merged by remainder: the fingerprints counted above one."""
    remainders = np.concatenate([np.frombuffer(x, np.uint64) for x in slab.remainders])
    counts = np.concatenate([np.frombuffer(x, np.int64) for x in slab.counts])
    remainders, counts = count_sorted(remainders, counts)
    quotient = np.uint64(int(slab.quotient.iloc[0]))
    found = (quotient << np.uint64(REMAINDER_BITS)) | remainders[counts > 1]
    return pd.DataFrame({"fingerprint": found.view(np.int64), "copies": counts[counts > 1]})


def exact(docs: DataFrame, text: Column | None = None, key: str = "doc_id") -> DataFrame:
    """The rows with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Each partition counts its texts' fingerprints in a quotient filter: quotient, sorted
    remainders, counts. Filters merge without loss, quotient by quotient; a quotient's part is
    a ``2 ** -SLAB_BITS`` share of all fingerprints. Only texts whose fingerprint is counted more than
    once are compared, and by their bytes: equal ones are aggregated first where they lie, so a
    text repeated a million times moves once per task. The largest key of equal texts stays.

    NULL texts count as empty ones. Rows with a NULL key are counted, and kept only if all of
    their group have NULL keys. Repeated rows (equal key and text) stay or go together. An empty
    table gives no rows. Input columns with the names of the results are replaced.
    """
    spark = docs.sparkSession
    workers_find_package(spark)
    scratch = Scratch(spark, "exact")
    body = F.coalesce(F.col("text") if text is None else text, F.lit(""))
    prints = docs.select(F.xxhash64(body).alias("fingerprint"))
    repeated = (
        prints.mapInArrow(build, "quotient int, remainders binary, counts binary")
        .groupBy("quotient")
        .applyInPandas(merge, "fingerprint long, copies long")
    )
    repeated = scratch.write(repeated, "repeated").select("fingerprint")
    suspects = docs.select(F.col(f"`{key}`").alias("id"), body.alias("body")).withColumn(
        "fingerprint", F.xxhash64("body")
    )
    groups = (
        suspects.join(repeated, "fingerprint", "left_semi")
        .groupBy("fingerprint", "body")
        .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where(F.col("group_size") > 1)
        .select(F.sha2("body", 256).alias("sha"), "keep_id", "group_size")
    )
    groups = scratch.write(groups, "groups")
    scratch.drop("repeated")
    joined = docs.select(
        packed(docs, "keep_id", "group_size", "kept", "text_sha256").alias("row"),
        F.col(f"`{key}`").alias("id"),
        F.sha2(body, 256).alias("text_sha256"),
    ).join(groups, F.col("text_sha256") == F.col("sha"), "left")
    alone = F.col("sha").isNull()
    keep = F.when(alone, F.col("id")).otherwise(F.col("keep_id"))
    return joined.select(
        "row.*",
        keep.alias("keep_id"),
        F.when(alone, F.lit(1).cast("long")).otherwise(F.col("group_size")).alias("group_size"),
        keep.eqNullSafe(F.col("id")).alias("kept"),
        "text_sha256",
    )
