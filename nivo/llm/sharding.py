"""Proportional stratified interleaving: shards of equal row counts that all match the mixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nivo.llm.shared import Scratch, packed, running

SEED = 20_731


def shard(
    docs: DataFrame,
    shards: int,
    stratum: str = "source",
    key: str = "doc_id",
    seed: int = SEED,
) -> DataFrame:
    """The rows with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    Rows of a stratum are shuffled by a seeded hash and ranked; the fractional rank
    ``(rank + 1/2) / rows of the stratum`` spreads each stratum evenly over [0, 1). Sorting all
    rows by it interleaves the strata in proportion, and cutting that order into equal stretches
    gives shards whose counts differ by one at most and whose mixture is that of the table.
    Both orders are distributed running counts, so a stratum may be of any size.

    NULL strata form one stratum; NULL keys are hashed as such. Texts play no part, so empty,
    NULL and very long ones are rows like others. Repeated rows are all kept, in any order among
    themselves. With more shards than rows the last ones are empty, and an empty table gives no
    rows. Columns of the input called ``shard`` or ``slot`` are replaced.
    """
    if shards < 1:
        raise ValueError("there must be a shard at least")
    scratch = Scratch(docs.sparkSession, "shard")
    # Rows are carried as one column, so that their names meet none used here; rows that share a
    # key are told apart by all that they hold.
    keyed = docs.select(
        packed(docs, "shard", "slot").alias("row"),
        F.col(f"`{stratum}`").alias("stratum"),
        F.xxhash64(F.lit(seed), F.col(f"`{key}`").cast("string")).alias("hash"),
    ).withColumns({"tie": F.xxhash64("row"), "number": F.monotonically_increasing_id()})
    # Written once, so that numbers hold; only what orders the rows goes through the orders.
    rows = scratch.write(keyed, "rows")
    keyed = rows.drop("row")
    first = running(
        scratch,
        keyed,
        "by-stratum",
        [F.col("stratum").asc_nulls_last(), F.col("hash"), F.col("tie")],
        F.lit(1),
    )
    sizes = scratch.write(keyed.groupBy("stratum").agg(F.count(F.lit(1)).alias("_size")), "sizes")
    total = sizes.agg(F.sum("_size")).first()[0] or 0
    base = Window.orderBy(F.col("stratum").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    # One row per stratum.
    bases = sizes.select(
        F.col("stratum").alias("of"),
        "_size",
        F.coalesce(F.sum("_size").over(base), F.lit(0)).alias("_base"),
    )
    ranked = (
        first.drop("before")
        .join(bases, F.col("stratum").eqNullSafe(F.col("of")))
        .withColumn("_share", (F.col("position") - F.col("_base") + F.lit(0.5)) / F.col("_size"))
        .drop("of", "_size", "_base", "position")
    )
    spread = running(
        scratch,
        ranked,
        "interleaved",
        [F.col("_share"), F.col("hash"), F.col("tie"), F.col("stratum")],
        F.lit(1),
    )
    scratch.drop("by-stratum", "sizes")
    cut = F.expr(f"(position * {shards}L) div {max(total, 1)}L").cast("int")
    start = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    placed = spread.withColumn("shard", cut).select("number", "shard", (F.col("position") - start).alias("slot"))
    return rows.select("number", "row").join(placed, "number").select("row.*", "shard", "slot")
