"""Weighted fair queueing: sources mixed to target weights by virtual finish times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nivo.llm.shared import Scratch, packed, running

SEED = "mix-1"
CYCLE = (5, 2, 1)


def targets(sizes: DataFrame, budget: Column, copies: int, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """``source``, ``source_size`` and ``target`` of each source, from one row per source.

    Sources in code point order, NULL last, have the weights of ``cycle``, repeated. Targets
    are ``weight * level``, but ``copies * source_size`` at most; the level is such that
    targets add up to the budget. Capped sources are those whose ratio of cap and weight is
    smallest, so the level follows from running sums over the sources sorted by that ratio;
    it is what resharing the excess until none is above comes to.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turns = F.array(*[F.lit(float(w)) for w in cycle])
    weighted = sizes.select(
        "source",
        "source_size",
        F.element_at(turns, ((F.row_number().over(order) - 1) % len(cycle)) + 1).alias("weight"),
        (F.col("source_size") * copies).cast("double").alias("cap"),
    ).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    levelled = weighted.withColumn("turn", F.row_number().over(by_ratio)).withColumn(
        "try",
        (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest),
    )
    # The first source in this order whose cap is not below the level tried with it sets the level.
    sets_level = levelled.withColumn("open", F.col("ratio") >= F.col("try"))
    everything = Window.partitionBy()
    level = F.min(F.when(F.col("open"), F.struct("turn", "try"))).over(everything)["try"]
    return sets_level.select(
        "source",
        "source_size",
        F.least(F.col("cap"), F.coalesce(F.col("weight") * level, F.col("cap"))).alias("target"),
    )


def mix(
    docs: DataFrame,
    size: Column,
    share: float = 1.5,
    copies: int = 2,
    cycle: tuple[int, ...] = CYCLE,
    source: str = "source",
    key: str = "doc_id",
    seed: str = SEED,
) -> DataFrame:
    """The rows with ``size``, ``source_size``, ``target`` and ``taken``, the copies the mix takes.

    The budget is ``share`` times all sizes (``share`` may not exceed ``copies``). Documents of
    a source queue in seeded-shuffled order, ``copies`` times over. A document's virtual finish
    time is the source's cumulative size up to its end, divided by the source's target. All
    queued documents are sorted by finish time, and those within the budget are taken, whole.
    Both orders are distributed running sums; the cut is found as one row.

    NULL sources are one source, the last. NULL keys are shuffled as the word ``null``. Rows
    of size 0 (NULL or blank texts) are never taken. Repeated rows queue as documents of their
    own. An empty table gives no rows. Input columns with the names of the results are replaced.
    """
    if not 0 <= share <= copies:
        raise ValueError("the budget may not exceed all copies of all documents")
    scratch = Scratch(docs.sparkSession, "mix")
    shuffled = F.md5(
        F.concat(F.lit(seed), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")))
    )
    # Rows are carried as one column, so that their names meet none used here.
    keyed = docs.select(
        packed(docs, "size", "source_size", "target", "taken").alias("row"),
        size.cast("long").alias("_size"),
        F.col(f"`{source}`").alias("_source"),
        shuffled.alias("_hash"),
    ).withColumns({"_tie": F.xxhash64("row"), "_number": F.monotonically_increasing_id()})
    # Written once, so that numbers hold; only what orders the rows goes through the orders.
    rows = scratch.write(keyed, "rows")
    keyed = rows.drop("row")
    queue = running(
        scratch,
        keyed,
        "queue",
        [F.col("_source").asc_nulls_last(), F.col("_hash"), F.col("_size"), F.col("_tie")],
        F.col("_size"),
    )
    sizes = keyed.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"))
    sizes = scratch.write(sizes, "sizes")
    budget = share * float(sizes.agg(F.sum("source_size")).first()[0] or 0)
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    based = targets(sizes, F.lit(budget), copies, cycle).withColumn(
        "_base",
        F.coalesce(
            F.sum("source_size").over(by_source.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ),
    )
    based = scratch.write(based, "targets").withColumnRenamed("source", "_s")
    finish = F.transform(
        F.sequence(F.lit(0), F.lit(copies - 1)),
        lambda turn: (F.col("before") - F.col("_base") + F.col("_size") + turn * F.col("source_size"))
        / F.col("target"),
    )
    queued = (
        queue.join(based, F.col("_source").eqNullSafe(F.col("_s")))
        .withColumn("_finish", F.when(F.col("_size") > 0, finish))
        .drop("_s", "_base", "before")
    )
    queued = scratch.write(queued, "queued")
    line = queued.select("_size", "position", F.posexplode("_finish").alias("turn", "finish"))
    line = line.select("_size", F.col("position").alias("place"), "finish", "turn")
    order = [F.col("finish"), F.col("place"), F.col("turn")]
    line = running(scratch, line, "line", order, F.col("_size"))
    cut = (
        line.where(F.col("before") + F.col("_size") <= budget)
        .agg(F.max(F.struct("finish", "place", "turn")).alias("cut"))
        .first()["cut"]
    )
    scratch.drop("queue", "sizes", "line")
    if cut is None:
        turns = F.lit(0)
    else:
        kinds = {"finish": "double", "place": "long", "turn": "int"}
        last = F.struct(*[F.lit(cut[n]).cast(kind).alias(n) for n, kind in kinds.items()])
        within = F.filter(
            F.transform(
                F.col("_finish"),
                lambda at, turn: F.struct(
                    at.alias("finish"), F.col("position").alias("place"), turn.alias("turn")
                ),
            ),
            lambda place: place <= last,
        )
        turns = F.coalesce(F.size(within), F.lit(0))
    results = queued.select(
        "_number",
        F.col("_size").alias("size"),
        "source_size",
        "target",
        F.when(F.col("_size") > 0, turns).otherwise(0).alias("taken"),
    )
    results = rows.select("_number", "row").join(results, "_number")
    return results.select("row.*", "size", "source_size", "target", "taken")
