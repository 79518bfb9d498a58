"""Trailing windows over a time series, split into blocks of days.

A window over one location's whole history runs in one task. Here the history is cut into
blocks of days and each block receives a copy of the few earlier rows its windows reach
back to, so the largest group is a block, not a location. The copies carry ``_halo`` and
are dropped once the windows are computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def day_number(date: Column) -> Column:
    """Days since 1970-01-01, the order column of date-range frames."""
    return F.unix_date(date.cast("date"))


def _block(date_col: str, block_days: int, shift: int = 0) -> Column:
    return F.floor((day_number(F.col(date_col)) + shift) / block_days)


def by_days(df: DataFrame, date_col: str, days: int, block_days: int) -> DataFrame:
    """Blocks whose rows reach back ``days`` calendar days (date-range frames)."""
    first, last = _block(date_col, block_days), _block(date_col, block_days, days)
    return df.withColumn("_block", F.explode(F.sequence(first, last))).withColumn(
        "_halo", F.col("_block") != first
    )


def by_rows(
    df: DataFrame, key: str, date_col: str, rows: int, block_days: int, columns: list[str]
) -> DataFrame:
    """Blocks whose rows reach back ``rows`` rows, however many days ago (row frames).

    Only ``columns`` are filled in the copied rows. The last ``rows`` rows of each block
    are kept (pruned in the map tasks); since blocks are never empty, the last ``rows``
    blocks before a block hold the rows it needs.
    """
    own = df.withColumn("_block", _block(date_col, block_days))
    from_end = Window.partitionBy(key, "_block").orderBy(F.desc(date_col))
    tails = (
        own.select(key, date_col, "_block", *columns)
        .withColumn("_from_end", F.row_number().over(from_end))
        .where(F.col("_from_end") <= rows)
        .groupBy(key, "_block")
        .agg(F.sort_array(F.collect_list(F.struct(date_col, *columns))).alias("_tail"))
    )
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(-rows, -1)
    reach = tails.select(key, "_block", F.flatten(F.collect_list("_tail").over(earlier)).alias("_reach"))
    last_rows = F.slice("_reach", F.greatest(F.lit(1), F.size("_reach") - rows + 1), F.lit(rows))
    halo = reach.select(key, "_block", F.explode(last_rows).alias("_row")).select(
        key, "_block", "_row.*", F.lit(True).alias("_halo")
    )
    return own.withColumn("_halo", F.lit(False)).unionByName(halo, allowMissingColumns=True)


#: How a value of a window follows from those of its two parts, and what a column of nothing gives.
_JOINED = {
    "sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b),
    "max": F.greatest,
    "min": F.least,
}
_AGGREGATES = {"sum": F.sum, "max": F.max, "min": F.min}


def trailing(
    rows: DataFrame,
    targets: DataFrame,
    keys: list[str],
    date_col: str,
    days: int,
    values: dict[str, tuple[str, str]],
) -> DataFrame:
    """``targets`` with sums, maxima and minima of the ``days`` calendar days that end on their date, per key.

    ``values`` maps a name to ``("sum" | "max" | "min", column of rows)``; NULL where the window has no value.
    ``targets`` has the keys and the date, which need not occur in ``rows``; there may be any number of rows a day.

    Time is cut into blocks of ``days``. A window that ends in a block is the end of the block before it plus
    the beginning of its own, so each row is kept once for its own block and copied once to the next, and both
    parts are running aggregates: the cost of a row does not depend on ``days``, and a group
    holds two blocks of a key. A window of one day is one block's own part.
    """
    if days < 1:
        raise ValueError("a window has a day at least")
    names = list(values)
    day = day_number(F.col(date_col))
    # Rows of one key and day are added up first: a day is one row from here on.
    daily = rows.groupBy(*keys, day.alias("_day")).agg(
        *[_AGGREGATES[kind](column).alias(f"_{name}") for name, (kind, column) in values.items()]
    )
    # A row of the block before counts for windows that end before it plus ``days``.
    own = F.struct(F.floor(F.col("_day") / days).alias("_block"), F.col("_day").alias("_at"), F.lit(1).alias("_kind"))
    late = F.struct(
        (F.floor(F.col("_day") / days) + 1).alias("_block"),
        (F.col("_day") + days - 1).alias("_at"),
        F.lit(2).alias("_kind"),
    )
    placed = daily.select("*", F.inline(F.array(own, late)))
    # Targets travel as one column, so that their names meet none used here.
    asked = targets.select(
        *keys,
        F.struct(*[F.col(f"`{c}`") for c in targets.columns]).alias("_target"),
        day.alias("_at"),
        F.floor(day / days).alias("_block"),
        F.lit(0).alias("_kind"),
    )
    line = asked.unionByName(placed.drop("_day"), allowMissingColumns=True)
    block = Window.partitionBy(*keys, "_block")
    # Own days up to the target's, the target after them; days of the block before from the last on, the target last.
    forward = block.orderBy(F.col("_at"), F.col("_kind").desc()).rowsBetween(Window.unboundedPreceding, 0)
    backward = block.orderBy(F.col("_at").desc(), F.col("_kind").desc()).rowsBetween(Window.unboundedPreceding, 0)
    parts = {}
    for name, (kind, _) in values.items():
        aggregate = _AGGREGATES[kind]
        parts[f"_own_{name}"] = aggregate(F.when(F.col("_kind") == 1, F.col(f"_{name}"))).over(forward)
        parts[f"_late_{name}"] = aggregate(F.when(F.col("_kind") == 2, F.col(f"_{name}"))).over(backward)
    joined = {n: _JOINED[values[n][0]](F.col(f"_own_{n}"), F.col(f"_late_{n}")) for n in names}
    return (
        line.withColumns(parts)
        .where("_kind = 0")
        .select("_target.*", *[joined[n].alias(n) for n in names])
    )
