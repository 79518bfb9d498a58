"""Elevation bands, risk categories and the five-level danger scale."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nivo import config
from nivo.config import Band


def steps(value: Column, cuts: Sequence[tuple], otherwise=None, op=Column.__ge__) -> Column:
    """First label whose bound satisfies ``op(value, bound)``; a NULL value falls through."""
    start, *rest = cuts
    chain = reduce(
        lambda acc, cut: acc.when(op(value, F.lit(cut[0])), cut[1]),
        rest,
        F.when(op(value, F.lit(start[0])), start[1]),
    )
    return chain.otherwise(otherwise)


def elevation_band(
    value: Column,
    bands: Sequence[Band] = config.BANDS,
    outside: str = "open",
    nulls: str = "last",
) -> Column:
    """Band name of an elevation.

    ``outside`` says what happens to values no band contains: ``"last"`` gives the last
    band, ``"null"`` gives NULL, ``"open"`` ignores the outer bounds, so values below the
    first band belong to it and values above the last belong to that. A NULL elevation
    gives the last band unless ``outside="null"`` or ``nulls="null"``.
    """
    last = bands[-1].name
    if outside == "open":
        named = steps(value, [(b.high, b.name) for b in bands[:-1]], last, Column.__lt__)
    elif outside in ("last", "null"):
        inside = [((value >= b.low) & (value < b.high), b.name) for b in bands]
        chain = reduce(lambda acc, c: acc.when(*c), inside[1:], F.when(*inside[0]))
        named = chain.otherwise(last if outside == "last" else None)
    else:
        raise ValueError(f"outside must be 'last', 'null' or 'open', not {outside!r}")
    return F.when(value.isNotNull(), named) if nulls == "null" else named


def risk_category(score: Column) -> Column:
    cuts = [(0.8, "Muy Alto"), (0.6, "Alto"), (0.4, "Moderado"), (0.2, "Bajo")]
    return steps(score, cuts, "Muy Bajo")


def danger_level(score: Column) -> Column:
    return steps(score, [(0.2, 1), (0.4, 2), (0.6, 3), (0.8, 4)], 5, Column.__lt__)


def danger_attribute(level: Column, attribute: str) -> Column:
    """An attribute of the danger scale (``label``, ``color``, ...) for a level column."""
    rows = [(row["level"], row[attribute]) for row in config.DANGER_SCALE]
    return steps(level, rows, op=Column.__eq__)


def danger_scale(spark: SparkSession) -> DataFrame:
    """The danger scale as a five-row dimension table."""
    columns = list(config.DANGER_SCALE[0])
    schema = "level int, " + ", ".join(f"{c} string" for c in columns[1:])
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in config.DANGER_SCALE], schema)


#: Bands whose index a row can carry while it is looked up; a table of more is refused.
MOST_BANDS = 1_000


def breakpoint_index(bands: DataFrame) -> Column:
    """The intervals of ``bands(band, low, high)`` as one row: their breakpoints in order and the bands from each on.

    Between two neighbouring breakpoints the same bands hold, so overlapping, nested and open intervals become
    disjoint pieces, each with the list of its bands. It is a scalar subquery: the plan stays lazy, and
    whatever is looked up needs neither a join nor a shuffle.
    """
    low = F.coalesce(F.col("low").cast("double"), F.lit(float("-inf"))).alias("low")
    high = F.coalesce(F.col("high").cast("double"), F.lit(float("inf"))).alias("high")
    real = bands.select(low, high, "band").where("low < high")
    # A row of at most MOST_BANDS bands; the count is compared before they are gathered.
    counted = real.agg(F.count(F.lit(1)).alias("n")).scalar()
    few = F.when(counted > MOST_BANDS, F.raise_error(F.lit(f"more than {MOST_BANDS} bands"))).otherwise(True)
    listed = real.where(few.cast("boolean")).agg(F.sort_array(F.collect_list(F.struct("low", "high", "band"))).alias("b"))
    edges = F.flatten(F.transform("b", lambda x: F.array(x["low"], x["high"])))
    pointed = listed.select("b", F.array_sort(F.array_distinct(edges)).alias("points"))

    def holding(point: Column) -> Column:
        held = F.filter("b", lambda x: (x["low"] <= point) & (point < x["high"]))
        return F.transform(held, lambda x: x["band"])

    return pointed.select(F.struct("points", F.transform("points", holding).alias("bands"))).scalar()


def piece_of(value: Column, points: Column) -> Column:
    """How many of the sorted ``points`` are at or below the value, by binary search."""
    rounds = F.ceil(F.log2(F.greatest(F.size(points), F.lit(1)) + 1)).cast("int")
    start = F.struct(F.lit(0).alias("lo"), F.size(points).alias("hi"))

    def halve(range_: Column, _: Column) -> Column:
        middle = F.floor((range_["lo"] + range_["hi"]) / 2).cast("int")
        open_ = range_["lo"] < range_["hi"]
        right = open_ & (F.get(points, middle) <= value)
        return F.struct(
            F.when(right, middle + 1).otherwise(range_["lo"]).alias("lo"),
            F.when(open_ & ~right, middle).otherwise(range_["hi"]).alias("hi"),
        )

    return F.aggregate(F.sequence(F.lit(1), rounds), start, halve, lambda range_: range_["lo"])


def lookup_band(df: DataFrame, value_col: str, bands: DataFrame) -> DataFrame:
    """Each row with the ``band`` of ``bands(band, low, high)`` whose interval ``[low, high)`` holds its value.

    A NULL or infinite bound is open. Values are looked up where they lie, by binary search in the breakpoints
    of the bands: the input is scanned once and not shuffled, wherever values and bounds lie. A value
    that several bands hold has a row for each; one that none holds, like NULL, NaN and infinite ones, has NULL.
    Empty intervals hold nothing. A disjoint band table gives one row per input row. The bands are
    dimension data: more than ``MOST_BANDS`` are an error.
    """
    value = F.col(value_col).cast("double")
    carrying = df.withColumn("_index", breakpoint_index(bands))
    index = F.col("_index")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    place = piece_of(value, index["points"])
    held = F.when(finite & (place > 0), F.get(index["bands"], place - 1))
    return carrying.withColumn("_held", held).select(
        *[F.col(f"`{c}`") for c in df.columns], F.explode_outer("_held").alias("band")
    )
