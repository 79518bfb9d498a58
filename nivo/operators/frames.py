"""Operators that work on any frame: top-k, latest rows, distributions, histograms, samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def top_k(df: DataFrame, by: str | Column | list, k: int) -> DataFrame:
    """First k rows of the given order (each task keeps k rows, no full sort)."""
    order = by if isinstance(by, list) else [by]
    return df.orderBy(*order).limit(k)


def latest(df: DataFrame, date_col: str, by: str | list[str] | None = None) -> DataFrame:
    """All rows carrying the greatest date, of the whole frame or of each ``by`` key.

    The greatest date of the whole frame is a scalar subquery, which file scans can use to
    skip partitions. Per key it is a partially aggregated group joined back on key and date.
    """
    if by is None:
        return df.where(F.col(date_col) == df.agg(F.max(date_col)).scalar())
    keys = [by] if isinstance(by, str) else list(by)
    newest = df.groupBy(*keys).agg(F.max(date_col).alias(date_col))
    return df.join(newest, [*keys, date_col], "left_semi")


def newest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in the given order.

    Spark prunes to one row per key inside each map task before the shuffle, so a key with
    many copies does not gather them in one place.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def distribution(df: DataFrame, col: str, total_pct: bool = True, count_name: str = "count") -> DataFrame:
    """Rows per value and, with ``total_pct``, their percentage rounded to two places."""
    counts = df.groupBy(col).agg(F.count("*").alias(count_name))
    if not total_pct:
        return counts
    total = counts.agg(F.sum(count_name)).scalar()
    return counts.withColumn("percentage", F.round(F.col(count_name) / total * 100, 2))


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width histogram between minimum and maximum; the last bin includes its end.

    A constant column gets the range value - 0.5 to value + 0.5. NULLs are not counted.
    """
    limits = df.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"))
    constant = F.col("lo") == F.col("hi")
    limits = limits.select(
        F.struct(
            F.when(constant, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
            F.when(constant, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
        )
    ).scalar()
    low, high = limits["lo"], limits["hi"]
    width = (high - low) / bins
    value = F.col(col).cast("double")
    guess = F.least(F.floor((value - low) / width), F.lit(bins - 1)).cast("int")

    def edge(i: Column) -> Column:
        return F.when(i >= bins, high).otherwise(low + i * width)

    counts = (
        df.where(value.isNotNull())
        .select(value.alias("_v"), guess.alias("_g"))
        .select(
            F.when(F.col("_v") < edge(F.col("_g")), F.col("_g") - 1)
            .when((F.col("_v") >= edge(F.col("_g") + 1)) & (F.col("_g") < bins - 1), F.col("_g") + 1)
            .otherwise(F.col("_g"))
            .alias("bin")
        )
        .groupBy("bin")
        .agg(F.count("*").alias("count"))
    )
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (
        spine.join(counts, "bin", "left")
        .where(low.isNotNull())
        .select(
            "bin",
            (low + F.col("bin") * width).alias("bin_start"),
            F.when(F.col("bin") == bins - 1, high)
            .otherwise(low + (F.col("bin") + 1) * width)
            .alias("bin_end"),
            F.coalesce("count", F.lit(0)).alias("count"),
        )
    )


def sample(df: DataFrame, fraction: float, seed: int = 0, keys: list[str] | None = None) -> DataFrame:
    """Bernoulli sample: each row with probability ``fraction``, whatever the table's size.

    Each row is kept or not by a digest of its key columns (all columns by default), so a
    recomputed task keeps the same rows.
    """
    names = keys or df.columns
    digest = F.md5(F.concat_ws("~", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(2**32)
    return df.where(draw < float(fraction))


def reports(df: DataFrame, sets: Mapping[str, Sequence[str]], aggregates: Sequence[Column]) -> DataFrame:
    """Several groupings of one table from one scan: the aggregates per group, with ``report``, the name of its grouping.

    ``sets`` names each report and its key columns (none for the whole table). A key that a report does not
    group by is NULL in its rows; a NULL key of the table is a group of its own, told apart by ``report``. The
    aggregates may not be distinct ones of many columns, as each would copy the rows again.
    """
    dims = list(dict.fromkeys(c for keys in sets.values() for c in keys))
    # The grouping number has a bit for each key column, the first the highest; it is set where the column is left out.
    numbers = {name: sum(1 << (len(dims) - 1 - i) for i, c in enumerate(dims) if c not in keys) for name, keys in sets.items()}
    if len(set(numbers.values())) < len(numbers):
        raise ValueError("two reports have the same keys")
    if not dims:
        (name,) = sets
        return df.agg(*aggregates).select(F.lit(name).alias("report"), "*")
    grouped = df.groupingSets([[F.col(c) for c in keys] for keys in sets.values()], *dims)
    result = grouped.agg(*aggregates, F.grouping_id().alias("_number"))
    report = F.coalesce(*[F.when(F.col("_number") == n, F.lit(name)) for name, n in numbers.items()])
    return result.select(report.alias("report"), *[c for c in result.columns if c != "_number"])


def newest_from_footers(spark: SparkSession, path: str, col: str) -> DataFrame:
    """One row with the greatest ``col`` of a Parquet table, taken from the statistics in its footers.

    Spark pushes the aggregate into its Parquet reader of the second kind, so no row group is read. That
    reader is asked for in a session of its own; settings of the given one stay as they are. For dates and numbers;
    statistics of texts may be cut short, so Spark reads these as usual.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own.read.parquet(path).agg(F.max(col).alias(col))


def newest_slice(spark: SparkSession, path: str, col: str) -> DataFrame:
    """The rows of a Parquet table that carry the greatest ``col``: the value from the footers, the rows by a pushed filter."""
    newest = newest_from_footers(spark, path, col).first()[0]
    return spark.read.parquet(path).where(F.col(col) == F.lit(newest))
