"""Data quality: checks, null counts, value ranges, table inventory."""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nivo.config import HIGH_QUALITY, BBox
from nivo.functions import bands
from nivo.sources import tables

REQUIRED = ("latitude", "longitude", "elevation", "slope_degrees", "aspect_degrees")
WEATHER_REQUIRED = ("temperature_2m_mean", "snowfall_sum", "windspeed_10m_max")
WEATHER_RANGES = {
    "min_temp": ("min", "temperature_2m_min"),
    "max_temp": ("max", "temperature_2m_max"),
    "min_snow": ("min", "snowfall_sum"),
    "max_snow": ("max", "snowfall_sum"),
    "min_wind": ("min", "windspeed_10m_max"),
    "max_wind": ("max", "windspeed_10m_max"),
}

# Parts of a table name that place it in a layer, tested in this order.
LAYER_NAMES = {
    "bronze": ("weather_daily", "weather_hourly", "srtm_raw", "locations"),
    "silver": ("topo_features", "topo_susceptibility", "nlp_", "weather_features", "weather_triggers"),
    "gold": ("predictions", "bulletins", "susceptibility_map"),
}


@dataclass(frozen=True)
class Check:
    """An aggregate of a table and the comparison it has to pass; ``error`` stops a write, ``warning`` and ``info`` do not."""

    name: str
    severity: str
    value: Column
    test: str
    bound: float | None = None


#: Comparisons of a check; they work on columns and on numbers alike.
TESTS = {"==": operator.eq, ">": operator.gt, ">=": operator.ge, "<=": operator.le}


def judge(checks: Sequence[Check], values: Mapping[str, float | None]) -> list[tuple[str, str, float | None, bool]]:
    """(check, severity, value, passed) for values measured elsewhere, such as while a table was written."""
    out = []
    for check in checks:
        value = values[check.name]
        passed = value is not None and (check.test == "known" or TESTS[check.test](value, check.bound))
        out.append((check.name, check.severity, None if value is None else float(value), passed))
    return out


def measure(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """The checks as rows (check, severity, value, passed); one pass over the table."""
    measured = df.agg(*[check.value.alias(check.name) for check in checks])
    rows = []
    for check in checks:
        value = F.col(check.name)
        passed = value.isNotNull() if check.test == "known" else TESTS[check.test](value, check.bound)
        rows.append(
            F.struct(
                F.lit(check.name).alias("check"),
                F.lit(check.severity).alias("severity"),
                value.cast("double").alias("value"),
                F.coalesce(passed, F.lit(False)).alias("passed"),
            )
        )
    return measured.select(F.inline(F.array(*rows)))


def cell_checks(
    bbox: BBox, min_rows: int = 1000, coverage: float = 0.8, min_quality: float = HIGH_QUALITY
) -> list[Check]:
    """Checks of a cell feature table."""

    def span(name: str) -> Column:
        return F.max(name) - F.min(name)

    def outside(name: str, high: float) -> Column:
        return F.count_if((F.col(name) < 0) | (F.col(name) > high))

    covered = F.least(span("latitude") / (bbox.north - bbox.south), span("longitude") / (bbox.east - bbox.west))
    faults = {
        **{f"null_{c}": F.count_if(F.col(c).isNull()) for c in REQUIRED},
        "negative_elevation": F.count_if(F.col("elevation") < 0),
        "slope_range": outside("slope_degrees", 90),
        "aspect_range": outside("aspect_degrees", 360),
    }
    return [
        Check("not_empty", "error", F.count(F.lit(1)), ">", 0),
        *[Check(name, "error", value, "==", 0) for name, value in faults.items()],
        Check("enough_rows", "warning", F.count(F.lit(1)), ">=", min_rows),
        Check("coverage", "warning", covered, ">=", coverage),
        Check("quality", "warning", F.avg("gee_quality_flag"), ">=", min_quality),
    ]


def slope_checks(strict: bool = False) -> list[Check]:
    """Cells that the mask cut off from their neighbours, so that they have no slope."""
    missing = F.count_if(F.col("slope_degrees").isNull())
    return [Check("cells_without_slope", "error" if strict else "warning", missing, "==", 0)]


def range_checks(col: str, low: float = 0.0, high: float = 1.0) -> list[Check]:
    return [
        Check(f"{col}_min", "error", F.min(col), ">=", low),
        Check(f"{col}_max", "error", F.max(col), "<=", high),
        Check(f"{col}_avg", "info", F.avg(col), "known"),
    ]


def weather_checks(cols=WEATHER_REQUIRED, cols_of: Mapping[str, tuple[str, str]] | None = None) -> list[Check]:
    """Missing values and value ranges of weather rows, for the record."""
    functions = {"min": F.min, "max": F.max}
    nulls = [Check(f"null_{c}", "info", F.count_if(F.col(c).isNull()), "==", 0) for c in cols]
    named = (WEATHER_RANGES if cols_of is None else cols_of).items()
    return nulls + [Check(name, "info", functions[f](c), "known") for name, (f, c) in named]


def check_cells(
    cells: DataFrame, bbox: BBox, min_rows: int = 1000, coverage: float = 0.8, min_quality: float = HIGH_QUALITY
) -> DataFrame:
    """Checks of a cell feature table as rows (check, severity, value, passed); one pass."""
    return measure(cells, cell_checks(bbox, min_rows, coverage, min_quality))


def check_range(df: DataFrame, col: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Minimum, maximum and mean of a column as checks against [low, high]."""
    return measure(df, range_checks(col, low, high))


class ChecksFailed(ValueError):
    """An error-level check failed; ``results`` has all of them."""

    def __init__(self, results: list[tuple[str, str, float | None, bool]]):
        self.results = results
        failed = sorted(f"{r[0]} ({'NULL' if r[2] is None else r[2]})" for r in results if r[1] == "error" and not r[3])
        super().__init__("checks failed: " + ", ".join(failed))


def enforce(checks: DataFrame) -> None:
    """Raise if an error-level check failed (a check table has a dozen rows)."""
    name = F.concat(F.col("check"), F.lit(" ("), F.coalesce(F.col("value").cast("string"), F.lit("NULL")), F.lit(")"))
    failed = checks.where("severity = 'error' and not passed").agg(F.collect_list(name)).first()[0]
    if failed:
        raise ValueError("checks failed: " + ", ".join(sorted(failed)))


def quality_metrics(cells: DataFrame, threshold: float = HIGH_QUALITY) -> DataFrame:
    flag = F.col("gee_quality_flag")
    return cells.agg(
        F.count("*").alias("total_features"),
        F.avg(flag).alias("avg_quality"),
        F.min(flag).alias("min_quality"),
        F.max(flag).alias("max_quality"),
        F.count_if(flag >= threshold).alias("high_quality_count"),
        F.count_if(flag < threshold).alias("low_quality_count"),
    )


def scale_counts(cells: DataFrame) -> DataFrame:
    return cells.groupBy("gee_scale").agg(F.count("*").alias("count"))


def null_counts(df: DataFrame, cols=WEATHER_REQUIRED) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])


def ranges(df: DataFrame, cols: Mapping[str, tuple[str, str]] = WEATHER_RANGES) -> DataFrame:
    """One row with the named minima and maxima, given as name -> ("min" | "max", column)."""
    functions = {"min": F.min, "max": F.max}
    return df.agg(*[functions[f](c).alias(name) for name, (f, c) in cols.items()])


def layer(name: Column) -> Column:
    """Layer of a table by its name; NULL when no part matches."""
    conditions = [
        (reduce(Column.__or__, [name.contains(part) for part in parts]), label)
        for label, parts in LAYER_NAMES.items()
    ]
    return bands.steps(F.lit(True), conditions, op=Column.__eq__)


def table_inventory(spark: SparkSession, names: Mapping[str, str]) -> DataFrame:
    """Rows, status (ok, empty, missing) and layer of each table, given as name -> location.

    A location is a catalog name or a path. The counts are one lazy plan; for Parquet they
    come from file footers.
    """
    found = {name: tables.find(spark, location) for name, location in names.items()}
    counted = [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, df in found.items()
        if df is not None
    ]
    missing = [(name, None) for name, df in found.items() if df is None]
    absent = spark.createDataFrame(missing, "table_name string, rows bigint")
    status = F.when(F.col("rows").isNull(), "missing").when(F.col("rows") == 0, "empty").otherwise("ok")
    return reduce(DataFrame.unionByName, counted, absent).select(
        "table_name", layer(F.col("table_name")).alias("layer"), "rows", status.alias("status")
    )


def catalog_layers(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Number of catalog tables per layer; tables of no layer are counted under NULL."""
    rows = [(t.name,) for t in spark.catalog.listTables(database)]
    return (
        spark.createDataFrame(rows, "table_name string")
        .groupBy(layer(F.col("table_name")).alias("layer"))
        .agg(F.count("*").alias("tables"))
    )
