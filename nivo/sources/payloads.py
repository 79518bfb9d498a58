"""Landed weather payloads: one array per variable and a time axis, to rows.

A payload row holds ``location_name``, the axis ``time_start, time_end, interval_s`` in
epoch seconds (the end is exclusive) and one array per variable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from nivo import config


def parse(raw: DataFrame, schema: StructType, json_col: str = "value") -> DataFrame:
    """Payload rows from a column of JSON documents."""
    return raw.select(F.from_json(json_col, schema).alias("_payload")).select("_payload.*")


def _flatten(payload: DataFrame, variables: Sequence[str]) -> DataFrame:
    """One row per time step with its UTC time; variables the payload lacks become NULL.

    A value array that is not as long as the axis is an error, as it would shift values to
    wrong times.
    """
    present = [v for v in variables if v in payload.columns]
    steps = F.ceil((F.col("time_end") - F.col("time_start")) / F.col("interval_s")).cast("int")
    uneven = F.lit(False)
    for name in present:
        uneven = uneven | (F.size(name) != steps)
    zipped = F.when(
        uneven, F.raise_error(F.concat(F.lit("uneven arrays in payload of "), F.col("location_name")))
    ).otherwise(F.arrays_zip(*present))
    keep = [c for c in payload.columns if c not in present and c not in ("time_start", "time_end", "interval_s")]
    rows = payload.select(
        *keep, "time_start", "interval_s", F.posexplode(zipped).alias("_step", "_values")
    )
    seconds = F.col("time_start") + F.col("_step") * F.col("interval_s")
    utc = F.timestamp_add("SECOND", seconds, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    values = [
        F.col(f"_values.{v}").alias(v) if v in present else F.lit(None).cast("double").alias(v) for v in variables
    ]
    return rows.select(*keep, utc.alias("_utc"), *values)


def _local(time: Column, tz: str | Column) -> Column:
    """UTC wall-clock time as local wall-clock time; no session setting takes part."""
    return F.convert_timezone(F.lit("UTC"), tz if isinstance(tz, Column) else F.lit(tz), time)


def flatten_daily(payload: DataFrame, tz: str | Column = config.LOCAL_TIMEZONE, mode: str = "forecast") -> DataFrame:
    """Daily rows; the date is the local day of each step's UTC time.

    In historical mode the two forecast-only variables are NULL.
    """
    if mode not in ("forecast", "historical"):
        raise ValueError(f"mode must be 'forecast' or 'historical', not {mode!r}")
    variables = config.DAILY_VARIABLES + config.FORECAST_ONLY_VARIABLES
    if mode == "historical":
        payload = payload.drop(*config.FORECAST_ONLY_VARIABLES)
    rows = _flatten(payload, variables)
    return rows.withColumn("date", _local(F.col("_utc"), tz).cast("date")).drop("_utc")


def flatten_hourly(payload: DataFrame, tz: str | Column = config.LOCAL_TIMEZONE) -> DataFrame:
    """Hourly rows with local ``timestamp`` and ``date``."""
    rows = _flatten(payload, config.HOURLY_VARIABLES)
    return (
        rows.withColumn("timestamp", _local(F.col("_utc"), tz))
        .withColumn("date", F.col("timestamp").cast("date"))
        .drop("_utc")
    )


def attach_location(rows: DataFrame, locations: DataFrame) -> DataFrame:
    """Add latitude, longitude and elevation of each row's location.

    Rows of unknown locations are dropped, as only known locations are asked for.
    """
    attributes = locations.select(F.col("name").alias("location_name"), "latitude", "longitude", "elevation")
    return rows.join(attributes, "location_name")
