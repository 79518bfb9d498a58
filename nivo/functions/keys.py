"""Deterministic identifiers built from the columns that define a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _slug(value: Column) -> Column:
    return F.regexp_replace(value, " ", "_")


def zone_id(zone: Column, band: Column) -> Column:
    return F.concat(F.lit("zone_"), _slug(zone), F.lit("_"), _slug(band))


def prediction_id(date: Column, zone: Column, band: Column) -> Column:
    return F.concat(
        F.lit("pred_"), F.date_format(date, "yyyyMMdd"), F.lit("_"), _slug(zone), F.lit("_"), _slug(band)
    )


def pattern_id(route: Column) -> Column:
    return F.concat(F.lit("nlp_"), route.cast("string"))


def feature_id(date: Column, location: Column) -> Column:
    return F.concat(F.lit("weather_"), F.date_format(date, "yyyyMMdd"), F.lit("_"), location)


def bulletin_id(date: Column, zone: Column) -> Column:
    return F.concat(F.lit("boletin_"), F.date_format(date, "yyyyMMdd"), F.lit("_"), _slug(zone))


def grid_id(cell_id: Column, start: int = 6) -> Column:
    """Map key of a cell: its identifier without the prefix that ends before ``start``."""
    return F.concat(F.lit("grid_"), F.substring(cell_id, start, 12))


def row_key(*cols: Column, length: int = 12) -> Column:
    """Hex digest of the key columns. Unlike a random id it survives a recomputed task."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    return F.substring(F.sha2(F.concat_ws("~", *parts), 256), 1, length)
