"""Row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nivo.config import HIGH_SUSCEPTIBILITY, BBox


#: Places over which the rows of one bucket are dealt for a join.
SALTS = 8


def inside(bbox: BBox, lat: str = "latitude", lon: str = "longitude") -> Column:
    return F.col(lat).between(bbox.south, bbox.north) & F.col(lon).between(bbox.west, bbox.east)


def in_bbox(df: DataFrame, bbox: BBox) -> DataFrame:
    """Rows inside the box, borders included."""
    return df.where(inside(bbox))


def assign_zone(points: DataFrame, zones: DataFrame, bucket: float = 0.1) -> DataFrame:
    """Add ``zone_name``, the zone whose box (zone_name, south, north, west, east) holds the point.

    Points in several boxes get the first zone by name, points in none NULL; no point is lost or
    doubled. The boxes that reach a grid bucket of ``bucket`` degrees are gathered on its row, so each point meets
    one row at most, and the zone is picked inside the row. A bucket's row is dealt to ``SALTS``
    places, and so are the points of a popular bucket.
    """

    def bucket_of(degrees: str) -> Column:
        return F.floor(F.col(degrees) / bucket)

    def reach(low: str, high: str) -> Column:
        return F.explode(F.sequence(bucket_of(low), bucket_of(high)))

    box = F.struct("zone_name", "south", "north", "west", "east")
    boxes = (
        zones.select("*", reach("south", "north").alias("_lat"))
        .select(box.alias("box"), "_lat", reach("west", "east").alias("_lon"))
        .groupBy("_lat", "_lon")
        .agg(F.collect_list("box").alias("_boxes"))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    lat, lon = F.col("latitude"), F.col("longitude")
    dealt = points.withColumns(
        {
            "_lat": bucket_of("latitude"),
            "_lon": bucket_of("longitude"),
            "_salt": F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in points.columns]), F.lit(SALTS)).cast("int"),
        }
    )
    holding = F.filter(
        "_boxes", lambda b: lat.between(b["south"], b["north"]) & lon.between(b["west"], b["east"])
    )
    first = F.array_min(F.transform(holding, lambda b: b["zone_name"]))
    return (
        dealt.join(boxes, ["_lat", "_lon", "_salt"], "left")
        .withColumn("zone_name", first)
        .drop("_boxes", "_lat", "_lon", "_salt")
    )


def filter_or_all(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows that satisfy the predicate, or every row when none does.

    Whether any row matches is a scalar subquery, so the plan stays lazy. The subquery
    reads only the predicate's columns.
    """
    none_match = df.agg(F.count_if(predicate).alias("n") == 0).scalar()
    return df.where(predicate | none_match)


def high_susceptibility(df: DataFrame, minimum: float = HIGH_SUSCEPTIBILITY) -> DataFrame:
    return df.where(F.col("susceptibility_score") >= minimum)


def historical_high_risk(patterns: DataFrame, minimum: float = 0.5) -> DataFrame:
    return patterns.where((F.col("avalanche_events") > 0) | (F.col("confidence") >= minimum))


def critical_triggers(triggers: DataFrame) -> DataFrame:
    return triggers.where(F.col("is_critical"))


def at_least_level(predictions: DataFrame, level: int = 3) -> DataFrame:
    return predictions.where(F.col("eaws_level") >= level)
