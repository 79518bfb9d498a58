"""Scoring forecasts against observed events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nivo.operators import frames


def match(observed: DataFrame, predictions: DataFrame, tolerance: int = 1) -> DataFrame:
    """Each observed event with the newest prediction for its date, zone and band.

    Events without a prediction stay, with NULLs. ``error`` is absolute, ``signed_error``
    is predicted minus observed, ``acierto`` means an error within the tolerance.
    """
    key = ["forecast_date", "zone_name", "elevation_band"]
    stamp = [F.desc("prediction_timestamp")] if "prediction_timestamp" in predictions.columns else []
    newest = frames.newest_per_key(predictions, key, [*stamp, F.desc("risk_score")]).select(
        F.col("forecast_date").alias("fecha"),
        F.col("zone_name").alias("zona"),
        "elevation_band",
        F.col("eaws_level").alias("nivel_predicho"),
        "risk_score",
        "confidence",
    )
    off = F.col("nivel_predicho") - F.col("nivel_eaws_observado")
    return observed.join(newest, ["fecha", "zona", "elevation_band"], "left").select(
        "fecha",
        "zona",
        "elevation_band",
        F.col("nivel_eaws_observado").alias("nivel_observado"),
        "nivel_predicho",
        F.abs(off).alias("error"),
        off.alias("signed_error"),
        (F.abs(off) <= tolerance).alias("acierto"),
        "risk_score",
        "confidence",
    )


def metrics(matched: DataFrame) -> DataFrame:
    """One row: matched events, hits, accuracy in percent, mean absolute error, unmatched."""
    total, hits = F.count("error"), F.count_if("acierto")
    return matched.agg(
        total.alias("total"),
        hits.alias("aciertos"),
        F.when(total > 0, hits / total * 100).otherwise(0.0).alias("accuracy"),
        F.avg("error").alias("mae"),
        F.count_if(F.col("error").isNull()).alias("unmatched"),
    )


def error_distribution(matched: DataFrame) -> DataFrame:
    return matched.where("error is not null").groupBy("error").agg(F.count("*").alias("count"))


def by_level(matched: DataFrame) -> DataFrame:
    """Accuracy in percent and number of events per observed level."""
    hit = F.col("acierto").cast("double")
    return (
        matched.where("error is not null")
        .groupBy("nivel_observado")
        .agg((F.avg(hit) * 100).alias("accuracy"), F.count("*").alias("events"))
    )
