"""The registered queries: name -> function of (session, directory of the test tables)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from nivo import (
    bands,
    bulletins,
    config,
    contracts,
    filters,
    frames,
    fusion,
    ingest,
    keys,
    payloads,
    quality,
    sinks,
    sources,
    terrain,
    text,
    validation,
    weather,
)
from nivo.config import BBox
from nivo.operators import lookback
from nivo.sources import scratch
from nivo.plans import testdata as td

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DIGITS = 6
EMPTY_BOX = BBox(10.0, 11.0, 10.0, 11.0)
CELL_BOX = BBox(-33.40, -33.37, -70.32, -70.296)
AS_OF = dt.date(2024, 1, 20)


def _register(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, since sums taken in another order differ in the last bits."""
    return df.select(
        *[
            (F.round(F.col(name), digits) + 0.0).alias(name) if kind == "double" else F.col(name)
            for name, kind in df.dtypes
        ]
    )


# --- Shared inputs -----------------------------------------------------------------------


def _features(spark, d, per_user=False, frame="rows"):
    return weather.features(td.weather_daily(spark, d, per_user), frame)


def _triggers(spark, d, per_user=False):
    return weather.detect_triggers(_features(spark, d, per_user))


def _cells_v1(spark, d):
    return terrain.features(td.slopes(spark, d), "v1")


def _cells_v2(spark, d):
    return terrain.features(td.slopes(spark, d), "v2")


def _susceptibility(spark, d):
    return terrain.susceptibility_table(_cells_v1(spark, d), "v1")


def _reports(spark, d):
    return td.reports(spark, d)


def _patterns(spark, d):
    return text.patterns(_reports(spark, d), F.col("zone_name"))


def _topo(spark, d):
    cells = terrain.features(td.relabelled_slopes(spark, d), "v1")
    return fusion.topo_evidence(terrain.susceptibility_table(cells, "v1"))


def _weather_tables(spark, d):
    """Feature table and triggers."""
    rows = _features(spark, d)
    return weather.feature_table(rows), weather.detect_triggers(rows)


def _fusion_inputs(spark, d):
    return *_weather_tables(spark, d), _topo(spark, d), text.by_band(_patterns(spark, d))


def _fused(spark, d):
    table, triggers, topo, nlp = _fusion_inputs(spark, d)
    return fusion.fuse(topo, nlp, fusion.weather_by_band(table, triggers))


def _fused_rows(spark, d, newest):
    """The same evidence from one aggregation; features carry their critical triggers."""
    cells = terrain.features(td.relabelled_slopes(spark, d), "v1")
    topo, nlp = terrain.susceptibility_table(cells, "v1"), _patterns(spark, d)
    return fusion.fuse_rows(topo, nlp, weather.feature_table(_features(spark, d), with_triggers=True), None, newest)


def _predictions(spark, d):
    newest = td.weather_daily(spark, d).agg(F.max("date")).scalar()
    return fusion.predictions(fusion.score(_fused_rows(spark, d, newest)), newest)


def _backtest(spark, d):
    table, triggers, topo, nlp = _fusion_inputs(spark, d)
    return fusion.backtest(table, triggers, topo, nlp)


def _matched(spark, d):
    observed = td.observed(spark, d)
    table, triggers, topo, nlp = _fusion_inputs(spark, d)
    asked = observed.select(F.col("zona").alias("zone_name"), F.col("fecha").alias("forecast_date"))
    return validation.match(observed, fusion.backtest(table, triggers, topo, nlp, asked))


def _joined(column: str, separator: str = "; "):
    return F.array_join(column, separator).alias(column)


# --- Filters, bands, keys, frames --------------------------------------------------------


@_register
def filter_bbox(spark, d):
    return rounded(filters.in_bbox(td.reports(spark, d), config.PILOT_ZONE.bbox).select("route_id", "latitude", "longitude"))


@_register
def zone_assign(spark, d):
    shift = F.col("r_regionkey") * 0.05
    zones = td.read(spark, d, "region").select(
        F.col("r_name").alias("zone_name"),
        (F.lit(-33.45) + shift).alias("south"),
        (F.lit(-33.41) + shift).alias("north"),
        (F.lit(-70.37) + shift).alias("west"),
        (F.lit(-70.34) + shift).alias("east"),
    )
    reports = td.reports(spark, d).drop("zone_name", "description")
    return filters.assign_zone(reports, zones).select("route_id", "zone_name")


@_register
def filter_or_all(spark, d):
    kept = filters.filter_or_all(td.reports(spark, d), filters.inside(config.PILOT_ZONE.bbox))
    return kept.select("route_id", "zone_name")


@_register
def filter_or_all_no_match(spark, d):
    return filters.filter_or_all(td.reports(spark, d), filters.inside(EMPTY_BOX)).select("route_id", "zone_name")


def _band_query(outside):
    def query(spark, d):
        shifted = (F.col("o_totalprice") / 50 - 500).alias("elevation")
        orders = td.read(spark, d, "orders").select("o_orderkey", shifted)
        known = F.when(F.col("o_orderkey") % 50 != 0, F.col("elevation"))
        return orders.select("o_orderkey", bands.elevation_band(known, outside=outside).alias("band"))

    return query


for _outside in ("last", "null", "open"):
    QUERIES[f"elevation_band_{_outside}"] = _band_query(_outside)


@_register
def band_range_join(spark, d):
    rows = [(b.name, float(b.low), float(b.high)) for b in config.BANDS]
    table = spark.createDataFrame(rows, "band string, low double, high double")
    orders = td.read(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 50 - 500).alias("elevation"))
    return bands.lookup_band(orders, "elevation", table).select("o_orderkey", "band")


@_register
def band_overlaps(spark, d):
    """Prices by overlapping, nested and open ranges: a row for each that holds them, NULL where none does."""
    rows = [("any", None, 90_000.0), ("mid", 50_000.0, 200_000.0), ("inner", 120_000.0, 120_500.0), ("top", 350_000.0, None)]
    table = spark.createDataFrame(rows, "band string, low double, high double")
    found = bands.lookup_band(td.read(spark, d, "orders"), "o_totalprice", table)
    return found.groupBy("o_orderstatus", "band").agg(F.count("*").alias("orders"))


@_register
def critical_slope(spark, d):
    return td.slopes(spark, d).select(
        "zone_name", "row", "col", terrain.critical_slope(F.col("slope_degrees")).alias("is_critical_slope")
    )


@_register
def cell_quality(spark, d):
    key = F.col("o_orderkey")
    cells = td.read(spark, d, "orders").select(
        "o_orderkey",
        F.when(key % 7 != 0, F.col("o_totalprice") / 50 - 500).alias("elevation"),
        (key % 100).cast("double").alias("slope_degrees"),
        (key % 400).cast("double").alias("aspect_degrees"),
    )
    return terrain.quality_flag(cells).select("o_orderkey", "gee_quality_flag")


@_register
def cell_quality_filter(spark, d):
    key = F.col("o_orderkey")
    cells = td.read(spark, d, "orders").select(
        "o_orderkey",
        (F.col("o_totalprice") / 50 - 500).alias("elevation"),
        (key % 100).cast("double").alias("slope_degrees"),
        (key % 400).cast("double").alias("aspect_degrees"),
    )
    return terrain.keep_quality(terrain.quality_flag(cells)).select("o_orderkey", "slope_degrees")


@_register
def quality_loss(spark, d):
    return terrain.quality_loss(_cells_v2(spark, d))


@_register
def last_n_days(spark, d):
    return rounded(weather.last_n_days(td.weather_daily(spark, d), 3).select("location_name", "date", "snowfall_sum"))


@_register
def latest_slice(spark, d):
    return rounded(frames.latest(td.weather_daily(spark, d), "date").select("location_name", "date", "snowfall_sum"))


@_register
def latest_per_location(spark, d):
    daily = td.weather_daily(spark, d, per_user=True)
    return rounded(frames.latest(daily, "date", "location_name").select("location_name", "date", "snowfall_sum"))


@_register
def keys_build(spark, d):
    daily = td.weather_daily(spark, d)
    band = bands.elevation_band(F.col("elevation"))
    zone, date = F.col("location_name"), F.col("date")
    cell = F.concat(F.lit("topo_"), keys.row_key(zone, date))
    return daily.select(
        keys.zone_id(zone, band).alias("zone_id"),
        keys.prediction_id(date, F.concat(F.lit("Valle "), zone), band).alias("prediction_id"),
        keys.pattern_id(zone).alias("pattern_id"),
        keys.feature_id(date, zone).alias("feature_id"),
        keys.row_key(zone, date).alias("row_key"),
        keys.grid_id(cell).alias("grid_id"),
    )


@_register
def top_k(spark, d):
    table = _susceptibility(spark, d).select("zone_name", "elevation_band", "susceptibility_score")
    return rounded(frames.top_k(table, [F.desc("susceptibility_score"), "zone_name", "elevation_band"], 10))


@_register
def latest_rows(spark, d):
    daily = td.weather_daily(spark, d).select("location_name", "date", "snowfall_sum")
    return rounded(frames.top_k(daily, [F.desc("date"), "location_name"], 10))


@_register
def latest_row(spark, d):
    predictions = _backtest(spark, d).select("zone_name", "forecast_date", "elevation_band", "eaws_level")
    return frames.top_k(predictions, [F.desc("forecast_date"), "zone_name", "elevation_band"], 1)


@_register
def report_sorts(spark, d):
    table = _susceptibility(spark, d).select("zone_name", "elevation_band", "susceptibility_score", "avg_slope_degrees")
    return rounded(table.orderBy(F.desc("susceptibility_score")))


@_register
def sample_to(spark, d):
    cells = td.cells(spark, d).select("zone_name", "row", "col")
    return frames.sample(cells, 0.1, seed=7, keys=["zone_name", "row", "col"])


@_register
def threshold_filters(spark, d):
    scores = filters.high_susceptibility(_susceptibility(spark, d), 0.5)
    risky = filters.historical_high_risk(_patterns(spark, d))
    critical = filters.critical_triggers(_triggers(spark, d))
    danger = filters.at_least_level(_backtest(spark, d), 3)
    rows = [
        scores.select(F.lit("susceptibility").alias("filter"), F.col("zone_id").alias("id")),
        risky.select(F.lit("reports").alias("filter"), F.col("pattern_id").alias("id")),
        critical.select(F.lit("triggers").alias("filter"), F.col("trigger_id").alias("id")),
        danger.select(F.lit("danger").alias("filter"), F.col("prediction_id").alias("id")),
    ]
    return rows[0].unionAll(rows[1]).unionAll(rows[2]).unionAll(rows[3])


@_register
def top_historical(spark, d):
    risky = filters.historical_high_risk(_patterns(spark, d))
    ranked = frames.top_k(risky, [F.desc("confidence"), "pattern_id"], 20)
    return rounded(ranked.select("pattern_id", "confidence", "avalanche_events"))


# --- Terrain -----------------------------------------------------------------------------


@_register
def grid_make(spark, d):
    boxes = td.cells(spark, d).groupBy("zone_name").agg(
        F.min("latitude").alias("south"),
        (F.max("latitude") + 0.0003).alias("north"),
        F.min("longitude").alias("west"),
        (F.max("longitude") + 0.0003).alias("east"),
    )
    zone = config.PILOT_ZONE
    return rounded(
        terrain.make_grid(boxes, 0.0006).withColumn(
            "distance_km",
            terrain.distance_km(F.col("latitude"), F.col("longitude"), zone.latitude, zone.longitude),
        )
    )


@_register
def box_areas(spark, d):
    boxes = td.cells(spark, d).groupBy("zone_name").agg(
        F.min("latitude").alias("south"),
        F.max("latitude").alias("north"),
        F.min("longitude").alias("west"),
        F.max("longitude").alias("east"),
    )
    area = terrain.box_area(F.col("south"), F.col("north"), F.col("west"), F.col("east"))
    return rounded(boxes.select("zone_name", area.alias("area_km2")))


@_register
def terrain_slope_aspect(spark, d):
    return rounded(td.slopes(spark, d).select("zone_name", "row", "col", "slope_degrees", "aspect_degrees"))


@_register
def terrain_tiles(spark, d):
    """The same over tiles of 7 by 7 cells, so that most neighbours come from another tile."""
    steep = terrain.gradient(td.cells(spark, d), td.CELL_M, td.CELL_M, tile=7)
    turned = terrain.aspect(terrain.slope(steep))
    return rounded(turned.select("zone_name", "row", "col", "slope_degrees", "aspect_degrees"))


@_register
def terrain_horn_compass(spark, d):
    steep = terrain.gradient(td.cells(spark, d), td.CELL_M, td.CELL_M, method="horn")
    turned = terrain.aspect(terrain.slope(steep), "compass")
    return rounded(turned.select("zone_name", "row", "col", "slope_degrees", "aspect_degrees"))


@_register
def terrain_dense(spark, d):
    """Slope and aspect from dense arrays of 16 by 16 cells."""
    steep = terrain.gradient_dense(td.cells(spark, d), td.CELL_M, td.CELL_M, tile=16)
    turned = terrain.aspect(terrain.slope(steep))
    return rounded(turned.select("zone_name", "row", "col", "slope_degrees", "aspect_degrees"))


@_register
def terrain_dense_masked(spark, d):
    """The same over a grid with cells cut out."""
    masked = terrain.mask_elevation(terrain.clip(td.cells(spark, d), CELL_BOX))
    steep = terrain.aspect(terrain.slope(terrain.gradient_dense(masked, td.CELL_M, td.CELL_M)))
    return rounded(steep.select("zone_name", "row", "col", "slope_degrees", "aspect_degrees"))


@_register
def terrain_dense_horn(spark, d):
    steep = terrain.gradient_dense(td.cells(spark, d), td.CELL_M, td.CELL_M, method="horn")
    turned = terrain.aspect(terrain.slope(steep), "compass")
    return rounded(turned.select("zone_name", "row", "col", "slope_degrees", "aspect_degrees"))


@_register
def terrain_features(spark, d):
    return rounded(_cells_v1(spark, d))


@_register
def terrain_features_v2(spark, d):
    return rounded(_cells_v2(spark, d))


@_register
def terrain_masked(spark, d):
    masked = terrain.mask_elevation(terrain.clip(td.cells(spark, d), CELL_BOX))
    steep = terrain.aspect(terrain.slope(terrain.gradient(masked, td.CELL_M, td.CELL_M)))
    return rounded(steep.select("zone_name", "row", "col", "slope_degrees", "aspect_degrees"))


@_register
def terrain_thin(spark, d):
    coarse = terrain.coarsen(td.cells(spark, d), 2, base_scale=td.CELL_M)
    steep = terrain.gradient(coarse, F.col("scale"), F.col("scale"))
    return rounded(terrain.slope(steep).select("zone_name", "row", "col", "scale", "n_cells", "slope_degrees"))


@_register
def terrain_area_stats(spark, d):
    return rounded(terrain.area_stats(td.slopes(spark, d)))


@_register
def band_stats(spark, d):
    return rounded(terrain.band_stats(_cells_v2(spark, d)))


@_register
def band_stats_all_zones(spark, d):
    return rounded(terrain.band_stats(_cells_v1(spark, d), ["elevation_band"]))


@_register
def band_shares(spark, d):
    return rounded(terrain.band_shares(_cells_v1(spark, d)))


@_register
def susceptibility_v1(spark, d):
    return rounded(_susceptibility(spark, d))


@_register
def susceptibility_v2(spark, d):
    return rounded(terrain.susceptibility_table(terrain.keep_quality(_cells_v2(spark, d)), "v2"))


@_register
def dominant_aspect_circular(spark, d):
    stats = terrain.band_stats(_cells_v1(spark, d), circular=True)
    return rounded(
        stats.select(
            "zone_name",
            "elevation_band",
            "avg_aspect_degrees",
            terrain.dominant_aspect(F.col("avg_aspect_degrees")).alias("dominant_aspect"),
        )
    )


@_register
def susceptibility_map(spark, d):
    cells = _cells_v1(spark, d)
    return rounded(terrain.susceptibility_map(cells, terrain.susceptibility_table(cells, "v1")))


@_register
def susceptibility_map_v2(spark, d):
    cells = terrain.keep_quality(_cells_v2(spark, d))
    return rounded(terrain.susceptibility_map(cells, terrain.susceptibility_table(cells, "v2")))


@_register
def risk_distribution(spark, d):
    cells = _cells_v1(spark, d)
    mapped = terrain.susceptibility_map(cells, terrain.susceptibility_table(cells, "v1"))
    return frames.distribution(mapped, "risk_category", count_name="pixel_count")


@_register
def terrain_summary(spark, d):
    return rounded(terrain.summary(_susceptibility(spark, d)))


@_register
def slope_histogram(spark, d):
    return rounded(frames.histogram(td.slopes(spark, d), "slope_degrees", 50))


# --- Text --------------------------------------------------------------------------------


@_register
def text_mentions(spark, d):
    counted = text.risk_score(text.mention_counts(_reports(spark, d)))
    return rounded(counted.select("route_id", *text.VOCABULARY, "nlp_risk_score"))


def _slope_query(strict):
    def query(spark, d):
        found = text.slope_mentions(_reports(spark, d), strict=strict)
        return rounded(found.select("route_id", "mentioned_slope_min", "mentioned_slope_max", "mentioned_slope_avg"))

    return query


QUERIES["text_slopes"] = _slope_query(False)
QUERIES["text_slopes_strict"] = _slope_query(True)


@_register
def text_sentiment(spark, d):
    return _reports(spark, d).select("route_id", text.sentiment(F.col("description")).alias("sentiment"))


@_register
def text_difficulty(spark, d):
    return text.analyse(_reports(spark, d)).select("route_id", "difficulty_level")


@_register
def text_patterns(spark, d):
    return rounded(_patterns(spark, d))


@_register
def text_by_band(spark, d):
    return rounded(text.by_band(_patterns(spark, d)))


@_register
def text_by_difficulty(spark, d):
    return rounded(text.by_difficulty(_patterns(spark, d)))


@_register
def text_by_elevation(spark, d):
    return rounded(text.by_elevation(_patterns(spark, d)))


@_register
def text_by_sentiment(spark, d):
    return text.by_sentiment(_patterns(spark, d))


@_register
def text_stats(spark, d):
    return rounded(text.summary(_patterns(spark, d)))


# --- Weather -----------------------------------------------------------------------------


@_register
def weather_flatten(spark, d):
    rows = payloads.flatten_daily(td.daily_payload(spark, d), td.LOCAL_OFFSET)
    placed = payloads.attach_location(rows, td.locations(spark, d))
    return rounded(
        placed.select(
            "location_name", "latitude", "longitude", "elevation", "date", *td.DAILY_VALUES, "precipitation_hours"
        )
    )


@_register
def hourly_flatten(spark, d):
    rows = payloads.flatten_hourly(td.hourly_payload(spark, d), td.LOCAL_OFFSET)
    return rounded(rows.select("location_name", "timestamp", "date", *td.HOURLY_VALUES))


def _landed(spark, d):
    return ingest.inspect(td.daily_documents(spark, d), td.locations(spark, d))


@_register
def ingest_outcomes(spark, d):
    """Documents accepted and put aside, per reason."""
    return ingest.reconcile(_landed(spark, d))


@_register
def ingest_quarantine(spark, d):
    aside = ingest.quarantine(_landed(spark, d))
    known = F.when(F.trim("location_name") != "", F.col("location_name")).alias("location_name")
    return aside.select("reason", known).groupBy("reason", "location_name").agg(F.count("*").alias("documents"))


@_register
def ingest_daily(spark, d):
    """Rows of the accepted documents, which are parsed without a schema."""
    rows = ingest.rows(ingest.accepted(_landed(spark, d)), td.DAILY_VALUES, td.LOCAL_OFFSET)
    return rounded(rows.select("location_name", "latitude", "longitude", "elevation", "date", *td.DAILY_VALUES))


@_register
def ingest_other_series(spark, d):
    """Values of variables that no column is made for."""
    return ingest.other_series(ingest.accepted(_landed(spark, d)), td.DAILY_VALUES, td.LOCAL_OFFSET)


@_register
def ingest_variables(spark, d):
    """Member names over all documents."""
    return ingest.variables(td.daily_documents(spark, d)).select("variable", "documents")


@_register
def ingest_hourly_dst(spark, d):
    """Hourly documents over the days on which the zone puts its clocks back."""
    landed = ingest.inspect(td.hourly_documents(spark, d, 92))
    rows = ingest.rows(ingest.accepted(landed), td.HOURLY_VALUES, config.LOCAL_TIMEZONE, hourly=True)
    return rounded(rows.select("location_name", "step_utc", "timestamp", "date", *td.HOURLY_VALUES))


@_register
def date_bounds(spark, d):
    """First and last date of a run for every date that occurs, in either mode."""
    days = td.weather_daily(spark, d).select("date").distinct()
    return days.withColumn("mode", F.explode(F.array(F.lit("historical"), F.lit("forecast")))).select(
        "date", "mode", weather.bounds_of(F.col("date"), F.col("mode")).alias("bounds")
    ).select("date", "mode", "bounds.*")


@_register
def weather_date_window(spark, d):
    daily = td.weather_daily(spark, d)
    history = weather.date_window(daily, AS_OF, "historical")
    forecast = weather.date_window(daily, AS_OF, "forecast")
    columns = ["location_name", "date"]
    return history.select(F.lit("historical").alias("mode"), *columns).unionAll(
        forecast.select(F.lit("forecast").alias("mode"), *columns)
    )


def _feature_query(frame, block_days=weather.BLOCK_DAYS):
    def query(spark, d):
        table = weather.features(td.weather_daily(spark, d, per_user=True), frame, block_days)
        return rounded(
            table.select(
                "location_name",
                "date",
                "snowfall_24h",
                "snowfall_48h",
                "snowfall_72h",
                "snowfall_7d",
                "temp_variation_24h",
                "temp_variation_48h",
                "isoterma_0c",
                "precipitation_intensity",
            )
        )

    return query


QUERIES["weather_features_rows"] = _feature_query("rows")
QUERIES["weather_features_range"] = _feature_query("range")
# Blocks of five days, so that most windows begin in another block.
QUERIES["weather_blocks_rows"] = _feature_query("rows", 5)
QUERIES["weather_blocks_range"] = _feature_query("range", 5)


@_register
def snow_windows(spark, d):
    table = weather.snow_windows(td.weather_daily(spark, d))
    return rounded(
        table.select(
            "location_name", "date", "snowfall_48h", "snowfall_72h", "snowfall_7d", "temp_variation_48h"
        )
    )


@_register
def weather_feature_table(spark, d):
    return rounded(weather.feature_table(_features(spark, d)))


@_register
def weather_triggers(spark, d):
    return rounded(_triggers(spark, d, per_user=True))


@_register
def trigger_unpivot(spark, d):
    fired = _triggers(spark, d)
    return fired.groupBy("location_name", "date").agg(
        F.count("*").alias("triggers"), F.count_if("is_critical").alias("critical")
    )


@_register
def trigger_counts(spark, d):
    return weather.trigger_counts(_triggers(spark, d))


@_register
def severity_counts(spark, d):
    return weather.severity_counts(_triggers(spark, d))


@_register
def trigger_pivot(spark, d):
    return weather.trigger_pivot(_triggers(spark, d))


@_register
def snowfall_summary(spark, d):
    return rounded(weather.snowfall_summary(td.weather_daily(spark, d)))


@_register
def weather_summary(spark, d):
    rows = _features(spark, d)
    return rounded(weather.summary(rows, weather.detect_triggers(rows)))


# --- Fusion ------------------------------------------------------------------------------


@_register
def weather_by_band(spark, d):
    return rounded(fusion.weather_by_band(*_weather_tables(spark, d)))


@_register
def weather_all_bands(spark, d):
    table = fusion.weather_by_band(*_weather_tables(spark, d))
    spread = fusion.zone_weather_to_bands(table)
    return rounded(spread.select("zone_name", "elevation_band", "max_snowfall_72h", "critical_trigger_count"))


@_register
def fusion_outer(spark, d):
    return rounded(_fused(spark, d))


@_register
def fusion_rows(spark, d):
    """The fusion as one aggregation, with flags for the sources that have rows."""
    newest = td.weather_daily(spark, d).agg(F.max("date")).scalar()
    return rounded(_fused_rows(spark, d, newest))


@_register
def trailing_month(spark, d):
    """Snow, wind and cold of the 30 days up to each day of a user's series."""
    daily = td.weather_daily(spark, d, per_user=True)
    values = {
        "snow_30d": ("sum", "snowfall_sum"),
        "wind_30d": ("max", "windspeed_10m_max"),
        "cold_30d": ("min", "temperature_2m_min"),
    }
    targets = daily.select("location_name", "date")
    return rounded(lookback.trailing(daily, targets, ["location_name"], "date", 30, values))


@_register
def backtest_fortnight(spark, d):
    """The backtest with windows of 14 days."""
    table, triggers, topo, nlp = _fusion_inputs(spark, d)
    rows = fusion.backtest(table, triggers, topo, nlp, days=14)
    return rounded(rows.select("zone_name", "forecast_date", "elevation_band", "eaws_level", "risk_score", "confidence"))


@_register
def risk_scores(spark, d):
    scored = fusion.score(_fused(spark, d))
    return rounded(
        scored.select(
            "zone_name",
            "elevation_band",
            "weather_score_raw",
            "nlp_score_adjusted",
            "topo_contribution",
            "weather_contribution",
            "nlp_contribution",
            "risk_score",
            "eaws_level",
            "eaws_label",
            "confidence",
        )
    )


@_register
def main_factors(spark, d):
    scored = fusion.score(_fused(spark, d)).withColumn("main_factors", fusion.main_factors())
    return scored.select("zone_name", "elevation_band", _joined("main_factors"))


@_register
def predictions(spark, d):
    table = _predictions(spark, d)
    return rounded(table.withColumn("main_factors", _joined("main_factors")))


@_register
def danger_distribution(spark, d):
    return rounded(fusion.danger_distribution(_backtest(spark, d)))


@_register
def risk_by_band(spark, d):
    return rounded(fusion.risk_by_band(_backtest(spark, d)))


@_register
def contribution_share(spark, d):
    return rounded(fusion.contribution_share(_backtest(spark, d)))


@_register
def danger_counts(spark, d):
    return rounded(fusion.danger_summary(_backtest(spark, d)))


@_register
def backtest(spark, d):
    return rounded(_backtest(spark, d).withColumn("main_factors", _joined("main_factors")))


# --- Bulletins ---------------------------------------------------------------------------


@_register
def bulletin_aggregate(spark, d):
    table = bulletins.aggregate(_backtest(spark, d))
    return table.select(
        "zone_name",
        "issue_date",
        "valid_from",
        "valid_to",
        "eaws_level",
        "eaws_label",
        _joined("high_risk_bands"),
        _joined("factors"),
        _joined("avalanche_problems"),
        "summary",
        "danger_description",
        "affected_elevations",
        "affected_aspects",
        "recommendations",
    )


@_register
def bulletin_text(spark, d):
    table = bulletins.records(bulletins.aggregate(_backtest(spark, d)))
    return table.select("boletin_id", "zone_name", "issue_date", "bulletin_text", "confidence", "generated_by")


@_register
def bulletin_prompts(spark, d):
    return bulletins.prompts(bulletins.aggregate(_backtest(spark, d)))


# --- Validation and quality --------------------------------------------------------------


@_register
def validation_match(spark, d):
    return rounded(_matched(spark, d))


@_register
def validation_metrics(spark, d):
    return rounded(validation.metrics(_matched(spark, d)))


@_register
def validation_error_distribution(spark, d):
    return validation.error_distribution(_matched(spark, d))


@_register
def validation_by_level(spark, d):
    return rounded(validation.by_level(_matched(spark, d)))


@_register
def dq_cells(spark, d):
    return rounded(quality.check_cells(_cells_v2(spark, d), config.PILOT_ZONE.bbox))


@_register
def dq_score_range(spark, d):
    return rounded(quality.check_range(_susceptibility(spark, d), "susceptibility_score"))


@_register
def quality_metrics(spark, d):
    return rounded(quality.quality_metrics(_cells_v2(spark, d)))


@_register
def scale_counts(spark, d):
    return quality.scale_counts(_cells_v2(spark, d))


@_register
def dq_nulls(spark, d):
    return quality.null_counts(td.weather_daily(spark, d, per_user=True))


@_register
def dq_ranges(spark, d):
    return rounded(quality.ranges(td.weather_daily(spark, d, per_user=True)))


@_register
def table_inventory(spark, d):
    names = ["events", "part", "documents", "avalanche_predictions"]
    return quality.table_inventory(spark, {n: f"{d}/{n}.parquet" for n in names})


@_register
def upsert_dim(spark, d):
    existing = td.read(spark, d, "supplier").select(
        F.col("s_suppkey").alias("location_id"), F.col("s_name").alias("name"), F.lit("old").alias("region")
    )
    new = td.read(spark, d, "customer").select(
        F.col("c_custkey").alias("location_id"), F.col("c_name").alias("name"), F.lit("new").alias("region")
    )
    return sinks.upsert_dim(existing, new, ["location_id"])


# --- Sources and contracts ---------------------------------------------------------------


def _orders(d):
    return f"{d}/orders.parquet"


def _schema(ddl):
    return StructType.fromDDL(ddl)


_STATUS = "o_orderkey bigint, o_orderstatus string"


@_register
def guarded_scan(spark, d):
    orders = sources.read_table(spark, _orders(d), _STATUS)
    return orders.groupBy("o_orderstatus").agg(F.count("*").alias("orders"))


@_register
def optional_source(spark, d):
    """A table that exists and one that does not, which counts as empty."""
    there = sources.read_or_default(spark, _orders(d), _STATUS)
    absent = sources.read_or_default(spark, f"{d}/no_such_table.parquet", _STATUS)
    both = there.withColumn("source", F.lit("there")).unionByName(absent.withColumn("source", F.lit("absent")))
    return both.groupBy("source", "o_orderstatus").agg(F.count("*").alias("orders"))


@_register
def literal_source(spark, d):
    """Orders by the rank of their priority in an inline table."""
    schema = _schema("o_orderpriority string, rank int")
    ranks = sources.literal(spark, [("1-URGENT", 1), ("2-HIGH", 2), ("5-LOW", 5)], schema)
    orders = td.read(spark, d, "orders")
    return orders.join(ranks, "o_orderpriority", "left").groupBy("rank").agg(F.count("*").alias("orders"))


@_register
def conformed_orders(spark, d):
    """Orders under a contract: cast, cut to its columns, an optional column missing, a load time filled in."""
    schema = _schema(
        "o_orderkey string, o_totalprice decimal(12,2), note string, ingestion_timestamp timestamp"
    )
    rows = contracts.conform(td.read(spark, d, "orders"), schema, optional=("note",))
    return rows.select(
        "o_orderkey",
        F.col("o_totalprice").cast("double").alias("o_totalprice"),
        "note",
        F.col("ingestion_timestamp").isNotNull().alias("stamped"),
    )


# --- Tables written and read again -------------------------------------------------------


def _stored(spark, d, partition_by=()):
    """The triggers as a table of the model, written twice."""
    path = scratch.folder(spark, "sink")
    for _ in range(2):
        sinks.write_table(_triggers(spark, d), path, contracts.WEATHER_TRIGGERS, partition_by=partition_by)
    return path


def _read_back(spark, path):
    table = sources.read_table(spark, path)
    columns = ["trigger_id", "location_name", "date", "trigger_type", "trigger_severity", "is_critical"]
    return table.select(*columns, F.round("trigger_value", 6).alias("trigger_value"))


@_register
def sink_overwrite(spark, d):
    return _read_back(spark, _stored(spark, d))


@_register
def sink_partitioned(spark, d):
    """Triggers by month; rows are read through the month's folder."""
    path = _stored(spark, d, sinks.by_month())
    by_month = sources.read_table(spark, path).groupBy("month").agg(F.count("*").alias("triggers"))
    return by_month.select(F.date_format(F.to_date("month", "yyyy-MM"), "yyyy-MM").alias("month"), "triggers")


@_register
def sink_replace_partitions(spark, d):
    """One location's partition is replaced, twice; all others stay."""
    path = _stored(spark, d, ("location_name",))
    again = _triggers(spark, d).where((F.col("location_name") == "loc_3") & F.col("is_critical"))
    options = {"mode": "replace_partitions", "partition_by": ("location_name",), "require_rows": False}
    for _ in range(2):
        sinks.write_table(again, path, contracts.WEATHER_TRIGGERS, **options)
    return _read_back(spark, path)


@_register
def sink_bulletins(spark, d):
    """The newest bulletins written by issue date and zone, twice, and read back."""
    path = scratch.folder(spark, "sink")
    records = frames.latest(bulletins.records(bulletins.aggregate(_backtest(spark, d))), "issue_date")
    keys_ = ("issue_date", "zone_name")
    for _ in range(2):
        sinks.write_table(records, path, contracts.AVALANCHE_BULLETINS, mode="replace_partitions", partition_by=keys_)
    table = sources.read_table(spark, path, contracts.AVALANCHE_BULLETINS)
    return table.select("boletin_id", "zone_name", "issue_date", "eaws_level")


@_register
def sink_text(spark, d):
    """The newest bulletin texts as one file per zone, read back from the files."""
    path = scratch.folder(spark, "sink")
    texts = frames.latest(bulletins.records(bulletins.aggregate(_backtest(spark, d))), "issue_date")
    sinks.write_text(texts, path, ("zone_name", "issue_date"))
    files = spark.read.text(path, wholetext=True)
    return files.select("zone_name", F.sha2(F.rtrim("value", F.lit("\n")), 256).alias("text_sha256"))


@_register
def checks_of_write(spark, d):
    """Checks of the susceptibility table and of weather rows, measured while they were written."""
    path, rows = scratch.folder(spark, "sink"), []
    kept = sinks.write_checked(
        terrain.susceptibility_table(_cells_v1(spark, d)),
        f"{path}/topo",
        contracts.TOPO_SUSCEPTIBILITY,
        quality.range_checks("susceptibility_score"),
    )
    daily = td.weather_daily(spark, d, per_user=True)
    measured = sinks.write_checked(daily, f"{path}/daily", daily.schema, quality.weather_checks())
    rows = [("topo_susceptibility", *r) for r in kept] + [("weather_daily", *r) for r in measured]
    schema = "table_name string, check string, severity string, value double, passed boolean"
    return rounded(spark.createDataFrame(rows, schema))


# --- Several groupings at once -----------------------------------------------------------


@_register
def prediction_reports(spark, d):
    """Predictions by level, by band, by zone and as a whole, from one scan."""
    sets = {"level": ["eaws_level", "eaws_label"], "band": ["elevation_band"], "zone": ["zone_name"], "all": []}
    aggregates = [
        F.count("*").alias("count"),
        F.avg("confidence").alias("avg_confidence"),
        F.avg("risk_score").alias("avg_risk_score"),
        F.max("eaws_level").alias("max_eaws_level"),
        F.count_if(F.col("eaws_level") >= 3).alias("high_risk_count"),
    ]
    return rounded(frames.reports(_backtest(spark, d), sets, aggregates))


@_register
def trigger_reports(spark, d):
    sets = {"type": ["trigger_type", "trigger_severity"], "severity": ["trigger_severity"], "date": ["date"]}
    critical = F.count_if("is_critical").alias("critical")
    return frames.reports(_triggers(spark, d, per_user=True), sets, [F.count("*").alias("count"), critical])


@_register
def text_reports(spark, d):
    sets = {"difficulty": ["difficulty_level"], "elevation": ["elevation_band"], "sentiment": ["sentiment"]}
    aggregates = [
        F.count("*").alias("count"),
        F.avg("confidence").alias("avg_confidence"),
        F.sum("avalanche_events").alias("total_avalanche_mentions"),
    ]
    return rounded(frames.reports(_patterns(spark, d), sets, aggregates))


@_register
def terrain_levels(spark, d):
    """The grid at 1, 2, 4 and 8 times its spacing."""
    return rounded(terrain.levels(td.cells(spark, d), (1, 2, 4, 8), td.CELL_M))


@_register
def newest_orders(spark, d):
    """Orders of the newest date, which comes from the footers."""
    return frames.newest_slice(spark, f"{d}/orders.parquet", "o_orderkey").select("o_orderkey", "o_orderstatus")
