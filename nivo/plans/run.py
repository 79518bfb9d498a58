"""Build every table of the model from landed inputs, one written layer after the other."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from nivo import bulletins, config, contracts, frames, fusion, ingest, quality, sinks, sources, terrain, text
from nivo import validation as scoring
from nivo import filters, weather


@dataclass(frozen=True)
class Inputs:
    """Landed inputs. A missing one is replaced by an empty table of its contract.

    Weather comes as ``daily`` rows, or as JSON documents (column ``value``, optionally ``landed``) of daily and hourly
    payloads together with the ``locations`` they may be of.
    """

    cells: DataFrame | None = None
    daily: DataFrame | None = None
    daily_documents: DataFrame | None = None
    hourly_documents: DataFrame | None = None
    locations: DataFrame | None = None
    time_zone: str = config.LOCAL_TIMEZONE
    reports: DataFrame | None = None
    observed: DataFrame | None = None
    cell_metres: tuple[float, float] = terrain.degrees_to_metres(config.GRID_STEP_DEG)
    terrain_version: str = "v1"
    checked_box: config.BBox | None = None
    strict_slopes: bool = False
    zone_boxes: DataFrame | None = None
    report_zone: str = config.PILOT_ZONE.name


class Layers:
    """The tables below one root directory."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        layer = next(layer for layer, tables in contracts.LAYERS.items() if table in tables)
        return contracts.table_path(self.root, layer, table)

    def read(self, table: str, schema: StructType | None = None) -> DataFrame:
        schema = schema or next(t[table] for t in contracts.LAYERS.values() if table in t)
        sinks.recover(self.spark, self.path(table))
        return sources.read_or_default(self.spark, self.path(table), schema)

    def write(self, df: DataFrame, table: str, schema: StructType | None = None, **options) -> DataFrame:
        """Write and read back: the next step starts from files whose size Spark knows."""
        schema = schema or next(t[table] for t in contracts.LAYERS.values() if table in t)
        sinks.write_table(df, self.path(table), schema, **options)
        return self.read(table, schema)

    def write_checked(self, df: DataFrame, table: str, schema: StructType, checks: list, **options) -> DataFrame:
        """Overwrite a table, measuring its checks in the same job, and keep their outcome in ``data_quality``."""
        try:
            results = sinks.write_checked(df, self.path(table), schema, checks, **options)
        except quality.ChecksFailed as failed:
            self.record(table, failed.results)
            raise
        self.record(table, results)
        return self.read(table, schema)

    def newest(self, table: str, column: str):
        """The greatest value of a stored column, from the footers of its files; None without a table."""
        if sources.find(self.spark, self.path(table)) is None:
            return None
        return frames.newest_from_footers(self.spark, self.path(table), column).first()[0]

    def record(self, table: str, results: list) -> None:
        columns = "check string, severity string, value double, passed boolean"
        rows = self.spark.createDataFrame(results, columns).withColumn("table_name", F.lit(table))
        others = self.read("data_quality").where(F.col("table_name") != table)
        self.write(contracts.conform(rows, contracts.DATA_QUALITY).unionByName(others), "data_quality")


_TERRAIN_CONTRACTS = {
    "v1": (contracts.TOPO_FEATURES, contracts.TOPO_SUSCEPTIBILITY, contracts.SUSCEPTIBILITY_MAP),
    "v2": (contracts.TOPO_FEATURES_V2, contracts.TOPO_SUSCEPTIBILITY_V2, contracts.SUSCEPTIBILITY_MAP_V2),
}


def build_terrain(layers: Layers, inputs: Inputs) -> None:
    """Feature cells, susceptibility and map.

    v2 masks low cells; those the mask cut off from all neighbours in a direction have no slope: they are counted
    (``cells_without_slope``, an error with ``strict_slopes``) and not written. Only cells of high quality go on.
    Checks are measured while the tables are written, with ``checked_box`` those of cells against the
    box too; any error leaves the old table and stops the run.
    """
    (dx, dy), version = inputs.cell_metres, inputs.terrain_version
    feature_schema, table_schema, map_schema = _TERRAIN_CONTRACTS[version]
    grid = inputs.cells if version == "v1" else terrain.mask_elevation(inputs.cells)
    steep = terrain.features(terrain.aspect(terrain.slope(terrain.gradient(grid, dx, dy))), version)
    by_zone = {"partition_by": ("zone_name",)}
    if version == "v2":
        box = quality.cell_checks(inputs.checked_box) if inputs.checked_box is not None else []
        cells = layers.write_checked(
            steep,
            "topo_features",
            feature_schema,
            box,
            before=quality.slope_checks(inputs.strict_slopes),
            kept=F.col("slope_degrees").isNotNull(),
            **by_zone,
        )
    else:
        cells = layers.write(steep, "topo_features", feature_schema, **by_zone)
    good = terrain.keep_quality(cells)
    table = layers.write_checked(
        terrain.susceptibility_table(good, version),
        "topo_susceptibility",
        table_schema,
        quality.range_checks("susceptibility_score"),
    )
    layers.write(terrain.susceptibility_map(good, table), "susceptibility_map", map_schema, **by_zone)


def build_text(layers: Layers, inputs: Inputs) -> None:
    """Patterns of reports. The zone is that of the box a report lies in, a column of the reports, or one for all."""
    reports = inputs.reports
    if inputs.zone_boxes is not None:
        reports = filters.assign_zone(reports.drop("zone_name"), inputs.zone_boxes)
    zone = F.col("zone_name") if "zone_name" in reports.columns else inputs.report_zone
    layers.write(text.patterns(reports, zone), "nlp_risk_patterns")


def _land(layers: Layers, raw: DataFrame, kind: str, inputs: Inputs) -> DataFrame:
    """Documents judged once and kept as they came out; those put aside replace what was put aside of them before."""
    judged = ingest.inspect(raw, inputs.locations).withColumn("kind", F.lit(kind))
    path = f"{layers.root}/bronze/_landed_{kind}"
    judged.write.mode("overwrite").parquet(path)
    judged = layers.spark.read.schema(judged.schema).parquet(path)
    aside = contracts.conform(ingest.quarantine(judged).withColumn("kind", F.lit(kind)), contracts.WEATHER_QUARANTINE)
    before = layers.read("weather_quarantine").join(
        judged.select("document_id", "kind"), ["document_id", "kind"], "left_anti"
    )
    before = before.select(*contracts.WEATHER_QUARANTINE.names)
    layers.write(before.unionByName(aside), "weather_quarantine", require_rows=False)
    return ingest.accepted(judged)


def build_ingestion(layers: Layers, inputs: Inputs) -> Inputs:
    """Landed documents to rows: every document is either accepted or put aside with a reason.

    Hourly rows and series without a column of their own are written here; daily rows take the place of
    ``inputs.daily`` and go through :func:`build_weather`.
    """
    if inputs.daily_documents is not None and inputs.daily is not None:
        raise ValueError("daily weather is given both as rows and as documents")
    monthly = {"mode": "replace_partitions", "require_rows": False}
    if inputs.hourly_documents is not None:
        documents = _land(layers, inputs.hourly_documents, "hourly", inputs)
        hours = ingest.rows(documents, config.HOURLY_VARIABLES, inputs.time_zone, hourly=True)
        hours = _placed(hours, inputs)
        # The hour put back twice a year has one row: the later step stays.
        hours = frames.newest_per_key(hours, ["location_name", "timestamp"], [F.desc("step_utc")])
        renewed = hours.select("location_name", "timestamp", "date")
        keys_ = ("location_name", "timestamp")
        merged = _merged(layers, hours, "weather_hourly", renewed, ("latitude", "longitude", "elevation"), keys_)
        layers.write(merged, "weather_hourly", partition_by=sinks.by_month("date"), **monthly)
        _write_other(layers, documents, "hourly", config.HOURLY_VARIABLES, inputs)
    if inputs.daily_documents is not None:
        documents = _land(layers, inputs.daily_documents, "daily", inputs)
        known = config.DAILY_VARIABLES + config.FORECAST_ONLY_VARIABLES
        days = _placed(ingest.rows(documents, known, inputs.time_zone), inputs)
        _write_other(layers, documents, "daily", known, inputs)
        inputs = replace(inputs, daily=days)
    return inputs


def _placed(rows: DataFrame, inputs: Inputs) -> DataFrame:
    """Rows with attributes of their location, NULL where no locations were given."""
    if inputs.locations is not None:
        return rows
    return rows.selectExpr("*", "double(NULL) AS latitude", "double(NULL) AS longitude", "int(NULL) AS elevation")


def _write_other(layers: Layers, documents: DataFrame, kind: str, known: tuple[str, ...], inputs: Inputs) -> None:
    """Series that no column is made for; a document's values replace stored ones of its location, time and variable."""
    other = ingest.other_series(documents, known, inputs.time_zone).withColumn("kind", F.lit(kind))
    keys_ = ["location_name", "kind", "timestamp", "variable"]
    other = frames.newest_per_key(other, keys_, [F.desc("value")]).withColumn("date", F.col("timestamp").cast("date"))
    merged = _merged(layers, other, "weather_other", other.select(*keys_, "date"), (), tuple(keys_))
    layers.write(
        merged,
        "weather_other",
        mode="replace_partitions",
        partition_by=sinks.by_month("timestamp"),
        require_rows=False,
    )


def _merged(
    layers: Layers,
    new: DataFrame,
    table: str,
    replaced: DataFrame,
    optional: tuple[str, ...] = (),
    keys_: tuple[str, ...] = ("location_name", "date"),
) -> DataFrame:
    """The rows of a month-partitioned table with those of the ``replaced`` keys (locations and dates) renewed.

    Only the months that the run touches are read and written again; other months, and other
    locations of the same months, stay as they are.
    """
    schema = next(t[table] for t in contracts.LAYERS.values() if table in t)
    stored = layers.read(table, schema)
    months = replaced.select(weather.month(F.col("date")).alias("month")).distinct()
    if "month" not in stored.columns:
        dated = "date" if "date" in schema.names else "timestamp"
        stored = stored.withColumn("month", weather.month(F.col(dated)))
    touched = stored.join(months, "month", "left_semi")
    kept = touched.drop("month").join(replaced.select(*keys_).distinct(), list(keys_), "left_anti")
    return kept.select(*schema.fieldNames()).unionByName(contracts.conform(new, schema, optional))


#: Rows before a day that its windows reach back to.
LOOKBACK = 6
#: Columns of the daily table that no feature reads.
_UNREAD = (
    "latitude",
    "longitude",
    "precipitation_hours",
    "precipitation_probability_max",
    "windgusts_10m_max",
    "winddirection_10m_dominant",
    "shortwave_radiation_sum",
    "et0_fao_evapotranspiration",
)


def _renewed(layers: Layers, daily: DataFrame, days: DataFrame, frame: str) -> tuple[DataFrame, DataFrame]:
    """Feature rows from a location's first day in the run on, and the locations and dates they are of.

    Each is computed with the stored days before it. Where features are stored that begin before all daily rows,
    days without their whole lookback are left out if they have a stored row: it was made of more.
    """
    first = days.groupBy("location_name").agg(F.min("date").alias("_first"))
    before = Window.partitionBy("location_name").orderBy(F.desc("date"))
    known = daily.join(first, "location_name")
    lead = (
        known.where("date < _first").withColumn("_n", F.row_number().over(before)).where(F.col("_n") <= LOOKBACK)
    )
    context = known.where("date >= _first").unionByName(lead.drop("_n"))
    stored = layers.read("weather_features")
    begun = stored.groupBy("location_name").agg(F.min("date").alias("_begun"))
    # The first LOOKBACK days that are known lack some of their lookback.
    heads = Window.partitionBy("location_name").orderBy("date")
    cut = (
        context.select("location_name", "date")
        .withColumn("_n", F.row_number().over(heads))
        .where(F.col("_n") <= LOOKBACK)
        .join(context.groupBy("location_name").agg(F.min("date").alias("_from")), "location_name")
        .join(begun, "location_name")
        .where("_begun < _from")
        .join(stored.select("location_name", "date"), ["location_name", "date"], "left_semi")
        .select("location_name", "date")
    )
    rows = (
        weather.features(context.drop("_first"), frame)
        .join(first, "location_name")
        .where("date >= _first")
        .drop("_first")
        .join(cut, ["location_name", "date"], "left_anti")
    )
    renewed = context.where("date >= _first").select("location_name", "date")
    return rows, renewed.join(cut, ["location_name", "date"], "left_anti")


def build_weather(layers: Layers, inputs: Inputs, frame: str = "rows") -> None:
    """Daily rows, features and triggers; rows of the locations and dates in the run replace the stored ones.

    The days before those of the run are read back from the stored daily rows, and later days that are stored are
    computed again, as their windows reach into the run.
    """
    days = inputs.daily.select("location_name", "date").distinct()
    monthly = sinks.by_month("date")
    daily = layers.write(
        _merged(layers, inputs.daily, "weather_daily", days, _UNREAD),
        "weather_daily",
        mode="replace_partitions",
        partition_by=monthly,
    )
    rows, renewed = _renewed(layers, daily.select(*contracts.WEATHER_DAILY.names), days, frame)
    tables = (("weather_triggers", weather.detect_triggers(rows)), ("weather_features", weather.feature_table(rows)))
    # Triggers go first: which days are renewed depends on the stored features.
    for table, df in tables:
        layers.write(
            _merged(layers, df, table, renewed),
            table,
            mode="replace_partitions",
            partition_by=monthly,
            require_rows=False,
        )


def _evidence(layers: Layers) -> tuple[DataFrame, DataFrame]:
    return fusion.topo_evidence(layers.read("topo_susceptibility")), text.by_band(layers.read("nlp_risk_patterns"))


def build_predictions(layers: Layers, as_of: dt.date | None = None) -> DataFrame:
    """Predictions for one date, by default the newest of the weather features.

    They replace those of the same zone and date, so running twice changes nothing.
    """
    features, triggers = layers.read("weather_features"), layers.read("weather_triggers")
    topo, nlp = _evidence(layers)
    date = F.lit(as_of or layers.newest("weather_features", "date")).cast("date")
    fused = fusion.fuse(topo, nlp, fusion.weather_by_band(features, triggers, date))
    return layers.write(
        fusion.predictions(fusion.score(fused), date),
        "avalanche_predictions",
        mode="replace_partitions",
        partition_by=("forecast_date", "zone_name"),
    )


def build_bulletins(layers: Layers, text_files: bool = False, as_of: dt.date | None = None) -> DataFrame:
    """Bulletins for the predictions of one date, by default the newest."""

    def asked(df: DataFrame, column: str) -> DataFrame:
        return df.where(F.col(column) == F.lit(as_of)) if as_of else frames.latest(df, column)

    records = layers.write(
        bulletins.records(bulletins.aggregate(asked(layers.read("avalanche_predictions"), "forecast_date"))),
        "avalanche_bulletins",
        mode="replace_partitions",
        partition_by=("issue_date", "zone_name"),
    )
    if text_files:
        sinks.write_text(asked(records, "issue_date"), f"{layers.root}/boletines", ("zone_name", "issue_date"))
    return records


def build_validation(layers: Layers, inputs: Inputs) -> DataFrame:
    """Forecasts for the dates and zones of all observed events in one job, and their errors."""
    asked = inputs.observed.select(F.col("zona").alias("zone_name"), F.col("fecha").alias("forecast_date"))
    topo, nlp = _evidence(layers)
    past = fusion.backtest(layers.read("weather_features"), layers.read("weather_triggers"), topo, nlp, asked)
    return layers.write(scoring.match(inputs.observed, past), "validation_results")


def run(
    spark: SparkSession,
    inputs: Inputs,
    root: str,
    as_of: dt.date | None = None,
    text_files: bool = False,
) -> DataFrame:
    """Build the layers the inputs allow and return the inventory of the result tables."""
    layers = Layers(spark, root)
    inputs = build_ingestion(layers, inputs)
    if inputs.cells is not None:
        build_terrain(layers, inputs)
    if inputs.reports is not None:
        build_text(layers, inputs)
    if inputs.daily is not None:
        build_weather(layers, inputs)
        build_predictions(layers, as_of)
        build_bulletins(layers, text_files, as_of)
        if inputs.observed is not None:
            build_validation(layers, inputs)
    names = (
        "topo_susceptibility",
        "nlp_risk_patterns",
        "weather_triggers",
        "avalanche_predictions",
        "avalanche_bulletins",
    )
    return quality.table_inventory(spark, {name: layers.path(name) for name in names})
