"""Table contracts: one schema per table, and the function that makes a frame keep it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

_TYPES = {
    "string": T.StringType(),
    "double": T.DoubleType(),
    "int": T.IntegerType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "array<string>": T.ArrayType(T.StringType()),
}


def _schema(columns: str) -> StructType:
    """Schema of a "name type, name type not null, ..." list; needs no running session."""
    fields = []
    for column in columns.split(", "):
        name, kind, *not_null = column.split(" ")
        fields.append(T.StructField(name, _TYPES[kind], not not_null))
    return StructType(fields)


LOCATIONS = _schema(
    "location_id string, name string, latitude double, longitude double, elevation int, "
    "region string, country string, timezone string, created_at timestamp"
)
WEATHER_DAILY = _schema(
    "location_name string, latitude double, longitude double, elevation int, date date, "
    "temperature_2m_max double, temperature_2m_min double, temperature_2m_mean double, "
    "precipitation_sum double, precipitation_hours double, precipitation_probability_max double, "
    "snowfall_sum double, windspeed_10m_max double, windgusts_10m_max double, "
    "winddirection_10m_dominant double, shortwave_radiation_sum double, "
    "et0_fao_evapotranspiration double, ingestion_timestamp timestamp"
)
WEATHER_HOURLY = _schema(
    "location_name string, latitude double, longitude double, elevation int, timestamp timestamp_ntz, "
    "date date, temperature_2m double, precipitation double, snowfall double, snow_depth double, "
    "weathercode int, cloudcover int, windspeed_10m double, winddirection_10m double, "
    "windgusts_10m double, surface_pressure double, relativehumidity_2m int, "
    "ingestion_timestamp timestamp"
)
WEATHER_QUARANTINE = _schema(
    "document_id string, kind string, location_name string, reason string, value string, "
    "ingestion_timestamp timestamp"
)
WEATHER_OTHER = _schema(
    "location_name string, kind string, timestamp timestamp_ntz, variable string, value double, "
    "ingestion_timestamp timestamp"
)
DATA_QUALITY = _schema(
    "table_name string, check string, severity string, value double, passed boolean, processing_timestamp timestamp"
)
ELEVATION_RAW = _schema(
    "pixel_id string, latitude double, longitude double, elevation int, zone_name string, "
    "ingestion_timestamp timestamp"
)
REPORTS = _schema(
    "route_id string, name string, description string, latitude double, longitude double, elevation int"
)
TOPO_FEATURES = _schema(
    "feature_id string, latitude double, longitude double, elevation int, slope_degrees double, "
    "aspect_degrees double, elevation_band string, is_critical_slope boolean, zone_name string, "
    "processing_timestamp timestamp"
)
TOPO_FEATURES_V2 = _schema(
    "feature_id string, latitude double, longitude double, elevation int, slope_degrees double, "
    "aspect_degrees double, elevation_band string, is_critical_slope boolean, zone_name string, "
    "gee_scale double, gee_quality_flag double, processing_timestamp timestamp"
)
TOPO_SUSCEPTIBILITY = _schema(
    "zone_id string, zone_name string, elevation_band string, total_area_km2 double, "
    "critical_slope_area_km2 double, susceptibility_score double, dominant_aspect string, "
    "avg_slope_degrees double, processing_timestamp timestamp"
)
TOPO_SUSCEPTIBILITY_V2 = _schema(
    "zone_id string, zone_name string, elevation_band string, min_elevation int, max_elevation int, "
    "avg_elevation double, total_area_km2 double, critical_slope_area_km2 double, "
    "susceptibility_score double, dominant_aspect string, avg_slope_degrees double, "
    "avg_gee_quality double, avg_gee_scale double, data_source string, processing_timestamp timestamp"
)
NLP_RISK_PATTERNS = _schema(
    "pattern_id string, zone_name string, latitude double, longitude double, elevation int, "
    "elevation_band string, risk_mentions int, avalanche_events int, difficulty_level string, "
    "sentiment string, confidence double, source string, processing_timestamp timestamp"
)
WEATHER_FEATURES = _schema(
    "feature_id string, location_name string, date date, elevation_band string, snowfall_24h double, "
    "snowfall_48h double, snowfall_72h double, temp_variation_24h double, windspeed_10m_max double, "
    "precipitation_intensity string, isoterma_0c int, processing_timestamp timestamp"
)
WEATHER_TRIGGERS = _schema(
    "trigger_id string, location_name string, date date, elevation_band string, trigger_type string, "
    "trigger_severity string, trigger_value double, is_critical boolean, processing_timestamp timestamp"
)
AVALANCHE_PREDICTIONS = _schema(
    "prediction_id string, zone_name string, forecast_date date, elevation_band string, "
    "eaws_level int, eaws_label string, risk_score double, confidence double, "
    "topo_contribution double, weather_contribution double, nlp_contribution double, "
    "main_factors array<string>, prediction_timestamp timestamp"
)
AVALANCHE_BULLETINS = _schema(
    "boletin_id string, zone_name string, issue_date date, valid_from date, valid_to date, "
    "eaws_level int, eaws_label string, summary string, danger_description string, "
    "avalanche_problems array<string>, affected_elevations string, affected_aspects string, "
    "recommendations string, confidence string, bulletin_text string, generated_by string, "
    "creation_timestamp timestamp"
)
SUSCEPTIBILITY_MAP = _schema(
    "grid_id string, zone_name string, latitude double, longitude double, elevation int, "
    "elevation_band string, slope_degrees double, aspect_degrees double, "
    "susceptibility_score double, risk_category string, last_updated timestamp"
)
SUSCEPTIBILITY_MAP_V2 = _schema(
    "grid_id string, zone_name string, latitude double, longitude double, elevation int, "
    "elevation_band string, slope_degrees double, aspect_degrees double, is_critical_slope boolean, "
    "gee_quality_flag double, susceptibility_score double, risk_category string, "
    "data_source string, last_updated timestamp"
)
OBSERVED_EVENTS = _schema(
    "fecha date not null, zona string not null, elevation_band string not null, "
    "severidad_observada string not null, nivel_eaws_observado int not null, "
    "descripcion string, fuente string"
)
VALIDATION_RESULTS = _schema(
    "fecha date, zona string, elevation_band string, nivel_observado int, nivel_predicho int, "
    "error int, signed_error int, acierto boolean, risk_score double, confidence double"
)

# Layer of every table. The directory of a table is <root>/<layer>/<table>.
LAYERS = {
    "bronze": {
        "ski_resort_locations": LOCATIONS,
        "weather_daily": WEATHER_DAILY,
        "weather_hourly": WEATHER_HOURLY,
        "weather_other": WEATHER_OTHER,
        "weather_quarantine": WEATHER_QUARANTINE,
        "srtm_raw": ELEVATION_RAW,
        "andes_handbook_routes": REPORTS,
    },
    "silver": {
        "topo_features": TOPO_FEATURES,
        "topo_susceptibility": TOPO_SUSCEPTIBILITY,
        "nlp_risk_patterns": NLP_RISK_PATTERNS,
        "weather_features": WEATHER_FEATURES,
        "weather_triggers": WEATHER_TRIGGERS,
        "data_quality": DATA_QUALITY,
    },
    "gold": {
        "avalanche_predictions": AVALANCHE_PREDICTIONS,
        "avalanche_bulletins": AVALANCHE_BULLETINS,
        "susceptibility_map": SUSCEPTIBILITY_MAP,
        "avalanche_events_real": OBSERVED_EVENTS,
        "validation_results": VALIDATION_RESULTS,
    },
}

_STAMPS = {
    "created_at",
    "ingestion_timestamp",
    "processing_timestamp",
    "prediction_timestamp",
    "creation_timestamp",
    "last_updated",
}


def table_path(root: str, layer: str, table: str) -> str:
    """Directory of a registered table; an unknown layer or table raises KeyError."""
    if table not in LAYERS[layer]:
        raise KeyError(f"no table {table!r} in layer {layer!r}")
    return f"{root.rstrip('/')}/{layer}/{table}"


def conform(df: DataFrame, schema: StructType, optional: tuple[str, ...] = ()) -> DataFrame:
    """Select and cast the schema's columns in order; extra columns are dropped.

    A missing load-time stamp is filled with the current time, a missing column named in
    ``optional`` with NULL; any other missing column is an error, as is (under ANSI mode) a
    value the target type cannot hold.
    """
    present = set(df.columns)
    missing = [
        f.name for f in schema if f.name not in present and f.name not in _STAMPS and f.name not in optional
    ]
    if missing:
        raise ValueError(f"columns missing from the frame: {', '.join(missing)}")

    def column(field):
        if field.name in present:
            return F.col(field.name).cast(field.dataType).alias(field.name)
        value = F.current_timestamp() if field.name in _STAMPS else F.lit(None)
        return value.cast(field.dataType).alias(field.name)

    return df.select(*[column(f) for f in schema])
