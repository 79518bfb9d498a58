"""Domain tables derived from the generated test tables (events, part, documents)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nivo import terrain
from nivo.functions import bands

CELL_M = 60.0
LOCAL_OFFSET = "-04:00"
LOCAL_OFFSET_S = 4 * 3600
DAILY_VALUES = [
    "temperature_2m_max",
    "temperature_2m_min",
    "temperature_2m_mean",
    "precipitation_sum",
    "snowfall_sum",
    "windspeed_10m_max",
]
HOURLY_VALUES = ["temperature_2m", "precipitation", "snowfall", "windspeed_10m"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mean_of(kind: str) -> Column:
    return F.avg(F.when(F.col("event_type") == kind, F.col("value")))


def _location(per_user: bool = False) -> Column:
    number = F.col("user_id") if per_user else F.col("user_id") % 20
    return F.concat(F.lit("loc_"), number.cast("string"))


def weather_daily(spark: SparkSession, sf_dir: str, per_user: bool = False) -> DataFrame:
    """One row per location and day. Per user the series has gaps and many locations."""
    high, low = F.col("temperature_2m_max"), F.col("temperature_2m_min")
    return (
        read(spark, sf_dir, "events")
        .groupBy(
            _location(per_user).alias("location_name"),
            (2000 + 100 * (F.col("user_id") % 20)).cast("int").alias("elevation"),
            F.col("ts").cast("date").alias("date"),
        )
        .agg(
            _mean_of("view").alias("snowfall_sum"),
            (_mean_of("purchase") / 3).alias("precipitation_sum"),
            (_mean_of("click") / 4 - 2).alias("temperature_2m_max"),
            (-_mean_of("signup") / 4).alias("temperature_2m_min"),
            _mean_of("error").alias("windspeed_10m_max"),
        )
        .withColumn("temperature_2m_mean", (high + low) / 2)
    )


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("user_id") % 20
    return (
        read(spark, sf_dir, "events")
        .select(
            _location().alias("name"),
            (-33.40 + 0.01 * number).alias("latitude"),
            (-70.30 + 0.01 * number).alias("longitude"),
            (2000 + 100 * number).cast("int").alias("elevation"),
        )
        .distinct()
    )


def _nest(series: DataFrame, time: str, group: Column, values: list[str], step_s: int) -> DataFrame:
    """Payloads of bounded length: one per location and group, absent steps as NULLs."""
    entry = F.struct(F.col(time), F.struct(*values))
    nested = series.groupBy("location_name", group.alias("_group")).agg(
        F.min(time).alias("_first"),
        F.max(time).alias("_last"),
        F.map_from_entries(F.collect_list(entry)).alias("_values"),
    )
    axis = F.sequence("_first", "_last", F.lit(step_s).cast("bigint"))

    def array_of(name: str) -> Column:
        return F.transform(axis, lambda t: F.try_element_at("_values", t)[name]).alias(name)

    return nested.select(
        "location_name",
        F.col("_first").alias("time_start"),
        (F.col("_last") + step_s).alias("time_end"),
        F.lit(step_s).cast("bigint").alias("interval_s"),
        *[array_of(name) for name in values],
    )


def daily_payload(spark: SparkSession, sf_dir: str, block_days: int = 16) -> DataFrame:
    daily = weather_daily(spark, sf_dir)
    local_midnight = F.unix_date("date").cast("bigint") * 86400 + LOCAL_OFFSET_S
    block = F.floor(F.unix_date("date") / block_days)
    return _nest(daily.withColumn("_t", local_midnight).drop("elevation"), "_t", block, DAILY_VALUES, 86400)


def hourly_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    hourly = (
        read(spark, sf_dir, "events")
        .groupBy(_location().alias("location_name"), (F.floor(hour / 3600) * 3600).alias("_t"))
        .agg(
            (_mean_of("click") / 4 - 2).alias("temperature_2m"),
            (_mean_of("purchase") / 3).alias("precipitation"),
            _mean_of("view").alias("snowfall"),
            _mean_of("error").alias("windspeed_10m"),
        )
    )
    return _nest(hourly, "_t", F.floor(F.col("_t") / 86400), HOURLY_VALUES, 3600)


def daily_documents(spark: SparkSession, sf_dir: str, block_days: int = 16) -> DataFrame:
    """The daily payloads as JSON documents, a part of them faulty in turn by location and block of days."""
    number = F.substring("location_name", 5, 10).cast("long")
    fault = (number + 3 * F.floor((F.col("time_start") - LOCAL_OFFSET_S) / 86400 / block_days)) % 9
    axis = ["location_name", "time_start", "time_end", "interval_s"]
    numbered = daily_payload(spark, sf_dir, block_days).withColumns({"_k": number, "_fault": fault})
    line = F.transform("snowfall_sum", lambda value, step: 2000 + 100 * F.col("_k") + step)

    def document(name: Column | None = None, interval: Column | None = None, **more: Column) -> Column:
        head = [
            F.coalesce(name if name is not None else F.col("location_name"), F.lit("")).alias("location_name"),
            *axis[1:3],
            (interval if interval is not None else F.col("interval_s")).alias("interval_s"),
        ]
        arrays = [more.pop(n, F.col(n)).alias(n) for n in DAILY_VALUES]
        return F.to_json(F.struct(*head, *arrays, *[column.alias(n) for n, column in more.items()]))

    whole = document()
    text = (
        F.when(F.col("_fault") == 0, F.substring(whole, 1, 90))
        .when(F.col("_fault") == 1, document(name=F.lit(" ")))
        .when(F.col("_fault") == 2, document(interval=F.lit(0)))
        .when(F.col("_fault") == 3, document(snowfall_sum=F.array_append("snowfall_sum", F.lit(1.0))))
        .when(F.col("_fault") == 4, document(name=F.concat("location_name", F.lit("x"))))
        .when(F.col("_fault") == 5, document(humidity=F.transform("snowfall_sum", lambda value: F.lit("n/a"))))
        .when(F.col("_fault") == 6, document(snow_line=line))
        .when(F.col("_fault") == 7, F.to_json(F.struct(*axis)))
        .otherwise(whole)
    )
    return numbered.select(text.alias("value"))


def hourly_documents(spark: SparkSession, sf_dir: str, shift_days: int) -> DataFrame:
    """The hourly payloads as JSON documents, moved by days."""
    moved = hourly_payload(spark, sf_dir).withColumns(
        {name: F.col(name) + shift_days * 86400 for name in ("time_start", "time_end")}
    )
    return moved.select(F.to_json(F.struct("*")).alias("value"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid of 50 rows and 40 columns per zone, 60 m apart."""
    key = F.col("p_partkey")
    row, col = F.floor(key % 2000 / 40).cast("int"), (key % 40).cast("int")
    return (
        read(spark, sf_dir, "part")
        .select(
            F.concat(F.lit("zone_"), F.floor(key / 2000).cast("string")).alias("zone_name"),
            row.alias("row"),
            col.alias("col"),
            "p_size",
        )
        .select(
            "zone_name",
            "row",
            "col",
            (F.lit(-33.40) + 0.0006 * F.col("row")).alias("latitude"),
            (F.lit(-70.32) + 0.0006 * F.col("col")).alias("longitude"),
            (F.lit(1900.0) + 34.0 * F.col("row") + 1.5 * F.col("p_size")).alias("elevation"),
            F.lit(CELL_M).alias("scale"),
        )
    )


def slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain.aspect(terrain.slope(terrain.gradient(cells(spark, sf_dir), CELL_M, CELL_M)))


def relabelled_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes whose rows are dealt to the weather locations, so that all inputs share zones."""
    zone = F.concat(F.lit("loc_"), (F.col("row") % 20).cast("string"))
    return slopes(spark, sf_dir).withColumn("_grid", F.col("zone_name")).withColumn("zone_name", zone)


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reports, with Spanish phrases appended."""
    n = F.col("doc_id")

    def text(value: Column) -> Column:
        return value.cast("string")

    extra = (
        F.when(n % 6 == 0, F.concat(F.lit(" Pendiente de "), text(n % 70), F.lit("° con riesgo de alud.")))
        .when(
            n % 6 == 1,
            F.concat(
                F.lit(" Tramos de "), text(30 + n % 10), F.lit("-"), text(40 + n % 9),
                F.lit(" grados, cuidado con cornisas."),
            ),
        )
        .when(n % 6 == 2, F.concat(F.lit(" INCLINACIÓN de "), text(n % 60), F.lit(", muy peligroso, evitar.")))
        .when(n % 6 == 3, " Ruta hermosa y recomendable, fácil.")
        .when(n % 6 == 4, " Historial de avalancha tras nieve reciente y viento a 3500 grados.")
        .otherwise("")
    )
    return read(spark, sf_dir, "documents").select(
        text(n).alias("route_id"),
        F.concat("text", extra).alias("description"),
        (F.lit(-33.445) + 0.01 * (n % 20)).alias("latitude"),
        (F.lit(-70.365) + 0.01 * (n % 20)).alias("longitude"),
        (2000 + n % 2000).cast("int").alias("elevation"),
        F.concat(F.lit("loc_"), text(n % 20)).alias("zone_name"),
    )


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    elevation = 2000 + 100 * (F.col("user_id") % 20)
    return (
        read(spark, sf_dir, "events")
        .where((F.col("event_type") == "error") & (F.col("value") >= 150))
        .groupBy(
            F.col("ts").cast("date").alias("fecha"),
            _location().alias("zona"),
            bands.elevation_band(elevation).alias("elevation_band"),
        )
        .agg(F.max(1 + F.col("event_id") % 5).cast("int").alias("nivel_eaws_observado"))
    )
