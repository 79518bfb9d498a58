import datetime as dt
import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nivo import contracts, payloads, quality, sinks, sources, weather
from nivo.config import BBox


def predictions(spark, day, levels, zone="z"):
    rows = [(f"p{i}", zone, day, f"b{i}", n, "l", 0.5, 1.0, 0.1, 0.1, 0.1, ["f"]) for i, n in enumerate(levels)]
    return spark.createDataFrame(rows, contracts.AVALANCHE_PREDICTIONS[:-1])


def test_guards(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    with pytest.raises(FileNotFoundError):
        sources.read_table(spark, path, schema)
    assert sources.read_or_default(spark, path, schema).columns == ["a"]
    default = spark.createDataFrame([(7,)], schema)
    assert sources.read_or_default(spark, path, schema, default).first()[0] == 7
    default.limit(0).write.parquet(path)
    with pytest.raises(ValueError):
        sources.read_table(spark, path, schema)
    assert sources.read_table(spark, path, schema, require_rows=False).count() == 0
    with pytest.raises(FileNotFoundError):
        sources.read_table(spark, "no_such_table")


def test_literal_source_checks_nulls(spark):
    row = (dt.date(2023, 8, 15), "La Parva", "Alta", "Notable", 3, None, None)
    assert sources.literal(spark, [row], contracts.OBSERVED_EVENTS).first()["nivel_eaws_observado"] == 3
    with pytest.raises(PySparkException):
        sources.literal(spark, [(None, *row[1:])], contracts.OBSERVED_EVENTS)


def test_conform(spark):
    schema = contracts.WEATHER_TRIGGERS
    df = spark.sql("select 'x' as extra, 't' as trigger_id, 'l' as location_name, '2024-01-02' as date, 'Alta' as elevation_band,"
                   " 'k' as trigger_type, 's' as trigger_severity, 3 as trigger_value, true as is_critical")
    row = contracts.conform(df, schema).first()
    assert row["date"] == dt.date(2024, 1, 2) and row["trigger_value"] == 3.0 and row["processing_timestamp"] is not None
    with pytest.raises(ValueError, match="trigger_value"):
        contracts.conform(df.drop("trigger_value"), schema)
    assert contracts.conform(df.drop("trigger_value"), schema, ("trigger_value",)).first()["trigger_value"] is None
    with pytest.raises(PySparkException):
        contracts.conform(df.withColumn("trigger_value", F.lit("much")), schema).collect()
    with pytest.raises(KeyError):
        contracts.table_path("/r", "gold", "weather_daily")
    assert contracts.table_path("/r/", "gold", "susceptibility_map") == "/r/gold/susceptibility_map"


def test_replace_partitions_is_idempotent(spark, tmp_path):
    path, schema = str(tmp_path / "p"), contracts.AVALANCHE_PREDICTIONS
    first, second = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    options = {"mode": "replace_partitions", "partition_by": ("forecast_date",)}
    assert sinks.write_table(predictions(spark, first, [1, 2]), path, schema, **options) == 2
    sinks.write_table(predictions(spark, second, [3]), path, schema, **options)
    sinks.write_table(predictions(spark, second, [4]), path, schema, **options)
    stored = spark.read.schema(schema).parquet(path)
    assert sorted(r["eaws_level"] for r in stored.collect()) == [1, 2, 4]
    with pytest.raises(ValueError):
        sinks.write_table(predictions(spark, first, [1]).limit(0), path, schema, **options)
    assert spark.read.schema(schema).parquet(path).count() == 3
    with pytest.raises(ValueError):
        sinks.write_table(predictions(spark, first, [1]), path, schema, mode="replace_partitions")


def test_overwrite_refuses_empty_and_append_adds(spark, tmp_path):
    path, schema = str(tmp_path / "p"), contracts.AVALANCHE_PREDICTIONS
    one = predictions(spark, dt.date(2024, 1, 1), [1])
    sinks.write_table(one, path, schema)
    with pytest.raises(ValueError):
        sinks.write_table(one.limit(0), path, schema)
    sinks.write_table(one, path, schema, mode="append")
    assert spark.read.parquet(path).count() == 2
    assert sinks.write_table(one.limit(0), path, schema, require_rows=False) == 0
    with pytest.raises(ValueError):
        sinks.write_table(one, path, schema, mode="merge")


def test_month_partitions(spark, tmp_path):
    path = str(tmp_path / "w")
    rows = [("t", "l", dt.date(2024, m, d), "Alta", "k", "s", 1.0, True) for m in (1, 2) for d in range(1, 20)]
    df = spark.createDataFrame(rows, contracts.WEATHER_TRIGGERS[:-1]).repartition(8)
    sinks.write_table(df, path, contracts.WEATHER_TRIGGERS, partition_by=sinks.by_month())
    assert sorted(n for n in os.listdir(path) if n.startswith("month")) == ["month=2024-01", "month=2024-02"]
    assert len([n for n in os.listdir(f"{path}/month=2024-01") if n.endswith(".parquet")]) == 1
    stored = spark.read.schema(contracts.WEATHER_TRIGGERS).parquet(path)
    assert stored.count() == 38 and stored.columns == [*contracts.WEATHER_TRIGGERS.names, "month"]
    recent = weather.last_n_days(stored, 3)
    assert {r["date"].day for r in recent.collect()} == {17, 18, 19}
    scans = [line for line in str(recent._jdf.queryExecution().executedPlan()).splitlines() if "FileScan" in line]
    assert any("PartitionFilters: [isnotnull(month" in line for line in scans)


def test_text_files(spark, tmp_path):
    path = str(tmp_path / "txt")
    df = spark.createDataFrame([("La Parva", "2024-01-01", "a\nb\n"), ("z", "2024-01-01", "c")], "zone_name string, issue_date string, bulletin_text string")
    sinks.write_text(df, path, ("zone_name", "issue_date"))
    folder = f"{path}/zone_name=La Parva/issue_date=2024-01-01"
    files = [n for n in os.listdir(folder) if n.endswith(".txt")]
    assert len(files) == 1 and open(f"{folder}/{files[0]}", encoding="utf8").read() == "a\nb\n\n"


def test_upsert_dim(spark):
    schema = "location_id string, name string"
    old = spark.createDataFrame([("a", "old"), ("b", "kept")], schema)
    new = spark.createDataFrame([("a", "new"), ("c", "added")], schema)
    once = sinks.upsert_dim(old, new, ["location_id"])
    twice = sinks.upsert_dim(once, new, ["location_id"])
    for df in (once, twice):
        assert {tuple(r) for r in df.collect()} == {("a", "new"), ("b", "kept"), ("c", "added")}


PAYLOAD = T.StructType([
    T.StructField("location_name", T.StringType()),
    T.StructField("time_start", T.LongType()),
    T.StructField("time_end", T.LongType()),
    T.StructField("interval_s", T.LongType()),
    T.StructField("temperature_2m_max", T.ArrayType(T.DoubleType())),
    T.StructField("snowfall_sum", T.ArrayType(T.DoubleType())),
    T.StructField("precipitation_probability_max", T.ArrayType(T.DoubleType())),
])


def payload(spark, start, end, interval, high, snow):
    document = json.dumps({"location_name": "La Parva", "time_start": start, "time_end": end, "interval_s": interval,
                           "temperature_2m_max": high, "snowfall_sum": snow, "precipitation_probability_max": [1.0] * len(high)})
    return payloads.parse(spark.createDataFrame([(document,)], "value string"), PAYLOAD)


@pytest.mark.parametrize("session_zone", ["UTC", "Asia/Tokyo"])
def test_daily_dates_are_local(spark, session_zone):
    # Local midnight of 1 July 2024 in Santiago is 04:00 UTC.
    start = int(dt.datetime(2024, 7, 1, 4, tzinfo=dt.UTC).timestamp())
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        df = payload(spark, start, start + 3 * 86400, 86400, [1.0, None, 3.0], [4.0, 5.0, 6.0])
        rows = payloads.flatten_daily(df).orderBy("date").collect()
        assert [(r["date"].day, r["temperature_2m_max"], r["snowfall_sum"]) for r in rows] == [(1, 1.0, 4.0), (2, None, 5.0), (3, 3.0, 6.0)]
        assert rows[0]["precipitation_probability_max"] == 1.0 and rows[0]["precipitation_hours"] is None
        past = payloads.flatten_daily(df, mode="historical").first()
        assert past["precipitation_probability_max"] is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_hourly_rows_and_the_last_step(spark):
    start = int(dt.datetime(2024, 7, 1, 3, tzinfo=dt.UTC).timestamp())
    df = payload(spark, start, start + 2 * 3600, 3600, [0.0, 0.0], [0.0, 0.0]).withColumnRenamed("snowfall_sum", "snowfall")
    df = df.select("location_name", "time_start", "time_end", "interval_s", "snowfall")
    rows = payloads.flatten_hourly(df).orderBy("timestamp").collect()
    assert [(r["timestamp"], r["date"]) for r in rows] == [
        (dt.datetime(2024, 6, 30, 23), dt.date(2024, 6, 30)), (dt.datetime(2024, 7, 1), dt.date(2024, 7, 1))
    ]


def test_uneven_arrays_raise(spark):
    with pytest.raises(PySparkException, match="uneven"):
        payloads.flatten_daily(payload(spark, 0, 3 * 86400, 86400, [1.0], [1.0, 2.0, 3.0])).collect()
    with pytest.raises(ValueError):
        payloads.flatten_daily(payload(spark, 0, 86400, 86400, [1.0], [1.0]), mode="now")


def test_attach_location(spark):
    rows = spark.createDataFrame([("La Parva", 1), ("nowhere", 2)], "location_name string, v int")
    places = spark.createDataFrame([("La Parva", -33.35, -70.27, 3000)], "name string, latitude double, longitude double, elevation int")
    assert payloads.attach_location(rows, places).collect() == [("La Parva", 1, -33.35, -70.27, 3000)]


CELLS = """latitude double, longitude double, elevation double, slope_degrees double, aspect_degrees double,
    gee_quality_flag double"""


def test_check_cells(spark):
    box = BBox(0, 1, 0, 1)
    good = spark.createDataFrame([(x / 40, y / 40, 100.0, 10.0, 10.0, 1.0) for x in range(41) for y in range(41)], CELLS)
    assert quality.check_cells(good, box).where("not passed").count() == 0
    quality.enforce(quality.check_cells(good, box))
    bad = spark.createDataFrame([(0.0, 0.0, -1.0, 91.0, 361.0, 0.5), (0.1, None, 5.0, -1.0, 0.0, 1.0)], CELLS)
    failed = {r["check"]: r["value"] for r in quality.check_cells(bad, box).where("not passed").collect()}
    assert failed == {"null_longitude": 1, "negative_elevation": 1, "slope_range": 2, "aspect_range": 1, "enough_rows": 2, "coverage": 0.0, "quality": 0.75}
    with pytest.raises(ValueError, match="aspect_range"):
        quality.enforce(quality.check_cells(bad, box))
    with pytest.raises(ValueError, match="not_empty"):
        quality.enforce(quality.check_cells(good.limit(0), box))


def test_check_range(spark):
    df = spark.createDataFrame([(0.5,), (1.2,)], "s double")
    rows = {r["check"]: r["passed"] for r in quality.check_range(df, "s").collect()}
    assert rows == {"s_min": True, "s_max": False, "s_avg": True}


def test_inventory_and_layers(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "full"))
    spark.range(0).write.parquet(str(tmp_path / "empty"))
    names = {"weather_daily": f"{tmp_path}/full", "nlp_risk_patterns": f"{tmp_path}/empty", "avalanche_predictions": f"{tmp_path}/none"}
    rows = {tuple(r) for r in quality.table_inventory(spark, names).collect()}
    assert rows == {("weather_daily", "bronze", 3, "ok"), ("nlp_risk_patterns", "silver", 0, "empty"), ("avalanche_predictions", "gold", None, "missing")}
    spark.range(1).createOrReplaceTempView("weather_triggers")
    layers = {r["layer"]: r["tables"] for r in quality.catalog_layers(spark).collect()}
    assert layers["silver"] >= 1
    assert sources.read_table(spark, "weather_triggers").count() == 1
    spark.catalog.dropTempView("weather_triggers")
