import datetime as dt
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from nivo import weather

DAY = dt.date(2024, 7, 1)
SCHEMA = """location_name string, elevation int, date date, temperature_2m_max double, temperature_2m_min double,
    temperature_2m_mean double, precipitation_sum double, snowfall_sum double, windspeed_10m_max double"""


@pytest.fixture(scope="module")
def daily(spark):
    rows = [
        ("La Parva", 3000, DAY, 2.0, -4.0, -1.0, 2.0, 20.0, 20.0),
        ("La Parva", 3000, DAY + dt.timedelta(1), 8.0, -3.0, 2.0, 12.0, 35.0, 55.0),
        ("La Parva", 3000, DAY + dt.timedelta(2), 1.0, -9.0, -4.0, 30.0, 40.0, 75.0),
        ("La Parva", 3000, DAY + dt.timedelta(3), 0.0, -1.0, -0.5, 4.0, None, 10.0),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def random_series(spark, seed, locations=4, days=90, keep=0.6):
    rng = random.Random(seed)
    rows = []
    for i in range(locations):
        for n in range(days):
            if rng.random() < keep and not (i == 1 and 20 <= n < 70):
                snow = None if rng.random() < 0.1 else round(rng.uniform(0, 90), 2)
                low = round(rng.uniform(-20, 5), 1)
                rows.append((f"l{i}", 3000, DAY + dt.timedelta(n), low + 7, low, low + 3, 1.0, snow, 5.0))
    return spark.createDataFrame(rows, SCHEMA)


def test_hand_worked_days(daily):
    rows = weather.features(daily).orderBy("date").collect()
    assert [r["snowfall_48h"] for r in rows] == [20, 55, 75, 40]
    assert [r["snowfall_72h"] for r in rows] == [20, 55, 95, 75]
    assert [r["temp_variation_24h"] for r in rows] == [6, 11, 10, 1]
    assert [r["temp_variation_48h"] for r in rows] == [None, 12, 4, 9]
    assert [r["isoterma_0c"] for r in rows] == [3000, 3307, 3000, 3000]
    assert [r["precipitation_intensity"] for r in rows] == ["Baja", "Moderada", "Muy Alta", "Baja"]
    fired = weather.detect_triggers(weather.features(daily)).collect()
    found = {(r["date"].day, r["trigger_type"], r["trigger_severity"]) for r in fired}
    assert found == {
        (1, "Nevada Intensa 24h", "Bajo"), (1, "Fluctuación Térmica", "Bajo"),
        (2, "Nevada Intensa 24h", "Moderado"), (2, "Nevada Acumulada 72h", "Alto"),
        (2, "Fluctuación Térmica", "Moderado"), (2, "Viento Fuerte", "Moderado"),
        (2, "Isoterma Crítica", "Zona Crítica"), (2, "Lluvia sobre Nieve", "Detectado"),
        (3, "Nevada Intensa 24h", "Moderado"), (3, "Nevada Acumulada 72h", "Crítico"),
        (3, "Fluctuación Térmica", "Moderado"), (3, "Viento Fuerte", "Alto"),
        (4, "Nevada Acumulada 72h", "Alto"),
    }
    assert len(fired) == 13 and sum(r["is_critical"] for r in fired) == 4
    assert len({r["trigger_id"] for r in fired}) == 13


@pytest.mark.parametrize("block_days", [1, 3, 10, 366])
def test_row_blocks_equal_one_window(spark, block_days):
    series = random_series(spark, block_days)
    window = Window.partitionBy("location_name").orderBy("date")
    plain = series.select(
        "location_name",
        "date",
        *[F.sum("snowfall_sum").over(window.rowsBetween(1 - n, 0)) for n in (2, 3, 7)],
        F.abs(F.col("temperature_2m_max") - F.lag("temperature_2m_min").over(window)),
    )
    check_equal(weather.snow_windows(series, "rows", block_days), plain)


@pytest.mark.parametrize("block_days", [1, 3, 10, 366])
def test_range_blocks_equal_a_self_join(spark, block_days):
    series = random_series(spark, block_days + 50)
    rows = {(r["location_name"], r["date"]): r for r in series.collect()}
    expected = []
    for (place, day), row in rows.items():
        sums = []
        for n in (2, 3, 7):
            back = [rows.get((place, day - dt.timedelta(k))) for k in range(n)]
            snow = [b["snowfall_sum"] for b in back if b is not None and b["snowfall_sum"] is not None]
            sums.append(sum(snow) if snow else None)
        before = rows.get((place, day - dt.timedelta(1)))
        swing = None if before is None else abs(row["temperature_2m_max"] - before["temperature_2m_min"])
        expected.append((place, day, *sums, swing))
    check_equal(weather.snow_windows(series, "range", block_days), spark.createDataFrame(
        expected, "a string, b date, c double, d double, e double, f double"))


def check_equal(windows, expected):
    names = ["location_name", "date", "snowfall_48h", "snowfall_72h", "snowfall_7d", "temp_variation_48h"]
    found = {tuple(r)[:2]: tuple(r)[2:] for r in windows.select(*names).collect()}
    wanted = {tuple(r)[:2]: tuple(r)[2:] for r in expected.collect()}
    assert found.keys() == wanted.keys()
    for key, values in wanted.items():
        for x, y in zip(found[key], values, strict=True):
            assert x == y or math.isclose(x, y, abs_tol=1e-9), key


def test_frames_agree_without_gaps(spark):
    series = random_series(spark, 9, locations=2, keep=2.0).where("location_name = 'l0'")
    rows = weather.features(series, "rows").orderBy("date").collect()
    ranges = weather.features(series, "range").orderBy("date").collect()
    for a, b in zip(rows, ranges, strict=True):
        assert a["snowfall_48h"] is b["snowfall_48h"] is None or math.isclose(a["snowfall_48h"], b["snowfall_48h"])
        assert a["temp_variation_48h"] == b["temp_variation_48h"]
    with pytest.raises(ValueError):
        weather.features(series, "days")


def test_isotherm_of_odd_values(spark):
    rows = [("a", 3000, DAY, 1.0, 0.0, v, None, 1.0, 1.0) for v in (float("nan"), 1e12, None, 0.0, 6.5)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = sorted((r["isoterma_0c"] for r in weather.features(df).collect()), key=lambda v: (v is None, v))
    assert found == [3000, 3000, 4000, None, None]
    assert {r["precipitation_intensity"] for r in weather.features(df).collect()} == {"Muy Alta"}


def test_date_windows(daily):
    today = dt.date(2024, 8, 1)
    assert weather.date_bounds("2024-07-08", "historical", today) == (DAY, dt.date(2024, 7, 8))
    assert weather.date_bounds(DAY, "forecast") == (DAY, dt.date(2024, 7, 17))
    for bad in (dt.date(2024, 7, 31), dt.date(2020, 1, 7)):
        with pytest.raises(ValueError):
            weather.date_bounds(bad, "historical", today)
    with pytest.raises(ValueError):
        weather.date_bounds(DAY, "both")
    assert weather.date_window(daily, dt.date(2024, 7, 9), "historical", today=today).count() == 3
    assert weather.last_n_days(daily, 3).count() == 3
    assert weather.last_n_days(daily, 2, dt.date(2024, 7, 2)).count() == 2


def test_counts_and_summaries(daily):
    features = weather.features(daily)
    triggers = weather.detect_triggers(features)
    pivot = {r["date"].day: r for r in weather.trigger_pivot(triggers).collect()}
    assert pivot[2]["Moderado"] == 3 and pivot[4]["Bajo"] == 0 and pivot[3]["Crítico"] == 1
    assert sum(r["count"] for r in weather.trigger_counts(triggers).collect()) == 13
    assert {r["trigger_severity"]: r["count"] for r in weather.severity_counts(triggers).collect()}["Bajo"] == 2
    row = weather.summary(features, triggers).first()
    assert (row["total_days_analyzed"], row["locations"], row["total_triggers"], row["critical_triggers"]) == (4, 1, 13, 4)
    assert (row["max_snowfall_24h"], row["max_snowfall_72h"], row["max_wind_speed"]) == (40.0, 95.0, 75.0)
    snow = weather.snowfall_summary(daily).first()
    assert (snow["total_snowfall_cm"], snow["min_temp_c"], snow["max_temp_c"]) == (95.0, -9.0, 8.0)


def test_calm_weather_gives_an_empty_trigger_table(spark):
    calm = spark.createDataFrame([("a", 1000, DAY, 1.0, 0.0, -1.0, 0.0, 0.0, 0.0)], SCHEMA)
    triggers = weather.detect_triggers(weather.features(calm))
    assert triggers.isEmpty()
    assert weather.summary(weather.features(calm), triggers).first()["total_triggers"] == 0


def test_no_window_spans_a_whole_location(spark):
    for frame in ("rows", "range"):
        plan = weather.features(random_series(spark, 1), frame)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan
        wide = [line for line in plan.splitlines() if "Window [" in line and "sum(snowfall_sum" in line]
        assert wide and all("_block" in line for line in wide)
