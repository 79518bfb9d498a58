import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from nivo import bands, config, keys
from nivo.functions import templates
from nivo.functions.numbers import fixed

EDGES = [-1.0, 0.0, 2499.9, 2500.0, 3200.0, 3500.0, 5999.9, 6000.0, None]


def column(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def collect(df, expression):
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


@pytest.mark.parametrize(
    ("outside", "expected"),
    [
        ("last", "Alta Baja Baja Media-Baja Media-Alta Alta Alta Alta Alta".split()),
        ("null", [None, *"Baja Baja Media-Baja Media-Alta Alta Alta".split(), None, None]),
        ("open", "Baja Baja Baja Media-Baja Media-Alta Alta Alta Alta Alta".split()),
    ],
)
def test_elevation_band_edges(spark, outside, expected):
    assert collect(column(spark, EDGES), bands.elevation_band(F.col("v"), outside=outside)) == expected


def test_elevation_band_options(spark):
    df = column(spark, [None, float("nan")])
    assert collect(df, bands.elevation_band(F.col("v"), nulls="null"))[0] is None
    assert collect(df, bands.elevation_band(F.col("v"), outside="last"))[1] == "Alta"
    with pytest.raises(ValueError):
        bands.elevation_band(F.col("v"), outside="nearest")


def test_danger_level_and_category_edges(spark):
    df = column(spark, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])
    assert collect(df, bands.danger_level(F.col("v"))) == [1, 2, 3, 4, 5, 5]
    assert collect(df, bands.risk_category(F.col("v"))) == [
        "Muy Bajo", "Bajo", "Moderado", "Alto", "Muy Alto", "Muy Alto"
    ]
    assert collect(column(spark, [None]), bands.risk_category(F.col("v"))) == ["Muy Bajo"]


def test_danger_scale_table(spark):
    rows = bands.danger_scale(spark).orderBy("level").collect()
    assert [r["label"] for r in rows] == ["Débil", "Limitado", "Notable", "Fuerte", "Muy Fuerte"]
    levels = column(spark, [3, 6], "int")
    assert collect(levels, bands.danger_attribute(F.col("v"), "color")) == ["#FF9900", None]


def test_lookup_band_with_open_and_far_bounds(spark):
    table = spark.createDataFrame(
        [("low", None, 100.0), ("mid", 100.0, 900.0), ("far", 900.0, 1e300), ("never", 5.0, 5.0)],
        "band string, low double, high double",
    )
    values = [-1e6, 0.0, 99.9, 100.0, 899.0, 900.0, 1e6, None] + [500.0] * 300
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    rows = {r["i"]: r["band"] for r in bands.lookup_band(df, "v", table).collect()}
    expected = ["low", "low", "low", "mid", "mid", "far", "far", None] + ["mid"] * 300
    assert [rows[i] for i in range(len(values))] == expected
    infinite = spark.createDataFrame([("all", float("-inf"), float("inf"))], "band string, low double, high double")
    assert bands.lookup_band(df, "v", infinite).where("band = 'all'").count() == len(values) - 1
    assert bands.lookup_band(df.limit(0), "v", table).count() == 0


def test_lookup_band_matches_the_expression(spark):
    table = spark.createDataFrame([(b.name, float(b.low), float(b.high)) for b in config.BANDS], "band string, low double, high double")
    rng = random.Random(1)
    values = [rng.uniform(-500, 7000) for _ in range(500)] + EDGES
    df = column(spark, values)
    joined = bands.lookup_band(df, "v", table).withColumn("e", bands.elevation_band(F.col("v"), outside="null"))
    rows = joined.collect()
    assert len(rows) == len(values)
    assert all(r["band"] == r["e"] for r in rows)


def test_lookup_band_by_brute_force(spark):
    """Overlapping, nested, repeated, touching and open bands; an outlier costs nothing."""
    rng = random.Random(4)
    table = [("all", None, None), ("a", 0.0, 10.0), ("a", 0.0, 10.0), ("b", 5.0, 7.0), ("c", 10.0, 11.0), ("d", None, 3.0)]
    table += [("e", 8.0, None), ("empty", 4.0, 4.0), ("upside", 6.0, 2.0)]
    table += [(f"r{i}", x, x + rng.uniform(0, 9)) for i, x in enumerate(rng.uniform(-20, 20) for _ in range(40))]
    values = [rng.uniform(-25, 25) for _ in range(300)] + [0.0, 3.0, 10.0, 11.0, 7.0, 1e13, -1e300]
    values += [None, float("nan"), float("inf"), float("-inf")]
    df = spark.createDataFrame(list(enumerate(values)), "band_id int, v double")
    found = bands.lookup_band(df, "v", spark.createDataFrame(table, "band string, low double, high double"))

    def holds(low, high, v):
        return (low is None or low <= v) and (high is None or v < high)

    wanted = []
    for i, v in enumerate(values):
        held = [] if v is None or math.isnan(v) or math.isinf(v) else [b for b, low, high in table if holds(low, high, v)]
        wanted += [(i, b) for b in held] or [(i, None)]
    assert sorted(((r.band_id, r.band) for r in found.collect()), key=str) == sorted(wanted, key=str)
    two = spark.createDataFrame([("low", None, 1000.0), ("high", 1000.0, None)], "band string, low double, high double")
    rows = bands.lookup_band(spark.createDataFrame([(10.0,), (1e13,)], "v double"), "v", two).collect()
    assert sorted(tuple(r) for r in rows) == [(10.0, "low"), (1e13, "high")]
    none = bands.lookup_band(df, "v", two.limit(0))
    assert none.count() == len(values) and none.where("band is not null").count() == 0


def test_lookup_band_scans_once_and_shuffles_no_values(spark, tmp_path):
    spark.range(1000).selectExpr("id", "double(id) AS v").write.parquet(f"{tmp_path}/values")
    spark.createDataFrame([("x", 1.0, 2.0)], "band string, low double, high double").write.parquet(f"{tmp_path}/bands")
    found = bands.lookup_band(spark.read.parquet(f"{tmp_path}/values"), "v", spark.read.parquet(f"{tmp_path}/bands"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Subquery")[0] if plan.startswith("Subquery") is False else plan
    assert plan.count(f"{tmp_path}/values") == 1 and "Join" not in plan and "Exchange" not in main
    many = spark.range(bands.MOST_BANDS + 1).selectExpr("string(id) AS band", "double(id) AS low", "double(id + 1) AS high")
    with pytest.raises(Exception, match="more than"):
        bands.lookup_band(spark.range(1).selectExpr("1.0D AS v"), "v", many).collect()


@pytest.mark.parametrize("digits", [0, 1, 2, 3])
def test_fixed_formats_like_printf(spark, digits):
    rng = random.Random(digits)
    values = [0.0, 0.05, 0.25, 0.35, 0.45, 0.5, 0.95, 0.995, 0.9995, 1.5, 2.5, 2.675, 1e-9, 9.95, 99.5, 1e6 + 0.125]
    values += [n * 0.0009 for n in range(1, 3000, 7)] + [n / 8 for n in range(100)] + [n / 1000 for n in range(0, 2000, 5)]
    values += [rng.uniform(0, 1000) for _ in range(500)]
    assert collect(column(spark, values), fixed(F.col("v"), digits)) == [f"{v:.{digits}f}" for v in values]


def test_keys(spark):
    date, zone = F.lit(dt.date(2024, 8, 5)), F.lit("La Parva")
    row = spark.range(1).select(
        keys.zone_id(zone, F.lit("Media-Alta")),
        keys.prediction_id(date, zone, F.lit("Alta")),
        keys.pattern_id(F.lit("001")),
        keys.feature_id(date, zone),
        keys.grid_id(F.lit("topo_0123456789abcdef")),
        keys.grid_id(F.lit("gee_0123456789ab"), 5),
        keys.row_key(F.lit("a"), F.lit(1)),
        keys.row_key(F.lit("a"), F.lit(None)),
    ).first()
    assert row[:6] == (
        "zone_La_Parva_Media-Alta",
        "pred_20240805_La_Parva_Alta",
        "nlp_001",
        "weather_20240805_La Parva",
        "grid_0123456789ab",
        "grid_0123456789ab",
    )
    assert row[6] != row[7] and len(row[6]) == 12


def test_fill_template(spark):
    text = templates.fill("a {x} b {y}{x}", {"x": F.lit(1), "y": F.lit("é")})
    assert spark.range(1).select(text).first()[0] == "a 1 b é1"


def test_vocabulary_size():
    assert [len(v) for v in config.VOCABULARY.values()] == [10, 13, 9, 10, 8, 8, 5]
    assert (len(config.POSITIVE_WORDS), len(config.NEGATIVE_WORDS)) == (11, 10)
    assert math.isclose(sum((0.35, 0.45, 0.20)), 1.0)
