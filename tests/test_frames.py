import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nivo import config, filters, frames
from nivo.config import BBox


def points(spark):
    rows = [("a", -33.40, -70.32), ("b", -33.30, -70.22), ("c", -33.29, -70.25), ("d", -33.35, -70.33), ("e", None, -70.3)]
    return spark.createDataFrame(rows, "id string, latitude double, longitude double")


def test_bbox_is_inclusive(spark):
    assert {r["id"] for r in filters.in_bbox(points(spark), config.PILOT_ZONE.bbox).collect()} == {"a", "b"}


def test_filter_or_all(spark):
    df = points(spark)
    assert filters.filter_or_all(df, filters.inside(config.PILOT_ZONE.bbox)).count() == 2
    assert filters.filter_or_all(df, filters.inside(BBox(1, 2, 1, 2))).count() == 5
    assert filters.filter_or_all(df.limit(0), filters.inside(BBox(1, 2, 1, 2))).count() == 0


def test_assign_zone(spark):
    zones = spark.createDataFrame(
        [("low", -33.40, -33.35, -70.40, -70.20), ("high", -33.35, -33.20, -70.40, -70.20), ("wide", -40.0, -20.0, -71.0, -70.0)],
        "zone_name string, south double, north double, west double, east double",
    )
    found = {r["id"]: r["zone_name"] for r in filters.assign_zone(points(spark), zones).collect()}
    # Borders belong to both boxes: the first by name is taken.
    assert found == {"a": "low", "b": "high", "c": "high", "d": "high", "e": None}
    assert filters.assign_zone(points(spark), zones.limit(0)).where("zone_name is null").count() == 5


def test_threshold_filters(spark):
    df = spark.createDataFrame([(0.59, 2, True), (0.6, 3, False), (None, 5, True)], "susceptibility_score double, eaws_level int, is_critical boolean")
    assert filters.high_susceptibility(df).count() == 1
    assert filters.at_least_level(df).count() == 2
    assert filters.critical_triggers(df).count() == 2


@pytest.mark.parametrize("values", [
    [random.Random(n).gauss(30, 12) for n in range(700)],
    [0.1 * n for n in range(101)],
    [5.0, 5.0, 5.0],
    [0.0, 1.0],
])
@pytest.mark.parametrize("bins", [50, 7, 1])
def test_histogram_equals_numpy(spark, values, bins):
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    counts, edges = np.histogram(values, bins=bins)
    rows = sorted(frames.histogram(df, "v", bins).collect())
    assert [r["count"] for r in rows] == counts.tolist()
    assert np.allclose([r["bin_start"] for r in rows], edges[:-1]) and np.allclose([r["bin_end"] for r in rows], edges[1:])


def test_histogram_of_nothing(spark):
    assert frames.histogram(spark.createDataFrame([(None,)], "v double"), "v").count() == 0


def test_latest_and_newest(spark):
    d = dt.date(2024, 1, 1)
    rows = [("a", d, 1), ("a", d + dt.timedelta(1), 2), ("a", d + dt.timedelta(1), 3), ("b", d, 4)]
    df = spark.createDataFrame(rows, "k string, d date, v int")
    assert {r["v"] for r in frames.latest(df, "d").collect()} == {2, 3}
    assert {r["v"] for r in frames.latest(df, "d", "k").collect()} == {2, 3, 4}
    newest = frames.newest_per_key(df, ["k"], [F.desc("d"), F.desc("v")])
    assert {r["v"] for r in newest.collect()} == {3, 4}
    # Map tasks prune to one row per key before the shuffle.
    assert "WindowGroupLimit" in newest._jdf.queryExecution().executedPlan().toString()
    assert [r["v"] for r in frames.top_k(df, F.desc("v"), 2).collect()] == [4, 3]


def test_distribution(spark):
    df = spark.createDataFrame([("x",)] * 2 + [("y",)], "c string")
    rows = {r["c"]: (r["n"], r["percentage"]) for r in frames.distribution(df, "c", count_name="n").collect()}
    assert rows == {"x": (2, 66.67), "y": (1, 33.33)}
    assert frames.distribution(df, "c", total_pct=False).columns == ["c", "count"]


def test_assign_zone_keeps_every_point(spark):
    zones = spark.createDataFrame(
        [("b", 0.0, 1.0, 0.0, 1.0), ("a", 0.5, 1.0, 0.0, 1.0)],
        "zone_name string, south double, north double, west double, east double",
    )
    rows = [("k", 0.6, 0.6), ("k", 0.2, 0.2), (None, 0.7, 0.1), (None, 9.0, 9.0), (None, None, 0.1), ("k", 0.6, 0.6)]
    found = filters.assign_zone(spark.createDataFrame(rows, "id string, latitude double, longitude double"), zones)
    got = sorted((str(r["id"]), str(r["zone_name"])) for r in found.collect())
    assert got == [("None", "None"), ("None", "None"), ("None", "a"), ("k", "a"), ("k", "a"), ("k", "b")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_sample_is_repeatable_and_its_rate_fixed(spark):
    df = spark.range(20000)
    first = {r[0] for r in frames.sample(df, 0.05, seed=1).collect()}
    again = {r[0] for r in frames.sample(df.repartition(7), 0.05, seed=1).collect()}
    other = {r[0] for r in frames.sample(df, 0.05, seed=2).collect()}
    assert first == again and first != other and 850 < len(first) < 1150
    assert {r[0] for r in frames.sample(df.limit(2000), 0.05, seed=1).collect()} <= first
    assert frames.sample(df.limit(0), 0.5).count() == 0


def test_reports_equal_single_groupings(spark):
    rows = [(x % 3 if x % 5 else None, "ab"[x % 2], float(x)) for x in range(60)]
    df = spark.createDataFrame(rows, "k int, s string, v double")
    sets = {"k": ["k"], "both": ["k", "s"], "s": ["s"], "all": []}
    found = frames.reports(df, sets, [F.count("*").alias("n"), F.sum("v").alias("total")])
    for name, keys in sets.items():
        single = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("v").alias("total"))
        part = found.where(F.col("report") == name).select(*single.columns)
        assert sorted(map(str, part.collect())) == sorted(map(str, single.collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("+- Expand") + plan.count(" Expand [") >= 1 and plan.count("Scan ExistingRDD") == 1
    assert frames.reports(df, {"all": []}, [F.count("*").alias("n")]).collect() == [("all", 60)]
    with pytest.raises(ValueError):
        frames.reports(df, {"a": ["k", "s"], "b": ["s", "k"]}, [F.count("*").alias("n")])


def test_newest_value_comes_from_the_footers(spark, tmp_path):
    path = str(tmp_path / "t")
    days = spark.range(4_000).selectExpr("id", "date_add(date'2024-01-01', int(id % 97)) AS date")
    days.repartition(3).write.parquet(path)
    newest = frames.newest_from_footers(spark, path, "date")
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [MAX(date)]" in plan
    expected = days.agg(F.max("date")).first()[0]
    assert newest.first()[0] == expected
    slice_ = frames.newest_slice(spark, path, "date")
    assert slice_.count() == days.where(F.col("date") == expected).count() > 0
    pushed = slice_._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(date" in pushed and spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
    empty = str(tmp_path / "empty")
    days.limit(0).write.parquet(empty)
    assert frames.newest_slice(spark, empty, "date").count() == 0
