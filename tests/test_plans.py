import datetime as dt
import glob
import math
import os
import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from nivo import config, contracts
from nivo.plans import oracle, queries
from nivo.plans import run as layers
from nivo.plans import testdata

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = queries.QUERIES, oracle.ORACLES

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, abs_tol=1e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    order = sorted(df.columns)
    found = sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == order
    wanted = sorted((tuple(r[names.index(c)] for c in order) for r in result.fetchall()), key=repr)
    assert len(found) == len(wanted)
    for x, y in zip(found, wanted, strict=True):
        assert all(same(a, b) for a, b in zip(x, y, strict=True)), (x, y)


def test_every_query_has_sql_and_is_registered():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.items() <= entry.queries().items() and ORACLES.items() <= entry.oracle_sql().items()


@pytest.mark.parametrize("name", ["predictions", "bulletin_text", "validation_match", "susceptibility_map", "text_patterns", "weather_triggers"])
def test_plans_stay_in_the_jvm_without_cross_joins(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan


def test_run_builds_every_layer_and_can_be_repeated(spark, tmp_path):
    root = str(tmp_path / "model")
    inputs = layers.Inputs(
        cells=testdata.cells(spark, SF),
        daily=testdata.weather_daily(spark, SF),
        reports=testdata.reports(spark, SF),
        observed=testdata.observed(spark, SF),
        cell_metres=(60.0, 60.0),
    )
    for _ in range(2):
        inventory = layers.run(spark, inputs, root, text_files=True)
        assert {r["status"] for r in inventory.collect()} == {"ok"}
    model = layers.Layers(spark, root)
    predictions = model.read("avalanche_predictions")
    assert predictions.count() == predictions.select("prediction_id").distinct().count() > 0
    assert set(predictions.columns) == set(contracts.AVALANCHE_PREDICTIONS.names)
    newest = testdata.weather_daily(spark, SF).agg({"date": "max"}).first()[0]
    assert {r[0] for r in predictions.select("forecast_date").distinct().collect()} == {newest}
    records = model.read("avalanche_bulletins")
    texts = glob.glob(f"{root}/boletines/*/*/*.txt")
    assert len(texts) == records.count() > 0
    assert model.read("validation_results").count() == 8
    earlier = newest - dt.timedelta(3)
    layers.build_predictions(model, earlier)
    dates = {r[0] for r in model.read("avalanche_predictions").select("forecast_date").distinct().collect()}
    assert dates == {newest, earlier}


def test_partial_runs_keep_what_they_do_not_renew(spark, tmp_path):
    """A run with one location, a backfill, and a repeated run leave all other rows as they were."""
    root = str(tmp_path / "model")
    daily = testdata.weather_daily(spark, SF).cache()
    model = layers.Layers(spark, root)
    whole = layers.Inputs(cells=testdata.cells(spark, SF), daily=daily, cell_metres=(60.0, 60.0))
    layers.run(spark, whole, root)

    def stored(table, *columns):
        return sorted(map(tuple, model.read(table).select(*columns).collect()))

    features = stored("weather_features", "location_name", "date", "snowfall_24h")
    triggers = stored("weather_triggers", "trigger_id")
    levels = stored("avalanche_predictions", "zone_name", "forecast_date", "elevation_band", "eaws_level", "risk_score")
    location = daily.select("location_name").distinct().orderBy("location_name").first()[0]
    part = layers.Inputs(daily=daily.where(F.col("location_name") == location))
    layers.run(spark, part, root)
    assert stored("weather_features", "location_name", "date", "snowfall_24h") == features
    assert stored("weather_triggers", "trigger_id") == triggers
    assert (
        stored("avalanche_predictions", "zone_name", "forecast_date", "elevation_band", "eaws_level", "risk_score")
        == levels
    )
    newest = daily.agg(F.max("date")).first()[0]
    earlier = newest - dt.timedelta(3)
    layers.run(spark, part, root, as_of=earlier)
    dates = {r[0] for r in model.read("avalanche_bulletins").select("issue_date").distinct().collect()}
    assert dates == {newest, earlier}
    assert {r for r in levels} <= set(
        stored("avalanche_predictions", "zone_name", "forecast_date", "elevation_band", "eaws_level", "risk_score")
    )


@pytest.mark.parametrize("forget", [False, True])
def test_a_run_with_lead_in_days_keeps_their_values(spark, tmp_path, forget):
    """Also where features, but no daily rows, are stored of the days before."""
    root = str(tmp_path / "model")
    daily = testdata.weather_daily(spark, SF).cache()
    model = layers.Layers(spark, root)
    newest = daily.agg(F.max("date")).first()[0]
    first = newest - dt.timedelta(9)
    layers.build_weather(model, layers.Inputs(daily=daily))

    def stored():
        columns = ("location_name", "date", "snowfall_24h", "snowfall_48h", "snowfall_72h")
        kinds = model.read("weather_triggers").select("trigger_id")
        return (
            sorted(map(tuple, model.read("weather_features").select(*columns).collect()), key=str),
            sorted(map(tuple, kinds.collect())),
        )

    whole = stored()
    if forget:
        shutil.rmtree(model.path("weather_daily"))
    layers.build_weather(model, layers.Inputs(daily=daily.where(F.col("date") >= F.lit(first))))
    assert stored() == whole
    if not forget:  # Without any lead-in days, and days put in before stored ones.
        layers.build_weather(model, layers.Inputs(daily=daily.where(F.col("date") == F.lit(newest))))
        assert stored() == whole


def test_run_with_checked_terrain(spark, tmp_path):
    root = str(tmp_path / "model")
    cells = testdata.cells(spark, SF)
    box = config.BBox(-33.40, -33.3976, -70.32, -70.2966)
    options = {"cell_metres": (60.0, 60.0), "terrain_version": "v2"}
    layers.run(spark, layers.Inputs(cells=cells, checked_box=box, **options), root)
    model = layers.Layers(spark, root)
    stored = model.read("susceptibility_map", contracts.SUSCEPTIBILITY_MAP_V2)
    assert 0 < stored.count() <= cells.where("elevation >= 2000").count()
    assert stored.where("gee_quality_flag < 0.9 or data_source is null").count() == 0
    low = cells.withColumn("latitude", F.when(F.col("row") != 4, F.col("latitude")))
    with pytest.raises(ValueError, match="null_latitude"):
        layers.run(spark, layers.Inputs(cells=low, checked_box=box, **options), root)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "main_factors" in df.columns
