import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from nivo import bulletins, fusion, text, validation, weather
from nivo.functions import templates
from nivo.operators import lookback
from tests.test_weather import DAY, random_series

ZONE = "La Parva"


@pytest.fixture(scope="module")
def seeds(spark):
    topo = spark.createDataFrame(
        [(ZONE, "Media-Alta", 0.7, 2.5), (ZONE, "Alta", 0.8, 1.8)],
        "zone_name string, elevation_band string, topo_score double, critical_area_km2 double",
    )
    nlp = spark.createDataFrame(
        [(ZONE, "Media-Alta", 0.5, 10, 3, 5), (ZONE, "Alta", 0.6, 15, 5, 8)],
        """zone_name string, elevation_band string, nlp_score double, total_risk_mentions bigint,
        total_avalanche_mentions bigint, nlp_report_count bigint""",
    )
    wx = spark.createDataFrame(
        [(ZONE, "Media-Alta", 25.0, 60.0, 12.0, 45.0, 3200.0, 2), (ZONE, "Alta", 35.0, 85.0, 15.0, 55.0, 3500.0, 3)],
        """zone_name string, elevation_band string, max_snowfall_24h double, max_snowfall_72h double,
        max_temp_variation double, max_wind_speed double, avg_isoterma double, critical_trigger_count bigint""",
    )
    return topo, nlp, wx


def test_seed_fusion(seeds):
    scored = fusion.score(fusion.fuse(*seeds)).withColumn("f", fusion.main_factors())
    rows = {r["elevation_band"]: r for r in scored.collect()}
    mid, high = rows["Media-Alta"], rows["Alta"]
    assert math.isclose(mid["topo_contribution"], 0.245) and math.isclose(high["topo_contribution"], 0.28)
    assert math.isclose(mid["weather_score_raw"], 0.43375) and math.isclose(high["weather_score_raw"], 0.58)
    assert math.isclose(mid["nlp_score_adjusted"], 0.42) and math.isclose(high["nlp_score_adjusted"], 0.56)
    assert math.isclose(mid["risk_score"], 0.5241875) and math.isclose(high["risk_score"], 0.653)
    assert (mid["eaws_level"], mid["eaws_label"], high["eaws_level"], high["eaws_label"]) == (3, "Notable", 4, "Fuerte")
    assert mid["confidence"] == high["confidence"] == 1.0
    assert mid["f"] == [
        "Pendientes críticas (2.5 km²)", "Nevada acumulada (60 cm/72h)", "Fluctuación térmica (12°C)",
        "Historial de 3 evento(s)", "2 condición(es) gatillante(s)",
    ]
    assert high["f"] == [
        "Pendientes críticas (1.8 km²)", "Nevada intensa (35 cm/24h)", "Nevada acumulada (85 cm/72h)",
        "Fluctuación térmica (15°C)", "Viento fuerte (55 km/h)", "Historial de 5 evento(s)",
        "3 condición(es) gatillante(s)",
    ]


def test_missing_sources_default(seeds):
    topo, nlp, wx = seeds
    fused = fusion.fuse(topo.where("elevation_band = 'Alta'"), nlp.limit(0), wx.where("elevation_band = 'Media-Alta'"))
    rows = {r["elevation_band"]: r for r in fusion.score(fused).withColumn("f", fusion.main_factors()).collect()}
    assert math.isclose(rows["Alta"]["confidence"], 0.4) and rows["Alta"]["critical_trigger_count"] == 0
    assert rows["Media-Alta"]["critical_area_km2"] is None and rows["Media-Alta"]["nlp_report_count"] is None
    assert rows["Alta"]["f"] == ["Pendientes críticas (1.8 km²)"]
    calm = fusion.fuse(topo.withColumn("topo_score", F.lit(0.1)), nlp.limit(0), wx.limit(0))
    assert fusion.score(calm).select(fusion.main_factors()).first()[0] == ["Condiciones normales"]


def test_scores_stay_in_range_and_levels_follow(spark):
    rng = random.Random(2)
    rows = [
        ("z", str(i), rng.uniform(0, 3), 1.0, rng.uniform(0, 3), 1, rng.randint(0, 40), 1,
         rng.uniform(0, 300), rng.uniform(0, 300), rng.uniform(0, 60), rng.uniform(0, 200), 1.0, rng.randint(0, 30))
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, """zone_name string, elevation_band string, topo_score double, critical_area_km2 double,
        nlp_score double, total_risk_mentions int, total_avalanche_mentions int, nlp_report_count int,
        max_snowfall_24h double, max_snowfall_72h double, max_temp_variation double, max_wind_speed double,
        avg_isoterma double, critical_trigger_count int""")
    for r in fusion.score(df).collect():
        total = r["topo_contribution"] + r["weather_contribution"] + r["nlp_contribution"]
        assert math.isclose(r["risk_score"], min(total, 1.0)) and 0 <= r["risk_score"] <= 1
        assert r["eaws_level"] == min(5, 1 + sum(r["risk_score"] >= c for c in (0.2, 0.4, 0.6, 0.8)))
        assert r["weather_score_raw"] <= 1.0 + 1e-12


@pytest.fixture(scope="module")
def history(spark):
    daily = random_series(spark, 77, locations=3, days=25, keep=2.0)
    daily = daily.withColumn("elevation", F.when(F.col("location_name") == "l0", 3300).otherwise(2600).cast("int"))
    rows = weather.features(daily)
    table, triggers = weather.feature_table(rows).cache(), weather.detect_triggers(rows).cache()
    topo = spark.createDataFrame(
        [("l0", "Alta", 0.7, 1.0), ("l1", "Media-Baja", 0.3, 1.0)],
        "zone_name string, elevation_band string, topo_score double, critical_area_km2 double",
    )
    nlp = spark.createDataFrame(
        [("l0", "Media-Alta", 0.4, 3, 2, 4), ("l2", "Baja", 0.1, 1, 0, 1)],
        """zone_name string, elevation_band string, nlp_score double, total_risk_mentions bigint,
        total_avalanche_mentions bigint, nlp_report_count bigint""",
    )
    return table, triggers, topo, nlp


def as_rows(predictions):
    return {
        (r["zone_name"], r["elevation_band"]): (r["prediction_id"], r["eaws_level"], round(r["risk_score"], 9), tuple(r["main_factors"]))
        for r in predictions.collect()
    }


def test_backtest_equals_one_run_per_date(history):
    table, triggers, topo, nlp = history
    past = fusion.backtest(table, triggers, topo, nlp).cache()
    for n in (0, 1, 5, 24):
        day = DAY + dt.timedelta(n)
        fused = fusion.fuse(topo, nlp, fusion.weather_by_band(table, triggers, day))
        single = as_rows(fusion.predictions(fusion.score(fused), day))
        zones = {r[0] for r in table.where(F.col("date") == day).select("location_name").collect()}
        wanted = {k: v for k, v in single.items() if k[0] in zones}
        assert as_rows(past.where(F.col("forecast_date") == day)) == wanted


@pytest.mark.parametrize("days", [1, 2, 30])
def test_backtest_windows_of_any_length(history, days):
    table, triggers, topo, nlp = history
    past = fusion.backtest(table, triggers, topo, nlp, days=days).cache()
    for n in (0, 3, 24):
        day = DAY + dt.timedelta(n)
        fused = fusion.fuse(topo, nlp, fusion.weather_by_band(table, triggers, day, days))
        single = as_rows(fusion.predictions(fusion.score(fused), day))
        zones = {r[0] for r in table.where(F.col("date") == day).select("location_name").collect()}
        assert as_rows(past.where(F.col("forecast_date") == day)) == {k: v for k, v in single.items() if k[0] in zones}


@pytest.mark.parametrize("days", [1, 2, 7, 30])
def test_trailing_by_brute_force(spark, days):
    rng = random.Random(days)
    rows = [(rng.choice("ab"), DAY + dt.timedelta(rng.randrange(-40, 90)), rng.choice([None, rng.uniform(-5, 5)])) for _ in range(150)]
    targets = sorted({(k, DAY + dt.timedelta(n)) for k in "abc" for n in rng.sample(range(-60, 130), 60)})
    values = {"s": ("sum", "v"), "m": ("max", "v"), "n": ("min", "v")}
    df = spark.createDataFrame(rows, "k string, d date, v double")
    asked = spark.createDataFrame([(*t, i) for i, t in enumerate(targets)], "k string, d date, _at int")
    found = lookback.trailing(df, asked, ["k"], "d", days, values)
    assert found.count() == len(targets)
    for row in found.collect():
        inside = [v for k, d, v in rows if k == row.k and row.d - dt.timedelta(days - 1) <= d <= row.d and v is not None]
        if not inside:
            assert (row.s, row.m, row.n) == (None, None, None)
        else:
            assert math.isclose(row.s, sum(inside), abs_tol=1e-9) and (row.m, row.n) == (max(inside), min(inside))
    with pytest.raises(ValueError):
        lookback.trailing(df, asked, ["k"], "d", 0, values)


def test_fusion_of_rows_equals_joins_and_knows_missing_sources(spark, history):
    table, triggers, topo, _ = history
    patterns = spark.createDataFrame(
        [("l0", "Alta", 0.0, 0, 0), ("l0", "Alta", 0.5, 2, 1), ("elsewhere", "Baja", 0.25, 1, 0)],
        "zone_name string, elevation_band string, confidence double, risk_mentions int, avalanche_events int",
    )
    sus = topo.select("zone_name", "elevation_band", F.col("topo_score").alias("susceptibility_score"),
                      F.col("critical_area_km2").alias("critical_slope_area_km2"))
    day = DAY + dt.timedelta(5)
    joined = fusion.fuse(fusion.topo_evidence(sus), text.by_band(patterns), fusion.weather_by_band(table, triggers, day))
    rows = fusion.fuse_rows(sus, patterns, table, triggers, day)
    same = rows.select(*joined.columns)
    assert sorted(map(str, same.collect())) == sorted(map(str, joined.collect()))
    flags = {(r.zone_name, r.elevation_band): (r.has_topo, r.has_nlp, r.has_weather) for r in rows.collect()}
    assert flags["elsewhere", "Baja"] == (False, True, False)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_backtest_of_asked_dates_only(spark, history):
    asked = spark.createDataFrame([("l0", DAY), ("l0", DAY), ("nowhere", DAY)], "zone_name string, forecast_date date")
    rows = as_rows(fusion.backtest(*history, asked))
    assert set(rows) == {("l0", "Media-Alta"), ("l0", "Alta")}


def test_weather_can_cover_all_bands(seeds):
    spread = fusion.zone_weather_to_bands(seeds[2].limit(1))
    assert {r["elevation_band"] for r in spread.collect()} == {"Baja", "Media-Baja", "Media-Alta", "Alta"}


def test_reports_over_predictions(spark, seeds):
    table = fusion.predictions(fusion.score(fusion.fuse(*seeds)), DAY).cache()
    assert {(r["eaws_level"], r["count"]) for r in fusion.danger_distribution(table).collect()} == {(3, 1), (4, 1)}
    assert {r["elevation_band"]: r["max_eaws_level"] for r in fusion.risk_by_band(table).collect()} == {"Media-Alta": 3, "Alta": 4}
    share = fusion.contribution_share(table).first()
    assert math.isclose(share["topo_pct"] + share["weather_pct"] + share["nlp_pct"], 100)
    assert fusion.danger_summary(table).first()[:3] == (2, 2, 2)


def test_bulletin(spark, seeds):
    table = fusion.predictions(fusion.score(fusion.fuse(*seeds)), DAY)
    stamped = table.withColumn("prediction_timestamp", F.lit(dt.datetime(2024, 7, 2)))
    older = stamped.withColumn("prediction_timestamp", F.lit(dt.datetime(2024, 7, 1))).withColumn("eaws_level", F.lit(5))
    record = bulletins.records(bulletins.aggregate(stamped.unionAll(older))).first()
    assert record["eaws_level"] == 4 and record["boletin_id"] == "boletin_20240701_La_Parva"
    assert (record["valid_from"], record["valid_to"]) == (dt.date(2024, 7, 2), dt.date(2024, 7, 3))
    assert record["summary"] == "Nivel 4 - Fuerte para La Parva. Condiciones críticas en Alta, Media-Alta."
    assert record["avalanche_problems"] == ["Nieve reciente", "Placas de viento", "Nieve húmeda", "Terreno crítico"]
    assert record["affected_elevations"] == "Alta, Media-Alta"
    body = record["bulletin_text"]
    assert body.startswith("\nBOLETÍN DE PELIGRO DE AVALANCHAS\nLA PARVA\n\nFecha de emisión: 01/07/2024\n")
    assert "  • Alta           : Nivel 4 - Fuerte\n  • Media-Alta     : Nivel 3 - Notable\n\n" in body
    assert "  1. Pendientes críticas (1.8 km²)\n" in body and "  12. 2 condición(es) gatillante(s)\n" in body
    assert templates.ADVICE[4] in body and "Próxima actualización: 02/07/2024\n" in body
    assert "\n".join([templates.TERRAIN_PROBLEM, templates.SNOW_PROBLEM, templates.WET_PROBLEM, templates.WIND_PROBLEM]) in body
    prompt = bulletins.prompts(bulletins.aggregate(table)).first()["prompt"]
    assert "- Alta: Nivel 4 (Fuerte), Score: 0.65, Factores: Pendientes críticas (1.8 km²), Nevada intensa" in prompt


def test_calm_bulletin(spark):
    table = spark.createDataFrame(
        [("z", DAY, "Baja", 1, "Débil", 0.1, ["Condiciones normales"])],
        """zone_name string, forecast_date date, elevation_band string, eaws_level int, eaws_label string,
        risk_score double, main_factors array<string>""",
    )
    record = bulletins.records(bulletins.aggregate(table)).first()
    assert record["summary"] == "Nivel 1 - Débil para z. Condiciones estables."
    assert record["avalanche_problems"] == ["Condiciones estables"]
    for part in (templates.NO_PROBLEM, "Evaluar según condiciones locales", "Leves o ausentes", "Elevaciones: Todas las elevaciones"):
        assert part in record["bulletin_text"]


def test_validation(spark):
    observed = spark.createDataFrame(
        [(DAY, "z", "Alta", 3), (DAY, "z", "Baja", 3), (DAY, "y", "Alta", 3), (DAY, "x", "Alta", 1)],
        "fecha date, zona string, elevation_band string, nivel_eaws_observado int",
    )
    early, late = dt.datetime(2024, 7, 1), dt.datetime(2024, 7, 2)
    predicted = spark.createDataFrame(
        [(DAY, "z", "Alta", 3, 0.5, 1.0, late), (DAY, "z", "Alta", 1, 0.9, 1.0, early), (DAY, "z", "Baja", 2, 0.3, 1.0, late), (DAY, "y", "Alta", 5, 0.9, 0.6, late)],
        """forecast_date date, zone_name string, elevation_band string, eaws_level int, risk_score double,
        confidence double, prediction_timestamp timestamp""",
    )
    matched = validation.match(observed, predicted).cache()
    found = {(r["zona"], r["elevation_band"]): (r["error"], r["signed_error"], r["acierto"]) for r in matched.collect()}
    assert found == {
        ("z", "Alta"): (0, 0, True), ("z", "Baja"): (1, -1, True), ("y", "Alta"): (2, 2, False), ("x", "Alta"): (None, None, None)
    }
    row = validation.metrics(matched).first()
    assert (row["total"], row["aciertos"], row["mae"], row["unmatched"]) == (3, 2, 1.0, 1)
    assert math.isclose(row["accuracy"], 200 / 3)
    assert {r["error"]: r["count"] for r in validation.error_distribution(matched).collect()} == {0: 1, 1: 1, 2: 1}
    level = validation.by_level(matched).collect()
    assert len(level) == 1 and level[0]["events"] == 3 and math.isclose(level[0]["accuracy"], 200 / 3)


def test_bulletin_text_follows_every_factor(spark):
    factors = [
        "Pendientes críticas (2 km²)", "Nevada intensa (35 cm/24h)", "Nevada acumulada (85 cm/72h)",
        "Fluctuación térmica (15°C)", "Historial de 5 evento(s)", "3 condición(es) gatillante(s)",
        "Viento fuerte (80 km/h)",
    ]
    row = ("z", DAY, "Alta", 4, "Fuerte", 0.7, factors)
    schema = (
        "zone_name string, forecast_date date, elevation_band string, eaws_level int, eaws_label string, "
        "risk_score double, main_factors array<string>"
    )
    record = bulletins.records(bulletins.aggregate(spark.createDataFrame([row], schema))).first()
    assert "Placas de viento" in record["avalanche_problems"]
    assert "Fuerte, con formación de placas" in record["bulletin_text"]
    assert templates.WIND_PROBLEM in record["bulletin_text"]
    assert all(factor in record["bulletin_text"] for factor in factors)
