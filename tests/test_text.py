import math
import re

import pytest
from pyspark.sql import functions as F

from nivo import config, filters, text

SEED = [
    ("001", "Volcán Plomo por Cara Norte",
     "Ascenso con riesgo de avalanchas en pendientes de 35-40 grados sobre 3500m. Cuidado con cornisas. "
     "Realizado en enero con buenas condiciones de nieve.", -33.35, -70.27, 3500),
    ("002", "La Parva - Ruta del Cordón",
     "Zona con historial de aludes en sector este. Pendientes críticas sobre 3000m. Precaución con "
     "acumulación de nieve reciente.", -33.36, -70.28, 3200),
    ("003", "Valle Nevado - Travesía Alta",
     "Hermosa ruta con exposición moderada. Algunos tramos técnicos en pendientes de 30 grados. Recomendado "
     "para montañistas experimentados.", -33.34, -70.26, 3100),
]
SCHEMA = "route_id string, name string, description string, latitude double, longitude double, elevation int"


@pytest.fixture(scope="module")
def reports(spark):
    return spark.createDataFrame(SEED, SCHEMA)


def texts(spark, *values):
    return spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "route_id string, description string")


def test_seed_reports(reports):
    rows = {r["route_id"]: r for r in text.analyse(reports).collect()}
    expected = {
        "001": ((3, 2, 4, 0, 0, 0, 0), 0.38, (35, 40, 115 / 3), "Muy Difícil", "positivo"),
        "002": ((2, 1, 2, 1, 1, 0, 0), 0.25, (None, None, None), "Fácil", "neutral"),
        "003": ((0, 1, 4, 0, 0, 0, 0), 0.16, (30, 30, 30.0), "Moderado", "positivo"),
    }
    for route, (counts, score, slopes, level, mood) in expected.items():
        row = rows[route]
        assert tuple(row[c] for c in config.VOCABULARY) == counts
        assert math.isclose(row["nlp_risk_score"], score)
        assert (row["mentioned_slope_min"], row["mentioned_slope_max"]) == slopes[:2]
        assert row["mentioned_slope_avg"] == slopes[2] or math.isclose(row["mentioned_slope_avg"], slopes[2])
        assert (row["difficulty_level"], row["sentiment"]) == (level, mood)


def test_pattern_table(reports):
    rows = {r["pattern_id"]: r for r in text.patterns(reports).collect()}
    row = rows["nlp_001"]
    assert (row["zone_name"], row["elevation_band"], row["risk_mentions"], row["avalanche_events"]) == ("La Parva", "Alta", 5, 3)
    assert rows["nlp_002"]["elevation_band"] == "Media-Alta" and rows["nlp_003"]["elevation_band"] == "Media-Baja"
    assert {r["pattern_id"] for r in filters.historical_high_risk(text.patterns(reports)).collect()} == {"nlp_001", "nlp_002"}


def test_phrases_count_once_and_inside_words(spark):
    row = text.mention_counts(texts(spark, "SALUDO alud alud ALUDES", None, "")).orderBy("route_id").collect()
    assert [r["avalanche_mentions"] for r in row] == [2, 0, 0]
    assert text.risk_score(text.mention_counts(texts(spark, None))).first()["nlp_risk_score"] == 0.0


def test_custom_vocabulary(spark):
    row = text.mention_counts(texts(spark, "hielo y roca"), vocab={"ice": ("hielo", "verglas")}).first()
    assert row["ice"] == 1


@pytest.mark.parametrize(
    ("body", "plain", "strict"),
    [
        ("3500 grados", (0, 0, 0.0), None),
        ("a 95° y 40°", (40, 40, 40.0), (40, 40, 40.0)),
        ("30 - 45 grados", (30, 45, 40.0), (30, 45, 40.0)),
        ("INCLINACIÓN de 50", (50, 50, 50.0), (50, 50, 50.0)),
        ("Pendiente  de 40 grados", (40, 40, 40.0), (40, 40, 40.0)),
        ("pendiente de 42 degrees", (42, 42, 42.0), (42, 42, 42.0)),
        ("GRADOS 35", None, None),
    ],
)
def test_slope_values(spark, body, plain, strict):
    names = ["mentioned_slope_min", "mentioned_slope_max", "mentioned_slope_avg"]
    for flag, expected in ((False, plain), (True, strict)):
        row = text.slope_mentions(texts(spark, body), strict=flag).select(*names).first()
        assert tuple(row) == (expected or (None, None, None))


def test_slope_values_equal_a_brute_force_scan(spark):
    patterns = [
        r"(\d{1,2})\s*(?:grados|°|degrees)", r"pendiente\s+de\s+(\d{1,2})",
        r"(\d{1,2})\s*-\s*(\d{1,2})\s*(?:grados|°)", r"inclinación\s+de\s+(\d{1,2})",
    ]
    bodies = [
        f"{a}-{b} grados; pendiente de {c}; Inclinación  de {a}; {b} °, 1{c}{a} degrees {a} - {c}-{b}°"
        for a in (5, 30, 91) for b in (0, 45) for c in (7, 88)
    ]
    rows = text.slope_mentions(texts(spark, *bodies)).collect()
    for row in rows:
        found = []
        for p in patterns:
            for m in re.findall(p, row["description"], re.IGNORECASE):
                found += [int(x) for x in (m if isinstance(m, tuple) else (m,))]
        found = [v for v in found if 0 <= v <= 90]
        assert (row["mentioned_slope_min"], row["mentioned_slope_max"]) == (min(found), max(found))
        assert math.isclose(row["mentioned_slope_avg"], sum(found) / len(found))


def test_sentiment_ties_and_nulls(spark):
    df = texts(spark, "excelente y hermoso", "malo", "bueno pero malo", None)
    moods = [r[0] for r in df.orderBy("route_id").select(text.sentiment(F.col("description"))).collect()]
    assert moods == ["positivo", "negativo", "neutral", "neutral"]


def test_difficulty_ignores_missing_slopes(spark):
    rows = [(0.7, None, 0), (0.5, None, 0), (0.0, 35, 0), (0.3, None, 0), (0.1, None, 0), (0.0, None, 1), (0.0, None, 0)]
    df = spark.createDataFrame(rows, "nlp_risk_score double, mentioned_slope_max int, severity_high_count int")
    assert [r[0] for r in df.select(text.difficulty()).collect()] == [
        "Muy Difícil", "Difícil", "Difícil", "Moderado", "Fácil", "Muy Difícil", "Muy Fácil"
    ]


def test_summaries(spark, reports):
    table = text.patterns(reports)
    row = text.summary(table).first()
    assert (row["total_reports"], row["high_risk_reports"], row["total_avalanche_mentions"]) == (3, 2, 5)
    assert math.isclose(row["avg_risk_score"], (0.38 + 0.25 + 0.16) / 3)
    # Three levels, one report each: the first by name.
    assert row["most_common_difficulty"] == "Fácil"
    assert tuple(text.summary(table.limit(0)).first())[:4] == (0, 0, 0.0, 0)
    band = {r["elevation_band"]: r for r in text.by_band(table).collect()}["Alta"]
    assert (band["total_risk_mentions"], band["nlp_report_count"]) == (5, 1)
    assert {r["sentiment"]: r["count"] for r in text.by_sentiment(table).collect()} == {"positivo": 2, "neutral": 1}


def test_no_python_in_the_plan(spark, reports):
    plan = text.patterns(reports)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_parts_are_shared_and_lose_no_phrase():
    phrases = [p for listed in config.VOCABULARY.values() for p in listed] + ["x", "ab", "abx"]
    groups = text.shared_parts(tuple(phrases))
    assert sorted(p for _, held in groups for p in held) == sorted(set(phrases))
    assert all(part in p for part, held in groups for p in held) and len(groups) < 0.7 * len(set(phrases))


def test_overlapping_phrases_by_brute_force(spark):
    phrases = ["aba", "ab", "bab", "abab", "b a", "ñu", "muy alto", "alto", "x"]
    values = ["ababab", "b ab", "MUY ALTO ñu", "ÑU muy  alto", "", "b", "xxbabx"]
    found = texts(spark, *values).select("description", text.phrases_in(F.lower("description"), phrases).alias("f"))
    for row in found.collect():
        assert sorted(row.f) == sorted(p for p in phrases if p in row.description.lower())
