"""The registered queries in DuckDB SQL, over the raw test tables.

Each text starts from the same derivations as ``testdata`` and states the result its own
way (self-joins for grid neighbours, unions for triggers, full joins for the backtest).
"""

from __future__ import annotations

from string import Formatter

from nivo import config
from nivo.functions import templates
from nivo.operators.text import _BLANK, SLOPE_PATTERNS

BAND_OPEN = """CASE WHEN {0} < 2500 THEN 'Baja' WHEN {0} < 3200 THEN 'Media-Baja'
    WHEN {0} < 3500 THEN 'Media-Alta' ELSE 'Alta' END"""
BAND_INSIDE = """CASE WHEN {0} >= 0 AND {0} < 2500 THEN 'Baja' WHEN {0} >= 2500 AND {0} < 3200 THEN 'Media-Baja'
    WHEN {0} >= 3200 AND {0} < 3500 THEN 'Media-Alta' WHEN {0} >= 3500 AND {0} < 6000 THEN 'Alta'"""
BAND_NULL = BAND_INSIDE + " END"
BAND_LAST = BAND_INSIDE + " ELSE 'Alta' END"
CATEGORY = """CASE WHEN {0} >= 0.8 THEN 'Muy Alto' WHEN {0} >= 0.6 THEN 'Alto' WHEN {0} >= 0.4 THEN 'Moderado'
    WHEN {0} >= 0.2 THEN 'Bajo' ELSE 'Muy Bajo' END"""
ASPECT = """CASE WHEN {0} < 45 THEN 'Norte' WHEN {0} < 135 THEN 'Este' WHEN {0} < 225 THEN 'Sur'
    WHEN {0} < 315 THEN 'Oeste' ELSE 'Norte' END"""


def _attribute(level: str, name: str) -> str:
    return f"CASE {level} " + " ".join(f"WHEN {r['level']} THEN '{r[name]}'" for r in config.DANGER_SCALE) + " END"


def _key(*parts: str, length: int = 12) -> str:
    return "substr(sha256(" + " || '~' || ".join(f"({p})::VARCHAR" for p in parts) + f"), 1, {length})"


# --- Common table expressions ------------------------------------------------------------

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def _weather(user: str) -> str:
    return f"""SELECT 'loc_' || {user} AS location_name,
       CAST(2000 + 100 * (user_id % 20) AS INTEGER) AS elevation,
       CAST(ts AS DATE) AS date,
       avg(value) FILTER (event_type = 'view') AS snowfall_sum,
       avg(value) FILTER (event_type = 'purchase') / 3 AS precipitation_sum,
       avg(value) FILTER (event_type = 'click') / 4 - 2::DOUBLE AS temperature_2m_max,
       -avg(value) FILTER (event_type = 'signup') / 4 AS temperature_2m_min,
       (avg(value) FILTER (event_type = 'click') / 4 - 2::DOUBLE
        - avg(value) FILTER (event_type = 'signup') / 4) / 2 AS temperature_2m_mean,
       avg(value) FILTER (event_type = 'error') AS windspeed_10m_max
FROM events GROUP BY 1, 2, 3"""


CTES["weather_daily"] = (), _weather("(user_id % 20)")
CTES["weather_user"] = (), _weather("user_id")

CTES["cells"] = (), """SELECT 'zone_' || (p_partkey // 2000) AS zone_name,
       CAST((p_partkey % 2000) // 40 AS INTEGER) AS "row",
       CAST(p_partkey % 40 AS INTEGER) AS col,
       -33.40::DOUBLE + 0.0006::DOUBLE * ((p_partkey % 2000) // 40) AS latitude,
       -70.32::DOUBLE + 0.0006::DOUBLE * (p_partkey % 40) AS longitude,
       1900::DOUBLE + 34::DOUBLE * ((p_partkey % 2000) // 40) + 1.5::DOUBLE * p_size AS elevation,
       60::DOUBLE AS scale
FROM part"""

CTES["reports"] = (), """SELECT CAST(doc_id AS VARCHAR) AS route_id,
       text || CASE doc_id % 6
         WHEN 0 THEN ' Pendiente de ' || (doc_id % 70) || '° con riesgo de alud.'
         WHEN 1 THEN ' Tramos de ' || (30 + doc_id % 10) || '-' || (40 + doc_id % 9) || ' grados, cuidado con cornisas.'
         WHEN 2 THEN ' INCLINACIÓN de ' || (doc_id % 60) || ', muy peligroso, evitar.'
         WHEN 3 THEN ' Ruta hermosa y recomendable, fácil.'
         WHEN 4 THEN ' Historial de avalancha tras nieve reciente y viento a 3500 grados.'
         ELSE '' END AS description,
       -33.445::DOUBLE + 0.01::DOUBLE * (doc_id % 20) AS latitude,
       -70.365::DOUBLE + 0.01::DOUBLE * (doc_id % 20) AS longitude,
       CAST(2000 + doc_id % 2000 AS INTEGER) AS elevation,
       'loc_' || (doc_id % 20) AS zone_name
FROM documents"""

CTES["observed"] = (), f"""SELECT CAST(ts AS DATE) AS fecha, 'loc_' || (user_id % 20) AS zona,
       {BAND_OPEN.format("(2000 + 100 * (user_id % 20))")} AS elevation_band,
       CAST(max(1 + event_id % 5) AS INTEGER) AS nivel_eaws_observado
FROM events WHERE event_type = 'error' AND value >= 150 GROUP BY 1, 2, 3"""


def _features(source: str, frame: str) -> str:
    def snow(days: int) -> str:
        if frame == "rows":
            reach = f"ROWS BETWEEN {days - 1} PRECEDING AND CURRENT ROW"
        else:
            reach = f"RANGE BETWEEN INTERVAL {days - 1} DAY PRECEDING AND CURRENT ROW"
        return f"sum(snowfall_sum) OVER (PARTITION BY location_name ORDER BY date {reach})"

    previous = (
        "lag(temperature_2m_min) OVER (PARTITION BY location_name ORDER BY date)"
        if frame == "rows"
        else """max(temperature_2m_min) OVER (PARTITION BY location_name ORDER BY date
                RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)"""
    )
    return f"""SELECT *, snowfall_sum AS snowfall_24h, {snow(2)} AS snowfall_48h, {snow(3)} AS snowfall_72h,
       {snow(7)} AS snowfall_7d, abs(temperature_2m_max - temperature_2m_min) AS temp_variation_24h,
       abs(temperature_2m_max - {previous}) AS temp_variation_48h,
       CAST(trunc(CASE WHEN temperature_2m_mean > 0 THEN elevation + temperature_2m_mean / 0.0065::DOUBLE
            ELSE elevation END) AS INTEGER) AS isoterma_0c,
       CASE WHEN precipitation_sum < 5 THEN 'Baja' WHEN precipitation_sum < 15 THEN 'Moderada'
            WHEN precipitation_sum < 30 THEN 'Alta' ELSE 'Muy Alta' END AS precipitation_intensity,
       {BAND_OPEN.format("elevation")} AS elevation_band
FROM {source}"""


CTES["features"] = ("weather_daily",), _features("weather_daily", "rows")
CTES["features_user"] = ("weather_user",), _features("weather_user", "rows")
CTES["features_range"] = ("weather_user",), _features("weather_user", "range")


def _triggers(source: str) -> str:
    rules = [
        ("Nevada Intensa 24h", "snowfall_24h", """CASE WHEN snowfall_24h >= 80 THEN 'Extremo'
            WHEN snowfall_24h >= 50 THEN 'Alto' WHEN snowfall_24h >= 30 THEN 'Moderado'
            WHEN snowfall_24h >= 10 THEN 'Bajo' END"""),
        ("Nevada Acumulada 72h", "snowfall_72h", """CASE WHEN snowfall_72h >= 80 THEN 'Crítico'
            WHEN snowfall_72h >= 50 THEN 'Alto' WHEN snowfall_72h >= 30 THEN 'Moderado' END"""),
        ("Fluctuación Térmica", "temp_variation_24h", """CASE WHEN temp_variation_24h >= 15 THEN 'Alto'
            WHEN temp_variation_24h >= 10 THEN 'Moderado' WHEN temp_variation_24h >= 5 THEN 'Bajo' END"""),
        ("Viento Fuerte", "windspeed_10m_max", """CASE WHEN windspeed_10m_max >= 70 THEN 'Alto'
            WHEN windspeed_10m_max >= 50 THEN 'Moderado' WHEN windspeed_10m_max >= 30 THEN 'Bajo' END"""),
        ("Isoterma Crítica", "isoterma_0c",
         "CASE WHEN isoterma_0c > 3000 AND isoterma_0c < 4000 THEN 'Zona Crítica' END"),
        ("Lluvia sobre Nieve", "precipitation_sum", """CASE WHEN precipitation_sum > 10
            AND temperature_2m_mean > 0 AND temperature_2m_mean < 5 THEN 'Detectado' END"""),
    ]
    union = " UNION ALL ".join(
        f"""SELECT location_name, date, elevation_band, '{kind}' AS trigger_type, {severity} AS trigger_severity,
        CAST({value} AS DOUBLE) AS trigger_value FROM {source}"""
        for kind, value, severity in rules
    )
    key = _key("location_name", "date", "trigger_type", length=8)
    return f"""SELECT 'trigger_' || {key} AS trigger_id, *,
       trigger_severity IN ('Extremo', 'Crítico', 'Alto') AS is_critical
FROM ({union}) WHERE trigger_severity IS NOT NULL"""


CTES["triggers"] = ("features",), _triggers("features")
CTES["triggers_user"] = ("features_user",), _triggers("features_user")


def _gradients(source: str, spacing: str = "60::DOUBLE", step: str = "1") -> str:
    def neighbour(alias: str, row: str, col: str) -> str:
        return f"""LEFT JOIN {source} {alias} ON {alias}.zone_name = c.zone_name
            AND {alias}."row" = c."row" {row} AND {alias}.col = c.col {col}"""

    def difference(before: str, after: str) -> str:
        return f"""CASE WHEN {before}.elevation IS NOT NULL AND {after}.elevation IS NOT NULL
             THEN ({after}.elevation - {before}.elevation) / ({spacing} * 2)
             WHEN {after}.elevation IS NOT NULL THEN ({after}.elevation - c.elevation) / {spacing}
             WHEN {before}.elevation IS NOT NULL THEN (c.elevation - {before}.elevation) / {spacing} END"""

    joins = "\n".join(
        neighbour(a, r, c)
        for a, r, c in (("w", "", f"- {step}"), ("e", "", f"+ {step}"), ("s", f"- {step}", ""), ("n", f"+ {step}", ""))
    )
    return f"""SELECT c.*, {difference("w", "e")} AS dzdx, {difference("s", "n")} AS dzdy
FROM {source} c {joins}"""


def _slope_aspect(source: str, north: str = "dzdy") -> str:
    return f"""SELECT *, degrees(atan(sqrt(dzdx * dzdx + dzdy * dzdy))) AS slope_degrees,
       CASE WHEN dzdx = 0 AND dzdy = 0 THEN 0::DOUBLE
            ELSE (degrees(atan2(-dzdx, {north})) + 360) % 360 END AS aspect_degrees
FROM {source}"""


CTES["gradients"] = ("cells",), _gradients("cells")
CTES["slopes"] = ("gradients",), _slope_aspect("gradients")
CTES["masked"] = ("cells",), """SELECT * FROM cells WHERE latitude BETWEEN -33.40::DOUBLE AND -33.37::DOUBLE
    AND longitude BETWEEN -70.32::DOUBLE AND -70.296::DOUBLE AND elevation >= 2000"""
CTES["masked_gradients"] = ("masked",), _gradients("masked")
CTES["masked_slopes"] = ("masked_gradients",), _slope_aspect("masked_gradients")
CTES["thinned"] = ("cells",), """SELECT zone_name, CAST(floor("row" / 2) AS INTEGER) AS "row",
    CAST(floor(col / 2) AS INTEGER) AS col, avg(latitude) AS latitude, avg(longitude) AS longitude,
    avg(elevation) AS elevation, 120::DOUBLE AS scale, CAST(count(*) AS BIGINT) AS n_cells
FROM cells GROUP BY 1, 2, 3"""
CTES["thinned_gradients"] = ("thinned",), _gradients("thinned", "120::DOUBLE")
CTES["thinned_slopes"] = ("thinned_gradients",), _slope_aspect("thinned_gradients")

_EIGHT = {"sw": (-1, -1), "s": (-1, 0), "se": (-1, 1), "w": (0, -1), "e": (0, 1), "nw": (1, -1), "n": (1, 0), "ne": (1, 1)}
CTES["horn_gradients"] = ("cells", "gradients"), (
    """SELECT c.* EXCLUDE (dzdx, dzdy),
    coalesce((ne.elevation + 2 * e.elevation + se.elevation - nw.elevation - 2 * w.elevation - sw.elevation)
        / 480 + 0 * (n.elevation + s.elevation), c.dzdx) AS dzdx,
    coalesce((nw.elevation + 2 * n.elevation + ne.elevation - sw.elevation - 2 * s.elevation - se.elevation)
        / 480 + 0 * (w.elevation + e.elevation), c.dzdy) AS dzdy
FROM gradients c """
    + " ".join(
        f"""LEFT JOIN cells {a} ON {a}.zone_name = c.zone_name AND {a}."row" = c."row" + ({r}) AND {a}.col = c.col + ({k})"""
        for a, (r, k) in _EIGHT.items()
    )
)
CTES["horn_slopes"] = ("horn_gradients",), _slope_aspect("horn_gradients", "-dzdy")


def _cell_features(source: str, prefix: str, band: str, zone: str = "zone_name", grid: str = "zone_name") -> str:
    return f"""SELECT '{prefix}_' || {_key(zone, '"row"', "col")} AS feature_id, latitude, longitude,
       CAST(trunc(elevation) AS INTEGER) AS elevation, slope_degrees, aspect_degrees,
       {band.format("elevation")} AS elevation_band,
       coalesce(slope_degrees BETWEEN 30 AND 45, false) AS is_critical_slope, {zone} AS zone_name,
       scale AS gee_scale,
       CASE WHEN elevation IS NULL THEN 0::DOUBLE WHEN elevation < 0 OR slope_degrees > 90 OR aspect_degrees > 360
            THEN 0.5::DOUBLE ELSE 1::DOUBLE END AS gee_quality_flag
FROM {source}"""


def _band_stats(source: str, by: str = "zone_name, elevation_band", aspect: str = "avg(aspect_degrees)") -> str:
    return f"""SELECT {by}, count(*) AS total_pixels, count(*) FILTER (is_critical_slope) AS critical_pixels,
       avg(slope_degrees) AS avg_slope_degrees, avg(elevation) AS avg_elevation, {aspect} AS avg_aspect_degrees,
       stddev_samp(slope_degrees) AS stddev_slope, min(slope_degrees) AS min_slope, max(slope_degrees) AS max_slope,
       min(elevation) AS min_elevation, max(elevation) AS max_elevation,
       avg(gee_quality_flag) AS avg_gee_quality, avg(gee_scale) AS avg_gee_scale
FROM {source} GROUP BY {by}"""


def _susceptibility(stats: str, score: str, cell_m2: str) -> str:
    return f"""SELECT 'zone_' || replace(zone_name, ' ', '_') || '_' || replace(elevation_band, ' ', '_') AS zone_id, *,
       CASE WHEN score > 1 THEN 1::DOUBLE ELSE score END AS susceptibility_score,
       total_pixels * {cell_m2} / 1000000::DOUBLE AS total_area_km2,
       critical_pixels * {cell_m2} / 1000000::DOUBLE AS critical_slope_area_km2,
       {ASPECT.format("avg_aspect_degrees")} AS dominant_aspect
FROM (SELECT *, {score} AS score FROM {stats})"""


_RATIO = "(critical_pixels / total_pixels::DOUBLE)"
SCORE_V1 = f"""0.6::DOUBLE * {_RATIO} + 0.3::DOUBLE * (avg_slope_degrees / 60)
    + 0.1::DOUBLE * (coalesce(stddev_slope, 0) / 30)"""
SCORE_V2 = f"""0.5::DOUBLE * {_RATIO} + 0.3::DOUBLE * (avg_slope_degrees / 60)
    + 0.15::DOUBLE * (coalesce(stddev_slope, 0) / 30) + 0.05::DOUBLE * avg_gee_quality"""

CTES["cells_v1"] = ("slopes",), _cell_features("slopes", "topo", BAND_NULL)
CTES["cells_v2"] = ("slopes",), _cell_features("slopes", "gee", BAND_LAST)
CTES["stats_v1"] = ("cells_v1",), _band_stats("cells_v1")
CTES["stats_v2"] = ("cells_v2",), _band_stats("cells_v2")
CTES["susceptibility"] = ("stats_v1",), _susceptibility("stats_v1", SCORE_V1, "900")
CTES["susceptibility_2"] = ("stats_v2",), _susceptibility("stats_v2", SCORE_V2, "avg_gee_scale * avg_gee_scale")
CTES["cells_zoned"] = ("slopes",), _cell_features("slopes", "topo", BAND_NULL, "'loc_' || (\"row\" % 20)")
CTES["stats_zoned"] = ("cells_zoned",), _band_stats("cells_zoned")
CTES["susceptibility_zoned"] = ("stats_zoned",), _susceptibility("stats_zoned", SCORE_V1, "900")
CTES["topo"] = ("susceptibility_zoned",), """SELECT zone_name, elevation_band, susceptibility_score AS topo_score,
    critical_slope_area_km2 AS critical_area_km2 FROM susceptibility_zoned"""
CTES["map_v1"] = ("cells_v1", "susceptibility"), f"""SELECT 'grid_' || substr(feature_id, 6, 12) AS grid_id, c.zone_name,
    latitude, longitude, elevation, c.elevation_band, slope_degrees, aspect_degrees, susceptibility_score,
    {CATEGORY.format("susceptibility_score")} AS risk_category
FROM cells_v1 c LEFT JOIN susceptibility s ON s.zone_name = c.zone_name AND s.elevation_band = c.elevation_band"""


def _present(phrases, text: str = "t") -> str:
    return " + ".join(f"contains({text}, '{p}')::INTEGER" for p in phrases)


CTES["mentions"] = ("reports",), (
    "SELECT *, "
    + ", ".join(f"{_present(p)} AS {name}" for name, p in config.VOCABULARY.items())
    + f", {_present(config.POSITIVE_WORDS)} AS good, {_present(config.NEGATIVE_WORDS)} AS bad"
    + " FROM (SELECT *, lower(coalesce(description, '')) AS t FROM reports)"
)
CTES["text_scores"] = ("mentions",), """SELECT *, least(1::DOUBLE, (avalanche_mentions * 0.3::DOUBLE
    + risk_mentions * 0.2::DOUBLE + slope_mentions * 0.15::DOUBLE + weather_trigger_mentions * 0.15::DOUBLE
    + severity_high_count * 0.15::DOUBLE + severity_moderate_count * 0.05::DOUBLE) / 5) AS nlp_risk_score,
    CASE WHEN good > bad THEN 'positivo' WHEN bad > good THEN 'negativo' ELSE 'neutral' END AS sentiment
FROM mentions"""


def _slopes_in_text(strict: bool) -> str:
    found = []
    for pattern, groups in SLOPE_PATTERNS:
        if strict and pattern.startswith("("):
            pattern = r"(?:^|\D)" + pattern
        pattern = "(?i)" + pattern.replace(r"\s", _BLANK)
        found += [f"regexp_extract_all(description, '{pattern}', {g})" for g in groups]
    values = " || ".join(found)
    return f"""SELECT *, CASE WHEN len(v) > 0 THEN list_min(v) END AS mentioned_slope_min,
       CASE WHEN len(v) > 0 THEN list_max(v) END AS mentioned_slope_max,
       CASE WHEN len(v) > 0 THEN list_sum(v) / len(v)::DOUBLE END AS mentioned_slope_avg
FROM (SELECT *, [x FOR x IN CAST({values} AS INTEGER[]) IF x BETWEEN 0 AND 90] AS v FROM text_scores)"""


CTES["text_slopes"] = ("text_scores",), _slopes_in_text(False)
CTES["text_slopes_strict"] = ("text_scores",), _slopes_in_text(True)
CTES["patterns"] = ("text_slopes",), f"""SELECT 'nlp_' || route_id AS pattern_id, route_id, zone_name, latitude, longitude,
    elevation, {BAND_OPEN.format("elevation")} AS elevation_band,
    CAST(avalanche_mentions + risk_mentions AS INTEGER) AS risk_mentions,
    CAST(avalanche_mentions AS INTEGER) AS avalanche_events,
    CASE WHEN nlp_risk_score >= 0.7 OR mentioned_slope_max >= 40 OR severity_high_count > 0 THEN 'Muy Difícil'
         WHEN nlp_risk_score >= 0.5 OR mentioned_slope_max >= 35 THEN 'Difícil'
         WHEN nlp_risk_score >= 0.3 OR mentioned_slope_max >= 30 THEN 'Moderado'
         WHEN nlp_risk_score >= 0.1 THEN 'Fácil' ELSE 'Muy Fácil' END AS difficulty_level,
    sentiment, nlp_risk_score AS confidence, '{config.REPORT_SOURCE}' AS source
FROM text_slopes"""
CTES["nlp"] = ("patterns",), """SELECT zone_name, elevation_band, avg(confidence) AS nlp_score,
    sum(risk_mentions)::BIGINT AS total_risk_mentions, sum(avalanche_events)::BIGINT AS total_avalanche_mentions,
    count(*) AS nlp_report_count FROM patterns GROUP BY 1, 2"""

_WEATHER_AGG = """max(snowfall_24h) AS max_snowfall_24h, max(snowfall_72h) AS max_snowfall_72h,
    max(temp_variation_24h) AS max_temp_variation, max(windspeed_10m_max) AS max_wind_speed,
    avg(isoterma_0c) AS avg_isoterma"""
CTES["band_weather"] = ("features", "triggers"), f"""SELECT w.*, coalesce(n, 0)::BIGINT AS critical_trigger_count
FROM (SELECT location_name AS zone_name, elevation_band, {_WEATHER_AGG} FROM features
      WHERE date >= (SELECT max(date) FROM features) - 2 GROUP BY 1, 2) w
LEFT JOIN (SELECT location_name AS zone_name, elevation_band, count(*) AS n FROM triggers
      WHERE is_critical AND date >= (SELECT max(date) FROM features) - 2 GROUP BY 1, 2)
USING (zone_name, elevation_band)"""


def _fused(joins: str, keys: str) -> str:
    return f"""SELECT {keys}, coalesce(topo_score, 0) AS topo_score, critical_area_km2, coalesce(nlp_score, 0) AS nlp_score,
    coalesce(total_risk_mentions, 0)::BIGINT AS total_risk_mentions,
    coalesce(total_avalanche_mentions, 0)::BIGINT AS total_avalanche_mentions, nlp_report_count,
    coalesce(max_snowfall_24h, 0) AS max_snowfall_24h, coalesce(max_snowfall_72h, 0) AS max_snowfall_72h,
    coalesce(max_temp_variation, 0) AS max_temp_variation, coalesce(max_wind_speed, 0) AS max_wind_speed,
    avg_isoterma, coalesce(critical_trigger_count, 0)::BIGINT AS critical_trigger_count
FROM {joins}"""


def _scored(source: str) -> str:
    return f"""SELECT *, {_attribute("eaws_level", "label")} AS eaws_label
FROM (SELECT *, CASE WHEN risk_score < 0.2 THEN 1 WHEN risk_score < 0.4 THEN 2 WHEN risk_score < 0.6 THEN 3
        WHEN risk_score < 0.8 THEN 4 ELSE 5 END AS eaws_level,
    CASE WHEN topo_score > 0 THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN weather_score_raw > 0 THEN 0.4::DOUBLE ELSE 0 END
        + CASE WHEN nlp_score > 0 THEN 0.2::DOUBLE ELSE 0 END AS confidence,
    [f FOR f IN [
        CASE WHEN topo_score >= 0.6 THEN 'Pendientes críticas (' || printf('%.1f', critical_area_km2) || ' km²)' END,
        CASE WHEN max_snowfall_24h >= 30 THEN 'Nevada intensa (' || printf('%.0f', max_snowfall_24h) || ' cm/24h)' END,
        CASE WHEN max_snowfall_72h >= 50 THEN 'Nevada acumulada (' || printf('%.0f', max_snowfall_72h) || ' cm/72h)' END,
        CASE WHEN max_temp_variation >= 10 THEN 'Fluctuación térmica (' || printf('%.0f', max_temp_variation) || '°C)' END,
        CASE WHEN max_wind_speed >= 50 THEN 'Viento fuerte (' || printf('%.0f', max_wind_speed) || ' km/h)' END,
        CASE WHEN total_avalanche_mentions > 0 THEN 'Historial de ' || total_avalanche_mentions || ' evento(s)' END,
        CASE WHEN critical_trigger_count > 0 THEN critical_trigger_count || ' condición(es) gatillante(s)' END
    ] IF f IS NOT NULL] AS found
FROM (SELECT *, greatest(0::DOUBLE, least(1::DOUBLE, topo_contribution + weather_contribution + nlp_contribution)) AS risk_score
FROM (SELECT *, topo_score * 0.35::DOUBLE AS topo_contribution, weather_score_raw * 0.45::DOUBLE AS weather_contribution,
    nlp_score_adjusted * 0.2::DOUBLE AS nlp_contribution
FROM (SELECT *, least(max_snowfall_24h / 80, 1::DOUBLE) * 0.3::DOUBLE + least(max_snowfall_72h / 120, 1::DOUBLE) * 0.25::DOUBLE
        + least(max_temp_variation / 20, 1::DOUBLE) * 0.2::DOUBLE + least(max_wind_speed / 90, 1::DOUBLE) * 0.15::DOUBLE
        + least(critical_trigger_count * 0.1::DOUBLE, 1::DOUBLE) * 0.1::DOUBLE AS weather_score_raw,
    nlp_score * 0.6::DOUBLE + least(total_avalanche_mentions / 10::DOUBLE, 1::DOUBLE) * 0.4::DOUBLE AS nlp_score_adjusted
FROM {source}))))"""


_FACTORS = "CASE WHEN len(found) > 0 THEN found ELSE ['Condiciones normales'] END"


def _predictions(source: str) -> str:
    return f"""SELECT 'pred_' || strftime(forecast_date, '%Y%m%d') || '_' || replace(zone_name, ' ', '_') || '_'
    || replace(elevation_band, ' ', '_') AS prediction_id, zone_name, forecast_date, elevation_band,
    eaws_level, eaws_label, risk_score, confidence, topo_contribution, weather_contribution, nlp_contribution,
    {_FACTORS} AS main_factors FROM {source}"""


_ZB, _ZDB = "zone_name, elevation_band", "zone_name, forecast_date, elevation_band"
CTES["fused"] = ("topo", "nlp", "band_weather"), _fused(
    f"topo FULL JOIN nlp USING ({_ZB}) FULL JOIN band_weather USING ({_ZB})", _ZB
)
CTES["scored"] = ("fused",), _scored("fused")
CTES["predictions"] = ("scored", "features"), _predictions(
    "(SELECT *, (SELECT max(date) FROM features) AS forecast_date FROM scored)"
)
CTES["asked"] = ("features",), "SELECT DISTINCT location_name AS zone_name, date AS forecast_date FROM features"
CTES["dated_weather"] = ("asked", "features", "triggers"), f"""SELECT a.zone_name, a.forecast_date, f.elevation_band,
    {_WEATHER_AGG}, coalesce(sum(n), 0)::BIGINT AS critical_trigger_count
FROM asked a JOIN features f ON f.location_name = a.zone_name AND f.date BETWEEN a.forecast_date - 2 AND a.forecast_date
LEFT JOIN (SELECT location_name, date, count(*) AS n FROM triggers WHERE is_critical GROUP BY 1, 2) t
    ON t.location_name = f.location_name AND t.date = f.date
GROUP BY 1, 2, 3"""
CTES["dated_fused"] = ("asked", "dated_weather", "topo", "nlp"), _fused(
    f"""(SELECT * FROM asked JOIN topo USING (zone_name))
    FULL JOIN (SELECT * FROM asked JOIN nlp USING (zone_name)) USING ({_ZDB})
    FULL JOIN dated_weather USING ({_ZDB})""",
    _ZDB,
)
CTES["dated_scored"] = ("dated_fused",), _scored("dated_fused")
CTES["backtest"] = ("dated_scored",), _predictions("dated_scored")
CTES["matched"] = ("observed", "backtest"), """SELECT fecha, zona, o.elevation_band, nivel_eaws_observado AS nivel_observado,
    eaws_level AS nivel_predicho, abs(eaws_level - nivel_eaws_observado) AS error,
    eaws_level - nivel_eaws_observado AS signed_error, abs(eaws_level - nivel_eaws_observado) <= 1 AS acierto,
    risk_score, confidence
FROM observed o LEFT JOIN backtest p ON p.forecast_date = fecha AND p.zone_name = zona AND p.elevation_band = o.elevation_band"""

# Bulletins: bands ranked by falling score, factors in the order they are first seen.
CTES["ranked"] = ("backtest",), """SELECT *, row_number() OVER (PARTITION BY zone_name, forecast_date
    ORDER BY risk_score DESC, elevation_band DESC) AS place FROM backtest"""
CTES["factor_lists"] = ("ranked",), """SELECT zone_name, forecast_date, list(factor ORDER BY seen) AS factors
FROM (SELECT zone_name, forecast_date, factor, min(seen) AS seen
      FROM (SELECT zone_name, forecast_date, unnest(main_factors) AS factor,
                   place * 100 + unnest(range(len(main_factors))) AS seen FROM ranked)
      GROUP BY 1, 2, 3) GROUP BY 1, 2"""


def _factor_like(*parts: str, source: str = "factors", lower: bool = True) -> str:
    text = "lower(f)" if lower else "f"
    tests = " OR ".join(f"contains({text}, '{p}')" for p in parts)
    return f"len([f FOR f IN {source} IF {tests}]) > 0"


CTES["bulletins"] = ("ranked", "factor_lists"), f"""SELECT *,
    'Nivel ' || eaws_level || ' - ' || eaws_label || ' para ' || zone_name || '. '
        || CASE WHEN risky <> '' THEN 'Condiciones críticas en ' || risky || '.' ELSE 'Condiciones estables.' END AS summary,
    {_attribute("eaws_level", "description")} AS danger_description,
    [p FOR p IN [CASE WHEN {_factor_like("nevada", "nieve reciente")} THEN 'Nieve reciente' END,
        CASE WHEN {_factor_like("viento")} THEN 'Placas de viento' END,
        CASE WHEN {_factor_like("térmica", "temperatura", "fluctuación")} THEN 'Nieve húmeda' END,
        CASE WHEN {_factor_like("pendiente")} THEN 'Terreno crítico' END] IF p IS NOT NULL] AS tags,
    CASE WHEN risky <> '' THEN risky ELSE 'Todas las elevaciones' END AS affected_elevations,
    {_attribute("eaws_level", "recommendations")} AS recommendations,
    issue_date + 1 AS valid_from, issue_date + 2 AS valid_to, factors AS five
FROM (SELECT *, {_attribute("eaws_level", "label")} AS eaws_label
FROM (SELECT zone_name, forecast_date AS issue_date, max(eaws_level) AS eaws_level,
        coalesce(string_agg(elevation_band, ', ' ORDER BY place) FILTER (eaws_level >= 3), '') AS risky,
        coalesce(string_agg(elevation_band, '; ' ORDER BY place) FILTER (eaws_level >= 3), '') AS high_risk_bands,
        list(elevation_band ORDER BY place) AS names,
        string_agg('  • ' || rpad(elevation_band, 15, ' ') || ': Nivel ' || eaws_level || ' - ' || eaws_label
            || chr(10), '' ORDER BY place) AS band_lines,
        string_agg('- ' || elevation_band || ': Nivel ' || eaws_level || ' (' || eaws_label || '), Score: '
            || printf('%.2f', risk_score) || ', Factores: ' || array_to_string(main_factors, ', '), chr(10)
            ORDER BY place) AS prompt_lines
      FROM ranked GROUP BY 1, 2)
JOIN (SELECT zone_name, forecast_date AS issue_date, factors FROM factor_lists) USING (zone_name, issue_date))"""


def _filled(template: str, values: dict[str, str]) -> str:
    parts = []
    for text, name, _, _ in Formatter().parse(template):
        if text:
            parts.append("'" + text.replace("'", "''") + "'")
        if name is not None:
            parts.append(f"({values[name]})::VARCHAR")
    return " || ".join(parts)


def _bulletin_text() -> str:
    line = f"""CASE WHEN contains(lower(f), 'nevada') THEN '{templates.SNOW_PROBLEM}'
        WHEN contains(lower(f), 'viento') THEN '{templates.WIND_PROBLEM}'
        WHEN contains(lower(f), 'térmica') OR contains(lower(f), 'temperatura') THEN '{templates.WET_PROBLEM}'
        WHEN contains(lower(f), 'pendiente') THEN '{templates.TERRAIN_PROBLEM}' END"""
    lines = f"[l FOR l IN [{line} FOR f IN five] IF l IS NOT NULL]"
    first = f"[l FOR l, i IN {lines} IF list_position({lines}, l) = i]"
    advice = "CASE eaws_level " + " ".join(f"WHEN {n} THEN '{t}'" for n, t in templates.ADVICE.items()) + " END"
    day = "%d/%m/%Y"
    return _filled(
        templates.BULLETIN,
        {
            "zone": "zone_name",
            "zone_upper": "upper(zone_name)",
            "issue_date": f"strftime(issue_date, '{day}')",
            "valid_from": f"strftime(valid_from, '{day}')",
            "valid_to": f"strftime(valid_to, '{day}')",
            "level": "eaws_level",
            "label": "eaws_label",
            "label_upper": "upper(eaws_label)",
            "color": _attribute("eaws_level", "color"),
            "situation": """CASE WHEN risky <> '' THEN 'Se identificaron condiciones críticas en elevaciones ' || risky || '.'
                ELSE 'Las condiciones son generalmente estables.' END""",
            "band_lines": "band_lines",
            "problem_lines": f"""CASE WHEN len({lines}) > 0 THEN array_to_string({first}, chr(10))
                ELSE '{templates.NO_PROBLEM}' END""",
            "elevations": f"""CASE WHEN {_factor_like("Alta", "Media", source="names", lower=False)}
                THEN 'Sobre 2500m' ELSE 'Todas las elevaciones' END""",
            "factor_lines": "array_to_string(['  ' || i || '. ' || f || chr(10) FOR f, i IN five], '')",
            "snow": f"""CASE WHEN {_factor_like("Nevada", source="five", lower=False)}
                THEN 'Moderadas a intensas' ELSE 'Leves o ausentes' END""",
            "wind": f"""CASE WHEN {_factor_like("Viento", source="five", lower=False)}
                THEN 'Fuerte, con formación de placas' ELSE 'Moderado' END""",
            "temperature": f"""CASE WHEN {_factor_like("térmica", "fluctuación", source="five")}
                THEN 'Fluctuante con riesgo de deshielo' ELSE 'Estable' END""",
            "advice": advice,
            "avoid": "CASE WHEN risky <> '' THEN risky ELSE 'Evaluar según condiciones locales' END",
        },
    )


# --- Queries -----------------------------------------------------------------------------

ORACLES: dict[str, str] = {}


def _needed(names: tuple[str, ...]) -> list[str]:
    order: list[str] = []
    for name in names:
        for needed in [*_needed(CTES[name][0]), name]:
            if needed not in order:
                order.append(needed)
    return order


def _columns(spec: str) -> str:
    """Column list; a name after ``~`` is rounded as the queries round their doubles."""
    return ", ".join(f"round({c[1:]}, 6) + 0.0 AS {c[1:]}" if c.startswith("~") else c for c in spec.split())


def _oracle(name: str, sql: str, *ctes: str) -> None:
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in _needed(ctes)]
    ORACLES[name] = ("WITH " + ",\n".join(parts) + "\n" if parts else "") + sql


def _select(name: str, spec: str, source: str, rest: str = "") -> None:
    _oracle(name, f"SELECT {_columns(spec)} FROM {source} {rest}", source)


_BOX = "latitude BETWEEN -33.40::DOUBLE AND -33.30::DOUBLE AND longitude BETWEEN -70.32::DOUBLE AND -70.22::DOUBLE"
_select("filter_bbox", "route_id ~latitude ~longitude", "reports", f"WHERE {_BOX}")
_oracle("zone_assign", """SELECT route_id, min(r_name) AS zone_name FROM reports LEFT JOIN region
    ON latitude BETWEEN -33.45::DOUBLE + r_regionkey * 0.05::DOUBLE AND -33.41::DOUBLE + r_regionkey * 0.05::DOUBLE
    AND longitude BETWEEN -70.37::DOUBLE + r_regionkey * 0.05::DOUBLE AND -70.34::DOUBLE + r_regionkey * 0.05::DOUBLE
    GROUP BY 1""", "reports")
_oracle("filter_or_all", f"""SELECT route_id, zone_name FROM reports
    WHERE ({_BOX}) OR NOT EXISTS (SELECT 1 FROM reports WHERE {_BOX})""", "reports")
_select("filter_or_all_no_match", "route_id zone_name", "reports")

_PRICE = "(o_totalprice / 50 - 500)"
for _outside, _band in (("last", BAND_LAST), ("null", BAND_NULL), ("open", BAND_OPEN)):
    _oracle(f"elevation_band_{_outside}", f"""SELECT o_orderkey, {_band.format("e")} AS band
        FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 50 <> 0 THEN {_PRICE} END AS e FROM orders)""")
_oracle("band_range_join", f"""SELECT o_orderkey, band FROM orders
    LEFT JOIN (VALUES ('Baja', 0, 2500), ('Media-Baja', 2500, 3200), ('Media-Alta', 3200, 3500), ('Alta', 3500, 6000))
    b(band, low, high) ON {_PRICE} >= low AND {_PRICE} < high""")
_oracle("critical_slope", """SELECT zone_name, "row", col, slope_degrees >= 30 AND slope_degrees <= 45 AS is_critical_slope
    FROM slopes""", "slopes")
_FLAG = """CASE WHEN e IS NULL THEN 0::DOUBLE WHEN e < 0 OR slope_degrees > 90 OR aspect_degrees > 360 THEN 0.5::DOUBLE
    ELSE 1::DOUBLE END"""
_oracle("cell_quality", f"""SELECT o_orderkey, {_FLAG} AS gee_quality_flag
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN {_PRICE} END AS e, o_orderkey % 100 AS slope_degrees,
          o_orderkey % 400 AS aspect_degrees FROM orders)""")
_oracle("cell_quality_filter", f"""SELECT o_orderkey, slope_degrees FROM (SELECT o_orderkey, {_PRICE} AS e,
    CAST(o_orderkey % 100 AS DOUBLE) AS slope_degrees, o_orderkey % 400 AS aspect_degrees FROM orders)
    WHERE {_FLAG} >= 0.9""")
_oracle("quality_loss", """SELECT count(*) AS total, count(*) FILTER (gee_quality_flag >= 0.9) AS kept,
    count(*) FILTER (gee_quality_flag >= 0.9) < count(*) * 0.5 AS warning FROM cells_v2""", "cells_v2")
_select("last_n_days", "location_name date ~snowfall_sum", "weather_daily",
        "WHERE date >= (SELECT max(date) FROM weather_daily) - 2")
_select("latest_slice", "location_name date ~snowfall_sum", "weather_daily",
        "WHERE date = (SELECT max(date) FROM weather_daily)")
_select("latest_per_location", "location_name date ~snowfall_sum", "weather_user",
        "QUALIFY date = max(date) OVER (PARTITION BY location_name)")
_oracle("keys_build", f"""SELECT 'zone_' || location_name || '_' || band AS zone_id,
    'pred_' || day || '_Valle_' || location_name || '_' || band AS prediction_id,
    'nlp_' || location_name AS pattern_id, 'weather_' || day || '_' || location_name AS feature_id,
    key AS row_key, 'grid_' || key AS grid_id
    FROM (SELECT location_name, {BAND_OPEN.format("elevation")} AS band, strftime(date, '%Y%m%d') AS day,
          {_key("location_name", "date")} AS key FROM weather_daily)""", "weather_daily")
_select("top_k", "zone_name elevation_band ~susceptibility_score", "susceptibility",
        "ORDER BY susceptibility.susceptibility_score DESC, zone_name, elevation_band LIMIT 10")
_select("latest_rows", "location_name date ~snowfall_sum", "weather_daily",
        "ORDER BY date DESC, location_name LIMIT 10")
_select("latest_row", "zone_name forecast_date elevation_band eaws_level", "backtest",
        "ORDER BY forecast_date DESC, zone_name, elevation_band LIMIT 1")
_select("report_sorts", "zone_name elevation_band ~susceptibility_score ~avg_slope_degrees", "susceptibility",
        "ORDER BY 3 DESC")
_oracle("sample_to", """SELECT zone_name, "row", col FROM cells
    WHERE ('0x' || substr(md5('7~' || zone_name || '~' || "row" || '~' || col), 1, 8))::BIGINT / 4294967296::DOUBLE
        < 0.1::DOUBLE""", "cells")
_oracle("threshold_filters", """SELECT 'susceptibility' AS filter, zone_id AS id FROM susceptibility
        WHERE susceptibility_score >= 0.5
    UNION ALL SELECT 'reports', pattern_id FROM patterns WHERE avalanche_events > 0 OR confidence >= 0.5
    UNION ALL SELECT 'triggers', trigger_id FROM triggers WHERE is_critical
    UNION ALL SELECT 'danger', prediction_id FROM backtest WHERE eaws_level >= 3""",
        "susceptibility", "patterns", "triggers", "backtest")
_select("top_historical", "pattern_id ~confidence avalanche_events", "patterns",
        """WHERE avalanche_events > 0 OR patterns.confidence >= 0.5
        ORDER BY patterns.confidence DESC, pattern_id LIMIT 20""")

_oracle("grid_make", """SELECT zone_name, "row", col, round(latitude, 6) + 0.0 AS latitude,
    round(longitude, 6) + 0.0 AS longitude,
    round(sqrt(pow((latitude + 33.35::DOUBLE) * 111, 2) + pow((longitude + 70.27::DOUBLE) * 85, 2)), 6) AS distance_km
    FROM (SELECT zone_name, "row", col, south + "row" * 0.0006::DOUBLE AS latitude, west + col * 0.0006::DOUBLE AS longitude
    FROM (SELECT *, CAST(unnest(range(CAST(ceil((east - west) / 0.0006::DOUBLE) AS BIGINT))) AS INTEGER) AS col
    FROM (SELECT *, CAST(unnest(range(CAST(ceil((north - south) / 0.0006::DOUBLE) AS BIGINT))) AS INTEGER) AS "row"
    FROM (SELECT zone_name, min(latitude) AS south, max(latitude) + 0.0003::DOUBLE AS north, min(longitude) AS west,
          max(longitude) + 0.0003::DOUBLE AS east FROM cells GROUP BY 1))))""", "cells")
_oracle("box_areas", """SELECT zone_name, round(area, 6) + 0.0 AS area_km2
    FROM (SELECT zone_name, (max(latitude) - min(latitude)) * (max(longitude) - min(longitude)) * 111 * 85 AS area
          FROM cells GROUP BY 1)""", "cells")
_SLOPES = 'zone_name "row" col ~slope_degrees ~aspect_degrees'
_select("terrain_slope_aspect", _SLOPES, "slopes")
_select("terrain_tiles", _SLOPES, "slopes")
_select("terrain_horn_compass", _SLOPES, "horn_slopes")
_select("terrain_masked", _SLOPES, "masked_slopes")
_select("terrain_thin", 'zone_name "row" col ~scale n_cells ~slope_degrees', "thinned_slopes")
_CELL = """feature_id ~latitude ~longitude elevation ~slope_degrees ~aspect_degrees elevation_band is_critical_slope
    zone_name"""
_select("terrain_features", _CELL, "cells_v1")
_select("terrain_features_v2", _CELL + " ~gee_scale ~gee_quality_flag", "cells_v2")
_oracle("terrain_area_stats", "SELECT " + ", ".join(
    f"round(min({c}), 6) + 0.0 AS {c}_min, round(max({c}), 6) + 0.0 AS {c}_max, round(avg({c}), 6) + 0.0 AS {c}_mean, "
    f"count({c}) AS {c}_count" for c in ("elevation", "slope_degrees", "aspect_degrees")) + " FROM slopes", "slopes")
_STATS = """total_pixels critical_pixels ~avg_slope_degrees ~avg_elevation ~avg_aspect_degrees ~stddev_slope
    ~min_slope ~max_slope min_elevation max_elevation"""
_select("band_stats", f"zone_name elevation_band {_STATS} ~avg_gee_quality ~avg_gee_scale", "stats_v2")
_oracle("band_stats_all_zones", f"""SELECT {_columns("elevation_band " + _STATS)}
    FROM ({_band_stats("cells_v1", "elevation_band")})""", "cells_v1")
_oracle("band_shares", """SELECT elevation_band, n AS total_pixels, c AS critical_pixels,
    round(n / total * 100, 6) + 0.0 AS share_pct, round(c / total * 100, 6) + 0.0 AS critical_share_pct
    FROM (SELECT elevation_band, count(*) AS n, count(*) FILTER (is_critical_slope) AS c,
          (SELECT count(*) FROM cells_v1)::DOUBLE AS total FROM cells_v1 GROUP BY 1)""", "cells_v1")
_SUSC = """zone_id zone_name elevation_band ~total_area_km2 ~critical_slope_area_km2 ~susceptibility_score
    dominant_aspect ~avg_slope_degrees"""
_select("susceptibility_v1", _SUSC, "susceptibility")
_oracle("susceptibility_v2", f"""SELECT {_columns(_SUSC)}, min_elevation, max_elevation,
    {_columns("~avg_elevation ~avg_gee_quality ~avg_gee_scale")}, 'grid' AS data_source FROM susceptibility_2""",
        "susceptibility_2")
_CIRCULAR = "(degrees(atan2(avg(sin(radians(aspect_degrees))), avg(cos(radians(aspect_degrees))))) + 360) % 360"
_oracle("dominant_aspect_circular", f"""SELECT zone_name, elevation_band, round(a, 6) + 0.0 AS avg_aspect_degrees,
    {ASPECT.format("a")} AS dominant_aspect
    FROM (SELECT zone_name, elevation_band, {_CIRCULAR} AS a FROM cells_v1 GROUP BY 1, 2)""", "cells_v1")
_select("susceptibility_map", """grid_id zone_name ~latitude ~longitude elevation elevation_band ~slope_degrees
    ~aspect_degrees ~susceptibility_score risk_category""", "map_v1")
_oracle("susceptibility_map_v2", f"""SELECT 'grid_' || substr(feature_id, 5, 12) AS grid_id, c.zone_name, c.elevation,
    c.elevation_band, {_columns("~latitude ~longitude ~slope_degrees ~aspect_degrees ~gee_quality_flag")},
    is_critical_slope, round(susceptibility_score, 6) + 0.0 AS susceptibility_score,
    {CATEGORY.format("susceptibility_score")} AS risk_category, 'grid' AS data_source
    FROM cells_v2 c JOIN (SELECT zone_name, elevation_band, susceptibility_score FROM susceptibility_2) s
    ON s.zone_name = c.zone_name AND s.elevation_band = c.elevation_band""", "cells_v2", "susceptibility_2")
_oracle("risk_distribution", """SELECT risk_category, count(*) AS pixel_count,
    round(count(*) / (SELECT count(*) FROM map_v1)::DOUBLE * 100, 2) AS percentage FROM map_v1 GROUP BY 1""", "map_v1")
_oracle("terrain_summary", """SELECT round(t, 6) + 0.0 AS total_area_km2, round(c, 6) + 0.0 AS critical_area_km2,
    round(CASE WHEN t > 0 THEN c / t * 100 ELSE 0 END, 6) + 0.0 AS critical_area_percentage,
    round(hi, 6) + 0.0 AS max_susceptibility, round(mean, 6) + 0.0 AS avg_susceptibility, high AS high_risk_zones
    FROM (SELECT sum(total_area_km2) AS t, sum(critical_slope_area_km2) AS c, max(susceptibility_score) AS hi,
          avg(susceptibility_score) AS mean, count(*) FILTER (susceptibility_score >= 0.6) AS high
          FROM susceptibility)""", "susceptibility")
_oracle("slope_histogram", """SELECT bin, round(lo, 6) + 0.0 AS bin_start, round(hi, 6) + 0.0 AS bin_end,
    (SELECT count(*) FROM slopes WHERE slope_degrees >= lo AND (slope_degrees < hi OR (bin = 49 AND slope_degrees <= hi)))
        AS count
    FROM (SELECT CAST(bin AS INTEGER) AS bin, low + bin * ((high - low) / 50) AS lo,
          CASE WHEN bin = 49 THEN high ELSE low + (bin + 1) * ((high - low) / 50) END AS hi
          FROM (SELECT min(slope_degrees) AS low, max(slope_degrees) AS high FROM slopes), range(50) r(bin))""", "slopes")

_select("text_mentions", "route_id " + " ".join(config.VOCABULARY) + " ~nlp_risk_score", "text_scores")
_VALUES = "route_id mentioned_slope_min mentioned_slope_max ~mentioned_slope_avg"
_select("text_slopes", _VALUES, "text_slopes")
_select("text_slopes_strict", _VALUES, "text_slopes_strict")
_select("text_sentiment", "route_id sentiment", "text_scores")
_select("text_difficulty", "route_id difficulty_level", "patterns")
_select("text_patterns", """pattern_id zone_name ~latitude ~longitude elevation elevation_band risk_mentions avalanche_events
    difficulty_level sentiment ~confidence source""", "patterns")
_select("text_by_band", "zone_name elevation_band ~nlp_score total_risk_mentions total_avalanche_mentions nlp_report_count",
        "nlp")
_oracle("text_by_difficulty", """SELECT difficulty_level, count(*) AS count, round(avg(confidence), 6) + 0.0 AS avg_confidence
    FROM patterns GROUP BY 1""", "patterns")
_oracle("text_by_elevation", """SELECT elevation_band, count(*) AS count,
    sum(avalanche_events)::BIGINT AS total_avalanche_mentions, round(avg(confidence), 6) + 0.0 AS avg_risk_score
    FROM patterns GROUP BY 1""", "patterns")
_oracle("text_by_sentiment", "SELECT sentiment, count(*) AS count FROM patterns GROUP BY 1", "patterns")
_oracle("text_stats", """SELECT count(*) AS total_reports,
    count(*) FILTER (avalanche_events > 0 OR confidence >= 0.5) AS high_risk_reports,
    round(avg(confidence), 6) + 0.0 AS avg_risk_score, sum(avalanche_events)::BIGINT AS total_avalanche_mentions,
    (SELECT difficulty_level FROM patterns GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS most_common_difficulty
    FROM patterns""", "patterns")

_oracle("weather_flatten", """SELECT location_name, round(-33.40::DOUBLE + 0.01::DOUBLE * k, 6) AS latitude,
    round(-70.30::DOUBLE + 0.01::DOUBLE * k, 6) AS longitude, CAST(2000 + 100 * k AS INTEGER) AS elevation, d.date,
    round(temperature_2m_max, 6) + 0.0 AS temperature_2m_max, round(temperature_2m_min, 6) + 0.0 AS temperature_2m_min,
    round(temperature_2m_mean, 6) + 0.0 AS temperature_2m_mean, round(precipitation_sum, 6) + 0.0 AS precipitation_sum,
    round(snowfall_sum, 6) + 0.0 AS snowfall_sum, round(windspeed_10m_max, 6) + 0.0 AS windspeed_10m_max,
    NULL::DOUBLE AS precipitation_hours
    FROM (SELECT location_name, CAST(substr(location_name, 5) AS INTEGER) AS k,
          CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date
          FROM (SELECT location_name, min(date) AS lo, max(date) AS hi FROM weather_daily
                GROUP BY location_name, (date - DATE '1970-01-01') // 16)) d
    LEFT JOIN (SELECT * EXCLUDE (elevation) FROM weather_daily) w USING (location_name, date)""", "weather_daily")
_oracle("hourly_flatten", """WITH hourly AS (SELECT 'loc_' || (user_id % 20) AS location_name, date_trunc('hour', ts) AS h,
    avg(value) FILTER (event_type = 'click') / 4 - 2::DOUBLE AS temperature_2m,
    avg(value) FILTER (event_type = 'purchase') / 3 AS precipitation, avg(value) FILTER (event_type = 'view') AS snowfall,
    avg(value) FILTER (event_type = 'error') AS windspeed_10m FROM events GROUP BY 1, 2)
    SELECT a.location_name, a.h - INTERVAL 4 HOUR AS timestamp, CAST(a.h - INTERVAL 4 HOUR AS DATE) AS date,
    round(temperature_2m, 6) + 0.0 AS temperature_2m, round(precipitation, 6) + 0.0 AS precipitation,
    round(snowfall, 6) + 0.0 AS snowfall, round(windspeed_10m, 6) + 0.0 AS windspeed_10m
    FROM (SELECT location_name, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS h
          FROM (SELECT location_name, min(h) AS lo, max(h) AS hi FROM hourly GROUP BY location_name, CAST(h AS DATE))) a
    LEFT JOIN hourly b ON b.location_name = a.location_name AND b.h = a.h""")
CTES["landed"] = ("weather_daily",), """SELECT location_name, k, lo, hi, (k + 3 * block) % 9 AS fault
    FROM (SELECT location_name, CAST(substr(location_name, 5) AS INTEGER) AS k,
                 (date - DATE '1970-01-01') // 16 AS block, min(date) AS lo, max(date) AS hi
          FROM weather_daily GROUP BY 1, 2, 3)"""
_REASON = """CASE fault WHEN 0 THEN 'malformed' WHEN 1 THEN 'location_missing' WHEN 2 THEN 'axis_invalid'
    WHEN 3 THEN 'series_uneven' WHEN 4 THEN 'location_unknown' WHEN 5 THEN 'value_invalid'
    WHEN 7 THEN 'series_missing' END"""
_oracle("ingest_outcomes", f"""SELECT coalesce({_REASON}, 'accepted') AS outcome, count(*) AS documents
    FROM landed GROUP BY 1""", "landed")
_oracle("ingest_quarantine", f"""SELECT {_REASON} AS reason,
    CASE WHEN fault = 4 THEN location_name || 'x' WHEN fault > 1 THEN location_name END AS location_name,
    count(*) AS documents FROM landed WHERE fault NOT IN (6, 8) GROUP BY 1, 2""", "landed")
_oracle("ingest_daily", f"""SELECT location_name, round(-33.40::DOUBLE + 0.01::DOUBLE * k, 6) AS latitude,
    round(-70.30::DOUBLE + 0.01::DOUBLE * k, 6) AS longitude, CAST(2000 + 100 * k AS INTEGER) AS elevation, d.date,
    {_columns("~temperature_2m_max ~temperature_2m_min ~temperature_2m_mean ~precipitation_sum ~snowfall_sum ~windspeed_10m_max")}
    FROM (SELECT location_name, k, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date
          FROM landed WHERE fault IN (6, 8)) d
    LEFT JOIN (SELECT * EXCLUDE (elevation) FROM weather_daily) w USING (location_name, date)""", "landed")
_oracle("ingest_other_series", """SELECT location_name, timestamp, 'snow_line' AS variable,
    CAST(2000 + 100 * k + CAST(timestamp AS DATE) - lo AS DOUBLE) AS value
    FROM (SELECT location_name, k, lo, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS TIMESTAMP) AS timestamp
          FROM landed WHERE fault = 6)""", "landed")
_oracle("ingest_variables", """SELECT variable, count(*) AS documents
    FROM (SELECT fault, unnest(['location_name', 'time_start', 'time_end', 'interval_s']) AS variable FROM landed
          UNION ALL
          SELECT fault, unnest(['temperature_2m_max', 'temperature_2m_min', 'temperature_2m_mean', 'precipitation_sum',
                                'snowfall_sum', 'windspeed_10m_max']) FROM landed WHERE fault <> 7
          UNION ALL SELECT fault, 'humidity' FROM landed WHERE fault = 5
          UNION ALL SELECT fault, 'snow_line' FROM landed WHERE fault = 6)
    WHERE fault > 0 GROUP BY 1""", "landed")
_oracle("ingest_hourly_dst", """WITH hourly AS (SELECT 'loc_' || (user_id % 20) AS location_name,
    date_trunc('hour', ts) + INTERVAL 92 DAY AS h,
    avg(value) FILTER (event_type = 'click') / 4 - 2::DOUBLE AS temperature_2m,
    avg(value) FILTER (event_type = 'purchase') / 3 AS precipitation, avg(value) FILTER (event_type = 'view') AS snowfall,
    avg(value) FILTER (event_type = 'error') AS windspeed_10m FROM events GROUP BY 1, 2),
    steps AS (SELECT location_name, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS h
          FROM (SELECT location_name, min(h) AS lo, max(h) AS hi FROM hourly GROUP BY location_name, CAST(h AS DATE)))
    SELECT a.location_name, a.h AS step_utc,
    CAST(a.h - CASE WHEN a.h < TIMESTAMP '2024-04-07 03:00:00' THEN INTERVAL 3 HOUR ELSE INTERVAL 4 HOUR END AS TIMESTAMP)
        AS timestamp,
    CAST(a.h - CASE WHEN a.h < TIMESTAMP '2024-04-07 03:00:00' THEN INTERVAL 3 HOUR ELSE INTERVAL 4 HOUR END AS DATE) AS date,
    round(temperature_2m, 6) + 0.0 AS temperature_2m, round(precipitation, 6) + 0.0 AS precipitation,
    round(snowfall, 6) + 0.0 AS snowfall, round(windspeed_10m, 6) + 0.0 AS windspeed_10m
    FROM steps a LEFT JOIN hourly b ON b.location_name = a.location_name AND b.h = a.h""")
_oracle("date_bounds", """SELECT date, mode, CASE mode WHEN 'historical' THEN date - 7 ELSE date END AS first,
    CASE mode WHEN 'historical' THEN date ELSE date + 16 END AS last, true AS reachable
    FROM (SELECT DISTINCT date FROM weather_daily), (VALUES ('historical'), ('forecast')) m(mode)""", "weather_daily")
_oracle("weather_date_window", """SELECT 'historical' AS mode, location_name, date FROM weather_daily
    WHERE date BETWEEN DATE '2024-01-13' AND DATE '2024-01-20'
    UNION ALL SELECT 'forecast', location_name, date FROM weather_daily
    WHERE date BETWEEN DATE '2024-01-20' AND DATE '2024-02-05'""", "weather_daily")
_FEATURES = """location_name date ~snowfall_24h ~snowfall_48h ~snowfall_72h ~snowfall_7d ~temp_variation_24h
    ~temp_variation_48h isoterma_0c precipitation_intensity"""
_select("weather_features_rows", _FEATURES, "features_user")
_select("weather_features_range", _FEATURES, "features_range")
_select("weather_blocks_rows", _FEATURES, "features_user")
_select("weather_blocks_range", _FEATURES, "features_range")
_select("snow_windows", "location_name date ~snowfall_48h ~snowfall_72h ~snowfall_7d ~temp_variation_48h", "features")
_oracle("weather_feature_table", f"""SELECT 'weather_' || strftime(date, '%Y%m%d') || '_' || location_name AS feature_id,
    {_columns('''location_name date elevation_band ~snowfall_24h ~snowfall_48h ~snowfall_72h ~temp_variation_24h
    ~windspeed_10m_max precipitation_intensity isoterma_0c''')} FROM features""", "features")
_select("weather_triggers", """trigger_id location_name date elevation_band trigger_type trigger_severity ~trigger_value
    is_critical""", "triggers_user")
_oracle("trigger_unpivot", """SELECT location_name, date, count(*) AS triggers, count(*) FILTER (is_critical) AS critical
    FROM triggers GROUP BY 1, 2""", "triggers")
_oracle("trigger_counts", """SELECT trigger_type, trigger_severity, count(*) AS count FROM triggers GROUP BY 1, 2""",
        "triggers")
_oracle("severity_counts", "SELECT trigger_severity, count(*) AS count FROM triggers GROUP BY 1", "triggers")
_oracle("trigger_pivot", "SELECT date, " + ", ".join(
    f"""count(*) FILTER (trigger_severity = '{s}') AS "{s}\"""" for s in config.SEVERITIES)
    + " FROM triggers GROUP BY 1", "triggers")
_oracle("snowfall_summary", """SELECT location_name, round(sum(snowfall_sum), 6) + 0.0 AS total_snowfall_cm,
    round(avg(snowfall_sum), 6) + 0.0 AS avg_daily_snowfall_cm, round(max(snowfall_sum), 6) + 0.0 AS max_daily_snowfall_cm,
    round(min(temperature_2m_min), 6) + 0.0 AS min_temp_c, round(max(temperature_2m_max), 6) + 0.0 AS max_temp_c
    FROM weather_daily GROUP BY 1""", "weather_daily")
_oracle("weather_summary", """SELECT count(DISTINCT date) AS total_days_analyzed, count(DISTINCT location_name) AS locations,
    round(max(snowfall_24h), 6) + 0.0 AS max_snowfall_24h, round(max(snowfall_72h), 6) + 0.0 AS max_snowfall_72h,
    round(max(windspeed_10m_max), 6) + 0.0 AS max_wind_speed, (SELECT count(*) FROM triggers) AS total_triggers,
    (SELECT count(*) FILTER (is_critical) FROM triggers) AS critical_triggers FROM features""", "features", "triggers")

_WEATHER = "~max_snowfall_24h ~max_snowfall_72h ~max_temp_variation ~max_wind_speed ~avg_isoterma critical_trigger_count"
_select("weather_by_band", f"zone_name elevation_band {_WEATHER}", "band_weather")
_oracle("weather_all_bands", """SELECT zone_name, unnest(['Baja', 'Media-Baja', 'Media-Alta', 'Alta']) AS elevation_band,
    round(max_snowfall_72h, 6) + 0.0 AS max_snowfall_72h, critical_trigger_count FROM band_weather""", "band_weather")
_select("fusion_outer", f"""zone_name elevation_band ~topo_score ~critical_area_km2 ~nlp_score total_risk_mentions
    total_avalanche_mentions nlp_report_count {_WEATHER}""", "fused")
_select("risk_scores", """zone_name elevation_band ~weather_score_raw ~nlp_score_adjusted ~topo_contribution
    ~weather_contribution ~nlp_contribution ~risk_score eaws_level eaws_label ~confidence""", "scored")
_oracle("main_factors", f"""SELECT zone_name, elevation_band, array_to_string({_FACTORS}, '; ') AS main_factors
    FROM scored""", "scored")
_PREDICTION = """prediction_id zone_name forecast_date elevation_band eaws_level eaws_label ~risk_score ~confidence
    ~topo_contribution ~weather_contribution ~nlp_contribution"""
for _name, _source in (("predictions", "predictions"), ("backtest", "backtest")):
    _oracle(_name, f"""SELECT {_columns(_PREDICTION)}, array_to_string(main_factors, '; ') AS main_factors
        FROM {_source}""", _source)
_oracle("danger_distribution", """SELECT eaws_level, eaws_label, count(*) AS count,
    round(avg(confidence), 6) + 0.0 AS avg_confidence FROM backtest GROUP BY 1, 2""", "backtest")
_oracle("risk_by_band", """SELECT elevation_band, round(avg(risk_score), 6) + 0.0 AS avg_risk_score,
    max(eaws_level) AS max_eaws_level, round(avg(confidence), 6) + 0.0 AS avg_confidence FROM backtest GROUP BY 1""",
        "backtest")
_oracle("contribution_share", """SELECT round(t, 6) + 0.0 AS topo_contribution, round(w, 6) + 0.0 AS weather_contribution,
    round(n, 6) + 0.0 AS nlp_contribution, round(t * 100 / (t + w + n), 6) + 0.0 AS topo_pct,
    round(w * 100 / (t + w + n), 6) + 0.0 AS weather_pct, round(n * 100 / (t + w + n), 6) + 0.0 AS nlp_pct
    FROM (SELECT avg(topo_contribution) AS t, avg(weather_contribution) AS w, avg(nlp_contribution) AS n FROM backtest)""",
        "backtest")
_oracle("danger_counts", """SELECT count(*) AS total_predictions, count(*) FILTER (eaws_level >= 3) AS high_risk_count,
    count(DISTINCT eaws_level) AS levels, round(avg(confidence), 6) + 0.0 AS avg_confidence FROM backtest""", "backtest")

_oracle("bulletin_aggregate", """SELECT zone_name, issue_date, valid_from, valid_to, eaws_level, eaws_label, high_risk_bands,
    array_to_string(factors, '; ') AS factors,
    CASE WHEN len(tags) > 0 THEN array_to_string(tags, '; ') ELSE 'Condiciones estables' END AS avalanche_problems,
    summary, danger_description, affected_elevations, 'Todas las orientaciones' AS affected_aspects, recommendations
    FROM bulletins""", "bulletins")
_oracle("bulletin_text", f"""SELECT 'boletin_' || strftime(issue_date, '%Y%m%d') || '_' || zone_name AS boletin_id, zone_name,
    issue_date, {_bulletin_text()} AS bulletin_text, 'Media' AS confidence, 'Template_System' AS generated_by
    FROM bulletins""", "bulletins")
_oracle("bulletin_prompts", "SELECT zone_name, issue_date, " + _filled(templates.PROMPT, {
    "zone": "zone_name", "issue_date": "issue_date", "valid_from": "valid_from", "valid_to": "valid_to",
    "band_lines": "prompt_lines"}) + " AS prompt FROM bulletins", "bulletins")

_select("validation_match", """fecha zona elevation_band nivel_observado nivel_predicho error signed_error acierto
    ~risk_score ~confidence""", "matched")
_oracle("validation_metrics", """SELECT count(error) AS total, count(*) FILTER (acierto) AS aciertos,
    round(CASE WHEN count(error) > 0 THEN count(*) FILTER (acierto) / count(error)::DOUBLE * 100 ELSE 0 END, 6) AS accuracy,
    round(avg(error), 6) AS mae, count(*) FILTER (error IS NULL) AS unmatched FROM matched""", "matched")
_oracle("validation_error_distribution", """SELECT error, count(*) AS count FROM matched WHERE error IS NOT NULL
    GROUP BY 1""", "matched")
_oracle("validation_by_level", """SELECT nivel_observado, round(avg(acierto::INTEGER) * 100, 6) AS accuracy,
    count(*) AS events FROM matched WHERE error IS NOT NULL GROUP BY 1""", "matched")

_CRITICAL = ("latitude", "longitude", "elevation", "slope_degrees", "aspect_degrees")
_COVERAGE = "least((max(latitude) - min(latitude)) / 0.1::DOUBLE, (max(longitude) - min(longitude)) / 0.1::DOUBLE)"
_oracle("dq_cells", " UNION ALL ".join(
    f"""SELECT '{name}' AS "check", '{severity}' AS severity, round(CAST({value} AS DOUBLE), 6) + 0.0 AS value,
    coalesce({passed.format(value)}, false) AS passed FROM cells_v2"""
    for name, severity, value, passed in [
        ("not_empty", "error", "count(*)", "{0} > 0"),
        *[(f"null_{c}", "error", f"count(*) FILTER ({c} IS NULL)", "{0} = 0") for c in _CRITICAL],
        ("negative_elevation", "error", "count(*) FILTER (elevation < 0)", "{0} = 0"),
        ("slope_range", "error", "count(*) FILTER (slope_degrees < 0 OR slope_degrees > 90)", "{0} = 0"),
        ("aspect_range", "error", "count(*) FILTER (aspect_degrees < 0 OR aspect_degrees > 360)", "{0} = 0"),
        ("enough_rows", "warning", "count(*)", "{0} >= 1000"),
        ("coverage", "warning", _COVERAGE, "{0} >= 0.8"),
        ("quality", "warning", "avg(gee_quality_flag)", "{0} >= 0.9"),
    ]), "cells_v2")
_oracle("dq_score_range", " UNION ALL ".join(
    f"""SELECT 'susceptibility_score_{f}' AS "check", '{severity}' AS severity,
    round({f}(susceptibility_score), 6) + 0.0 AS value, {f}(susceptibility_score) {test} AS passed FROM susceptibility"""
    for f, severity, test in (("min", "error", ">= 0"), ("max", "error", "<= 1"), ("avg", "info", "IS NOT NULL"))),
        "susceptibility")
_oracle("quality_metrics", """SELECT count(*) AS total_features, round(avg(gee_quality_flag), 6) AS avg_quality,
    min(gee_quality_flag) AS min_quality, max(gee_quality_flag) AS max_quality,
    count(*) FILTER (gee_quality_flag >= 0.9) AS high_quality_count,
    count(*) FILTER (gee_quality_flag < 0.9) AS low_quality_count FROM cells_v2""", "cells_v2")
_oracle("scale_counts", "SELECT gee_scale, count(*) AS count FROM cells_v2 GROUP BY 1", "cells_v2")
_oracle("dq_nulls", "SELECT " + ", ".join(
    f"count(*) FILTER ({c} IS NULL) AS {c}" for c in ("temperature_2m_mean", "snowfall_sum", "windspeed_10m_max"))
    + " FROM weather_user", "weather_user")
_oracle("dq_ranges", "SELECT " + ", ".join(
    f"round({f}({c}), 6) + 0.0 AS {n}" for n, f, c in (
        ("min_temp", "min", "temperature_2m_min"), ("max_temp", "max", "temperature_2m_max"),
        ("min_snow", "min", "snowfall_sum"), ("max_snow", "max", "snowfall_sum"),
        ("min_wind", "min", "windspeed_10m_max"), ("max_wind", "max", "windspeed_10m_max")))
    + " FROM weather_user", "weather_user")
_oracle("table_inventory", " UNION ALL ".join(
    f"""SELECT '{t}' AS table_name, NULL::VARCHAR AS layer, count(*) AS rows,
    CASE WHEN count(*) = 0 THEN 'empty' ELSE 'ok' END AS status FROM {t}""" for t in ("events", "part", "documents"))
    + " UNION ALL SELECT 'avalanche_predictions', 'gold', NULL, 'missing'")
_oracle("upsert_dim", """SELECT c_custkey AS location_id, c_name AS name, 'new' AS region FROM customer
    UNION ALL SELECT s_suppkey, s_name, 'old' FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)""")

_oracle("guarded_scan", "SELECT o_orderstatus, count(*) AS orders FROM orders GROUP BY 1")
_oracle("optional_source", "SELECT 'there' AS source, o_orderstatus, count(*) AS orders FROM orders GROUP BY 2")
_oracle("literal_source", """SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '5-LOW' THEN 5 END
    AS rank, count(*) AS orders FROM orders GROUP BY 1""")
_oracle("conformed_orders", """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,
    CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS DOUBLE) AS o_totalprice, CAST(NULL AS VARCHAR) AS note, true AS stamped
    FROM orders""")

_TRIGGER_ROWS = "trigger_id location_name date trigger_type trigger_severity is_critical ~trigger_value"
_select("sink_overwrite", _TRIGGER_ROWS, "triggers")
_oracle("sink_partitioned", "SELECT strftime(date, '%Y-%m') AS month, count(*) AS triggers FROM triggers GROUP BY 1", "triggers")
_oracle("sink_replace_partitions", f"""SELECT {_columns(_TRIGGER_ROWS)} FROM triggers
    WHERE location_name <> 'loc_3' OR is_critical
        OR NOT EXISTS (SELECT 1 FROM triggers WHERE location_name = 'loc_3' AND is_critical)""", "triggers")
_oracle("sink_bulletins", """SELECT 'boletin_' || strftime(issue_date, '%Y%m%d') || '_' || zone_name AS boletin_id,
    zone_name, issue_date, eaws_level FROM bulletins WHERE issue_date = (SELECT max(issue_date) FROM bulletins)""",
        "bulletins")
_oracle("sink_text", f"""SELECT zone_name, sha256(rtrim(bulletin_text, chr(10))) AS text_sha256
    FROM ({ORACLES["bulletin_text"]}) WHERE issue_date = (SELECT max(issue_date) FROM ({ORACLES["bulletin_text"]}))""")
_oracle("checks_of_write", " UNION ALL ".join(
    f"""SELECT '{table}' AS table_name, '{name}' AS "check", '{severity}' AS severity,
    round(CAST({value} AS DOUBLE), 6) + 0.0 AS value, coalesce({value} {test}, false) AS passed FROM {source}"""
    for table, name, severity, value, test, source in (
        ("topo_susceptibility", "susceptibility_score_min", "error", "min(susceptibility_score)", ">= 0", "susceptibility"),
        ("topo_susceptibility", "susceptibility_score_max", "error", "max(susceptibility_score)", "<= 1", "susceptibility"),
        ("topo_susceptibility", "susceptibility_score_avg", "info", "avg(susceptibility_score)", "IS NOT NULL", "susceptibility"),
        *((f"weather_daily", f"null_{c}", "info", f"count(*) FILTER ({c} IS NULL)", "= 0", "weather_user")
          for c in ("temperature_2m_mean", "snowfall_sum", "windspeed_10m_max")),
        *(("weather_daily", f"{f}_{n}", "info", f"{f}({c})", "IS NOT NULL", "weather_user")
          for n, c, fs in (("temp", "temperature_2m_min", ["min"]), ("temp", "temperature_2m_max", ["max"]),
                           ("snow", "snowfall_sum", ["min", "max"]), ("wind", "windspeed_10m_max", ["min", "max"])) for f in fs),
    )), "susceptibility", "weather_user")
_oracle("band_overlaps", """SELECT o_orderstatus, band, count(*) AS orders FROM orders
    LEFT JOIN (VALUES ('any', NULL, 90000), ('mid', 50000, 200000), ('inner', 120000, 120500), ('top', 350000, NULL))
        b(band, low, high)
    ON o_totalprice >= coalesce(low, -1e300) AND o_totalprice < coalesce(high, 1e300) GROUP BY 1, 2""")

for _name, _from in (("dated_weather", "dated_weather"), ("dated_fused", "dated_weather"), ("dated_scored", "dated_fused"),
                     ("backtest", "dated_scored")):
    _needs, _text = CTES[_name]
    for _part in ("dated_weather", "dated_fused", "dated_scored"):
        _text = _text.replace(f" {_part}", f" {_part}_14")
    _needs = tuple(f"{n}_14" if n.startswith("dated_") else n for n in _needs)
    CTES[f"{_name}_14"] = _needs, _text.replace("forecast_date - 2 ", "forecast_date - 13 ")
_select("backtest_fortnight", "zone_name forecast_date elevation_band eaws_level ~risk_score ~confidence", "backtest_14")
_oracle("fusion_rows", f"""SELECT {_columns(f"""zone_name elevation_band ~topo_score ~critical_area_km2 ~nlp_score
    total_risk_mentions total_avalanche_mentions nlp_report_count {_WEATHER}""")},
    (zone_name, elevation_band) IN (SELECT (zone_name, elevation_band) FROM topo) AS has_topo,
    (zone_name, elevation_band) IN (SELECT (zone_name, elevation_band) FROM nlp) AS has_nlp,
    (zone_name, elevation_band) IN (SELECT (zone_name, elevation_band) FROM band_weather) AS has_weather FROM fused""",
        "fused")
_oracle("trailing_month", """SELECT a.location_name, a.date, round(sum(b.snowfall_sum), 6) + 0.0 AS snow_30d,
    round(max(b.windspeed_10m_max), 6) + 0.0 AS wind_30d, round(min(b.temperature_2m_min), 6) + 0.0 AS cold_30d
    FROM weather_user a JOIN weather_user b ON b.location_name = a.location_name AND b.date BETWEEN a.date - 29 AND a.date
    GROUP BY 1, 2""", "weather_user")

_AGG = """count(*) AS count, round(avg(confidence), 6) + 0.0 AS avg_confidence,
    round(avg(risk_score), 6) + 0.0 AS avg_risk_score, max(eaws_level) AS max_eaws_level,
    count(*) FILTER (eaws_level >= 3) AS high_risk_count FROM backtest"""
_oracle("prediction_reports", f"""SELECT 'level' AS report, eaws_level, eaws_label, NULL::VARCHAR AS elevation_band,
    NULL::VARCHAR AS zone_name, {_AGG} GROUP BY eaws_level, eaws_label
    UNION ALL SELECT 'band', NULL, NULL, elevation_band, NULL, {_AGG} GROUP BY elevation_band
    UNION ALL SELECT 'zone', NULL, NULL, NULL, zone_name, {_AGG} GROUP BY zone_name
    UNION ALL SELECT 'all', NULL, NULL, NULL, NULL, {_AGG}""", "backtest")
_AGG = "count(*) AS count, count(*) FILTER (is_critical) AS critical FROM triggers_user"
_oracle("trigger_reports", f"""SELECT 'type' AS report, trigger_type, trigger_severity, NULL::DATE AS date, {_AGG} GROUP BY 2, 3
    UNION ALL SELECT 'severity', NULL, trigger_severity, NULL, {_AGG} GROUP BY trigger_severity
    UNION ALL SELECT 'date', NULL, NULL, date, {_AGG} GROUP BY date""", "triggers_user")
_AGG = """count(*) AS count, round(avg(confidence), 6) + 0.0 AS avg_confidence,
    sum(avalanche_events)::BIGINT AS total_avalanche_mentions FROM patterns"""
_oracle("text_reports", f"""SELECT 'difficulty' AS report, difficulty_level, NULL::VARCHAR AS elevation_band,
    NULL::VARCHAR AS sentiment, {_AGG} GROUP BY difficulty_level
    UNION ALL SELECT 'elevation', NULL, elevation_band, NULL, {_AGG} GROUP BY elevation_band
    UNION ALL SELECT 'sentiment', NULL, NULL, sentiment, {_AGG} GROUP BY sentiment""", "patterns")
_oracle("terrain_levels", " UNION ALL ".join(
    f"""SELECT zone_name, {f} AS factor, CAST("row" // {f} AS INTEGER) AS "row", CAST(col // {f} AS INTEGER) AS col,
    round(avg(latitude), 6) + 0.0 AS latitude, round(avg(longitude), 6) + 0.0 AS longitude,
    round(avg(elevation), 6) + 0.0 AS elevation, count(*) AS n_cells, {60 * f}::DOUBLE AS scale
    FROM cells GROUP BY zone_name, "row" // {f}, col // {f}""" for f in (1, 2, 4, 8)), "cells")
_oracle("newest_orders", """SELECT o_orderkey, o_orderstatus FROM orders
    WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)""")

_select("terrain_dense", _SLOPES, "slopes")
_select("terrain_dense_masked", _SLOPES, "masked_slopes")
_select("terrain_dense_horn", _SLOPES, "horn_slopes")
