"""Constants and parameter records shared by the operators.

Every number and phrase in this module is a fixed value: results are only comparable
across runs and engines when these agree. Operators take them as default arguments, so
callers can pass their own.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class BBox:
    """Geographic box in degrees, inclusive on all four sides."""

    south: float
    north: float
    west: float
    east: float


@dataclass(frozen=True)
class Zone:
    name: str
    latitude: float
    longitude: float
    bbox: BBox


@dataclass(frozen=True)
class Band:
    """Half-open elevation interval ``[low, high)`` in metres."""

    name: str
    low: float
    high: float


@dataclass(frozen=True)
class SusceptibilityWeights:
    critical: float
    slope: float
    spread: float
    quality: float = 0.0
    slope_norm: float = 60.0
    spread_norm: float = 30.0


@dataclass(frozen=True)
class TextWeights:
    avalanche: float = 0.3
    risk: float = 0.2
    slope: float = 0.15
    weather: float = 0.15
    high: float = 0.15
    moderate: float = 0.05
    norm: float = 5.0


@dataclass(frozen=True)
class TriggerThresholds:
    """Each tuple lists (lower bound, severity), highest bound first."""

    snow_24h: tuple = ((80, "Extremo"), (50, "Alto"), (30, "Moderado"), (10, "Bajo"))
    snow_72h: tuple = ((80, "Crítico"), (50, "Alto"), (30, "Moderado"))
    temp_variation: tuple = ((15, "Alto"), (10, "Moderado"), (5, "Bajo"))
    wind: tuple = ((70, "Alto"), (50, "Moderado"), (30, "Bajo"))
    isotherm: tuple = (3000, 4000)
    rain_min_mm: float = 10
    rain_mean_temp: tuple = (0, 5)


@dataclass(frozen=True)
class FusionWeights:
    topo: float = 0.35
    weather: float = 0.45
    nlp: float = 0.20


# --- Fixed values: pilot zone, elevation bands, critical slope ---------------------------

PILOT_ZONE = Zone("La Parva", -33.35, -70.27, BBox(-33.40, -33.30, -70.32, -70.22))

BANDS = (
    Band("Baja", 0, 2500),
    Band("Media-Baja", 2500, 3200),
    Band("Media-Alta", 3200, 3500),
    Band("Alta", 3500, 6000),
)

CRITICAL_SLOPE_MIN = 30
CRITICAL_SLOPE_MAX = 45

MIN_ELEVATION_M = 2000
GRID_STEP_DEG = 0.0003
METRES_PER_DEG_LAT = 111_000
METRES_PER_DEG_LON = 85_000
CELL_AREA_M2 = 900
BASE_SCALE_M = 30
HIGH_QUALITY = 0.9
HIGH_SUSCEPTIBILITY = 0.6

# --- Fixed values: score weights ---------------------------------------------------------

SUSCEPTIBILITY_V1 = SusceptibilityWeights(0.6, 0.3, 0.1)
SUSCEPTIBILITY_V2 = SusceptibilityWeights(0.50, 0.30, 0.15, 0.05)
SUSCEPTIBILITY_V2_NO_QUALITY = SusceptibilityWeights(0.55, 0.30, 0.15)
TEXT_WEIGHTS = TextWeights()
TRIGGERS = TriggerThresholds()
FUSION_WEIGHTS = FusionWeights()

CRITICAL_SEVERITIES = ("Extremo", "Crítico", "Alto")
SEVERITIES = ("Alto", "Bajo", "Crítico", "Detectado", "Extremo", "Moderado", "Zona Crítica")
LAPSE_RATE_C_PER_M = 0.0065

# --- Fixed values: date windows ----------------------------------------------------------

HISTORY_DAYS = 7
FORECAST_DAYS = 16
EARLIEST_HISTORY = "2020-01-01"
HISTORY_LATENCY_DAYS = 2
LOCAL_TIMEZONE = "America/Santiago"

# --- Fixed values: five-level danger scale -----------------------------------------------

DANGER_SCALE = (
    {
        "level": 1,
        "label": "Débil",
        "label_en": "Low",
        "color": "#CCFF66",
        "description": "Nieve generalmente bien estabilizada",
        "description_long": "La nieve está generalmente bien estabilizada",
        "probability": "improbable",
        "avalanche_size": "pequeño",
        "recommendations": "Condiciones favorables. Riesgo en pendientes muy empinadas y extremas.",
    },
    {
        "level": 2,
        "label": "Limitado",
        "label_en": "Moderate",
        "color": "#FFFF00",
        "description": "Nieve moderadamente estabilizada",
        "description_long": "Nieve moderadamente estabilizada en algunas pendientes",
        "probability": "posible",
        "avalanche_size": "pequeño a mediano",
        "recommendations": "Condiciones mayormente favorables. Evaluar pendientes específicas.",
    },
    {
        "level": 3,
        "label": "Notable",
        "label_en": "Considerable",
        "color": "#FF9900",
        "description": "Nieve débilmente estabilizada en muchas pendientes",
        "description_long": "Nieve moderada o débilmente estabilizada en muchas pendientes",
        "probability": "probable",
        "avalanche_size": "mediano a grande",
        "recommendations": "Condiciones críticas. Experiencia y evaluación del terreno esencial.",
    },
    {
        "level": 4,
        "label": "Fuerte",
        "label_en": "High",
        "color": "#FF0000",
        "description": "Nieve débilmente estabilizada en mayoría de pendientes",
        "description_long": "Nieve débilmente estabilizada en la mayoría de pendientes empinadas",
        "probability": "muy probable",
        "avalanche_size": "grande a muy grande",
        "recommendations": "Condiciones muy críticas. Restricción a terreno simple solamente.",
    },
    {
        "level": 5,
        "label": "Muy Fuerte",
        "label_en": "Very High",
        "color": "#9900CC",
        "description": "Nieve inestable generalizada",
        "description_long": "Nieve inestable generalizada",
        "probability": "seguro",
        "avalanche_size": "muy grande a extremadamente grande",
        "recommendations": "Evitar todo terreno de avalanchas. Condiciones extraordinarias.",
    },
)

# --- Fixed values: phrases searched in report text ---------------------------------------

VOCABULARY = {
    "avalanche_mentions": (
        "avalancha", "alud", "aludes", "desprendimiento", "deslizamiento",
        "cornisa", "cornisas", "placa", "placas", "nieve inestable",
    ),
    "risk_mentions": (
        "peligro", "peligroso", "riesgo", "riesgoso", "cuidado", "precaución",
        "atención", "evitar", "no recomendado", "crítico", "exposición",
        "inestable", "inseguro",
    ),
    "slope_mentions": (
        "pendiente", "pendientes", "grado", "grados", "inclinación",
        "empinado", "empinada", "pronunciado", "vertical",
    ),
    "weather_trigger_mentions": (
        "nieve reciente", "nevada", "nevadas", "precipitación", "viento",
        "temperatura", "calor", "frío", "deshielo", "lluvia",
    ),
    "temporal_mentions": (
        "historial", "frecuente", "recurrente", "anterior", "previo",
        "ha ocurrido", "se han reportado", "conocido por",
    ),
    "severity_high_count": (
        "muy peligroso", "extremadamente", "mortal", "fatal", "grave",
        "severo", "alto riesgo", "máxima precaución",
    ),
    "severity_moderate_count": (
        "moderado", "medio", "considerable", "significativo", "notable",
    ),
}

POSITIVE_WORDS = (
    "excelente", "hermoso", "hermosa", "espectacular", "increíble",
    "recomendado", "recomendable", "fácil", "seguro", "bueno", "buena",
)

NEGATIVE_WORDS = (
    "peligroso", "difícil", "malo", "mala", "evitar", "no recomendado",
    "riesgoso", "inseguro", "problemático", "complicado",
)

REPORT_SOURCE = "AndesHandbook"

# --- Fixed values: weather payload variables ---------------------------------------------

DAILY_VARIABLES = (
    "temperature_2m_max", "temperature_2m_min", "temperature_2m_mean",
    "precipitation_sum", "precipitation_hours", "snowfall_sum",
    "windspeed_10m_max", "windgusts_10m_max", "winddirection_10m_dominant",
    "shortwave_radiation_sum",
)
FORECAST_ONLY_VARIABLES = ("precipitation_probability_max", "et0_fao_evapotranspiration")
HOURLY_VARIABLES = (
    "temperature_2m", "precipitation", "snowfall", "snow_depth",
    "weathercode", "cloudcover", "windspeed_10m", "winddirection_10m",
    "windgusts_10m", "surface_pressure", "relativehumidity_2m",
)
