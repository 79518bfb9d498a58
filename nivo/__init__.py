"""Snow-avalanche danger analytics on Spark DataFrames."""

from nivo import config, contracts, sources
from nivo.functions import bands, keys
from nivo.operators import (
    bulletins,
    filters,
    frames,
    fusion,
    quality,
    terrain,
    text,
    validation,
    weather,
)
from nivo.sources import ingest, payloads, sinks

__all__ = [
    "bands",
    "bulletins",
    "config",
    "contracts",
    "filters",
    "frames",
    "fusion",
    "ingest",
    "keys",
    "payloads",
    "quality",
    "sinks",
    "sources",
    "terrain",
    "text",
    "validation",
    "weather",
]
