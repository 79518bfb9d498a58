"""Wall time of the headline queries: one JSON line on standard output.

``BENCH_SF_DIR`` names the directory of the test tables, ``BENCH_CPUS`` the local cores.
Every query is built, planned and run into a sink that discards its rows. A first pass
over all of them warms the JVM and is not counted.
"""

from __future__ import annotations

import json
import os
import time

from nivo.plans.queries import QUERIES
from nivo.session import local_session

HEADLINE = [
    "terrain_slope_aspect",
    "terrain_features_v2",
    "susceptibility_v1",
    "susceptibility_v2",
    "susceptibility_map",
    "slope_histogram",
    "text_mentions",
    "text_slopes",
    "text_patterns",
    "text_by_band",
    "weather_flatten",
    "hourly_flatten",
    "weather_features_rows",
    "weather_features_range",
    "weather_triggers",
    "trigger_pivot",
    "weather_by_band",
    "predictions",
    "backtest",
    "bulletin_text",
    "validation_metrics",
]


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "nivo-bench")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    for name in HEADLINE:
        run(name)
    times = {name: run(name) for name in HEADLINE}
    scale = os.path.basename(directory.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
