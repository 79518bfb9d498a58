import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nivo import bands, config, frames, terrain
from nivo.config import BBox


def grid(spark, z, zone="z", scale=30.0, skip=()):
    rows = [
        (zone, r, c, -33.4 + r * 0.0003, -70.3 + c * 0.0003, None if v is None else float(v), scale)
        for r, line in enumerate(z)
        for c, v in enumerate(line)
        if (r, c) not in skip
    ]
    return spark.createDataFrame(
        rows, "zone_name string, row int, col int, latitude double, longitude double, elevation double, scale double"
    )


def by_cell(df, *names):
    return {(r["row"], r["col"]): tuple(r[n] for n in names) for r in df.collect()}


@pytest.mark.parametrize(
    ("surface", "slope", "ref", "compass"),
    [
        ([[30 * r] * 3 for r in range(3)], 45.0, 0.0, 180.0),
        ([[30 * c for c in range(3)] for _ in range(3)], 45.0, 270.0, 270.0),
        ([[5] * 3] * 3, 0.0, 0.0, 0.0),
    ],
)
def test_hand_worked_surfaces(spark, surface, slope, ref, compass):
    steep = terrain.slope(terrain.gradient(grid(spark, surface), 30.0, 30.0))
    for convention, expected in (("ref", ref), ("compass", compass)):
        cells = terrain.aspect(steep, convention).withColumn("critical", terrain.critical_slope(F.col("slope_degrees")))
        for s, a, critical in by_cell(cells, "slope_degrees", "aspect_degrees", "critical").values():
            assert math.isclose(s, slope, abs_tol=1e-9) and math.isclose(a, expected, abs_tol=1e-9)
            assert critical == (slope == 45.0)


@pytest.mark.parametrize("tile", [1, 2, 3, 7, 512])
def test_gradient_equals_numpy_for_any_tile(spark, tile):
    z = np.random.default_rng(3).uniform(1500, 4000, (17, 23))
    dzdy, dzdx = np.gradient(z, 31.0, 29.0)
    found = by_cell(terrain.gradient(grid(spark, z.tolist()), 29.0, 31.0, tile=tile), "dzdx", "dzdy")
    assert len(found) == z.size
    for (r, c), (x, y) in found.items():
        assert math.isclose(x, dzdx[r, c], abs_tol=1e-9) and math.isclose(y, dzdy[r, c], abs_tol=1e-9)


@pytest.mark.parametrize("tile", [2, 512])
def test_gradient_at_holes_is_one_sided(spark, tile):
    z = [[0, 10, 40], [5, 20, 60], [0, 0, None]]
    found = by_cell(
        terrain.gradient(grid(spark, z, skip={(0, 1), (1, 0)}), 10.0, 10.0, tile=tile), "dzdx", "dzdy"
    )
    assert found[(0, 0)] == (None, None)
    assert found[(1, 1)] == (4.0, -2.0)
    assert found[(0, 2)] == (None, 2.0)
    assert found[(1, 2)] == (4.0, 2.0)
    assert found[(2, 1)] == (0.0, -2.0)


def test_horn_weights(spark):
    z = np.random.default_rng(4).uniform(0, 100, (6, 5))
    found = by_cell(terrain.gradient(grid(spark, z.tolist()), 30.0, 30.0, method="horn", tile=2), "dzdx", "dzdy")
    plain = by_cell(terrain.gradient(grid(spark, z.tolist()), 30.0, 30.0), "dzdx", "dzdy")
    w = np.array([1, 2, 1])
    for (r, c), (x, y) in found.items():
        if 0 < r < 5 and 0 < c < 4:
            box = z[r - 1 : r + 2, c - 1 : c + 2]
            assert math.isclose(x, (w @ box[:, 2] - w @ box[:, 0]) / 240, abs_tol=1e-9)
            assert math.isclose(y, (w @ box[2] - w @ box[0]) / 240, abs_tol=1e-9)
        else:
            assert (x, y) == plain[(r, c)]
    with pytest.raises(ValueError):
        terrain.gradient(grid(spark, [[1]]), 1.0, 1.0, method="spline")


def test_gradient_shuffles_once(spark):
    plan = terrain.slope(terrain.gradient(grid(spark, [[1, 2], [3, 4]]), 30.0, 30.0))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1
    assert "BatchEvalPython" not in text


def test_coarsen_counts_every_cell(spark):
    cells = grid(spark, [[r + c for c in range(30)] for r in range(30)]).unionAll(
        grid(spark, [[1.0, 2.0]], zone="small")
    )
    coarse = terrain.coarsen(cells, 3)
    rows = {(r["zone_name"], r["row"], r["col"]): (r["elevation"], r["n_cells"], r["scale"]) for r in coarse.collect()}
    expected = {("z", r, c): (3.0 * r + 3 * c + 2, 9, 90.0) for r in range(10) for c in range(10)}
    assert rows == expected | {("small", 0, 0): (1.5, 2, 90.0)}
    steep = terrain.gradient(coarse.where("zone_name = 'z'"), F.col("scale"), F.col("scale"), tile=4)
    assert all(math.isclose(x, 3 / 90) and math.isclose(y, 3 / 90) for x, y in by_cell(steep, "dzdx", "dzdy").values())


def test_make_grid_has_the_pilot_size(spark):
    zone = config.PILOT_ZONE
    cells = terrain.make_grid(terrain.zones_frame(spark, [zone]))
    row = cells.agg(
        F.count("*"), F.max("row"), F.max("col"), F.min("latitude"), F.max("latitude"), F.max("longitude")
    ).first()
    assert row[:3] == (334 * 334, 333, 333)
    assert terrain.grid_size(zone.bbox) == (334, 334)
    assert math.isclose(row[3], -33.40) and row[4] < -33.30 and row[5] < -70.22
    centre = terrain.distance_km(F.lit(-33.40), F.lit(-70.32), zone.latitude, zone.longitude)
    assert math.isclose(spark.range(1).select(centre).first()[0], math.hypot(0.05 * 111, 0.05 * 85))
    assert math.isclose(terrain.box_area_km2(zone.bbox), 94.35)


def test_mask_keeps_the_bound(spark):
    assert terrain.mask_elevation(grid(spark, [[1999.9, 2000.0, 2000.1]])).count() == 2
    assert terrain.clip(grid(spark, [[1, 2], [3, 4]]), BBox(-33.4, -33.4, -70.3, -70.2)).count() == 2


def test_features_versions(spark):
    z = [[-5.0, 2499.9, 6000.0], [100.0, 2500.0, 6100.0]]
    steep = terrain.aspect(terrain.slope(terrain.gradient(grid(spark, z), 30.0, 30.0)))
    first = terrain.features(steep, "v1").collect()
    second = terrain.features(steep, "v2").collect()
    assert {r["feature_id"][:5] for r in first} == {"topo_"} and len({r["feature_id"] for r in first}) == 6
    assert {r["feature_id"][:4] for r in second} == {"gee_"}
    assert {r["elevation"]: r["elevation_band"] for r in first}[6000] is None
    assert {r["elevation"]: r["elevation_band"] for r in second}[6000] == "Alta"
    assert {r["elevation"]: r["gee_quality_flag"] for r in second}[-5] == 0.5
    # The band is that of the exact elevation, the stored elevation is truncated.
    assert {r["elevation"]: r["elevation_band"] for r in first}[2499] == "Baja"


def test_quality_rules(spark):
    rows = [(None, 95.0, 10.0), (10.0, 91.0, 10.0), (10.0, 10.0, 361.0), (10.0, 90.0, 360.0)]
    cells = spark.createDataFrame(rows, "elevation double, slope_degrees double, aspect_degrees double")
    flagged = terrain.quality_flag(cells)
    assert [r["gee_quality_flag"] for r in flagged.collect()] == [0.0, 0.5, 0.5, 1.0]
    assert terrain.keep_quality(flagged).count() == 1
    assert terrain.keep_quality(cells).count() == 4
    assert terrain.quality_loss(flagged).first() == (4, 1, True)


def test_susceptibility_scores(spark):
    stats = spark.createDataFrame(
        [("z", "Alta", 100, 50, 30.0, 6.0, 1.0, 60.0), ("z", "Baja", 1, 1, 60.0, None, 1.0, 30.0), ("z", "Media-Alta", 10, 10, 90.0, 30.0, 1.0, 30.0)],
        """zone_name string, elevation_band string, total_pixels bigint, critical_pixels bigint, avg_slope_degrees double,
        stddev_slope double, avg_gee_quality double, avg_gee_scale double""",
    )

    def scores(weights, **options):
        return {r["elevation_band"]: r["susceptibility_score"] for r in terrain.susceptibility(stats, weights, **options).collect()}

    v1 = scores(config.SUSCEPTIBILITY_V1)
    assert math.isclose(v1["Alta"], 0.3 + 0.15 + 0.02) and v1["Media-Alta"] == 1.0 and math.isclose(v1["Baja"], 0.9)
    assert scores(config.SUSCEPTIBILITY_V1, null_spread="null")["Baja"] is None
    v2 = scores(config.SUSCEPTIBILITY_V2)
    assert math.isclose(v2["Alta"], 0.25 + 0.15 + 0.03 + 0.05) and math.isclose(v2["Baja"], 0.85)
    assert math.isclose(scores(config.SUSCEPTIBILITY_V2_NO_QUALITY)["Alta"], 0.275 + 0.15 + 0.03)
    area = {r["elevation_band"]: r for r in terrain.areas(stats, F.col("avg_gee_scale") ** 2).collect()}
    assert math.isclose(area["Alta"]["total_area_km2"], 0.36)
    plain = {r["elevation_band"]: r for r in terrain.areas(stats).collect()}
    assert math.isclose(plain["Alta"]["critical_slope_area_km2"], 0.045)


def test_dominant_aspect_and_circular_mean(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 45.0, 135.0, 225.0, 315.0)], "v double")
    assert [r[0] for r in df.select(terrain.dominant_aspect(F.col("v"))).collect()] == ["Norte", "Este", "Sur", "Oeste", "Norte"]
    cells = spark.createDataFrame(
        [("z", "Alta", 350.0), ("z", "Alta", 10.0)], "zone_name string, elevation_band string, aspect_degrees double"
    ).selectExpr("*", "10D AS slope_degrees", "1 AS elevation", "false AS is_critical_slope")
    assert terrain.band_stats(cells).first()["avg_aspect_degrees"] == 180.0
    mean = terrain.band_stats(cells, circular=True).first()["avg_aspect_degrees"]
    assert min(mean, 360 - mean) < 1e-9


def test_map_and_summary(spark):
    rng = random.Random(5)
    z = [[2000 + 60 * r + rng.uniform(-20, 20) for _ in range(12)] for r in range(30)]
    steep = terrain.aspect(terrain.slope(terrain.gradient(grid(spark, z), 60.0, 60.0)))
    cells = terrain.features(steep, "v2")
    table = terrain.susceptibility_table(cells, "v2").cache()
    mapped = terrain.susceptibility_map(cells, table)
    assert mapped.count() == 360 and mapped.where("susceptibility_score is null").count() == 0
    category = bands.risk_category(F.col("susceptibility_score"))
    assert mapped.where(category != F.col("risk_category")).count() == 0
    assert table.where("susceptibility_score < 0 or susceptibility_score > 1").count() == 0
    row = terrain.summary(table).first()
    assert math.isclose(row["total_area_km2"], 360 * 900 / 1e6) and row["avg_gee_quality"] == 1.0
    shares = frames.distribution(mapped, "elevation_band").collect()
    assert math.isclose(sum(r["percentage"] for r in shares), 100, abs_tol=0.05)
    empty = terrain.summary(table.limit(0).drop("avg_gee_quality")).first()
    assert empty["critical_area_percentage"] == 0.0


def test_band_shares_and_area_stats(spark):
    cells = spark.createDataFrame(
        [("Alta", True, 10.0), ("Alta", False, 30.0), ("Baja", False, None), ("Baja", False, 20.0)],
        "elevation_band string, is_critical_slope boolean, slope_degrees double",
    )
    shares = {r["elevation_band"]: r for r in terrain.band_shares(cells).collect()}
    assert shares["Alta"]["share_pct"] == 50.0 and shares["Alta"]["critical_share_pct"] == 25.0
    assert terrain.area_stats(cells, ["slope_degrees"]).first() == (10.0, 30.0, 20.0, 3)


def test_levels_equal_single_grids(spark):
    rows = [("z" if r % 3 else "y", r, c, 1.0 * r, 2.0 * c, r * 7.0 + c) for r in range(-5, 20) for c in range(13)]
    cells = spark.createDataFrame(rows, "zone_name string, row int, col int, latitude double, longitude double, elevation double")
    found = terrain.levels(cells, (1, 2, 4, 8)).cache()
    for factor in (1, 2, 4, 8):
        single = terrain.coarsen(cells, factor)
        part = found.where(f"factor = {factor}").select(*single.columns)
        assert sorted(map(str, part.collect())) == sorted(map(str, single.collect()))
    assert found.agg({"n_cells": "sum"}).first()[0] == 4 * len(rows)


@pytest.mark.parametrize("method,step,tile", [("central", 1, 5), ("horn", 1, 64), ("horn", 2, 7), ("central", 3, 8)])
def test_dense_tiles_equal_windows(spark, method, step, tile):
    rng = random.Random(tile)
    rows = [
        (rng.choice("yz"), r * step, c * step, rng.choice([None, *[rng.uniform(0, 3_000)] * 9]), f"{r}/{c}")
        for r in range(-9, 22) for c in range(-3, 17) if rng.random() < 0.85
    ]
    cells = spark.createDataFrame(rows, "zone_name string, row int, col int, elevation double, at string")
    cells = cells.dropDuplicates(["zone_name", "row", "col"]).cache()
    plain = terrain.gradient(cells, 10.0, 20.0, step, method)
    dense = terrain.gradient_dense(cells, 10.0, 20.0, step, method, tile)
    assert dense.columns == plain.columns and dense.count() == len(rows)
    assert sorted(map(str, dense.collect())) == sorted(map(str, plain.collect()))
    fresh = terrain.gradient_dense(spark.createDataFrame(rows, cells.schema), 10.0, 20.0, step, method, tile)
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan
    with pytest.raises(ValueError):
        terrain.gradient_dense(cells, 1.0, 1.0, method="sobel")
