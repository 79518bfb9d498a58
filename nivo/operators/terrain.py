"""Terrain: elevation cells to slope, aspect, susceptibility per band and the cell map.

A cell table has one row per grid cell: ``zone_name, row, col, latitude, longitude,
elevation`` and optionally ``scale`` (metres per cell side). Row 0 is the southern edge.
"""

from __future__ import annotations

from collections.abc import Sequence

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from nivo import config
from nivo.config import BBox, SusceptibilityWeights
from nivo.functions import bands, keys
from nivo.operators import filters

ZONE_BAND = ["zone_name", "elevation_band"]


# --- Grids -------------------------------------------------------------------------------


def zones_frame(spark: SparkSession, zones: list[config.Zone]) -> DataFrame:
    """Zones with their boxes as a frame, the input of :func:`make_grid`."""
    rows = [(z.name, z.bbox.south, z.bbox.north, z.bbox.west, z.bbox.east) for z in zones]
    schema = "zone_name string, south double, north double, west double, east double"
    return spark.createDataFrame(rows, schema)


def make_grid(zones: DataFrame, step: float = config.GRID_STEP_DEG) -> DataFrame:
    """Regular grid over each zone's box, half-open at north and east.

    Grid rows are spread over the cluster before they are expanded to cells, so one huge
    zone is generated by many tasks.
    """

    def count(low: str, high: str) -> Column:
        return F.ceil((F.col(high) - F.col(low)) / step).cast("int")

    def indices(n: Column) -> Column:
        return F.when(n > 0, F.sequence(F.lit(0), n - 1))

    lines = zones.select(
        "zone_name",
        "south",
        "west",
        indices(count("west", "east")).alias("_cols"),
        F.explode(indices(count("south", "north"))).alias("row"),
    ).repartition("zone_name", "row")
    return lines.select("zone_name", "south", "west", "row", F.explode("_cols").alias("col")).select(
        "zone_name",
        "row",
        "col",
        (F.col("south") + F.col("row") * step).alias("latitude"),
        (F.col("west") + F.col("col") * step).alias("longitude"),
    )


def box_area_km2(bbox: BBox) -> float:
    """Area of a box with fixed 111 and 85 km per degree."""
    return abs(bbox.north - bbox.south) * abs(bbox.east - bbox.west) * 111 * 85


def box_area(south: Column, north: Column, west: Column, east: Column) -> Column:
    return F.abs(north - south) * F.abs(east - west) * 111 * 85


def distance_km(lat: Column, lon: Column, lat0: float | Column, lon0: float | Column) -> Column:
    """Distance to a centre with fixed 111 and 85 km per degree."""
    north, east = (lat - lat0) * 111, (lon - lon0) * 85
    return F.sqrt(north * north + east * east)


def clip(cells: DataFrame, bbox: BBox) -> DataFrame:
    return filters.in_bbox(cells, bbox)


def mask_elevation(cells: DataFrame, min_m: float = config.MIN_ELEVATION_M) -> DataFrame:
    return cells.where(F.col("elevation") >= min_m)


def coarsen(cells: DataFrame, factor: int, base_scale: float = config.BASE_SCALE_M) -> DataFrame:
    """A grid ``factor`` times as coarse: each block of ``factor`` by ``factor`` cells becomes one.

    Position and elevation are the means of the block's cells, so that every cell counts;
    ``n_cells`` holds how many there were, and ``scale`` becomes ``base_scale * factor``.
    """
    block = [F.floor(F.col(name) / factor).cast("int").alias(name) for name in ("row", "col")]
    means = [F.avg(name).alias(name) for name in ("latitude", "longitude", "elevation")]
    return (
        cells.groupBy("zone_name", *block)
        .agg(*means, F.count(F.lit(1)).alias("n_cells"))
        .withColumn("scale", F.lit(float(base_scale * factor)))
    )


def levels(cells: DataFrame, factors: Sequence[int], base_scale: float = config.BASE_SCALE_M) -> DataFrame:
    """The grids of several factors (see :func:`coarsen`) from one aggregation, told apart by ``factor``.

    Each cell is counted in one block per level; blocks of all levels are combined in the map tasks and shuffled once.
    """
    factors = sorted(set(factors))
    blocks = {f: [F.floor(F.col(name) / f).cast("int") for name in ("row", "col")] for f in factors}
    numbered = cells.select(
        "zone_name",
        "latitude",
        "longitude",
        "elevation",
        *[block.alias(f"_{name}{f}") for f in factors for block, name in zip(blocks[f], ("row", "col"))],
    )
    sets = [["zone_name", f"_row{f}", f"_col{f}"] for f in factors]
    means = [F.avg(name).alias(name) for name in ("latitude", "longitude", "elevation")]
    places = [c for keys_ in sets for c in keys_[1:]]
    # grouping() is 0 for the columns of a row's own level.
    own = F.coalesce(*[F.when(F.col(f"_without{f}") == 0, F.lit(f)) for f in factors])
    grouped = numbered.groupingSets([[F.col(c) for c in keys_] for keys_ in sets], "zone_name", *places).agg(
        *means, F.count(F.lit(1)).alias("n_cells"), *[F.grouping(f"_row{f}").alias(f"_without{f}") for f in factors]
    )

    def of_level(name: str) -> Column:
        return F.coalesce(*[F.when(F.col("factor") == f, F.col(f"_{name}{f}")) for f in factors]).alias(name)

    return grouped.withColumn("factor", own).select(
        "zone_name",
        "factor",
        of_level("row"),
        of_level("col"),
        "latitude",
        "longitude",
        "elevation",
        "n_cells",
        (F.lit(float(base_scale)) * F.col("factor")).alias("scale"),
    )


# --- Slope and aspect --------------------------------------------------------------------


def gradient(
    cells: DataFrame,
    dx: float | Column,
    dy: float | Column,
    step: int | Column = 1,
    method: str = "central",
    tile: int = 512,
) -> DataFrame:
    """Add ``dzdx`` and ``dzdy`` (rise per metre eastwards and northwards).

    Central differences, one-sided where a neighbour is missing (grid edge, masked or
    NULL), NULL where both are. ``dx`` and ``dy`` are the metres between neighbours,
    ``step`` the index distance between them.
    ``method="horn"`` uses the 3x3 weighted form where all eight neighbours exist.

    Cells are grouped in square tiles and the few cells on a tile's border are copied to
    the tiles that need them, so one shuffle serves both directions and no task holds more
    than a tile at a time, however large the zone.
    """
    step = step if isinstance(step, Column) else F.lit(step)
    tiled = _with_halo(cells, step, tile).repartition("zone_name", "_tile_row", "_tile_col")
    tile_key = ["zone_name", "_tile_row", "_tile_col"]
    along = Window.partitionBy(*tile_key, "row").orderBy("col")
    across = Window.partitionBy(*tile_key, "col").orderBy("row")

    def near(col: str, index: str, window, offset: int) -> Column:
        """Value one step back or ahead; NULL when the row found is not that neighbour."""
        found = F.lag(index, offset).over(window) == F.col(index) - step * offset
        return F.when(found, F.lag(col, offset).over(window))

    tiled = tiled.withColumns(
        {"_w": near("elevation", "col", along, 1), "_e": near("elevation", "col", along, -1)}
    )
    vertical = {"_s": near("elevation", "row", across, 1), "_n": near("elevation", "row", across, -1)}
    if method == "horn":
        vertical |= {
            f"_{ns}{we}": near(f"_{we}", "row", across, offset)
            for ns, offset in (("s", 1), ("n", -1))
            for we in ("w", "e")
        }
    elif method != "central":
        raise ValueError(f"method must be 'central' or 'horn', not {method!r}")
    tiled = tiled.withColumns(vertical).where(
        (F.floor(F.col("row") / tile) == F.col("_tile_row"))
        & (F.floor(F.col("col") / tile) == F.col("_tile_col"))
    )
    return _gradients(tiled, cells.columns, dx, dy, method)


def gradient_dense(
    cells: DataFrame,
    dx: float | Column,
    dy: float | Column,
    step: int = 1,
    method: str = "central",
    tile: int = 64,
) -> DataFrame:
    """What :func:`gradient` gives, from one dense array of elevations per tile.

    A tile with its border is gathered by one aggregation and laid out as a square array, absent cells as NULL;
    a cell finds its neighbours by their index. There is one shuffle, by tile, and no sort of rows: it is the shorter
    plan for grids that are mostly full, while :func:`gradient` moves less where few cells of a
    tile exist. A group holds ``(tile + 2 * step) ** 2`` cells at most; of cells given twice either may be the neighbour.
    """
    if method not in ("central", "horn"):
        raise ValueError(f"method must be 'central' or 'horn', not {method!r}")
    width = tile + 2 * step
    tiled = _with_halo(cells, F.lit(step), tile)
    in_row, in_col = (F.col(n) - F.col(f"_tile_{n}") * tile + step for n in ("row", "col"))
    own = (F.floor(F.col("row") / tile) == F.col("_tile_row")) & (F.floor(F.col("col") / tile) == F.col("_tile_col"))
    cell = F.struct(
        (in_row * width + in_col).cast("int").alias("at"),
        F.col("elevation").alias("z"),
        F.when(own, F.struct(*[F.col(f"`{c}`") for c in cells.columns])).alias("cell"),
    )
    tiles = tiled.groupBy("zone_name", "_tile_row", "_tile_col").agg(F.collect_list(cell).alias("_cells"))
    everywhere = F.sequence(F.lit(0), F.lit(width * width - 1))
    absent = F.array_except(everywhere, F.transform("_cells", lambda c: c["at"]))
    no_height = F.lit(None).cast(cells.schema["elevation"].dataType)
    heights = F.concat(
        F.transform("_cells", lambda c: F.struct(c["at"].alias("at"), c["z"].alias("z"))),
        F.transform(absent, lambda at: F.struct(at.alias("at"), no_height.alias("z"))),
    )
    laid = tiles.select("_cells", F.sort_array(heights).alias("_sorted"))
    single = F.filter("_sorted", lambda c, i: (i == 0) | (F.get("_sorted", i - 1)["at"] != c["at"]))
    dense = laid.select("_cells", F.transform(single, lambda c: c["z"]).alias("_heights"))

    def near(c: Column, north: int, east: int) -> Column:
        return F.get("_heights", c["at"] + (north * width + east) * step)

    around = {"w": (0, -1), "e": (0, 1), "s": (-1, 0), "n": (1, 0)}
    if method == "horn":
        around |= {"sw": (-1, -1), "se": (-1, 1), "nw": (1, -1), "ne": (1, 1)}
    found = F.transform(
        F.filter("_cells", lambda c: c["cell"].isNotNull()),
        lambda c: F.struct(c["cell"].alias("_cell"), *[near(c, *to).alias(f"_{n}") for n, to in around.items()]),
    )
    rows = dense.select(F.inline(found))
    return _gradients(rows.select("_cell.*", *[f"_{n}" for n in around]), cells.columns, dx, dy, method)


def _gradients(near: DataFrame, columns: list[str], dx: float | Column, dy: float | Column, method: str) -> DataFrame:
    """Differences of cells that carry the elevations of their neighbours."""
    dzdx = _difference(F.col("_w"), F.col("elevation"), F.col("_e"), dx)
    dzdy = _difference(F.col("_s"), F.col("elevation"), F.col("_n"), dy)
    if method == "horn":
        east = F.col("_ne") + F.col("_e") * 2 + F.col("_se")
        west = F.col("_nw") + F.col("_w") * 2 + F.col("_sw")
        north = F.col("_nw") + F.col("_n") * 2 + F.col("_ne")
        south = F.col("_sw") + F.col("_s") * 2 + F.col("_se")
        # The sums are NULL unless all eight neighbours exist.
        full = (east + west + north + south).isNotNull()
        dzdx = F.when(full, (east - west) / (dx * 8)).otherwise(dzdx)
        dzdy = F.when(full, (north - south) / (dy * 8)).otherwise(dzdy)
    return near.select(*columns, dzdx.alias("dzdx"), dzdy.alias("dzdy"))


def _with_halo(cells: DataFrame, step: Column, tile: int) -> DataFrame:
    """Each cell once per tile that holds it or one of its eight neighbours."""

    def tile_of(row: str, col: str) -> str:
        return f"struct(floor({row} / {tile}) AS _tile_row, floor({col} / {tile}) AS _tile_col)"

    def inner(index: str) -> str:
        return f"pmod({index}, {tile}) >= _step AND pmod({index}, {tile}) < {tile} - _step"

    around = ", ".join(tile_of(f"(row {r})", f"(col {c})") for r in _SHIFTS for c in _SHIFTS)
    tiles = F.expr(
        f"""CASE WHEN {inner("row")} AND {inner("col")} THEN array({tile_of("row", "col")})
        ELSE array_distinct(array({around})) END"""
    )
    tiled = cells.withColumn("_step", step).withColumn("_tile", F.explode(tiles))
    return tiled.select(*cells.columns, "_tile.*")


_SHIFTS = ("- _step", "", "+ _step")


def _difference(before: Column, here: Column, after: Column, spacing: float | Column) -> Column:
    return (
        F.when(before.isNotNull() & after.isNotNull(), (after - before) / (spacing * 2))
        .when(after.isNotNull(), (after - here) / spacing)
        .when(before.isNotNull(), (here - before) / spacing)
    )


def slope(df: DataFrame) -> DataFrame:
    """Add ``slope_degrees`` from the gradient."""
    steep = F.sqrt(F.col("dzdx") * F.col("dzdx") + F.col("dzdy") * F.col("dzdy"))
    return df.withColumn("slope_degrees", F.degrees(F.atan(steep)))


def aspect(df: DataFrame, convention: str = "ref") -> DataFrame:
    """Add ``aspect_degrees`` in [0, 360); flat cells get 0.

    ``"ref"`` is atan2(-dzdx, dzdy), in which north and south are exchanged;
    ``"compass"`` is the bearing of the downhill direction.
    """
    if convention not in ("ref", "compass"):
        raise ValueError(f"convention must be 'ref' or 'compass', not {convention!r}")
    north = F.col("dzdy") if convention == "ref" else -F.col("dzdy")
    bearing = F.pmod(F.degrees(F.atan2(-F.col("dzdx"), north)) + 360, F.lit(360.0))
    flat = (F.col("dzdx") == 0) & (F.col("dzdy") == 0)
    return df.withColumn("aspect_degrees", F.when(flat, 0.0).otherwise(bearing))


def critical_slope(
    degrees: Column, low: float = config.CRITICAL_SLOPE_MIN, high: float = config.CRITICAL_SLOPE_MAX
) -> Column:
    return degrees.between(low, high)


# --- Feature tables ----------------------------------------------------------------------


def features(cells: DataFrame, version: str = "v1") -> DataFrame:
    """Feature table of cells that carry slope and aspect.

    v1: ``topo_`` keys, cells outside every band have a NULL band. v2: ``gee_`` keys, such
    cells fall in the last band, and scale and quality flag are kept.
    """
    if version not in ("v1", "v2"):
        raise ValueError(f"version must be 'v1' or 'v2', not {version!r}")
    first = version == "v1"
    named = cells.withColumns(
        {
            "feature_id": F.concat(
                F.lit("topo_" if first else "gee_"),
                keys.row_key(F.col("zone_name"), F.col("row"), F.col("col")),
            ),
            "elevation_band": bands.elevation_band(F.col("elevation"), outside="null" if first else "last"),
            "is_critical_slope": F.coalesce(critical_slope(F.col("slope_degrees")), F.lit(False)),
        }
    )
    columns = [
        "feature_id",
        "latitude",
        "longitude",
        F.col("elevation").cast("int").alias("elevation"),
        "slope_degrees",
        "aspect_degrees",
        "elevation_band",
        "is_critical_slope",
        "zone_name",
    ]
    if not first:
        named = quality_flag(named)
        scale = F.col("scale") if "scale" in cells.columns else F.lit(config.BASE_SCALE_M)
        columns += [scale.cast("double").alias("gee_scale"), "gee_quality_flag"]
    return named.select(*columns)


def quality_flag(cells: DataFrame) -> DataFrame:
    """Add ``gee_quality_flag``: 0 without elevation, 0.5 out of range, else 1."""
    out_of_range = (
        (F.col("elevation") < 0) | (F.col("slope_degrees") > 90) | (F.col("aspect_degrees") > 360)
    )
    flag = F.when(F.col("elevation").isNull(), 0.0).when(out_of_range, 0.5).otherwise(1.0)
    return cells.withColumn("gee_quality_flag", flag)


def keep_quality(cells: DataFrame, min_flag: float = config.HIGH_QUALITY) -> DataFrame:
    """Cells of high quality; a frame without the flag passes unchanged."""
    if "gee_quality_flag" not in cells.columns:
        return cells
    return cells.where(F.col("gee_quality_flag") >= min_flag)


def quality_loss(cells: DataFrame, min_flag: float = config.HIGH_QUALITY) -> DataFrame:
    """What :func:`keep_quality` drops, with a warning flag above one half."""
    kept = F.count_if(F.col("gee_quality_flag") >= min_flag)
    return cells.agg(F.count("*").alias("total"), kept.alias("kept")).select(
        "total", "kept", (F.col("kept") < F.col("total") * 0.5).alias("warning")
    )


# --- Susceptibility ----------------------------------------------------------------------


def band_stats(df: DataFrame, by: list[str] = ZONE_BAND, circular: bool = False) -> DataFrame:
    """Slope, elevation and aspect statistics per group, quality and scale if present.

    ``circular`` replaces the arithmetic mean of the aspect by the mean direction.
    """
    if circular:
        angle = F.radians("aspect_degrees")
        mean_angle = F.degrees(F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle))))
        avg_aspect = F.pmod(mean_angle + 360, F.lit(360.0))
    else:
        avg_aspect = F.avg("aspect_degrees")
    stats = [
        F.count("*").alias("total_pixels"),
        F.count_if("is_critical_slope").alias("critical_pixels"),
        F.avg("slope_degrees").alias("avg_slope_degrees"),
        F.avg("elevation").alias("avg_elevation"),
        avg_aspect.alias("avg_aspect_degrees"),
        F.stddev("slope_degrees").alias("stddev_slope"),
        F.min("slope_degrees").alias("min_slope"),
        F.max("slope_degrees").alias("max_slope"),
        F.min("elevation").alias("min_elevation"),
        F.max("elevation").alias("max_elevation"),
    ]
    if "gee_quality_flag" in df.columns:
        stats.append(F.avg("gee_quality_flag").alias("avg_gee_quality"))
    if "gee_scale" in df.columns:
        stats.append(F.avg("gee_scale").alias("avg_gee_scale"))
    return df.groupBy(*by).agg(*stats)


def susceptibility(
    stats: DataFrame,
    weights: SusceptibilityWeights = config.SUSCEPTIBILITY_V1,
    null_spread: str = "zero",
) -> DataFrame:
    """Add ``susceptibility_score`` in [0, 1] to the band statistics.

    A one-cell group has no standard deviation: ``null_spread="zero"`` counts it as 0,
    ``"null"`` leaves the score NULL.
    """
    spread = F.col("stddev_slope")
    if null_spread == "zero":
        spread = F.coalesce(spread, F.lit(0.0))
    score = (
        F.col("critical_pixels") / F.col("total_pixels") * weights.critical
        + F.col("avg_slope_degrees") / weights.slope_norm * weights.slope
        + spread / weights.spread_norm * weights.spread
    )
    if weights.quality:
        score = score + F.col("avg_gee_quality") * weights.quality
    scored = stats.withColumn("susceptibility_score", score)
    capped = F.when(F.col("susceptibility_score") > 1.0, 1.0).otherwise(F.col("susceptibility_score"))
    return scored.withColumn("susceptibility_score", capped)


def dominant_aspect(degrees: Column) -> Column:
    cuts = [(45, "Norte"), (135, "Este"), (225, "Sur"), (315, "Oeste")]
    return bands.steps(degrees, cuts, "Norte", Column.__lt__)


def areas(stats: DataFrame, cell_m2: float | Column = config.CELL_AREA_M2) -> DataFrame:
    """Add total and critical area in km2 from cell counts."""
    return stats.withColumns(
        {
            "total_area_km2": (F.col("total_pixels") * cell_m2 / 1_000_000).cast("double"),
            "critical_slope_area_km2": (F.col("critical_pixels") * cell_m2 / 1_000_000).cast("double"),
        }
    )


def susceptibility_table(cells: DataFrame, version: str = "v1", data_source: str = "grid") -> DataFrame:
    """Feature cells to the susceptibility row of every zone and band, in one aggregation."""
    stats = band_stats(cells)
    if version == "v1":
        scored = areas(susceptibility(stats, config.SUSCEPTIBILITY_V1))
        extra_front, extra_back = [], []
    elif version == "v2":
        has_quality = "gee_quality_flag" in cells.columns
        weights = config.SUSCEPTIBILITY_V2 if has_quality else config.SUSCEPTIBILITY_V2_NO_QUALITY
        has_scale = "gee_scale" in cells.columns
        cell_m2 = F.col("avg_gee_scale") * F.col("avg_gee_scale") if has_scale else config.CELL_AREA_M2
        scored = areas(susceptibility(stats, weights), cell_m2)
        extra_front = ["min_elevation", "max_elevation", "avg_elevation"]
        extra_back = [c for c in ("avg_gee_quality", "avg_gee_scale") if c in stats.columns]
        extra_back.append(F.lit(data_source).alias("data_source"))
    else:
        raise ValueError(f"version must be 'v1' or 'v2', not {version!r}")
    return scored.select(
        keys.zone_id(F.col("zone_name"), F.col("elevation_band")).alias("zone_id"),
        *ZONE_BAND,
        *extra_front,
        "total_area_km2",
        "critical_slope_area_km2",
        "susceptibility_score",
        dominant_aspect(F.col("avg_aspect_degrees")).alias("dominant_aspect"),
        "avg_slope_degrees",
        *extra_back,
    )


#: Places over which the cells of one zone and band are dealt for the join of the map.
SALTS = 16


def susceptibility_map(cells: DataFrame, table: DataFrame) -> DataFrame:
    """Every feature cell with the score and risk category of its zone and band.

    The table has one row per zone and band. Read it from storage, as ``plans.run`` does,
    and Catalyst knows its size: small ones are broadcast and the cells stay in place. Where it is
    shuffled, each of its rows goes to ``SALTS`` places and the cells of a zone and band are
    dealt over these.
    """
    second = "gee_quality_flag" in cells.columns
    columns = ["susceptibility_score"] + (["data_source"] if "data_source" in table.columns else [])
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    spread = table.select(*ZONE_BAND, *columns, salts.alias("_salt"))
    dealt = cells.withColumn("_salt", F.pmod(F.xxhash64("feature_id"), F.lit(SALTS)).cast("int"))
    joined = dealt.join(spread, [*ZONE_BAND, "_salt"], "left")
    extra = ["gee_quality_flag"] if second else []
    return joined.select(
        keys.grid_id(F.col("feature_id"), 5 if second else 6).alias("grid_id"),
        "zone_name",
        "latitude",
        "longitude",
        "elevation",
        "elevation_band",
        "slope_degrees",
        "aspect_degrees",
        *(["is_critical_slope", *extra] if second else []),
        "susceptibility_score",
        bands.risk_category(F.col("susceptibility_score")).alias("risk_category"),
        *columns[1:],
    )


def summary(table: DataFrame) -> DataFrame:
    """One row over a susceptibility table: areas, critical share, scores, high-risk bands."""
    total, critical = F.sum("total_area_km2"), F.sum("critical_slope_area_km2")
    columns = [
        total.alias("total_area_km2"),
        critical.alias("critical_area_km2"),
        F.when(total > 0, critical / total * 100).otherwise(0.0).alias("critical_area_percentage"),
        F.max("susceptibility_score").alias("max_susceptibility"),
        F.avg("susceptibility_score").alias("avg_susceptibility"),
        F.count_if(F.col("susceptibility_score") >= config.HIGH_SUSCEPTIBILITY).alias("high_risk_zones"),
    ]
    if "avg_gee_quality" in table.columns:
        columns.append(F.avg("avg_gee_quality").alias("avg_gee_quality"))
    return table.agg(*columns)


def area_stats(cells: DataFrame, columns=("elevation", "slope_degrees", "aspect_degrees")) -> DataFrame:
    """Minimum, maximum, mean and non-NULL count of each column, in one row."""
    return cells.agg(
        *[
            f(c).alias(f"{c}_{name}")
            for c in columns
            for name, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("count", F.count))
        ]
    )


def band_shares(cells: DataFrame) -> DataFrame:
    """Cells and critical cells per band with the band's percentage of all cells."""
    counts = cells.groupBy("elevation_band").agg(
        F.count("*").alias("total_pixels"), F.count_if("is_critical_slope").alias("critical_pixels")
    )
    total = counts.agg(F.sum("total_pixels")).scalar()
    return counts.withColumns(
        {
            "share_pct": F.col("total_pixels") / total * 100,
            "critical_share_pct": F.col("critical_pixels") / total * 100,
        }
    )


def degrees_to_metres(step: float) -> tuple[float, float]:
    """(dx, dy) in metres of a grid step in degrees, with the fixed metres per degree."""
    return step * config.METRES_PER_DEG_LON, step * config.METRES_PER_DEG_LAT


def grid_size(bbox: BBox, step: float = config.GRID_STEP_DEG) -> tuple[int, int]:
    """Rows and columns :func:`make_grid` produces for a box."""
    return math.ceil((bbox.north - bbox.south) / step), math.ceil((bbox.east - bbox.west) / step)
