"""Small dimensions of the grid: levels, zones, land-cover legend."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Default levels in metres, finest first.
LEVELS = (300, 600, 1200, 2400, 12000, 120000)
#: Divisor of the level in the longitude margin.
MARGIN = {300: 20, 600: 10, 1200: 8, 2400: 7, 6000: 6, 12000: 5, 120000: 2.5}
#: Origin and extents of UTM zones and of the two polar grids.
UTM_X0, UTM_X1 = 100_000, 900_000
UTM_Y1_NORTH, UTM_Y0_SOUTH = 9_329_005, 10_000_000
POLAR_HALF = 4_500_000
#: Land-cover classes, code and name.
LEGEND = (
    (0, "Open Seas"),
    (10, "Tree Cover"),
    (20, "Shrubland"),
    (30, "Grassland"),
    (40, "Cropland"),
    (50, "Built-up"),
    (60, "Bare/Sparse Vegetation"),
    (70, "Snow and Ice"),
    (80, "Permanent Water Bodies"),
    (90, "Herbaceous Wetland"),
    (95, "Mangroves"),
    (100, "Moss and Lichen"),
)
CODES = tuple(c for c, _ in LEGEND)
#: Climate classes by main group, and potential biomes, code and name.
CLIMATES = {
    "Equatorial": ("Af", "Am", "As", "Aw"),
    "Arid": ("BSh", "BSk", "BWh", "BWk"),
    "Warm Temperate": ("Cfa", "Cfb", "Cfc", "Csa", "Csb", "Csc", "Cwa", "Cwb", "Cwc"),
    "Boreal": ("Dfa", "Dfb", "Dfc", "Dfd", "Dsa", "Dsb", "Dsc", "Dsd", "Dwa", "Dwb", "Dwc", "Dwd"),
    "Polar": ("EF", "ET"),
    "NA": ("NA",),
}
BIOMES = (
    (1, "Trop EG BLF"),
    (2, "Trop Semi EG BLF"),
    (3, "Trop Decid BLF"),
    (4, "Warm-Temp EG BLF"),
    (7, "Cool-Temp RF"),
    (8, "Cool EG NL"),
    (9, "Cool Mixed Forest"),
    (13, "Temp Decid BLF"),
    (14, "Cold Decid Forest"),
    (15, "Cold EG NL"),
    (16, "Temp Sclerophyll"),
    (17, "Temp EG Open WL"),
    (18, "Trop Savanna"),
    (20, "Xerophytic Scrub"),
    (22, "Steppe"),
    (27, "Desert"),
    (28, "Graminoid & FT"),
    (30, "Erect Dwarf ST"),
    (31, "Low&High ST"),
    (32, "Prost Dwarf ST"),
)
#: Least share at which a tile stands for a class, and weights of the progressive targets, in legend order.
THRESHOLDS = (0.80, 0.70, 0.70, 0.65, 0.60, 0.20, 0.60, 0.40, 0.50, 0.40, 0.05, 0.10)
WEIGHTS = (0.25, 1.0, 0.9, 1.1, 1.5, 2.0, 0.9, 1.1, 1.2, 1.5, 2.0, 1.5)
#: Bias of each subset size, in thousands of tiles.
BIAS = {10: 1.5, 25: 1.4, 50: 1.3, 100: 1.2, 250: 1.1, 500: 1.0, 750: 0.9, 1000: 0.8, 1500: 0.7}


def parent_level(level: int, levels: tuple[int, ...] = LEVELS) -> int | None:
    """The next coarser level, if it is a whole multiple."""
    if level not in levels:
        return None
    above = sorted(x for x in levels if x > level)
    return above[0] if above and above[0] % level == 0 else None


def level_table(spark: SparkSession, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """level, super_level, factor: a row per level."""
    rows = [(x, parent_level(x, levels), parent_level(x, levels) // x if parent_level(x, levels) else None) for x in levels]
    return spark.createDataFrame(rows, "level int, super_level int, factor int")


def zone_table(spark: SparkSession) -> DataFrame:
    """zone, zone_num, south, epsg, lon_min, lon_max, lat_min, lat_max, origin_x, origin_y: 120 UTM zones and the two poles."""
    rows = [(f"{z}{h}", z, h == "S", (32600 if h == "N" else 32700) + z, 6.0 * z - 186, 6.0 * z - 180, 0.0 if h == "N" else -80.0, 84.0 if h == "N" else 0.0, UTM_X0, 0 if h == "N" else UTM_Y0_SOUTH) for h in "NS" for z in range(1, 61)]
    rows += [("NP", None, False, 3413, -180.0, 180.0, 84.0, 90.0, -POLAR_HALF, 0), ("SP", None, True, 3031, -180.0, 180.0, -90.0, -80.0, -POLAR_HALF, -POLAR_HALF)]
    return spark.createDataFrame(rows, "zone string, zone_num int, south boolean, epsg int, lon_min double, lon_max double, lat_min double, lat_max double, origin_x bigint, origin_y bigint")
