"""Tiles in degrees: native boxes of any zone or pole brought to WGS84 and put in one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapane.dims import zone_table
from terrapane.functions import projection, tileid
from terrapane.functions.geometry import CORNERS, wkt_bounds
from terrapane.operators.grid import with_corners

CORNER_COLUMNS = tuple(f"{c}{i}" for i in range(4) for c in ("lon", "lat"))


def boxes_from_wkt(df: DataFrame, wkt: str = "utm_footprint", crs: str = "crs") -> DataFrame:
    """df with minx, miny, maxx, maxy and zone rebuilt from its WKT and CRS (EPSG:n) columns; one table of all CRSs, told apart by the column. Other CRSs have a null zone."""
    code = F.regexp_extract(F.col(crs), r"^EPSG:(\d+)$", 1).try_cast("int")
    zone = F.when(code == 3413, "NP").when(code == 3031, "SP")
    for first, side in ((32600, "N"), (32700, "S")):
        zone = F.when(code.between(first + 1, first + 60), F.concat((code - first).cast("string"), F.lit(side))).otherwise(zone)
    return df.select("*", *wkt_bounds(F.col(wkt)), zone.alias("zone"))


def to_wgs84(tiles: DataFrame) -> DataFrame:
    """tiles (zone, minx … maxy and more) with lon0, lat0 … lon3, lat3, the degrees of their corners, and crs, the native one. UTM longitudes go on beyond 180."""
    zones = zone_table(tiles.sparkSession).select("zone", "zone_num", "south")
    rows = tiles.drop("zone_num", "south").join(F.broadcast(zones), "zone").withColumn("crs", tileid.epsg(F.col("zone")))
    out = with_corners(rows.where("zone_num IS NOT NULL"))
    for pole in ("NP", "SP"):
        part = rows.where(F.col("zone") == pole)
        for i, (x, y) in enumerate(CORNERS[:4]):
            part = projection.apply(part, projection.polar_inverse(pole, x, y, lon=f"lon{i}", lat=f"lat{i}"), (f"lon{i}", f"lat{i}"))
        out = out.unionByName(part)
    return out.drop("zone_num", "south")


def wkt_degrees() -> Column:
    """The corners as a POLYGON in degrees, six decimals."""
    points = [F.format_string("%.6f %.6f", F.col(f"lon{i % 4}"), F.col(f"lat{i % 4}")) for i in range(5)]
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *points), F.lit("))"))


def write_wgs84(tiles: DataFrame, path: str, mode: str = "error") -> None:
    """One table of all zones with its geometry in degrees and its native CRS as a column."""
    to_wgs84(tiles).withColumn("geometry", wkt_degrees()).drop(*CORNER_COLUMNS).write.mode(mode).parquet(path)


def merge_files(tiles_by_file: DataFrame, path: str, mode: str = "error") -> None:
    """Grid files of any levels and zones, read as one table (files.read_tables), merged to one WGS84 table without repeated tiles: of rows of one tile_id, that with the smallest hash of all columns stays."""
    one = tiles_by_file.groupBy("tile_id").agg(F.min_by(F.struct(*tiles_by_file.columns), F.xxhash64(*tiles_by_file.columns)).alias("row"))
    write_wgs84(one.select("row.*"), path, mode)
