"""Points and boxes to tiles: equi-joins on computed keys in place of spatial predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapane.dims import POLAR_HALF, UTM_X0, UTM_Y0_SOUTH
from terrapane.functions import polygons, projection, tileid
from terrapane.operators.grid import met


def with_zone(points: DataFrame) -> DataFrame:
    """Adds zone_num, south, zone, origin_y for points (lon, lat)."""
    number = F.greatest(F.lit(1), F.least(F.lit(60), F.floor((F.col("lon") + 180) / 6).cast("int") + 1))
    out = points.withColumn("zone_num", number).withColumn("south", F.col("lat") < 0)
    return out.withColumn("zone", F.concat(F.col("zone_num").cast("string"), F.when(F.col("south"), "S").otherwise("N"))).withColumn("origin_y", F.when(F.col("south"), UTM_Y0_SOUTH).otherwise(0))


def points_to_tiles(points: DataFrame, level: int) -> DataFrame:
    """Adds easting, northing, level, x_idx, y_idx, tile_id. Half-open tiles: a point on an edge has the tile to its upper right."""
    out = projection.apply(with_zone(points), projection.utm_forward())
    out = out.withColumn("level", F.lit(level)).withColumn("x_idx", tileid.floor_div(F.col("easting") - UTM_X0, level)).withColumn("y_idx", tileid.floor_div(F.col("northing") - F.col("origin_y"), level))
    return out.withColumn("tile_id", tileid.format_id(F.col("level"), F.col("zone"), F.col("x_idx"), F.col("y_idx")))


def points_to_polar_tiles(points: DataFrame, level: int) -> DataFrame:
    """The same for latitudes beyond the UTM zones, on the polar grids."""
    out = []
    for pole, test, y0 in (("NP", F.col("lat") >= 0, 0), ("SP", F.col("lat") < 0, -POLAR_HALF)):
        each = projection.apply(points.where(test), projection.polar_forward(pole)).withColumn("zone", F.lit(pole)).withColumn("level", F.lit(level))
        out.append(each.withColumn("x_idx", tileid.floor_div(F.col("easting") + POLAR_HALF, level)).withColumn("y_idx", tileid.floor_div(F.col("northing") - y0, level)))
    both = out[0].unionByName(out[1])
    return both.withColumn("tile_id", tileid.format_id(F.col("level"), F.col("zone"), F.col("x_idx"), F.col("y_idx")))


def assign_tiles(points: DataFrame, tiles: DataFrame, level: int) -> DataFrame:
    """points left-joined with tiles (tile_id, …) of the level on the tile that holds them; null where the table lacks it."""
    held = points_to_tiles(points, level).withColumnRenamed("tile_id", "own_tile")
    right = tiles.select(F.col("tile_id"), *(c for c in tiles.columns if c != "tile_id"))
    return held.join(right, F.col("own_tile") == F.col("tile_id"), "left")


def boxes_in_polygons(shapes: DataFrame, boxes: DataFrame, cell: float, shape_id: str, box_id: str, whole: bool = False) -> DataFrame:
    """shape_id, box_id: boxes (box_id, minx … maxy) that a polygon (shape_id, edges) meets and whose centre is within it (a box shares its centre with the polygon then, so that this is the one test); with whole, those that lie in it with all corners and that no edge meets. Bounds, or centres, meet in coarse cells by an equi-join, and the exact tests see only pairs of overlapping bounds, where these meet: no pair is shuffled."""
    # through generators of one row, so that edges and bounds are made once and filters on them are not written out below
    bounded = shapes.select(shape_id, F.inline(F.array(F.struct("edges"))))
    bounded = bounded.select(shape_id, "edges", F.inline(F.array(F.struct(*polygons.bounds_of(F.col("edges"))))))
    edges = F.col("a_edges")
    if whole:
        right = boxes.select(box_id, "minx", "miny", "maxx", "maxy")
        box = [F.col(f"b_{c}") for c in ("minx", "miny", "maxx", "maxy")]
        corners = [polygons.inside(x, y, edges) for x in (box[0], box[2]) for y in (box[1], box[3])]
        test = ~F.exists(edges, lambda e: polygons.edge_meets_box(e, *box)) & corners[0] & corners[1] & corners[2] & corners[3]
    else:
        x, y = (F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2
        right = boxes.select(box_id, x.alias("minx"), y.alias("miny"), x.alias("maxx"), y.alias("maxy"))
        test = polygons.inside(F.col("b_minx"), F.col("b_miny"), edges)
    return met(bounded, right, cell, test).select(F.col(f"a_{shape_id}").alias(shape_id), F.col(f"b_{box_id}").alias(box_id))
