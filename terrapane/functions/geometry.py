"""Boxes as four doubles, and their text and binary forms."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORNERS = (("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy"), ("minx", "miny"))


def box_columns(x: Column, y: Column, level: Column, buffer: Column | int = 0) -> list[Column]:
    return [(x - buffer).alias("minx"), (y - buffer).alias("miny"), (x + level + buffer).alias("maxx"), (y + level + buffer).alias("maxy")]


def centroid() -> list[Column]:
    return [((F.col("minx") + F.col("maxx")) / 2).alias("centroid_x"), ((F.col("miny") + F.col("maxy")) / 2).alias("centroid_y")]


def area() -> Column:
    return (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))


def wkt_polygon() -> Column:
    """POLYGON of minx, miny, maxx, maxy, counter-clockwise, one decimal."""
    points = [F.format_string("%.1f %.1f", F.col(a).cast("double"), F.col(b).cast("double")) for a, b in CORNERS]
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *points), F.lit("))"))


def wkt_point(x: Column, y: Column) -> Column:
    return F.format_string("POINT (%.6f %.6f)", x, y)


def wkt_bounds(wkt: Column) -> list[Column]:
    """Bounds of any WKT of plain coordinate pairs."""
    xs = F.transform(F.regexp_extract_all(wkt, F.lit(r"(-?[0-9.]+) (-?[0-9.]+)"), F.lit(1)), lambda v: v.cast("double"))
    ys = F.transform(F.regexp_extract_all(wkt, F.lit(r"(-?[0-9.]+) (-?[0-9.]+)"), F.lit(2)), lambda v: v.cast("double"))
    return [F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy")]


@F.pandas_udf(T.BinaryType())
def wkb_polygon(minx: pd.Series, miny: pd.Series, maxx: pd.Series, maxy: pd.Series) -> pd.Series:
    """Little-endian WKB; Spark's own geometry functions only wrap such bytes."""
    form = struct.Struct("<BIII10d")
    return pd.Series([form.pack(1, 3, 1, 5, a, b, c, b, c, d, a, d, a, b) for a, b, c, d in zip(minx, miny, maxx, maxy, strict=True)])


def boxes_overlap(a: str, b: str) -> Column:
    """Closed overlap of the boxes with prefixes a and b."""
    return (F.col(f"{a}minx") <= F.col(f"{b}maxx")) & (F.col(f"{a}maxx") >= F.col(f"{b}minx")) & (F.col(f"{a}miny") <= F.col(f"{b}maxy")) & (F.col(f"{a}maxy") >= F.col(f"{b}miny"))


def in_polygon(x: Column, y: Column, points: Column) -> Column:
    """Ray casting over an array of struct(x, y), closed or not: is the point inside?"""
    edges = F.zip_with(points, F.concat(F.slice(points, 2, 1_000_000), F.slice(points, 1, 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    hit = lambda e: ((e["p"]["y"] > y) != (e["q"]["y"] > y)) & (x < (e["q"]["x"] - e["p"]["x"]) * (y - e["p"]["y"]) / F.nullif(e["q"]["y"] - e["p"]["y"], F.lit(0.0)) + e["p"]["x"])
    return F.size(F.filter(edges, lambda e: F.coalesce(hit(e), F.lit(False)))) % 2 == 1


def within_polygon(x: Column, y: Column, points: Column) -> Column:
    """The same without the boundary: a point on an edge or a corner is not within."""
    edges = F.zip_with(points, F.concat(F.slice(points, 2, 1_000_000), F.slice(points, 1, 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    between = lambda v, a, b: (v >= F.least(a, b)) & (v <= F.greatest(a, b))
    on = lambda p, q: ((q["x"] - p["x"]) * (y - p["y"]) == (q["y"] - p["y"]) * (x - p["x"])) & between(x, p["x"], q["x"]) & between(y, p["y"], q["y"])
    return in_polygon(x, y, points) & ~F.exists(edges, lambda e: on(e["p"], e["q"]))


def within_corners(x: Column, y: Column, corners: list[tuple[Column, Column]]) -> Column:
    """within_polygon for a known number of corners: few steps of plain arithmetic, which Spark compiles as it does not functions over arrays. x, y and corners should be columns, as each is written out several times."""
    crossed, on = F.lit(False), F.lit(False)
    for (px, py), (qx, qy) in zip(corners, [*corners[1:], corners[0]], strict=True):
        side = (qx - px) * (y - py) - (x - px) * (qy - py)  # beyond 0: the point is to the left of an edge that goes up
        crossed = crossed != (((py > y) != (qy > y)) & (F.when(qy > py, side).otherwise(-side) > 0))
        on = on | ((side == 0) & ((px - x) * (qx - x) + (py - y) * (qy - y) <= 0))
    return crossed & ~on
