"""General polygons: rings of points from WKT, GeoJSON and WKB, and exact tests of them against points and boxes.

A polygon, or several, is the array of the edges of all its rings. What is inside is told by the even-odd rule, so holes
and parts need no order and no direction. Everything but WKB, which is bytes, is column arithmetic.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RINGS = T.ArrayType(T.ArrayType(POINT))
GEOJSON = "array<array<array<double>>>"
_NUMBER = r"[-+0-9.eE]+"


def rings_of_wkt(wkt: Column) -> Column:
    """Rings of a POLYGON or MULTIPOLYGON; further ordinates are left out. Other texts, and EMPTY, have no rings; null stays null."""
    kind = F.upper(wkt).rlike(r"^\s*(SRID=\d+;)?\s*(MULTI)?POLYGON")
    texts = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1))
    number = lambda p, i: F.regexp_extract(p, rf"^\s*({_NUMBER})\s+({_NUMBER})", i).cast("double")
    point = lambda p: F.struct(number(p, 1).alias("x"), number(p, 2).alias("y"))
    rings = F.transform(texts, lambda t: F.transform(F.split(t, ","), point))
    return F.when(wkt.isNull(), F.lit(None)).when(kind, rings).otherwise(F.array().cast(RINGS))


def rings_of_geojson(geometry: Column) -> Column:
    """Rings of a Polygon or MultiPolygon (a geometry's JSON text)."""
    kind, text = F.get_json_object(geometry, "$.type"), F.get_json_object(geometry, "$.coordinates")
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    rings = F.when(kind == "Polygon", F.from_json(text, GEOJSON)).when(kind == "MultiPolygon", F.flatten(F.from_json(text, f"array<{GEOJSON}>")))
    return F.when(geometry.isNull(), F.lit(None)).otherwise(F.coalesce(F.transform(rings, lambda r: F.transform(r, point)), F.array().cast(RINGS)))


def _wkb_rings(data: bytes) -> list:
    """Rings of a WKB polygon or multipolygon, of either byte order, with any ordinates (also with an SRID)."""
    at = 0

    def take(form: str) -> tuple:
        nonlocal at
        out = struct.unpack_from(form, data, at)
        at += struct.calcsize(form)
        return out

    def shape() -> list:
        order = "<" if take("B")[0] else ">"
        (kind,) = take(order + "I")
        if kind & 0x20000000:
            take(order + "I")
        ordinates = 2 + bool(kind & 0x80000000) + bool(kind & 0x40000000) + (0, 1, 1, 2)[(kind & 0xFFFF) // 1000]
        (n,) = take(order + "I")
        if kind % 1000 & 0xFF == 6:
            return [ring for _ in range(n) for ring in shape()]
        if kind % 1000 & 0xFF != 3:
            return []
        rings = []
        for _ in range(n):
            (m,) = take(order + "I")
            values = take(f"{order}{m * ordinates}d")
            rings.append([(values[i], values[i + 1]) for i in range(0, len(values), ordinates)])
        return rings

    return shape()


@F.pandas_udf(RINGS)
def rings_of_wkb(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else [[{"x": x, "y": y} for x, y in ring] for ring in _wkb_rings(bytes(b))])


def edges_of(rings: Column) -> Column:
    """Edges (x1, y1, x2, y2) of all rings, closed or not; edges without length are left out."""
    after = lambda r: F.concat(F.slice(r, F.lit(2), F.size(r)), F.slice(r, 1, 1))
    edge = lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))
    each = F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) > 0), lambda r: F.zip_with(r, after(r), edge)))
    return F.filter(each, lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))


def bounds_of(edges: Column) -> list[Column]:
    of = lambda pick, c: pick(F.transform(edges, lambda e: e[c]))
    return [of(F.array_min, "x1").alias("minx"), of(F.array_min, "y1").alias("miny"), of(F.array_max, "x1").alias("maxx"), of(F.array_max, "y1").alias("maxy")]


def inside(x: Column, y: Column, edges: Column) -> Column:
    """Is the point inside, by the even-odd rule? Points on a lower or left edge are."""
    hit = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"])
    return F.size(F.filter(edges, lambda e: F.coalesce(hit(e), F.lit(False)))) % 2 == 1


def edge_meets_box(e: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Does a segment meet a closed box? They are apart only if one's bounds exclude the other, or all corners lie strictly on one side of the segment's line."""
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    sides = [dx * (y - e["y1"]) - dy * (x - e["x1"]) for x in (minx, maxx) for y in (miny, maxy)]
    near = (F.least(e["x1"], e["x2"]) <= maxx) & (F.greatest(e["x1"], e["x2"]) >= minx) & (F.least(e["y1"], e["y2"]) <= maxy) & (F.greatest(e["y1"], e["y2"]) >= miny)
    return near & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)


def meets_box(edges: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Do a polygon and a closed box share a point: an edge meets the box, or the box is inside as a whole?"""
    return F.exists(edges, lambda e: edge_meets_box(e, minx, miny, maxx, maxy)) | inside(minx, miny, edges)


def area_of(edges: Column) -> Column:
    """Area of one polygon with its holes, whose rings run in opposite directions."""
    return F.abs(F.aggregate(edges, F.lit(0.0), lambda a, e: a + e["x1"] * e["y2"] - e["x2"] * e["y1"]) / 2)
