"""Polygons with holes and parts, against plain tests of points and segments."""

import itertools
import json
import math
import struct

import numpy as np
from pyspark.sql import functions as F

from terrapane.functions import polygons
from terrapane.operators import spatial


def star(cx, cy, n, big, small, turn=0.1):
    return [(cx + (small if k % 2 else big) * math.cos(turn + 2 * math.pi * k / n), cy + (small if k % 2 else big) * math.sin(turn + 2 * math.pi * k / n)) for k in range(n)]


SHAPES = {
    "star": [[star(0, 0, 10, 20, 8), star(0, 0, 4, 3, 4)]],
    "two": [[star(-15, 5, 6, 9, 9)], [star(15, -5, 8, 12, 4), star(15, -5, 3, 2, 2)]],
    "u": [[[(0, 0), (30, 0), (30, 30), (20, 30), (20, 10), (10, 10), (10, 30), (0, 30)]]],
}


def wkt(parts):
    ring = lambda r: "(" + ", ".join(f"{x!r} {y!r}" for x, y in (*r, r[0])) + ")"
    texts = ["(" + ", ".join(map(ring, p)) + ")" for p in parts]
    return f"POLYGON {texts[0]}" if len(texts) == 1 else f"MULTIPOLYGON ({', '.join(texts)})"


def geojson(parts):
    shapes = [[[list(p) for p in (*r, r[0])] for r in part] for part in parts]
    return json.dumps({"type": "Polygon", "coordinates": shapes[0]} if len(shapes) == 1 else {"type": "MultiPolygon", "coordinates": shapes})


def wkb(parts, order="<", z=False):
    flag = b"\x01" if order == "<" else b"\x00"

    def polygon(part):
        out = flag + struct.pack(order + "II", 1003 if z else 3, len(part))
        for r in part:
            out += struct.pack(order + "I", len(r) + 1) + b"".join(struct.pack(order + ("3d" if z else "2d"), *p, *([7.0] if z else [])) for p in (*r, r[0]))
        return out

    return polygon(parts[0]) if len(parts) == 1 else flag + struct.pack(order + "II", 1006 if z else 6, len(parts)) + b"".join(map(polygon, parts))


def plain_inside(x, y, parts):
    n = 0
    for ring in itertools.chain.from_iterable(parts):
        for (x1, y1), (x2, y2) in zip(ring, (*ring[1:], ring[0]), strict=True):
            n += (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
    return n % 2 == 1


def plain_meets(box, parts):
    """By clipping each edge to the box, and the corners."""
    a, b, c, d = box

    def clipped(x1, y1, x2, y2):
        t0, t1 = 0.0, 1.0
        for p, q in ((x1 - x2, x1 - a), (x2 - x1, c - x1), (y1 - y2, y1 - b), (y2 - y1, d - y1)):
            if p == 0:
                if q < 0:
                    return False
            elif p < 0:
                t0 = max(t0, q / p)
            else:
                t1 = min(t1, q / p)
        return t0 <= t1

    return plain_inside(a, b, parts) or any(clipped(*p, *q) for ring in itertools.chain.from_iterable(parts) for p, q in zip(ring, (*ring[1:], ring[0]), strict=True))


def test_forms_give_the_same_rings(spark):
    rows = [(n, wkt(p), geojson(p), wkb(p), wkb(p, ">", True)) for n, p in SHAPES.items()] + [("none", None, None, None, None), ("point", "POINT (1 2)", '{"type": "Point", "coordinates": [1, 2]}', struct.pack("<BIdd", 1, 1, 1.0, 2.0), None), ("empty", "POLYGON EMPTY", "{}", struct.pack("<BII", 1, 3, 0), None)]
    df = spark.createDataFrame(rows, "name string, wkt string, json string, wkb binary, wkb_z binary")
    got = df.select("name", polygons.rings_of_wkt(F.col("wkt")).alias("a"), polygons.rings_of_geojson(F.col("json")).alias("b"), polygons.rings_of_wkb("wkb").alias("c"), polygons.rings_of_wkb("wkb_z").alias("d"))
    for r in got.collect():
        if r.name in SHAPES:
            want = [[*ring, ring[0]] for part in SHAPES[r.name] for ring in part]
            assert all([[tuple(p) for p in ring] for ring in x] == want for x in (r.a, r.b, r.c, r.d))
        else:
            assert r.a == r.b == r.c == (None if r.name == "none" else [])


def test_points_and_boxes_equal_plain_tests(spark):
    rng = np.random.default_rng(8)
    boxes = [(int(i), *map(float, (x, y, x + w, y + h))) for i, (x, y, w, h) in enumerate(zip(rng.uniform(-35, 32, 400), rng.uniform(-30, 32, 400), rng.uniform(0.1, 12, 400), rng.uniform(0.1, 12, 400), strict=True))]
    boxes += [(1_000, 10.0, 30.0, 12.0, 31.0), (1_001, 30.0, 0.0, 31.0, 1.0), (1_002, 12.0, 12.0, 18.0, 18.0), (1_003, 1.0, 1.0, 9.0, 9.0), (1_004, -0.5, -0.5, 0.5, 0.5)]
    shapes = spark.createDataFrame([(n, wkt(p)) for n, p in SHAPES.items()], "shape string, wkt string").select("shape", polygons.edges_of(polygons.rings_of_wkt(F.col("wkt"))).alias("edges"))
    df = spark.createDataFrame(boxes, "box long, minx double, miny double, maxx double, maxy double")
    box = [F.col(c) for c in ("minx", "miny", "maxx", "maxy")]
    got = shapes.crossJoin(df).select("shape", "box", polygons.meets_box(F.col("edges"), *box).alias("meets"), polygons.inside(F.col("minx"), F.col("miny"), F.col("edges")).alias("inside")).collect()
    by_id = {b[0]: b[1:] for b in boxes}
    assert all(r.meets == plain_meets(by_id[r.box], SHAPES[r["shape"]]) and r.inside == plain_inside(*by_id[r.box][:2], SHAPES[r["shape"]]) for r in got)
    assert 0 < sum(r.meets for r in got) < len(got)
    centre = lambda b: ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)
    want = {(n, i) for n, p in SHAPES.items() for i, b in by_id.items() if plain_meets(b, p) and plain_inside(*centre(b), p)}
    pairs = spatial.boxes_in_polygons(shapes, df, 7.0, "shape", "box").collect()
    assert {tuple(r) for r in pairs} == want and len(pairs) == len(want) > 100
    whole = {tuple(r) for r in spatial.boxes_in_polygons(shapes, df, 7.0, "shape", "box", whole=True).collect()}
    assert whole < want and ("u", 1_003) in whole and ("u", 1_002) not in whole and ("star", 1_004) not in want


def test_areas(spark):
    df = spark.createDataFrame([("POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 2 4, 4 4, 4 2, 2 2))",), ("POLYGON ((0 0, 30 0, 30 30, 20 30, 20 10, 10 10, 10 30, 0 30))",)], "wkt string")
    assert [r[0] for r in df.select(polygons.area_of(polygons.edges_of(polygons.rings_of_wkt(F.col("wkt"))))).collect()] == [96.0, 700.0]


def test_pairs_are_decided_where_they_meet(spark, sf):
    """One join, so no pair is shuffled for a test; a text is parsed once, and not in the one task that reads a small table."""
    from terrapane.plans import world_queries

    plan = world_queries.polygon_boxes(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("regexp_extract_all") == 1
    assert plan.index("regexp_extract_all") < plan.index("RepartitionByExpression")
