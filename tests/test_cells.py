"""Coverings against known ids and dense samples of points."""

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from terrapane.operators import cells


def plain_cell(lon, lat, level):
    """face, i, j of the cell that holds a point."""
    x, y, z = math.cos(math.radians(lat)) * math.cos(math.radians(lon)), math.cos(math.radians(lat)) * math.sin(math.radians(lon)), math.sin(math.radians(lat))
    axis = max(range(3), key=lambda k: abs((x, y, z)[k]))
    face = axis + 3 * ((x, y, z)[axis] < 0)
    u, v = ((y / x, z / x), (-x / y, z / y), (-x / z, -y / z), (z / x, y / x), (z / y, -x / y), (-y / z, -x / z))[face] if (x, y, z)[axis] else (0, 0)
    st = lambda w: 0.5 * math.sqrt(1 + 3 * w) if w >= 0 else 1 - 0.5 * math.sqrt(1 - 3 * w)
    n = 1 << level
    return face, *(min(n - 1, max(0, int(st(w) * n))) for w in (u, v))


def covered(spark, boxes, level):
    df = spark.createDataFrame(boxes, "box_id string, west double, south double, east double, north double")
    out = defaultdict(set)
    for r in cells.cover(df, level).collect():
        assert (r.face, r.i, r.j) not in out[r.box_id]
        out[r.box_id].add((r.face, r.i, r.j))
    return out


def test_ids_of_points_are_the_known_ones(spark):
    known = {0x47A1CBD595522B39: (11.770681595, 49.703498679), 0x46525318B63BE0F9: (12.588490937, 55.685376759), 0x52B30B71698E729D: (-93.449700022, 45.486546517)}
    df = spark.createDataFrame([(str(k), lon, lat, lon, lat) for k, (lon, lat) in known.items()], "box_id string, west double, south double, east double, north double")
    assert {r.box_id: r.cell_id for r in cells.cover(df, 9).collect()} == {str(k): k & -(1 << 42) | 1 << 42 for k in known}


def test_cells_cover_each_box_and_none_is_outside(spark):
    boxes = [("a", 3.0, 48.0, 9.0, 52.0), ("turn", 175.0, -10.0, -172.0, 4.0), ("north", -180.0, 80.0, 180.0, 90.0), ("thin", 10.0, 44.7, 60.0, 45.3), ("tall", 44.7, -60.0, 45.3, 70.0), ("point", 7.0, 7.0, 7.0, 7.0), ("south", 100.0, -90.0, 120.0, -70.0), ("odd", 5.0, 9.0, 8.0, 7.0)]
    level, got = 4, covered(spark, boxes, 4)
    assert "odd" not in got and len(got["point"]) == 1
    rng = np.random.default_rng(4)
    for name, west, south, east, north in boxes[:-1]:
        width = (east - west) % 360 or (360.0 if name == "north" else 0.0)
        points = [(((west + width * a + 180) % 360) - 180, south + (north - south) * b) for a, b in [*rng.random((3_000, 2)), *((a, b) for a in np.linspace(0, 1, 60) for b in (0.0, 1.0)), *((a, b) for a in (0.0, 1.0) for b in np.linspace(0, 1, 60))]]
        assert {plain_cell(*p, level) for p in points if abs(p[1]) < 89.999} <= got[name]  # at a pole four cells meet
        # each cell has a point of the box: sampled in the cell, with its edges, finely
        n, inside = 1 << level, lambda lon, lat: south <= lat <= north and (lon - west) % 360 <= width  # noqa: B023, E731
        missing = 0
        for face, i, j in got[name]:
            grid = np.linspace(0, 1, 25)
            uv = [[(4 * s * s - 1) / 3 if s >= 0.5 else (1 - 4 * (1 - s) ** 2) / 3 for s in (k + grid) / n] for k in (i, j)]
            seen = False
            for u in uv[0]:
                for v in uv[1]:
                    x, y, z = ((1, u, v), (-u, 1, v), (-u, -v, 1), (-1, -v, -u), (v, -1, -u), (v, u, -1))[face]
                    seen = seen or inside(math.degrees(math.atan2(y, x)), math.degrees(math.atan2(z, math.hypot(x, y))))
            missing += not seen
        assert name == "point" or missing <= 0.1 * len(got[name]) + 1  # what a box only grazes may have no sampled point


def test_a_covering_is_the_parents_of_the_next(spark):
    boxes = [("a", -20.0, -33.0, 14.0, 21.0)]
    fine, coarse = covered(spark, boxes, 4)["a"], covered(spark, boxes, 3)["a"]
    assert {(f, i // 2, j // 2) for f, i, j in fine} == coarse and len(fine) > 2 * len(coarse)
    df = spark.createDataFrame(boxes, "box_id string, west double, south double, east double, north double")
    ids = [r.cell_id for r in cells.cover(df, 4).collect()]
    assert len(set(ids)) == len(ids) and cells.cover(df.limit(0), 2).count() == 0
    assert cells.cover(df.select("box_id", F.lit(None).cast("double").alias("west"), "south", "east", "north"), 2).count() == 0

def test_the_arrays_decide_as_the_sql_text(spark):
    """All cells of two levels against boxes of every kind, by the steps as text and on arrays; and nothing that meets is skipped beforehand."""
    rng = np.random.default_rng(12)
    boxes = [tuple(map(float, b)) for b in zip(rng.uniform(-180, 180, 25).round(2), rng.uniform(-90, 60, 25).round(2), rng.uniform(-180, 180, 25).round(2), strict=True)]
    boxes = [(w, s, e, s + k) for k, (w, s, e) in enumerate(boxes)] + [(45.0, -10.0, 45.0, 10.0), (-180.0, -90.0, 180.0, 90.0), (-180.0, 35.0, 180.0, 35.5), (0.0, 0.0, 0.0, 0.0), (170.0, 89.0, -170.0, 90.0), (90.0, -45.0, 135.0, 0.0)]
    for level in (0, 2):
        side = spark.range(1 << level)
        df = spark.createDataFrame([(k, *b, level) for k, b in enumerate(boxes)], "k long, west double, south double, east double, north double, level int")
        df = df.crossJoin(spark.range(6).select(F.col("id").alias("face"))).crossJoin(side.select(F.col("id").alias("i"))).crossJoin(side.select(F.col("id").alias("j")))
        for layer in cells.layers(cells.meets_box()):
            df = df.select("*", *(F.expr(text).alias(name) for name, text in layer))
        rows = df.select("k", "face", "i", "j", "hit").collect()
        k, face, i, j, hit = (np.array(c) for c in zip(*rows, strict=True))
        with np.errstate(all="ignore"):
            held = cells.Boxes(np.array(boxes).T).take(k)
            meets, near = cells._meets(face, i, j, level, held), cells._near(face, i, j, level, held)
        odd = meets != hit
        assert not odd.any(), [(boxes[a], *r) for a, *r in zip(k[odd], face[odd], i[odd], j[odd], hit[odd], strict=True)]
        assert 0 < hit.sum() < len(hit) and (near | ~hit).all() and not near.all()


def test_a_covering_of_many_levels_and_cuts(spark):
    """The finest cells of a point and of a small box are in those of each coarser level, also over cuts; the plan has no step that Spark interprets, and boxes of one file are spread over tasks."""
    df = spark.createDataFrame([("a", 11.77, 49.7, 11.775, 49.702), ("b", float("nan"), 1.0, 2.0, 3.0)], "box_id string, west double, south double, east double, north double")
    found = {level: {(r.box_id, r.face, r.i, r.j) for r in cells.cover(df, level).collect()} for level in (5, 6, 13, 18)}
    for low, high in ((5, 6), (6, 13), (13, 18)):
        assert {(b, f, i >> (high - low), j >> (high - low)) for b, f, i, j in found[high]} == found[low]
    assert len(found[18]) > 20 and {b for b, *_ in found[18]} == {"a"}
    plan = cells.cover(df, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "atan2" not in plan.lower() and "REPARTITION" in plan.upper()
