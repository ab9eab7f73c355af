"""Packed rasters against plain loops over pixels."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapane.functions import projection
from terrapane.functions.geometry import in_polygon
from terrapane.operators import grid, raster, zonal

SIDE = 16


@pytest.fixture(scope="module")
def image():
    rng = np.random.default_rng(5)
    img = rng.choice(np.array([0, 1, 10, 20, 20, 95], np.uint8), (50, 70))
    img[20:30, 40:60] = 30
    return img


@pytest.fixture(scope="module")
def blocks(spark, image):
    rows = [("a", r, c, int(image[r, c])) for r in range(50) for c in range(70)]
    rows += [("a", 3, 3, 0), ("a", 4, 4, None)]  # a repeated pixel: the largest code holds; a null code is outside
    pixels = spark.createDataFrame(rows, "source string, row long, col long, code int")
    return raster.pack_blocks(pixels, SIDE).persist()


def codes_at(image):
    def at(r, c):
        return int(image[r, c]) if 0 <= r < image.shape[0] and 0 <= c < image.shape[1] else 1

    return at


def shares(counts):
    inside = {c: n for c, n in counts.items() if c != 1}
    return {c: round(n / sum(inside.values()), 5) for c, n in inside.items()} if inside else {0: 1.0}


def test_windows_over_blocks_equal_a_loop(spark, image, blocks):
    rng, at = np.random.default_rng(6), codes_at(image)
    windows = [(f"t{i}", "a", *sorted(map(int, rng.integers(-3, 54, 2))), *sorted(map(int, rng.integers(-3, 75, 2)))) for i in range(40)]
    windows += [("all", "a", 0, 50, 0, 70), ("none", "a", 5, 5, 1, 9), ("else", "b", 0, 9, 0, 9), ("far", "a", 500, 510, 0, 3), ("one", "a", 25, 26, 45, 46)]
    df = spark.createDataFrame(windows, "tile_id string, source string, r0 long, r1 long, c0 long, c1 long")
    want = {t: shares(Counter(at(r, c) for r in range(r0, r1) for c in range(c0, c1)) if s == "a" else {}) for t, s, r0, r1, c0, c1 in windows}
    got = defaultdict(dict)
    for r in raster.block_shares(df, blocks, SIDE).collect():
        got[r.tile_id][r.code] = r.share
    assert got == want
    inner = [w for w in windows if w[1] == "a" and 0 <= w[2] < w[3] <= 48 and 0 <= w[4] < w[5] <= 64]
    chips = {r.tile_id: r for r in raster.zonal_chips(spark.createDataFrame(inner, df.schema), blocks, SIDE).collect()}
    assert len(chips) == len(inner) > 5
    for t, _, r0, r1, c0, c1 in inner:
        assert chips[t].shape == [r1 - r0, c1 - c0] and chips[t].props == want[t]
        assert zlib.decompress(chips[t].data) == np.array([[at(r, c) for c in range(c0, c1)] for r in range(r0, r1)], np.uint8).tobytes()


def test_chips_and_shares_equal_those_of_the_pixels(spark, image, blocks):
    boxes = [("x", 0.0, 20.0, 10.0, 50.0), ("y", 32.0, 2.0, 64.0, 34.0)]
    tiles = spark.createDataFrame([(t, "a", *b) for t, *b in boxes], "tile_id string, source string, minx double, miny double, maxx double, maxy double")
    windows = raster.box_windows(tiles, 0.0, 50.0, 1.0)
    rows = [(t, r, c, int(image[r, c])) for t, x0, y0, x1, y1 in boxes for r in range(50) for c in range(70) if x0 <= c + 0.5 < x1 and y0 <= 50 - r - 0.5 < y1]
    pixels = spark.createDataFrame(rows, "tile_id string, row int, col int, code int")
    chips = {r.tile_id: (r.shape, bytes(r.data), r.props) for r in raster.zonal_chips(windows, blocks, SIDE).collect()}
    props = {r.tile_id: r.props for r in zonal.as_maps(zonal.class_shares(pixels)).collect()}
    assert chips == {r.tile_id: (r["shape"], bytes(r.data), props[r.tile_id]) for r in zonal.tile_chips(pixels).collect()}


def test_no_pixel_is_shuffled(spark, blocks):
    df = spark.createDataFrame([("t", "a", 0, 9, 0, 9)], "tile_id string, source string, r0 long, r1 long, c0 long, c1 long")
    n = raster.zonal_counts(df, spark.createDataFrame(blocks.collect(), blocks.schema), SIDE)
    plan = n._jdf.queryExecution().executedPlan().toString()
    # windows to their blocks, packed blocks, and sums of counts: no exchange carries a pixel
    assert plan.count("Exchange") <= 3 and "row" not in n.columns


def test_concave_polygons_with_a_hole_equal_a_test_of_each_centre(spark, image, blocks):
    at, rng = codes_at(image), np.random.default_rng(7)
    shapes = []
    for i in range(12):
        cx, cy, turn = rng.uniform(10, 60), rng.uniform(10, 40), rng.uniform(0, 3)
        ring = lambda n, big, small: [(cx + (big if k % 2 else small) * math.cos(turn + 2 * math.pi * k / n), cy + (big if k % 2 else small) * math.sin(turn + 2 * math.pi * k / n)) for k in range(n)]  # noqa: B023, E731
        shapes.append((i, [ring(10, 14.3, 6.1), ring(4, 2.2, 2.7)]))
    df = spark.createDataFrame([(i, "a", [[{"x": x, "y": y} for x, y in ring] for ring in rings]) for i, rings in shapes], "tile_id long, source string, rings array<array<struct<x double, y double>>>")
    edges = df.select("tile_id", "source", F.flatten(F.transform("rings", raster.ring_edges)).alias("edges"))
    got = defaultdict(dict)
    for r in raster.zonal_counts(raster.polygon_windows(edges), blocks, SIDE).collect():
        got[r.tile_id][r.code] = r.n
    centres = spark.range(-10, 62).select(F.col("id").alias("r")).crossJoin(spark.range(-10, 82).select(F.col("id").alias("c")))
    x, y = F.col("c") + 0.5, F.col("r") + 0.5
    inside = centres.crossJoin(df).where(in_polygon(x, y, F.col("rings")[0]) & ~in_polygon(x, y, F.col("rings")[1])).select("tile_id", "r", "c").collect()
    want = defaultdict(Counter)
    for p in inside:
        if 0 <= p.r < 64 and 0 <= p.c < 80 and (p.r < 50 and p.c < 70 or (p.r // SIDE, p.c // SIDE) in {(r, c) for r in range(4) for c in range(5)}):
            want[p.tile_id][at(p.r, p.c)] += 1
    assert got == {i: dict(n) for i, n in want.items()} and len(got) == 12


@pytest.mark.parametrize("resolution", [10.0, 30.0])
def test_warp_equals_a_loop_over_target_pixels(spark, image, blocks, resolution):
    west, north, step, n = 3.001, 48.0, 0.0002, 40
    corner = projection.apply(spark.createDataFrame([(west, north, 31, False)], "lon double, lat double, zone_num int, south boolean"), projection.utm_forward()).first()
    minx, maxy = math.floor(corner.easting) - 40.0, math.floor(corner.northing) + 35.0
    grids = spark.createDataFrame([("g", "a", 31, False, minx, maxy, n, n)], "target string, source string, zone_num int, south boolean, minx double, maxy double, width int, height int")
    got = {(r.row, r.col): r.code for r in raster.warp(grids, blocks, F.lit(west), F.lit(north), step, resolution, SIDE).collect()}
    k = 1 if resolution <= 10 else math.ceil(resolution / 10)
    spots = [(r, c, minx + (c + (j + 0.5) / k) * resolution, maxy - (r + (i + 0.5) / k) * resolution) for r in range(n) for c in range(n) for i in range(k) for j in range(k)]
    df = spark.createDataFrame([(*s, 31, False) for s in spots], "row int, col int, easting double, northing double, zone_num int, south boolean")
    seen = defaultdict(Counter)
    for p in projection.apply(df, projection.utm_inverse()).collect():
        r, c = math.floor((north - p.lat) / step), math.floor((p.lon - west) / step)
        code = codes_at(image)(r, c)
        seen[p.row, p.col][0 if code == 1 else code] += 1
    assert got == {at: min(c, key=lambda x: (-c[x], x)) for at, c in seen.items()}
    assert len(set(got.values())) > 3


def test_scenes_over_180_degrees_and_the_equator(spark):
    cases = [("turn", 179.0, 10.0, -179.0, 10.5), ("both", 179.5, -0.3, -179.5, 0.3), ("plain", 5.0, 10.0, 13.0, 10.5), ("edge", 5.0, -1.0, 5.5, 0.0)]
    scenes = spark.createDataFrame(cases, "scene_id string, west double, south double, east double, north double")
    zones = {r.scene_id: sorted(r.z) for r in scenes.select("scene_id", grid.zones_of_bounds(*map(F.col, ("west", "south", "east", "north"))).alias("z")).collect()}
    assert zones == {"turn": ["1N", "60N"], "both": ["1N", "1S", "60N", "60S"], "plain": ["31N", "32N", "33N"], "edge": ["31S"]}
    tiles = defaultdict(list)
    for r in grid.scene_grids(scenes, (12_000,)).collect():
        tiles[r.scene_id].append(r)
    assert {s: {r.zone for r in t} for s, t in tiles.items()} == {s: set(z) for s, z in zones.items()}
    assert len(tiles["turn"]) < 2 * 11 * 8  # two parts of a degree each, and no zone between them
    assert all((r.y_idx < 0) == r.zone.endswith("S") for t in tiles.values() for r in t)
    for s in ("turn", "both"):  # mirrored parts have equally many tiles
        n = Counter(r.zone[:-1] for r in tiles[s])
        assert abs(n["1"] - n["60"]) <= 12


def test_raster_counts_shuffle_no_pair(spark, sf):
    from terrapane.plans import world_queries

    plan = world_queries.raster_tile_shares(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_a_task_holds_one_block_and_no_pixel_as_an_object(spark):
    """Blocks of one partition flow through: repeated and null pixels, null sources, negative places; and codes that are no byte stop the job."""
    rows = [("a", r, c, (r * 7 + c * 3) % 90 + 2) for r in range(-20, 90) for c in range(-5, 40)] + [(None, 0, 0, 9), (None, 17, 0, 8), ("a", 1, 1, None), ("a", 2, 2, 1), ("a", 3, 3, 95), ("a", 3, 3, 2)]
    pixels = spark.createDataFrame(rows, "source string, row long, col long, code int")
    want = defaultdict(lambda: np.full((SIDE, SIDE), -1))
    for source, r, c, code in rows:
        if code is not None:
            block = want[source, r // SIDE, c // SIDE]
            block[r % SIDE, c % SIDE] = max(block[r % SIDE, c % SIDE], code)
    made = raster.pack_blocks(pixels, SIDE)
    got = {(b.source, b.brow, b.bcol): np.frombuffer(zlib.decompress(b.data), np.uint8).reshape(SIDE, SIDE) for b in made.collect()}
    assert got.keys() == want.keys() and made.count() == len(got) > raster.READY / 2
    assert all((got[k] == np.where(want[k] < 0, 1, want[k])).all() for k in got)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "ArrowEvalPython" not in plan and "MapInArrow" in plan
    for code in (256, -1):
        with pytest.raises(Exception, match="not within 0 and 255"):
            raster.pack_blocks(spark.createDataFrame([("a", 0, 0, code)], pixels.schema), SIDE).collect()
