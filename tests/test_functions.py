import math

import pytest
from pyspark.sql import functions as F

from terrapane.dims import zone_table
from terrapane.functions import arrays, geometry, projection, proportions, tileid
from terrapane.operators import grid, spatial, zonal


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_parse_goldens(spark):
    rows = spark.createDataFrame([("G2400m_19S_X000162_Y-01131_buf60_ovrlp16",), ("G600m_42N_X00023_Y00109_ovrlp16_buf60",), ("tile-1",), (None,)], "tile_id string")
    got = [tuple(r) for r in tileid.expand_ids(rows).select("level", "zone", "epsg", "x_idx", "y_idx", "buffer", "overlap").collect()]
    assert got == [(2400, "19S", "EPSG:32719", 162, -1131, 60, 16), (600, "42N", "EPSG:32642", 23, 109, 60, 16), (None,) * 7, (None,) * 7]


def test_format_and_hash(spark):
    r = one(spark, tileid.format_id(F.lit(2400), F.lit("19S"), F.lit(162), F.lit(-1131)), tileid.tile_hash(F.lit("G600m_42N_X000023_Y000109"), F.lit(600), F.lit("42N")))
    assert tuple(r) == ("G2400m_19S_X000162_Y-01131", "d787b58ed3464060784d7f036605121f")


def test_lineage_goldens(spark):
    a = (F.lit(2400), F.lit("19S"), F.lit(162), F.lit(-1131))
    up, same, down = one(spark, *(tileid.lineage(*a, F.lit(t)) for t in (12000, 2400, 1200)))
    assert up == ["G12000m_19S_X000032_Y-00227"] and same == ["G2400m_19S_X000162_Y-01131"]
    assert down == [f"G1200m_19S_X{x:06d}_Y{y:06d}" for x in (324, 325) for y in (-2262, -2261)]
    assert one(spark, tileid.lineage(F.lit(1200), F.lit("31N"), F.lit(1), F.lit(1), F.lit(700)))[0] == []


def test_children_have_one_parent_and_factor_squared_siblings(spark):
    t = spark.range(20).crossJoin(spark.range(20).withColumnRenamed("id", "y")).select(F.lit(1200).alias("level"), F.lit("31S").alias("zone"), F.col("id").alias("x_idx"), (F.col("y") - 10).alias("y_idx"))
    n = grid.identify(t).groupBy("super_id").count().where("super_id IS NOT NULL").select("count").distinct().collect()
    assert [r[0] for r in n] == [4]


def test_known_point(spark):
    p = spark.createDataFrame([(2.2945, 48.8583)], "lon double, lat double")
    r = spatial.points_to_tiles(p, 1200).first()
    assert r.tile_id == "G1200m_31N_X000290_Y004509"
    assert r.easting == pytest.approx(448251.898, abs=1e-3) and r.northing == pytest.approx(5411943.794, abs=1e-3)


def test_longitude_180_stays_in_zone_60(spark):
    assert spatial.with_zone(spark.createDataFrame([(180.0, 1.0)], "lon double, lat double")).first().zone == "60N"


def test_polar_scale_matches_published_example(spark):
    # EPSG's worked example for a standard parallel of 71 S, moved from its own meridian of 70 E to 0
    p = spark.createDataFrame([(120.0 - 70.0, -75.0)], "lon double, lat double")
    r = projection.apply(p, projection.polar_forward("SP")).first()
    assert r.easting == pytest.approx(1255380.79, abs=0.01) and r.northing == pytest.approx(1053389.56, abs=0.01)


def test_zones_from_bounds(spark):
    z = one(spark, grid.zones_of_bounds(*map(F.lit, (5.0, 10.0, 13.0, 20.0))))[0]
    assert z == ["31N", "32N", "33N"]


def test_proportion_goldens(spark):
    rows = [("a", c) for c in (10, 10, 40, 1)] + [("b", 1), ("b", 1)] + [("c", 0), ("c", 0), ("c", 1)]
    px = spark.createDataFrame(rows, "tile_id string, code int")
    got = {r.tile_id: r.props for r in zonal.as_maps(zonal.class_shares(px)).collect()}
    assert got == {"a": {10: 0.66667, 40: 0.33333}, "b": {0: 1.0}, "c": {0: 1.0}}


def test_parent_mean_counts_absent_classes_as_zero(spark):
    c = spark.createDataFrame([("p", {10: 0.5, 20: 0.5}), ("p", {10: 1.0}), ("q", {30: 1.0})], "super_id string, props map<int,double>")
    got = {(r.tile_id, r.code): r.share for r in zonal.parent_means(c).collect()}
    assert got == {("p", 10): 0.75, ("p", 20): 0.25, ("q", 30): 1.0}


def test_pruned_proportions(spark):
    t = spark.createDataFrame([("a", "P"), ("b", "Q"), ("c", "Q")], "tile_id string, super_id string")
    parents = spark.createDataFrame([("P", {0: 1.0}), ("Q", {10: 1.0})], "tile_id string, props map<int,double>")
    px = spark.createDataFrame([("a", 10), ("b", 20)], "tile_id string, code int")
    got = {r.tile_id: r.props for r in zonal.proportions_with_pruning(t, parents, px).collect()}
    assert got == {"a": {0: 1.0}, "b": {20: 1.0}, "c": {0: 1.0}}


def test_entropy_and_majority(spark):
    v = [F.lit(0.5), F.lit(0.25), F.lit(0.25)]
    assert tuple(one(spark, proportions.entropy(v), proportions.majority(v[1:], ["x", "y"]), proportions.entropy([F.lit(0.0)]))) == (1.5, "x", 0.0)


def test_both_text_forms(spark):
    for t in ("{10: 0.5, 40: 0.5}", '{"10": 0.5, "40": 0.5}'):
        assert one(spark, proportions.text_to_map(F.lit(t)))[0] == {10: 0.5, 40: 0.5}
    assert one(spark, proportions.text_to_map(F.lit(None).cast("string")))[0] is None


@pytest.mark.parametrize(("zone", "level", "inside"), [("31N", 120000, 286), ("19S", 120000, 282), ("31N", 12000, 29320), ("19S", 12000, 29032)])
def test_derived_tile_counts(spark, zone, level, inside):
    z = zone_table(spark).where(F.col("zone") == zone)
    assert grid.utm_grid(z, level, border=False).count() == inside


def test_border_adds_tiles_within_the_prefilter(spark):
    z = zone_table(spark).where("zone = '31N'")
    n = grid.utm_grid(z, 120000).count()
    assert 286 < n <= 357


@pytest.mark.parametrize(("zone", "level", "n"), [("NP", 120000, 47), ("NP", 12000, 4586), ("SP", 120000, 139), ("SP", 12000, 12918)])
def test_polar_tile_counts(spark, zone, level, n):
    poles = spark.createDataFrame([(zone,)], "zone string")
    assert grid.polar_grid(poles, level).count() == n


def test_wkb_and_point_in_polygon(spark):
    import struct

    b = one(spark, geometry.wkb_polygon(*(F.lit(v) for v in (0.0, 1.0, 2.0, 3.0))))[0]
    assert struct.unpack("<BIII", b[:13]) == (1, 3, 1, 5) and len(b) == 13 + 80
    square = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (2, 0), (2, 2), (0, 2))))
    assert tuple(one(spark, geometry.in_polygon(F.lit(1.0), F.lit(1.0), square), geometry.in_polygon(F.lit(3.0), F.lit(1.0), square))) == (True, False)


def test_a_point_on_the_boundary_is_not_within(spark):
    points = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4))))
    at = spark.createDataFrame([(2.5, 0.0), (4.0, 2.0), (2.0, 2.0), (0.0, 0.0), (3.0, 1.0), (1.0, 3.0), (-1.0, 0.0)], "x double, y double")
    assert [r[0] for r in at.select(geometry.within_polygon(F.col("x"), F.col("y"), points)).collect()] == [False] * 4 + [True] + [False] * 2


def test_known_corners_decide_as_an_array_of_them(spark):
    ring = ((0, 0), (8, 0), (8, 8), (4, 3), (0, 8))
    points = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ring))
    at = spark.range(19 * 19).select((F.col("id") % 19 / 2 - 0.5).alias("x"), (F.floor(F.col("id") / 19) / 2 - 0.5).alias("y"))
    corners = [(F.lit(float(x)), F.lit(float(y))) for x, y in ring]
    got = at.select(geometry.within_corners(F.col("x"), F.col("y"), corners), geometry.within_polygon(F.col("x"), F.col("y"), points)).collect()
    assert all(a == b for a, b in got) and 100 < sum(a for a, _ in got) < 200


def test_scene_grid_join_shuffles_no_pair(spark, sf):
    from terrapane.plans.queries import QUERIES

    plan = QUERIES["scene_grid_join"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_scene_grid_join_equals_its_sql_on_edges(spark, tmp_path):
    """The centres of these prints lie on the lower edges of these scenes, but for the last, whose is inside."""
    import duckdb

    from terrapane.plans.queries import ORACLES, QUERIES

    spark.createDataFrame([(301, 32), (969, 12), (16874, 20), (36, 47)], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(9518,), (6398,), (9359,), (13980,)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    db = duckdb.connect()
    for t in ("part", "customer"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(db.execute(ORACLES["scene_grid_join"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["scene_grid_join"](spark, str(tmp_path)).collect()) == want and want


def test_chips_keep_pixel_order(spark):
    import zlib

    px = spark.createDataFrame([("t", r, c, 10 * r + c) for r in range(3) for c in range(2)][::-1], "tile_id string, row int, col int, code int")
    r = zonal.tile_chips(px).first()
    assert r.shape == [3, 2] and list(zlib.decompress(r.data)) == [0, 1, 10, 11, 20, 21]


def test_scene_chips_of_all_levels_and_origins(spark):
    import zlib

    tiles = [("a", 0, 0, 10, 0, 0), ("b", 1, 0, 10, 0, 0), ("c", 0, 0, 20, 0, 0), ("s", 0, -1, 10, 0, 10_000_000)]
    t = spark.createDataFrame(tiles, "tile_id string, x_idx long, y_idx long, level int, origin_x int, origin_y int").repartition(4)
    px = spark.createDataFrame([(7, 5, 5, 1, True), (7, 15, 5, 2, True), (7, 5, 9_999_995, 3, True)], "scene_id int, x int, y int, value int, clear boolean")
    got = {r.tile_id: (r.shape, list(zlib.decompress(r.image))) for r in zonal.scene_chips(t, px).collect()}
    assert got == {"a": ([1, 1], [1]), "b": ([1, 1], [2]), "c": ([1, 2], [1, 2]), "s": ([1, 1], [3])}
    assert zonal.scene_chips(t.limit(0), px).count() == 0


def test_percentile_stretch(spark):
    out = one(spark, arrays.percentile_stretch(F.array(*(F.lit(float(i)) for i in range(101)))))[0]
    assert out[0] == 0.0 and out[-1] == 1.0 and math.isclose(out[50], 0.5)


def test_overlap_pairs_come_once(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 25.0, 25.0)], "a long, minx double, miny double, maxx double, maxy double")
    b = spark.createDataFrame([(7, 5.0, 5.0, 30.0, 30.0), (8, 25.0, 25.0, 26.0, 26.0), (9, 26.0, 0.0, 27.0, 1.0)], "b long, minx double, miny double, maxx double, maxy double")
    assert sorted(tuple(r) for r in grid.overlapping(a, b, 10.0, "a", "b").collect()) == [(1, 7), (1, 8)]
