"""Registered queries on degrees, lattices, scenes over zones, rasters and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapane.dims import BIOMES, CLIMATES, CODES, POLAR_HALF, zone_table
from terrapane.functions import polygons, projection, tileid
from terrapane.operators import cells, grid, reproject, spatial, zonal
from terrapane.plans import catalog
from terrapane.plans.more_queries import LABELS
from terrapane.plans.queries import FORWARD, POLAR, TURNED_BOXES, longs, parts_sql, query
from terrapane.plans.views import FOOTPRINTS, METRE_BOXES, POINTS, POLAR_POINTS, choose, nest, spread, sql, table, tile_text, view

CORNERS_OF = "(VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1)) AS c(corner, dx, dy)"


def _corners_sql() -> str:
    utm = (
        f"SELECT {tile_text('12000', 'zone', 'xi', 'yi')} AS tile_id, zone_num, south, corner, 100000 + (xi + dx) * 12000.0 AS easting, origin_y + (yi + dy) * 12000.0 AS northing FROM "
        f"(SELECT DISTINCT zone, zone_num, south, origin_y, floor((easting - 100000) / 12000) AS xi, floor((northing - origin_y) / 12000) AS yi FROM ({FORWARD})), {CORNERS_OF}"
    )
    out = [nest(utm, projection.utm_inverse())]
    for p, y0 in (("NP", 0), ("SP", -POLAR_HALF)):
        base = (
            f"SELECT {tile_text('12000', repr(p), 'xi', 'yi')} AS tile_id, corner, -4500000 + (xi + dx) * 12000.0 AS easting, {y0} + (yi + dy) * 12000.0 AS northing FROM "
            f"(SELECT DISTINCT floor((easting + 4500000) / 12000) AS xi, floor((northing - {y0}) / 12000) AS yi FROM ({POLAR[p]})), {CORNERS_OF}"
        )
        out.append(nest(base, projection.polar_inverse(p)))
    return " UNION ALL ".join(f"SELECT tile_id, CAST(corner AS BIGINT) AS corner, round(lon, 6) AS lon, round(lat, 6) AS lat FROM ({x})" for x in out)


def point_tiles(spark, sf_dir, level: int = 12000):
    """The tiles of zones and poles that hold a customer or a supplier, with their native boxes."""
    ids = spatial.points_to_tiles(view(spark, sf_dir, "customer", POINTS), level).select("tile_id")
    ids = ids.unionByName(spatial.points_to_polar_tiles(view(spark, sf_dir, "supplier", POLAR_POINTS), level).select("tile_id")).distinct()
    zones = zone_table(spark).select("zone", "origin_x", "origin_y")
    return grid.with_box(tileid.expand_ids(ids).join(F.broadcast(zones), "zone"))


@query(_corners_sql())
def wgs84_corners(spark, sf_dir):
    """Tiles of zones and poles in one table of degrees."""
    made = reproject.to_wgs84(point_tiles(spark, sf_dir))
    corners = F.array(*(F.struct(F.lit(i).cast("long").alias("corner"), F.round(f"lon{i}", 6).alias("lon"), F.round(f"lat{i}", 6).alias("lat")) for i in range(4)))
    return made.select("tile_id", F.inline(corners))


@query(f"SELECT k, round(easting, 3) AS easting, round(northing, 3) AS northing, round(lon, 6) AS lon, round(lat, 6) AS lat FROM ({nest(sql('customer', POINTS), projection.ease_forward())})")
def equal_area_roundtrip(spark, sf_dir):
    """Points to the equal-area projection and back."""
    rows = projection.apply(view(spark, sf_dir, "customer", POINTS).select("k", "lon", "lat"), projection.ease_forward(), ("easting", "northing"))
    back = projection.apply(rows.select("k", "easting", "northing"), projection.ease_inverse())
    return back.select("k", *(F.round(c, d).alias(c) for c, d in (("easting", 3), ("northing", 3), ("lon", 6), ("lat", 6))))


REGIONS = (
    "box_id",
    "CAST(box_id % 60 + 1 AS INT) AS zone_num",
    "box_id % 2 = 1 AS south",
    "minx + 300000 AS minx",
    "miny + 60000 * (box_id % 140 + 1) AS miny",
    "maxx + 300000 AS maxx",
    "maxy + 60000 * (box_id % 140 + 1) AS maxy",
)
REGIONS_SQL = f"SELECT {', '.join(REGIONS)} FROM ({sql('part', METRE_BOXES)})"


def _lattice_sql(s: float = 400.0) -> str:
    start = lambda low, origin: f"{low} + ((({origin} - {low}) % {s}) + {s}) % {s}"
    base = f"SELECT *, start_y + r * {s} AS northing FROM (SELECT *, unnest(range(CAST(ceil((maxy + {s} - start_y) / {s}) AS BIGINT))) AS r FROM (SELECT *, {start('minx', '500000')} AS start_x, {start('miny', '0')} AS start_y, 500000.0 AS middle FROM ({REGIONS_SQL})))"
    rows = nest(base, projection.utm_inverse("middle", lon="row_lon", lat="row_lat"))
    cols = f"SELECT box_id, zone_num, south, r, minx, maxx, start_x, northing, greatest(3, CAST(floor((maxx - minx) / ({s} * cos(radians(row_lat)))) AS BIGINT)) AS n FROM ({rows})"
    points = f"SELECT box_id, zone_num, south, r, col, northing, start_x + col * (maxx - start_x) / (n - 1) AS easting FROM (SELECT *, unnest(range(n)) AS col FROM ({cols}))"
    return f"SELECT box_id, r AS row, col, round(lon, 6) AS lon, round(lat, 6) AS lat FROM ({nest(points, projection.utm_inverse())})"


@query(_lattice_sql())
def utm_lattice(spark, sf_dir):
    """Points aligned with the zone's origin, fewer metres apart towards the poles."""
    regions = view(spark, sf_dir, "part", METRE_BOXES).selectExpr(*REGIONS)
    made = grid.utm_lattice(regions, 400.0)
    return longs(made.select("box_id", "row", "col", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat")), "row", "col")


_W, _S = "CAST((p_partkey * 7919) % 34000 AS DOUBLE) / 100 - 179.7", "CAST((p_partkey * 104729) % 14000 AS DOUBLE) / 100 - 75.5"
#: Every ninth scene goes over 180 degrees, and every eleventh over the equator.
_TURNED, _OVER = "p_partkey % 9 = 0", "p_partkey % 11 = 0"
SCENES = (
    "p_partkey AS scene_id",
    f"CASE WHEN {_TURNED} THEN 179.3 + (p_size % 5) * 0.1 ELSE {_W} END AS west",
    f"CASE WHEN {_OVER} THEN -0.15 ELSE {_S} END AS south",
    f"CASE WHEN {_TURNED} THEN -179.9 + (p_size % 4) * 0.2 ELSE {_W} + (p_size % 20 + 1) * 0.1 END AS east",
    f"CASE WHEN {_OVER} THEN 0.05 + (p_size % 3) * 0.1 ELSE {_S} + (p_size % 5 + 1) * 0.1 END AS north",
)
SCENE_LEVELS = (12000, 2400)


def _scenes_sql() -> str:
    number = lambda x: f"CAST(least(60, floor(({x} + 180) / 6) + 1) AS BIGINT)"
    zoned = f"SELECT *, unnest(range({number('west')}, {number('east')} + 1)) AS zone_num, south < 0 AS is_south FROM ({parts_sql(sql('part', SCENES))})"
    clipped = f"SELECT *, greatest(west, 6.0 * zone_num - 186) AS w, least(east, 6.0 * zone_num - 180) AS e, 6.0 * zone_num - 183 AS mid FROM ({zoned})"
    points = f"SELECT scene_id, zone_num, is_south AS south, unnest([w, e, least(e, greatest(w, mid)), w, e, least(e, greatest(w, mid))]) AS lon, unnest([south, south, south, north, north, north]) AS lat FROM ({clipped})"
    boxes = f"SELECT scene_id, zone_num, south, min(easting) AS a, min(northing) AS b, max(easting) AS c, max(northing) AS d, CASE WHEN south THEN 10000000 ELSE 0 END AS y0 FROM ({nest(points, projection.utm_forward())}) GROUP BY scene_id, zone_num, south"
    out = []
    for level in SCENE_LEVELS:
        at = lambda v, o: f"CAST(floor(({v} - {o}) / {level}) AS BIGINT)"  # noqa: B023, E731
        tiles = f"SELECT *, unnest(range({at('b', 'y0')}, CASE WHEN south THEN least(0, {at('d', 'y0')} + 1) ELSE {at('d', 'y0')} + 1 END)) AS y FROM (SELECT *, unnest(range({at('a', '100000')}, {at('c', '100000')} + 1)) AS x FROM ({boxes}))"
        out.append(f"SELECT scene_id, concat(CAST(zone_num AS STRING), CASE WHEN south THEN 'S' ELSE 'N' END) AS zone, CAST({level} AS BIGINT) AS level, count(*) AS n, CAST(sum(x) AS BIGINT) AS x_sum, CAST(sum(y) AS BIGINT) AS y_sum FROM ({tiles}) GROUP BY ALL")
    return " UNION ALL ".join(out)


@query(_scenes_sql())
def scene_grids(spark, sf_dir):
    """Tiles of two levels for every scene, in each zone that it reaches, summed up."""
    made = grid.scene_grids(view(spark, sf_dir, "part", SCENES), SCENE_LEVELS)
    sums = made.groupBy("scene_id", "zone", "level").agg(F.count(F.lit(1)).alias("n"), F.sum("x_idx").alias("x_sum"), F.sum("y_idx").alias("y_sum"))
    return longs(sums, "level")


RASTERS = ("print_id AS source", f"CAST({choose('print_id', CODES)} AS BIGINT) AS code", "minx", "miny", "maxx", "maxy")


@query(
    "WITH n AS (SELECT t.box_id AS tile_id, code, CAST(floor((least(t.maxx, r.maxx) - greatest(t.minx, r.minx)) * (least(t.maxy, r.maxy) - greatest(t.miny, r.miny)) / 100.0) AS BIGINT) AS n "
    f"FROM ({sql('part', METRE_BOXES)}) t JOIN (SELECT {', '.join(RASTERS)} FROM ({sql('customer', FOOTPRINTS)})) r ON t.minx <= r.maxx AND t.maxx >= r.minx AND t.miny <= r.maxy AND t.maxy >= r.miny), "
    "s AS (SELECT tile_id, code, sum(n) AS n FROM n WHERE n > 0 AND code <> 0 GROUP BY ALL) SELECT tile_id, code, round(n / sum(n) OVER (PARTITION BY tile_id), 4) AS share FROM s"
)
def raster_tile_shares(spark, sf_dir):
    """Tiles against raster footprints, counts merged over rasters, then shares."""
    tiles = view(spark, sf_dir, "part", METRE_BOXES).withColumnRenamed("box_id", "tile_id")
    rasters = view(spark, sf_dir, "customer", FOOTPRINTS).selectExpr(*RASTERS)
    return longs(zonal.raster_proportions(tiles, rasters, 2000.0, 10.0), "code")


BANDS_TEXT = (
    "concat('{\"id\": \"s', CAST(event_id AS STRING), '\", \"properties\": {\"eo:bands\": [{\"name\": \"Band_', CAST(event_id % 7 AS STRING), ' Red\", \"common_name\": \"', event_type, '\", \"center_wavelength\": 0.5}, "
    "{\"name\": \"nir\", \"full_width_half_max\": 0.25}]}}') AS value"
)


@query(
    "SELECT concat('s', CAST(event_id AS STRING)) AS scene_id, unnest([concat('band_', CAST(event_id % 7 AS STRING), '_red_common_name'), concat('band_', CAST(event_id % 7 AS STRING), '_red_center_wavelength'), 'band_nir_full_width_half_max']) AS feature, "
    "unnest([event_type, '0.5', '0.25']) AS value FROM events"
)
def band_features(spark, sf_dir):
    """Band features of scene records; those that a band does not give are null, and not listed here."""
    made = catalog.band_features(table(spark, sf_dir, "events").selectExpr(BANDS_TEXT))
    return made.select("scene_id", F.explode("features").alias("feature", "value")).where("value IS NOT NULL")


@query(f"SELECT unnest(['s1', 's2', 's3']) AS \"column\", unnest([count(*) FILTER (s1 <> 'none'), count(*) FILTER (s2 <> 'none'), count(*) FILTER (s3 <> 'none')]) AS n FROM (SELECT {', '.join(LABELS)} FROM (SELECT o_orderkey AS k FROM orders))")
def presence_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).selectExpr(*LABELS)
    return catalog.presence_counts(rows, ["s1", "s2", "s3"])


@query("SELECT count(DISTINCT o_orderkey) AS n_a, count(DISTINCT o_custkey) AS n_b, count(DISTINCT o_orderkey) = count(DISTINCT o_custkey) AS same FROM orders")
def same_distinct(spark, sf_dir):
    return catalog.same_distinct(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey")


CLIMATE_OF = [(c, g) for g, cs in CLIMATES.items() for c in cs]
CLASSED = ("c_custkey AS k", f"{choose('c_custkey', [repr(c) for c, _ in CLIMATE_OF] + [repr('Zz')])} AS climate", f"CAST({choose('c_custkey', [b for b, _ in BIOMES] + [99])} AS INT) AS biome")


@query(
    f"SELECT k, CASE climate {' '.join(f'WHEN {c!r} THEN {g!r}' for c, g in CLIMATE_OF)} END AS climate_group, CASE biome {' '.join(f'WHEN {b} THEN {n!r}' for b, n in BIOMES)} END AS biome_name FROM ({sql('customer', CLASSED)})"
)
def legend_lookup(spark, sf_dir):
    """Codes to the names of two legends; unknown codes are null."""
    of = lambda pairs: F.create_map(*(F.lit(x) for p in pairs for x in p))
    rows = view(spark, sf_dir, "customer", CLASSED)
    return rows.select("k", F.element_at(of(CLIMATE_OF), F.col("climate")).alias("climate_group"), F.element_at(of(BIOMES), F.col("biome")).alias("biome_name"))


#: An arrow with a notch, and a hole in it, in units of each customer's own size, as WKT.
OUTER, HOLE = ((0, 0), (10, 0), (10, 10), (5, 4), (0, 10)), ((4, 1), (4, 3), (6, 3), (6, 1))
_PX, _PY, _PS = "(c_custkey * 6029) % 100000 + 0.125", "(c_custkey * 15485863) % 100003 + 0.375", "(c_custkey % 30 + 40)"
_POINT = "concat(CAST({x} * {s} + {px} AS STRING), ' ', CAST({y} * {s} + {py} AS STRING))"
_RING = lambda ring: "concat('(', concat_ws(', ', " + ", ".join(_POINT.format(x=x, y=y, s=_PS, px=_PX, py=_PY) for x, y in (*ring, ring[0])) + "), ')')"
SHAPES = ("c_custkey AS shape_id", f"concat('POLYGON (', {_RING(OUTER)}, ', ', {_RING(HOLE)}, ')') AS wkt")
_EDGES = [(*a, *b) for ring in (OUTER, HOLE) for a, b in zip(ring, (*ring[1:], ring[0]), strict=True)]


@query(
    f"WITH t AS (SELECT * FROM (VALUES {', '.join(map(str, _EDGES))}) AS v(ax, ay, bx, b_y)), "
    f"e AS (SELECT c_custkey AS shape_id, ax * {_PS} + {_PX} AS x1, ay * {_PS} + {_PY} AS y1, bx * {_PS} + {_PX} AS x2, b_y * {_PS} + {_PY} AS y2 FROM customer, t), "
    "d AS (SELECT shape_id, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2 FROM e), "
    "s AS (SELECT shape_id, min(x1) AS lx, max(x1) AS hx, min(y1) AS ly, max(y1) AS hy FROM d GROUP BY shape_id), "
    f"p AS (SELECT shape_id, b.*, (minx + maxx) / 2 AS px, (miny + maxy) / 2 AS py FROM s JOIN ({sql('part', METRE_BOXES)}) b ON minx <= hx AND maxx >= lx AND miny <= hy AND maxy >= ly) "
    "SELECT p.shape_id, box_id FROM p JOIN d ON d.shape_id = p.shape_id WHERE (y1 > py) <> (y2 > py) AND px < (x2 - x1) * (py - y1) / (y2 - y1) + x1 GROUP BY p.shape_id, box_id HAVING count(*) % 2 = 1"
)
def polygon_boxes(spark, sf_dir):
    """Boxes that a concave polygon with a hole meets and that have their centre in it. A centre inside is a meeting, so the plain SQL needs the one test."""
    shapes = spread(spark, sf_dir, "customer", "c_custkey", SHAPES).select("shape_id", polygons.edges_of(polygons.rings_of_wkt(F.col("wkt"))).alias("edges"))
    return spatial.boxes_in_polygons(shapes, view(spark, sf_dir, "part", METRE_BOXES), 2000.0, "shape_id", "box_id")


CELL_LEVEL = 3


def _cells_sql() -> str:
    """All cells of the level against all boxes."""
    n = f"(SELECT unnest(range({1 << CELL_LEVEL})) AS {{c}})"
    base = f"SELECT * FROM ({sql('part', TURNED_BOXES)}) b, (SELECT unnest(range(6)) AS face) f, {n.format(c='i')} r, {n.format(c='j')} c, (SELECT {CELL_LEVEL} AS level) l"
    for layer in cells.layers(cells.meets_box()):
        base = f"SELECT *, {', '.join(f'{text} AS {name}' for name, text in layer)} FROM ({base})"
    return f"SELECT k, CAST(face AS BIGINT) AS face, i, j FROM ({base}) WHERE hit"


@query(_cells_sql())
def cell_covering(spark, sf_dir):
    """Spherical cells that meet boxes of degrees, by descent from the cube's faces."""
    boxes = view(spark, sf_dir, "part", TURNED_BOXES)
    return longs(cells.cover(boxes, CELL_LEVEL, ("k",)).select("k", "face", "i", "j"), "face")
