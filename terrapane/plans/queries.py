"""The registered queries of the library, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from terrapane.dims import BIAS, CODES, LEVELS, MARGIN, POLAR_HALF, THRESHOLDS, UTM_X0, UTM_X1, UTM_Y0_SOUTH, UTM_Y1_NORTH, WEIGHTS, level_table, parent_level, zone_table
from terrapane.functions import arrays, geodesic, geometry, projection, proportions, tileid
from terrapane.operators import grid, select, spatial, zonal
from terrapane.plans import catalog
from terrapane.plans.views import DEGREE_BOXES, FOOTPRINTS, METRE_BOXES, PARTS, PIXELS_SQL, POINTS, POLAR_POINTS, TILES, choose, nest, pixels, sql, table, tile_text, view

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def longs(df, *names):
    """df with these columns as BIGINT."""
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# --- tile ids -------------------------------------------------------------------------------------------------------

ID_TEXT = f"CASE WHEN bad THEN concat('tile-', CAST(k AS STRING)) ELSE concat({tile_text()}, CASE WHEN buf <> 0 THEN concat('_buf', CAST(buf AS STRING)) ELSE '' END, CASE WHEN ov <> 0 THEN concat('_ovrlp', CAST(ov AS STRING)) ELSE '' END) END"
IDS_SQL = f"SELECT k, {ID_TEXT} AS tile_id, level, zone, x, y, buf, ov, bad FROM ({sql('orders', PARTS)})"
EPSG_TEXT = "CASE WHEN zone = 'NP' THEN 'EPSG:3413' WHEN zone = 'SP' THEN 'EPSG:3031' ELSE concat('EPSG:', CASE WHEN zone LIKE '%N' THEN '326' ELSE '327' END, lpad(regexp_extract(zone, '^([0-9]+)', 1), 2, '0')) END"


def ids(spark, sf_dir):
    rows = view(spark, sf_dir, "orders", PARTS)
    made = tileid.format_id(F.col("level"), F.col("zone"), F.col("x"), F.col("y"), F.col("buf"), F.col("ov"))
    return rows.select("k", F.when(F.col("bad"), F.concat(F.lit("tile-"), F.col("k").cast("string"))).otherwise(made).alias("tile_id"))


@query(f"SELECT k, tile_id FROM ({IDS_SQL})")
def tile_id_format(spark, sf_dir):
    return ids(spark, sf_dir)


@query(f"SELECT k, CASE WHEN NOT bad THEN level END AS level, CASE WHEN NOT bad THEN zone END AS zone, CASE WHEN NOT bad THEN x END AS x_idx, CASE WHEN NOT bad THEN y END AS y_idx, CASE WHEN NOT bad THEN buf END AS buffer, CASE WHEN NOT bad THEN ov END AS overlap FROM ({IDS_SQL})")
def tile_id_parse(spark, sf_dir):
    p = tileid.parse_id(F.col("tile_id"))
    return longs(ids(spark, sf_dir).withColumn("p", p).select("k", "p.*"), "level", "buffer", "overlap")


@query(f"SELECT tile_id, CASE WHEN NOT bad THEN level END AS level, CASE WHEN NOT bad THEN zone END AS zone, CASE WHEN NOT bad THEN {EPSG_TEXT} END AS epsg, CASE WHEN NOT bad THEN x END AS x_idx, CASE WHEN NOT bad THEN y END AS y_idx, CASE WHEN NOT bad THEN buf END AS buffer, CASE WHEN NOT bad THEN ov END AS overlap FROM ({IDS_SQL})")
def tile_id_expand(spark, sf_dir):
    return longs(tileid.expand_ids(ids(spark, sf_dir).select("tile_id")), "level", "buffer", "overlap")


@query(f"SELECT k, CASE WHEN bad THEN -1 ELSE level END AS level FROM ({IDS_SQL})")
def tile_level_infer(spark, sf_dir):
    return ids(spark, sf_dir).select("k", tileid.infer_level(F.col("tile_id")).cast("long").alias("level"))


PARENTS = {lv: parent_level(lv) for lv in LEVELS}
PARENT_TEXT = "CASE level " + " ".join(f"WHEN {a} THEN {tile_text(str(b), 'zone', f'floor(x / {b // a}.0)', f'floor(y / {b // a}.0)')}" for a, b in PARENTS.items() if b) + " END"


def tiles(spark, sf_dir):
    rows = view(spark, sf_dir, "customer", TILES)
    return rows.select("k", tileid.format_id(F.col("level"), F.col("zone"), F.col("x"), F.col("y")).alias("tile_id"), "level", "zone", F.col("x").alias("x_idx"), F.col("y").alias("y_idx"))


TILES_SQL = f"SELECT k, {tile_text()} AS tile_id, level, zone, x, y FROM ({sql('customer', TILES)})"
XY = ("level", "zone", "x_idx", "y_idx")


def own():
    return tuple(F.col(c) for c in XY)


@query(f"SELECT tile_id, {PARENT_TEXT} AS super_id FROM ({TILES_SQL})")
def tile_parent(spark, sf_dir):
    return tiles(spark, sf_dir).select("tile_id", tileid.parent_id(*own()).alias("super_id"))


@query(f"SELECT tile_id, CASE WHEN 12000 % level = 0 AND level <= 12000 THEN {tile_text('12000', 'zone', 'floor(x / (12000 / level))', 'floor(y / (12000 / level))')} END AS ancestor FROM ({TILES_SQL})")
def tile_ancestor(spark, sf_dir):
    return tiles(spark, sf_dir).select("tile_id", tileid.ancestor_id(*own(), 12000).alias("ancestor"))


@query(
    f"WITH t AS (SELECT tile_id, zone, x, y FROM ({TILES_SQL}) WHERE level = 2400), up AS (SELECT tile_id, CAST(12000 AS BIGINT) AS target, {tile_text('12000', 'zone', 'floor(x / 5.0)', 'floor(y / 5.0)')} AS related FROM t), "
    f"down AS (SELECT tile_id, CAST(600 AS BIGINT) AS target, {tile_text('600', 'zone', 'x * 4 + dx', 'y * 4 + dy')} AS related FROM t, (SELECT unnest(range(4)) AS dx), (SELECT unnest(range(4)) AS dy)) "
    "SELECT * FROM up UNION ALL SELECT * FROM down UNION ALL SELECT tile_id, CAST(2400 AS BIGINT), tile_id FROM t"
)
def tile_lineage_explode(spark, sf_dir):
    rows = tiles(spark, sf_dir).where("level = 2400").withColumn("target", F.explode(F.array(F.lit(12000), F.lit(2400), F.lit(600))))
    rows = rows.withColumn("related", F.explode(tileid.lineage(*own(), F.col("target"))))
    return longs(rows.select("tile_id", "target", "related"), "target")


@query(f"SELECT tile_id, target, CASE WHEN target >= level AND target % level = 0 THEN 1 WHEN target < level AND level % target = 0 THEN (level // target) * (level // target) ELSE 0 END AS related FROM ({TILES_SQL}), (SELECT CAST(unnest([200, 700, 2400]) AS BIGINT) AS target) WHERE level <= 2400")
def tile_lineage_missing(spark, sf_dir):
    """How many tiles each tile is related to at levels that fit and at levels that do not (none)."""
    rows = tiles(spark, sf_dir).where("level <= 2400").withColumn("target", F.explode(F.array(*(F.lit(x).cast("long") for x in (200, 700, 2400)))))
    return rows.select("tile_id", "target", F.size(tileid.lineage(*own(), F.col("target"))).cast("long").alias("related"))


@query(f"SELECT tile_id, md5(concat_ws('_', tile_id, CAST(level AS STRING), zone)) AS tile_hash FROM ({TILES_SQL})")
def tile_hash(spark, sf_dir):
    return tiles(spark, sf_dir).select("tile_id", tileid.tile_hash(F.col("tile_id"), F.col("level"), F.col("zone")).alias("tile_hash"))


def _geohash_text() -> str:
    out = []
    for c in range(7):
        terms = []
        for b in range(5 * c, 5 * c + 5):
            source = f"(gx >> {17 - b // 2})" if b % 2 == 0 else f"(gy >> {16 - b // 2})"
            terms.append(f"({source} % 2) * {2 ** (4 - (b - 5 * c))}")
        out.append(f"substr('{tileid.BASE32}', CAST({' + '.join(terms)} + 1 AS BIGINT), 1)")
    return "concat(" + ", ".join(out) + ")"


@query(f"SELECT k, {_geohash_text()} AS geohash FROM (SELECT k, CAST(floor((lon + 180) / 360 * 262144) AS BIGINT) AS gx, CAST(floor((lat + 90) / 180 * 131072) AS BIGINT) AS gy FROM ({sql('customer', POINTS)}))")
def tile_geohash(spark, sf_dir):
    return view(spark, sf_dir, "customer", POINTS).select("k", tileid.geohash(F.col("lon"), F.col("lat")).alias("geohash"))


@query(f"SELECT tile_id, row_number() OVER (ORDER BY CAST(regexp_extract(zone, '^([0-9]+)', 1) AS INT), CASE WHEN zone LIKE '%S' THEN 1 ELSE 0 END, -level, tile_id) AS place FROM ({TILES_SQL}) QUALIFY place <= 50")
def zone_order_top(spark, sf_dir):
    """The first 50 tiles in natural zone order (a top-k report)."""
    from pyspark.sql import Window

    number, south = tileid.zone_order(F.col("zone"))
    first = tiles(spark, sf_dir).select("tile_id", "level", number.alias("z"), south.alias("h")).orderBy("z", "h", -F.col("level"), "tile_id").limit(50)
    return first.select("tile_id", F.row_number().over(Window.orderBy("z", "h", -F.col("level"), "tile_id")).cast("long").alias("place"))


@query(f"SELECT tile_id, zone, CAST(100000 + x * level AS DOUBLE) AS minx, CAST(CASE WHEN zone LIKE '%S' THEN 10000000 ELSE 0 END + y * level AS DOUBLE) AS miny, CAST(100000 + (x + 1) * level AS DOUBLE) AS maxx, CAST(CASE WHEN zone LIKE '%S' THEN 10000000 ELSE 0 END + (y + 1) * level AS DOUBLE) AS maxy, CAST(level * level AS DOUBLE) AS area FROM ({TILES_SQL})")
def tile_reconstruct(spark, sf_dir):
    """Boxes in native metres from ids alone."""
    rows = tileid.expand_ids(tiles(spark, sf_dir).select("tile_id")).withColumn("origin_x", F.lit(UTM_X0)).withColumn("origin_y", F.when(F.col("zone").endswith("S"), UTM_Y0_SOUTH).otherwise(0))
    return grid.with_box(rows).select("tile_id", "zone", "minx", "miny", "maxx", "maxy", geometry.area().alias("area"))


BOX_TEXT = "SELECT tile_id, CAST(100000 + x * level AS DOUBLE) AS a, CAST(y0 + y * level AS DOUBLE) AS b, CAST(100000 + (x + 1) * level AS DOUBLE) AS c, CAST(y0 + (y + 1) * level AS DOUBLE) AS d FROM (SELECT *, CASE WHEN zone LIKE '%S' THEN 10000000 ELSE 0 END AS y0 FROM ({tiles}))".format(tiles=TILES_SQL)


@query(f"SELECT tile_id, printf('POLYGON ((%.1f %.1f, %.1f %.1f, %.1f %.1f, %.1f %.1f, %.1f %.1f))', a, b, c, b, c, d, a, d, a, b) AS wkt, a AS minx, b AS miny, c AS maxx, d AS maxy FROM ({BOX_TEXT})")
def wkt_roundtrip(spark, sf_dir):
    """Boxes from ids, written as WKT and read back."""
    rows = tileid.expand_ids(tiles(spark, sf_dir).select("tile_id")).withColumn("origin_x", F.lit(UTM_X0)).withColumn("origin_y", F.when(F.col("zone").endswith("S"), UTM_Y0_SOUTH).otherwise(0))
    rows = grid.with_box(rows).select("tile_id", geometry.wkt_polygon().alias("wkt"))
    return rows.select("tile_id", "wkt", *geometry.wkt_bounds(F.col("wkt")))


# --- projections and lookups ----------------------------------------------------------------------------------------

ZONED = f"SELECT *, CASE WHEN lat < 0 THEN 10000000 ELSE 0 END AS origin_y, concat(CAST(zone_num AS STRING), CASE WHEN south THEN 'S' ELSE 'N' END) AS zone FROM (SELECT *, CAST(least(60, floor((lon + 180) / 6) + 1) AS INT) AS zone_num, lat < 0 AS south FROM ({sql('customer', POINTS)}))"
FORWARD = nest(ZONED, projection.utm_forward())


def tile_of_point(level: int) -> str:
    return f"SELECT *, {tile_text(str(level), 'zone', f'floor((easting - 100000) / {level})', f'floor((northing - origin_y) / {level})')} AS tile_id FROM ({FORWARD})"


@query(f"SELECT k, zone, round(easting, 3) AS easting, round(northing, 3) AS northing FROM ({FORWARD})")
def utm_forward(spark, sf_dir):
    rows = spatial.points_to_tiles(view(spark, sf_dir, "customer", POINTS), 1200)
    return rows.select("k", "zone", F.round("easting", 3).alias("easting"), F.round("northing", 3).alias("northing"))


@query(f"SELECT k, round(lon, 6) AS lon, round(lat, 6) AS lat FROM ({sql('customer', POINTS)})")
def utm_roundtrip(spark, sf_dir):
    rows = projection.apply(spatial.with_zone(view(spark, sf_dir, "customer", POINTS)), projection.utm_forward())
    rows = projection.apply(rows.select("k", "easting", "northing", "zone_num", "south"), projection.utm_inverse())
    return rows.select("k", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


POLAR = {p: nest(f"SELECT * FROM ({sql('supplier', POLAR_POINTS)}) WHERE {test}", projection.polar_forward(p)) for p, test in (("NP", "lat >= 0"), ("SP", "lat < 0"))}


@query(" UNION ALL ".join(f"SELECT k, '{p}' AS zone, round(easting, 3) AS easting, round(northing, 3) AS northing, {tile_text('12000', repr(p), 'floor((easting + 4500000) / 12000)', f'floor((northing - {y0}) / 12000)')} AS tile_id FROM ({POLAR[p]})" for p, y0 in (("NP", 0), ("SP", -POLAR_HALF))))
def polar_latlon_to_tile(spark, sf_dir):
    rows = spatial.points_to_polar_tiles(view(spark, sf_dir, "supplier", POLAR_POINTS), 12000)
    return rows.select("k", "zone", F.round("easting", 3).alias("easting"), F.round("northing", 3).alias("northing"), "tile_id")


@query(f"SELECT k, round(lon, 6) AS lon, round(lat, 6) AS lat FROM ({sql('supplier', POLAR_POINTS)})")
def polar_roundtrip(spark, sf_dir):
    rows = spatial.points_to_polar_tiles(view(spark, sf_dir, "supplier", POLAR_POINTS), 12000).select("k", "zone", "easting", "northing")
    back = [projection.apply(rows.where(F.col("zone") == p), projection.polar_inverse(p)) for p in ("NP", "SP")]
    return back[0].unionByName(back[1]).select("k", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query(f"SELECT tile_id, count(*) AS n FROM ({tile_of_point(1200)}) GROUP BY tile_id")
def latlon_to_tile(spark, sf_dir):
    """Points to tiles, and how many each tile holds."""
    return spatial.points_to_tiles(view(spark, sf_dir, "customer", POINTS), 1200).groupBy("tile_id").agg(F.count(F.lit(1)).alias("n"))


#: Every ninth box goes over 180 degrees.
TURNED_BOXES = ("p_partkey AS k", *(f"CASE WHEN p_partkey % 9 = 0 THEN {t} ELSE {c} END AS {n}" for t, c, n in (("179.0 - p_size % 20", DEGREE_BOXES[1][:-8], "west"), ("-178.5 + p_size % 7", DEGREE_BOXES[3][:-8], "east"))), DEGREE_BOXES[2], DEGREE_BOXES[4])


def parts_sql(base: str) -> str:
    """The boxes of degrees of base, cut at 180 degrees and at the equator."""
    turned = f"SELECT * FROM ({base}) WHERE west <= east UNION ALL SELECT * REPLACE (180.0 AS east) FROM ({base}) WHERE west > east UNION ALL SELECT * REPLACE (-180.0 AS west) FROM ({base}) WHERE west > east"
    over = "south < 0 AND north > 0"
    return f"SELECT * FROM ({turned}) WHERE NOT ({over}) UNION ALL SELECT * REPLACE (0.0 AS north) FROM ({turned}) WHERE {over} UNION ALL SELECT * REPLACE (0.0 AS south) FROM ({turned}) WHERE {over}"


@query(
    "SELECT DISTINCT k, concat(CAST(unnest(range(CAST(least(60, floor((west + 180) / 6) + 1) AS BIGINT), CAST(least(60, floor((east + 180) / 6) + 1) AS BIGINT) + 1)) AS STRING), CASE WHEN south < 0 THEN 'S' ELSE 'N' END) AS zone "
    f"FROM ({parts_sql(sql('part', TURNED_BOXES))})"
)
def zones_from_bounds(spark, sf_dir):
    b = view(spark, sf_dir, "part", TURNED_BOXES)
    return b.select("k", F.explode(grid.zones_of_bounds(F.col("west"), F.col("south"), F.col("east"), F.col("north"))).alias("zone"))


# --- grids ----------------------------------------------------------------------------------------------------------


def zones_in_use(spark, sf_dir):
    """The zones that hold customers, with their bounds. At most 120 rows, whatever the input."""
    used = spatial.with_zone(view(spark, sf_dir, "customer", POINTS)).select("zone").distinct()
    return zone_table(spark).join(F.broadcast(used), "zone", "left_semi")


L = 120000
NX, NN, NS = -(-(UTM_X1 - UTM_X0) // L), -(-UTM_Y1_NORTH // L), -(-UTM_Y0_SOUTH // L)
CANDIDATES = (
    "SELECT z.*, x_idx, y_idx, 100000 + (x_idx + 0.5) * 120000 AS easting, origin_y + (y_idx + 0.5) * 120000 AS northing FROM "
    f"(SELECT DISTINCT zone, zone_num, south, origin_y FROM ({ZONED})) z, (SELECT unnest(range({NX})) AS x_idx), (SELECT unnest(range({-NS}, {NN})) AS y_idx) WHERE CASE WHEN south THEN y_idx < 0 ELSE y_idx >= 0 END"
)
INVERSE = nest(CANDIDATES, projection.utm_inverse())
NEAR = f"SELECT *, (120000 / {MARGIN[L]}) / (111320 * cos(radians(least(abs(lat), 80.0)))) AS h, 6.0 * zone_num - 186 AS lon_min, 6.0 * zone_num - 180 AS lon_max, CASE WHEN south THEN -80.0 ELSE 0.0 END AS lat_min, CASE WHEN south THEN 0.0 ELSE 84.0 END AS lat_max FROM ({INVERSE})"
GRID_SQL = f"SELECT zone, x_idx, y_idx, {tile_text('120000', 'zone', 'x_idx', 'y_idx')} AS tile_id, lon, lat FROM ({NEAR}) WHERE lon >= lon_min - h AND lon <= lon_max + h AND lon >= lon_min AND lon < lon_max AND lat >= lat_min AND lat <= lat_max"


@query(f"SELECT g.tile_id, round(g.lon, 6) AS lon, round(g.lat, 6) AS lat, count(p.k) AS points FROM ({GRID_SQL}) g LEFT JOIN ({tile_of_point(L)}) p ON g.tile_id = p.tile_id GROUP BY ALL")
def grid_utm_tiles(spark, sf_dir):
    """The 120 km tiles of the zones in use whose centre is in its zone, with the points that they hold."""
    made = grid.identify(grid.utm_grid(zones_in_use(spark, sf_dir), L, border=False))
    held = spatial.points_to_tiles(view(spark, sf_dir, "customer", POINTS), L).groupBy("tile_id").agg(F.count(F.lit(1)).alias("points"))
    return made.join(held, "tile_id", "left").select("tile_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.coalesce("points", F.lit(0).cast("long")).alias("points"))


CORNER_ROWS = nest(
    f"SELECT zone, zone_num, south, x_idx, y_idx, lon_min, lon_max, lat_min, lat_max, i, 100000 + (x_idx + dx) * 120000.0 AS easting, origin_y + (y_idx + dy) * 120000.0 AS northing FROM ({NEAR}), (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1)) AS c(i, dx, dy) "
    "WHERE lon >= lon_min - h AND lon <= lon_max + h AND NOT (lon >= lon_min AND lon < lon_max AND lat >= lat_min AND lat <= lat_max)",
    projection.utm_inverse(),
)
QUADS = "SELECT zone, x_idx, y_idx, lon_min, lon_max, lat_min, lat_max, list(lon ORDER BY i) AS xs, list(lat ORDER BY i) AS ys FROM ({rows}) GROUP BY ALL".format(rows=CORNER_ROWS)
#: Two convex shapes meet unless a side of one has the other on its outer side: the sides of the rectangle, then those of the quadrilateral.
MEETS = "list_min(xs) <= lon_max AND list_max(xs) >= lon_min AND list_min(ys) <= lat_max AND list_max(ys) >= lat_min AND list_max(xs) - list_min(xs) <= 12 AND " + " AND ".join(
    f"(xs[{j}] - xs[{i}]) * (CASE WHEN xs[{j}] > xs[{i}] THEN lat_max ELSE lat_min END - ys[{i}]) - (ys[{j}] - ys[{i}]) * (CASE WHEN ys[{j}] > ys[{i}] THEN lon_min ELSE lon_max END - xs[{i}]) >= 0" for i, j in ((1, 2), (2, 3), (3, 4), (4, 1))
)


@query(f"SELECT zone, count(*) AS tiles, CAST(sum(x_idx) AS BIGINT) AS x_sum, CAST(sum(y_idx) AS BIGINT) AS y_sum FROM (SELECT zone, x_idx, y_idx FROM ({GRID_SQL}) UNION ALL SELECT zone, x_idx, y_idx FROM ({QUADS}) WHERE {MEETS}) GROUP BY zone")
def grid_border_tiles(spark, sf_dir):
    """Tiles of each zone in use, with those at its border."""
    made = grid.utm_grid(zones_in_use(spark, sf_dir), L)
    return made.groupBy("zone").agg(F.count(F.lit(1)).alias("tiles"), F.sum("x_idx").alias("x_sum"), F.sum("y_idx").alias("y_sum"))


@query(f"SELECT tile_id, super_id FROM (SELECT tile_id, CAST(NULL AS STRING) AS super_id FROM ({GRID_SQL}))")
def grid_index_only(spark, sf_dir):
    """Ids and parents; no geometry column is read."""
    return grid.identify(grid.utm_grid(zones_in_use(spark, sf_dir), L, border=False)).select("tile_id", "super_id")


def _polar_grid_sql() -> str:
    out = []
    for p, y0, low, high in (("NP", 0, 84.0, 89.5), ("SP", -POLAR_HALF, -89.5, -80.0)):
        base = f"SELECT '{p}' AS zone, x_idx, y_idx, -4500000 + (x_idx + 0.5) * 120000 AS c_x, {y0} + (y_idx + 0.5) * 120000 AS c_y FROM (SELECT unnest(range(75)) AS x_idx), (SELECT unnest(range(38)) AS y_idx)"
        out.append(f"SELECT {tile_text('120000', 'zone', 'x_idx', 'y_idx')} AS tile_id, round(lat, 6) AS lat FROM ({nest(base, projection.polar_inverse(p, 'c_x', 'c_y'))}) WHERE lat BETWEEN {low} AND {high}")
    return " UNION ALL ".join(out)


POLAR_TILES = " UNION ALL ".join(f"SELECT {tile_text('120000', repr(p), 'floor((easting + 4500000) / 120000)', f'floor((northing - {y0}) / 120000)')} AS tile_id FROM ({POLAR[p]})" for p, y0 in (("NP", 0), ("SP", -POLAR_HALF)))


@query(f"SELECT g.tile_id, g.lat, coalesce(n, 0) AS points FROM ({_polar_grid_sql()}) g LEFT JOIN (SELECT tile_id, count(*) AS n FROM ({POLAR_TILES}) GROUP BY tile_id) p ON g.tile_id = p.tile_id")
def grid_polar_tiles(spark, sf_dir):
    """The polar tiles with the points that they hold."""
    poles = spark.sql("SELECT explode(array('NP', 'SP')) AS zone")
    held = spatial.points_to_polar_tiles(view(spark, sf_dir, "supplier", POLAR_POINTS), L).groupBy("tile_id").agg(F.count(F.lit(1)).alias("points"))
    made = grid.identify(grid.polar_grid(poles, L))
    return made.join(held, "tile_id", "left").select("tile_id", F.round("lat", 6).alias("lat"), F.coalesce("points", F.lit(0).cast("long")).alias("points"))


@query(f"SELECT box_id, {tile_text('1200', repr('31N'), 'x_idx', 'y_idx')} AS tile_id FROM (SELECT *, unnest(range(CAST(floor(miny / 1200) AS BIGINT), CAST(floor(maxy / 1200) AS BIGINT) + 1)) AS y_idx FROM (SELECT *, unnest(range(CAST(floor(minx / 1200) AS BIGINT), CAST(floor(maxx / 1200) AS BIGINT) + 1)) AS x_idx FROM ({sql('part', METRE_BOXES)})))")
def grid_bbox_tiles(spark, sf_dir):
    boxes = view(spark, sf_dir, "part", METRE_BOXES).withColumn("origin_x", F.lit(0)).withColumn("origin_y", F.lit(0))
    return grid.bounds_grid(boxes, 1200).select("box_id", tileid.format_id(F.col("level"), F.lit("31N"), F.col("x_idx"), F.col("y_idx")).alias("tile_id"))


@query(f"WITH z AS (SELECT DISTINCT zone, floor(x / (12000.0 / level)) AS rx, floor(y / (12000.0 / level)) AS ry FROM ({TILES_SQL}) WHERE level < 12000 AND k % 3 = 0) SELECT tile_id FROM ({TILES_SQL}) t WHERE NOT (12000 % level = 0 AND level < 12000 AND EXISTS (SELECT 1 FROM z WHERE z.zone = t.zone AND z.rx = floor(t.x / (12000.0 / t.level)) AND z.ry = floor(t.y / (12000.0 / t.level))))")
def grid_reference_filter(spark, sf_dir):
    """Tiles that are not below an empty reference tile."""
    t = tiles(spark, sf_dir)
    f = F.lit(12000) / F.col("level")
    zero = t.where("level < 12000 AND k % 3 = 0").select("zone", tileid.floor_div(F.col("x_idx"), f).alias("x_idx"), tileid.floor_div(F.col("y_idx"), f).alias("y_idx")).distinct()
    return grid.drop_zero_ancestors(t, zero, 12000).select("tile_id")


@query(f"SELECT DISTINCT l.level, p_size AS resolution, round(l.level / CAST(p_size AS DOUBLE), 2) AS pixels_per_side, round((l.level / CAST(p_size AS DOUBLE)) * (l.level / CAST(p_size AS DOUBLE)), 1) AS pixels_per_tile, l.level % p_size = 0 AS is_perfect FROM (SELECT CAST(unnest([{', '.join(map(str, LEVELS))}]) AS BIGINT) AS level) l, (SELECT CAST(p_size AS BIGINT) AS p_size FROM part)")
def sensor_compat(spark, sf_dir):
    """Levels against the sensor resolutions in the parts."""
    r = table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("resolution")).distinct()
    ratio = F.col("level") / F.col("resolution").cast("double")
    both = r.withColumn("level", F.explode(F.array(*(F.lit(x).cast("long") for x in LEVELS))))
    return both.select("level", "resolution", F.round(ratio, 2).alias("pixels_per_side"), F.round(ratio * ratio, 1).alias("pixels_per_tile"), (F.col("level") % F.col("resolution") == 0).alias("is_perfect"))


@query(
    "SELECT k, CAST(r AS BIGINT) AS row_no, round(south + r * 0.5, 6) AS lat, round(west + c * w, 6) AS lon FROM (SELECT *, unnest(range(CAST(floor((east - west) / w) AS BIGINT) + 1)) AS c FROM (SELECT *, 0.5 / greatest(cos(radians(south + r * 0.5)), 0.01) AS w FROM "
    f"(SELECT *, unnest(range(CAST(floor((north - south) / 0.5) AS BIGINT) + 1)) AS r FROM ({sql('part', DEGREE_BOXES)}))))"
)
def geodesic_lattice(spark, sf_dir):
    made = grid.geodesic_lattice(view(spark, sf_dir, "part", DEGREE_BOXES), 0.5 * 111320)
    return made.select("k", F.round((F.col("lat") - F.col("south")) / 0.5).cast("long").alias("row_no"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


BEARINGS = [("azimuth", "CAST((k * 37) % 360 AS DOUBLE)"), ("metres", "CAST((k * 7919) % 2000000 AS DOUBLE)")]


@query(f"SELECT k, round(to_lon, 7) AS lon, round(to_lat, 7) AS lat FROM ({nest(sql('customer', POINTS), [*BEARINGS, *geodesic.direct()])})")
def geodesic_direct(spark, sf_dir):
    """Where geodesics of a bearing and length from each point end."""
    made = projection.apply(view(spark, sf_dir, "customer", POINTS), [*BEARINGS, *geodesic.direct()])
    return made.select("k", F.round("to_lon", 7).alias("lon"), F.round("to_lat", 7).alias("lat"))


_LATTICE_M = 45_000.0
_LATTICE_ROWS = nest(
    f"SELECT *, unnest(range(CAST(floor((m_north - m_south) / {_LATTICE_M}) AS BIGINT) + 1)) AS r FROM ({nest(sql('part', DEGREE_BOXES), [*geodesic.meridian_forward('south', 'm_south'), *geodesic.meridian_forward('north', 'm_north')])})",
    [("metres", f"m_south + r * {_LATTICE_M}"), ("azimuth", "90.0"), ("zero", "0.0"), ("spacing", str(_LATTICE_M)), *geodesic.meridian_inverse("metres", "lat"), *geodesic.direct("zero", "lat", "azimuth", "spacing", "width", "ahead")],
)


@query(f"SELECT k, r AS row, c AS col, round(lat, 7) AS lat, round(west + c * width, 7) AS lon FROM (SELECT *, unnest(range(CAST(floor((east - west) / width) AS BIGINT) + 1)) AS c FROM ({_LATTICE_ROWS}))")
def ellipsoid_lattice(spark, sf_dir):
    """Points 45 km apart over the ellipsoid."""
    made = grid.ellipsoid_lattice(view(spark, sf_dir, "part", DEGREE_BOXES), _LATTICE_M)
    return made.select("k", "row", "col", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


# --- joins ----------------------------------------------------------------------------------------------------------


@query(f"WITH t AS (SELECT DISTINCT tile_id FROM ({tile_of_point(12000)}) WHERE k % 2 = 0) SELECT p.k, t.tile_id FROM ({tile_of_point(12000)}) p LEFT JOIN t ON p.tile_id = t.tile_id")
def point_tile_left_join(spark, sf_dir):
    points = view(spark, sf_dir, "customer", POINTS)
    some = spatial.points_to_tiles(points.where("k % 2 = 0"), 12000).select("tile_id").distinct()
    return spatial.assign_tiles(points, some, 12000).select("k", "tile_id")


@query(f"SELECT b.box_id, f.print_id FROM ({sql('part', METRE_BOXES)}) b JOIN ({sql('customer', FOOTPRINTS)}) f ON b.minx <= f.maxx AND b.maxx >= f.minx AND b.miny <= f.maxy AND b.maxy >= f.miny")
def box_overlap_join(spark, sf_dir):
    return grid.overlapping(view(spark, sf_dir, "part", METRE_BOXES), view(spark, sf_dir, "customer", FOOTPRINTS), 1000.0, "box_id", "print_id")


@query(
    f"SELECT b.box_id, f.print_id FROM ({sql('part', METRE_BOXES)}) b JOIN ({sql('customer', FOOTPRINTS)}) f ON b.minx <= f.maxx AND b.maxx >= f.minx AND b.miny <= f.maxy AND b.maxy >= f.miny "
    "WHERE (f.minx + f.maxx) / 2 + 0.25 > b.minx AND (f.minx + f.maxx) / 2 + 0.25 < b.maxx AND (f.miny + f.maxy) / 2 > b.miny AND (f.miny + f.maxy) / 2 < b.miny + ((f.minx + f.maxx) / 2 + 0.25 - b.minx)"
)
def scene_grid_join(spark, sf_dir):
    """Scene footprints (here triangles, the lower half of each box) and the tiles that overlap them with their centre (a little to its right, so that none is on an edge) inside."""
    scenes, prints = view(spark, sf_dir, "part", METRE_BOXES), view(spark, sf_dir, "customer", FOOTPRINTS)
    prints = prints.withColumn("x", (F.col("minx") + F.col("maxx")) / 2 + 0.25).withColumn("y", (F.col("miny") + F.col("maxy")) / 2)
    x, y = F.col("b_x"), F.col("b_y")
    bounded = (x > F.col("a_minx")) & (x < F.col("a_maxx")) & (y > F.col("a_miny")) & (y < F.col("a_maxy"))
    inside = geometry.within_corners(x, y, [(F.col(f"a_{i}"), F.col(f"a_{j}")) for i, j in (("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"))])
    return grid.met(scenes, prints, 1000.0, bounded & inside).select(F.col("a_box_id").alias("box_id"), F.col("b_print_id").alias("print_id"))


@query(f"WITH t AS (SELECT *, {PARENT_TEXT} AS super_id FROM ({TILES_SQL})), z AS (SELECT DISTINCT super_id FROM t WHERE k % 4 = 0 AND super_id IS NOT NULL) SELECT t.tile_id, z.super_id IS NOT NULL AS zero_parent FROM t LEFT JOIN z ON t.super_id = z.super_id")
def zero_parent_prune(spark, sf_dir):
    t = tiles(spark, sf_dir).withColumn("super_id", tileid.parent_id(*own()))
    parents = t.where("k % 4 = 0 AND super_id IS NOT NULL").select(F.col("super_id").alias("tile_id")).distinct().withColumn("props", F.create_map(F.lit(0), F.lit(1.0)))
    return zonal.split_by_zero_parent(t, parents).select("tile_id", "zero_parent")


@query(f"SELECT box_id, (maxx - minx) * (maxy - miny) > 2 * 500 * 500 AS oversized FROM ({sql('part', METRE_BOXES)})")
def oversized_placeholder(spark, sf_dir):
    rows = view(spark, sf_dir, "part", METRE_BOXES).withColumn("props", zonal.placeholder_props(geometry.area(), F.lit(500), F.create_map(F.lit(0), F.lit(1.0))))
    return rows.select("box_id", F.array_contains(F.map_keys("props"), zonal.OVERSIZED).alias("oversized"))


# --- zonal statistics -----------------------------------------------------------------------------------------------

SHARES_SQL = (
    f"SELECT tile_id, CASE WHEN total = 0 THEN 0 ELSE code END AS code, CASE WHEN total = 0 THEN 1.0 ELSE round(n / CAST(total AS DOUBLE), 5) END AS share FROM (SELECT *, sum(n) OVER (PARTITION BY tile_id) AS total, row_number() OVER (PARTITION BY tile_id ORDER BY code) AS r FROM "
    f"(SELECT tile_id, code, CASE WHEN code <> 1 THEN count(*) ELSE 0 END AS n FROM ({PIXELS_SQL}) GROUP BY tile_id, code)) WHERE n > 0 OR (total = 0 AND r = 1)"
)


def shares(spark, sf_dir):
    return zonal.class_shares(pixels(spark, sf_dir))


@query(SHARES_SQL)
def lc_proportions(spark, sf_dir):
    return longs(shares(spark, sf_dir), "code")


WIDE_SQL = f"SELECT tile_id, {', '.join(f'coalesce(max(CASE WHEN code = {c} THEN share END), 0.0) AS lc_{c}' for c in CODES)} FROM ({SHARES_SQL}) GROUP BY tile_id"


def wide(spark, sf_dir):
    return zonal.as_maps(shares(spark, sf_dir)).select("tile_id", *proportions.wide_columns(F.col("props")))


@query(WIDE_SQL)
def lc_props_wide(spark, sf_dir):
    return wide(spark, sf_dir)


@query(
    f"WITH s AS (SELECT {tile_text('2400', repr('31N'), 'floor(x / 2.0)', '2250')} AS super_id, s.* FROM ({SHARES_SQL}) s JOIN (SELECT DISTINCT tile_id, x FROM ({PIXELS_SQL})) p ON s.tile_id = p.tile_id) SELECT super_id AS tile_id, code, round(sum(share) / max(n), 6) AS share FROM s JOIN (SELECT super_id AS sid, count(DISTINCT tile_id) AS n FROM s GROUP BY super_id) ON super_id = sid GROUP BY super_id, code"
)
def lc_parent_mean(spark, sf_dir):
    maps = tileid.expand_ids(zonal.as_maps(shares(spark, sf_dir)))
    return longs(zonal.parent_means(maps.withColumn("super_id", tileid.parent_id(*own()))), "code")


@query(f"SELECT tile_id, code, round(sum(n) / sum(sum(n)) OVER (PARTITION BY tile_id), 4) AS share FROM (SELECT tile_id, x % 3 AS source, code, CAST(count(*) AS DOUBLE) AS n FROM ({PIXELS_SQL}) GROUP BY ALL) WHERE code <> 0 GROUP BY tile_id, code")
def lc_counts_merge(spark, sf_dir):
    counts = pixels(spark, sf_dir).groupBy("tile_id", (F.col("x") % 3).alias("source"), "code").agg(F.count(F.lit(1)).alias("n"))
    return longs(zonal.merged_shares(counts), "code")


RASTER = ("l_suppkey % 10 AS sheet", "l_orderkey AS \"row\"", "CAST(l_linenumber AS BIGINT) AS col", f"CAST({choose('l_partkey', CODES)} AS BIGINT) AS code")


@query(f"SELECT sheet, \"row\", col, code FROM (SELECT *, row_number() OVER (PARTITION BY sheet, \"row\", col ORDER BY n DESC, code) AS r FROM (SELECT sheet, CAST(floor(\"row\" / 4) AS BIGINT) AS \"row\", CAST(floor(col / 4) AS BIGINT) AS col, code, count(*) AS n FROM ({sql('lineitem', RASTER)}) GROUP BY ALL)) WHERE r = 1")
def lc_mode_downsample(spark, sf_dir):
    return zonal.majority_downsample(view(spark, sf_dir, "lineitem", [c.replace('"', "`") for c in RASTER]), 4, ["sheet"])


@query(f"SELECT tile_id, code FROM (SELECT tile_id, code, row_number() OVER (PARTITION BY tile_id ORDER BY l DESC) AS r FROM (SELECT {tile_text('1200', repr('31N'), 'l_suppkey', '4500')} AS tile_id, CAST({choose('l_partkey', CODES)} AS BIGINT) AS code, l_orderkey * 10 + l_linenumber AS l FROM lineitem) WHERE code <> 0) WHERE r = 1")
def mosaic_last_writer(spark, sf_dir):
    rows = view(spark, sf_dir, "lineitem", ("l_suppkey AS x", f"CAST({choose('l_partkey', CODES)} AS BIGINT) AS code", "l_orderkey * 10 + l_linenumber AS source_order"))
    return zonal.last_writer(rows.withColumn("tile_id", tileid.format_id(F.lit(1200), F.lit("31N"), F.col("x"), F.lit(4500))), ["tile_id"])


@query(f"WITH w AS ({WIDE_SQL}), t AS (SELECT *, {' + '.join(f'lc_{c}' for c in CODES)} AS total FROM w) SELECT tile_id, round({' + '.join(f'CASE WHEN lc_{c} > 0 THEN -(lc_{c} / total) * log2(lc_{c} / total) ELSE 0.0 END' for c in CODES)}, 6) AS entropy FROM t")
def lc_entropy(spark, sf_dir):
    return wide(spark, sf_dir).select("tile_id", F.round(proportions.entropy([F.col(c) for c in select.CLASSES]), 6).alias("entropy"))


MAJORITY_TEXT = "CASE " + " ".join(f"WHEN lc_{c} = greatest({', '.join(select.CLASSES)}) THEN 'lc_{c}'" for c in CODES) + " END"


def majorities(spark, sf_dir):
    return wide(spark, sf_dir).withColumn("majority", proportions.majority([F.col(c) for c in select.CLASSES], select.CLASSES))


@query(f"SELECT tile_id, {MAJORITY_TEXT} AS majority FROM ({WIDE_SQL})")
def lc_majority(spark, sf_dir):
    return majorities(spark, sf_dir).select("tile_id", "majority")


@query(f"SELECT majority, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM (SELECT {MAJORITY_TEXT} AS majority FROM ({WIDE_SQL})) GROUP BY majority")
def lc_majority_share(spark, sf_dir):
    from pyspark.sql import Window

    n = majorities(spark, sf_dir).groupBy("majority").agg(F.count(F.lit(1)).alias("n"))
    return n.select("majority", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4).alias("percent"))


@query(f"SELECT class, round(100 * v / sum(v) OVER (), 4) AS percent FROM (UNPIVOT (SELECT {', '.join(f'sum(lc_{c}) AS lc_{c}' for c in CODES)} FROM ({WIDE_SQL})) ON COLUMNS(*) INTO NAME class VALUE v)")
def lc_global_share(spark, sf_dir):
    from pyspark.sql import Window

    sums = wide(spark, sf_dir).agg(*(F.sum(c).alias(c) for c in select.CLASSES)).unpivot([], select.CLASSES, "class", "v")
    return sums.select("class", F.round(100 * F.col("v") / F.sum("v").over(Window.partitionBy()), 4).alias("percent"))


TEXTS = "CASE WHEN o_orderkey % 3 = 0 THEN '{0: 1.0}' WHEN o_orderkey % 3 = 1 THEN concat('{10: 0.', CAST(o_orderkey % 9 + 1 AS STRING), ', 40: 0.5}') ELSE concat('{\"20\": 0.', CAST(o_orderkey % 9 + 1 AS STRING), '}') END AS props"


@query(f"SELECT k, CAST(CASE WHEN k % 3 = 0 THEN 0 WHEN k % 3 = 1 THEN c ELSE 20 END AS BIGINT) AS code, CASE WHEN k % 3 = 0 THEN 1.0 WHEN k % 3 = 1 AND c = 40 THEN 0.5 ELSE CAST(concat('0.', CAST(k % 9 + 1 AS STRING)) AS DOUBLE) END AS share FROM (SELECT o_orderkey AS k, unnest(CASE WHEN o_orderkey % 3 = 1 THEN [10, 40] ELSE [0] END) AS c FROM orders)")
def props_text_to_map(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", TEXTS)
    return longs(rows.select("k", F.explode(proportions.text_to_map(F.col("props"))).alias("code", "share")), "code")


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN '{\"0\": 1.0}' WHEN o_orderkey % 3 = 1 THEN concat('{\"10\": 0.', CAST(o_orderkey % 9 + 1 AS STRING), ', \"40\": 0.5}') ELSE concat('{\"20\": 0.', CAST(o_orderkey % 9 + 1 AS STRING), '}') END AS props, o_orderkey % 3 = 0 AS all_zero FROM orders")
def props_json_roundtrip(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", TEXTS).withColumn("m", proportions.text_to_map(F.col("props")))
    return rows.select("k", proportions.map_to_json(F.col("m")).alias("props"), proportions.is_all_zero(F.col("m")).alias("all_zero"))
