"""Queries over packed rasters: shares and chips of tiles, polygon masks, warping; with their DuckDB SQL on the pixels themselves."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrapane.dims import CODES
from terrapane.functions import projection, tileid
from terrapane.operators import raster
from terrapane.plans.queries import SHARES_SQL, longs, query
from terrapane.plans.views import PIXELS, choose, nest, spread, sql, view
from terrapane.scratch import written

#: A tile of 1,200 m has 48 x 48 pixels of 25 m here; blocks of 64 lie across tiles.
TILE_PIXELS, PIXEL_M, BLOCK = 48, 25.0, 64


def packed_tiles(spark, sf_dir):
    """The pixels of each tile, row by row within it, as a packed raster of all tiles side by side; and the tiles' boxes."""
    rows = view(spark, sf_dir, "lineitem", (*PIXELS, "l_orderkey", "l_linenumber"))
    order = F.row_number().over(Window.partitionBy("x").orderBy("l_orderkey", "l_linenumber")) - 1
    placed = rows.withColumn("i", order).select(
        F.lit("31N").alias("source"), F.floor(F.col("i") / TILE_PIXELS).alias("row"), (F.col("x") * TILE_PIXELS + F.col("i") % TILE_PIXELS).alias("col"), "code"
    )
    box = lambda n: F.lit(float(n))
    tiles = rows.select("x").distinct().select(
        tileid.format_id(F.lit(1200), F.lit("31N"), F.col("x"), F.lit(4500)).alias("tile_id"),
        F.lit("31N").alias("source"),
        (F.col("x") * 1200.0).alias("minx"),
        box(0).alias("miny"),
        (F.col("x") * 1200.0 + 1200.0).alias("maxx"),
        box(1200).alias("maxy"),
    )
    return written(raster.pack_blocks(placed, BLOCK), "blocks"), raster.box_windows(tiles, 0.0, 1200.0, PIXEL_M)


@query(SHARES_SQL)
def block_tile_shares(spark, sf_dir):
    """Class shares of tiles from packed blocks: the same as from the pixels."""
    blocks, windows = packed_tiles(spark, sf_dir)
    return longs(raster.block_shares(windows, blocks, BLOCK), "code")


@query(SHARES_SQL)
def block_tile_chips(spark, sf_dir):
    """The shares that come with the tiles' chips, in one pass."""
    blocks, windows = packed_tiles(spark, sf_dir)
    chips = raster.zonal_chips(windows, blocks, BLOCK)
    return longs(chips.select("tile_id", F.explode("props").alias("code", "share")), "code")


#: A raster of the orders, 128 pixels wide; and a rotated square in it for each customer, in pixels.
SHEET = ("'orders' AS source", "o_orderkey // 128 AS \"row\"", "o_orderkey % 128 AS col", f"CAST({choose('o_orderkey', CODES)} AS BIGINT) AS code")
_A, _B = "(2 + c_custkey % 7 + 0.3)", "(c_custkey % 5 - 1.9)"
_X, _Y = "((c_custkey * 37) % 128 + 0.21)", "(c_custkey * 10 / 128.0 + 0.13)"
CORNERS = ((f"{_X} + {_A}", f"{_Y} + {_B}"), (f"{_X} - {_B}", f"{_Y} + {_A}"), (f"{_X} - {_A}", f"{_Y} - {_B}"), (f"{_X} + {_B}", f"{_Y} - {_A}"))
QUADS = ("c_custkey AS tile_id", *(f"CAST({v} AS DOUBLE) AS {n}{i}" for i, (x, y) in enumerate(CORNERS) for n, v in (("x", x), ("y", y))))
_HITS = " + ".join(
    f"CASE WHEN (y{i} > py) <> (y{(i + 1) % 4} > py) AND px < (x{(i + 1) % 4} - x{i}) * (py - y{i}) / (y{(i + 1) % 4} - y{i}) + x{i} THEN 1 ELSE 0 END" for i in range(4)
)


def sheet(spark, sf_dir):
    return view(spark, sf_dir, "orders", [c.replace("//", "DIV").replace('"row"', "row") for c in SHEET])


@query(
    f"WITH q AS ({sql('customer', QUADS)}), p AS (SELECT code, CAST(\"row\" AS DOUBLE) + 0.5 AS py, CAST(col AS DOUBLE) + 0.5 AS px FROM ({sql('orders', SHEET)})), "
    "b AS (SELECT *, least(x0, x1, x2, x3) AS lx, greatest(x0, x1, x2, x3) AS hx, least(y0, y1, y2, y3) AS ly, greatest(y0, y1, y2, y3) AS hy FROM q), "
    f"n AS (SELECT tile_id, code, count(*) AS n FROM b JOIN p ON px BETWEEN lx AND hx AND py BETWEEN ly AND hy WHERE ({_HITS}) % 2 = 1 GROUP BY ALL), "
    "s AS (SELECT tile_id, code, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY tile_id), 5) AS share FROM n WHERE code <> 1) "
    "SELECT q.tile_id, coalesce(code, 0) AS code, coalesce(share, 1.0) AS share FROM q LEFT JOIN s ON s.tile_id = q.tile_id"
)
def masked_tile_shares(spark, sf_dir):
    """Shares of the pixels whose centres are within rotated quadrilaterals, by their scanlines."""
    blocks = written(raster.pack_blocks(sheet(spark, sf_dir), BLOCK), "sheet")
    quads = spread(spark, sf_dir, "customer", "c_custkey", QUADS)
    points = F.array(*(F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in range(4)))
    shapes = quads.select("tile_id", F.lit("orders").alias("source"), raster.ring_edges(points).alias("edges"))
    counts = raster.zonal_counts(raster.polygon_windows(shapes), blocks, BLOCK)
    return longs(raster.shares_of_counts(counts, quads), "code")


#: Sheets of 128 x 128 orders in degrees, and a grid in metres of zone 31N over each.
STEP, SPAN = 0.0001, 60
DEGREE_SHEETS = ("DISTINCT o_orderkey // 16384 AS source", "3.0 + 0.05 * ((o_orderkey // 16384) % 50) AS west", "40.0 + 0.05 * (o_orderkey // 819200) AS north")
DEGREE_PIXELS = ("o_orderkey // 16384 AS source", "(o_orderkey // 128) % 128 AS \"row\"", "o_orderkey % 128 AS col", f"CAST({choose('o_orderkey * 7', CODES)} AS BIGINT) AS code")
_CORNER = [("lon", "west + 0.001"), ("lat", "north - 0.0001"), ("zone_num", "31"), ("south", "false"), *projection.utm_forward()]


def _warp_sql(resolution: float, k: int) -> str:
    grids = nest(f"SELECT source, CAST(west AS DOUBLE) AS west, CAST(north AS DOUBLE) AS north FROM (SELECT {', '.join(DEGREE_SHEETS)} FROM orders)", [*_CORNER, ("minx", "floor(easting / 100) * 100"), ("maxy", "floor(northing / 100) * 100")])
    at = f"SELECT source, west, north, zone_num, south, r.i AS \"row\", c.i AS col, minx + (c.i + (b.i + 0.5) / {k}.0) * {resolution} AS easting, maxy - (r.i + (a.i + 0.5) / {k}.0) * {resolution} AS northing FROM ({grids}) g"
    for name, n in (("r", SPAN), ("c", SPAN), ("a", k), ("b", k)):
        at += f" CROSS JOIN (SELECT unnest(range({n})) AS i) {name}"
    samples = nest(at, projection.utm_inverse())
    return (
        f"WITH s AS (SELECT source, \"row\", col, CAST(floor((north - lat) / {STEP}) AS BIGINT) AS srow, CAST(floor((lon - west) / {STEP}) AS BIGINT) AS scol FROM ({samples})), "
        f"n AS (SELECT s.source, s.\"row\", s.col, coalesce(p.code, 0) AS code, count(*) AS n FROM s LEFT JOIN ({sql('orders', DEGREE_PIXELS)}) p ON p.source = s.source AND p.\"row\" = srow AND p.col = scol GROUP BY ALL), "
        "b AS (SELECT *, row_number() OVER (PARTITION BY source, \"row\", col ORDER BY n DESC, code) AS place FROM n) SELECT source AS target, code, count(*) AS n, sum(\"row\" * 1000 + col)::BIGINT AS places FROM b WHERE place = 1 GROUP BY ALL"
    )


def warped(spark, sf_dir, resolution: float):
    spelled = lambda columns: [c.replace("//", "DIV").replace('"row"', "row") for c in columns]
    blocks = written(raster.pack_blocks(view(spark, sf_dir, "orders", spelled(DEGREE_PIXELS)), BLOCK), "degrees")
    sheets = view(spark, sf_dir, "orders", ["o_orderkey DIV 16384 AS source"]).distinct()
    sheets = sheets.selectExpr("source", "CAST(3.0 + 0.05 * (source % 50) AS DOUBLE) AS west", "CAST(40.0 + 0.05 * (source DIV 50) AS DOUBLE) AS north")
    grids = projection.apply(sheets, _CORNER, ("easting", "northing"))
    grids = grids.select(F.col("source").alias("target"), "source", "west", "north", "zone_num", "south", (F.floor(F.col("easting") / 100) * 100.0).alias("minx"), (F.floor(F.col("northing") / 100) * 100.0).alias("maxy"), F.lit(SPAN).alias("width"), F.lit(SPAN).alias("height"))
    found = raster.warp(grids, blocks, F.col("west"), F.col("north"), STEP, resolution, BLOCK)
    return longs(found.groupBy("target", "code").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("row") * 1000 + F.col("col")).alias("places")), "code")


@query(_warp_sql(10.0, 1))
def raster_warp_nearest(spark, sf_dir):
    """Sheets in degrees warped to 10 m: the nearest pixel. The places of each class are summed up."""
    return warped(spark, sf_dir, 10.0)


@query(_warp_sql(20.0, 2))
def raster_warp_mode(spark, sf_dir):
    """The same to 20 m: the most frequent of each pixel's samples."""
    return warped(spark, sf_dir, 20.0)
