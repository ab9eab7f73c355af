"""Deterministic stand-ins for geographic inputs, derived from the driver's tables by arithmetic that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapane.dims import CODES, LEVELS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def choose(key: str, values) -> str:
    """The value at key modulo their number."""
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


LON, LAT = "CAST(({k} * 7919) % 36000 AS DOUBLE) / 100 - 180", "CAST(({k} * 104729) % 16000 AS DOUBLE) / 100 - 79.5"
POINTS = ("c_custkey AS k", f"{LON.format(k='c_custkey')} AS lon", f"{LAT.format(k='c_custkey')} AS lat")
POLAR_POINTS = ("s_suppkey AS k", f"{LON.format(k='s_suppkey')} AS lon", "CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE -1 END * (CAST(s_suppkey * 37 % 500 AS DOUBLE) / 100 + 84.5) AS lat")
#: Tile id parts from the orders: all levels, both hemispheres, poles, suffixes; every thirteenth is malformed.
PARTS = (
    "o_orderkey AS k",
    f"CAST({choose('o_orderkey', LEVELS)} AS BIGINT) AS level",
    "CASE WHEN o_orderkey % 11 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'NP' ELSE 'SP' END ELSE concat(CAST((o_orderkey * 7) % 60 + 1 AS STRING), CASE WHEN o_orderkey % 2 = 1 THEN 'S' ELSE 'N' END) END AS zone",
    "o_orderkey % 5000 AS x",
    "CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 2 = 1 THEN -(o_orderkey % 7000) - 1 ELSE o_orderkey % 7000 END AS y",
    "CAST(CASE WHEN o_orderkey % 5 = 0 THEN 60 ELSE 0 END AS BIGINT) AS buf",
    "CAST(CASE WHEN o_orderkey % 15 = 0 THEN 16 ELSE 0 END AS BIGINT) AS ov",
    "o_orderkey % 13 = 0 AS bad",
)
#: Tiles from the customers, all well-formed.
TILES = (
    "c_custkey AS k",
    f"CAST({choose('c_custkey', LEVELS)} AS BIGINT) AS level",
    "concat(CAST((c_custkey * 7) % 60 + 1 AS STRING), CASE WHEN c_custkey % 2 = 1 THEN 'S' ELSE 'N' END) AS zone",
    "c_custkey % 5000 AS x",
    "CASE WHEN c_custkey % 2 = 1 THEN -(c_custkey % 7000) - 1 ELSE c_custkey % 7000 END AS y",
)
#: Pixels from the line items: tile by supplier; code 1 is outside the tile.
PIXELS = ("l_suppkey AS x", f"CAST(CASE WHEN l_linenumber = 7 THEN 1 ELSE {choose('l_partkey', CODES)} END AS BIGINT) AS code")
_W, _S = "CAST((p_partkey * 7919) % 34000 AS DOUBLE) / 100 - 179.7", "CAST((p_partkey * 104729) % 14000 AS DOUBLE) / 100 - 75.5"
DEGREE_BOXES = ("p_partkey AS k", f"{_W} AS west", f"{_S} AS south", f"{_W} + p_size % 20 AS east", f"{_S} + p_size % 5 AS north")
METRE_BOXES = (
    "p_partkey AS box_id",
    "CAST((p_partkey * 7919) % 100000 AS DOUBLE) AS minx",
    "CAST((p_partkey * 104729) % 100003 AS DOUBLE) AS miny",
    "CAST((p_partkey * 7919) % 100000 + p_size * 20 AS DOUBLE) AS maxx",
    "CAST((p_partkey * 104729) % 100003 + p_size * 20 AS DOUBLE) AS maxy",
)
FOOTPRINTS = (
    "c_custkey AS print_id",
    "CAST((c_custkey * 6029) % 100000 AS DOUBLE) AS minx",
    "CAST((c_custkey * 15485863) % 100003 AS DOUBLE) AS miny",
    "CAST((c_custkey * 6029) % 100000 + 300 AS DOUBLE) AS maxx",
    "CAST((c_custkey * 15485863) % 100003 + 300 AS DOUBLE) AS maxy",
)


def view(spark: SparkSession, sf_dir: str, name: str, columns) -> DataFrame:
    return table(spark, sf_dir, name).selectExpr(*columns)


def spread(spark: SparkSession, sf_dir: str, name: str, key: str, columns) -> DataFrame:
    """The same view with its rows dealt over tasks by a key, for costly columns: a table of few bytes is read by one task."""
    rows = table(spark, sf_dir, name).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)
    return rows.selectExpr(*columns)


def sql(name: str, columns) -> str:
    """The same view as DuckDB text."""
    return f"SELECT {', '.join(columns)} FROM {name}"


def nest(base: str, steps) -> str:
    """Steps of arithmetic, one query around the other."""
    for column, text in steps:
        base = f"SELECT *, {text} AS {column} FROM ({base})"
    return base


def tile_text(level="level", zone="zone", x="x", y="y") -> str:
    return f"printf('G%dm_%s_X%06d_Y%06d', CAST({level} AS BIGINT), {zone}, CAST({x} AS BIGINT), CAST({y} AS BIGINT))"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrapane.functions.tileid import format_id

    rows = view(spark, sf_dir, "lineitem", PIXELS)
    return rows.select(format_id(F.lit(1200), F.lit("31N"), F.col("x"), F.lit(4500)).alias("tile_id"), "x", "code")


PIXELS_SQL = f"SELECT {tile_text('1200', repr('31N'), 'x', '4500')} AS tile_id, x, code FROM ({sql('lineitem', PIXELS)})"
