"""Reading and writing tile tables."""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapane.functions.geometry import wkt_polygon
from terrapane.functions.tileid import zone_order


def read_tables(spark: SparkSession, paths: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """Parquet files or folders, recursively; only the named columns are read, and a column that some files lack is null there."""
    df = spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).parquet(*([paths] if isinstance(paths, str) else paths))
    if columns is None:
        return df
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of GeoJSON files: their properties (a schema text) and geometry as JSON text."""
    whole = spark.read.text(path, wholetext=True)
    features = F.explode(F.from_json(F.get_json_object("value", "$.features"), f"array<struct<properties:struct<{properties}>,geometry:string>>")).alias("f")
    return whole.select(features).select("f.properties.*", F.col("f.geometry").alias("geometry"))


def read_json_texts(spark: SparkSession, root: str) -> DataFrame:
    """value, file: every JSON file under root as one text."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))


def search_files(spark: SparkSession, root: str, text: str, glob: str = "*") -> DataFrame:
    """file, line: lines that hold the text."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root)
    return lines.where(F.col("value").contains(text)).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def csv_row_counts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, row_count without the header; a file of a header alone has 0."""
    lines = spark.read.text(paths).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("lines"))
    return lines.select("file", (F.col("lines") - 1).alias("row_count"))


def write_grid(tiles: DataFrame, path: str, form: str = "PARQUET", mode: str = "error") -> None:
    """PARQUET (snappy) and PARQUET_NO_COMPRESS by level and zone, GEOJSON as one feature a line, CSV with WKT. Other forms are refused."""
    if form in ("PARQUET", "PARQUET_NO_COMPRESS"):
        codec = "snappy" if form == "PARQUET" else "none"
        rows = tiles.repartition("level", "zone").sortWithinPartitions("level", "zone", "x_idx", "y_idx")
        rows.write.mode(mode).option("compression", codec).partitionBy("level", "zone").parquet(path)
    elif form == "GEOJSON":
        ring = F.array(*(F.array(F.col(a), F.col(b)) for a, b in (("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy"), ("minx", "miny"))))
        geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
        props = F.struct(*(c for c in tiles.columns if c not in ("minx", "miny", "maxx", "maxy")))
        tiles.select(F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), geometry.alias("geometry"))).alias("value")).write.mode(mode).text(path)
    elif form == "CSV":
        tiles.withColumn("geometry", wkt_polygon()).write.mode(mode).csv(path, header=True)
    else:
        raise ValueError(f"unknown form {form}")


MOST_ROWS = 5_000_000  # of a written file


def write_enriched(tiles: DataFrame, path: str, how: str = "partitioned", mode: str = "error") -> None:
    """single_file (one task writes it, as its name says), per_level or partitioned (by level and zone). A level or zone of any size is cut into files of a bounded size by as many tasks."""
    if how == "single_file":
        tiles.coalesce(1).write.mode(mode).parquet(path)
    elif how in ("per_level", "partitioned"):
        by = ["level"] if how == "per_level" else ["level", "zone"]
        # Spark splits what is large of a rebalanced key, and joins what is small
        tiles.hint("rebalance", *by).write.mode(mode).option("maxRecordsPerFile", MOST_ROWS).partitionBy(*by).parquet(path)
    else:
        raise ValueError(f"unknown way {how}")


def write_index(tiles: DataFrame, path: str, groups: int = 512, mode: str = "error") -> None:
    """tile_id, super_id in natural zone order, zstd, in files of about rows / groups rows (1,024 at least)."""
    number, south = zone_order(F.col("zone"))
    rows = tiles.select("tile_id", "super_id", number.alias("z"), south.alias("h"), (-F.col("level")).alias("v")).orderBy("z", "h", "v", "tile_id")
    most = max(math.ceil(tiles.count() / groups), 1024)
    rows.select("tile_id", "super_id").write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", most).parquet(path)


def write_chips(chips: DataFrame, path: str, mode: str = "error") -> None:
    """Binary payloads: zstd, dictionaries, 2 MB pages."""
    chips.write.mode(mode).option("compression", "zstd").option("parquet.page.size", 2 << 20).option("parquet.enable.dictionary", True).parquet(path)


def save_tables(frames: dict[str, DataFrame], prefix: str = "") -> None:
    """Each frame as a catalog table."""
    for name, df in frames.items():
        df.write.mode("overwrite").saveAsTable(f"{prefix}{name}")


def manifest_text(manifest: DataFrame, note: str = "") -> str:
    """JSON of a manifest's totals."""
    row = manifest.agg(F.coalesce(F.sum("tile_count"), F.lit(0)).alias("tiles"), F.countDistinct("zone").alias("zones"), F.countDistinct("level").alias("levels")).first()
    return json.dumps(row.asDict() | {"note": note}, sort_keys=True)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; columns that some lack are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def not_done(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work items that have no output yet."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")
