"""Tables about tables: manifests, tile indexes, structure scans, nesting checks, scene records, score views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapane.dims import LEVELS
from terrapane.functions import tileid

STAC = (
    "id string, stac_version string, stac_extensions array<string>, bbox array<double>, geometry string, "
    "properties map<string,string>, assets map<string,struct<href:string,type:string>>"
)
PROVIDERS = "array<struct<name:string,roles:array<string>,url:string>>"


def manifest(tiles: DataFrame) -> DataFrame:
    """zone, level, tile_count and bounds of each zone and level."""
    return tiles.groupBy("zone", "level").agg(
        F.count(F.lit(1)).alias("tile_count"), F.min("minx").alias("xmin"), F.min("miny").alias("ymin"), F.max("maxx").alias("xmax"), F.max("maxy").alias("ymax")
    )


def nesting_report(tiles: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """level, checked, correct, incorrect, percent: does super_id say what the indices do?"""
    want = tileid.parent_id(F.col("level"), F.col("zone"), F.col("x_idx"), F.col("y_idx"), levels)
    rows = tiles.where("super_id IS NOT NULL").withColumn("ok", F.coalesce(F.col("super_id") == want, F.lit(False)))
    out = rows.groupBy("level").agg(F.count(F.lit(1)).alias("checked"), F.count_if("ok").alias("correct"))
    return out.select("level", "checked", "correct", (F.col("checked") - F.col("correct")).alias("incorrect"), F.round(100 * F.col("correct") / F.col("checked"), 2).alias("percent"))


def orphans(tiles: DataFrame) -> DataFrame:
    """Tiles whose parent is not in the table."""
    return tiles.where("super_id IS NOT NULL").join(tiles.select(F.col("tile_id").alias("super_id")), "super_id", "left_anti")


def structure(spark: SparkSession, root: str) -> DataFrame:
    """relative_path, is_folder, file_size, file_extension of every file under root and of the folders that hold them; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    base = F.regexp_replace(F.lit(root), r"^[a-z]+:/*|/+$", "")
    name = F.regexp_replace(F.expr("substring(path, instr(path, base) + length(base))"), r"^/+", "")
    rel = files.withColumn("base", base).select(name.alias("relative_path"), F.col("length").alias("file_size"))
    parts = F.split("relative_path", "/")
    folders = rel.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda i: F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, i), "/")).otherwise(""))).alias("relative_path"))
    folders = folders.where("relative_path <> ''").distinct()
    files = rel.select("relative_path", F.lit(False).alias("is_folder"), "file_size", F.regexp_extract("relative_path", r"(\.[^./]+)$", 1).alias("file_extension"))
    return files.unionByName(folders.select("relative_path", F.lit(True).alias("is_folder"), F.lit(None).cast("long").alias("file_size"), F.lit("").alias("file_extension")))


def row_counts(df: DataFrame) -> DataFrame:
    """file, row_count of a read table."""
    return df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("row_count"))


def structure_summary(files: DataFrame) -> DataFrame:
    """n_files, n_folders, megabytes (decimal, 2 places)."""
    return files.agg(F.count_if(~F.col("is_folder")).alias("n_files"), F.count_if("is_folder").alias("n_folders"), F.round(F.coalesce(F.sum("file_size"), F.lit(0)) / 1e6, 2).alias("megabytes"))


def flatten_scenes(items: DataFrame, column: str = "value") -> DataFrame:
    """A column of STAC item texts to one row per scene; colons in property names become underscores."""
    s = F.from_json(column, STAC)
    rows = items.select(s.alias("s"), F.from_json(F.get_json_object(column, "$.properties.providers"), PROVIDERS).alias("providers"))
    props = F.transform_keys(F.map_filter("s.properties", lambda k, v: k != "providers"), lambda k, v: F.replace(k, F.lit(":"), F.lit("_")))
    pick = lambda f: F.coalesce(F.transform("providers", lambda p: p[f]), F.array())
    return rows.select(
        F.col("s.id").alias("scene_id"),
        "s.stac_version",
        "s.stac_extensions",
        "s.bbox",
        "s.geometry",
        props.alias("properties"),
        pick("name").alias("provider_names"),
        pick("roles").alias("provider_roles"),
        pick("url").alias("provider_urls"),
        F.coalesce(F.map_keys("s.assets"), F.array()).alias("asset_keys"),
        F.coalesce(F.transform(F.map_values("s.assets"), lambda a: a["href"]), F.array()).alias("asset_hrefs"),
    )


BANDS = "array<struct<name:string,common_name:string,center_wavelength:double,full_width_half_max:double,solar_illumination:double>>"


def band_features(items: DataFrame, column: str = "value", at: str = "$.properties.eo:bands") -> DataFrame:
    """scene_id, features: a map of band_<name>_<field> to text for each band of a STAC item; of bands of one name the last holds."""
    bands = F.from_json(F.get_json_object(column, at.replace("eo:bands", "['eo:bands']").replace(".[", "[")), BANDS)
    rows = items.select(F.get_json_object(column, "$.id").alias("scene_id"), F.coalesce(bands, F.array()).alias("bands"))
    name = lambda b: F.replace(F.replace(F.lower(F.coalesce(b["name"], F.lit(""))), F.lit("band_"), F.lit("")), F.lit(" "), F.lit("_"))
    last = F.filter("bands", lambda b, i: ~F.exists(F.slice("bands", i + 2, F.size("bands")), lambda c: name(c) == name(b)))
    fields = ("common_name", "center_wavelength", "full_width_half_max", "solar_illumination")
    entries = F.flatten(F.transform(last, lambda b: F.array(*(F.struct(F.concat(F.lit("band_"), name(b), F.lit(f"_{f}")).alias("key"), b[f].cast("string").alias("value")) for f in fields))))
    return rows.select("scene_id", F.map_from_entries(entries).alias("features"))


def presence_counts(df: DataFrame, columns: list[str], none: str = "none") -> DataFrame:
    """column, n: in how many rows each column says something."""
    counted = df.agg(*(F.count_if(F.coalesce(F.col(c) != none, F.lit(False))).alias(c) for c in columns))
    return counted.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in columns))))


def same_distinct(df: DataFrame, a: str, b: str) -> DataFrame:
    """n_a, n_b, same: have two columns equally many distinct values?"""
    n = df.agg(F.count_distinct(a).alias("n_a"), F.count_distinct(b).alias("n_b"))
    return n.withColumn("same", F.col("n_a") == F.col("n_b"))


def structure_yaml(files: DataFrame) -> DataFrame:
    """relative_path, line: the scanned tree as YAML lines, in order; folders are keys and files have their sizes."""
    depth = F.size(F.split("relative_path", "/")) - 1
    name = F.regexp_extract("relative_path", "([^/]*)$", 1)
    line = F.concat(F.repeat(F.lit("  "), depth), F.lit('"'), name, F.lit('":'), F.when(F.col("is_folder"), "").otherwise(F.concat(F.lit(" "), F.col("file_size").cast("string"))))
    return files.select("relative_path", line.alias("line")).orderBy(F.split("relative_path", "/"))


def snapshot(files: DataFrame, path: str, version: str) -> None:
    """A version of a structure scan: its rows, and its summary as one JSON line."""
    files.write.parquet(f"{path}/{version}/structure")
    structure_summary(files).select(F.to_json(F.struct(F.lit(version).alias("version"), "n_files", "n_folders", "megabytes")).alias("value")).write.text(f"{path}/{version}/summary")


def grid_readme(manifest: DataFrame, title: str, levels: tuple[int, ...] = LEVELS, buffer: int = 0) -> str:
    """A short description of a written grid, from its manifest."""
    n, zones = manifest.agg(F.coalesce(F.sum("tile_count"), F.lit(0)), F.count_distinct("zone")).first()
    return "\n".join([f"# {title}", "", f"* {n} tiles in {zones} zones", f"* levels: {', '.join(map(str, levels))} metres a side", f"* buffer: {buffer} metres", "* ids: G1200m_31N_X000123_Y000456, with _buf60 for a buffer of 60 metres", ""])


def scene_time(text: Column) -> Column:
    """ISO text with a Z or an offset to a timestamp."""
    return F.to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def contains_any_case(column: str, word: str) -> Column:
    """Case-insensitive contains; null is no match."""
    return F.coalesce(F.lower(column).contains(word.lower()), F.lit(False))


def first_by_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by order. An aggregate, so that a key of many rows is reduced before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*key, "row.*")


def pivot_unique(df: DataFrame, index: str, column: str, value: str, values: list) -> DataFrame:
    """Pivot that fails on two rows for one cell."""
    cell = F.when(F.count(value) <= 1, F.first(value, True)).otherwise(F.raise_error(F.lit("two rows for one cell")).cast("double"))
    return df.groupBy(index).pivot(column, values).agg(cell)


def reindex(df: DataFrame, key: str, ordered: list[str]) -> DataFrame:
    """A row for each of ordered, in that order, null where df has none."""
    dim = df.sparkSession.createDataFrame(list(enumerate(ordered)), f"position int, {key} string")
    return dim.join(df, key, "left").orderBy("position")


def tile_metadata(tiles: DataFrame) -> DataFrame:
    """tile_id, zone, level, crs, bounds and centre of each tile (with minx … maxy)."""
    return tiles.select(
        "tile_id",
        "zone",
        "level",
        tileid.epsg(F.col("zone")).alias("crs"),
        "minx",
        "miny",
        "maxx",
        "maxy",
        ((F.col("minx") + F.col("maxx")) / 2).alias("centroid_x"),
        ((F.col("miny") + F.col("maxy")) / 2).alias("centroid_y"),
    )


#: Attributes that later jobs fill in, and their types.
ATTRIBUTES = (("landcover_vector", "string"), ("climate_zone", "string"), ("population_density", "double"), ("ndvi_avg", "double"), ("lst_mean", "double"))


def attribute_table(tiles: DataFrame) -> DataFrame:
    """tile_id, zone, level, crs and the attributes, all null."""
    return tiles.select("tile_id", "zone", "level", tileid.epsg(F.col("zone")).alias("crs"), *(F.lit(None).cast(t).alias(n) for n, t in ATTRIBUTES))


def map_back(tiles: DataFrame, subsets: dict[str, DataFrame], key: str = "tile_id", none: str = "none") -> DataFrame:
    """tiles with a column for each saved subset (key): its name where it holds the tile."""
    for name, rows in subsets.items():
        mark = rows.select(key, F.lit(name).alias(name)).distinct()
        tiles = tiles.drop(name).join(mark, key, "left").withColumn(name, F.coalesce(name, F.lit(none)))
    return tiles


def guard(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """df; a row that fails a test stops the job with the test's message."""
    checks = [F.when(~F.coalesce(ok, F.lit(False)), F.raise_error(F.lit(message)).cast("boolean")).otherwise(True) for message, ok in tests.items()]
    return df.where(F.least(*checks) if len(checks) > 1 else checks[0]) if checks else df
