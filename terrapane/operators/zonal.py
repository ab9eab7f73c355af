"""Zonal statistics over pixel tables (tile_id, code): histograms become class proportions of each tile and of its parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapane.functions.arrays import compress_uint8
from terrapane.functions.proportions import is_all_zero
from terrapane.operators.grid import met

#: Code of pixels outside the tile's polygon, and of placeholder tiles.
OUTSIDE, OVERSIZED = 1, -1
MOST_GRIDS = 64  # (level, origin_x, origin_y) of one call of scene_chips


def class_shares(pixels: DataFrame, digits: int = 5) -> DataFrame:
    """tile_id, code, share: the histogram of each tile over pixels inside it. A tile with none, or with code 0 only, is (0, 1.0)."""
    n = pixels.groupBy("tile_id", "code").agg(F.count(F.lit(1)).alias("n"))
    inside = n.withColumn("n", F.when(F.coalesce(F.col("code") != OUTSIDE, F.lit(False)), F.col("n")).otherwise(0))
    tile = Window.partitionBy("tile_id")  # one row per class: at most the legend's length, whatever the tile's pixels
    rows = inside.withColumn("total", F.sum("n").over(tile)).withColumn("first", F.row_number().over(tile.orderBy("code")) == 1)
    return rows.where((F.col("n") > 0) | ((F.col("total") == 0) & F.col("first"))).select(
        "tile_id", F.when(F.col("total") == 0, 0).otherwise(F.col("code")).cast("int").alias("code"), F.when(F.col("total") == 0, 1.0).otherwise(F.round(F.col("n") / F.col("total"), digits)).alias("share")
    )


def as_maps(shares: DataFrame, key: str = "tile_id") -> DataFrame:
    """key, props: shares gathered to one MAP<INT, DOUBLE> per key, at most the legend's length."""
    return shares.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "share")))).alias("props"))


def merged_shares(counts: DataFrame, digits: int = 4) -> DataFrame:
    """counts (tile_id, source, code, n) of several rasters: counts are added before they become shares; code 0 (no data) is left out."""
    n = counts.where("code <> 0").groupBy("tile_id", "code").agg(F.sum("n").alias("n"))
    return n.select("tile_id", F.col("code").cast("int").alias("code"), F.round(F.col("n") / F.sum("n").over(Window.partitionBy("tile_id")), digits).alias("share"))


def tile_raster_counts(tiles: DataFrame, rasters: DataFrame, cell: float, pixel: float) -> DataFrame:
    """tile_id, source, code, n: tiles (tile_id, minx … maxy) against footprints of rasters of one code (source, code, minx … maxy), as whole pixels of their overlap. Boxes meet in coarse cells; nothing is compared with everything."""
    box = ("minx", "miny", "maxx", "maxy")
    side = lambda a: F.least(f"a_max{a}", f"b_max{a}") - F.greatest(f"a_min{a}", f"b_min{a}")
    n = F.floor(side("x") * side("y") / (pixel * pixel)).cast("long")
    pairs = met(tiles.select("tile_id", *box), rasters.select("source", "code", *box), cell, n > 0)
    return pairs.select(F.col("a_tile_id").alias("tile_id"), F.col("b_source").alias("source"), F.col("b_code").alias("code"), n.alias("n"))


def raster_proportions(tiles: DataFrame, rasters: DataFrame, cell: float, pixel: float, digits: int = 4) -> DataFrame:
    """tile_id, code, share: tiles meet their rasters, counts are merged over rasters, and become shares; in one pass."""
    return merged_shares(tile_raster_counts(tiles, rasters, cell, pixel), digits)


def parent_means(children: DataFrame, parent: str = "super_id", digits: int = 6) -> DataFrame:
    """children (parent, props) to tile_id, code, share: means over all children, an absent class counting 0."""
    rows = children.groupBy(parent).agg(F.count(F.lit(1)).alias("children"))
    sums = children.select(parent, F.explode("props").alias("code", "v")).groupBy(parent, "code").agg(F.sum("v").alias("v"))
    return sums.join(rows, parent).select(F.col(parent).alias("tile_id"), F.col("code").cast("int").alias("code"), F.round(F.col("v") / F.col("children"), digits).alias("share"))


def majority_downsample(pixels: DataFrame, factor: int, by: list[str]) -> DataFrame:
    """pixels (by…, row, col, code) to blocks of factor x factor: the most frequent code, the smallest of equal ones."""
    blocks = pixels.select(*by, F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col"), "code")
    n = blocks.groupBy(*by, "row", "col", "code").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*by, "row", "col").agg(F.max_by("code", F.struct("n", (-F.col("code")).alias("order"))).alias("code"))


def last_writer(pixels: DataFrame, by: list[str], order: str = "source_order") -> DataFrame:
    """Mosaic of sources: for each pixel the code of the last source that has data (0 is none)."""
    return pixels.where("code <> 0").groupBy(*by).agg(F.max_by("code", order).alias("code"))


def split_by_zero_parent(tiles: DataFrame, parents: DataFrame) -> DataFrame:
    """tiles (…, super_id) with zero_parent: does the parent (tile_id, props) hold nothing? One left join in place of two scans."""
    zero = parents.where(is_all_zero(F.col("props"))).select(F.col("tile_id").alias("super_id"), F.lit(True).alias("is_zero")).distinct()
    return tiles.join(zero, "super_id", "left").withColumn("zero_parent", F.coalesce("is_zero", F.lit(False))).drop("is_zero")


def proportions_with_pruning(tiles: DataFrame, parents: DataFrame, pixels: DataFrame) -> DataFrame:
    """tile_id, props for all tiles: {0: 1.0} below an empty parent or where there are no pixels; only the rest meets the pixels."""
    split = split_by_zero_parent(tiles, parents)
    wanted = pixels.join(split.where("NOT zero_parent").select("tile_id"), "tile_id", "left_semi")
    found = as_maps(class_shares(wanted))
    empty = F.create_map(F.lit(0), F.lit(1.0))
    return split.join(found, "tile_id", "left").select("tile_id", F.coalesce("props", empty).alias("props"))


def placeholder_props(area: Column, level: Column, props: Column) -> Column:
    """{-1: 1.0} for tiles of more than twice their nominal area."""
    return F.when(area > 2 * level * level, F.create_map(F.lit(OVERSIZED), F.lit(1.0))).otherwise(props)


def tile_chips(pixels: DataFrame) -> DataFrame:
    """tile_id, shape, data: a tile's codes in row and column order as zlib bytes. A tile is bounded by its level's pixels."""
    rows = pixels.groupBy("tile_id").agg(F.array_sort(F.collect_list(F.struct("row", "col", "code"))).alias("p"), F.countDistinct("row").alias("h"), F.countDistinct("col").alias("w"))
    return rows.select("tile_id", F.array("h", "w").alias("shape"), compress_uint8(F.transform("p", lambda x: x["code"])).alias("data"))


def scene_chips(tiles: DataFrame, pixels: DataFrame, least_clear: float = 0.8) -> DataFrame:
    """tile_id, scene_id, shape, clear_ratio, image, clear_mask: the pixels (scene_id, x, y, value, clear, in the tile's metres) in each tile's half-open box.

    Pixels find their tiles by index arithmetic on each level and origin of the tiles, not by a spatial test. A chip below the clear ratio,
    or with nothing but zeros, is left out. A tile is bounded by its level's pixels.
    """
    grids = tiles.select("level", "origin_x", "origin_y").distinct().limit(MOST_GRIDS + 1).collect()
    if len(grids) > MOST_GRIDS:
        raise ValueError(f"tiles have more than {MOST_GRIDS} grids (level, origin_x, origin_y): a pixel is looked up in each")
    found = F.array(*(F.struct(*(F.lit(r[c]).alias(c) for c in ("level", "origin_x", "origin_y"))) for r in grids)) if grids else F.array().cast(tiles.select(F.array(F.struct("level", "origin_x", "origin_y"))).schema[0].dataType)
    at = lambda c, o: F.floor((F.col(c) - F.col(o)) / F.col("level")).cast("long")
    placed = pixels.select("scene_id", "x", "y", "value", "clear", F.inline(found)).withColumn("x_idx", at("x", "origin_x")).withColumn("y_idx", at("y", "origin_y"))
    keys = ["level", "origin_x", "origin_y", "x_idx", "y_idx"]
    rows = placed.join(tiles.select("tile_id", *keys), keys)
    pixel = F.struct((-F.col("y")).alias("down"), "x", "value", F.col("clear").cast("int").alias("clear"))
    chips = rows.groupBy("tile_id", "scene_id").agg(
        F.avg(F.col("clear").cast("double")).alias("clear_ratio"), F.max(F.abs("value")).alias("most"), F.array(F.countDistinct("y"), F.countDistinct("x")).alias("shape"), F.array_sort(F.collect_list(pixel)).alias("p")
    )
    good = chips.where((F.col("clear_ratio") >= least_clear) & (F.col("most") > 0))
    return good.select("tile_id", "scene_id", "shape", "clear_ratio", compress_uint8(F.transform("p", lambda v: v["value"])).alias("image"), compress_uint8(F.transform("p", lambda v: v["clear"])).alias("clear_mask"))
