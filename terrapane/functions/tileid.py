"""Tile ids: G{level}m_{zone}_X{x}_Y{y}[_buf{n}][_ovrlp{n}], and the hierarchy that they encode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapane.dims import LEVELS, parent_level

#: Fixed value: the id's form. X and Y may be negative; a buffer and an overlap may follow in either order.
PATTERN = r"^G(\d+)m_(\d{1,2}[NS]|NP|SP)_X(-?\d+)_Y(-?\d+)((?:_(?:buf|ovrlp)\d+)*)$"
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def suffix(buffer: Column, overlap: Column) -> Column:
    return F.concat(F.when(buffer != 0, F.concat(F.lit("_buf"), buffer.cast("string"))).otherwise(""), F.when(overlap != 0, F.concat(F.lit("_ovrlp"), overlap.cast("string"))).otherwise(""))


def format_id(level: Column, zone: Column, x: Column, y: Column, buffer: Column | None = None, overlap: Column | None = None) -> Column:
    base = F.format_string("G%dm_%s_X%06d_Y%06d", level.cast("long"), zone, x.cast("long"), y.cast("long"))
    zero = F.lit(0)
    return F.concat(base, suffix(buffer if buffer is not None else zero, overlap if overlap is not None else zero))


def parse_id(tile_id: Column) -> Column:
    """Struct of level, zone, x_idx, y_idx, buffer, overlap; null if the id is malformed. One match tells well-formed ids, and one split gives all parts."""

    def of(p: Column) -> Column:
        after = lambda i, n: F.substring(p[i], n + 1, 20)
        number = lambda key: F.coalesce(F.get(F.filter(p, lambda x: x.startswith(key)), F.lit(0)), F.lit(f"{key}0")).substr(len(key) + 1, 20).try_cast("int")
        return F.struct(
            F.rtrim(after(0, 1), F.lit("m")).try_cast("int").alias("level"),
            p[1].alias("zone"),
            after(2, 1).try_cast("bigint").alias("x_idx"),
            after(3, 1).try_cast("bigint").alias("y_idx"),
            number("buf").alias("buffer"),
            number("ovrlp").alias("overlap"),
        )

    return F.when(tile_id.rlike(PATTERN), F.element_at(F.transform(F.array(F.split(tile_id, "_")), of), 1))


def epsg(zone: Column) -> Column:
    n = F.regexp_extract(zone, r"^(\d+)", 1)
    code = F.when(zone == "NP", F.lit("3413")).when(zone == "SP", F.lit("3031")).when(zone.endswith("N"), F.concat(F.lit("326"), F.lpad(n, 2, "0"))).otherwise(F.concat(F.lit("327"), F.lpad(n, 2, "0")))
    return F.when(zone.isNotNull(), F.concat(F.lit("EPSG:"), code))


def expand_ids(df: DataFrame, column: str = "tile_id") -> DataFrame:
    """df with level, zone, epsg, x_idx, y_idx, buffer, overlap, replacing columns of these names; all null for a malformed id."""
    keep = [c for c in df.columns if c not in ("level", "zone", "epsg", "x_idx", "y_idx", "buffer", "overlap")]
    parsed = df.select(*keep).withColumn("parsed", parse_id(F.col(column)))
    p = F.col("parsed")
    parts = F.struct(p["level"].alias("level"), p["zone"].alias("zone"), epsg(p["zone"]).alias("epsg"), *(p[c].alias(c) for c in ("x_idx", "y_idx", "buffer", "overlap")))
    # through a generator of one row, so that filters and joins on these columns are not rewritten as filters on the regexes
    return parsed.select(*keep, F.inline(F.array(parts)))


def infer_level(tile_id: Column) -> Column:
    return F.coalesce(F.regexp_extract(tile_id, r"^G(\d+)m_", 1).try_cast("int"), F.lit(-1))


def floor_div(a: Column, b: Column | int) -> Column:
    return F.floor(a / b).cast("long")


def ancestor_id(level: Column, zone: Column, x: Column, y: Column, target: Column | int) -> Column:
    """The tile of a coarser level that holds this one; null if the level does not divide it."""
    target = target if isinstance(target, Column) else F.lit(target)
    factor = F.floor(target / level)
    fits = (target % level == 0) & (target >= level)
    return F.when(fits, format_id(target, zone, floor_div(x, factor), floor_div(y, factor)))


def parent_id(level: Column, zone: Column, x: Column, y: Column, levels: tuple[int, ...] = LEVELS) -> Column:
    """The tile of the next level that holds this one; null at the top, for unknown levels and for factors that are not whole."""
    out = F.lit(None).cast("string")
    for lv in levels:
        if above := parent_level(lv, levels):
            out = F.when(level == lv, format_id(F.lit(above), zone, floor_div(x, above // lv), floor_div(y, above // lv))).otherwise(out)
    return out


def lineage(level: Column, zone: Column, x: Column, y: Column, target: Column) -> Column:
    """Array of related ids at a level: the ancestor, the tile itself, or all descendants (x first); empty if neither level divides the other."""
    f = F.floor(level / target).cast("int")
    side = F.sequence(F.lit(0), F.greatest(f, F.lit(1)) - 1)
    down = F.flatten(F.transform(side, lambda dx: F.transform(side, lambda dy: format_id(target, zone, x * f + dx, y * f + dy))))
    return F.when((target >= level) & (target % level == 0), F.array(ancestor_id(level, zone, x, y, target))).when((target < level) & (level % target == 0), down).otherwise(F.array().cast("array<string>"))


def tile_hash(tile_id: Column, level: Column, zone: Column) -> Column:
    return F.md5(F.concat_ws("_", tile_id, level.cast("string"), zone))


def geohash(lon: Column, lat: Column, precision: int = 7) -> Column:
    """Base-32 geohash: bits of longitude and latitude by turns, longitude first."""
    bits = 5 * precision
    n_lon, n_lat = (bits + 1) // 2, bits // 2
    cell = lambda v, low, span, n: F.least(F.floor((v - low) / span * 2**n), F.lit(2**n - 1)).cast("long")
    x, y = cell(lon, -180.0, 360.0, n_lon), cell(lat, -90.0, 180.0, n_lat)
    out = []
    for c in range(precision):
        value = F.lit(0).cast("long")
        for b in range(5 * c, 5 * c + 5):
            source, place = (x, n_lon - 1 - b // 2) if b % 2 == 0 else (y, n_lat - 1 - b // 2)
            value = value * 2 + F.shiftright(source, place).bitwiseAND(F.lit(1))
        out.append(F.substring(F.lit(BASE32), (value + 1).cast("int"), F.lit(1)))
    return F.concat(*out)


def zone_order(zone: Column) -> tuple[Column, Column]:
    """Sort keys: UTM zones by number, north before south, then the poles."""
    n = F.regexp_extract(zone, r"^(\d+)[NS]$", 1).try_cast("int")
    return F.coalesce(n, F.when(zone == "NP", 61).when(zone == "SP", 62).otherwise(99)), F.when(zone.endswith("S"), 1).otherwise(0)
