"""Rasters as packed blocks: zonal counts, shares and chips from integral histograms, polygon masks, and warping.

A raster is rows (source, brow, bcol, data): square blocks of side x side class codes, zlib bytes of uint8. Pixel (row,
col) of a source has its centre at (row + 0.5, col + 0.5); row 0 is the northern edge. No pixel is ever a row on the way
to a count: a window of pixels meets its blocks by an equi-join on block numbers, and its count of a class is four
look-ups in the block's table of sums. A polygon is the windows of one row each that its scanlines cut, so masks need
nothing else. Windows are half-open: a pixel is in if its centre is.

Null codes and pixels that a source lacks are OUTSIDE; of repeated pixels the largest code holds.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from terrapane.functions import projection
from terrapane.operators.zonal import OUTSIDE

SIDE = 512
NO_DATA = 0
READY = 64  # packed blocks that a task hands on at once
MOST_COUNTS = 100_000  # counts that a task gathers before it hands them on
#: Up to here a target pixel takes the nearest source pixel; a coarser one takes the most frequent of its samples.
NEAREST_M = 10.0


def pack_blocks(pixels: DataFrame, side: int = SIDE) -> DataFrame:
    """pixels (source, row, col, code) to blocks (source, brow, bcol, data). Pixels reach a task sorted by block and flow through it: it holds one block, whatever its partition holds."""
    keys = ["source", "brow", "bcol"]

    def packed(ready: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*ready, strict=True), kinds, strict=True)], [*keys, "data"])

    def closed(key: tuple, block: np.ndarray) -> tuple:
        return *key, zlib.compress(np.where(block < 0, OUTSIDE, block).astype(np.uint8).tobytes(), 3)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block, ready = None, None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, at = batch.column("code").to_numpy(), batch.column("at").to_numpy()
            if codes.min() < 0 or codes.max() > 255:
                raise OverflowError("a code is not within 0 and 255")
            columns = [batch.column(k) for k in keys]
            # where a block begins: a value that is not the one before (nulls are alike)
            new = np.zeros(batch.num_rows, bool)
            for c in (c.dictionary_encode(null_encoding="encode").indices.to_numpy() for c in columns):
                new[1:] |= c[1:] != c[:-1]
            for start, end in itertools.pairwise((0, *np.flatnonzero(new), batch.num_rows)):
                key = tuple(c[start].as_py() for c in columns)
                if key != held:
                    if held is not None:
                        ready.append(closed(held, block))
                    if len(ready) == READY:
                        yield packed(ready)
                        ready = []
                    held, block = key, np.full(side * side, -1, np.int16)
                np.maximum.at(block, at[start:end], codes[start:end].astype(np.int16))
        if held is not None:
            yield packed([*ready, closed(held, block)])

    at = (F.pmod("row", F.lit(side)) * side + F.pmod("col", F.lit(side))).cast("int").alias("at")
    rows = pixels.where("code IS NOT NULL").select("source", block_of("row", side).alias("brow"), block_of("col", side).alias("bcol"), at, F.col("code").cast("int").alias("code"))
    blocks = T.StructType([*(rows.schema[k] for k in keys), T.StructField("data", T.BinaryType())])
    kinds = to_arrow_schema(blocks).types
    n = int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(pack, blocks)


def block_of(pixel: str, side: int) -> Column:
    return F.floor(F.col(pixel) / side).cast("long")


def first_pixel(edge: Column) -> Column:
    """The first pixel whose centre is at or beyond an edge, in pixels."""
    return F.ceil(edge - 0.5).cast("long")


def box_windows(tiles: DataFrame, west: float, north: float, pixel: float) -> DataFrame:
    """tiles (tile_id, source, minx … maxy) to windows (tile_id, source, r0, r1, c0, c1) of a raster whose corner is (west, north)."""
    column, row = (lambda c: first_pixel((F.col(c) - west) / pixel)), (lambda c: first_pixel((F.lit(north) - F.col(c)) / pixel))
    return tiles.select("tile_id", "source", row("maxy").alias("r0"), row("miny").alias("r1"), column("minx").alias("c0"), column("maxx").alias("c1"))


def ring_edges(points: Column) -> Column:
    """Edges (x1, y1, x2, y2) of a ring of points (x, y), closed or not. Edges of several rings, holes too, may be put in one array."""
    after = F.concat(F.slice(points, F.lit(2), F.size(points)), F.slice(points, 1, 1))
    return F.zip_with(points, after, lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))


def polygon_windows(shapes: DataFrame) -> DataFrame:
    """shapes (tile_id, source, edges in pixels: x along columns, y along rows) to windows of one row each, by the even-odd rule: a scanline through the pixel centres is inside between each two crossings. The rows of a shape are bounded by its height."""
    ys = F.concat(F.transform("edges", lambda e: e["y1"]), F.transform("edges", lambda e: e["y2"]))
    r0, r1 = first_pixel(F.array_min(ys)), first_pixel(F.array_max(ys))
    # through a generator of one row, so that edges are made once and not in filters below
    shapes = shapes.select("tile_id", "source", F.inline(F.array(F.struct("edges"))))
    rows = shapes.where(F.size("edges") > 0).withColumn("r0", F.explode(F.when(r1 > r0, F.sequence(r0, r1 - 1))))
    y = F.col("r0") + 0.5
    cut = F.filter("edges", lambda e: (e["y1"] > y) != (e["y2"] > y))
    rows = rows.select("tile_id", "source", "r0", F.sort_array(F.transform(cut, lambda e: (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])).alias("x"))
    pair = lambda i: F.struct(first_pixel(F.get("x", 2 * i)).alias("c0"), first_pixel(F.get("x", 2 * i + 1)).alias("c1"))
    spans = F.when(F.size("x") > 1, F.transform(F.sequence(F.lit(0), F.floor(F.size("x") / 2).cast("int") - 1), pair))
    return rows.select("tile_id", "source", "r0", (F.col("r0") + 1).alias("r1"), F.inline(spans)).where("c1 > c0")


def quad_edges(column_of, row_of) -> Column:
    """Edges in pixels of the quadrilateral whose corners are lon0, lat0 … lon3, lat3."""
    points = F.array(*(F.struct(column_of(F.col(f"lon{i}")).alias("x"), row_of(F.col(f"lat{i}")).alias("y")) for i in range(4)))
    return ring_edges(points)


def _met(windows: DataFrame, blocks: DataFrame, side: int) -> DataFrame:
    """source, brow, bcol, data and the windows that meet the block: one row a block. They are as many as tiles (or their scanlines) meet a block."""
    blocks_of = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / side).cast("long"), F.floor((F.col(b) - 1) / side).cast("long")))
    cut = windows.where("r1 > r0 AND c1 > c0").withColumn("brow", blocks_of("r0", "r1")).withColumn("bcol", blocks_of("c0", "c1"))
    lists = cut.groupBy("source", "brow", "bcol").agg(F.collect_list(F.struct("tile_id", "r0", "r1", "c0", "c1")).alias("windows"))
    return lists.join(blocks, ["source", "brow", "bcol"])


def integral(block: np.ndarray, code: int) -> np.ndarray:
    """Table of sums: [r, c] is how many pixels above r and left of c have the code."""
    out = np.zeros((block.shape[0] + 1, block.shape[1] + 1), np.int32)
    np.cumsum(block == code, axis=0, dtype=np.int32, out=out[1:, 1:])
    np.cumsum(out[1:, 1:], axis=1, out=out[1:, 1:])
    return out


def window_counts(block: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each code of a block with its count in each window (rows r0, r1, c0, c1 of bounds, within the block). One table of sums is held at a time."""
    r0, r1, c0, c1 = bounds
    for code in np.unique(block):
        table = integral(block, code)
        yield int(code), table[r1, c1] - table[r0, c1] - table[r1, c0] + table[r0, c0]


def _read(batch: pa.RecordBatch, side: int) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, tuple[int, int]]]:
    """Of each row of _met: the block, its tiles, the windows cut to the block, and where it begins."""
    for brow, bcol, data, windows in zip(*(batch.column(c) for c in ("brow", "bcol", "data", "windows")), strict=True):
        flat = windows.values
        at = np.array([[brow.as_py()], [brow.as_py()], [bcol.as_py()], [bcol.as_py()]]) * side
        bounds = np.stack([flat.field(c).to_numpy() for c in ("r0", "r1", "c0", "c1")])
        block = np.frombuffer(zlib.decompress(data.as_py()), np.uint8).reshape(side, side)
        yield block, flat.field("tile_id"), np.clip(bounds - at, 0, side), (at[0, 0], at[2, 0])


def zonal_counts(windows: DataFrame, blocks: DataFrame, side: int = SIDE) -> DataFrame:
    """tile_id, code, n of windows (tile_id, source, r0, r1, c0, c1; a tile may have many) over blocks. What is shuffled is blocks and counts."""

    def counted(held: list[tuple]) -> pa.RecordBatch:
        ids, codes, n = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(np.concatenate(codes)), pa.array(np.concatenate(n))], ["tile_id", "code", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            for block, tiles, bounds, _ in _read(batch, side):
                own = tiles.dictionary_encode(null_encoding="encode")
                at, ids = own.indices.to_numpy(), own.dictionary
                for code, n in window_counts(block, bounds):
                    sums = np.bincount(at, n, len(ids)).astype(np.int64)  # whole numbers far below 2 ** 53
                    some = np.flatnonzero(sums)
                    held.append((ids.take(pa.array(some)).cast(kind), np.full(len(some), code, np.int32), sums[some]))
                    many += len(some)
                if many > MOST_COUNTS:
                    yield counted(held)
                    held, many = [], 0
        if held:
            yield counted(held)

    tile = windows.schema["tile_id"].dataType
    kind = pa.string() if isinstance(tile, T.StringType) else pa.int64()
    met = _met(windows, blocks, side).select("brow", "bcol", "data", "windows")
    return met.mapInArrow(count, f"tile_id {tile.simpleString()}, code int, n long").groupBy("tile_id", "code").agg(F.sum("n").alias("n"))


def shares_of_counts(counts: DataFrame, windows: DataFrame, digits: int = 5) -> DataFrame:
    """tile_id, code, share for every tile of windows. A tile without pixels inside, or with code 0 only, is (0, 1.0)."""
    inside = counts.where(F.col("code") != OUTSIDE)
    rows = inside.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("tile_id")), digits))  # at most the legend's length a tile
    found = windows.select("tile_id").distinct().join(rows.select("tile_id", "code", "share"), "tile_id", "left")
    return found.select("tile_id", F.coalesce("code", F.lit(0)).alias("code"), F.coalesce("share", F.lit(1.0)).alias("share"))


def block_shares(windows: DataFrame, blocks: DataFrame, side: int = SIDE, digits: int = 5) -> DataFrame:
    return shares_of_counts(zonal_counts(windows, blocks, side), windows, digits)


def zonal_chips(windows: DataFrame, blocks: DataFrame, side: int = SIDE, digits: int = 5) -> DataFrame:
    """tile_id, shape, data, props: each tile's pixels (zlib bytes, OUTSIDE where no window of it is) and its shares, from one pass over the blocks. A tile that meets no block is left out. A tile's pixels, which its level bounds, meet in one task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = defaultdict(list)
            for block, tiles, bounds, (top, left) in _read(batch, side):
                counts = defaultdict(list)
                for code, n in window_counts(block, bounds):
                    for i in np.flatnonzero(n):
                        counts[i].append((code, int(n[i])))
                for i, (tile, (r0, r1, c0, c1)) in enumerate(zip(tiles.to_pylist(), bounds.T, strict=True)):
                    for name, value in (("tile_id", tile), ("top", top + r0), ("left", left + c0), ("height", r1 - r0), ("width", c1 - c0), ("part", block[r0:r1, c0:c1].tobytes()), ("counts", counts[i])):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(dict(out) if out else {f.name: [] for f in parts}, schema=parts)

    def join(parts: pd.Series) -> bytes:
        top, left = min(p["top"] for p in parts), min(p["left"] for p in parts)
        chip = np.full((max(p["top"] + p["height"] for p in parts) - top, max(p["left"] + p["width"] for p in parts) - left), OUTSIDE, np.uint8)
        for p in parts:
            r, c = p["top"] - top, p["left"] - left
            chip[r : r + p["height"], c : c + p["width"]] = np.frombuffer(p["part"], np.uint8).reshape(p["height"], p["width"])
        return chip

    @F.pandas_udf("shape array<int>, data binary")
    def assembled(parts: pd.Series) -> pd.DataFrame:
        chips = [join(p) for p in parts]
        return pd.DataFrame({"shape": [list(c.shape) for c in chips], "data": [zlib.compress(c.tobytes(), 3) for c in chips]})

    tile = windows.schema["tile_id"].dataType
    counted = pa.list_(pa.struct([("code", pa.int32()), ("n", pa.int64())]))
    parts = pa.schema([("tile_id", pa.string() if isinstance(tile, T.StringType) else pa.int64()), *((c, pa.int64()) for c in ("top", "left", "height", "width")), ("part", pa.binary()), ("counts", counted)])
    cuts = _met(windows, blocks, side).select("brow", "bcol", "data", "windows").mapInArrow(cut, f"tile_id {tile.simpleString()}, top long, left long, height long, width long, part binary, counts array<struct<code int, n long>>")
    tiles = cuts.groupBy("tile_id").agg(F.collect_list(F.struct("top", "left", "height", "width", "part")).alias("parts"), F.flatten(F.collect_list("counts")).alias("counts"))
    inside = F.filter("counts", lambda x: x["code"] != OUTSIDE)
    codes = F.array_sort(F.array_distinct(F.transform(inside, lambda x: x["code"])))
    of = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    share = lambda code: F.round(of(F.filter(inside, lambda x: x["code"] == code)) / of(inside), digits)
    props = F.when(F.size(codes) > 0, F.map_from_arrays(codes, F.transform(codes, share))).otherwise(F.create_map(F.lit(0), F.lit(1.0)))
    chips = tiles.select("tile_id", assembled("parts").alias("chip"), props.alias("props"))
    return chips.select("tile_id", "chip.shape", "chip.data", "props")


def target_samples(grids: DataFrame, resolution: float) -> DataFrame:
    """grids (target, zone_num, south, minx, maxy, width, height: pixels of the resolution in a zone's metres) to samples (target, row, col, lon, lat): a pixel's centre, or beyond NEAREST_M the centres of its parts, which are no wider than that."""
    k = 1 if resolution <= NEAREST_M else int(np.ceil(resolution / NEAREST_M))
    rows = grids.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height").cast("long") - 1)))
    rows = rows.repartition("target", "row")  # a grid's rows are spread before they become pixels
    rows = rows.withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width").cast("long") - 1)))
    parts = F.array(*(F.struct(F.lit((i + 0.5) / k).alias("down"), F.lit((j + 0.5) / k).alias("across")) for i in range(k) for j in range(k)))
    rows = rows.select("target", "zone_num", "south", "minx", "maxy", "row", "col", F.inline(parts))
    rows = rows.withColumn("easting", F.col("minx") + (F.col("col") + F.col("across")) * resolution).withColumn("northing", F.col("maxy") - (F.col("row") + F.col("down")) * resolution)
    return projection.apply(rows, projection.utm_inverse(), ("lon", "lat")).select("target", "row", "col", "lon", "lat")


def gather(samples: DataFrame, blocks: DataFrame, side: int = SIDE) -> DataFrame:
    """samples (target, row, col, source, srow, scol) with the code of their source pixel, NO_DATA where there is none. Samples meet the packed block; a group is a block and the samples in it."""

    def pick(key, wanted: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = wanted[["target", "row", "col"]].copy()
        if not len(held):
            return out.assign(code=NO_DATA)
        block = np.frombuffer(zlib.decompress(held["data"].iloc[0]), np.uint8)
        codes = block[(wanted["srow"] % side * side + wanted["scol"] % side).to_numpy()].astype(np.int32)
        return out.assign(code=np.where(codes == OUTSIDE, NO_DATA, codes))

    keys = ["source", "brow", "bcol"]
    wanted = samples.withColumn("brow", block_of("srow", side)).withColumn("bcol", block_of("scol", side))
    kind = samples.schema["target"].dataType.simpleString()
    return wanted.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInPandas(pick, f"target {kind}, row long, col long, code int")


def warp(grids: DataFrame, blocks: DataFrame, west: Column, north: Column, step: float, resolution: float, side: int = SIDE) -> DataFrame:
    """target, row, col, code: a raster in degrees (corner west, north; columns of grids) brought to grids in metres, by looking up where each target pixel lies in the source. grids also has source."""
    corners = grids.select("target", F.col("source").alias("source"), west.alias("west"), north.alias("north"))
    samples = target_samples(grids, resolution).join(corners, "target")
    at = lambda v: F.floor(v / step).cast("long")
    found = gather(samples.select("target", "row", "col", "source", at(F.col("north") - F.col("lat")).alias("srow"), at(F.col("lon") - F.col("west")).alias("scol")), blocks, side)
    if resolution <= NEAREST_M:
        return found
    n = found.groupBy("target", "row", "col", "code").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("target", "row", "col").agg(F.max_by("code", F.struct("n", (-F.col("code")).alias("order"))).alias("code"))
