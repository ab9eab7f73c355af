"""Grids: tiles of UTM zones, of the poles, of bounds; geographic filters; hierarchy pruning.

Tiles are enumerated by exploding one row per zone to columns, which are spread over tasks by the grid's size, and then
to rows of tiles; so a large grid fills a cluster without a cross join, and a query that needs no geometry never computes
it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapane.dims import LEVELS, MARGIN, POLAR_HALF, UTM_X0, UTM_X1, UTM_Y0_SOUTH, UTM_Y1_NORTH
from terrapane.functions import geodesic, projection, tileid
from terrapane.functions.geometry import CORNERS, boxes_overlap
from terrapane.scratch import written


TASK_TILES = 2_000_000  # candidates enumerated by a task


def utm_indices(zones: DataFrame, level: int) -> DataFrame:
    """zones (zone, zone_num, south, origin_y) to all index pairs of their full extent: adds x_idx, y_idx (south: negative)."""
    nx = -(-(UTM_X1 - UTM_X0) // level)
    ny_north, ny_south = -(-UTM_Y1_NORTH // level), -(-UTM_Y0_SOUTH // level)
    xs = zones.withColumn("x_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nx - 1).cast("long"))))
    xs = xs.repartition(max(1, -(-120 * nx * ny_south // TASK_TILES)), "zone", "x_idx")
    first = F.when(F.col("south"), F.lit(-ny_south)).otherwise(F.lit(0)).cast("long")
    last = F.when(F.col("south"), F.lit(-1)).otherwise(F.lit(ny_north - 1)).cast("long")
    return xs.withColumn("y_idx", F.explode(F.sequence(first, last))).withColumn("level", F.lit(level))


def with_box(tiles: DataFrame, step: Column | None = None, buffer: int = 0) -> DataFrame:
    """Adds minx, miny, maxx, maxy in the zone's metres."""
    size = F.col("level")
    step = size if step is None else step
    x, y = F.col("origin_x") + F.col("x_idx") * step, F.col("origin_y") + F.col("y_idx") * step
    return tiles.select("*", *((v.cast("double")).alias(n) for n, v in (("minx", x - buffer), ("miny", y - buffer), ("maxx", x + size + buffer), ("maxy", y + size + buffer))))


def with_centroid_degrees(tiles: DataFrame) -> DataFrame:
    """Adds lon, lat of the box's centre, by the zone's inverse projection."""
    tiles = tiles.withColumn("p_east", (F.col("minx") + F.col("maxx")) / 2).withColumn("p_north", (F.col("miny") + F.col("maxy")) / 2)
    return projection.apply(tiles, projection.utm_inverse("p_east", "p_north"), ("lon", "lat")).drop("p_east", "p_north")


def margin(level: int, lat: Column) -> Column:
    """Degrees of longitude by which a tile may stand out of its zone."""
    return (level / MARGIN[level]) / (111320 * F.cos(F.radians(F.least(F.abs(lat), F.lit(80.0)))))


def near_zone(level: int) -> Column:
    h = margin(level, F.col("lat"))
    return (F.col("lon") >= F.col("lon_min") - h) & (F.col("lon") <= F.col("lon_max") + h)


def centre_in_zone() -> Column:
    return (F.col("lon") >= F.col("lon_min")) & (F.col("lon") < F.col("lon_max")) & (F.col("lat") >= F.col("lat_min")) & (F.col("lat") <= F.col("lat_max"))


def may_reach_zone(level: int) -> Column:
    """Is the box's centre near enough to the central meridian, by the zone's width at the latitude of the box's lower edge? A cheap test on metres, wider than the zone and its margin, that spares most projections."""
    away = F.when(F.col("south"), 10_000_000 - F.col("maxy")).otherwise(F.col("miny"))
    width = 345_000 * F.cos(F.radians(F.greatest(F.lit(0.0), F.least(F.lit(89.0), away / 111_700))))
    return F.abs((F.col("minx") + F.col("maxx")) / 2 - 500_000) <= width + level / MARGIN[level] + 2 * level


def with_corners(tiles: DataFrame, where: Column | None = None) -> DataFrame:
    """Adds lon0, lat0 to lon3, lat3: the degrees of the corners, counter-clockwise from the lower left. Longitudes go on beyond 180, so a tile at the antimeridian does not wrap. Only rows of where get them, if it is given; of the others they are null, which costs no arithmetic."""
    names = ("minx", "miny", "maxx", "maxy")
    used = {c: c if where is None else f"k_{c}" for c in names}
    if where is not None:
        tiles = tiles.select("*", *(F.when(where, F.col(c)).alias(used[c]) for c in names))
    for i, (x, y) in enumerate(CORNERS[:4]):
        tiles = projection.apply(tiles, projection.utm_inverse(used[x], used[y], lon=f"lon{i}", lat=f"lat{i}"), (f"lon{i}", f"lat{i}"))
    return tiles if where is None else tiles.drop(*used.values())


def reaches_zone(widest: float = 12.0) -> Column:
    """Does the straight-edged quadrilateral of the corners (with_corners) meet the zone's rectangle of degrees, edges included? Two convex shapes are apart only if an edge of one of them has the other wholly on its outer side."""
    lons, lats = [F.col(f"lon{i}") for i in range(4)], [F.col(f"lat{i}") for i in range(4)]
    meets = (F.least(*lons) <= F.col("lon_max")) & (F.greatest(*lons) >= F.col("lon_min")) & (F.least(*lats) <= F.col("lat_max")) & (F.greatest(*lats) >= F.col("lat_min"))
    for i in range(4):
        x, y = lons[i], lats[i]
        dx, dy = lons[(i + 1) % 4] - x, lats[(i + 1) % 4] - y
        # the rectangle's corner that lies farthest to the inner side of the edge
        far_y = F.when(dx > 0, F.col("lat_max")).otherwise(F.col("lat_min"))
        far_x = F.when(dy > 0, F.col("lon_min")).otherwise(F.col("lon_max"))
        meets = meets & (dx * (far_y - y) - dy * (far_x - x) >= 0)
    return meets & (F.greatest(*lons) - F.least(*lons) <= widest)


def utm_grid(zones: DataFrame, level: int, border: bool = True, widest: float = 12.0) -> DataFrame:
    """Tiles of the zones: those whose centre is in the zone, and with border those whose quadrilateral reaches into it. Tiles that wrap around (wider than widest degrees) go."""
    boxes = with_box(utm_indices(zones, level)).where(may_reach_zone(level))
    tiles = with_centroid_degrees(boxes).where(near_zone(level)).withColumn("inside", centre_in_zone())
    if not border:
        return tiles.where("inside").drop("inside")
    cornered = with_corners(tiles, ~F.col("inside"))  # one pass: tiles inside skip the corners
    return cornered.where(F.col("inside") | reaches_zone(widest)).select(*tiles.columns).drop("inside")


def polar_grid(poles: DataFrame, level: int) -> DataFrame:
    """poles (zone) to their tiles whose centre's latitude is 84..89.5 north or 80..89.5 south: zone, level, x_idx, y_idx, box, lon, lat."""
    n, half = -(-2 * POLAR_HALF // level), -(-POLAR_HALF // level)
    tiles = poles.select("zone", F.lit(level).alias("level"), F.lit(-POLAR_HALF).cast("long").alias("origin_x"), F.when(F.col("zone") == "NP", 0).otherwise(-POLAR_HALF).cast("long").alias("origin_y"))
    tiles = tiles.withColumn("x_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    tiles = tiles.repartition(max(1, -(-2 * n * half // TASK_TILES)), "zone", "x_idx")
    tiles = tiles.withColumn("y_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(half - 1).cast("long"))))
    tiles = with_box(tiles).withColumn("c_x", (F.col("minx") + F.col("maxx")) / 2).withColumn("c_y", (F.col("miny") + F.col("maxy")) / 2)
    out = []
    for pole, low, high in (("NP", 84.0, 89.5), ("SP", -89.5, -80.0)):
        each = projection.apply(tiles.where(F.col("zone") == pole), projection.polar_inverse(pole, "c_x", "c_y"), ("lon", "lat"))
        out.append(each.where(F.col("lat").between(low, high)))
    return out[0].unionByName(out[1]).drop("c_x", "c_y")


def bounds_grid(boxes: DataFrame, level: int) -> DataFrame:
    """boxes (…, minx, miny, maxx, maxy in a zone's metres, origin_x, origin_y) to the indices of the tiles that they touch: adds level, x_idx, y_idx."""
    low = lambda c, o: tileid.floor_div(F.col(c) - F.col(o), level)
    xs = boxes.withColumn("x_idx", F.explode(F.sequence(low("minx", "origin_x"), low("maxx", "origin_x"))))
    return xs.withColumn("y_idx", F.explode(F.sequence(low("miny", "origin_y"), low("maxy", "origin_y")))).withColumn("level", F.lit(level))


def identify(tiles: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Adds tile_id, super_id, tile_hash."""
    a = (F.col("level"), F.col("zone"), F.col("x_idx"), F.col("y_idx"))
    tiles = tiles.withColumn("tile_id", tileid.format_id(*a)).withColumn("super_id", tileid.parent_id(*a, levels))
    return tiles.withColumn("tile_hash", tileid.tile_hash(F.col("tile_id"), F.col("level"), F.col("zone")))


def drop_zero_ancestors(tiles: DataFrame, zero: DataFrame, ref_level: int) -> DataFrame:
    """tiles without descendants of zero (zone, x_idx, y_idx at ref_level); levels that do not divide ref_level pass."""
    factor = F.floor(F.lit(ref_level) / F.col("level"))
    applies = (F.lit(ref_level) % F.col("level") == 0) & (F.col("level") < ref_level)
    keyed = tiles.withColumn("r_x", F.when(applies, tileid.floor_div(F.col("x_idx"), factor))).withColumn("r_y", F.when(applies, tileid.floor_div(F.col("y_idx"), factor)))
    refs = zero.select(F.col("zone"), F.col("x_idx").alias("r_x"), F.col("y_idx").alias("r_y"))
    return keyed.join(refs, ["zone", "r_x", "r_y"], "left_anti").drop("r_x", "r_y")


def bounds_parts(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Array of the parts (w, s, e, n) of a box of degrees, cut at 180 degrees, if west > east, and at the equator; at most four. A part up to the equator from below is southern."""
    at = lambda *x: F.struct(*(v.cast("double").alias(c) for v, c in zip(x, "wsen", strict=True)))
    zero, turn = F.lit(0.0), F.lit(180.0)
    wide = F.when(west > east, F.array(at(west, south, turn, north), at(-turn, south, east, north))).otherwise(F.array(at(west, south, east, north)))
    crosses = (south < 0) & (north > 0)
    cut = lambda p: F.when(crosses, F.array(at(p["w"], p["s"], p["e"], zero), at(p["w"], zero, p["e"], p["n"]))).otherwise(F.array(p))
    return F.flatten(F.transform(wide, cut))


def zone_numbers(west: Column, east: Column) -> Column:
    number = lambda lon: F.least(F.lit(60), (F.floor((lon + 180) / 6) + 1).cast("int"))
    return F.sequence(number(west), number(east))


def side_of(south: Column) -> Column:
    return F.when(south < 0, F.lit("S")).otherwise(F.lit("N"))


def zones_of_bounds(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Array of the UTM zones that a box of degrees reaches, over 180 degrees and on both sides of the equator."""
    zones = lambda p: F.transform(zone_numbers(p["w"], p["e"]), lambda z: F.concat(z.cast("string"), side_of(p["s"])))
    return F.array_distinct(F.flatten(F.transform(bounds_parts(west, south, east, north), zones)))


def met(a: DataFrame, b: DataFrame, cell: float, test: Column | None = None) -> DataFrame:
    """Pairs of overlapping boxes (closed), with the columns of both under a_ and b_: each box goes to the coarse cells that it touches, pairs meet in a cell, and the pair counts in the cell of its overlap's lower corner only, so that no pair comes twice. A further test reads these columns and is done where a pair meets, after the cheap ones, so that no pair is shuffled for it."""

    def cells(df: DataFrame, p: str) -> DataFrame:
        low = lambda c: F.floor(F.col(c) / cell).cast("long")
        df = df.select(*(F.col(c).alias(f"{p}{c}") for c in df.columns))
        return df.withColumn("cx", F.explode(F.sequence(low(f"{p}minx"), low(f"{p}maxx")))).withColumn("cy", F.explode(F.sequence(low(f"{p}miny"), low(f"{p}maxy"))))

    own = (F.col("cx") == F.floor(F.greatest("a_minx", "b_minx") / cell)) & (F.col("cy") == F.floor(F.greatest("a_miny", "b_miny") / cell))
    pair = boxes_overlap("a_", "b_") & own
    # one filter, as one put above it would be evaluated before it
    return cells(a, "a_").join(cells(b, "b_"), ["cx", "cy"]).where(pair if test is None else pair & test).drop("cx", "cy")


def overlapping(a: DataFrame, b: DataFrame, cell: float, a_id: str, b_id: str) -> DataFrame:
    """The ids of the pairs of met."""
    return met(a, b, cell).select(F.col(f"a_{a_id}").alias(a_id), F.col(f"b_{b_id}").alias(b_id))


def spread(rows: DataFrame) -> DataFrame:
    """The rows of lattices over all tasks, before they become points, so that one large region fills a cluster."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *(c for c in rows.columns if c in ("row", "northing", "lat")))


def ellipsoid_lattice(bounds: DataFrame, spacing_m: float) -> DataFrame:
    """bounds (…, west, south, east, north) to points spacing_m apart over the ellipsoid: rows along the west meridian, and in a row steps as wide as a geodesic that starts eastward there. Adds row, col, lat, lon. No step is taken from the one before: the meridian's length has a series, and all steps of a row are alike."""
    ends = projection.apply(bounds, [*geodesic.meridian_forward("south", "m_south"), *geodesic.meridian_forward("north", "m_north")])
    n = F.floor((F.col("m_north") - F.col("m_south")) / spacing_m)
    rows = spread(ends.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long")))))
    rows = rows.withColumn("metres", F.col("m_south") + F.col("row") * spacing_m)
    rows = rows.withColumn("azimuth", F.lit(90.0)).withColumn("zero", F.lit(0.0)).withColumn("spacing", F.lit(float(spacing_m)))
    rows = projection.apply(rows, [*geodesic.meridian_inverse("metres", "lat"), *geodesic.direct("zero", "lat", "azimuth", "spacing", "width", "ahead")], ("lat", "width"))
    count = F.floor((F.col("east") - F.col("west")) / F.col("width")).cast("long")
    points = rows.withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), count))).withColumn("lon", F.col("west") + F.col("col") * F.col("width"))
    return points.select(*bounds.columns, "row", "col", "lat", "lon")


def geodesic_lattice(bounds: DataFrame, spacing_m: float) -> DataFrame:
    """bounds (…, west, south, east, north) to lattice points about spacing_m apart: adds lat, lon; the step in longitude widens with latitude."""
    step = spacing_m / 111320
    rows = bounds.withColumn("row", F.explode(F.sequence(F.lit(0), F.floor((F.col("north") - F.col("south")) / step).cast("int")))).withColumn("lat", F.col("south") + F.col("row") * step)
    rows = spread(rows)
    width = step / F.greatest(F.cos(F.radians("lat")), F.lit(0.01))
    rows = rows.withColumn("width", width).withColumn("col", F.explode(F.sequence(F.lit(0), F.floor((F.col("east") - F.col("west")) / F.col("width")).cast("int"))))
    return rows.withColumn("lon", F.col("west") + F.col("col") * F.col("width")).drop("row", "col", "width")


def utm_lattice(bounds: DataFrame, spacing_m: float) -> DataFrame:
    """bounds (…, zone_num, south, minx, miny, maxx, maxy in a zone's metres) to lattice points: adds row, col, easting, northing, lon, lat. Rows keep their spacing from the zone's origin; towards a pole a row has more columns, greatest(3, width / (spacing * cos(lat))), evenly spread."""
    s = F.lit(float(spacing_m))
    start = lambda low, origin: F.col(low) + F.pmod(F.lit(float(origin)) - F.col(low), s)
    rows = bounds.withColumn("start_x", start("minx", 500_000)).withColumn("start_y", start("miny", 0))
    n = F.ceil((F.col("maxy") + s - F.col("start_y")) / s).cast("int")
    rows = rows.withColumn("row", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("northing", F.col("start_y") + F.col("row") * s).withColumn("middle", F.lit(500_000.0))
    rows = projection.apply(spread(rows), projection.utm_inverse("middle", lon="row_lon", lat="row_lat"), ("row_lon", "row_lat"))
    columns = F.greatest(F.lit(3), F.floor((F.col("maxx") - F.col("minx")) / (s * F.cos(F.radians("row_lat")))).cast("int"))
    rows = rows.withColumn("columns", columns).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)))
    rows = rows.withColumn("easting", F.col("start_x") + F.col("col") * (F.col("maxx") - F.col("start_x")) / (F.col("columns") - 1))
    return projection.apply(rows, projection.utm_inverse(), ("lon", "lat")).drop("start_x", "start_y", "middle", "row_lon", "row_lat", "columns")


def scene_grids(scenes: DataFrame, levels: tuple[int, ...], key: str = "scene_id") -> DataFrame:
    """scenes (key, west, south, east, north in degrees) to the tiles of every zone that they reach, whose boxes touch the scene's: key, zone, level, x_idx, y_idx. All scenes, zones and levels in one job; a scene's corners and edge middles give its bounds in a zone. A scene with west > east goes over 180 degrees, and one over the equator has tiles of both sides, none beyond it."""
    parts = scenes.select(key, F.inline(bounds_parts(F.col("west"), F.col("south"), F.col("east"), F.col("north"))))
    zoned = parts.select(key, F.col("w").alias("west"), F.col("s").alias("south"), F.col("e").alias("east"), F.col("n").alias("north"), F.explode(zone_numbers(F.col("w"), F.col("e"))).alias("zone_num"))
    zoned = zoned.withColumn("is_south", F.col("south") < 0).withColumn("zone", F.concat(F.col("zone_num").cast("string"), side_of(F.col("south"))))
    # a scene's part in the zone, to the zone's edges
    low, high = 6.0 * F.col("zone_num") - 186, 6.0 * F.col("zone_num") - 180
    zoned = zoned.withColumn("w", F.greatest("west", low)).withColumn("e", F.least("east", high)).withColumn("mid", (6.0 * F.col("zone_num") - 183))
    points = F.array(*(F.struct(x.alias("lon"), F.col(y).alias("lat")) for x in (F.col("w"), F.col("e"), F.least("e", F.greatest("w", "mid"))) for y in ("south", "north")))
    rows = zoned.select(key, "zone", "zone_num", F.col("is_south").alias("south"), F.inline(points))
    rows = projection.apply(rows, projection.utm_forward())
    boxes = rows.groupBy(key, "zone", "south").agg(F.min("easting").alias("minx"), F.min("northing").alias("miny"), F.max("easting").alias("maxx"), F.max("northing").alias("maxy"))
    boxes = boxes.withColumn("origin_x", F.lit(UTM_X0)).withColumn("origin_y", F.when(F.col("south"), UTM_Y0_SOUTH).otherwise(0))
    made = [bounds_grid(boxes, level).where("NOT (south AND y_idx >= 0)").select(key, "zone", "level", "x_idx", "y_idx") for level in levels]
    return reduce(DataFrame.unionByName, made)


def morton(x: Column, y: Column, bits: int = 16) -> Column:
    """Key that interleaves the low bits of two indices: tiles near each other have near keys, so that a range partition by it is a spatial one."""
    key = F.lit(0).cast("long")
    for i in range(bits):
        key = key.bitwiseOR(F.shiftleft(F.shiftright(x, i).bitwiseAND(F.lit(1).cast("long")), 2 * i)).bitwiseOR(F.shiftleft(F.shiftright(y, i).bitwiseAND(F.lit(1).cast("long")), 2 * i + 1))
    return key


def by_locality(tiles: DataFrame, partitions: int) -> DataFrame:
    """tiles in partitions that are compact areas of a level and zone."""
    return tiles.withColumn("m", morton(F.col("x_idx"), F.col("y_idx"))).repartitionByRange(partitions, "level", "zone", "m").sortWithinPartitions("level", "zone", "m").drop("m")


PART_BITS = 20  # of an index, that cuts may use


def bounded_parts(tiles: DataFrame, most: int, keys: tuple[str, ...] = ("level", "zone")) -> DataFrame:
    """tiles with part: compact areas of at most so many tiles, whatever their density.

    The areas are quarters of quarters: a square of a key's plane is cut while it holds more than most tiles. Cuts come
    from counts of Morton key prefixes, all depths in one aggregation over the finest squares; each tile has one square
    that is small enough while the next larger is not. Tiles of one finest square, if there are too many, are numbered
    and cut by number. Nothing of this passes the driver.
    """
    shift = F.lit(1 << (PART_BITS - 1)).cast("long")
    keyed = tiles.withColumn("square", morton(F.col("x_idx") + shift, F.col("y_idx") + shift, PART_BITS))
    squares = written(keyed.groupBy(*keys, "square").agg(F.count(F.lit(1)).alias("n")), "squares")
    prefix = lambda d: F.call_function("shiftright", F.col("square"), (2 * (PART_BITS - d)).cast("int"))
    depths = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(PART_BITS)), prefix)).alias("depth", "prefix")
    above = squares.select(*keys, "n", depths)
    counts = written(above.groupBy(*keys, "depth", "prefix").agg(F.sum("n").alias("n")), "squares")
    small = counts.where(F.col("n") <= most)
    parents = counts.where(F.col("n") > most).select(*keys, (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    leaves = small.withColumn("parent", F.shiftright("prefix", 2)).join(parents, [*keys, "depth", "parent"]).select(*keys, "depth", "prefix")
    whole = small.where("depth = 0").select(*keys, "depth", "prefix")
    full = counts.where((F.col("depth") == PART_BITS) & (F.col("n") > most)).select(*keys, "depth", "prefix")
    cut = written(leaves.unionByName(whole).unionByName(full), "cuts")
    of_square = squares.select(*keys, "square", depths).join(cut, [*keys, "depth", "prefix"]).join(squares, [*keys, "square"])
    of_square = of_square.select(*keys, "square", F.concat_ws(":", "depth", "prefix").alias("part"), (F.col("n") > most).alias("crowded"))
    placed = keyed.join(of_square, [*keys, "square"])
    thin = placed.where("NOT crowded").drop("crowded")
    number = F.row_number().over(Window.partitionBy(*keys, "square").orderBy("x_idx", "y_idx")) - 1
    thick = placed.where("crowded").drop("crowded").withColumn("part", F.concat_ws(":", "part", F.floor(number / most)))
    return thin.unionByName(thick).drop("square")


def spatial_clusters(tiles: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """tiles with cluster: k-means over box centres, where labels themselves are wanted (by_locality is cheaper for partitioning)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    centred = tiles.withColumn("cx", (F.col("minx") + F.col("maxx")) / 2).withColumn("cy", (F.col("miny") + F.col("maxy")) / 2)
    points = VectorAssembler(inputCols=["cx", "cy"], outputCol="at").transform(centred)
    return KMeans(k=k, seed=seed, featuresCol="at", predictionCol="cluster").fit(points).transform(points).drop("cx", "cy", "at")
