"""Registered queries on selection, catalogs, scenes, payloads and table work."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrapane.dims import BIAS, CODES, THRESHOLDS, WEIGHTS
from terrapane.functions import arrays, proportions, tileid
from terrapane.operators import grid, select, zonal
from terrapane.plans import catalog
from terrapane.plans.queries import EPSG_TEXT, PARENT_TEXT, TILES_SQL, WIDE_SQL, longs, own, query, tiles, wide
from terrapane.plans.views import TILES, sql, table, view
from terrapane.scratch import scratch_base, written
from terrapane.sources import files
from terrapane.streaming import incremental

CLASSES = select.CLASSES
BASE_MIX = [1.0 / len(CODES)] * len(CODES)

# --- catalogs -------------------------------------------------------------------------------------------------------


def identified(spark, sf_dir):
    t = tiles(spark, sf_dir).withColumn("super_id", tileid.parent_id(*own()))
    wrong = F.when(F.col("k") % 10 == 0, F.concat("super_id", F.lit("x"))).otherwise(F.col("super_id"))
    t = t.withColumn("super_id", wrong).withColumn("origin_x", F.lit(100000)).withColumn("origin_y", F.when(F.col("zone").endswith("S"), 10_000_000).otherwise(0))
    return grid.with_box(t)


@query(
    f"SELECT level, count(*) AS checked, count(*) FILTER (k % 10 <> 0) AS correct, count(*) FILTER (k % 10 = 0) AS incorrect, round(100.0 * count(*) FILTER (k % 10 <> 0) / count(*), 2) AS percent FROM (SELECT *, {PARENT_TEXT} AS super_id FROM ({TILES_SQL})) WHERE super_id IS NOT NULL GROUP BY level"
)
def zone_validate_nesting(spark, sf_dir):
    """Every tenth parent id is made wrong, and must be found."""
    return catalog.nesting_report(identified(spark, sf_dir))


@query(
    f"SELECT zone, level, count(*) AS tile_count, CAST(min(100000 + x * level) AS DOUBLE) AS xmin, CAST(min(CASE WHEN zone LIKE '%S' THEN 10000000 ELSE 0 END + y * level) AS DOUBLE) AS ymin, CAST(max(100000 + (x + 1) * level) AS DOUBLE) AS xmax, CAST(max(CASE WHEN zone LIKE '%S' THEN 10000000 ELSE 0 END + (y + 1) * level) AS DOUBLE) AS ymax FROM ({TILES_SQL}) GROUP BY zone, level"
)
def manifest(spark, sf_dir):
    return catalog.manifest(identified(spark, sf_dir))


FILES = ("concat('dir', o_custkey % 20, '/file', o_orderkey, '.parquet') AS relative_path", "o_orderkey % 17 = 0 AS is_folder", "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_totalprice * 100 AS BIGINT) END AS file_size")


@query(f"SELECT count(*) FILTER (NOT is_folder) AS n_files, count(*) FILTER (is_folder) AS n_folders, round(sum(file_size) / 1e6, 2) AS megabytes FROM (SELECT {', '.join(FILES)} FROM orders)")
def structure_summary(spark, sf_dir):
    return catalog.structure_summary(table(spark, sf_dir, "orders").selectExpr(*FILES))


# --- selection ------------------------------------------------------------------------------------------------------


def enriched(spark, sf_dir):
    w = wide(spark, sf_dir)
    return w.withColumn("entropy", F.round(proportions.entropy([F.col(c) for c in CLASSES]), 6))


TOTAL = " + ".join(CLASSES)
ENRICHED_SQL = f"SELECT *, round({' + '.join(f'CASE WHEN {c} > 0 THEN -({c} / ({TOTAL})) * log2({c} / ({TOTAL})) ELSE 0.0 END' for c in CLASSES)}, 6) AS entropy FROM ({WIDE_SQL})"
LEAST = [t / 8 for t in THRESHOLDS]
NEED = 5
LONG_SQL = " UNION ALL ".join(f"SELECT tile_id, {i} AS i, '{c}' AS class, {c} AS share FROM ({WIDE_SQL}) WHERE {c} >= {t}" for i, (c, t) in enumerate(zip(CLASSES, LEAST, strict=True)))
TOP_SQL = f"SELECT tile_id, class, CAST(place AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY i) AS first FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY share DESC, tile_id) AS place FROM ({LONG_SQL})) WHERE place <= {NEED}) WHERE first = 1"


@query(TOP_SQL)
def topk_per_class(spark, sf_dir):
    return longs(select.top_per_class(wide(spark, sf_dir), dict.fromkeys(CLASSES, NEED), LEAST), "place")


@query(f"SELECT tile_id, entropy FROM (SELECT tile_id, entropy FROM ({ENRICHED_SQL}) ORDER BY md5(concat(tile_id, '-7')), tile_id LIMIT 60) ORDER BY entropy DESC, tile_id LIMIT 10")
def topk_entropy_pool(spark, sf_dir):
    t = enriched(spark, sf_dir)
    return t.join(select.phase_two(t, 10, 7), "tile_id", "left_semi").select("tile_id", "entropy")


@query("SELECT o_orderkey AS k FROM orders ORDER BY md5(concat(CAST(o_orderkey AS STRING), '-42')), o_orderkey LIMIT 100")
def hash_sample_n(spark, sf_dir):
    return select.sample_rows(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), 100, 42, "k")


def _targets_sql() -> str:
    mixes = f"(SELECT {', '.join(f'sum({c}) / sum({TOTAL}) AS {c}' for c in CLASSES)} FROM ({WIDE_SQL}))"
    out = []
    for label, bias in BIAS.items():
        mu = (bias - 1) / (max(BIAS.values()) - 1)
        raw = [f"least((1 - {mu!r}) * {c} + {mu!r} * {w} * {c}, {c})" for c, w in zip(CLASSES, WEIGHTS, strict=True)]
        total = " + ".join(raw)
        out += [f"SELECT '{label}k' AS label, '{c}' AS class, round(({r}) / ({total}), 6) AS share FROM {mixes}" for c, r in zip(CLASSES, raw, strict=True)]
    return " UNION ALL ".join(out)


@query(_targets_sql())
def target_distribution(spark, sf_dir):
    """Progressive targets of every subset size from the tiles' own mix."""
    mix = wide(spark, sf_dir).agg(*((F.sum(c) / F.sum(sum((F.col(x) for x in CLASSES), F.lit(0.0)))).alias(c) for c in CLASSES)).first()
    rows = [(f"{label}k", c, v) for label, bias in BIAS.items() for c, v in zip(CLASSES, select.progressive_target(list(mix), bias), strict=True)]
    return spark.createDataFrame(rows, "label string, class string, share double").withColumn("share", F.round("share", 6))


@query(f"WITH one AS ({TOP_SQL}), free AS (SELECT * FROM ({ENRICHED_SQL}) WHERE tile_id NOT IN (SELECT tile_id FROM one)) SELECT tile_id, 'phase1' AS phase FROM one UNION ALL SELECT tile_id, 'phase2' FROM (SELECT tile_id FROM (SELECT tile_id, entropy FROM free ORDER BY md5(concat(tile_id, '-3')), tile_id LIMIT 30) ORDER BY entropy DESC, tile_id LIMIT 5)")
def subset_phase12(spark, sf_dir):
    t = enriched(spark, sf_dir)
    one = select.top_per_class(t, dict.fromkeys(CLASSES, NEED), LEAST).select("tile_id")
    two = select.phase_two(t.join(one, "tile_id", "left_anti"), 5, 3)
    return one.withColumn("phase", F.lit("phase1")).unionByName(two.withColumn("phase", F.lit("phase2")))


LABELS = ("k", "CASE WHEN k % 4 = 0 THEN 'a' ELSE 'none' END AS s1", "CASE WHEN k % 3 = 0 THEN 'b' ELSE 'none' END AS s2", "CASE WHEN k % 5 = 0 THEN 'c' ELSE 'none' END AS s3")


@query(
    f"SELECT k, s1, CASE WHEN s2 <> 'none' THEN s2 WHEN s1 <> 'none' THEN s1 ELSE 'none' END AS s2, CASE WHEN s3 <> 'none' THEN s3 WHEN s1 <> 'none' THEN s1 WHEN s2 <> 'none' THEN s2 ELSE 'none' END AS s3 FROM (SELECT {', '.join(LABELS)} FROM (SELECT o_orderkey AS k FROM orders))"
)
def subset_propagate(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).selectExpr(*LABELS)
    return select.propagate_up(rows, ["s1", "s2", "s3"])


@query()
def subset_select_full(spark, sf_dir):
    """All phases for two sizes that follow the number of tiles; held against its rules in the tests."""
    t = written(enriched(spark, sf_dir), "tiles")
    n = t.count()
    sizes = {"small": max(10, n // 5), "large": max(20, n // 2)}
    targets = {k: select.progressive_target(BASE_MIX, b) for k, b in (("small", 1.5), ("large", 1.2))}
    return select.select_subsets(t, targets, sizes, batch=max(1, min(25, n // 8)), pool=2500)


# --- table work -----------------------------------------------------------------------------------------------------


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1")
def dedupe_first(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return catalog.first_by_key(rows, ["o_custkey"], [F.col("o_orderkey")])


@query("SELECT o_orderkey AS k, o_orderstatus AS status, CAST(NULL AS STRING) AS brand FROM orders UNION ALL SELECT p_partkey, NULL, p_brand FROM part")
def union_promote(spark, sf_dir):
    return files.union_all([table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "o_orderstatus AS status"), table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "p_brand AS brand")])


@query("SELECT w.priority, n FROM (SELECT unnest(['1-URGENT', '5-LOW', '9-NONE', '2-HIGH']) AS priority) w LEFT JOIN (SELECT o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1) o ON w.priority = o.priority")
def reindex_left(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"))
    return catalog.reindex(n, "priority", ["1-URGENT", "5-LOW", "9-NONE", "2-HIGH"]).select("priority", "n")


@query("SELECT o_orderpriority AS dataset, max(CASE WHEN o_orderstatus = 'F' THEN v END) AS F, max(CASE WHEN o_orderstatus = 'O' THEN v END) AS O, max(CASE WHEN o_orderstatus = 'P' THEN v END) AS P FROM (SELECT o_orderpriority, o_orderstatus, round(avg(o_totalprice), 4) AS v FROM orders GROUP BY ALL) GROUP BY 1")
def pivot_scores(spark, sf_dir):
    v = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("dataset"), "o_orderstatus").agg(F.round(F.avg("o_totalprice"), 4).alias("v"))
    return catalog.pivot_unique(v, "dataset", "o_orderstatus", "v", ["F", "O", "P"])


@query("SELECT o_orderpriority AS dataset, round(avg(o_totalprice), 4) AS score FROM orders GROUP BY 1")
def group_mean_sorted(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("dataset")).agg(F.round(F.avg("o_totalprice"), 4).alias("score")).orderBy(F.desc("score"), "dataset")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the')")
def contains_ci(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(catalog.contains_any_case("text", "THE")).select("doc_id")


@query("SELECT DISTINCT p_brand AS brand, p_type AS kind FROM part")
def distinct_values(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("kind")).distinct()


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber >= 5)")
def skip_existing(spark, sf_dir):
    work = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return files.not_done(work, table(spark, sf_dir, "lineitem").where("l_linenumber >= 5").select(F.col("l_orderkey").alias("k")), ["k"])


@query("SELECT o_orderkey AS k, coalesce(TRY_CAST(CASE WHEN o_orderkey % 4 = 0 THEN 'n/a' ELSE CAST(o_totalprice AS STRING) END AS DOUBLE), 0.0) AS v FROM orders")
def coerce_numbers(spark, sf_dir):
    text = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "CASE WHEN o_orderkey % 4 = 0 THEN 'n/a' ELSE CAST(o_totalprice AS STRING) END AS t")
    return text.select("k", F.coalesce(F.col("t").try_cast("double"), F.lit(0.0)).alias("v"))


BINS = "CASE WHEN {v} < 1 THEN -1 ELSE CAST(floor(log2({v})) AS BIGINT) END"


@query(f"SELECT bin, count(*) AS n FROM (SELECT {BINS.format(v='o_totalprice')} AS bin FROM orders) GROUP BY bin")
def class_code_bins(spark, sf_dir):
    """Power-of-two classes, as population densities are coded, and how many rows each has."""
    return table(spark, sf_dir, "orders").selectExpr(f"CAST({BINS.format(v='o_totalprice')} AS BIGINT) AS bin").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


# --- scenes and payloads --------------------------------------------------------------------------------------------

STAC_TEXT = (
    "concat('{\"id\": \"s', CAST(event_id AS STRING), '\", \"stac_version\": \"1.0.0\", \"bbox\": [', CAST(event_id % 90 AS STRING), ', 1, 2, 3], \"properties\": {\"eo:cloud\": ', CAST(event_id % 7 AS STRING), "
    "', \"raw\": \"', event_type, '\", \"providers\": [{\"name\": \"p', CAST(event_id % 3 AS STRING), '\", \"roles\": [\"host\"], \"url\": \"u\"}]}, \"assets\": {\"a', CAST(event_id % 2 AS STRING), '\": {\"href\": \"h', CAST(event_id AS STRING), '\"}}}') AS value"
)


@query("SELECT concat('s', CAST(event_id AS STRING)) AS scene_id, CAST(event_id % 90 AS DOUBLE) AS west, CAST(event_id % 7 AS STRING) AS cloud, event_type AS raw, concat('p', CAST(event_id % 3 AS STRING)) AS providers, concat('a', CAST(event_id % 2 AS STRING)) AS asset_keys, concat('h', CAST(event_id AS STRING)) AS asset_hrefs FROM events")
def stac_flatten(spark, sf_dir):
    flat = catalog.flatten_scenes(table(spark, sf_dir, "events").selectExpr(STAC_TEXT))
    return flat.select(
        "scene_id",
        F.col("bbox")[0].alias("west"),
        F.col("properties")["eo_cloud"].alias("cloud"),
        F.col("properties")["raw"].alias("raw"),
        F.array_join("provider_names", ",").alias("providers"),
        F.array_join("asset_keys", ",").alias("asset_keys"),
        F.array_join("asset_hrefs", ",").alias("asset_hrefs"),
    )


@query("SELECT event_id, year(ts) AS y, epoch_us(date_trunc('second', ts)) // 1000000 AS seconds FROM events WHERE year(ts) = (SELECT min(year(ts)) FROM events)")
def scene_time_parse(spark, sf_dir):
    """ISO texts with Z parsed to instants; those of the first year."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("text"))
    t = e.select("event_id", catalog.scene_time(F.col("text")).alias("t"))
    first = t.agg(F.min(F.year("t")).alias("y"))
    return t.withColumn("y", F.year("t").cast("long")).join(F.broadcast(first.select(F.col("y").cast("long").alias("y"))), "y", "left_semi").select("event_id", "y", F.unix_timestamp("t").alias("seconds"))


@query("SELECT user_id, round(avg(CASE WHEN event_id % 5 <> 0 THEN 1.0 ELSE 0.0 END), 6) AS clear_ratio FROM events GROUP BY user_id HAVING avg(CASE WHEN event_id % 5 <> 0 THEN 1.0 ELSE 0.0 END) >= 0.8 AND sum(abs(value)) > 0")
def scene_clear_ratio(spark, sf_dir):
    ratio = F.avg(F.when(F.col("event_id") % 5 != 0, 1.0).otherwise(0.0))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(ratio.alias("r"), F.sum(F.abs("value")).alias("s"))
    return rows.where("r >= 0.8 AND s > 0").select("user_id", F.round("r", 6).alias("clear_ratio"))


@query("SELECT vec_id, round(CAST(list_min(embedding) AS DOUBLE), 5) AS lowest, round(CAST(list_max(embedding) AS DOUBLE), 5) AS highest, round(list_avg(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS mean FROM embeddings")
def array_stats(spark, sf_dir):
    stats = arrays.array_stats(F.col("embedding"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", *stats)
    return e.select("vec_id", *(F.round(c, 5).alias(c) for c in ("lowest", "highest", "mean")))


@query("SELECT vec_id, CAST(list_sum(list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1) * 127.5) AS BIGINT))) AS BIGINT) AS total, CAST(len(embedding) AS BIGINT) AS n FROM embeddings")
def array_bytes_roundtrip(spark, sf_dir):
    """Codes compressed to bytes and read back."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", arrays.compress_uint8(arrays.scaled_codes(F.col("embedding"))).alias("data"))
    back = rows.where(F.length("data") > 0).withColumn("codes", arrays.decompress_uint8("data"))
    return back.select("vec_id", F.aggregate("codes", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size("codes").cast("long").alias("n"))


@query("SELECT vec_id, round(list_avg(list_transform(embedding, lambda x: greatest(-0.1, least(0.1, CAST(x AS DOUBLE))))), 5) AS mean FROM embeddings")
def array_clip(spark, sf_dir):
    clipped = arrays.clip(F.transform("embedding", lambda v: v.cast("double")), F.lit(-0.1), F.lit(0.1))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(clipped, F.lit(0.0), lambda a, x: a + x) / F.size("embedding"), 5).alias("mean"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def incremental_append(spark, sf_dir):
    """The events appended by a file stream (twice: the second run finds nothing new), then summed up."""
    where, mark = (f"{scratch_base(spark)}/{x}-{uuid.uuid4().hex}" for x in ("appended", "progress"))
    source = table(spark, sf_dir, "events")
    for _ in range(2):
        incremental.append_new_files(spark, f"{sf_dir}/events.parquet*", source.schema, where, mark, lambda df: df.select("event_type", "value"))
    return spark.read.schema("event_type string, value double").parquet(where).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    "SELECT event_type, event_id % 50 AS part, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY event_type, event_id % 50"
)
def latest_events(spark, sf_dir):
    """The last event of each kind and part, kept by a stream of files in levelled runs (six batches)."""
    source, where, mark = (f"{scratch_base(spark)}/{x}-{uuid.uuid4().hex}" for x in ("arrivals", "latest", "progress"))
    rows = table(spark, sf_dir, "events").select(F.struct("event_type", (F.col("event_id") % 50).alias("part")).alias("key"), F.col("event_id").cast("long").alias("event_id"), "value")
    rows.repartition(6, "event_id").write.parquet(source)
    incremental.latest_by_key(spark, source, rows.schema, "key", "event_id", where, mark, fanout=2, files_a_batch=1)
    return incremental.read_latest(spark, rows.schema, "key", "event_id", where).select("key.event_type", "key.part", "event_id", "value")


# --- tile tables ----------------------------------------------------------------------------------------------------

AREA_MOST = 3
_AREA_SHIFT = 1 << (grid.PART_BITS - 1)


@query(
    f"WITH d AS (SELECT t.k, level, zone, d, (x + {_AREA_SHIFT}) >> ({grid.PART_BITS} - d) AS px, (y + {_AREA_SHIFT}) >> ({grid.PART_BITS} - d) AS py FROM ({sql('customer', TILES)}) t, (SELECT unnest(range({grid.PART_BITS + 1})) AS d)), "
    f"n AS (SELECT k, d, count(*) OVER (PARTITION BY level, zone, d, px, py) AS n FROM d) SELECT k, coalesce(min(CASE WHEN n <= {AREA_MOST} THEN d END), {grid.PART_BITS}) AS depth FROM n GROUP BY k"
)
def bounded_areas(spark, sf_dir):
    """How often the plane is quartered around each tile until no area has more than three tiles of a level and zone."""
    tiles = view(spark, sf_dir, "customer", TILES).select("k", "level", "zone", F.col("x").alias("x_idx"), F.col("y").alias("y_idx"))
    return grid.bounded_parts(tiles, AREA_MOST).select("k", F.split("part", ":")[0].cast("long").alias("depth"))


BOX_SQL = f"SELECT tile_id, zone, level, k, 100000 + x * level AS a, CASE WHEN zone LIKE '%S' THEN 10000000 ELSE 0 END + y * level AS b FROM ({TILES_SQL})"


@query(f"SELECT tile_id, zone, level, {EPSG_TEXT} AS crs, CAST(a AS DOUBLE) AS minx, CAST(b AS DOUBLE) AS miny, CAST(a + level AS DOUBLE) AS maxx, CAST(b + level AS DOUBLE) AS maxy, a + level / 2.0 AS centroid_x, b + level / 2.0 AS centroid_y FROM ({BOX_SQL})")
def tile_metadata(spark, sf_dir):
    return catalog.tile_metadata(identified(spark, sf_dir))


@query(f"SELECT tile_id, {EPSG_TEXT} AS crs, CAST(NULL AS DOUBLE) AS ndvi_avg FROM ({TILES_SQL})")
def attribute_placeholders(spark, sf_dir):
    return catalog.attribute_table(tiles(spark, sf_dir)).select("tile_id", "crs", "ndvi_avg")


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'small' ELSE 'none' END AS small, CASE WHEN o_orderkey % 2 = 0 THEN 'large' ELSE 'none' END AS large FROM orders")
def subset_map_back(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return catalog.map_back(rows, {"small": rows.where("k % 3 = 0"), "large": rows.where("k % 2 = 0")}, "k")


@query(
    f"WITH w AS (SELECT *, md5(concat(tile_id, '-42')) AS h FROM ({WIDE_SQL})), drawn AS (SELECT * FROM w WHERE lc_0 > 0.1 AND CAST(concat('0x', substr(h, 1, 5)) AS BIGINT) * 1000 < 250 * 1048576) "
    "SELECT tile_id, round(lc_0, 4) AS share FROM w WHERE NOT lc_0 > 0.1 UNION ALL SELECT tile_id, round(lc_0, 4) FROM (SELECT * FROM drawn ORDER BY h, tile_id LIMIT 1000)"
)
def open_sea_filter(spark, sf_dir):
    """All tiles with little open sea, and of the others a quarter by hash, 1,000 at most."""
    return select.downsample_class(wide(spark, sf_dir), "lc_0", 0.1, 250, 1000).select("tile_id", F.round("lc_0", 4).alias("share"))


CHIP = ("l_suppkey % 3 AS scene_id", "l_orderkey % 480 AS x", "l_partkey % 480 AS y", "CAST(l_linenumber AS BIGINT) AS value", "l_linenumber < 7 AS clear")


@query(f"SELECT concat('t', CAST(x // 120 AS STRING), '-', CAST(y // 120 AS STRING)) AS tile_id, scene_id, round(avg(CASE WHEN clear THEN 1.0 ELSE 0.0 END), 6) AS clear_ratio, count(*) AS n FROM (SELECT {', '.join(CHIP)} FROM lineitem) GROUP BY 1, 2 HAVING avg(CASE WHEN clear THEN 1.0 ELSE 0.0 END) >= 0.8")
def scene_chip_extract(spark, sf_dir):
    """Chips of 120 metres from pixels; their bytes are read back for the pixel count."""
    px = table(spark, sf_dir, "lineitem").selectExpr(*CHIP)
    cells = px.select(F.floor(F.col("x") / 120).alias("x_idx"), F.floor(F.col("y") / 120).alias("y_idx")).distinct()
    t = cells.select(F.concat(F.lit("t"), F.col("x_idx"), F.lit("-"), F.col("y_idx")).alias("tile_id"), "x_idx", "y_idx", F.lit(120).alias("level"), F.lit(0).alias("origin_x"), F.lit(0).alias("origin_y"))
    chips = zonal.scene_chips(t, px)
    return chips.select("tile_id", "scene_id", F.round("clear_ratio", 6).alias("clear_ratio"), F.size(arrays.decompress_uint8("image")).cast("long").alias("n"))


MORTON_BITS = " + ".join(f"((x >> {i}) % 2) * {4**i} + ((y >> {i}) % 2) * {2 * 4**i}" for i in range(16))


@query(f"SELECT tile_id, CAST({MORTON_BITS} AS BIGINT) AS key FROM (SELECT * FROM ({TILES_SQL}) WHERE zone LIKE '%N')")
def morton_cells(spark, sf_dir):
    """Locality keys of the northern tiles, whose indices are not negative."""
    return tiles(spark, sf_dir).where("zone LIKE '%N'").select("tile_id", grid.morton(F.col("x_idx"), F.col("y_idx")).alias("key"))
