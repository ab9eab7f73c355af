import json
import math

import pytest
from pyspark.sql import functions as F

from terrapane.dims import BIAS, MARGIN, zone_table
from terrapane.functions import tileid
from terrapane.functions.geometry import wkt_polygon
from terrapane.operators import grid, reproject, select
from terrapane.plans import catalog, more_queries
from terrapane.plans.queries import QUERIES
from terrapane.sources import files
from terrapane.streaming import incremental


@pytest.fixture(scope="module")
def made(spark, sf):
    return more_queries.identified(spark, sf).drop("k", "origin_x", "origin_y")


@pytest.mark.parametrize("form", ["PARQUET", "PARQUET_NO_COMPRESS"])
def test_grid_files_round_trip(spark, made, tmp_path, form):
    files.write_grid(made, str(tmp_path / form), form)
    back = spark.read.parquet(str(tmp_path / form))
    assert back.count() == made.count() and set(back.columns) == set(made.columns)


def test_geojson_and_csv(spark, made, tmp_path):
    files.write_grid(made, str(tmp_path / "g"), "GEOJSON")
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "g")).collect()]
    assert len(lines) == made.count() and {x["geometry"]["type"] for x in lines} == {"Polygon"}
    (tmp_path / "c.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": lines[:3]}))
    assert files.read_geojson(spark, str(tmp_path / "c.geojson"), "tile_id: string").count() == 3
    files.write_grid(made, str(tmp_path / "csv"), "CSV")
    n = files.csv_row_counts(spark, [str(tmp_path / "csv")]).agg(F.sum("row_count")).first()[0]
    assert n == made.count()
    with pytest.raises(ValueError):
        files.write_grid(made, str(tmp_path / "x"), "SHP")


@pytest.mark.parametrize("how", ["single_file", "per_level", "partitioned"])
def test_enriched_layouts(spark, made, tmp_path, how):
    files.write_enriched(made, str(tmp_path / how), how)
    assert spark.read.parquet(str(tmp_path / how)).count() == made.count()


def test_index_is_in_natural_order(spark, made, tmp_path):
    files.write_index(made, str(tmp_path / "i"))
    rows = [r.tile_id for r in spark.read.parquet(str(tmp_path / "i")).collect()]
    assert sorted(rows) == sorted(r.tile_id for r in made.select("tile_id").collect())


def test_missing_columns_are_null(spark, made, tmp_path):
    made.select("tile_id").write.parquet(str(tmp_path / "a/x"))
    made.select("tile_id", "super_id").write.parquet(str(tmp_path / "a/y"))
    df = files.read_tables(spark, str(tmp_path / "a"), ["tile_id", "super_id", "nothing"])
    assert df.columns == ["tile_id", "super_id", "nothing"] and df.count() == 2 * made.count()


def test_structure_scan(spark, tmp_path):
    (tmp_path / "d/e").mkdir(parents=True)
    (tmp_path / "d/a.csv").write_text("x\n1\n")
    (tmp_path / "d/e/b.txt").write_text("hello there\nother")
    found = {r.relative_path: (r.is_folder, r.file_size) for r in catalog.structure(spark, str(tmp_path)).collect()}
    assert found == {"d": (True, None), "d/e": (True, None), "d/a.csv": (False, 4), "d/e/b.txt": (False, 17)}
    assert catalog.structure_summary(catalog.structure(spark, str(tmp_path))).first()[:2] == (2, 2)
    assert [r.line for r in files.search_files(spark, str(tmp_path), "there").collect()] == ["hello there"]


def test_scene_texts_from_files(spark, tmp_path):
    item = {"id": "s", "bbox": [1, 2, 3, 4], "geometry": {"type": "Point"}, "properties": {"a:b": 1, "providers": [{"name": "n", "roles": ["r"], "url": "u"}]}, "assets": {"k": {"href": "h"}}}
    (tmp_path / "x").mkdir()
    (tmp_path / "x/item.json").write_text(json.dumps(item))
    r = catalog.flatten_scenes(files.read_json_texts(spark, str(tmp_path))).first()
    assert (r.scene_id, r.bbox, r.properties, r.provider_names, r.provider_roles, r.asset_keys, r.asset_hrefs) == ("s", [1, 2, 3, 4], {"a_b": "1"}, ["n"], [["r"]], ["k"], ["h"])


def test_manifest_text(spark, made):
    assert json.loads(files.manifest_text(catalog.manifest(made), "x"))["tiles"] == made.count()


def test_nesting_and_orphans(spark, made):
    assert catalog.nesting_report(made).where("incorrect > 0").count() > 0
    assert catalog.orphans(made).count() > 0


def test_pivot_refuses_two_rows_for_a_cell(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 2.0)], "i string, c string, v double")
    with pytest.raises(Exception, match="two rows"):
        catalog.pivot_unique(df, "i", "c", "v", ["x"]).collect()


def test_targets_add_up():
    base = [0.3, 0.2, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05, 0.04, 0.03, 0.02, 0.01]
    for b in BIAS.values():
        assert sum(select.progressive_target(base, b)) == pytest.approx(1)


def test_full_selection_keeps_its_rules(spark, sf):
    picks = QUERIES["subset_select_full"](spark, sf).toPandas()
    tiles = more_queries.enriched(spark, sf).toPandas().set_index("tile_id")
    n, earlier = len(tiles), set()
    for label, size in (("small", max(10, n // 5)), ("large", max(20, n // 2))):
        mine = picks[picks.subset == label]
        quota = int(size * select.KEPT_SHARE) - len(earlier)
        by = {p: set(g.tile_id) for p, g in mine.groupby("phase")}
        assert mine.tile_id.is_unique
        assert by.get("reuse", set()) == earlier
        assert len(by.get("phase2", ())) == int(quota * select.PHASE2)
        assert len(by.get("phase1", ())) <= max(int(quota * select.PHASE1), 0) + len(select.CLASSES)
        assert len(mine) <= int(size * select.KEPT_SHARE) + len(select.CLASSES)
        assert set(mine.tile_id) <= set(tiles.index)
        # phase 2 takes the most mixed of its pool, so its tiles are more mixed than those left on the whole
        if by.get("phase2"):
            assert tiles.loc[list(by["phase2"])].entropy.mean() >= tiles.drop(list(by["phase2"])).entropy.mean()
        earlier = set(mine.tile_id)


def tile_mixes(spark, n=700, seed=3):
    import numpy as np

    shares = np.random.default_rng(seed).dirichlet(np.full(len(select.CLASSES), 0.3), n)
    rows = [(f"G1200m_31N_X{i:06d}_Y000001", *map(float, s), float(i % 17)) for i, s in enumerate(shares)]
    return rows, spark.createDataFrame(rows, "tile_id string, " + ", ".join(f"{c} double" for c in select.CLASSES) + ", entropy double").repartition(5)


@pytest.mark.parametrize("n", [40, 333, 690, 2000])
def test_phase_three_equals_a_plain_version(spark, n):
    import hashlib

    rows, df = tile_mixes(spark)
    batch, pool, seed = 10, 120, 5
    target, sums, count = select.progressive_target([1 / len(select.CLASSES)] * len(select.CLASSES), 1.2), [3.0] + [1.0] * (len(select.CLASSES) - 1), 20
    got = {r.tile_id for r in select.phase_three(df, n, target, sums, count, batch, pool, seed).collect()}
    order = sorted(rows, key=lambda r: (hashlib.md5(f"{r[0]}-{seed}".encode()).hexdigest(), r[0]))
    cuts = [order[i : i + batch] for i in range(0, len(order), batch)]
    left, taken, need, least = list(range(len(cuts))), [], n, min(batch, n)
    while need > 0:
        before = len(taken)
        usable = [b for b in left if len(cuts[b]) >= least]
        for i in range(0, len(usable), pool // batch):
            part = usable[i : i + pool // batch]
            for _ in range(max(1, len(part) // 4)):
                if need <= 0:
                    break
                total = lambda b: [sum(r[1 + k] for r in cuts[b]) for k in range(len(target))]
                best = min((b for b in part if b not in [t for t, _ in taken]), key=lambda b: sum(((s + x) / (count + len(cuts[b])) - t) ** 2 for s, x, t in zip(sums, total(b), target, strict=True)))
                taken.append((best, min(len(cuts[best]), need)))
                sums, count, need = [s + x for s, x in zip(sums, total(best), strict=True)], count + len(cuts[best]), need - taken[-1][1]
        left = [b for b in left if b not in [t for t, _ in taken]]
        if len(taken) == before:
            break
    assert got == {r[0] for b, k in taken for r in sorted(cuts[b])[:k]}
    assert len(got) == min(n, 700)


def test_samples_equal_a_sort_of_all(spark, monkeypatch):
    _, df = tile_mixes(spark)
    want = {k: {r.tile_id for r in select.sample_rows(df, k, 9).collect()} for k in (1, 50, 699, 700, 900)}
    monkeypatch.setattr(select, "TOP", 0)
    monkeypatch.setattr(select, "PREFIX", 2)
    assert {k: {r.tile_id for r in select.sample_rows(df, k, 9).collect()} for k in want} == want
    assert len(want[50]) == 50 and len(want[900]) == 700


def test_greatest_shares_are_limited_before_the_shuffle(spark, capsys):
    _, df = tile_mixes(spark)
    select.top_per_class(df, dict.fromkeys(select.CLASSES, 3), [0.1] * len(select.CLASSES)).explain()
    assert "WindowGroupLimit" in capsys.readouterr().out


def crossing(quad, box):
    """Do the sides or insides of a quadrilateral and a box (west, south, east, north) meet? By segments, not by axes."""
    w, s, e, n = box
    rect = [(w, s), (e, s), (e, n), (w, n)]
    turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    inside = lambda p, shape: all(turn(a, b, p) >= 0 for a, b in zip(shape, shape[1:] + shape[:1], strict=True))
    if any(inside(p, rect) for p in quad) or any(inside(p, quad) for p in rect):
        return True
    cut = lambda a, b, c, d: turn(a, b, c) * turn(a, b, d) <= 0 and turn(c, d, a) * turn(c, d, b) <= 0
    return any(cut(a, b, c, d) for a, b in zip(quad, quad[1:] + quad[:1], strict=True) for c, d in zip(rect, rect[1:] + rect[:1], strict=True))


@pytest.mark.parametrize("zone", ["1N", "60S", "31N"])
def test_border_tiles_by_segments(spark, zone):
    z = zone_table(spark).where(F.col("zone") == zone)
    level = 120000
    boxes = grid.with_box(grid.utm_indices(z, level))
    rows = grid.with_corners(grid.with_centroid_degrees(boxes)).collect()
    near = boxes.where(grid.may_reach_zone(level)).select("x_idx", "y_idx").collect()
    near = {tuple(r) for r in near}
    want, by_bounds = set(), 0
    for r in rows:
        quad = [(r[f"lon{i}"], r[f"lat{i}"]) for i in range(4)]
        h = (level / MARGIN[level]) / (111320 * math.cos(math.radians(min(abs(r.lat), 80))))
        centre = r.lon_min <= r.lon < r.lon_max and r.lat_min <= r.lat <= r.lat_max
        lons, lats = [p[0] for p in quad], [p[1] for p in quad]
        if centre or r.lon_min - h <= r.lon <= r.lon_max + h and crossing(quad, (r.lon_min, r.lat_min, r.lon_max, r.lat_max)) and max(lons) - min(lons) <= 12:
            want.add((r.x_idx, r.y_idx))
            by_bounds += 1
    assert want <= near
    assert {(r.x_idx, r.y_idx) for r in grid.utm_grid(z, level).collect()} == want


def test_grids_spread_over_tasks(spark):
    z = zone_table(spark).where("zone_num IS NOT NULL")
    assert grid.utm_indices(z, 120000).rdd.getNumPartitions() == 1
    assert grid.utm_indices(z, 1200).rdd.getNumPartitions() > 100  # not run: 600 million candidates


def test_tables_of_degrees(spark, made, tmp_path):
    rows = made.where("level <= 2400 AND abs(y_idx) < 3000")
    reproject.write_wgs84(rows, str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    assert one.count() == rows.count() and set(one.columns) == {*rows.columns, "crs", "geometry"}
    files.write_grid(rows, str(tmp_path / "grid"))
    files.write_grid(rows.limit(5), str(tmp_path / "more"))
    both = spark.read.parquet(str(tmp_path / "grid")).unionByName(spark.read.parquet(str(tmp_path / "more")))
    reproject.merge_files(both, str(tmp_path / "merged"))
    key = lambda d: sorted((r.tile_id, r.geometry, r.crs) for r in d.collect())
    assert key(spark.read.parquet(str(tmp_path / "merged"))) == key(one)
    wkt = rows.select("tile_id", wkt_polygon().alias("utm_footprint"), tileid.epsg(F.col("zone")).alias("crs"))
    back = reproject.boxes_from_wkt(wkt)
    assert back.join(rows, ["tile_id", "zone", "minx", "miny", "maxx", "maxy"]).count() == rows.count()


def test_structure_texts(spark, made, tmp_path):
    (tmp_path / "d/e").mkdir(parents=True)
    (tmp_path / "d/a.csv").write_text("x\n1\n")
    (tmp_path / "d/e/b.txt").write_text("hello")
    found = catalog.structure(spark, str(tmp_path))
    assert [r.line for r in catalog.structure_yaml(found).collect()] == ['"d":', '  "a.csv": 4', '  "e":', '    "b.txt": 5']
    catalog.snapshot(found, str(tmp_path / "snapshots"), "v1")
    assert json.loads(spark.read.text(str(tmp_path / "snapshots/v1/summary")).first().value)["n_files"] == 2
    assert f"* {made.count()} tiles" in catalog.grid_readme(catalog.manifest(made), "Tiles")


def test_guard_stops_a_bad_row(spark):
    df = spark.range(5)
    assert catalog.guard(df, {"negative": F.col("id") >= 0, "large": F.col("id") < 9}).count() == 5
    with pytest.raises(Exception, match="too large"):
        catalog.guard(df, {"too large": F.col("id") < 3}).collect()


def test_footers_chips_and_catalog(spark, made, tmp_path):
    made.repartition(3).write.parquet(str(tmp_path / "t"))
    counts = catalog.row_counts(spark.read.parquet(str(tmp_path / "t"))).collect()
    assert sum(r.row_count for r in counts) == made.count()
    (tmp_path / "x.csv").write_text("a,b\n1,u\n2,v\n")
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "x.csv"), "a int, b string").collect()] == [(1, "u"), (2, "v")]
    files.write_chips(made.select("tile_id", F.encode("tile_id", "UTF-8").alias("image")), str(tmp_path / "chips"))
    assert spark.read.parquet(str(tmp_path / "chips")).where("decode(image, 'UTF-8') = tile_id").count() == made.count()
    made.limit(4).createOrReplaceTempView("few")
    try:
        files.save_tables({"kept_tiles": spark.table("few")}, "t_")
        assert spark.table("t_kept_tiles").count() == 4
    finally:
        spark.sql("DROP TABLE IF EXISTS t_kept_tiles")


def test_clusters_and_locality(spark, made):
    rows = made.where("zone LIKE '%N'")
    got = grid.spatial_clusters(rows, 3)
    assert got.count() == rows.count() and got.select("cluster").distinct().count() == 3
    assert grid.by_locality(rows, 4).rdd.getNumPartitions() <= 4 and grid.by_locality(rows, 4).count() == rows.count()


def test_stream_reads_each_file_once(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).write.mode("append").parquet(src)
        incremental.append_new_files(spark, src, "id long", out, mark)
        assert spark.read.parquet(out).count() == 10 * (i + 1)


def test_latest_by_key(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    schema, want = "k long, t long, v string", {}
    assert incremental.read_latest(spark, schema, "k", "t", out).count() == 0
    for i in range(9):
        rows = [(k, i if k % 2 else -i, f"{i}") for k in range(i, i + 6)]
        want = {k: max(want.get(k, (-99, "")), (t, v)) for k, t, v in rows} | {k: x for k, x in want.items() if k not in range(i, i + 6)}
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        incremental.latest_by_key(spark, src, schema, "k", "t", out, mark, fanout=2)
        assert {r.k: (r.t, r.v) for r in incremental.read_latest(spark, schema, "k", "t", out).collect()} == want
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["L0-8", "L3-0"]  # nine batches: 8 + 1
    # a merge that was complete before its parts were deleted changes nothing
    spark.createDataFrame([(0, 0, "0")], schema).write.parquet(f"{out}/L0-7")
    assert {r.k: (r.t, r.v) for r in incremental.read_latest(spark, schema, "k", "t", out).collect()} == want


def test_lattice_step_widens(spark):
    b = spark.createDataFrame([(0.0, 0.0, 10.0, 61.0)], "west double, south double, east double, north double")
    n = {r.lat: r.n for r in grid.geodesic_lattice(b, 111320.0).groupBy(F.round("lat").alias("lat")).agg(F.count("*").alias("n")).collect()}
    assert n[0.0] == 11 and n[60.0] == 6
