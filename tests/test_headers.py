"""Headers of files: nothing but footers and directories is read."""

import struct

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from terrapane.sources import headers


def tiff(path, width, height, scale, tie, epsg=None, order="<", big=False, geographic=False):
    """A TIFF of one directory and no pixels."""
    geo = [1, 1, 0, 1, 2048 if geographic else 3072, 0, 1, epsg] if epsg else None
    values = [(256, 3, [width]), (257, 4, [height]), (33550, 12, [*scale, 0.0]), (33922, 12, [*tie[:2], 0.0, *tie[2:], 0.0])] + ([(34735, 3, geo)] if geo else [])
    entry, first = (20, 16) if big else (12, 8)
    at = first + (8 if big else 2) + entry * len(values) + (8 if big else 4)
    directory, rest = b"", b""
    for tag, kind, value in values:
        data = struct.pack(f"{order}{len(value)}{headers.KINDS[kind]}", *value)
        room = 8 if big else 4
        if len(data) <= room:
            held = data.ljust(room, b"\0")
        else:
            held = struct.pack(order + ("Q" if big else "I"), at + len(rest))
            rest += data
        directory += struct.pack(order + ("HHQ" if big else "HHI"), tag, kind, len(value)) + held
    head = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, first) if big else struct.pack(order + "HI", 42, first))
    path.write_bytes(head + struct.pack(order + ("Q" if big else "H"), len(values)) + directory + struct.pack(order + ("Q" if big else "I"), 0) + rest)


@pytest.fixture()
def root(tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    table = pa.table({"tile_id": [f"G1200m_31N_X{i:06d}_Y000001" for i in range(5_000)], "super_id": ["G2400m_31N_X000000_Y000000"] * 5_000, "x": list(range(5_000))})
    pq.write_table(table.replace_schema_metadata({"geo": "{}", "made": "here"}), tmp_path / "a" / "one.parquet", row_group_size=1_000)
    pq.write_table(pa.table({"tile_id": ["G120000m_9S_X000001_Y-00003"], "x": [90_000]}), tmp_path / "a" / "b" / "two.parquet")
    pq.write_table(pa.table({"other": [1.5, None]}), tmp_path / "three.gpq")
    (tmp_path / "broken.parquet").write_bytes(b"PAR1 nothing PAR1")
    (tmp_path / "note.txt").write_text("hello")
    (tmp_path / "_SUCCESS").write_text("")
    return tmp_path


def test_headers_of_a_mixed_folder(spark, root):
    got = {r.file.split("/")[-1]: r for r in headers.file_headers(spark, str(root), 2).collect()}
    assert set(got) == {"one.parquet", "two.parquet", "three.gpq", "broken.parquet", "note.txt"}
    one = got["one.parquet"]
    assert (one.rows, one.row_groups, [c.name for c in one.columns], tuple(one.bounds["x"]), one.key_values["made"]) == (5_000, 5, ["tile_id", "super_id", "x"], (0.0, 4_999.0), "here")
    assert got["broken.parquet"].error and got["broken.parquet"].rows is None
    assert (got["note.txt"].size, got["note.txt"].kind, got["note.txt"].error) == (5, "txt", None)
    structure = {r.relative_path: r for r in headers.table_structure(spark, str(root)).collect()}
    assert structure["a/b/two.parquet"].row_count == 1 and structure["a/one.parquet"].parquet_metadata["geo"] == "{}"


def test_no_data_page_is_read(spark, root):
    path = root / "a" / "one.parquet"
    data = bytearray(path.read_bytes())
    footer = int.from_bytes(data[-8:-4], "little") + 8
    data[4:-footer] = bytes(len(data) - 4 - footer)  # no page is left
    path.write_bytes(data)
    row = headers.file_headers(spark, str(path)).first()
    assert row.rows == 5_000 and row.error is None


def test_files_without_the_columns_are_skipped(spark, root):
    df = headers.read_having(spark, str(root), ["tile_id", "x"])
    assert df.count() == 5_001 and len(df.inputFiles()) == 2
    df = headers.read_having(spark, str(root), ["tile_id", "x"], headers.may_hold("x", 10_000, 99_999))
    assert [r.x for r in df.collect()] == [90_000] and len(df.inputFiles()) == 1
    with pytest.raises(FileNotFoundError):
        headers.read_having(spark, str(root), ["nowhere"])


def test_index_is_built_from_the_files_that_have_ids(spark, root, tmp_path):
    index = headers.build_index(spark, str(root), str(tmp_path / "index"), rows_a_file=2_000)
    rows = index.collect()
    assert len(rows) == 5_001 and index.columns == ["tile_id", "super_id"] and len(index.inputFiles()) >= 3
    assert {r.super_id for r in rows if r.tile_id.startswith("G120000m")} == {None}
    files = sorted(index.inputFiles())
    first = pq.read_table(files[0].removeprefix("file://"))
    assert first.column("tile_id")[0].as_py().startswith("G120000m_9S")  # zone 9 before 31


def test_footprints_from_directories(spark, tmp_path):
    tiff(tmp_path / "degrees.tif", 100, 50, (0.01, 0.02), (0, 0, 5.0, 48.0), 4326, geographic=True)
    tiff(tmp_path / "utm.tif", 1000, 2000, (10.0, 10.0), (0, 0, 500_000.0, 5_000_000.0), 32631, order=">")
    tiff(tmp_path / "big.tiff", 10, 10, (1000.0, 1000.0), (5, 5, 0.0, -1_000_000.0), 3031, big=True)
    tiff(tmp_path / "nowhere.tif", 10, 10, (1.0, 1.0), (0, 0, 0.0, 0.0))
    rows = headers.file_headers(spark, str(tmp_path))
    got = {r.file.split("/")[-1]: r for r in rows.collect()}
    assert all(r.error is None for r in got.values())
    assert (got["utm.tif"].crs, got["utm.tif"].width, got["utm.tif"].miny, got["utm.tif"].maxx) == ("EPSG:32631", 1000, 4_980_000.0, 510_000.0)
    assert (got["big.tiff"].crs, got["big.tiff"].minx, got["big.tiff"].maxy) == ("EPSG:3031", -5_000.0, -995_000.0)
    prints = {r.file.split("/")[-1]: r.geometry for r in headers.footprints(rows).collect()}
    assert set(prints) == {"degrees.tif", "utm.tif", "big.tiff"}
    assert prints["degrees.tif"] == "POLYGON ((5.000000 47.000000, 6.000000 47.000000, 6.000000 48.000000, 5.000000 48.000000, 5.000000 47.000000))"
    assert prints["utm.tif"].startswith("POLYGON ((3.000000 44.9")


def test_listing_is_cut_into_tasks(spark, root):
    assert headers.file_headers(spark, str(root), 1).rdd.getNumPartitions() == 5
    assert headers.file_headers(spark, str(root)).agg(F.sum("rows")).first()[0] == 5_003
