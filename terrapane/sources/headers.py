"""What files say of themselves: a data source that reads Parquet footers and TIFF directories, never their data.

One row a file. The driver lists names only; tasks open the files, some hundreds each, and read a few kilobytes of every
one, wherever the file is that pyarrow can open (local and shared folders, HDFS, object stores). Files of other kinds are
listed with their size; a file that cannot be parsed has its error, and does not stop the scan.

On these rows stand the tables that need no data: row counts, schemas, key-values, footprints of rasters; and the scans
that leave out files before reading them: those without the columns asked for, or whose statistics exclude a range.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from terrapane.functions import geometry
from terrapane.functions.tileid import zone_order
from terrapane.operators import reproject

FILES_A_TASK = 256
SCHEMA = (
    "file string, size long, kind string, rows long, row_groups int, columns array<struct<name:string,type:string>>, bounds map<string,struct<low:double,high:double>>, key_values map<string,string>, "
    "crs string, width long, height long, minx double, miny double, maxx double, maxy double, error string"
)
FIELDS = [f.split(" ")[0] for f in SCHEMA.replace(", ", "\n").split("\n")]
#: Fixed values of the TIFF format: tags, and the bytes of the types of their values.
WIDTH, HEIGHT, PIXEL_SCALE, TIEPOINT, GEO_KEYS = 256, 257, 33550, 33922, 34735
GEOGRAPHIC, PROJECTED = 2048, 3072
KINDS = {3: "H", 4: "I", 12: "d", 16: "Q"}


def parquet_header(source) -> dict:
    """Rows, row groups, columns, bounds of numeric columns and key-values, from the footer."""
    import pyarrow.parquet as pq

    meta = pq.ParquetFile(source).metadata
    schema = meta.schema.to_arrow_schema()
    bounds: dict[str, list[float]] = {}
    for g in range(meta.num_row_groups):
        for c in range(meta.num_columns):
            column = meta.row_group(g).column(c)
            s = column.statistics
            if s is not None and s.has_min_max and isinstance(s.min, (int, float)) and not isinstance(s.min, bool):
                low, high = bounds.setdefault(column.path_in_schema, [float(s.min), float(s.max)])
                bounds[column.path_in_schema] = [min(low, s.min), max(high, s.max)]
    text = {k.decode(errors="replace"): v.decode(errors="replace") for k, v in (meta.metadata or {}).items()}
    columns = [(f.name, str(f.type)) for f in schema]
    return {"rows": meta.num_rows, "row_groups": meta.num_row_groups, "columns": columns, "bounds": {k: (float(a), float(b)) for k, (a, b) in bounds.items()}, "key_values": text}


def tiff_header(source) -> dict:
    """Width, height, CRS and bounds, from the first directory of a classic or big TIFF."""

    def read(at: int, form: str) -> tuple:
        source.seek(at)
        return struct.unpack(order + form, source.read(struct.calcsize(order + form)))

    order = {b"II": "<", b"MM": ">"}[source.read(2)]
    big = read(2, "H")[0] == 43
    (at,) = read(8, "Q") if big else read(4, "I")
    (n,) = read(at, "Q" if big else "H")
    tags = {}
    for i in range(n):
        here = at + (8 + 20 * i if big else 2 + 12 * i)
        tag, kind, count = read(here, "HHQ" if big else "HHI")
        if tag in (WIDTH, HEIGHT, PIXEL_SCALE, TIEPOINT, GEO_KEYS) and kind in KINDS:
            value, room = here + (12 if big else 8), 8 if big else 4
            if struct.calcsize("=" + KINDS[kind]) * count > room:
                (value,) = read(value, "Q" if big else "I")
            tags[tag] = read(value, f"{count}{KINDS[kind]}")
    out = {"width": tags[WIDTH][0], "height": tags[HEIGHT][0]}
    if GEO_KEYS in tags:
        keys = {tags[GEO_KEYS][i]: tags[GEO_KEYS][i + 3] for i in range(4, len(tags[GEO_KEYS]) - 3, 4)}
        code = keys.get(PROJECTED) or keys.get(GEOGRAPHIC)
        out["crs"] = f"EPSG:{code}" if code else None
    if PIXEL_SCALE in tags and TIEPOINT in tags:
        (sx, sy), (i, j, _, x, y) = tags[PIXEL_SCALE][:2], tags[TIEPOINT][:5]
        west, north = x - i * sx, y + j * sy
        out |= {"minx": west, "miny": north - out["height"] * sy, "maxx": west + out["width"] * sx, "maxy": north}
    return out


READERS = {"parquet": parquet_header, "gpq": parquet_header, "tif": tiff_header, "tiff": tiff_header}


class Files(InputPartition):
    def __init__(self, names: list[tuple[str, int]]):
        self.names = names


class HeaderReader(DataSourceReader):
    def __init__(self, root: str, files_a_task: int):
        self.root, self.files_a_task = root, files_a_task

    def _place(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root) if ":/" in self.root else (fs.LocalFileSystem(), self.root)

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        files, path = self._place()
        at = files.get_file_info(path)
        if at.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        found = [at] if at.type == fs.FileType.File else files.get_file_info(fs.FileSelector(path, recursive=True))
        names = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))
        n = self.files_a_task
        return [Files(names[i : i + n]) for i in range(0, len(names), n)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        files, _ = self._place()
        for name, size in partition.names:
            kind = name.rpartition(".")[2].lower() if "." in name.rpartition("/")[2] else ""
            row = dict.fromkeys(FIELDS) | {"file": name, "size": size, "kind": kind}
            if kind in READERS:
                try:
                    with files.open_input_file(name) as source:
                        row |= READERS[kind](source)
                except Exception as e:  # noqa: BLE001  whatever is wrong with one file, the others are read
                    row["error"] = f"{type(e).__name__}: {e}"[:300]
            yield tuple(row[f] for f in FIELDS)


class HeaderSource(DataSource):
    """spark.read.format("file_headers").option("root", …)."""

    @classmethod
    def name(cls) -> str:
        return "file_headers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HeaderReader:
        return HeaderReader(self.options["root"], int(self.options.get("files_a_task", FILES_A_TASK)))


def file_headers(spark: SparkSession, root: str, files_a_task: int = FILES_A_TASK) -> DataFrame:
    """A row for each file under root (or root itself); names that begin with a dot or underscore are left out."""
    spark.dataSource.register(HeaderSource)
    return spark.read.format(HeaderSource.name()).option("root", root).option("files_a_task", str(files_a_task)).load()


def has_columns(*names: str) -> Column:
    held = F.transform("columns", lambda c: c["name"])
    return F.coalesce(F.forall(F.array(*map(F.lit, names)), lambda n: F.array_contains(held, n)), F.lit(False))


def may_hold(column: str, low: float, high: float) -> Column:
    """Can a file have values of the column from low to high? Files without its statistics can."""
    b = F.element_at("bounds", column)
    return F.coalesce((b["low"] <= high) & (b["high"] >= low), F.lit(True))


def read_having(spark: SparkSession, root: str, columns: list[str], where: Column | None = None) -> DataFrame:
    """These columns of the Parquet files under root that have them all (and whose headers pass where); the others are never opened for data. What comes to the driver is names of files."""
    found = file_headers(spark, root).where(has_columns(*columns))
    if where is not None:
        found = found.where(where)
    names = [r.file for r in found.select("file").collect()]
    if not names:
        raise FileNotFoundError(f"no file under {root} has the columns {', '.join(columns)}")
    return spark.read.parquet(*names).select(*columns)


def table_structure(spark: SparkSession, root: str) -> DataFrame:
    """relative_path, file_size, file_extension, row_count, parquet_metadata of the files under root."""
    base = root.rstrip("/")
    name = F.regexp_replace(F.expr("substring(file, instr(file, base) + length(base))"), "^/+", "")
    rows = file_headers(spark, root).withColumn("base", F.lit(base.partition("://")[2] or base))
    return rows.select(name.alias("relative_path"), F.col("size").alias("file_size"), F.concat(F.lit("."), "kind").alias("file_extension"), F.col("rows").alias("row_count"), F.col("key_values").alias("parquet_metadata"))


def footprints(headers: DataFrame) -> DataFrame:
    """file, crs, geometry: rasters' bounds as WKT in degrees. Rasters of other CRSs than degrees, UTM and the two polar ones, and those without bounds, are left out."""
    rasters = headers.where("minx IS NOT NULL").select("file", "crs", "minx", "miny", "maxx", "maxy")
    degrees = rasters.where("crs = 'EPSG:4326'").select("*", *(F.col(c).alias(f"{n}{i}") for i, (x, y) in enumerate(geometry.CORNERS[:4]) for n, c in (("lon", x), ("lat", y))))
    code = F.regexp_extract("crs", r"^EPSG:(\d+)$", 1).try_cast("int")
    zone = F.when(code == 3413, "NP").when(code == 3031, "SP").when(code.between(32601, 32660), F.concat((code - 32600).cast("string"), F.lit("N"))).when(code.between(32701, 32760), F.concat((code - 32700).cast("string"), F.lit("S")))
    zoned = rasters.withColumn("zone", zone).where("zone IS NOT NULL")
    metres = reproject.to_wgs84(zoned.drop("crs"))
    columns = ["file", "crs", *reproject.CORNER_COLUMNS]
    return degrees.select(*columns).unionByName(metres.select(*columns)).select("file", "crs", reproject.wkt_degrees().alias("geometry"))


def build_index(spark: SparkSession, root: str, path: str, rows_a_file: int = 100_000, mode: str = "error") -> DataFrame:
    """One index (tile_id, super_id; zstd) of all grid files under root, in natural order of zones, coarse levels first. Files without tile_id are skipped by their footers; without super_id it is null. Returns the index as read back."""
    from terrapane.functions.tileid import expand_ids

    headers = file_headers(spark, root).where(has_columns("tile_id")).select("file", has_columns("super_id").alias("full")).collect()
    parts = []
    for full in (True, False):
        if names := [r.file for r in headers if r.full == full]:
            held = spark.read.parquet(*names)
            parts.append(held.select(F.col("tile_id").cast("string"), (F.col("super_id") if full else F.lit(None)).cast("string").alias("super_id")))
    if not parts:
        raise FileNotFoundError(f"no grid files under {root}")
    rows = expand_ids(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))
    number, south = zone_order(F.col("zone"))
    ordered = rows.select("tile_id", "super_id", number.alias("z"), south.alias("h"), (-F.col("level")).alias("v")).orderBy("z", "h", "v", "tile_id")
    ordered.select("tile_id", "super_id").write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", rows_a_file).parquet(path)
    return spark.read.parquet(path)
