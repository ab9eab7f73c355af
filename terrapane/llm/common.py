"""What the text operators share: word rules, scratch tables, and small column helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space and the five ASCII control spaces.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the session (spark.checkpoint.dir). Only a session without one, as in local tests, gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    own = getattr(spark.sparkContext, "_terrapane_scratch", None)
    if own is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = spark.sparkContext._terrapane_scratch = tempfile.mkdtemp(prefix="spark-scratch-")
    return own


_paths: ContextVar[list[str] | None] = ContextVar("paths", default=None)  # of the run at hand, if one records them


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of the tables written within, by this run alone."""
    token = _paths.set([])
    try:
        yield _paths.get()
    finally:
        _paths.reset(token)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a step's rows to the shared folder and read them back: cuts lineage, survives lost executors, and gives Spark the true size."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (paths := _paths.get()) is not None:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables, for callers whose results no longer need them."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def carried(docs: DataFrame, *others: Column | str) -> DataFrame:
    """All columns of docs in one struct, row, so that none clashes with those that an operator adds; the operator ends with select("row.*")."""
    return docs.select(F.struct("*").alias("row"), *others)


def row_key(*columns: str) -> Column:
    """64 bits of what a row says in these columns; null differs from all values."""
    return F.xxhash64(*(x for c in columns for x in (F.col(c).isNull(), F.col(c))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute value once and use it many times in body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def join_small(df: DataFrame, small: DataFrame, on, how: str = "left", most_rows: int = 200_000) -> DataFrame:
    """Join a materialized table: broadcast below most_rows (counted), a shuffled join that AQE may split beyond it."""
    return df.join(F.broadcast(small) if small.count() <= most_rows else small, on, how)


def ascii_lower(text: Column) -> Column:
    """text with A-Z alone in lower case; texts of ASCII alone go the fast way."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


#: Bits of a set of keys on the map side: 32 for each key, to at most 2**28, which are 32 MB.
FEWEST_BITS, MOST_BITS, BITS_A_KEY, BLOCK_BITS = 15, 28, 32, 15


def maybe_among(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """rows with maybe: false where the 64-bit hash of the column key is surely not that of a row of keys (a written table with a column of the same name), else true. A bitmap with one bit a key is cut into blocks of 4 KB and broadcast; its size is bounded, and when there are more keys than it tells apart, more rows are maybes."""
    bits = max(FEWEST_BITS, min(MOST_BITS, (BITS_A_KEY * max(1, keys.count()) - 1).bit_length()))
    at = lambda: F.xxhash64(key).bitwiseAND(F.lit((1 << bits) - 1))
    ones = keys.select(at().alias("bit")).groupBy(F.shiftright("bit", BLOCK_BITS).alias("bit_block"))
    blocks = ones.agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))).alias("bit_map"))
    rows = rows.select("*", at().alias("bit")).withColumn("bit_block", F.shiftright("bit", BLOCK_BITS))
    rows = rows.join(F.broadcast(blocks), "bit_block", "left")
    place = F.col("bit").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")
    byte = F.conv(F.hex(F.substring("bit_map", F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.shiftright(byte, 0).bitwiseAND(F.expr("shiftleft(1, CAST(bit & 7 AS INT))")) != 0
    return rows.withColumn("maybe", F.coalesce(is_set, F.lit(False))).drop("bit", "bit_block", "bit_map")


#: Rows of keys that are broadcast, with their few numbers; beyond it, a bitmap tells which rows have to be shuffled.
MOST_BROADCAST = 200_000


def join_where_held(rows: DataFrame, held: DataFrame, key: str, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """rows left-joined with held (a written table, one row a key; null keys meet) on key. Up to most_broadcast rows, held is broadcast; beyond, rows that are surely not held go by without a shuffle, and only the others are joined."""
    others = [c for c in held.columns if c != key]
    right, same = held.withColumnRenamed(key, "held_key"), F.col(key).eqNullSafe(F.col("held_key"))
    if held.count() <= most_broadcast:
        return rows.join(F.broadcast(right), same, "left").select(*rows.columns, *others)
    told = maybe_among(rows, key, held)
    free = told.where("NOT maybe").select(*rows.columns, *(F.lit(None).cast(held.schema[c].dataType).alias(c) for c in others))
    return free.unionByName(told.where("maybe").join(right, same, "left").select(*rows.columns, *others))


def without_held(rows: DataFrame, held: DataFrame, key: str, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """rows whose key is not in held (a written table; null keys meet), in the same way."""
    right, same = held.select(F.col(key).alias("held_key")), F.col(key).eqNullSafe(F.col("held_key"))
    if held.count() <= most_broadcast:
        return rows.join(F.broadcast(right), same, "left_anti")
    told = maybe_among(rows, key, held)
    met = told.where("maybe").join(right, same, "left_anti")
    return told.where("NOT maybe").select(*rows.columns).unionByName(met.select(*rows.columns))


def freeing(batches: Iterator) -> Iterator:
    """The batches that a task reads. A Python worker outlives its task and would hold what it took while others run: what Arrow's pool keeps of earlier batches goes back before the next is read, and what the C library keeps goes back at the end."""
    pool = pa.default_memory_pool()
    for batch in batches:
        yield batch
        del batch
        pool.release_unused()
    give_back()


def give_back() -> None:
    """What Arrow's pool and the C library keep of freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)
