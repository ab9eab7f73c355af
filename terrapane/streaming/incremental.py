"""Incremental runs: each new file of a folder is read once, projected, and appended; a checkpoint remembers what is done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_new_files(spark: SparkSession, source: str, schema, out: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] = lambda df: df, glob: str | None = None, files_a_batch: int = 64) -> None:
    """Append change(rows) of the files under source that no earlier run has read; then stop."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    query = change(reader.parquet(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


FANOUT = 4  # runs of a level that are merged to one of the next


def _latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by order; of equal ones, that of the greatest hash."""
    rest = [c for c in rows.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct(F.col(order), F.xxhash64(*rest)))
    return rows.groupBy(key).agg(last.alias("row")).select(key, "row.*")


def _runs(spark: SparkSession, out: str) -> list[str]:
    """The runs under out that are written to the end."""
    where = spark._jvm.org.apache.hadoop.fs.Path(out)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    names = [f.getPath() for f in files.listStatus(where) if f.isDirectory()]
    return sorted(p.toString() for p in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def latest_by_key(spark: SparkSession, source: str, schema, key: str, order: str, out: str, checkpoint: str, fanout: int = FANOUT, files_a_batch: int = 64) -> None:
    """Keep, over runs of this function, the last row of each key of a folder that grows; read it with read_latest.

    The table is levelled: batch number b writes its own last rows as run L0-b, and whenever fanout runs of a level are
    full they are merged to one of the next, so a row is rewritten once a level and the work of a batch follows the
    batch, not the table. What is merged is told by the batch's number alone, so a batch that is done again after a loss
    writes the same runs again. Merged runs are deleted after the merge is complete; that one is read together with
    them in between changes nothing, as the last of rows is the last of parts' lasts.
    """

    def add(batch: DataFrame, number: int) -> None:
        _latest(batch, key, order).write.mode("overwrite").parquet(f"{out}/L0-{number}")
        level, index = 0, number
        while index % fanout == fanout - 1:
            parts = [f"{out}/L{level}-{i}" for i in range(index - fanout + 1, index + 1)]
            held = [p for p in _runs(spark, out) if p.rpartition("/")[2] in {x.rpartition("/")[2] for x in parts}]
            level, index = level + 1, index // fanout
            if len(held) == fanout:  # else an earlier attempt has merged them
                _latest(spark.read.schema(batch.schema).parquet(*held), key, order).write.mode("overwrite").parquet(f"{out}/L{level}-{index}")
            for p in held:
                path = spark._jvm.org.apache.hadoop.fs.Path(p)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch)
    reader.parquet(source).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_latest(spark: SparkSession, schema, key: str, order: str, out: str) -> DataFrame:
    """The last row of each key, over all runs: a few for each level."""
    runs = _runs(spark, out)
    return _latest(spark.read.schema(schema).parquet(*runs) if runs else spark.createDataFrame([], schema), key, order)
