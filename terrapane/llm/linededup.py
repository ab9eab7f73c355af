"""Lines that many documents share stay in one of them, by levelled sorted runs of line hashes; DataFrame operations only.

A line's key is the line without ASCII spaces at its ends and with A-Z in lower case. Keys of at least LEAST_CHARS code
points that at least LEAST_DOCS documents hold lose all their lines, except in the document of the largest doc_id that
holds them. A key is stored as 128 bits of its hash.

The hashes are kept as a log-structured store (`LineRuns`). A batch of documents is aggregated to one row a key and
merge-joined with the runs: keys that no run holds (the anti-join) enter the batch's own run as first seen, the others as
repeats with the count that this batch adds. Runs are sorted and cut into the same buckets, so that no join or merge
ever shuffles a run again. FANOUT runs of a level are merged to one of the next, so a key is rewritten once a level, and
a batch meets few levels however many batches came before it. What is shuffled of a batch is its hashes, once.

Then the store gives the common keys, their hits in each document drop the lines, and texts are joined with their hits.

Defined results: null and empty texts are one empty line; each row is a document of its own, so rows of an equal doc_id
count each, and a line stays in all rows of the largest doc_id; a null doc_id is below all others; all lines of a key in
the document that keeps it stay; other columns are kept by `drop_repeated_lines`, whatever their names; no rows in, no
rows out.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapane.llm.common import ascii_lower, carried, join_where_held, let, materialize, release, scratch_dir, text_of

LEAST_CHARS = 40
LEAST_DOCS = 5
BATCHES = 4  # that a table given at once is dealt into
FANOUT = 3  # runs of a level that are merged to one of the next
SPACE_CHARS = " \t\n\x0b\f\r"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE_CHARS)))


def halves(key: Column) -> tuple[Column, Column]:
    """128 bits of a key, as two longs."""
    return F.xxhash64(key), F.xxhash64(F.lit(1), key)


def line_hashes(docs: DataFrame, batches: int = BATCHES, doc_id: str = "doc_id") -> DataFrame:
    """batch, h1, h2, doc_id: a row for each document and long key that it holds."""
    long = F.filter(lines_of(text_of()), lambda x: F.octet_length(x) >= LEAST_CHARS)  # most lines fall here, unread
    keys = F.array_distinct(F.filter(F.transform(long, line_key), lambda k: F.length(k) >= LEAST_CHARS))
    batch = F.pmod(F.xxhash64(doc_id), F.lit(batches)).cast("int")
    rows = docs.select(F.col(doc_id).alias("doc_id"), batch.alias("batch"), F.explode(keys).alias("line"))
    h1, h2 = halves(F.col("line"))
    return rows.select("batch", h1.alias("h1"), h2.alias("h2"), "doc_id")


class LineRuns:
    """A store of line hashes: levels of sorted runs (h1, h2, n documents, last doc_id, repeat: did an earlier run hold the key).

    A level is a bucketed table; its runs are the files that each append adds to every bucket. All levels have the same
    buckets, so joins with them, unions of them and merges are without exchange.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list] = []  # of each level: table name, path, number of runs; None while it is empty

    def _append(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append(None)
        if self.levels[level] is None:
            name = f"line_runs_{uuid.uuid4().hex}"
            self.levels[level] = [name, f"{scratch_dir(self.spark)}/{name}", 0]
        name, path, _ = self.levels[level]
        run.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).mode("append").saveAsTable(name)
        self.levels[level][2] += 1

    def _tables(self) -> list[DataFrame]:
        return [self.spark.table(level[0]) for level in self.levels if level]

    def _compact(self, level: int, to: int) -> None:
        """Merge the runs of a level to one run of the level `to`."""
        self._append(_merged(self.spark.table(self.levels[level][0])), to)
        self._drop(level)

    def _drop(self, level: int) -> None:
        name, path, _ = self.levels[level]
        self.levels[level] = None
        self.spark.sql(f"DROP TABLE {name}")
        release(self.spark, [path])

    def add(self, hashes: DataFrame) -> None:
        """hashes (h1, h2, doc_id), one row a document and key: the batch's keys are merged against the runs and become a run; full levels are compacted."""
        batch = hashes.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
        seen = []
        for i, runs in enumerate(self._tables()):
            first = runs.where("NOT repeat").select("h1", "h2", F.lit(True).alias(f"in{i}"))  # once in all runs, so no row is multiplied
            batch = batch.join(first.hint("merge"), ["h1", "h2"], "left")
            seen.append(F.col(f"in{i}").isNotNull())
        held = reduce(lambda a, b: a | b, seen, F.lit(False))
        self._append(batch.select("h1", "h2", "n", "last", held.alias("repeat")), 0)
        level = 0
        while self.levels[level] and self.levels[level][2] >= self.fanout:
            self._compact(level, level + 1)
            level += 1

    def common(self, least: int) -> DataFrame:
        """h1, h2, last of the keys in at least so many documents. The runs of all levels are merged for it, in one table: a union of bucketed tables would do, but Spark 4.1 deals it out wrongly."""
        while len(held := [i for i, level in enumerate(self.levels) if level]) > 1:
            self._compact(held[0], held[1])
        if not held:
            return self.spark.createDataFrame([], "h1 long, h2 long, last long")
        found = _merged(self._tables()[0]).where(F.col("n") >= least).select("h1", "h2", "last")
        return materialize(found, "common_lines")

    def close(self) -> None:
        for level in range(len(self.levels)):
            if self.levels[level]:
                self._drop(level)


def _merged(runs: DataFrame) -> DataFrame:
    return runs.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.min("repeat").alias("repeat"))


def dropped_lines(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, least: int = LEAST_DOCS, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, h1s, h2s: the hashes of the lines that each document loses; documents that lose none are left out."""
    spark = docs.sparkSession
    path = f"{scratch_dir(spark)}/line_hashes-{uuid.uuid4().hex}"
    hashes = line_hashes(docs, batches, doc_id)
    hashes.write.partitionBy("batch").parquet(path)
    hashes = spark.read.schema(hashes.schema).parquet(path)
    runs = LineRuns(spark, fanout)
    for i in range(batches):
        runs.add(hashes.where(F.col("batch") == i))  # one folder of the table
    common = runs.common(least)
    runs.close()
    hits = hashes.join(common, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("last")))
    hits = hits.groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("lost"))  # at most the document's lines
    hits = materialize(hits.select("doc_id", F.col("lost.h1").alias("h1s"), F.col("lost.h2").alias("h2s")), "lost_lines")
    release(spark, [path])
    return hits


def with_kept_lines(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, least: int = LEAST_DOCS, doc_id: str = "doc_id") -> DataFrame:
    """docs' rows as a struct row, with id, n_lines, n_dropped and kept_text. Only texts that may lose a line are shuffled to meet their hits."""
    lost = dropped_lines(docs, batches, fanout, least, doc_id)
    rows = carried(docs.withColumn("text", F.col("text")), F.col(doc_id).alias("id"))
    rows = join_where_held(rows, lost.withColumnRenamed("doc_id", "id"), "id", most_broadcast=0)  # a row of lost may be long
    hit = lambda key: let(F.struct(*(h.alias(n) for n, h in zip(("a", "b"), halves(key), strict=True))), lambda h: F.array_contains("h1s", h["a"]) & F.array_contains("h2s", h["b"]))
    loses = lambda line: F.when(F.octet_length(line) < LEAST_CHARS, F.lit(False)).otherwise(let(line_key(line), lambda k: (F.length(k) >= LEAST_CHARS) & hit(k)))
    lines = lines_of(text_of("row.text"))
    kept = F.when(F.col("h1s").isNull(), lines).otherwise(F.filter(lines, lambda x: ~loses(x)))
    rows = rows.select("row", "id", F.size(lines).cast("long").alias("n_lines"), kept.alias("kept"))
    return rows.select("row", "id", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("kept_text"))


def drop_repeated_lines(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, least: int = LEAST_DOCS) -> DataFrame:
    """docs with all their columns, without the lines that go; texts that lose none stay as they are, null included."""
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("row.text"))
    rows = with_kept_lines(docs, batches, fanout, least)
    return rows.withColumn("row", F.col("row").withField("text", text)).select("row.*")


def line_digest(kept: DataFrame) -> DataFrame:
    """What the query op11 returns."""
    return kept.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
