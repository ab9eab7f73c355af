"""Class-balanced subsets of tiles: progressive targets, and a selection in phases, with hashed (repeatable) randomness.

Tiles are (tile_id, lc_* shares, entropy). A subset takes 90 % of its size here (the rest is left for manual picks):
what smaller subsets hold, then 40 % by dominant class, 10 % by entropy from a pool, and the rest batch by batch, each
time the batch of a pool that brings the mix nearest to the target. The driver only sees counts, sums and batch numbers.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapane.dims import BIAS, CODES, THRESHOLDS, WEIGHTS
from terrapane.functions.proportions import column_name
from terrapane.scratch import StepLog, scratch_base, written

CLASSES = [column_name(c) for c in CODES]
KEPT_SHARE, PHASE1, PHASE2 = 0.9, 0.4, 0.1
TOP = 10_000  # rows that one task may order
PREFIX = 4  # hexadecimal digits of a hash's prefix
PREFIXES = 16**PREFIX
SHARE_BITS = 20


def progressive_target(base: list[float], bias: float, weights=WEIGHTS, ceiling: list[float] | None = None, most_bias: float = max(BIAS.values())) -> list[float]:
    """Shares between the base mix and the weighted one, by bias; no class above its ceiling (the base mix, unless given); adds up to 1."""
    mu = (bias - 1) / (most_bias - 1)
    ceiling = ceiling or [min(b, 1.0) for b in base]
    raw = [min((1 - mu) * b + mu * w * b, c) for b, w, c in zip(base, weights, ceiling, strict=True)]
    return [x / sum(raw) for x in raw]


def hashed(seed: int, key: str = "tile_id") -> Column:
    """An order that looks random and is the same in every run."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))


def sample_rows(df: DataFrame, n: int, seed: int, key: str = "tile_id") -> DataFrame:
    """n rows, or all of fewer: those of the smallest hashes.

    Beyond TOP rows the cut is found from counts per hash prefix (PREFIXES at most), so that no task sorts the sample:
    rows of smaller prefixes are in, and only those of the prefix at the cut are ordered.
    """
    if n <= TOP:
        return df.orderBy(hashed(seed, key), key).limit(n)
    prefix = F.substring(hashed(seed, key), 1, PREFIX)
    left = n
    for r in df.groupBy(prefix.alias("prefix")).count().orderBy("prefix").collect():
        if r["count"] >= left:
            edge = df.where(prefix == r["prefix"]).orderBy(hashed(seed, key), key).limit(left)
            return df.where(prefix < r["prefix"]).unionByName(edge)
        left -= r["count"]
    return df


def sample_share(df: DataFrame, per_mille: int, seed: int, key: str = "tile_id") -> DataFrame:
    """About per_mille of a thousand rows: those whose hash begins, as a number of SHARE_BITS bits, below that share."""
    digits = -(-SHARE_BITS // 4)
    number = F.shiftright(F.conv(F.substring(hashed(seed, key), 1, digits), 16, 10).cast("long"), 4 * digits - SHARE_BITS)
    return df.where(number * 1000 < per_mille * (1 << SHARE_BITS))


def top_per_class(tiles: DataFrame, need: dict[str, int], thresholds=THRESHOLDS) -> DataFrame:
    """tile_id, class, place: for each class the tiles above its threshold with the greatest share; a tile that leads in two classes counts for its first."""
    long = tiles.select("tile_id", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(c).alias("class"), F.col(c).alias("share"), F.lit(t).alias("least"), F.lit(need.get(c, 0)).alias("need")) for i, (c, t) in enumerate(zip(CLASSES, thresholds, strict=True))))).alias("x")).select("tile_id", "x.*")
    above = long.where((F.col("share") >= F.col("least")) & (F.col("need") > 0))
    # the bound is a literal, so that each task sends on no more rows of a class than the greatest need
    ranked = above.withColumn("place", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("share"), "tile_id"))).where(F.col("place") <= max([*need.values(), 0]))
    ranked = ranked.where("place <= need")
    first = F.row_number().over(Window.partitionBy("tile_id").orderBy("i"))
    return ranked.withColumn("first", first).where("first = 1").select("tile_id", "class", "place")


def phase_one(tiles: DataFrame, n: int, target: list[float], seed: int) -> DataFrame:
    """tile_id: the dominant tiles of each class, filled up at random with tiles that have a class of half at least."""
    picked = top_per_class(tiles, {c: int(n * t) for c, t in zip(CLASSES, target, strict=True)}).select("tile_id")
    short = n - picked.count()
    if short <= 0:
        return picked
    rest = tiles.where(F.greatest(*CLASSES) >= 0.5).join(picked, "tile_id", "left_anti")
    return picked.unionByName(sample_rows(rest, short, seed).select("tile_id"))


def phase_two(tiles: DataFrame, n: int, seed: int) -> DataFrame:
    """tile_id: the most mixed of a pool of 6 n."""
    return sample_rows(tiles, 6 * n, seed).orderBy(F.desc("entropy"), "tile_id").limit(n).select("tile_id")


def batches(tiles: DataFrame, batch: int, seed: int) -> DataFrame:
    """tiles in hashed order, cut to batches of so many: adds batch. Places come from counts per hash prefix and the order within a prefix, not from one sort of all."""
    rows = tiles.withColumn("hash", hashed(seed)).withColumn("prefix", F.substring("hash", 1, PREFIX))
    counts = rows.groupBy("prefix").count()
    before = counts.select("prefix", (F.sum("count").over(Window.orderBy("prefix")) - F.col("count")).alias("before"))  # PREFIXES rows at most
    within = F.row_number().over(Window.partitionBy("prefix").orderBy("hash", "tile_id")) - 1
    placed = rows.withColumn("within", within).join(F.broadcast(before), "prefix")
    return placed.withColumn("batch", F.floor((F.col("before") + F.col("within")) / batch).cast("long")).drop("hash", "prefix", "within", "before")


def phase_three(tiles: DataFrame, n: int, target: list[float], sums: list[float], count: int, batch: int, pool: int, seed: int) -> DataFrame:
    """tile_id: batch by batch, the batch of a random pool that brings the running mix nearest to the target.

    All tiles get one hashed order; a batch is the next so many of it and a pool the next so many batches. The batches'
    sums are written once and streamed to the driver in order, a partition at a time; it takes up to a quarter of each
    pool before it goes on, and starts over with what is left. What the driver keeps is the numbers of taken batches.
    """
    numbered = written(batches(tiles, batch, seed), "batches")
    mixes = numbered.groupBy("batch").agg(F.count(F.lit(1)).alias("size"), *(F.sum(c).alias(c) for c in CLASSES))
    mixes = written(mixes.repartitionByRange("batch").sortWithinPartitions("batch"), "mixes").orderBy("batch")
    width, most, taken = max(1, pool // batch), min(batch, n), {}  # taken: batch to how many of its tiles

    def quarter(of: list) -> None:
        nonlocal n, sums, count
        for _ in range(max(1, len(of) // 4)):
            if n <= 0:
                return
            best = min((m for m in of if m["batch"] not in taken), key=lambda m: (sum(((s + m[c]) / (count + m["size"]) - t) ** 2 for c, s, t in zip(CLASSES, sums, target, strict=True)), m["batch"]))
            taken[best["batch"]] = min(best["size"], n)
            n -= taken[best["batch"]]
            sums, count = [s + best[c] for s, c in zip(sums, CLASSES, strict=True)], count + best["size"]

    while n > 0:
        held, seen = [], len(taken)
        for m in mixes.toLocalIterator():
            if m["size"] >= most and m["batch"] not in taken:
                held.append(m)
            if len(held) == width:
                quarter(held)
                held = []
            if n <= 0:
                break
        if held and n > 0:
            quarter(held)
        if len(taken) == seen:
            break
    spark = tiles.sparkSession
    chosen = spark.createDataFrame(list(taken.items()), "batch bigint, most bigint")
    place = F.row_number().over(Window.partitionBy("batch").orderBy("tile_id"))
    return numbered.join(chosen, "batch").withColumn("place", place).where("place <= most").select("tile_id")


def select_subsets(tiles: DataFrame, targets: dict[str, list[float]], sizes: dict[str, int], batch: int = 25, pool: int = 2500, seed: int = 42, log: str | None = None) -> DataFrame:
    """tile_id, subset, phase for every pick; a subset also holds, as reuse, what smaller ones took. Subsets already filled to 90 % by reuse take nothing new.

    Each step's picks are a table under log (a new scratch folder, if none is given), complete or not there. A run over
    the log of one that was killed reads what is complete and goes on; it has the same picks as one that ran through.
    """
    picks, spark = None, tiles.sparkSession
    steps = StepLog(spark, log or f"{scratch_base(spark)}/selection-{uuid.uuid4().hex}", repr((sorted(targets.items()), sorted(sizes.items()), batch, pool, seed)))
    for i, (label, size) in enumerate(sorted(sizes.items(), key=lambda x: x[1])):
        reused = picks.select("tile_id").distinct() if picks is not None else spark.createDataFrame([], "tile_id string")
        quota = int(size * KEPT_SHARE) - reused.count()
        parts = [reused.select("tile_id", F.lit("reuse").alias("phase"))]
        if quota > 0:
            free = tiles.join(reused, "tile_id", "left_anti")
            p1, p2 = int(quota * PHASE1), int(quota * PHASE2)
            one = steps.step(f"{label}-phase1", lambda: phase_one(free, p1, targets[label], seed + 10 * i))  # noqa: B023
            free = free.join(one, "tile_id", "left_anti")
            two = steps.step(f"{label}-phase2", lambda: phase_two(free, p2, seed + 10 * i + 1))  # noqa: B023
            free = free.join(two, "tile_id", "left_anti")
            held = tiles.join(reused.unionByName(one).unionByName(two), "tile_id", "left_semi").agg(F.count(F.lit(1)), *(F.sum(c) for c in CLASSES)).first()
            sums = [x or 0.0 for x in held[1:]]
            three = steps.step(f"{label}-phase3", lambda: phase_three(free, quota - p1 - p2, targets[label], sums, held[0], batch, pool, seed + 100 * (i + 1)))  # noqa: B023
            parts += [d.select("tile_id", F.lit(f"phase{k}").alias("phase")) for k, d in ((1, one), (2, two), (3, three))]
        new = reduce(DataFrame.unionByName, parts).select("tile_id", F.lit(label).alias("subset"), "phase")
        picks = steps.step(f"{label}-picks", lambda: new if picks is None else picks.unionByName(new))  # noqa: B023
    return picks


def propagate_up(df: DataFrame, columns: list[str], none: str = "none") -> DataFrame:
    """Each column, where it says none, takes the first of the smaller subsets' labels that does not."""
    for i, c in enumerate(columns[1:], 1):
        lower = F.coalesce(*(F.nullif(F.col(x), F.lit(none)) for x in columns[:i]))
        df = df.withColumn(c, F.when(F.col(c) == none, F.coalesce(lower, F.lit(none))).otherwise(F.col(c)))
    return df


def downsample_class(tiles: DataFrame, column: str, above: float, per_mille: int, most: int, seed: int = 42) -> DataFrame:
    """All tiles whose share of a class is not above the bound, and of the rest a hashed sample: per_mille of them, most at all."""
    held = tiles.where(~(F.col(column) > above))
    return held.unionByName(sample_rows(sample_share(tiles.where(F.col(column) > above), per_mille, seed), most, seed))
