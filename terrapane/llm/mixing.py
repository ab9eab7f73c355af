"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Document rates stay as near to 1 as the token constraints allow: they minimise the sum of base * (rate * log(rate) -
rate + 1) over the documents, with rates from 0 to MOST_COPIES, subject to sum(rate * size) = target for each source. A
document's base weight is its size ** (1 - tilt). The dual is convex, with one multiplier a source, and its optimum is
an exponential tilt of each document, rate = min(MOST_COPIES, exp(lambda[source] * size ** tilt)). With a tilt of 1
documents count alike and the longest give way, or are repeated, first; with 0 all words count alike and a source has
one rate; TILT lies between.

The dual is solved by Newton rounds, all sources side by side. A round sums rate * size and its derivative over the
documents of each source; as documents of one source and size share their rate, these sums run over the counts of each
(source, size), which are added up once before the shuffle. A step that would leave the multiplier's bracket halves it
instead. Sums are of decimals, so that they do not hang on the order of rows.

Rates become copies by error diffusion: a source is dealt by hash into blocks of about BLOCK documents, and within a
block, largest documents first, each document takes the whole number of copies nearest to its rate plus what the block
still owes. A copy that the smaller documents still to come could not balance is not taken. So a block ends within about
half of one of its smaller documents of its target.

Defined results: null or empty text has size 0, is taken 0 times and counts for nothing; null source is a source of its
own, ranked last; rows of an equal doc_id are mixed each on its own, also with a null one, and rows that are equal in
doc_id, source and text share out their copies as evenly as can be; if all sizes are 0, all targets are 0; other columns
are ignored by `mix` and kept by `mixed_documents`, whatever their names; no rows in, no rows out. The same rows give the
same copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapane.llm.common import WORD, carried, join_small, join_where_held, materialize, row_key, text_of

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
BLOCK = 512
TILT = 0.5
CLOSE = 1e-9  # of a target, where Newton's rounds end
MOST_ROUNDS = 100  # halving alone would end them


def source_ranks(sizes: DataFrame) -> DataFrame:
    """source, source_size, rows, rank from 0 by code point with null last. Ranks come from range partitions and their counts, not from one task."""
    found = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    keyed = found.withColumn("last", F.col("source").isNull())
    parts = materialize(keyed.repartitionByRange("last", "source").withColumn("part", F.spark_partition_id()), "sources")
    counts = parts.groupBy("part").count()
    before = counts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))  # one row a partition
    place = F.row_number().over(Window.partitionBy("part").orderBy("last", "source")) - 1
    return parts.withColumn("place", place).join(F.broadcast(before), "part").select("source", "source_size", "source_rows", (F.col("before") + F.col("place")).alias("rank"))


def targets(ranks: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Adds weight and target: shares of all sizes by weight; a target above most times its source's size stops there, and the excess is shared anew by weight until none is above."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = materialize(ranks.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * most), "ranks")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while True:  # each round stops at least one more source; a few sums over the sources each
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        n, held, free = rows.agg(F.count_if(full), F.sum(F.when(full, F.col("cap")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if n == stopped or not free:
            break
        stopped, level = n, (total - held) / free
    target = F.when(F.col("cap") <= F.col("weight") * F.lit(level), F.col("cap").cast("double")).otherwise(F.col("weight") * F.lit(level))
    return rows.withColumn("target", target).drop("cap")


def sizes_of(docs: DataFrame, *keep: str) -> DataFrame:
    """keep, doc_id, source, size, key: equal for rows that are equal in doc_id, source and text."""
    size = F.regexp_count(text_of(), F.lit(WORD)).cast("long")
    return docs.select(*keep, "doc_id", "source", size.alias("size"), row_key("doc_id", "source", "text").alias("key"))


def rate_of(size: Column, lam: Column, most: int, tilt: float) -> Column:
    return F.least(F.lit(float(most)), F.exp(lam * F.pow(size.cast("double"), F.lit(tilt))))


def balance(sizes: DataFrame, solved: DataFrame, most: int = MOST_COPIES, tilt: float = TILT) -> DataFrame:
    """solved (source, target and more, a written table) with lam, the multiplier at the dual's minimum; null where every rate is 0 or most."""
    counts = sizes.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "counts").withColumnRenamed("source", "of")
    x = F.pow(F.col("size").cast("double"), F.lit(tilt))
    ends = counts.groupBy("of").agg(F.min(x).alias("least_x"), F.max(x).alias("most_x"))
    ratio = F.log(F.col("target") / F.col("source_size"))
    # a multiplier at which every rate is too small, and one at which none is
    low, high = F.least(ratio / F.col("least_x"), ratio / F.col("most_x")), F.when(ratio > 0, F.log(F.lit(float(most))) / F.col("least_x")).otherwise(ratio / F.col("most_x"))
    state = join_small(solved.where((F.col("target") > 0) & (F.col("target") < most * F.col("source_size") * (1 - CLOSE))), ends, F.col("source").eqNullSafe(F.col("of")), "inner")
    state = materialize(state.select("source", "target", low.alias("low"), high.alias("high"), F.lit(0.0).alias("lam"), F.lit(False).alias("done")).withColumn("lam", F.greatest("low", F.least("high", "lam"))), "duals")
    small = F.broadcast if state.count() <= 200_000 else lambda df: df
    for _ in range(MOST_ROUNDS):
        if state.where("NOT done").limit(1).count() == 0:
            break
        rate = rate_of(F.col("size"), F.col("lam"), most, tilt)
        words = F.col("n") * F.col("size") * rate
        exact = lambda c: F.sum(c.cast("decimal(36,9)")).cast("double")
        open_ = state.where("NOT done").select(F.col("source").alias("of_state"), "lam")
        rows = counts.join(small(open_), F.col("of").eqNullSafe(F.col("of_state")))
        sums = rows.groupBy("of").agg(exact(words).alias("words"), exact(F.when(rate < most, words * x).otherwise(F.lit(0.0))).alias("slope"))
        both = state.join(sums, F.col("source").eqNullSafe(F.col("of")), "left")
        too_much = F.col("words") > F.col("target")
        low, high = F.when(too_much, F.col("low")).otherwise(F.col("lam")), F.when(too_much, F.col("lam")).otherwise(F.col("high"))
        near = F.abs(F.col("words") - F.col("target")) <= CLOSE * F.col("target")
        # Newton's step for the logarithm of the sum, which is nearly straight
        step = F.col("lam") - (F.log("words") - F.log("target")) * F.col("words") / F.col("slope")
        inside = (F.col("slope") > 0) & (step > low) & (step < high)
        done = F.col("done") | near
        lam = F.when(done, F.col("lam")).when(inside, step).otherwise((low + high) / 2)
        keep = lambda c, new: F.when(F.col("done"), F.col(c)).otherwise(new).alias(c)
        state = materialize(both.select("source", "target", keep("low", low), keep("high", high), keep("lam", lam), done.alias("done")), "duals")
    found = state.select(F.col("source").alias("of"), "lam")
    return join_small(solved, found, F.col("source").eqNullSafe(F.col("of"))).drop("of")


def dealt(sizes: DataFrame, weights: tuple[int, ...], most: int, tilt: float) -> DataFrame:
    """doc_id, source, size, key, source_size, target, rate, rows (of this key) and copies (of all of them)."""
    solved = materialize(targets(source_ranks(sizes), weights, most), "targets")
    solved = materialize(balance(sizes, solved, most, tilt), "rates").withColumnRenamed("source", "of")
    kinds = sizes.groupBy("doc_id", "source", "size", "key").agg(F.count(F.lit(1)).alias("rows"))
    rated = join_small(kinds, solved, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    full = F.when(F.col("target") > 0, F.lit(float(most))).otherwise(F.lit(0.0))
    rate = F.when(F.col("size") == 0, F.lit(0.0)).when(F.col("lam").isNull(), full).otherwise(rate_of(F.col("size"), F.col("lam"), most, tilt))
    rated = rated.withColumn("rate", rate).withColumn("block", F.pmod("key", F.ceil(F.col("source_rows") / BLOCK)))
    doc = F.struct((-F.col("size")).alias("order"), F.xxhash64("key", F.lit(5)).alias("tie"), "key", "doc_id", "size", "rate", "rows")
    keys = ("source", "source_size", "target")
    blocks = rated.groupBy(*keys, "block").agg(F.sort_array(F.collect_list(doc)).alias("docs"))

    def step(state: Column, d: Column) -> Column:
        size, due = d["size"], d["rate"] * d["size"] * d["rows"]
        later, room = state["later"] - due, state["room"] - (most * d["size"] * d["rows"] - due)
        owed = state["owed"] + due
        near = F.when(size > 0, F.greatest(F.lit(0), F.least(most * d["rows"], F.round(owed / size)))).otherwise(F.lit(0)).cast("long")
        # what is taken too much must be due to the smaller documents still to come; else one copy less, if they can make up for it
        too_much = (near > 0) & (owed - near * size < -later) & (owed - (near - 1) * size <= room)
        copies = near - too_much.cast("long")
        return F.struct((owed - copies * size).alias("owed"), later.alias("later"), room.alias("room"), F.concat(state["copies"], F.array(copies)).alias("copies"))

    def total(of) -> Column:
        return F.aggregate("docs", F.lit(0.0), lambda s, d: s + of(d))

    due = lambda d: d["rate"] * d["size"] * d["rows"]
    start = F.struct(F.lit(0.0).alias("owed"), F.col("later").alias("later"), F.col("room").alias("room"), F.array().cast("array<bigint>").alias("copies"))
    blocks = blocks.withColumn("later", total(due)).withColumn("room", total(lambda d: most * d["size"] * d["rows"] - due(d)))
    each = blocks.withColumn("copies", F.aggregate("docs", start, step, lambda s: s["copies"])).select(*keys, F.explode(F.arrays_zip("docs", "copies")).alias("x"))
    return each.select("x.docs.doc_id", "source", "x.docs.size", "x.docs.key", "source_size", "target", "x.docs.rate", "x.docs.rows", "x.copies")


def share_of(place: Column) -> Column:
    """The copies of one of the rows that share theirs: what remains goes to the first."""
    return F.expr("copies div rows") + (place < F.col("copies") % F.col("rows")).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, tilt: float = TILT) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies."""
    each = dealt(materialize(sizes_of(docs), "sizes"), weights, most, tilt).withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    return each.select("doc_id", "source", "size", "source_size", "target", "rate", share_of(F.col("place")).alias("copies"))


def places(rows: DataFrame) -> DataFrame:
    """id, place: the number of each row among those of its key. Counted in two steps, within and over the parts of the written table (the high bits of its ids), so that a key of many rows meets in no task."""
    rows = rows.withColumn("part", F.shiftright("id", 33))
    within = F.row_number().over(Window.partitionBy("key", "part").orderBy("id")) - 1
    counts = materialize(rows.groupBy("key", "part").count(), "parts")
    before = counts.select("key", "part", (F.sum("count").over(Window.partitionBy("key").orderBy("part")) - F.col("count")).alias("before"))
    return rows.withColumn("within", within).join(before, ["key", "part"]).select("id", (F.col("before") + F.col("within")).alias("place"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, tilt: float = TILT) -> DataFrame:
    """docs as the mix takes them: each row as often as its copies say. Copies go with what a row says; rows taken once go by without a join, and only rows that are said again are written, to be numbered."""
    sizes = materialize(sizes_of(docs), "sizes")
    other = materialize(dealt(sizes, weights, most, tilt).where("rows <> 1 OR copies <> 1").select("key", "rows", "copies"), "copies")
    rows = carried(docs, row_key("doc_id", "source", "text").alias("key"))
    joined = join_where_held(rows, other, "key")
    picked = joined.where("rows IS NULL OR rows = 1 AND copies > 0").select("row", F.coalesce("copies", F.lit(1).cast("long")).alias("copies"))
    shared = other.where("rows > 1")
    if shared.limit(1).count():
        again = materialize(joined.where("rows > 1 AND copies > 0").withColumn("id", F.monotonically_increasing_id()), "again")
        numbered = again.join(places(again.select("id", "key")), "id")
        picked = picked.unionByName(numbered.select("row", share_of(F.col("place")).alias("copies")).where("copies > 0"))
    return picked.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def mix_digest(mixed: DataFrame) -> DataFrame:
    """What the query op9 returns."""
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
