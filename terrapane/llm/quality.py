"""Quality rules with adaptive thresholds, in DataFrame operations only.

Each document gets whole-number metrics. Their distribution per language and source is kept in mergeable quantile
sketches of the log-linear kind: values below 128 are counted each on their own, greater ones in bins that keep their
seven leading bits, so a quantile read from the sketch is at most 1/64 of itself too small, whatever the range. Counts of
bins add up over partitions and groups in any order, and a sketch has at most 128 bins and 64 for each further doubling
of the greatest value. Thresholds are fences read from the sketch (the upper one q90 + FENCE * (q90 - q50) + slack, the
lower one alike), joined back to the documents. A group's fence is shrunk towards its language's, and a language's towards
that of all documents, as if PRIOR documents had said so; a group's say grows with its documents, without a step. No
group's fence is wider than its language's, nor (but for word lengths, which go with the language) than that of all
documents, so that a source or language with much junk does not make room for it; what more than a tenth of all documents
have is not junk.

Defined results: null text has no words and fails the base rules; null language or source is a group of its own; rows of
an equal doc_id are judged each on its own; other columns are ignored by `judge` and kept by `filter_documents`, whatever
their names; no rows in, no rows out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapane.llm.common import SPACES, WORD, carried, join_small, let, materialize, row_key, text_of

LEAST_WORDS = 50
MOST_REPEAT_PERCENT = 50
FENCE = 3
PRIOR = 100  # documents that the fence above a group's own counts for
EXACT_BITS = 7  # of a value, that its bin keeps
#: metric (in thousandths, word_length in tenths): slack above the upper fence; a lower fence too?
METRICS = {"symbols": (20, False), "dup_lines": (300, False), "repeats": (300, False), "word_length": (20, True)}


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that are found twice or more in the text, the first one included."""
    n = F.size(words) - 2
    grams = F.transform(
        F.arrays_zip(F.slice(words, 1, n).alias("a"), F.slice(words, 2, n).alias("b"), F.slice(words, 3, n).alias("c")),
        lambda z, i: F.struct(F.xxhash64(z["a"], z["b"], z["c"]).alias("gram"), i.alias("at")),
    )

    def covered(s: Column) -> Column:
        same = lambda x, i, d: F.coalesce(F.get(s, i + d)["gram"] == x["gram"], F.lit(False))
        starts = F.transform(F.filter(F.transform(s, lambda x, i: F.struct(x["at"], (same(x, i, -1) | same(x, i, 1)).alias("twice"))), lambda x: x["twice"]), lambda x: x["at"])
        return let(F.sort_array(starts), lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))

    return F.when(n > 1, let(F.sort_array(grams), covered)).otherwise(F.lit(0)).cast("long")


def document_metrics(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    read = docs.select(*keep, "doc_id", "lang", "source", text_of().alias("text"))
    read = read.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    read = read.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)))
    return read.select(
        *keep,
        "doc_id",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACES, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
    )


def with_shares(metrics: DataFrame) -> DataFrame:
    """Adds base_failed and the METRICS."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))
    share = lambda a, b, times=1000: F.expr(f"{times} * {a} div greatest({b}, 1)")
    return metrics.select(
        "*",
        failed.alias("base_failed"),
        share("n_symbols", "word_chars").alias("symbols"),
        share("n_dup_lines", "n_lines").alias("dup_lines"),
        share("n_repeat_words", "n_words").alias("repeats"),
        share("word_chars", "n_words", 10).alias("word_length"),
    )


def bin_of(value: Column) -> Column:
    """The sketch's bin of a whole number from 0: its leading EXACT_BITS bits, after the number of bits left out."""
    half, out = 1 << (EXACT_BITS - 1), F.greatest(F.lit(0), F.length(F.bin(value)) - EXACT_BITS)
    return half * out + F.call_function("shiftright", value, out)


def edge_of(bin_: Column) -> Column:
    """The least value of a bin."""
    half = 1 << (EXACT_BITS - 1)
    out = F.greatest(F.lit(0), F.floor(bin_ / half) - 1).cast("int")
    return F.call_function("shiftleft", bin_ - half * out, out)


def sketches(metrics: DataFrame) -> DataFrame:
    """lang, source, metric, bin, n: one mergeable sketch for each language, source and metric, over the documents that pass the base rules."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), bin_of(F.col(m)).alias("bin")) for m in METRICS)))
    rows = metrics.where(~F.col("base_failed")).select("lang", "source", pairs.alias("x"))
    return rows.groupBy("lang", "source", F.col("x.metric").alias("metric"), F.col("x.bin").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def fences(sketch: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, n, and low_<metric>, high_<metric> from the sketches merged to these keys."""
    merged = sketch.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "metric")
    seen = merged.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("total", F.sum("n").over(group))
    q = lambda percent: F.min(F.when(100 * F.col("upto") >= percent * F.col("total"), edge_of(F.col("bin"))))
    rows = seen.groupBy(*keys, "metric").agg(F.max("total").alias("n"), q(10).alias("q10"), q(50).alias("q50"), q(90).alias("q90"))
    slack = F.element_at(F.create_map(*(F.lit(x) for m, (s, _) in METRICS.items() for x in (m, s))), F.col("metric"))
    two_sided = F.col("metric").isin(*(m for m, (_, both) in METRICS.items() if both))
    high = F.col("q90") + FENCE * (F.col("q90") - F.col("q50")) + slack
    low = F.when(two_sided, F.col("q10") - FENCE * (F.col("q50") - F.col("q10")) - slack).otherwise(F.lit(-1))
    of = lambda m, c: F.max(F.when(F.col("metric") == m, c))
    return rows.groupBy(*keys).agg(F.max("n").alias("n"), *(of(m, low).alias(f"low_{m}") for m in METRICS), *(of(m, high).alias(f"high_{m}") for m in METRICS))


def thresholds(sketch: DataFrame) -> DataFrame:
    """lang, source and their fences: the narrowest of the group's and its language's, both shrunk to what is above them, and, for one-sided metrics, all documents'."""
    names = [f"{side}_{m}" for side in ("low", "high") for m in METRICS]
    own = fences(sketch, ("lang", "source"))
    lang = fences(sketch, ("lang",)).select(F.col("lang").alias("of"), F.col("n").alias("lang_n"), *(F.col(x).alias(f"lang_{x}") for x in names))
    every = fences(sketch, ()).select(*(F.col(x).alias(f"all_{x}") for x in names))
    both = own.join(lang, F.col("lang").eqNullSafe(F.col("of")), "left").join(F.broadcast(every.limit(1)), F.lit(True), "left")

    def narrowest(side: str, m: str) -> Column:
        x, pick = f"{side}_{m}", F.greatest if side == "low" else F.least
        shrunk = lambda n, fence, above: (F.col(n) * F.col(fence) + PRIOR * above) / (F.col(n) + PRIOR)
        of_lang = shrunk("lang_n", f"lang_{x}", F.col(f"all_{x}"))
        near = pick(shrunk("n", x, of_lang), of_lang)
        return (near if METRICS[m][1] else pick(near, F.col(f"all_{x}"))).alias(x)

    return both.select("lang", "source", *(narrowest(side, m) for side in ("low", "high") for m in METRICS))


def judge(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, the metrics, base_failed, and kept: not base_failed, and every metric within its group's fences."""
    metrics = materialize(with_shares(document_metrics(docs, keep)), "metrics")
    limits = materialize(thresholds(materialize(sketches(metrics), "sketches")), "fences")
    limits = limits.withColumnRenamed("lang", "of_lang").withColumnRenamed("source", "of_source")
    joined = join_small(metrics, limits, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")))
    within = ~F.col("base_failed")
    for m in METRICS:
        within = within & F.coalesce((F.col(m) >= F.col(f"low_{m}")) & (F.col(m) <= F.col(f"high_{m}")), F.lit(True))
    return joined.withColumn("kept", within)


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns. A verdict goes with what a row says (row_key), so rows of one doc_id have one each."""
    rows = carried(docs, "doc_id", "text", "lang", "source")
    key = row_key("doc_id", "lang", "source", "text")
    judged = judge(rows.drop("row").withColumn("key", key), ("key",))
    kept = materialize(judged.where("kept").select("key").distinct(), "kept")
    return rows.select("row", key.alias("key")).join(kept, "key", "left_semi").select("row.*")


def quality_digest(judged: DataFrame) -> DataFrame:
    """What the query op10 returns."""
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
