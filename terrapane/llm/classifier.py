"""Document quality by hierarchical empirical Bayes.

A naive Bayes classifier over binned text features gives each document its own evidence. Its scores are summed per host
and per path of a host; moments of these sums give the strength of the prior at each level, so that a site of few
documents shrinks to its host, and a host of few documents to all. A document's posterior odds are its own odds times
the odds of its path over those of the corpus; its own score is left out of its path and host.

Defined results: null text has no words, and is judged by those features; null host or path is a site of its own; rows
of an equal doc_id are judged each on its own, with a label that any row of `labels` gives (quality 1 if rows differ); a
corpus without labels of both kinds keeps everything that has a word (all probabilities 0.5); other columns are ignored by
`posteriors` and kept by `filter_documents`, whatever their names; no rows in, no rows out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapane.llm.common import SPACES, WORD, carried, join_small, materialize, row_key, text_of, without_held

BINS = 20
SMOOTHING = 0.2  # added to each count
KEEP = 0.2  # a document goes only where the odds against it are clear
MOST_ODDS = 12.0  # of a document's own log odds, either way
FEATURES = ("symbols", "bars", "marks", "capitals", "digits", "word_length", "short_words", "distinct", "runs", "lines", "length")


def url_sites(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with site_host and site_path (the first part of the path, / if there is none) of their URLs, for use as host and path; null where the URL has no host."""
    at = F.try_parse_url(F.col(url), F.lit("HOST"))
    first = F.regexp_extract(F.coalesce(F.try_parse_url(F.col(url), F.lit("PATH")), F.lit("")), "^(/[^/]*)", 1)
    return pages.withColumn("site_host", F.lower(at)).withColumn("site_path", F.when(at.isNotNull(), F.when(first == "", F.lit("/")).otherwise(first)))


def features(docs: DataFrame, host: str = "source", path: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, doc_id, host, path, n_words, and each feature's bin from 0 to BINS."""
    rows = docs.select(*keep, "doc_id", F.col(host).alias("host"), F.col(path).alias("path"), text_of().alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)))
    without = lambda pattern: F.length("text") - F.length(F.regexp_replace("text", pattern, ""))
    rows = rows.select(
        *keep,
        "doc_id",
        "host",
        "path",
        F.size("words").cast("long").alias("n_words"),
        F.greatest(F.lit(1), F.length("text") - without(SPACES)).alias("chars"),
        without(r"[#*$%&<>]+").alias("symbols"),
        without(r"[|]+").alias("bars"),
        without(r"[!?]+").alias("marks"),
        without(r"\p{Lu}+").alias("capitals"),
        without(r"[0-9]+").alias("digits"),
        F.size(F.filter("words", lambda w: F.length(w) <= 3)).alias("short_words"),
        F.size(F.array_distinct("words")).alias("distinct"),
        F.size(F.filter(F.zip_with("words", F.slice("words", 2, F.size("words")), lambda a, b: a == b), lambda x: x)).alias("runs"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("lines"),
    )
    words = F.greatest(F.lit(1), F.col("n_words"))
    bins = {
        "symbols": F.col("symbols") * 200 / F.col("chars"),
        "bars": F.col("bars") * 200 / F.col("chars"),
        "marks": F.col("marks") * 100 / F.col("chars"),
        "capitals": F.col("capitals") * 20 / F.col("chars"),
        "digits": F.col("digits") * 40 / F.col("chars"),
        "word_length": F.col("chars") * 2 / words,
        "short_words": F.col("short_words") * 20 / words,
        "distinct": F.col("distinct") * 20 / words,
        "runs": F.col("runs") * 20 / words,
        "lines": F.col("lines") * 20 / F.greatest(F.lit(1), F.col("n_lines")),
        "length": F.length(F.bin(words)) - 1,  # whole part of the binary logarithm
    }
    return rows.select(*keep, "doc_id", "host", "path", "n_words", *(F.least(F.lit(BINS), F.floor(bins[f])).cast("int").alias(f) for f in FEATURES))


def evidence(featured: DataFrame, labels: DataFrame) -> DataFrame:
    """log odds of good quality for each feature's bin: feature, bin, odds; smoothed counts of the labelled documents, all of them."""
    known = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("labelled_id")).agg(F.max("quality").alias("quality"))
    rows = featured.join(known, F.col("doc_id") == F.col("labelled_id"))
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("bin")) for f in FEATURES)))
    counted = rows.select("quality", pairs.alias("x")).groupBy("x.feature", "x.bin").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    return materialize(counted, "evidence")  # at most len(FEATURES) * (BINS + 1) rows


def document_scores(featured: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, doc_id, host, path, n_words, p: the document's own probability of good quality."""
    found = evidence(featured, labels).collect()
    good, bad = (sum(getattr(r, k) for r in found if r.feature == FEATURES[0]) for k in ("good", "bad"))
    odds = F.lit(0.0)
    if good and bad:
        odds = F.lit(math.log(good / bad))
        for f in FEATURES:
            table = {b: 0.0 for b in range(BINS + 1)}
            for r in found:
                if r.feature == f:
                    table[r.bin] = math.log((r.good + SMOOTHING) / (good + BINS * SMOOTHING)) - math.log((r.bad + SMOOTHING) / (bad + BINS * SMOOTHING))
            odds = odds + F.element_at(F.array(*(F.lit(table[b]) for b in range(BINS + 1))), F.col(f) + 1)
    odds = F.greatest(F.lit(-MOST_ODDS), F.least(F.lit(MOST_ODDS), odds))
    return featured.select(*keep, "doc_id", "host", "path", "n_words", (1 / (1 + F.exp(-odds))).alias("p"))


def strength(groups: DataFrame, mean: float) -> float:
    """How many documents the prior above these groups counts for: variance within over variance between, by moments (n, s, ss of each group)."""
    n, k, within, between, squares = groups.agg(
        F.sum("n"), F.count(F.lit(1)), F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n")), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2)), F.sum(F.col("n") * F.col("n") / F.lit(1.0))
    ).first()
    if not n or k < 2 or n <= k:
        return 1.0
    inner = max(within / (n - k), 1e-9)
    outer = max((between / (k - 1) - inner) / ((n - squares / n) / (k - 1)), inner / 1e4)
    return min(max(inner / outer, 1.0), 1e4)


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def posteriors(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: keep, doc_id, p_document, p_host, p_path, p_quality, kept."""
    scored = document_scores(materialize(features(docs, host, path, keep), "features"), labels, keep)
    sums = (F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("ss"))
    paths = materialize(scored.groupBy("host", "path").agg(*sums), "paths")
    hosts = materialize(paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss"))), "hosts")
    n, s = hosts.agg(F.sum("n"), F.sum("s")).first()
    mean = s / n if n else 0.5
    host_k, path_k = strength(hosts, mean), strength(paths, mean)
    sites = paths.select(F.col("host").alias("of_host"), F.col("path").alias("of_path"), F.col("n").alias("path_n"), F.col("s").alias("path_s"))
    owners = hosts.select(F.col("host").alias("own_host"), F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    joined = join_small(scored, sites, F.col("host").eqNullSafe(F.col("of_host")) & F.col("path").eqNullSafe(F.col("of_path")))
    joined = join_small(joined, owners, F.col("host").eqNullSafe(F.col("own_host")))
    p_host = (F.col("host_s") - F.col("p") + host_k * mean) / (F.col("host_n") - 1 + host_k)
    p_path = (F.col("path_s") - F.col("p") + path_k * F.col("p_host")) / (F.col("path_n") - 1 + path_k)
    odds = _logit(F.col("p")) + _logit(F.col("p_path")) - _logit(F.lit(mean))
    out = joined.withColumn("p_host", p_host).withColumn("p_path", p_path).withColumn("p_quality", 1 / (1 + F.exp(-odds)))
    return out.select(*keep, "doc_id", F.col("p").alias("p_document"), "p_host", "p_path", "p_quality", ((F.col("p_quality") >= KEEP) & (F.col("n_words") > 0)).alias("kept"))


def filter_documents(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """The rows of docs that are kept, with all their columns. A verdict goes with what a row says (row_key), so rows of one doc_id have one each."""
    rows = carried(docs, "doc_id", "text", F.col(host).alias("host"), F.col(path).alias("path"))
    key = row_key("doc_id", "host", "path", "text")
    judged = posteriors(rows.drop("row").withColumn("key", key), labels, "host", "path", ("key",))
    gone = materialize(judged.where(~F.coalesce("kept", F.lit(False))).select("key").distinct(), "gone")
    return without_held(rows.select("row", key.alias("key")), gone, "key").select("row.*")
