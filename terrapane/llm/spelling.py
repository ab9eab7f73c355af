"""Spelling variants: words one edit apart by asymmetric q-chunks, grouped under their commonest form.

Words are runs of letters, counted over all texts (`word_counts`; a run may first lose a code point by a checksum, which
plants misspellings at a known rate). Two words are near if one inserted, deleted or replaced code point makes one of the
other. Of such a pair, the shorter word (of equal lengths, the smaller) contributes two disjoint chunks, its first and its
last half; one edit leaves one of them as it is. The other word contributes positional grams: an edit moves what follows
it by at most one place, so of all its grams only those of a chunk's length that start within a shift of one of the
chunk's place can meet it, and these are its first and its last ones for either partner's length. Chunks and grams meet
in an equi-join on the partner's length, side and letters, and a pair is verified inside the join by a banded edit
distance. A pair that both chunks find counts with the first. Keys that very many chunks share are dealt into blocks, to
which the grams are copied, so that no task holds such a key alone.

A word's form is its near word of the largest count, if that is at least twice the word's own; forms are followed to the
last by doubling, so chains of any length take a few joins.

Defined results: null and empty texts have no words; rows of an equal doc_id all count; a null doc_id is the empty string
in the checksum; ties of counts go to the smaller word in code-point order; other columns are not read; no rows in, no
rows out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapane.llm.common import freeing, join_small, materialize

LEAST_CHARS = 5
LEAST_COUNT = 3
DAMAGE = 97  # a run loses a code point if this divides its checksum; 0: none does
MOST_HELD = 200_000  # different words that a task holds before it passes their counts on
BLOCK = 1_000  # chunks of a key in a block, about
RUN = re.compile("[a-zÀ-ÿ]+")


def runs_of(text: str) -> list[str]:
    """Maximal runs of letters; A-Z alone are lower-cased."""
    return RUN.findall(text.encode("utf-8").lower().decode("utf-8"))  # bytes.lower knows ASCII only


def damaged(doc_id: str, run: str, damage: int) -> str:
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if not damage or h % damage:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, damage: int = DAMAGE, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of all texts. Counts are combined in the tasks, in tables of a bounded size, before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def passed_on() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in freeing(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for run, n in Counter(runs_of(text.as_py() or "")).items():
                    word = damaged(doc_id or "", run, damage)
                    if len(word) >= least_chars:
                        held[word] += n
                if len(held) > MOST_HELD:
                    yield passed_on()
        yield passed_on()

    rows = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def near_pairs(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n, other, other_n: each pair of near words once, of words (word, n; written, one row a word, two code points at least)."""
    size = F.length("word")
    half = lambda of: F.floor(of / 2).cast("int")

    def sides(q):
        return F.array(F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), q).alias("gram")), F.struct(F.lit(1).alias("side"), F.expr("right(word, q)").alias("gram")))

    chunks = words.select("word", "n", size.alias("size"), half(size).alias("q")).select("word", "n", "size", F.inline(sides(F.col("q"))))
    grams = words.select("word", "n", F.explode(F.array(size - 1, size)).alias("size")).withColumn("q", half(F.col("size")))
    grams = grams.select(F.col("word").alias("other"), F.col("n").alias("other_n"), "size", F.inline(sides(F.col("q"))))
    key = ["size", "side", "gram"]
    full = materialize(chunks.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).where("blocks > 1"), "full_chunks")
    chunks = join_small(chunks, full, key).withColumn("block", F.coalesce(F.pmod(F.xxhash64("word"), "blocks").cast("int"), F.lit(0)))
    grams = join_small(grams, full, key).withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    first = lambda word: F.substring(word, F.lit(1), half(F.col("size")))
    meets = (F.length("other") > F.col("size")) | (F.col("word") < F.col("other"))
    once = (F.col("side") == 0) | (first("word") != first("other"))
    pairs = chunks.drop("blocks").join(grams.drop("blocks"), [*key, "block"]).where(meets & once & (F.levenshtein("word", "other", 1) == 1))
    return pairs.select("word", "n", "other", "other_n")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms (word, form): where following the forms ends. Each round doubles how far a word looks; forms have more than their words' counts, so there are no circles."""
    ahead = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while ahead.where("moved").limit(1).count():
        far = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = materialize(ahead.join(far, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
    return ahead.select("word", "root")


def variants(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n)."""
    words = materialize(words.select("word", "n"), "words")
    pairs = near_pairs(words, block)
    both = F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = F.min(F.struct((-F.col("other_n")).alias("order"), "other"))
    near = pairs.select(F.inline(both)).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.first("n").alias("n"), best.alias("best"))
    is_form = -F.col("best.order") >= 2 * F.col("n")
    near = materialize(near.select("word", "n_near", F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.order")).alias("form_n")), "near_words")
    known = near.join(roots(near.where("form IS NOT NULL")), "word", "left")
    return words.join(known, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def group_spellings(docs: DataFrame) -> DataFrame:
    """The spelling variants of all words of docs."""
    return variants(word_counts(docs))
