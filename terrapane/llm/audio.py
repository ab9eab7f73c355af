"""Chroma audio fingerprints of media columns.

Samples become frames of twelve pitch-class energies (windowed Fourier transform, each bin added to the class of its
nearest semitone). Frames are stretches of time, FRAME_S seconds each HOP_S seconds, so the sample rate makes no
difference (above 2 * HIGHEST_HZ; below, higher tones are missing). A recording is read and framed in stretches of
STRETCH frames. Sixteen rectangle filters slide over the frames; an integral image gives each rectangle's sum in four
look-ups. Each filter's log ratio is cut to two bits, so a position becomes one packed 32-bit integer.

Recordings with equal fingerprints are one class, so copies are searched once. Query classes and all classes meet at
positions whose packed integers agree in a band of 16 bits and in all but SEED_ERRORS of the 32, if the CONTEXT integers
from there on agree, too; so what only looks alike at one position is not passed on. Integers that repeat
(silence, held tones) make heavy bands: their postings are counted first (4 x 65,536 counts at most) and split over as
many salts as they need. Each offset so met is an alignment, and the share of wrong bits over its stretch decides. Of a
pair's alignments that pass, the one with most votes (positions equal in all bits) holds, or below LEAST_VOTES the one
with the smallest share of wrong bits.

Defined results: null or unreadable media, and recordings shorter than a filter, have an empty fingerprint, are a class
of their own each and match nothing; ties go to the smaller offset; rows of an equal id each get their own row and keep
their own class, which is named by its least id (null if it has none); rows with a null id are no queries; other columns
are ignored; no rows in, no rows out.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapane.llm.common import join_small, materialize

FRAME_S, HOP_S = 0.128, 0.064
STRETCH = 1024  # frames transformed at a time
READ = 1 << 18  # samples read at a time
WINDOW = 16  # frames under a filter at most
LEAST_VOTES = 6  # from here on votes choose between alignments
#: Bands of a packed integer, one of which agrees at a seed, and how many of all its bits may be wrong there.
#: A seed's first CONTEXT integers and the share of their bits that may be wrong: more than MOST_ERROR, as they are few.
CONTEXT, CONTEXT_ERROR = 12, 0.27
BANDS, SEED_ERRORS = (0xFFFF0000, 0x0000FFFF, 0xFF00FF00, 0x00FF00FF), 5
MOST_ERROR = 0.2  # of the bits over the aligned stretch; seeds find at least nine in ten of the alignments up to here
LEAST_OVERLAP = 16  # positions
SALT_ROWS = 20_000  # postings of a band that meet in one place
LOWEST_HZ, HIGHEST_HZ = 60.0, 3600.0
NOTE_SAMPLES, TONE_RATE = 256, 4000
#: (pattern, first pitch class, pitch classes, frames) of each filter, made by a rule that spreads them over all four.
FILTERS = tuple((i % 6, (5 * i) % 12, 2 + (7 * i) % 9, (4, 8, 12, WINDOW)[(i // 3) % 4]) for i in range(16))
#: For each filter, in order, the log ratios at which its two bits change (quartiles over random tunes, so that all four codes are as frequent).
STEPS = (
    (-0.9, 0.0, 0.9),
    (-0.8, -0.1, 0.6),
    (-0.6, 0.0, 0.6),
    (-1.8, -1.1, -0.6),
    (-2.2, -1.3, -0.5),
    (-2.7, -2.2, -1.7),
    (-0.2, 0.0, 0.2),
    (-0.5, 0.0, 0.4),
    (-0.5, 0.0, 0.5),
    (-2.0, -0.9, -0.2),
    (-1.0, -0.6, -0.3),
    (-2.0, -1.6, -1.1),
    (-0.7, 0.0, 0.7),
    (-1.9, -0.9, 0.2),
    (-0.6, 0.0, 0.6),
    (-1.4, -1.0, -0.8),
)
TWELFTHS = [NormalDist().inv_cdf(k / 12) for k in range(1, 12)]
GRAY = np.array([0, 1, 3, 2], np.int64)


Recording = tuple[Iterator[np.ndarray], int]  # mono samples, a stretch at a time, and their rate


def wav_samples(data: bytes) -> Recording:
    """Of a 16-bit WAV file; nothing if it can't be read."""
    try:
        w = wave.open(io.BytesIO(data))
    except (wave.Error, EOFError, TypeError, ValueError):
        return iter(()), 1
    if w.getsampwidth() != 2 or w.getframerate() < 1 or w.getnchannels() < 1:
        return iter(()), 1

    def read():
        n = w.getnchannels()
        while data := w.readframes(READ):
            x = np.frombuffer(data[: len(data) // (2 * n) * 2 * n], "<i2").astype(np.float32)
            yield x.reshape(-1, n).mean(axis=1)

    return read(), w.getframerate()


def tones(vector) -> Recording:
    """A recording of a vector: one note for each number, its pitch the twelfth of a normal distribution (of the vector's own spread) that the number is in."""
    if vector is None or not len(vector):
        return iter(()), TONE_RATE
    v = np.nan_to_num(np.asarray(vector, np.float64))
    pitch = np.searchsorted(TWELFTHS, v / (v.std() or 1.0))
    t = np.arange(NOTE_SAMPLES) / TONE_RATE
    return iter([np.sin(2 * np.pi * (220 * 2 ** (pitch / 12))[:, None] * t).ravel().astype(np.float32)]), TONE_RATE


@lru_cache(maxsize=8)
def _pitch_classes(rate: int, length: int) -> np.ndarray:
    """frequency bins x 12"""
    hz = np.fft.rfftfreq(length, 1 / rate)
    good = (hz >= LOWEST_HZ) & (hz <= HIGHEST_HZ)
    which = np.round(12 * np.log2(np.maximum(hz, 1) / 440)).astype(int) % 12
    return (good[:, None] & (which[:, None] == np.arange(12))).astype(np.float32)


def chroma(samples: Iterator[np.ndarray], rate: int) -> np.ndarray:
    """frames x 12, each frame adding up to 1 (0 where silent). Frame i begins at the sample nearest to i * HOP_S."""
    length = max(2, round(FRAME_S * rate))
    window, classes = np.hanning(length).astype(np.float32), _pitch_classes(rate, length)
    out, held, at, done = [np.empty((0, 12), np.float32)], np.empty(0, np.float32), 0, 0  # held begins at sample at

    def frames(n: int) -> np.ndarray:
        starts = np.round(np.arange(done, done + n) * (HOP_S * rate)).astype(np.int64) - at
        parts = np.lib.stride_tricks.sliding_window_view(held, length)[starts] * window
        energy = (np.abs(np.fft.rfft(parts, axis=1)) ** 2).astype(np.float32) @ classes
        return energy / np.maximum(energy.sum(axis=1, keepdims=True), 1e-9)

    for block in samples:
        held = np.concatenate([held, block])
        # frames whose end is here
        last = int((at + len(held) - length + 0.5) / (HOP_S * rate)) + 2
        while last >= done and round(last * (HOP_S * rate)) + length > at + len(held):
            last -= 1
        while done <= last:
            n = min(STRETCH, last - done + 1)
            out.append(frames(n))
            done += n
        drop = max(0, min(len(held), round(done * (HOP_S * rate)) - at))
        held, at = held[drop:], at + drop
    return np.concatenate(out)


def fingerprint(frames: np.ndarray) -> np.ndarray:
    """A packed 32-bit integer, as int64, for each position."""
    n = len(frames) - WINDOW + 1
    if n < 1:
        return np.empty(0, np.int64)
    rows = np.c_[frames, frames]  # pitch classes go round
    image = np.zeros((len(rows) + 1, 25))
    image[1:, 1:] = rows.cumsum(axis=0).cumsum(axis=1)

    def box(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        a, b = image[t0 : t0 + n], image[t1 : t1 + n]
        return b[:, y1] - a[:, y1] - b[:, y0] + a[:, y0]

    out = np.zeros(n, np.int64)
    for (pattern, y, h, w), steps in zip(FILTERS, STEPS, strict=True):
        whole, half, third = box(0, w, y, y + h), w // 2, max(1, w // 3)
        part = (
            lambda: box(0, half, y, y + h),  # earlier against later
            lambda: box(0, w, y, y + h // 2),  # lower against higher
            lambda: box(0, half, y, y + h // 2) + box(half, w, y + h // 2, y + h),  # diagonal
            lambda: box(third, 2 * third, y, y + h),  # middle frames against the rest
            lambda: box(0, w, y + h // 3, y + max(h // 3 + 1, 2 * h // 3)),  # middle classes against the rest
            lambda: box(0, w, y, y + 1),  # lowest class against the rest
        )[pattern]()
        ratio = np.log1p(50 * part) - np.log1p(50 * np.maximum(whole - part, 0))
        out = out << 2 | GRAY[np.searchsorted(steps, ratio)]
    return out


def fingerprints(media: DataFrame, id_column: str, column: str, read: Callable[[object], Recording] = wav_samples) -> DataFrame:
    """id, prints (array of packed integers)."""

    def run(batches):
        for b in batches:
            prints = [fingerprint(chroma(*read(x))) for x in b.column(1).to_pandas()]
            ends = pa.array(np.cumsum([0, *map(len, prints)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int64), *prints])))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["id", "prints"])

    rows = media.select(F.col(id_column).cast("long").alias("id"), F.col(column).alias("media"))
    return rows.mapInArrow(run, "id bigint, prints array<bigint>")


def keyed(printed: DataFrame) -> DataFrame:
    """Adds key: a 64-bit hash of the fingerprint; null for an empty one."""
    return printed.withColumn("key", F.when(F.size("prints") > 0, F.xxhash64("prints")))


def bands(prints: DataFrame, name: str) -> DataFrame:
    """band, {name}, {name}_at, {name}_0 and on, {name}_before: the postings of every position that has CONTEXT integers from it on, packed by two, and the integer before it."""
    packed = lambda i, k: F.shiftleft(F.get("prints", i + k), 32).bitwiseOR(F.get("prints", i + k + 1))
    at = F.filter(F.sequence(F.lit(0), F.size("prints") - CONTEXT), lambda i: (i >= 0) & (i + CONTEXT <= F.size("prints")))
    each = F.transform(at, lambda i: F.struct(i.alias(f"{name}_at"), *(packed(i, k).alias(f"{name}_{k // 2}") for k in range(0, CONTEXT, 2)), F.get("prints", i - 1).alias(f"{name}_before")))
    rows = prints.select(F.col("key").alias(name), F.inline(each))
    first = F.shiftrightunsigned(F.col(f"{name}_0"), 32)
    keys = F.array(*(first.bitwiseAND(F.lit(mask).cast("long")) + F.lit(i << 32) for i, mask in enumerate(BANDS)))
    return rows.select(F.explode(keys).alias("band"), *rows.columns)


def seeds(prints: DataFrame, queries: DataFrame) -> DataFrame:
    """query, match, shift: the offsets at which a query's position and another class's agree well enough, they and those that follow. Of positions in a row that do, the first alone is passed on, and in one band, so that true copies make few rows."""
    postings = bands(prints, "match")
    # at most four times 65,536 rows
    heavy = materialize(postings.groupBy("band").count().where(F.col("count") > SALT_ROWS).select("band", F.ceil(F.col("count") / SALT_ROWS).alias("salts")), "audio-heavy")
    salts = lambda df: df.join(F.broadcast(heavy), "band", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    right = salts(postings).withColumn("salt", F.pmod(F.xxhash64("match", "match_at"), F.col("salts"))).drop("salts")
    left = salts(bands(queries, "query")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    most = int(CONTEXT_ERROR * 32 * CONTEXT)
    low = F.lit(0xFFFFFFFF).cast("long")
    apart = [F.col(f"query_{k}").bitwiseXOR(F.col(f"match_{k}")) for k in range(CONTEXT // 2)]
    wrong = reduce(Column.__add__, map(F.bit_count, apart))
    first, before = F.shiftrightunsigned(apart[0], 32), F.col("query_before").bitwiseXOR(F.col("match_before"))
    agrees = lambda x, i: x.bitwiseAND(F.lit(BANDS[i]).cast("long")) == 0
    earlier = reduce(Column.__or__, (agrees(first, i) & (F.shiftright("band", 32) > i) for i in range(len(BANDS))))
    # the position before is a seed by the same rule: then this one adds nothing
    last = F.bit_count(apart[-1].bitwiseAND(low))
    follows = reduce(Column.__or__, (agrees(before, i) for i in range(len(BANDS)))) & (F.bit_count(before) <= SEED_ERRORS) & (wrong + F.bit_count(before) - last <= most)
    near = (F.col("query") != F.col("match")) & (F.bit_count(first) <= SEED_ERRORS) & (wrong <= most) & ~earlier & ~F.coalesce(follows, F.lit(False))
    left = left.withColumnsRenamed({"band": "q_band", "salt": "q_salt"})
    both = left.join(right, (F.col("q_band") == F.col("band")) & (F.col("q_salt") == F.col("salt")) & near)
    return both.select("query", "match", (F.col("match_at") - F.col("query_at")).alias("shift")).distinct()


def align(prints: DataFrame, queries: DataFrame) -> DataFrame:
    """query, match (keys of classes), shift, votes, bit_errors (share): alignments of the queries with the other classes; both tables have key, prints."""
    found = materialize(seeds(prints, queries), "audio-seeds")
    both = found.join(prints.select(F.col("key").alias("match"), F.col("prints").alias("b")), "match")
    both = join_small(both, queries.select(F.col("key").alias("query"), F.col("prints").alias("a")), "query", "inner")
    begin = F.greatest(F.lit(0), -F.col("shift"))
    n = F.least(F.size("a") - begin, F.size("b") - begin - F.col("shift"))
    both = both.withColumn("begin", begin).withColumn("n", n).where(F.col("n") >= LEAST_OVERLAP)
    wrong = F.zip_with(F.slice("a", F.col("begin") + 1, F.col("n")), F.slice("b", F.col("begin") + F.col("shift") + 1, F.col("n")), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    # bit errors in the low 32 bits, votes above them
    sums = both.select("query", "match", "shift", "n", F.aggregate(wrong, F.lit(0).cast("long"), lambda s, x: s + x + F.when(x == 0, F.lit(1 << 32)).otherwise(F.lit(0))).alias("sums"))
    scored = sums.select("query", "match", "shift", F.shiftright("sums", 32).alias("votes"), F.round(F.col("sums").bitwiseAND(F.lit(0xFFFFFFFF)) / (32 * F.col("n")), 6).alias("bit_errors"))
    strong = F.col("votes") >= LEAST_VOTES
    order = F.struct(F.when(strong, F.col("votes")).otherwise(0).alias("strong"), F.when(strong, 0.0).otherwise(-F.col("bit_errors")).alias("right"), (-F.abs("shift")).alias("near"), (-F.col("shift")).alias("order"), "votes", "bit_errors")
    best = scored.where(F.col("bit_errors") <= MOST_ERROR).groupBy("query", "match").agg(F.max(order).alias("x"))
    return best.select("query", "match", (-F.col("x.order")).cast("long").alias("shift"), "x.votes", "x.bit_errors")


def search(printed: DataFrame, every: int = 20) -> DataFrame:
    """One row per recording: id, class_id, n_prints, is_query, n_matches and matches (of its class, for queries: ids divisible by every)."""
    printed = materialize(keyed(printed), "audio")
    is_query = F.coalesce(F.col("id") % every == 0, F.lit(False))
    held = printed.where("key IS NOT NULL")
    classes = materialize(held.groupBy("key").agg(F.min("id").alias("class_id"), F.max(is_query).alias("asked"), F.first("prints").alias("prints")), "audio-classes")
    queries = materialize(classes.where("asked").select("key", "prints"), "audio-queries")
    pairs = align(classes.select("key", "prints"), queries)
    names = classes.select(F.col("key").alias("match"), "class_id")
    listed = F.sort_array(F.collect_list(F.struct("class_id", "shift", "votes", "bit_errors"))).alias("matches")
    lists = materialize(pairs.join(names, "match").groupBy(F.col("query").alias("key")).agg(listed), "audio-matches")
    out = printed.select("id", "key", F.size("prints").cast("long").alias("n_prints"), is_query.alias("is_query"))
    out = out.join(classes.select("key", "class_id"), "key", "left").join(lists, "key", "left")
    matches = F.when(F.col("is_query"), F.col("matches"))
    n = F.when(F.col("is_query"), F.coalesce(F.size("matches"), F.lit(0))).cast("long")
    class_id = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("class_id"))
    return out.select("id", class_id.alias("class_id"), "n_prints", "is_query", n.alias("n_matches"), matches.alias("matches"))
