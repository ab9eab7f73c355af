"""Phrases that hold together: counts of one to five words as sorted streams, scored against the counts of their parts.

Texts are cut into pieces and words (`tokens`). Every word starts one window of up to five words, and all counts come
from the windows: f(phrase) is the number of windows that start with it. A task sorts and counts the windows of a stretch
of text and sends each range of them as one packed run; ranges are cut at windows of a bounded sample, so that they are
about equal whatever words are frequent, and cuts never change a count. A range's task merges its runs level by level and
keeps what reaches LEAST; only the beginnings of a range's two bounds can go on in other ranges, and these few are added
up afterwards. No phrase needs a table of all phrases.

The counts are then read twice as a stream: in prefix order, where the beginnings of a phrase stand before it, and in
suffix order (words reversed), where its endings do. One pass with the path of open parts gives each phrase the counts of
all its beginnings, or endings, and tells which shorter phrases are never seen without it. Both streams meet in a merge
join, every cut is scored in exact decimals, and the lowest score counts.

Defined results: null texts are empty; a null language is `und`, together with a language of that name; rows of an equal
doc_id all count; ties of scores go to the larger count, then to the smaller phrase in byte order; other columns are not
read; no rows in, no rows out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapane.llm.common import freeing, materialize

LONGEST = 5
LEAST = 100
TOP = 2_000  # phrases reported of a language
NO_LANG = "und"
STRETCH = 800_000  # words that a task sorts at once; with the words of the bounds they must have codes of CODE_BITS
RANGE = 1_000_000  # windows of a range, about
SAMPLE = 50  # windows sampled for a range
MOST_RANGES = 20_000
CODE_BITS = 21  # of a word within a stretch; three share 64 bits
_BREAK, _EMPTY = b"\n", b""
_TABLE = bytes(10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if c == 9 else c for c in range(256))


def tokens(text: str) -> list[bytes]:
    """The words of a text in UTF-8, A-Z in lower case, with a newline wherever a piece ends, and empty ones between."""
    return text.encode("utf-8").lower().translate(_TABLE).replace(b"\n", b" \n ").split(b" ")


class _Codes(dict):
    """Numbers for words, as they come: 0 ends a piece, 1 is no word, words follow."""

    def __init__(self):
        super().__init__({_BREAK: 0, _EMPTY: 1})

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code


def windows(codes: np.ndarray) -> np.ndarray:
    """LONGEST rows of codes with a column for each word of a stretch, 0 beyond its piece. Words of negative codes are read by earlier windows only."""
    codes = codes[codes != 1]
    starts = codes > 0
    codes = np.abs(codes)
    padded = np.concatenate([codes, np.zeros(LONGEST, codes.dtype)])
    rows = np.empty((LONGEST, len(codes)), np.int64)
    rows[0] = codes
    for k in range(1, LONGEST):
        rows[k] = np.where(rows[k - 1] == 0, 0, padded[k : k + len(codes)])
    return rows[:, starts]


def _packed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return rows[0] << 2 * CODE_BITS | rows[1] << CODE_BITS | rows[2], rows[3] << CODE_BITS | rows[4]


def write_run(words: list[bytes], rows: np.ndarray, n: np.ndarray) -> bytes:
    """A sorted run with its own short dictionary, compressed."""
    used, inverse = np.unique(rows, return_inverse=True)
    text = b"\n".join(words[i] for i in used)
    width = np.uint16 if len(used) < 1 << 16 else np.uint32
    head = np.array([rows.shape[1], np.dtype(width).itemsize, len(text)], np.int64)
    return zstandard.compress(head.tobytes() + text + inverse.reshape(rows.shape).astype(width).tobytes() + n.astype(np.uint32).tobytes(), 3)


def read_run(run: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    data = zstandard.decompress(run)
    size, width, length = np.frombuffer(data, np.int64, 3)
    at = 24 + int(length)
    rows = np.frombuffer(data, f"u{width}", LONGEST * size, at).reshape(LONGEST, size)
    return data[24:at].split(b"\n"), rows, np.frombuffer(data, np.uint32, size, at + rows.nbytes)


def _stretches(batches: Iterable[pa.RecordBatch], stretch: int, known: Iterable[bytes] = ()) -> Iterator[tuple[_Codes, dict[str, np.ndarray]]]:
    """The codes of the texts (lang, text) by language, a stretch at a time. A text longer than a stretch goes in several, each with the words that its last windows need, in negative codes."""

    def fresh():
        codes = _Codes()
        for word in known:
            codes[word]
        return codes, {}, 0

    codes, parts, held = fresh()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = tokens(text.as_py() or "")
            for at in range(0, len(words), stretch):
                here, after = words[at : at + stretch], []
                for i in range(at + stretch, len(words)):
                    if words[i] == _BREAK or len(after) == LONGEST - 1:
                        break
                    if words[i]:
                        after.append(words[i])
                own = [*map(codes.__getitem__, here), *(-codes[w] for w in after), 0]
                parts.setdefault(lang, []).append(np.array(own, np.int32))
                held += len(here)
                if held >= stretch or len(codes) >= 1 << CODE_BITS - 1:
                    yield codes, {k: np.concatenate(v) for k, v in parts.items()}
                    codes, parts, held = fresh()
    if parts:
        yield codes, {k: np.concatenate(v) for k, v in parts.items()}


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), "text")


def range_bounds(docs: DataFrame, window_range: int = RANGE, least_ranges: int = 1) -> list[tuple[str, list[bytes]]]:
    """Bounds (lang, words) of ranges of about so many windows, from at most SAMPLE * MOST_RANGES windows of sampled texts. They only balance the work."""
    rows, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    words = (size or 0) / 6
    ranges = int(min(MOST_RANGES, max(least_ranges, words / window_range)))
    fraction = min(1.0, max(0.02, 2_000 / max(1, rows)))
    step = max(1, int(words * fraction / (SAMPLE * ranges)))

    def pick(batches):
        for codes, parts in _stretches(batches, STRETCH):
            named = list(codes)
            named[0] = b""
            for lang, each in parts.items():
                some = windows(each)[:, ::step]
                yield pa.RecordBatch.from_pydict({"lang": [lang] * some.shape[1], "words": [[named[i] for i in row] for row in some.T]}, schema=pa.schema([("lang", pa.string()), ("words", pa.list_(pa.binary()))]))

    found = _texts(docs).sample(fraction, 7).mapInArrow(pick, "lang string, words array<binary>").toArrow().to_pydict()
    found = sorted((lang.encode(), words) for lang, words in zip(found["lang"], found["words"], strict=True))
    cuts = sorted({(found[i][0], tuple(found[i][1])) for i in (len(found) * k // ranges for k in range(1, ranges))} if found else ())
    return [(lang.decode(), [bytes(w) for w in words]) for lang, words in cuts]


def window_runs(docs: DataFrame, bounds: list[tuple[str, list[bytes]]], stretch: int = STRETCH) -> DataFrame:
    """part, lang, run: the windows of docs (lang, text), counted by stretches, in sorted runs, one for each range that a stretch meets."""
    known = [w for _, words in bounds for w in words if w]

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, parts in _stretches(freeing(batches), stretch, known):
            named = list(codes)
            named[0] = b""  # none, below all words
            order = sorted(range(len(named)), key=named.__getitem__)
            words = [named[i] for i in order]
            rank = np.empty(len(named), np.int64)
            rank[order] = np.arange(len(named))
            rank[0] = 0
            out = {"part": [], "lang": [], "run": []}
            for lang, each in parts.items():
                rows = rank[windows(each)]
                high, low = _packed(rows)
                by = np.lexsort((low, high))
                high, low = high[by], low[by]
                first = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])) if len(by) else by
                n = np.diff(np.append(first, len(by)))
                rows, high, low = rows[:, by[first]], high[first], low[first]
                own = [words_ for at, words_ in bounds if at == lang]
                part = sum(at.encode() < lang.encode() for at, _ in bounds)
                cuts = []
                if own:
                    for a, b in zip(*_packed(rank[np.array([[codes[w] if w else 0 for w in words_] for words_ in own]).T]), strict=True):
                        start, end = np.searchsorted(high, [a, a + 1])
                        cuts.append(start + np.searchsorted(low[start:end], b))
                for i, (start, end) in enumerate(zip([0, *cuts], [*cuts, len(n)], strict=True)):
                    if start < end:
                        out["part"].append(part + i)
                        out["lang"].append(lang)
                        out["run"].append(write_run(words, rows[:, start:end], n[start:end]))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("part", pa.int32()), ("lang", pa.string()), ("run", pa.binary())]))

    return _texts(docs).mapInArrow(sort, "part int, lang string, run binary")


def merged_counts(runs: list[bytes], least: int, bounds: list[list[bytes]]) -> Iterator[tuple[list[bytes], int]]:
    """Phrases of one language's runs in a range and their counts: those that reach least, and all beginnings of its bounds, whatever they reach."""
    codes = _Codes()
    read = [read_run(run) for run in runs]
    rows = np.concatenate([np.array([codes[w] if w else 0 for w in words], np.int32)[each] for words, each, _ in read], axis=1)
    n = np.concatenate([n for _, _, n in read]).astype(np.int64)
    named = list(codes)
    yield [], int(n.sum())
    group, heads = np.zeros(rows.shape[1], np.int64), np.empty((0, 1), np.int64)
    for k in range(LONGEST):
        there = rows[k] != 0
        rows, n, group = rows[:, there], n[there], group[there]
        found, first, group = np.unique(group * len(codes) + rows[k], return_index=True, return_inverse=True)
        f = np.zeros(len(found), np.int64)
        np.add.at(f, group, n)
        heads = rows[: k + 1, first]
        edge = np.zeros(len(found), bool)
        for words in bounds:
            if all(words[: k + 1]) and all(w in codes for w in words[: k + 1]):
                edge |= (heads == np.array([codes[w] for w in words[: k + 1]])[:, None]).all(0)
        good = edge | (f >= least)
        for i in np.flatnonzero(good):
            yield [named[c] for c in heads[:, i]], int(f[i])
        keep = good[group]  # what no frequent phrase begins is in none that is longer
        rows, n, group = rows[:, keep], n[keep], group[keep]


def phrase_counts(docs: DataFrame, least: int = LEAST, window_range: int = RANGE, stretch: int = STRETCH) -> DataFrame:
    """lang, words, f: all phrases of up to LONGEST words with f >= least, and the empty one, whose f counts all words of the language. Written."""
    bounds = range_bounds(docs, window_range, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    runs = window_runs(docs, bounds, stretch)
    schema = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("f", pa.int64())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str], list[bytes]] = {}
        for batch in freeing(batches):
            for part, lang, run in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held.setdefault((part, lang), []).append(run)
        for (part, lang), each in held.items():
            out = [(lang, [w.decode() for w in words], f) for words, f in merged_counts(each, least, [words for at, words in bounds[max(0, part - 1) : part + 1] if at == lang])]
            yield pa.RecordBatch.from_pydict(dict(zip(("lang", "words", "f"), map(list, zip(*out, strict=True)), strict=True)), schema=schema)

    counted = runs.repartitionById(len(bounds) + 1, "part").mapInArrow(merge, "lang string, words array<string>, f long")
    counted = counted.groupBy("lang", "words").agg(F.sum("f").alias("f"))
    return materialize(counted.where((F.col("f") >= least) | (F.size("words") == 0)), "phrase_counts")


def stream_parts(counts: DataFrame) -> DataFrame:
    """lang, words, f, parts: counts as a sorted stream; parts[i] is the f of the first i words, for each i below the phrase's own length.

    A range of the stream lacks only the open path of its first row; these few counts, at most LONGEST a range, are looked up."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, open_, of = [], [], None
        for batch in batches:
            parts = []
            for lang, words, f in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                same = 0
                if lang == of:
                    while same < len(path) and same < len(words) and path[same] == words[same]:
                        same += 1
                    open_ = open_[: same + 1]
                else:
                    open_ = []
                open_ += [None] * (len(words) - len(open_))
                parts.append(open_[: len(words)])
                open_, path, of = [*open_[: len(words)], f], words, lang
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.list_(pa.int64()))], ["lang", "words", "f", "parts"])

    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = counts.select("lang", "words", "f").repartitionByRange(n, "lang", "words").sortWithinPartitions("lang", "words")
    stream = materialize(sorted_.mapInArrow(walk, "lang string, words array<string>, f long, parts array<long>"), "stream")
    lacking = stream.where(F.exists("parts", lambda x: x.isNull())).select("lang", F.explode(F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.when(F.element_at("parts", i + 1).isNull(), F.slice("words", F.lit(1), i)))).alias("words"))
    open_ = materialize(lacking.where("words IS NOT NULL").distinct().join(counts, ["lang", "words"]), "open_parts")
    for i in range(LONGEST):  # open_ is at most LONGEST rows a range, so it is small enough to broadcast
        held = open_.where(F.size("words") == i).select(F.col("lang").alias("of"), F.col("words").alias("start"), F.col("f").alias("found"))
        lacks = (F.size("parts") > i) & F.get("parts", F.lit(i)).isNull()
        stream = stream.join(F.broadcast(held), lacks & (F.col("lang") == F.col("of")) & (F.slice("words", 1, i) == F.col("start")), "left")
        stream = stream.select("lang", "words", "f", F.transform("parts", lambda x, at: F.when(at == F.lit(i), F.coalesce(x, "found")).otherwise(x)).alias("parts"))  # noqa: B023
    return stream


def exact_score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)), with products of up to 38 digits."""
    wide = lambda x: x.cast("decimal(19,0)")
    product = lambda x, y: (wide(x) * wide(y)).cast("decimal(38,0)")
    return F.call_function("div", product(1000 * a, n), product(left, right))


def phrases(counts: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score: every candidate that no longer one covers, of counts (lang, words, f; written)."""
    forward = stream_parts(counts)
    backward = stream_parts(counts.withColumn("words", F.reverse("words")))
    backward = backward.select("lang", F.reverse("words").alias("words"), "f", F.col("parts").alias("ends"))
    k = F.size("words")
    covers = lambda parts: (k > 2) & (F.element_at(parts, -1) == F.col("f"))
    covered = forward.where(covers("parts")).select("lang", F.slice("words", F.lit(1), k - 1).alias("words"))
    covered = covered.unionByName(backward.where(covers("ends")).select("lang", F.slice("words", F.lit(2), k - 1).alias("words")))
    both = forward.where(k > 1).join(backward.drop("f").hint("merge"), ["lang", "words"]).join(covered.distinct(), ["lang", "words"], "left_anti")
    n = F.element_at("parts", 1)
    cut = lambda i: F.struct(exact_score(F.col("f"), n, F.element_at("parts", i + 1), F.element_at("ends", k - i + 1)).alias("score"), i.alias("k"), F.element_at("parts", i + 1).alias("l"), F.element_at("ends", k - i + 1).alias("r"))
    best = both.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), n.alias("n"), F.array_min(F.transform(F.sequence(F.lit(1), k - 1), cut)).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases."""
    found = phrases(phrase_counts(docs, least))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
