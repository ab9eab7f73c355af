"""N-gram Jaccard join by T-occurrence search (DivideSkip), over inverted lists of word shingles.

1. Every text becomes its set of hashed shingles. Equal sets are one class, so exact copies cost nothing further.
2. Inverted lists: shingles go, packed, to hash buckets (their number follows the total). A bucket counts the classes
   on each of its lists and tells a class which of its shingles others have too. Shingles that more than about one in
   HEAVY_SHARE documents hold are found first, with counts added up before the shuffle; they do not enter the buckets
   but come last in every order. So a bucket's longest list has about a HEAVY_SHARE-th of the classes.
3. Two sets at the threshold share at least T = ceil(threshold * size) shingles. So of the size - T + 1 shingles on the
   shortest lists they share one at least; a class whose shortest lists hold nobody else has no partner. The others are
   grouped by these shared short lists into candidate groups (connected components). Sets so small that only an equal
   one can meet the threshold are not listed.
4. In each group, or in each pair of blocks of a large group, a T-occurrence search finds the links: short lists are
   merged, candidates that can still reach T are looked up in the long lists by binary search, and kept if the exact
   overlap meets the threshold. Classes that are already linked need no second link.
5. Components of the links give every document its class's smallest doc_id.

Shingles are compared by 46 to 63 bits of a 64-bit hash (three of a pair's must collide for a false link), classes by 63
bits of each of their shingles.

Defined results: lower case for A-Z only; a text of fewer words than a shingle is one shingle of all its words; null,
empty and blank texts have n_shingles 0 and are their own component; rows of an equal doc_id are rows of one component
if their texts link; null doc_id is passed over when the smallest is taken (a component of only those has null); other
columns are ignored by `link_documents` and kept by `keep_one`, whatever their names; no rows in, no rows out. `keep_one`
keeps one row of each component, that of the smallest doc_id (null last), then of the smallest hash of what it says.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import merge
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapane.llm.common import carried, freeing, materialize, row_key, text_of, without_held
from terrapane.llm.graph import components

WIDTH = 5
THRESHOLD = (75, 100)  # overlap of at least 75 / 100 of the union
HEAVY_SHARE = 1000
LEAST_HEAVY = 256
BUCKET_ROWS = 2_000_000
GROUP_ROWS = 2_000_000
EVEN_MEMBERS, MOST_EVEN = 64, 32  # groups are cut to blocks of so many classes, up to so many blocks; more only for GROUP_ROWS
LOW = 40  # bits of a shingle kept beside its bucket
SMALL_MERGE = 512
ROWS = 2_000  # documents read at a time
PART = 1 << 19  # bytes hashed at a time
_C = [np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15)]
_33 = np.uint64(33)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _33)) * _C[0]
    h = (h ^ (h >> _33)) * _C[1]
    return h ^ (h >> _33)


#: A 64-bit number for each place in a word (up to LONGEST) and byte; 0 for the six ASCII spaces.
LONGEST = 64
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BYTES = np.where(_SPACE, np.uint64(0), _mixed(np.arange(1, LONGEST * 256 + 1, dtype=np.uint64).reshape(LONGEST, 256) * _C[2])).ravel()


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of data begin, and a 64-bit hash of each: the sum of its bytes' numbers (longer words have a hash of their own)."""
    import xxhash

    codes = np.frombuffer(data, np.uint8)
    space = _SPACE[codes]
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    gaps = np.diff(np.r_[starts, len(codes)])
    place = np.arange(starts[0], len(codes)) - np.repeat(starts, gaps)
    hashes = np.add.reduceat(_BYTES[np.minimum(place, LONGEST - 1) * 256 + codes[starts[0] :]], starts - starts[0])
    for i in np.flatnonzero(gaps > LONGEST):
        word = data[starts[i] : starts[i] + gaps[i]].rstrip(b" \t\n\v\f\r")
        if len(word) > LONGEST:
            hashes[i] = xxhash.xxh3_64_intdigest(word)
    return starts, _mixed(hashes)


def shingle_sets(texts: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct 63-bit hashes of each text's shingles, one text after the other, and how many each has."""
    values, sizes = [], []
    for part in _parts(texts):
        for s in _shingles(part, width):
            values.append(s)
            sizes.append(len(s))
    return (np.concatenate(values) if values else np.empty(0, np.int64)), np.array(sizes, np.int64)


def _parts(texts: list[str]) -> Iterator[list[bytes]]:
    """Encoded texts, PART bytes or a text at a time. Lower-casing bytes changes A-Z only."""
    part, n = [], 0
    for t in texts:
        part.append(t.encode().lower())
        n += len(part[-1])
        if n >= PART:
            yield part
            part, n = [], 0
    if part:
        yield part


def _shingles(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    starts, h = word_hashes(b" ".join(texts))
    begin = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    n = np.diff(begin)
    # a shingle is a polynomial of its words' hashes in a constant, and mixed at the end
    sums = np.zeros(max(len(h) - width + 1, 0), np.uint64)
    for i in range(width):
        sums = sums * _C[2] + h[i : i + len(sums)]
    sums = (_mixed(sums) >> np.uint64(1)).astype(np.int64)
    for x, k in zip(begin.tolist(), n.tolist(), strict=False):
        if k >= width:
            s = sums[x : x + k - width + 1]
            s.sort()
            new = s[1:] != s[:-1]
            yield s if new.all() else s[np.r_[True, new]]
        else:
            short = np.full(min(k, 1), k, np.uint64)
            for j in range(x, x + k):
                short = _mixed(short * _C[2] + h[j : j + 1])
            yield (short >> np.uint64(1)).astype(np.int64)


def class_of(shingles: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(shingles.data) - (1 << 63)


def _classes(flat: np.ndarray, sizes: np.ndarray) -> list[int]:
    ends = np.cumsum(sizes).tolist()
    return [class_of(flat[y - n : y]) for y, n in zip(ends, sizes.tolist(), strict=True)]


def document_classes(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows (id, doc_id, text) to rows of two kinds: id, doc_id, n_shingles, class for each document; and shingle, n for shingles found in two or more classes of a batch."""

    schema = "id bigint, doc_id bigint, n_shingles bigint, class bigint, shingle bigint, n bigint"
    names = schema.replace(" bigint", "").split(", ")

    def table(n: int, columns: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], pa.int64()) if c in columns else pa.nulls(n, pa.int64()) for c in names], names=names)

    def run(batches):
        for batch in freeing(batches):
            for i in range(0, batch.num_rows, ROWS):
                b = batch.slice(i, ROWS)
                flat, sizes = shingle_sets(b.column(2).to_pylist(), width)
                classes = _classes(flat, sizes)
                yield table(b.num_rows, {"id": b.column(0), "doc_id": b.column(1), "n_shingles": sizes, "class": classes})
                first = np.zeros(len(sizes), bool)
                first[np.unique(np.array(classes, np.int64), return_index=True)[1]] = True
                found = np.sort(flat[np.repeat(first, sizes)])
                edges = np.flatnonzero(np.r_[True, found[1:] != found[:-1], True]) if len(found) else np.zeros(1, np.int64)
                n = np.diff(edges)
                if (n > 1).any():
                    yield table(int((n > 1).sum()), {"shingle": found[edges[:-1]][n > 1], "n": n[n > 1]})

    rows = rows.select(F.col("id").cast("long"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, schema)


def _pack(values: np.ndarray) -> bytes:
    """LOW bits of each, in LOW / 8 bytes."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : LOW // 8].tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) * 8 // LOW, 8), np.uint8)
    out[:, : LOW // 8] = np.frombuffer(packed, np.uint8).reshape(-1, LOW // 8)
    return out.view("<u8").ravel().astype(np.int64)


def inverted_rows(docs: DataFrame, buckets: int, heavy, width: int = WIDTH, threshold=THRESHOLD) -> DataFrame:
    """bucket, classes (packed), sizes, counts, shingles (packed): a batch's share of a bucket's lists. Buckets below 0 hold the heavy shingles of each class."""

    def run(batches):
        rare_last = heavy.value
        for b in (x.iloc[i : i + ROWS] for x in freeing(batches) for i in range(0, len(x), ROWS)):
            flat, sizes = shingle_sets(list(b["text"]), width)
            names = np.array(_classes(flat, sizes), np.int64)
            first = np.zeros(len(sizes), bool)
            first[np.unique(names, return_index=True)[1]] = True
            first &= sizes * (threshold[1] - threshold[0]) >= threshold[0]  # smaller sets link with equal ones only
            if not first.any():
                continue
            flat, names, sizes = flat[np.repeat(first, sizes)], names[first], sizes[first]
            owner = np.repeat(np.arange(len(names), dtype=np.int32), sizes)
            place = (flat >> LOW) % buckets
            if len(rare_last):
                at = np.minimum(np.searchsorted(rare_last, flat), len(rare_last) - 1)
                place = np.where(rare_last[at] == flat, -1 - names[owner] % buckets, place)
            # a stable sort of small numbers is a radix sort, and keeps the owners in order
            order = np.argsort(place.astype(np.int16) if buckets < 1 << 15 else place, kind="stable")
            flat, owner, place = flat[order], owner[order], place[order]
            edges = np.flatnonzero(np.r_[True, place[1:] != place[:-1], True])
            runs = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])])
            who, n = owner[runs], np.diff(np.r_[runs, len(owner)]).astype("<i4")
            of_edge = np.searchsorted(runs, edges)
            out = []
            for x, y, p, q in zip(edges.tolist(), edges[1:].tolist(), of_edge.tolist(), of_edge[1:].tolist(), strict=False):
                values = flat[x:y].astype("<i8").tobytes() if place[x] < 0 else _pack(flat[x:y])
                out.append((int(place[x]), names[who[p:q]].tobytes(), sizes[who[p:q]].astype("<i4").tobytes(), n[p:q].tobytes(), values))
            yield pd.DataFrame(out, columns=["bucket", "classes", "sizes", "counts", "shingles"])

    rows = docs.select(text_of().alias("text"))
    return rows.mapInPandas(run, "bucket bigint, classes binary, sizes binary, counts binary, shingles binary")


def shared_shingles(rows: DataFrame) -> DataFrame:
    """class, size, shingles, degrees (packed long and int arrays): for each class and bucket, its shingles that another class has too."""

    def heavy_of(b):
        out = {}
        for c, z, n, s in zip(b["classes"], b["sizes"], b["counts"], b["shingles"], strict=True):
            values, ends = np.frombuffer(s, "<i8"), np.cumsum(np.frombuffer(n, "<i4"))
            for who, size, x, y in zip(np.frombuffer(c, np.int64), np.frombuffer(z, "<i4"), np.r_[0, ends[:-1]], ends, strict=True):
                out[int(who)] = (int(who), int(size), (-1 - values[x:y]).tobytes(), np.full(y - x, 2**31 - 1, "<i4").tobytes())
        return pd.DataFrame(list(out.values()), columns=["class", "size", "shingles", "degrees"])

    def of_bucket(key, b):
        if key[0] < 0:
            return heavy_of(b)
        names, sizes, n = (np.concatenate([np.frombuffer(x, t) for x in b[c]]) for c, t in (("classes", np.int64), ("sizes", "<i4"), ("counts", "<i4")))
        # a class that several batches hold counts once
        once = np.zeros(len(names), bool)
        once[np.unique(names, return_index=True)[1]] = True
        low = np.concatenate([_unpack(s) for s in b["shingles"]])[np.repeat(once, n)]
        row = np.repeat(np.arange(int(once.sum()), dtype=np.int32), n[once])
        names, sizes = names[once], sizes[once]
        order = np.argsort(low)
        row, low = row[order], low[order]
        starts = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        n = np.diff(np.r_[starts, len(low)])
        degree = np.repeat(n, n)
        shared = degree > 1
        row, low, degree = row[shared], low[shared], degree[shared]
        order = np.argsort(row, kind="stable")
        row, degree = row[order], degree[order].astype("<i4")
        who, size = names[row], sizes[row]
        value = (int(key[0]) << LOW) + low[order]
        edges = np.flatnonzero(np.r_[True, who[1:] != who[:-1], True]) if len(who) else [0]
        out = [(int(who[x]), int(size[x]), value[x:y].tobytes(), degree[x:y].tobytes()) for x, y in zip(edges, edges[1:], strict=False)]
        return pd.DataFrame(out, columns=["class", "size", "shingles", "degrees"])

    return rows.groupBy("bucket").applyInPandas(of_bucket, "class bigint, size bigint, shingles binary, degrees binary")


def least_overlap(size: int, threshold=THRESHOLD) -> int:
    return -(-threshold[0] * size // threshold[1])


def candidate_classes(shared: DataFrame, threshold=THRESHOLD) -> DataFrame:
    """class, size, shingles (sorted, packed), firsts: classes that can have a partner, and which of their shared shingles are among the size - T + 1 on the shortest lists."""
    parts = shared.groupBy("class").agg(F.first("size").alias("size"), F.collect_list("shingles").alias("shingles"), F.collect_list("degrees").alias("degrees"))

    def run(batches):
        for b in freeing(batches):
            out = []
            for c, size, s, d in zip(b["class"], b["size"], b["shingles"], b["degrees"], strict=True):
                values, degree = np.frombuffer(b"".join(s), np.int64), np.frombuffer(b"".join(d), "<i4")
                room = size - least_overlap(size, threshold) + 1 - (size - len(values))
                if room > 0:
                    firsts = values[np.lexsort((values, degree))[:room]]
                    out.append((c, size, np.sort(values).tobytes(), firsts.tolist()))
            yield pd.DataFrame(out, columns=["class", "size", "shingles", "firsts"])

    return parts.mapInPandas(run, "class bigint, size bigint, shingles binary, firsts array<bigint>")


class Links:
    """T-occurrence search over a group's inverted lists; classes are numbered from 0."""

    def __init__(self, sizes: np.ndarray, sets: list[np.ndarray], threshold=THRESHOLD):
        self.sizes, self.sets, (self.a, self.b) = sizes, sets, threshold
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        flat, self.owner = flat[order], owner[order]
        self.values, self.starts = np.unique(flat, return_index=True)
        self.ends = np.r_[self.starts[1:], len(flat)]
        self.root = list(range(len(sets)))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.root[max(i, j)] = min(i, j)

    def search(self, i: int, among: np.ndarray) -> None:
        """Link i with each not yet linked j for which among[j] holds and the overlap suffices."""
        least = least_overlap(int(self.sizes[i]), (self.a, self.b))
        at = np.searchsorted(self.values, self.sets[i])
        order = np.argsort(self.ends[at] - self.starts[at], kind="stable")
        at = at[order]
        n_long = min(least - 1, len(at) - 1)  # each candidate is on a short list at least once
        short, long = at[: len(at) - n_long], at[len(at) - n_long :]
        lists = [self.owner[self.starts[k] : self.ends[k]] for k in short]
        if sum(map(len, lists)) <= SMALL_MERGE:
            merged = [(j, sum(1 for _ in g)) for j, g in groupby(merge(*(x.tolist() for x in lists)))]
            found, seen = (np.array(x, np.int64) for x in zip(*merged, strict=True))
        else:
            found, seen = np.unique(np.concatenate(lists), return_counts=True)
        n, m = self.sizes[found], int(self.sizes[i])
        need = -(-self.a * (n + m) // (self.a + self.b))  # overlap for the threshold: a * (n + m - overlap) <= b * overlap
        mine = self.find(i)
        good = (found != i) & among[found] & (self.b * np.minimum(n, m) >= self.a * np.maximum(n, m)) & (seen + n_long >= need)
        good &= np.fromiter((self.find(int(j)) != mine for j in found), bool, len(found))
        found, seen, need = found[good], seen[good], need[good]
        for done, k in enumerate(long):
            if not len(found):
                return
            on = self.owner[self.starts[k] : self.ends[k]]
            p = np.minimum(np.searchsorted(on, found), len(on) - 1)
            seen = seen + (on[p] == found)
            alive = seen + (n_long - done - 1) >= need
            if not alive.all():
                found, seen, need = found[alive], seen[alive], need[alive]
        for j in found:
            self.join(i, int(j))


def _search_group(b: pd.DataFrame, left: int, right: int, threshold=THRESHOLD) -> list[tuple[int, int]]:
    """(member, hub) of the links among a block, or between two blocks."""
    sets = [np.frombuffer(s, np.int64) for s in b["shingles"]]
    block, names = b["block"].to_numpy(), b["class"].to_numpy()
    links = Links(b["size"].to_numpy(), sets, threshold)
    other = block == right
    order = np.argsort(-links.sizes, kind="stable")
    for i in order[block[order] == left]:
        links.search(int(i), other)
    roots = [links.find(i) for i in range(len(sets))]
    size = np.bincount(roots, minlength=len(sets))
    return [(int(names[i]), int(names[r])) for i, r in enumerate(roots) if size[r] > 1]


def class_links(candidates: DataFrame, groups: DataFrame, threshold=THRESHOLD) -> DataFrame:
    """member, hub: classes that are linked with others, in groups of one hub each."""
    rows = candidates.join(groups.withColumnRenamed("member", "class"), "class").select("label", "class", "size", "shingles")
    rows = materialize(rows, "grouped")
    weigh = rows.groupBy("label").agg(F.ceil(F.sum(F.octet_length("shingles") / 8) / GROUP_ROWS).alias("full"), F.count(F.lit(1)).alias("members")).where("members > 1")
    blocks = F.greatest("full", F.least(F.lit(MOST_EVEN), F.ceil(F.col("members") / EVEN_MEMBERS)))
    weigh = materialize(weigh.select("label", blocks.alias("blocks")), "groups")
    rows = rows.join(weigh, "label").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")))
    # a block meets every block once: as (smaller, larger)
    pairs = F.transform(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")), lambda k: F.struct(F.least(k, F.col("block")).alias("left"), F.greatest(k, F.col("block")).alias("right")))
    rows = rows.withColumn("pair", F.explode(pairs))

    def of_group(key, b):
        return pd.DataFrame(_search_group(b, int(key[1]), int(key[2]), threshold), columns=["member", "hub"])

    keyed = rows.select("label", F.col("pair.left").alias("left"), F.col("pair.right").alias("right"), "class", "size", "shingles", "block")
    return keyed.groupBy("label", "left", "right").applyInPandas(of_group, "member bigint, hub bigint")


def linked(rows: DataFrame, width: int = WIDTH, threshold=THRESHOLD) -> DataFrame:
    """Rows (id, doc_id, text) to id, doc_id, n_shingles, label: equal for the rows of a component; null for a row without shingles."""
    spark = rows.sparkSession
    seen = materialize(document_classes(rows, width), "classes")
    own = seen.where("shingle IS NULL").select("id", "doc_id", "n_shingles", "class")
    total, n_docs = own.agg(F.sum("n_shingles"), F.count(F.lit(1))).first()
    buckets = max(64, math.ceil((total or 0) / BUCKET_ROWS))
    often = max(LEAST_HEAVY, n_docs // HEAVY_SHARE)
    # at most total / often rows: HEAVY_SHARE times the mean size of a set, whatever the number of documents
    heavy = seen.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") > often).select("shingle")
    known = spark.sparkContext.broadcast(np.sort(heavy.toPandas()["shingle"].to_numpy(np.int64)))
    shared = shared_shingles(inverted_rows(rows, buckets, known, width, threshold))
    candidates = materialize(candidate_classes(shared, threshold), "candidates")
    groups = components(candidates.select(F.col("class").alias("member"), F.explode("firsts").alias("hub")))
    links = class_links(candidates, groups, threshold)
    labels = components(links).select(F.col("member").alias("class"), "label")
    label = F.when(F.col("n_shingles") > 0, F.coalesce("label", "class")).alias("label")
    return materialize(own.join(labels, "class", "left").select("id", "doc_id", "n_shingles", label), "named")


def link_documents(docs: DataFrame, width: int = WIDTH, threshold=THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    named = linked(docs.select(F.lit(0).cast("long").alias("id"), "doc_id", "text"), width, threshold)
    least = materialize(named.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("component_id")), "least")
    found = named.where("label IS NOT NULL").join(least, "label").select("doc_id", "n_shingles", "component_id")
    return found.unionByName(named.where("label IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, width: int = WIDTH, threshold=THRESHOLD) -> DataFrame:
    """One row of docs for each component, and the rows without shingles; all columns stay. Rows are told apart by what they say; of rows equal in doc_id and text, that of the smallest hash of all columns stays."""
    rows = carried(docs, row_key("doc_id", "text").alias("key"))
    named = linked(docs.select(row_key("doc_id", "text").alias("id"), "doc_id", "text"), width, threshold)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "id"))
    one = named.where("label IS NOT NULL").groupBy("label").agg(first.alias("x")).select(F.col("x.id").alias("key"))
    kept = materialize(one.unionByName(named.where("label IS NULL").select(F.col("id").alias("key")).distinct()), "kept")
    gone = materialize(named.select(F.col("id").alias("key")).distinct().join(kept, "key", "left_anti"), "gone")
    out = without_held(rows, gone, "key")
    again = materialize(named.where("label IS NOT NULL").groupBy("id").count().where("count > 1").select(F.col("id").alias("key")).join(kept, "key", "left_semi"), "again")
    if again.limit(1).count() == 0:
        return out.select("row.*")
    least = out.join(again, "key", "left_semi").groupBy("key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return out.join(again, "key", "left_anti").select("row.*").unionByName(least.select("row.*"))
