"""Byte-level BPE encoding by per-prefix dynamic programming, and decoding.

For every prefix of a piece, BPE has one encoding, and so one last token. A token that ends at the prefix's end (found
by an Aho-Corasick automaton over the vocabulary) is that token exactly if the last token of the prefix before it may stand to
its left: no merge rule would have joined across the two earlier. Following the last tokens back gives the ids. The work
per piece is linear in its length for a bounded token length, so pieces of any length are whole. The new short pieces of
a batch of texts go through the automaton side by side, a byte of each in a step on arrays; longer pieces go one
at a time.

Defined results: null text is encoded as the empty text (no ids) and decodes to ''; the strings of added special tokens
in a text become their ids, as the library does by default; rows of an equal doc_id are encoded each on its own; other
columns are not read; no rows in, no rows out.
"""

from __future__ import annotations

import gc
import json
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import accumulate, chain, pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapane.llm.common import freeing, give_back, text_of

#: Fixed value: the pattern that splits text before merging.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MOST_CACHED = 200_000  # pieces; one batch or stretch may bring more
LONGEST_CACHED = 64  # characters of a piece; longer ones are encoded each time
BATCH_CHARS = 1_000_000
TOGETHER_CHARS = 400_000  # of new pieces that are encoded in the same steps
PAIR_BITS = 20  # of the number of places for tested pairs
START = -2  # in place of a last token, where a piece begins
NEVER = 1 << 30


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself where it prints, or else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class Memo(dict):
    """A cache of a function's results, bounded in entries."""

    def __init__(self, of, most: int):
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, key):
        out = self.of(key)
        if len(self) >= self.most:
            self.clear()
        self[key] = out
        return out


class Known:
    """Pieces with a place each, and the ids of each place."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.ids, self.ends = np.empty(0, np.int32), np.zeros(1, np.int64)

    def add(self, pieces: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        self.place.update(zip(pieces, range(len(self.ends) - 1, len(self.ends) - 1 + len(pieces)), strict=True))
        self.ids, self.ends = np.concatenate((self.ids, ids)), np.concatenate((self.ends, self.ends[-1] + np.cumsum(counts)))

    def forget_last(self, pieces: list[str]) -> None:
        for p in pieces:
            del self.place[p]
        self.ends = self.ends[: len(self.ends) - len(pieces)]
        self.ids = self.ids[: self.ends[-1]]

    def ids_of(self, places: np.ndarray) -> np.ndarray:
        counts = self.ends[places + 1] - self.ends[places]
        return self.ids[np.arange(counts.sum()) + np.repeat(self.ends[places] - (np.cumsum(counts) - counts), counts)]


@lru_cache(maxsize=2)
def token_bytes(path: str) -> dict[int, bytes]:
    """What each token decodes to: all that a decoding worker holds."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    to_byte = {c: b for b, c in enumerate(byte_alphabet())}
    own = {i: bytes(map(to_byte.__getitem__, t)) for t, i in spec["model"]["vocab"].items()}
    return own | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}


def decode_ids(ids, bytes_of: dict[int, bytes]) -> str:
    return b"".join(map(bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class Steps:
    """The Aho-Corasick automaton as arrays. longest: by state, the longest token that ends there; shorter: by token, the next shorter one that ends where it does, or -1."""

    def __init__(self, tokens: dict[str, int], n_ids: int):
        nodes = sorted({t[:k] for t in tokens for k in range(1, len(t) + 1)}, key=len)
        number = {"": 0} | {x: i for i, x in enumerate(nodes, 1)}
        to_byte = {c: b for b, c in enumerate(byte_alphabet())}
        parent = np.array([0, *(number[x[:-1]] for x in nodes)], np.int64)
        byte = np.array([0, *(to_byte[x[-1]] for x in nodes)], np.uint8)
        own = np.array([-1, *(tokens.get(x, -1) for x in nodes)], np.int32)
        self.alone = np.array([number.get(c, 0) for c in byte_alphabet()], np.int64)
        edges = parent << 8 | byte
        self.target = np.argsort(edges[1:]) + 1
        self.edges = np.append(edges[self.target], -1)  # the last is no edge
        self.fail = np.zeros(len(number), np.int64)
        self.longest, self.shorter = own.copy(), np.full(n_ids, -1, np.int32)
        depths = np.cumsum(np.bincount(np.fromiter(map(len, nodes), np.int64, len(nodes)))) + 1
        for a, b in pairwise(depths.tolist()):
            if a > depths[0]:
                self.fail[a:b] = np.where(parent[a:b] > 0, self.step(self.fail[parent[a:b]], byte[a:b]), 0)
            below = self.longest[self.fail[a:b]]
            known = own[a:b] >= 0
            self.longest[a:b] = np.where(known, own[a:b], below)
            self.shorter[own[a:b][known]] = below[known]

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        out = self.alone[byte]
        rest = np.flatnonzero(state)
        state = state[rest]
        while len(rest):
            edge = state << 8 | byte[rest]
            at = np.searchsorted(self.edges[:-1], edge)
            hit = self.edges[at] == edge
            out[rest[hit]] = self.target[at[hit]]
            rest, state = rest[~hit], self.fail[state[~hit]]
            rest, state = rest[state > 0], state[state > 0]
        return out


class Codec:
    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.split = regex.compile(PIECES).findall
        self.library_pieces = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.table = dict(enumerate(byte_alphabet()))
        self.rank: dict[tuple[int, int], int] = {}
        made: dict[int, tuple[int, int, int]] = {}  # token: left, right, rank
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.rank.setdefault(pair, r)
            made.setdefault(whole, (*pair, r))
        self._made = made
        self.left_side, self.right_side = Memo(self._left, 1 << 20), Memo(self._right, 1 << 20)
        self.fits = Memo(lambda k: self._meet(k >> 20, k & 0xFFFFF) and (k >> 20, k & 0xFFFFF) not in self.rank, 1 << 20)
        own = {i for t, i in vocab.items() if len(t) == 1}
        for t, (a, b, r) in sorted(made.items(), key=lambda x: x[1][2]):
            if a in own and b in own and self.rank[a, b] == r and self._meet(a, b):
                own.add(t)  # merging its bytes gives the token itself
        self.own = {t: i for t, i in vocab.items() if i in own and i not in self.special.values()}
        self.sizes = np.zeros(max(vocab.values()) + 1, np.int32)
        for t, i in self.own.items():
            self.sizes[i] = len(t)
        self.size_of = self.sizes.tolist()
        self.steps = Steps(self.own, len(self.sizes))
        self.pair_at, self.pair_fits = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        self.pieces_known = Known()
        self.odd, self.known = set(), set(map(chr, range(128)))

    def _left(self, t: int) -> tuple[tuple[int, int], ...]:
        """The tokens that stand first in t as it is merged, each with the rank of the merge that takes it up."""
        if t not in self._made:
            return ((t, NEVER),)
        a, _, r = self._made[t]
        return (*self.left_side[a][:-1], (a, r), (t, NEVER))

    def _right(self, t: int) -> tuple[tuple[int, int], ...]:
        if t not in self._made:
            return ((t, NEVER),)
        _, b, r = self._made[t]
        return (*self.right_side[b][:-1], (b, r), (t, NEVER))

    def _meet(self, a: int, b: int) -> bool:
        """Do a and b come to stand side by side: no merge joins parts of theirs across the border first? Among equal ranks the leftmost merge goes first."""
        xs, ys, i, j = self.right_side[a], self.left_side[b], 0, 0
        while True:
            (x, takes_x), (y, takes_y) = xs[i], ys[j]
            if i == len(xs) - 1 and j == len(ys) - 1:
                return True
            r = self.rank.get((x, y), NEVER)
            if r < takes_x and r <= takes_y:
                return False
            if takes_x <= takes_y:
                i += 1
            else:
                j += 1

    @cached_property
    def matches(self):
        """Of one string after another, the tokens that end at each character, longest first."""
        import ahocorasick

        auto = ahocorasick.Automaton()
        for t, i in self.own.items():
            auto.add_word(t, i)
        auto.make_automaton()
        return auto.iter

    def _encode_piece(self, piece: str) -> tuple[int, ...]:
        s = piece.encode().decode("latin-1").translate(self.table)
        if (whole := self.own.get(s)) is not None:
            return (whole,)
        last, size_of, fits = [-1] * (len(s) + 1), self.size_of, self.fits
        for end, token in self.matches(s):
            end += 1
            if last[end] >= 0:
                continue
            n = size_of[token]
            before = last[end - n]
            if n == end or before >= 0 and fits[before << 20 | token]:
                last[end] = token
        out, at = [], len(s)
        while at:
            out.append(last[at])
            at -= size_of[last[at]]
        return tuple(reversed(out))

    def _all_fit(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """fits of each pair. A pair has one place, which the last one tested there holds."""
        pair = before.astype(np.int64) << 20 | token
        place = (pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).view(np.int64)
        out = self.pair_fits[place]
        for i in np.flatnonzero(self.pair_at[place] != pair).tolist():
            key = int(pair[i])
            out[i] = self.pair_fits[place[i]] = self.fits[key]
            self.pair_at[place[i]] = key
        return out

    def _encode_together(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """What _encode_piece gives for each of the pieces, none of them empty: all ids, and how many each has."""
        raw = [p.encode() for p in pieces]
        long = np.fromiter(map(len, raw), np.int64, len(raw))
        order = np.argsort(-long, kind="stable")
        first = (np.cumsum(long) - long)[order]  # of a piece's bytes
        data, most = np.frombuffer(b"".join(raw), np.uint8), long[order]
        last = np.full(len(data) + len(raw), -1, np.int32)  # by prefix: a piece has one more of them than bytes
        begin = first + order
        last[begin] = START
        state = np.zeros(len(raw), np.int64)
        for at, n in enumerate((len(raw) - np.searchsorted(most[::-1], np.arange(most[0]), "right")).tolist()):
            state = self.steps.step(state[:n], data[first[:n] + at])
            token, end = self.steps.longest[state], begin[:n] + at + 1
            while len(end):
                before = last[end - self.sizes[token]]
                good = before == START
                inner = np.flatnonzero(before >= 0)
                good[inner] = self._all_fit(before[inner], token[inner])
                last[end[good]] = token[good]
                token, end = self.steps.shorter[token[~good]], end[~good]
                token, end = token[token >= 0], end[token >= 0]
        taken, ends = np.zeros(len(last), bool), begin + most
        while len(ends):
            taken[ends] = True
            ends = ends - self.sizes[last[ends]]
            ends = ends[last[ends] != START]
        return last[taken], np.diff(np.cumsum(taken)[np.cumsum(long + 1) - 1], prepend=0)

    def _learn(self, new: set[str]) -> list[str]:
        """Encode pieces that have no place yet. Returned are the last ones, which are too long to be kept."""
        known, part, chars, long = self.pieces_known, [], 0, []
        for p in new:
            if len(p) > LONGEST_CACHED:
                long.append(p)
                continue
            part.append(p)
            chars += len(p)
            if chars >= TOGETHER_CHARS:
                known.add(part, *self._encode_together(part))
                part, chars = [], 0
        if part:
            known.add(part, *self._encode_together(part))
        if long:
            ids = [self._encode_piece(p) for p in long]
            known.add(long, np.fromiter(chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int64))
        return long

    def _is_odd(self, c: str) -> bool:
        """Does the library class this character otherwise than the pattern does here (another Unicode version)?"""
        s = f"a{c}1!{c} {c}b"
        return [s[a:b] for _, (a, b) in self.library_pieces(s)] != self.split(s)

    def _plain_pieces(self, text: str) -> list[str]:
        if not text.isascii():
            chars = set(text)
            if new := chars - self.known:
                self.known |= new
                self.odd |= {c for c in new if self._is_odd(c)}
            if self.odd and chars & self.odd:
                return [text[a:b] for _, (a, b) in self.library_pieces(text)]
        return self.split(text)

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text; special strings in it are one each, and no other piece equals one."""
        if self.special_split is None or not any(s in text for s in self.special):
            return self._plain_pieces(text)
        return [x for i, p in enumerate(self.special_split(text)) for x in ((p,) if i % 2 else self._plain_pieces(p))]

    def _ids(self, split: list[list[str]]) -> list[np.ndarray]:
        """The ids of each list of pieces."""
        known = self.pieces_known
        places = [np.fromiter(map(known.place.get, x, repeat(-1)), np.int64, len(x)) for x in split]
        missing = [np.flatnonzero(x < 0).tolist() for x in places]
        new = {x[i] for x, at in zip(split, missing, strict=True) for i in at}
        if new and len(known.place) + len(new) > MOST_CACHED:
            known = self.pieces_known = Known()
            new, missing = set().union(*split), [range(len(x)) for x in split]
        specials = [x for x in self.special if x in new]
        known.add(specials, np.array([self.special[x] for x in specials], np.int32), np.ones(len(specials), np.int64))
        long = self._learn(new.difference(specials))
        for x, at, out in zip(split, missing, places, strict=True):
            out[at] = np.fromiter((known.place[x[i]] for i in at), np.int64, len(at))
        out = [known.ids_of(x) for x in places]
        known.forget_last(long)
        return out

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. A text of very many pieces goes in stretches of them."""
        split, of_text, last = [], [], None
        for text in texts:
            if text != last:  # copies that a mix takes stand together, and are encoded once
                split.append(self.pieces(text))
                last = text
            of_text.append(len(split) - 1)
        if sum(map(len, split)) <= BATCH_CHARS:
            own = self._ids(split)
        else:
            own = [np.concatenate([self._ids([x[i : i + BATCH_CHARS]])[0] for i in range(0, len(x) or 1, BATCH_CHARS)]) for x in split]
        return [own[i] for i in of_text]

    def encode(self, text: str) -> list[int]:
        return self.encode_texts([text])[0].tolist()

    def decode(self, ids) -> str:
        return decode_ids(ids, token_bytes(self.path))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One for each Python worker."""
    return Codec(path)


def forget() -> None:
    """At a task's end: the worker outlives it, and what it then holds of the vocabulary would stand beside the work of other stages. Reading the vocabulary again is a small part of the next task."""
    codec.cache_clear()
    token_bytes.cache_clear()
    gc.collect()
    give_back()


def _slices(batch: pa.RecordBatch, sizes) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about BATCH_CHARS, a row at least."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > BATCH_CHARS:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n or 0
    if begin < batch.num_rows:
        yield batch.slice(begin)


def _encoded(c: Codec, texts: list[str]) -> pa.ListArray:
    ids = c.encode_texts(texts)
    ends = np.cumsum([0, *map(len, ids)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))


def _decoded(lists: pa.ListArray, bytes_of) -> pa.StringArray:
    flat = lists.flatten().to_numpy().tolist()
    ends = list(accumulate(pc.list_value_length(lists).to_pylist(), initial=0))
    return pa.array([decode_ids(flat[a:b], bytes_of) for a, b in zip(ends, ends[1:], strict=False)], pa.string())


def _text_parts(batches) -> Iterator[pa.RecordBatch]:
    for batch in freeing(batches):
        yield from _slices(batch, pc.binary_length(batch.column(1)).to_pylist())


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int); other columns are left out."""

    def run(batches):
        c = codec(path)
        for part in _text_parts(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), _encoded(c, part.column(1).to_pylist())], names=["doc_id", "ids"])
        del c
        forget()

    rows = docs.select("doc_id", text_of().alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, text."""

    def run(batches):
        bytes_of = token_bytes(path)
        for batch in freeing(batches):
            for part in _slices(batch, (4 * n for n in pc.list_value_length(batch.column(1)).to_pylist())):
                lists = part.column(1)
                yield pa.RecordBatch.from_arrays([part.column(0), lists, _decoded(lists, bytes_of)], names=["doc_id", "ids", "text"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, text as decode(encode(docs)) has them: one worker of a task does both, where two would hold the vocabulary side by side."""

    def run(batches):
        c, bytes_of = codec(path), token_bytes(path)
        for part in _text_parts(batches):
            lists = _encoded(c, part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), lists, _decoded(lists, bytes_of)], names=["doc_id", "ids", "text"])
        del c, bytes_of
        forget()

    rows = docs.select("doc_id", text_of().alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")


def bpe_digest(decoded: DataFrame) -> DataFrame:
    """What the query op3 returns."""
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256")
    )
