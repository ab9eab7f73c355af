"""Token counts of whole texts, huge ones by overlapping chunks that are spliced where their encodings provably agree.

A border between two characters is stable if no vocabulary piece holds the two side by side: no merge can ever join
across it, so what stands on either side cannot change the tokens of the other. Each chunk of a huge text overlaps the
one before; both encodings come with character offsets, and they are spliced at the last stable border in the overlap
that is a token border of both. Where the overlap has none it is widened to the last stable border of the chunk, and
where the chunk has none it grows beyond the next one of the text. Borders are looked for in the text itself, so nothing
is encoded again and again in search of one.

Defined results: null text counts as empty (0 bytes, 0 tokens); strings of special tokens in a text are ordinary text,
as the library's default is; rows of an equal doc_id are counted each on its own; other columns are not read; no rows
in, no rows out.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapane.llm.bpe import _slices
from terrapane.llm.common import text_of

CHUNK = 32_768
OVERLAP = 512
LIMIT = 4096
SPACE = "▁"  # how the vocabulary writes a space


class Counter:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i)))
        self.inside = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}

    def stable(self, text: str, at: int) -> bool:
        """Both sides are plain characters that normalisation leaves alone, and no piece holds them side by side."""
        pair = text[at - 1 : at + 1].replace(" ", SPACE)
        return pair not in self.inside and all(c == SPACE or "!" <= c <= "~" or "À" <= c <= "ɏ" for c in pair)

    def offsets(self, text: str, begin: int, end: int) -> list[int]:
        """Where the tokens of text[begin:end] begin in text."""
        return [begin + a for a, _ in self.model.encode(text[begin:end], return_type="offset_mapping")["offsets"]]

    def last_stable(self, text: str, low: int, high: int) -> int | None:
        """The last stable border after low and before high."""
        return next((x for x in range(high - 1, low, -1) if self.stable(text, x)), None)

    def next_stable(self, text: str, low: int) -> int:
        """The first stable border from low on, or else the end."""
        return next((x for x in range(low, len(text)) if self.stable(text, x)), len(text))

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        n = len(text)
        if n <= chunk:
            return len(self.model.encode(text))
        total, cut, begin, end = 0, 0, 0, chunk
        left = self.offsets(text, begin, end)
        while end < n:
            near = self.last_stable(text, cut, end)
            if near is None:  # the chunk grows
                end = min(n, max(self.next_stable(text, end) + overlap, 2 * end - begin))
                left = self.offsets(text, begin, end)
                continue
            start = max(cut, min(end - min(overlap, chunk // 2), near - overlap))
            stop = min(n, max(end, start + chunk) + overlap)
            right = self.offsets(text, start, stop)
            both = set(left).intersection(right)
            at = next((x for x in sorted(both, reverse=True) if start < x < end and x > cut and self.stable(text, x)), None)
            if at is None:
                end = n
                left = self.offsets(text, begin, end)
                continue
            total += sum(cut <= x < at for x in left)
            cut, left, begin, end = at, right, start, stop
        return total + sum(x >= cut for x in left)

    def counts(self, texts: list[str]) -> list[int]:
        """Whole encodings for texts of a chunk at most, spliced ones for longer ones."""
        short = iter(self.model.encode([t for t in texts if len(t) <= CHUNK], num_threads=1))
        return [len(next(short)) if len(t) <= CHUNK else self.count(t) for t in texts]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One for each Python worker."""
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""

    def run(batches):
        c = counter(path)
        for batch in batches:
            for part in _slices(batch, pa.compute.binary_length(batch.column(1)).to_pylist()):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(c.counts(part.column(1).to_pylist()), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", text_of().alias("text"), F.octet_length(text_of()).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
