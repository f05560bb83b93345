"""Harmonic packing of token ids into sequences of fixed capacity.

Lengths fall into reciprocal-capacity classes: class k holds lengths over capacity/(k+1) and up to capacity/k, and a
bin of class k takes k pieces, never more or fewer, so every worker fills its bins on its own as documents come by. Long
documents are cut first: into whole sequences, and what is left into halves, quarters and so on of the capacity, which
fill the bins of their classes without padding, until a rest of at most capacity/16 is left, whose class wastes least.
The bins that are still open when a worker's rows end are packed together, longest piece first.

A sequence of 2^n ids needs no padding, so pieces of whole powers of two lose nothing even where their bin stays open.

Defined cases: null and empty texts are documents of the end id alone; rows that are equal are packed each; an empty
table gives no pieces; other columns are not carried.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import shared, tokens

CAPACITY = 1024
#: Rests of up to capacity / GRAIN are not cut further.
GRAIN = 16
#: A worker numbers its sequences from its partition times this.
PER_PART = 1 << 36
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def cuts(n: int, capacity: int = CAPACITY, grain: int = GRAIN) -> list[int]:
    """The lengths of the pieces of a document of ``n`` ids, in order."""
    whole, rest = divmod(n, capacity)
    out, half = [capacity] * whole, capacity // 2
    while rest > capacity // grain:
        if rest >= half:
            out.append(half)
            rest -= half
        half //= 2
    return out + [rest] * (rest > 0)


class Bins:
    """Online harmonic bins: ``add`` returns the pieces of each sequence that it closes."""

    def __init__(self, first: int, capacity: int = CAPACITY) -> None:
        self.capacity, self.next, self.open = capacity, first, defaultdict(list)

    def _close(self, pieces: list[tuple]) -> list[tuple]:
        sequence, at, out = self.next, 0, []
        for p in pieces:
            out.append((*p, sequence, at))
            at += p[2]
        self.next += 1
        return out

    def add(self, piece: tuple) -> list[tuple]:
        k = self.capacity // piece[2]
        own = self.open[k]
        own.append(piece)
        return self._close(self.open.pop(k)) if len(own) == k else []

    def rest(self) -> Iterator[tuple]:
        """What the open bins hold, packed together: each piece, longest first, goes to the first sequence with room."""
        left = sorted((p for pieces in self.open.values() for p in pieces), key=lambda p: -p[2])
        self.open.clear()
        sequences: list[tuple[int, list]] = []
        for p in left:
            i = next((i for i, (used, _) in enumerate(sequences) if used + p[2] <= self.capacity), len(sequences))
            if i == len(sequences):
                sequences.append((0, []))
            sequences[i] = (sequences[i][0] + p[2], sequences[i][1])
            sequences[i][1].append(p)
        for _, pieces in sequences:
            yield from self._close(pieces)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): a row a piece, ids as little-endian u32."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, bins = tokens.encoder(tokenizer or tokens.default_path()), Bins(TaskContext.get().partitionId() * PER_PART, capacity)

        def rows(done: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*done, strict=True))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            for piece in tokens.slices(batch, "text"):
                flat, lens = tokens.ends(*enc.encode(piece.column("text")))
                raw, at, done = flat.astype("<u4").tobytes(), 0, []
                for doc, n in zip(piece.column("key").to_pylist(), lens.tolist(), strict=True):
                    start = 0
                    for size in cuts(n, capacity):
                        done += bins.add((doc, start, size, raw[4 * (at + start) : 4 * (at + start + size)], n))
                        start += size
                    at += n
                if done:
                    yield rows(done)
        if done := list(bins.rest()):
            yield rows(done)

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(shared.lean(task), SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: the documents' pieces."""
    out = pack(shared.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
