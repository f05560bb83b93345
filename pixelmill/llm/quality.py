"""Document quality by a vote of nearest neighbours in a latent-semantic space.

Terms are n-grams of character shapes (letter case, digits, each punctuation mark; runs of letters and digits as one)
and words repeated at short distance, hashed to ``TERMS`` columns, so that they describe how a text is written in any
language. A bounded sample of labelled rows gives the inverse document frequencies, the latent space (truncated singular
value decomposition) and the labelled vectors. The labelled vectors, whose number is bounded by ``FIT_ROWS``, go to every
task; every document is compared with all of them, block by block, and the labels of the ``NEIGHBOURS`` most similar
ones vote, weighted by their similarity.

Only rows whose crc32(doc_id as text) modulo 3 is not 1 give labels. Inputs of a score: the text alone. A labelled row of the same
text has no vote, so that no document's own label is part of its score; such rows are told by a 64-bit hash of the text.

Defined cases: null and empty texts have no terms and get the share of label 1 in the sample; without any labelled row
every score is 0.5; a key with several labels counts with the least, and one of several texts with the least terms;
labelled keys without a document, and null labels, do not count; a null key is not held out; extra columns are carried; columns named as an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import shared, tokens

#: Most labelled rows that the model is fitted on (those with the least hash of their key).
FIT_ROWS = 4000
TERMS, LATENT, NEIGHBOURS = 2048, 48, 15
#: Similarities are raised to this power before they vote.
SHARPNESS = 6

#: Shapes of bytes: 0 ends a document, 1 lower case (and all beyond ASCII), 2 upper case, 3 digits, 4 white space, 5 line
#: feed, then each punctuation mark.
SHAPES = np.full(256, 1, np.uint8)
SHAPES[:128] = 4
SHAPES[ord("A") : ord("Z") + 1], SHAPES[ord("a") : ord("z") + 1], SHAPES[ord("0") : ord("9") + 1] = 2, 1, 3
SHAPES[10] = 5
_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
SHAPES[_MARKS] = np.arange(6, 6 + len(_MARKS))
#: Terms that count repeated words stand in the last columns.
REPEATS = 3
_BYTES = np.random.default_rng(5).integers(1, 1 << 62, 256, dtype=np.int64)


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def counts(texts: list[bytes]) -> np.ndarray:
    """The term counts of texts, a row a text."""
    n = len(texts)
    raw = np.frombuffer(b"\x00".join([*(t.replace(b"\x00", b" ") for t in texts), b""]), np.uint8)
    s = SHAPES[raw]
    s[raw == 0] = 0
    doc = np.cumsum(raw == 0) - (raw == 0)
    out = np.zeros(n * TERMS)
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (s[1:] > 3) | (s[1:] == 0)
    c, d = s[keep].astype(np.uint32), doc[keep]
    columns = TERMS - REPEATS
    for size in range(1, min(4, len(c)) + 1):
        code = np.zeros(len(c) - size + 1, np.uint32)
        whole = np.ones(len(code), bool)
        for i in range(size):
            part = c[i : len(c) - size + 1 + i]
            code = code * np.uint32(0x9E3779B1) + part
            whole &= part != 0
        code = ((code * np.uint32(0x85EBCA6B)) >> np.uint32(7)) % np.uint32(columns)
        out += np.bincount((d[: len(code)] * TERMS + code)[whole], minlength=n * TERMS)
    begin = np.flatnonzero((s[1:] < 4) & (s[1:] > 0) & ((s[:-1] >= 4) | (s[:-1] == 0))) + 1
    if len(s) and 0 < s[0] < 4:
        begin = np.insert(begin, 0, 0)
    if len(begin):
        own = np.where((s < 4) & (s > 0), _BYTES[raw], 0)
        word, of = np.add.reduceat(own, begin), doc[begin]
        for gap in range(1, REPEATS + 1):
            same = (word[gap:] == word[:-gap]) & (of[gap:] == of[:-gap])
            out += np.bincount(of[gap:][same] * TERMS + columns + gap - 1, minlength=n * TERMS)
    return out.reshape(n, TERMS)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


@dataclass
class Model:
    """What scoring needs: (TERMS, LATENT) projection with the frequencies in it, labelled vectors, their labels and their
    texts' hashes."""

    idf: np.ndarray
    space: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    hashes: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray, hashes: np.ndarray) -> Model:
        seen = x.sum(1) > 0
        idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
        rows = _unit(np.log1p(x) * idf)
        rng = np.random.default_rng(11)
        q = rng.standard_normal((rows.shape[1], min(LATENT + 16, len(rows)))).astype(np.float32)
        for _ in range(6):  # power iterations towards the leading right singular vectors
            q, _ = np.linalg.qr(rows.T @ (rows @ q))
        _, _, turn = np.linalg.svd(rows @ q, full_matrices=False)
        space = (q @ turn.T)[:, :LATENT].astype(np.float32)
        return cls(idf, space, _unit(rows @ space)[seen], labels[seen].astype(np.float32), hashes[seen]) if len(x) else cls.blank()

    @classmethod
    def blank(cls) -> Model:
        return cls(np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32), np.zeros(0, np.uint64))

    def score(self, x: np.ndarray, hashes: np.ndarray, block: int = 512) -> np.ndarray:
        prior = float(self.labels.mean()) if len(self.labels) else 0.5
        out, k = np.full(len(x), prior), min(NEIGHBOURS, len(self.labels))
        for i in range(0, len(x) if k else 0, block):
            own = _unit((np.log1p(x[i : i + block]).astype(np.float32) * self.idf) @ self.space)
            near = own @ self.vectors.T
            for j in np.flatnonzero(np.isin(hashes[i : i + block], self.hashes)):
                near[j, self.hashes == hashes[i + j]] = -1
            best = np.argpartition(near, -k, axis=1)[:, -k:]
            weight = np.clip(np.take_along_axis(near, best, 1), 0, 1).astype(float) ** SHARPNESS
            total = weight.sum(1)
            votes = (weight * self.labels[best]).sum(1)
            out[i : i + block] = np.divide(votes, total, out=np.full(len(total), prior), where=total > 1e-9)
        return np.clip(out, 0, 1)


def _bytes(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _hashes(texts: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, texts), np.uint64, len(texts))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = FIT_ROWS) -> Model:
    """The model of at most ``most`` labelled rows outside the held-out ones."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("key")).agg(F.min(label).alias("label"))
    sample = known.orderBy(F.xxhash64("key"), "key").limit(most)
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(sample), "key")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tokens.slices(batch, "text", 1 << 20):
                for i in range(0, piece.num_rows, 1024):
                    part = piece.slice(i, 1024)
                    texts = _bytes(part.column("text"))
                    # The text's hash stands behind its terms.
                    rows = [r.tobytes() + h.tobytes() for r, h in zip(counts(texts).astype("<f4"), _hashes(texts).astype("<u8"), strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column("key").cast(pa.int64()), part.column("label").cast(pa.float64()), pa.array(rows, pa.binary())], names=["key", "label", "x"])

    # One row a key, of whatever rows share it, so that no more than ``most`` go to the driver.
    rows = own.select("key", "label", "text").mapInArrow(shared.lean(task), "key long, label double, x binary").groupBy("key", "label").agg(F.min("x").alias("x")).toArrow()
    if not rows.num_rows:
        return Model.blank()
    order = np.argsort(rows["key"].to_numpy(), kind="stable")
    held = np.frombuffer(b"".join(rows["x"].to_pylist()), np.uint8).reshape(-1, 4 * TERMS + 8)[order]
    x, hashes = held[:, : 4 * TERMS].copy().view("<f4"), held[:, 4 * TERMS :].copy().view("<u8")[:, 0]
    return Model.fit(x, rows["label"].to_numpy()[order], hashes)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1)."""
    docs = docs.drop("score")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tokens.slices(batch, text, 1 << 20):
                for i in range(0, piece.num_rows, 1024):
                    part = piece.slice(i, 1024)
                    texts = _bytes(part.column(text))
                    found = sent.value.score(counts(texts).astype(np.float32), _hashes(texts))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64())], names=[*part.schema.names, "score"])

    return docs.mapInArrow(shared.lean(task), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with held_out, score and predicted."""
    model = fit(docs, labels, key, text, **options)
    out = score(docs.drop("held_out", "predicted"), model, text)
    return out.withColumn("held_out", held_out(F.col(key))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: the documents' quality."""
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, shared.table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
