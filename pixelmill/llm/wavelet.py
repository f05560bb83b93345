"""Token ids in wavelet-matrix files: one succinct, compressed file a shard, with access, rank, select and counting.

A shard holds the ids of consecutive documents. The ids stand as 16 bit-planes, most significant first, each plane
ordered by the planes above it (zeros before ones), which is the wavelet matrix; a plane's ranks are kept for every
1,024 bits. Planes are compressed in pieces of ``PIECE`` bits, so that a look-up inflates only the pieces that it visits.
File layout, all integers little-endian:

    b"PMWM"  u16 version  u16 planes  u64 tokens  u64 documents  u64 tokens of the partition before this shard
    then blocks, each u64 length and a Zstandard frame:
      document keys (i64), key-is-null flags (u8), tokens of each document (u32),
      lengths of all pieces (u32), and for each plane: its ranks (u32)
    then the pieces, plane after plane, each a Zstandard frame of packed bits (u8)

Defined cases: null and empty texts are documents of the end id alone; null keys come first; rows of equal keys stand
next to each other, ordered by a hash of their text (rows equal in both are interchangeable, and share a range of the
order); an empty table gives no files and no rows; a vocabulary of over 65,536 ids is an error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import shared, tokens

PLANES, STEP, PIECE = 16, 1024, 1 << 16
HEAD = struct.Struct("<4sHHQQQ")
#: Ids in a shard, before the document that fills it ends: a file of some 8 MB.
SHARD_IDS = 1 << 22
#: Bytes of text in a range of the order on average, and most ranges.
RANGE_BYTES, RANGES = 16 << 20, 1 << 16


class WaveletMatrix:
    """Access, rank, select, count and places of ids, from bit-planes alone. ``piece(k, j)``: piece j of plane k, packed."""

    def __init__(self, n: int, piece: Callable[[int, int], np.ndarray], ranks: Sequence[np.ndarray]) -> None:
        self.n, self.piece, self.ranks = n, piece, ranks
        self.zeros = [n - int(r[-1]) for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        x, bits, ranks = np.asarray(ids, dtype="<u2"), [], []
        for level in range(PLANES - 1, -1, -1):
            one = (x >> level) & 1 != 0
            packed = np.packbits(one, bitorder="little")
            whole = np.zeros(-(-max(len(x), 1) // STEP) * STEP // 8, np.uint8)
            whole[: len(packed)] = packed
            ranks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(whole.view("<u8")).reshape(-1, STEP // 64).sum(1))]).astype("<u4"))
            bits.append(packed)
            x = np.concatenate((np.compress(~one, x), np.compress(one, x)))
        return cls(len(x), lambda k, j: bits[k][j * PIECE // 8 : (j + 1) * PIECE // 8], ranks)

    def pieces(self) -> int:
        """Pieces of a plane."""
        return -(-self.n // PIECE)

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane upwards."""
        x = np.zeros(self.n, "<u2")
        for k in range(PLANES - 1, -1, -1):
            bits = np.concatenate([self.piece(k, j) for j in range(self.pieces())]) if self.n else np.zeros(0, np.uint8)
            one = np.unpackbits(bits, count=self.n, bitorder="little").view(bool)
            up = np.empty_like(x)
            up[~one] = x[: self.zeros[k]]
            up[one] = x[self.zeros[k] :] | (1 << (PLANES - 1 - k))
            x = up
        return x

    def _bit(self, k: int, i: int) -> int:
        return self.piece(k, i // PIECE)[i % PIECE >> 3] >> (i & 7) & 1

    def _ones(self, k: int, i: int) -> int:
        """Ones among the first ``i`` bits of plane ``k``."""
        step, out = i // STEP, int(self.ranks[k][i // STEP])
        if i % STEP:
            begin = step * STEP % PIECE // 8
            part = self.piece(k, i // PIECE)[begin : begin + (i % STEP + 7) // 8].copy()
            if i & 7:
                part[-1] &= (1 << (i & 7)) - 1
            out += int(np.bitwise_count(part).sum())
        return out

    def access(self, i: int) -> int:
        out = 0
        for k in range(PLANES):
            b, ones = self._bit(k, i), self._ones(k, i)
            out, i = out << 1 | int(b), self.zeros[k] + ones if b else i - ones
        return out

    def _range(self, token: int, i: int, j: int) -> tuple[int, int]:
        for k in range(PLANES):
            a, b = self._ones(k, i), self._ones(k, j)
            i, j = (self.zeros[k] + a, self.zeros[k] + b) if token >> (PLANES - 1 - k) & 1 else (i - a, j - b)
        return i, j

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """How often a token occurs in [start, stop)."""
        i, j = self._range(token, start, self.n if stop is None else stop)
        return j - i

    def rank(self, token: int, i: int) -> int:
        return self.count(token, 0, i)

    def select(self, token: int, nth: int) -> int:
        """The place of the nth occurrence (from 0); IndexError if there are fewer."""
        i, j = self._range(token, 0, self.n)
        if not 0 <= nth < j - i:
            raise IndexError(nth)
        at = i + nth
        for k in range(PLANES - 1, -1, -1):
            at = self._find(k, at - self.zeros[k], 1) if token >> (PLANES - 1 - k) & 1 else self._find(k, at, 0)
        return at

    def _find(self, k: int, nth: int, bit: int) -> int:
        """Where the nth bit (from 0) of that value stands in plane ``k``."""
        before = self.ranks[k].astype(np.int64)
        if not bit:
            before = np.arange(len(before)) * STEP - before
        step = int(np.searchsorted(before, nth, "right")) - 1
        begin = step * STEP % PIECE // 8
        block = np.unpackbits(self.piece(k, step * STEP // PIECE)[begin : begin + STEP // 8], bitorder="little")
        return step * STEP + int(np.flatnonzero(block == bit)[nth - int(before[step])])

    def places(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]


def dump(ids: np.ndarray, keys: list, lens: np.ndarray, before: int) -> bytes:
    """A file of one shard."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    wm = WaveletMatrix.build(ids)
    pieces = [pack(wm.piece(k, j).tobytes()) for k in range(PLANES) for j in range(wm.pieces())]
    blocks = [np.array([k or 0 for k in keys], "<i8"), np.array([k is None for k in keys], np.uint8), lens.astype("<u4"), np.array([len(p) for p in pieces], "<u4"), *wm.ranks]
    packed = [pack(np.ascontiguousarray(b).tobytes()) for b in blocks]
    return HEAD.pack(b"PMWM", 2, PLANES, len(ids), len(keys), before) + b"".join(struct.pack("<Q", len(p)) + p for p in packed) + b"".join(pieces)


def load(data: bytes) -> tuple[WaveletMatrix, list, np.ndarray, int]:
    """The matrix, which inflates pieces as it needs them, the document keys, the ids of each document, and the ids of the
    partition before this shard."""
    import zstandard

    magic, version, planes, n, docs, before = HEAD.unpack_from(data)
    if (magic, version, planes) != (b"PMWM", 2, PLANES):
        raise ValueError("not a wavelet-matrix file")
    unpack, at, blocks = zstandard.ZstdDecompressor().decompress, HEAD.size, []
    for _ in range(4 + PLANES):
        if at + 8 > len(data):
            raise ValueError("a wavelet-matrix file is cut short")
        (size,) = struct.unpack_from("<Q", data, at)
        blocks.append(unpack(data[at + 8 : at + 8 + size]))
        at += 8 + size
    keys = [None if null else int(k) for k, null in zip(np.frombuffer(blocks[0], "<i8"), np.frombuffer(blocks[1], np.uint8), strict=True)]
    lens, sizes = np.frombuffer(blocks[2], "<u4").astype(np.int64), np.frombuffer(blocks[3], "<u4").astype(np.int64)
    ends = at + np.cumsum(sizes)
    each = -(-n // PIECE)
    if len(keys) != docs or lens.sum() != n or len(sizes) != PLANES * each or (ends[-1] if n else at) != len(data):
        raise ValueError("a wavelet-matrix file's lengths disagree")

    @lru_cache(maxsize=PLANES * 4)
    def piece(k: int, j: int) -> np.ndarray:
        p = k * each + j
        return np.frombuffer(unpack(data[ends[p] - sizes[p] : ends[p]]), np.uint8)

    return WaveletMatrix(n, piece, [np.frombuffer(b, "<u4") for b in blocks[4:]]), keys, lens, before


def in_order(docs: DataFrame) -> DataFrame:
    """(key, text) in ascending order over the partitions, about ``RANGE_BYTES`` of text in each. Ranges are of keys and
    hashes of the text, so the rows of one key are not one range."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    hashed = docs.withColumn("hash", F.xxhash64("text"))
    return hashed.repartitionByRange(min(RANGES, max(1, -(-size // RANGE_BYTES))), "key", "hash").sortWithinPartitions("key", "hash").select("key", "text")


def write(docs: DataFrame, path: str, tokenizer: str | None = None, shard_ids: int = SHARD_IDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes ``path/part-P-S-ATTEMPT.wm`` in ascending key order; returns (name, part, shard, docs, ids, held), a row a file,
    already done; ``held``: a bit for each id that the file holds. Files are named by attempt, so those that a lost one left
    behind are in no manifest."""
    spark = docs.sparkSession
    shared.make_dirs(spark, path)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        enc, part, attempt = tokens.encoder(tokenizer or tokens.default_path()), TaskContext.get().partitionId(), uuid.uuid4().hex
        ids, keys, lens, held, before, done = [], [], [], 0, 0, []

        def close() -> None:
            nonlocal held, before
            if keys:
                name = f"part-{part:06d}-{len(done):06d}-{attempt}.wm"
                every = np.concatenate(ids)
                shared.write_bytes(f"{path}/{name}", dump(every, keys, np.array(lens), before))
                there = np.zeros(1 << PLANES, np.uint8)
                there[every] = 1
                done.append((name, part, len(done), len(keys), held, np.packbits(there, bitorder="little").tobytes()))
                before, held = before + held, 0
                ids.clear(), keys.clear(), lens.clear()

        for batch in batches:
            for piece in tokens.slices(batch, "text"):
                flat, n = tokens.ends(*enc.encode(piece.column("text")))
                own, at, pos = piece.column("key").to_pylist(), 0, np.concatenate([[0], np.cumsum(n)])
                while at < len(own):
                    # as many documents as the shard takes, the one that fills it included
                    to = min(int(np.searchsorted(pos, pos[at] + shard_ids - held, "left")), len(own))
                    to = max(to, at + 1)
                    ids.append(flat[pos[at] : pos[to]])
                    keys += own[at:to]
                    lens += n[at:to].tolist()
                    held += int(pos[to] - pos[at])
                    at = to
                    if held >= shard_ids:
                        close()
        close()
        cols = list(zip(*done, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:5]), pa.array(cols[5], pa.binary())], names=["name", "part", "shard", "docs", "ids", "held"])

    ordered = in_order(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")))
    return shared.cut(ordered.mapInArrow(shared.lean(task), "name string, part long, shard long, docs long, ids long, held binary"), "shards")[0]


def starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``, the ids of all documents before each file."""
    # A row for each range of the writing job; then the files of a range, one after another.
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("n"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = parts.select("part", before("n", Window.orderBy("part")).alias("base"))
    own = manifest.withColumn("own", before("ids", Window.partitionBy("part").orderBy("shard")))
    return own.join(base, "part").withColumn("start", F.col("base") + F.col("own")).drop("base", "own")


def holding(manifest: DataFrame, ids: list[int]) -> DataFrame:
    """The files that hold one of the ids at least."""
    bit = lambda t: F.shiftright(F.conv(F.hex(F.substring("held", t // 8 + 1, 1)), 16, 10).cast("int"), t % 8).bitwiseAND(F.lit(1)) == 1
    has = F.lit(False)
    for t in ids:
        has = has | bit(t) if 0 <= t < 1 << PLANES else has
    return manifest.where(has)


def _each(spark, path: str, files: DataFrame, schema: str, work: Callable) -> DataFrame:
    """The batches that ``work(matrix, keys, lens, start)`` yields for each of the files (name, start), which tasks read by their
    names: no other file is opened, and none passes a shuffle."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist(), strict=True):
                wm, keys, lens, _ = load(shared.read_bytes(f"{path}/{name}"))
                yield from work(wm, keys, lens, start)

    named, _ = shared.cut(files.select("name", "start"), "names")
    dealt = named.repartition(min(RANGES, max(1, named.count())))  # a number that adaptive execution leaves alone
    return dealt.mapInArrow(shared.lean(task), schema)


def read(spark, path: str, manifest: DataFrame) -> DataFrame:
    """(key, start, n_tokens, ids): every document of the files, ids as little-endian u32."""
    return _read(spark, path, manifest, "ids binary", lambda raw: pa.array(raw, pa.binary()))


def _read(spark, path: str, manifest: DataFrame, column: str, of: Callable) -> DataFrame:
    def work(wm: WaveletMatrix, keys: list, lens: np.ndarray, start: int) -> Iterator[pa.RecordBatch]:
        raw, ends = wm.decode().astype("<u4").tobytes(), np.cumsum(lens)
        starts = ends - lens
        cuts = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts + start), pa.array(lens), of(cuts)], names=["key", "start", "n_tokens", column.split()[0]])

    return _each(spark, path, starts(manifest), f"key long, start long, n_tokens long, {column}", work)


def count(spark, path: str, manifest: DataFrame, ids: list[int]) -> DataFrame:
    """(id, n): how often each id occurs in all files, by rank alone, in the files that hold it."""
    ids = list(dict.fromkeys(ids))

    def work(wm: WaveletMatrix, keys: list, lens: np.ndarray, start: int) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([wm.count(t) for t in ids], pa.int64())], names=["id", "n"])

    found = _each(spark, path, starts(holding(manifest, ids)), "id long, n long", work).groupBy("id").agg(F.sum("n").alias("n"))
    asked = spark.createDataFrame([(t,) for t in ids], "id long")
    return asked.join(found, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def occurrences(spark, path: str, manifest: DataFrame, ids: list[int]) -> DataFrame:
    """(id, key, place): where each id occurs, as the document's key and the place among its ids, by select alone, in the files
    that hold it."""
    ids = list(dict.fromkeys(ids))

    def work(wm: WaveletMatrix, keys: list, lens: np.ndarray, start: int) -> Iterator[pa.RecordBatch]:
        ends = np.cumsum(lens)
        for t in ids:
            at = np.array(wm.places(t), np.int64)
            doc = np.searchsorted(ends, at, "right")
            yield pa.RecordBatch.from_arrays([pa.array([t] * len(at), pa.int64()), pa.array([keys[d] for d in doc.tolist()], pa.int64()), pa.array(at - (ends - lens)[doc])], names=["id", "key", "place"])

    return _each(spark, path, starts(holding(manifest, ids)), "id long, key long, place long", work)


def access(spark, path: str, manifest: DataFrame, places: list[int]) -> DataFrame:
    """(place, id): the ids at places of the whole stream (from 0), each from the file that holds it; no other is read."""
    places = sorted(set(places))

    def work(wm: WaveletMatrix, keys: list, lens: np.ndarray, start: int) -> Iterator[pa.RecordBatch]:
        own = [p for p in places if start <= p < start + wm.n]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([wm.access(p - start) for p in own], pa.int64())], names=["place", "id"])

    asked = spark.createDataFrame([(p,) for p in places], "asked long")
    files = starts(manifest).join(F.broadcast(asked), (F.col("asked") >= F.col("start")) & (F.col("asked") < F.col("start") + F.col("ids")), "left_semi")
    return _each(spark, path, files, "place long, id long", work)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: the documents' ids, written and read back."""
    path = shared.new_path(spark, "wavelet")
    manifest = write(shared.table(spark, sf_dir, "documents"), path)
    found = _read(spark, path, manifest, "ids_crc32 long", lambda raw: pa.array([zlib.crc32(r) for r in raw], pa.int64()))
    return found.withColumnRenamed("key", "doc_id")
