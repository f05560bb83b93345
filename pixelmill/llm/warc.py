"""WARC archives in Zstandard: a dictionary in a leading skippable frame, then one frame a record.

Writing: pages of equal payloads (by SHA-1) share one response record, the one of the largest page id; the others become
revisit records that name it and carry no payload. Each task writes archives of bounded size; an archive begins with a
warcinfo record, its dictionary is trained on records from all over it and stands, itself compressed, in a skippable frame
at the archive's head. Responses are HTTP messages, and the payload is what follows the HTTP head. Files are named by
attempt and read by the list that the writing job returns, so what a lost attempt left behind does not count.

Reading takes any archive of this form: the dictionary from the skippable frame (compressed or not; archives without one
too), every following frame is found by its block headers, decoded alone, and its record validated: version line, required
headers, Content-Length, the closing line feeds, and the digests of block and payload where they are given (SHA-1,
SHA-256 or MD5, in base32 or hex). Records of every type are rows; the payload of HTTP messages is the body (chunks
joined; content codings stay), of others the block.

Defined cases: a null html is an empty payload; empty payloads of several pages are equal payloads; a null url leaves the
target header out; null page ids are written as "null", never referred to by name but as null; of a page id that comes
several times with one payload, every row of the largest id is a response; rows that are equal are records each; a record
of more bytes than an archive takes is an archive of its own; other columns are not carried; an empty table gives no
archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import shared

#: Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
FRAME = 0xFD2FB528
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Uncompressed bytes of an archive, of the records that its dictionary is trained on, of one such record, of the dictionary.
ARCHIVE_BYTES, SAMPLE_BYTES, SAMPLE_RECORD, DICTIONARY_BYTES = 32 << 20, 2 << 20, 64 << 10, 64 << 10
#: Payloads of at least so many bytes are deduplicated.
LEAST_BYTES = 0
DATE = "1970-01-01T00:00:00Z"
SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, record_id string, refers_to_id string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, record_id: str, headers: list[str], content_type: str, block: bytes) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", *headers, f"Content-Type: {content_type}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def information(name: str) -> bytes:
    """The warcinfo record of the archive ``name``."""
    return _record("warcinfo", f"urn:archive:{name}", [f"WARC-Filename: {name}"], "application/warc-fields", b"software: pixelmill\r\nformat: WARC File Format 1.1\r\n")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, sha: str) -> bytes:
    """One WARC record; the id of a page is its record id, ``sha`` the payload's SHA-1 in hex. A revisit has the HTTP head
    alone, which says how long the payload is."""
    name = lambda x: f"urn:page:{'null' if x is None else x}"
    more = [] if url is None else ["WARC-Target-URI: " + re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url)]
    more.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha)).decode()}")
    if revisit:
        more += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{name(refers_to)}>"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _record("revisit" if revisit else "response", name(page_id), more, "application/http; msgtype=response", http if revisit else http + payload)


def _fields(text: str) -> dict[str, str]:
    """Header lines by lower-case name; the first of a name counts, and lines that begin with a blank go on."""
    out: dict[str, str] = {}
    last = None
    for line in text.split("\r\n") if text else []:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"header without a colon: {line!r}")
        last = name.strip().lower()
        out.setdefault(last, value.strip())
    return out


def _holds(said: str | None, *bodies: bytes) -> bool:
    """Whether a digest header fits one of the bodies; what names another algorithm is not judged."""
    algorithm, colon, value = (said or "").partition(":")
    make = {"sha1": hashlib.sha1, "sha-1": hashlib.sha1, "sha256": hashlib.sha256, "sha-256": hashlib.sha256, "md5": hashlib.md5}.get(algorithm.lower())
    if not colon or make is None:
        return True
    value = value.strip().upper().rstrip("=")
    return any(value in (base64.b32encode(d).decode().rstrip("="), d.hex().upper()) for d in (make(b).digest() for b in bodies))


def _joined(body: bytes) -> bytes | None:
    """The body of an HTTP message in chunks; None where it is not in that form."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            return None
        if not (n := int(size, 16)):
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
        if len(out[-1]) != n or body[at - 2 : at] != b"\r\n":
            return None


def parse(data: bytes) -> dict:
    """A record's headers (lower-case names), its ``block`` and ``payload`` (None for revisits), and ``payload-length``
    (None where a revisit does not say it); ValueError where the record is not valid."""
    end = data.find(b"\r\n\r\n")
    version, _, text = data[: max(end, 0)].decode("utf-8").partition("\r\n")
    if end < 0 or version not in ("WARC/1.1", "WARC/1.0"):
        raise ValueError("not a WARC record")
    headers = _fields(text)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"no {name}")
    size = int(headers["content-length"])
    if len(data) != end + 4 + size + 4 or data[-4:] != b"\r\n\r\n":
        raise ValueError("the record's length disagrees with its Content-Length")
    block = data[end + 4 : end + 4 + size]
    if not _holds(headers.get("warc-block-digest"), block):
        raise ValueError("the block's digest disagrees")
    payload, length = block, size
    if headers.get("content-type", "").lower().startswith("application/http"):
        at = block.find(b"\r\n\r\n")
        _, _, text = block[: max(at, 0)].decode("latin-1").partition("\r\n")
        http, payload = _fields(text), block[at + 4 :] if at >= 0 else b""
        whole = _joined(payload) if http.get("transfer-encoding", "").lower() == "chunked" else None
        bodies = [payload] if whole is None else [payload, whole]
        payload, length = bodies[-1], len(bodies[-1])
        if headers["warc-type"] == "revisit":
            length = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
    else:
        bodies = [payload]
    if headers["warc-type"] == "revisit":
        payload, length = None, length if headers.get("content-type", "").lower().startswith("application/http") else None
    elif "warc-truncated" not in headers and not _holds(headers.get("warc-payload-digest"), *bodies):
        raise ValueError("the payload's digest disagrees")
    return headers | {"block": block, "payload": payload, "payload-length": length}


def sampled(records: list[bytes]) -> list[bytes]:
    """Every so manyth record of an archive, about ``SAMPLE_BYTES`` in all (``SAMPLE_RECORD`` of each at most)."""
    held = sum(min(len(r), SAMPLE_RECORD) for r in records)
    return [r[:SAMPLE_RECORD] for r in records[:: max(1, round(held / SAMPLE_BYTES))]]


def archive(records: list[bytes]) -> bytes:
    """An archive of records."""
    import zstandard

    sample = sampled(records)
    try:
        dictionary = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(sum(map(len, sample)) // 8, 256)), sample)
    except zstandard.ZstdError:  # too few or too short records: their own bytes serve
        dictionary = zstandard.ZstdCompressionDict(b"".join(sample)[-4096:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    head = zstandard.ZstdCompressor(level=3).compress(dictionary.as_bytes())
    pack = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True)
    return struct.pack("<II", DICTIONARY_FRAME, len(head)) + head + b"".join(pack.compress(r) for r in records)


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, by its header and its blocks' headers."""
    if at + 6 > len(data) or struct.unpack_from("<I", data, at)[0] != FRAME:
        raise ValueError("no Zstandard frame")
    flags = data[at + 4]
    single = flags >> 5 & 1
    to = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        if to + 3 > len(data):
            raise ValueError("a frame is cut short")
        block = data[to] | data[to + 1] << 8 | data[to + 2] << 16
        to += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            break
    to += 4 * (flags >> 2 & 1)
    if to > len(data):
        raise ValueError("a frame is cut short")
    return to


def records(data: bytes) -> Iterator[bytes]:
    """The records of an archive, decoded frame by frame; skippable frames between them are passed over."""
    import zstandard

    view, at, dictionary = memoryview(data), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        (size,) = struct.unpack_from("<I", data, 4)
        own = bytes(view[8 : 8 + size])
        if len(own) != size:
            raise ValueError("the dictionary is cut short")
        try:
            if own[:4] == struct.pack("<I", FRAME):
                own = zstandard.ZstdDecompressor().decompressobj().decompress(own)
            dictionary = zstandard.ZstdCompressionDict(own)
        except zstandard.ZstdError as e:
            raise ValueError(f"the dictionary cannot be read: {e}") from e
        at = 8 + size
    unpack = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(data):
        if at + 8 <= len(data) and struct.unpack_from("<I", data, at)[0] in SKIPPABLE:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        to = frame_end(view, at)
        try:
            yield unpack.decompressobj().decompress(view[at:to])
        except zstandard.ZstdError as e:
            raise ValueError(f"a frame cannot be read: {e}") from e
        at = to


def write(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``path/part-P-A-ATTEMPT.warc.zst``, an archive as soon as its records hold ``archive_bytes``; returns (name, part,
    archive, records), a row an archive, already done."""
    spark = pages.sparkSession
    shared.make_dirs(spark, path)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    pages = pages.withColumn("sha", F.sha1("payload"))
    # Only payloads that come more than once; written, so that a hot one's partition can be split in the join.
    shared_by = pages.where(F.octet_length("payload") >= least_bytes).groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("refers_to"))
    shared_by, _ = shared.cut(shared_by.where("n > 1").select("sha", "refers_to"), "payloads")
    named = pages.join(shared.small(shared_by), "sha", "left").withColumn("again", F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to")) & (F.octet_length("payload") >= least_bytes))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        part, attempt, held, own, done = TaskContext.get().partitionId(), uuid.uuid4().hex, 0, [], []

        def close() -> None:
            nonlocal held
            if own:
                name = f"part-{part:06d}-{len(done):06d}-{attempt}.warc.zst"
                shared.write_bytes(f"{path}/{name}", archive([information(name), *own]))
                done.append((name, part, len(done), len(own)))
                own.clear()
                held = 0

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to", "again", "sha")), strict=True):
                own.append(record(*(x.as_py() for x in row)))
                held += len(own[-1])
                if held >= archive_bytes:
                    close()
        close()
        cols = list(zip(*done, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["name", "part", "archive", "records"])

    out = named.select("page_id", "url", "payload", "refers_to", "again", "sha").mapInArrow(task, "name string, part long, archive long, records long")
    return shared.cut(out, "archives")[0]


def read(spark, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """The records of the manifest's archives (without one: of all in the folder): page_id, url, payload_bytes,
    payload_digest (both of the full payload), record_type, refers_to, payload (null for revisits), record_id,
    refers_to_id; page_id and refers_to are null where the ids are not of pages. Any invalid record fails the job with its
    archive's name."""

    def number(name: str | None) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
        return int(m[1]) if m else None

    def sha1(r: dict) -> str | None:
        if r["payload"] is not None:
            return digest(r["payload"])
        m = re.fullmatch(r"sha-?1:([A-Z2-7]{32}|[0-9a-f]{40})", r.get("warc-payload-digest", ""), re.IGNORECASE)
        return None if m is None else m[1].upper() if len(m[1]) == 32 else base64.b32encode(bytes.fromhex(m[1])).decode()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, types[s.split()[1]]) for c, s in zip(zip(*rows, strict=True), SCHEMA.split(", "), strict=True)], names=names)

        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, held = [], 0
                try:
                    for raw in records(data.as_py()):
                        r = parse(raw)
                        own, other = r["warc-record-id"], r.get("warc-refers-to")
                        rows.append((number(own), r.get("warc-target-uri"), r["payload-length"], sha1(r), r["warc-type"], number(other), r["payload"], own, other))
                        held += len(raw)
                        if held > 4 << 20:
                            yield flush(rows)
                            rows, held = [], 0
                except ValueError as e:
                    raise ValueError(f"{name}: {e}") from e
                if rows:
                    yield flush(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("path", "content")
    if manifest is not None:
        files = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(shared.small(manifest.select("name")), "name", "left_semi").select("path", "content")
    return files.mapInArrow(task, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: the pages, written and read back."""
    path = shared.new_path(spark, "warc")
    manifest = write(shared.table(spark, sf_dir, "pages"), path)
    return read(spark, path, manifest).where("record_type in ('response', 'revisit')").drop("url", "payload", "record_id", "refers_to_id")
