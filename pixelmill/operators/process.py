"""The pixel step: Arrow batches of sources, each with what is asked of it."""

from __future__ import annotations

import time

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, functions as F

from .. import tables
from . import codecs, pixels


def _whole(x) -> int | None:
    return None if x is None or pd.isna(x) else int(x)


#: The columns that say what is done to a source.
STEPS = ["width", "height", "format", "blur_sigma", "grayscale", "kernel"]


def decoded(data: bytes | None) -> tuple:
    """(image, error) of a source."""
    try:
        if data is None:
            raise codecs.CodecError("no source")
        return codecs.decode(bytes(data)), None
    except codecs.CodecError as e:
        return None, str(e)


def made_of(image, w, h, fmt: str, blur, gray, kernel: str) -> tuple:
    """(content, width, height, error, milliseconds) of a decoded image: resize, gray, blur, encode."""
    began = time.perf_counter()
    try:
        image = pixels.processed(image, _whole(w), _whole(h), kernel, bool(gray) if gray is not None and not pd.isna(gray) else None, None if blur is None or pd.isna(blur) else float(blur))
        out = (codecs.encode(image, fmt), image.shape[1], image.shape[0], None)
    except codecs.CodecError as e:
        out = (None, None, None, str(e))
    return *out, int((time.perf_counter() - began) * 1000)


def made(data: bytes | None, *steps) -> tuple:
    """``made_of`` of a source's bytes."""
    image, error = decoded(data)
    return (None, None, None, error, 0) if error is not None else made_of(image, *steps)


#: Requests of a source that go with it to a task, as expected; a source of more goes to several.
TOGETHER = 64
#: Bytes of derivatives that a worker holds.
HELD = 4 << 20
MADE = "key string, content_type string, content binary, error string, out_width int, out_height int, made_ms long"


def by_source(work: DataFrame) -> DataFrame:
    """(url, asked) of requests with a key, a url and the columns of ``requests.planned``: those of one url in lists of about
    ``TOGETHER``, so that a source's bytes go to as many rows as they must, and no list grows with a url's requests."""
    parts = work.groupBy("url").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("parts"))
    # Written, so that the join's sides come from exchanges of their own, and a hot url's partition can be split.
    parts, _ = tables.cut(parts, "parts")
    dealt = work.join(parts, "url").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))
    return dealt.groupBy("url", "part").agg(F.collect_list(F.struct("key", "content_type", *STEPS)).alias("asked")).drop("part")


def derived(work: DataFrame, profile: ResourceProfile | None = None) -> DataFrame:
    """Derivatives of rows with ``asked``, ``source`` (bytes) and ``source_error``: each source is decoded once, and what fails is
    the error of its rows. ``profile``: resources of the pixel tasks, on clusters that give tasks their own.

    Images are large: ``spark.sql.execution.arrow.maxBytesPerBatch`` bounds what a Python worker takes at once, and derivatives
    leave it as soon as they come to ``HELD`` bytes.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.binary(), pa.string(), pa.int32(), pa.int32(), pa.int64()]
        names = [c.split()[0] for c in MADE.split(", ")]
        rows, held = [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for asked, data, error in zip(*(batch.column(c) for c in ("asked", "source", "source_error")), strict=True):
                image = None
                if not error.is_valid:
                    image, error = decoded(data.as_py())
                else:
                    error = error.as_py()
                for r in asked.as_py():
                    content, width, height, failed, ms = (None, None, None, error, 0) if error is not None else made_of(image, *(r[c] for c in STEPS))
                    rows.append((r["key"], r["content_type"], content, failed, width, height, ms))
                    held += len(content or b"")
                    if held >= HELD:
                        yield flush()
                        rows, held = [], 0
        if rows:
            yield flush()

    return work.select("asked", "source", "source_error").mapInArrow(task, MADE, profile=profile)
