"""Sizes of derivatives as column expressions: aspect-keeping resize, cover and crop, kernel, size estimate."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Requests of at most so many pixels a side are thumbnails.
THUMBNAIL = 300


def _scaled(size: Column, ratio: Column) -> Column:
    """Half away from zero, at least 1."""
    return F.greatest(F.floor(size * ratio + F.lit(0.5)).cast("long"), F.lit(1).cast("long"))


def scaled_size(ow: Column, oh: Column, w: Column, h: Column) -> tuple[Column, Column]:
    """The size after scaling: by width, by height, to cover both, or as it is."""
    by_w, by_h = w.cast("double") / ow, h.cast("double") / oh
    ratio = F.when(h.isNull(), by_w).when(w.isNull(), by_h).otherwise(F.greatest(by_w, by_h))
    whole = w.isNull() & h.isNull()
    return F.when(whole, ow.cast("long")).otherwise(_scaled(ow, ratio)), F.when(whole, oh.cast("long")).otherwise(_scaled(oh, ratio))


def crop_offset(now: Column, want: Column) -> Column:
    """Half of what is over, never negative; 0 where nothing is asked."""
    return F.coalesce(F.floor(F.greatest(now - want, F.lit(0)) / 2).cast("long"), F.lit(0).cast("long"))


def final_size(now: Column, want: Column, other: Column) -> Column:
    """After the crop, which takes place only where both sides are asked."""
    return F.when(want.isNotNull() & other.isNotNull(), F.least(now, want.cast("long"))).otherwise(now)


def kernel(w: Column, h: Column) -> Column:
    return F.when((w <= THUMBNAIL) & (h <= THUMBNAIL), "triangle").otherwise("lanczos3")


def estimated_bytes(w: Column, h: Column, fmt: Column) -> Column:
    """A rough size of the encoded image, for weighing partitions."""
    pixels = w.cast("long") * h
    return F.when(fmt == "jpg", F.floor(pixels / 2)).when(fmt == "png", pixels * 4).when(fmt == "webp", F.floor(pixels / 3)).otherwise(pixels * 3).cast("long")
