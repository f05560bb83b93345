"""Formats: names, media types, magic bytes, store names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed values.
MEDIA_TYPES = {"jpg": "image/jpeg", "png": "image/png", "webp": "image/webp"}
STORE_NAMES = {"s3": ["S3", "MINIO"], "local": ["LOCAL_FS", "LOCALFS", "LOCAL"], "memory": ["IN_MEMORY", "INMEMORY", "MEMORY"]}
CACHE_CONTROL = "public, max-age=31536000, immutable"
OCTETS = "application/octet-stream"


def media_type(fmt: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])[fmt]


def store_name(name: Column) -> Column:
    """s3, local or memory, whatever the case; null where the name is none of them."""
    out = F.lit(None).cast("string")
    for kind, names in STORE_NAMES.items():
        out = F.when(F.upper(name).isin(names), kind).otherwise(out)
    return out


def sniffed(content: Column) -> Column:
    """jpg, png or webp by the first bytes; null for fewer than twelve bytes or none of them."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(F.octet_length(content) < 12, None)
        .when(F.startswith(head, F.lit("FFD8FF")), "jpg")
        .when(F.startswith(head, F.lit("89504E47")), "png")
        .when(F.startswith(head, F.lit("52494646")) & F.endswith(head, F.lit("57454250")), "webp")
    )
