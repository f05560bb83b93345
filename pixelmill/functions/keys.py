"""Cache keys and urls of derivatives, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Keys that a store takes; anything else (path traversal, say) is refused.
SAFE_KEY = r"^[A-Za-z0-9_/-]*[0-9a-f]{64}\.(jpg|png|webp)$"


def float_text(x: Column) -> Column:
    """A float as shortest decimal text without exponent or trailing zeros: 5, 0.1, 2.5. Values under 1e-18 read 0."""
    exact = x.cast("string").cast("decimal(38,18)").cast("string")
    return F.rtrim(F.rtrim(exact, F.lit("0")), F.lit("."))


def _said(text: Column) -> Column:
    return F.coalesce(text, F.lit("None"))


def key_parts(url: Column, width: Column, height: Column, fmt: Column, blur: Column, gray: Column) -> list[Column]:
    return [url, _said(width.cast("string")), _said(height.cast("string")), F.lower(fmt), _said(float_text(blur)), _said(gray.cast("string"))]


def cache_key(url: Column, width: Column, height: Column, fmt: Column, blur: Column, gray: Column, sub_path: str = "") -> Column:
    """The key: ``sub_path``, the SHA-256 of the parts without a separator, a dot, the format."""
    return F.concat(F.lit(sub_path), F.sha2(F.concat(*key_parts(url, width, height, fmt, blur, gray)), 256), F.lit("."), fmt)


def cache_key_v2(url: Column, width: Column, height: Column, fmt: Column, blur: Column, gray: Column, sub_path: str = "") -> Column:
    """An extension: parts apart by a separator, so 11x1111 and 111x111 have keys of their own."""
    return F.concat(F.lit(sub_path), F.sha2(F.concat_ws("\x1f", *key_parts(url, width, height, fmt, blur, gray)), 256), F.lit("."), fmt)


def safe_key(key: Column) -> Column:
    return F.coalesce(key.rlike(SAFE_KEY) & ~F.contains(key, F.lit("..")), F.lit(False))


def cdn_url(base: Column, key: Column) -> Column:
    """The base without trailing slashes, a slash, the key."""
    return F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), key)


def percent_encoded(text: Column) -> Column:
    """Percent-encoding of all but unreserved characters."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
