"""Requests: validation, normalisation, keys, deduplication, benchmark request lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import formats, geometry, keys

SIDE, BLUR = (10, 4096), (0, 100)


def errors(df: DataFrame) -> Column:
    """The names of the fields that are out of bounds, comma-joined; null where all are good. Nothing is dropped."""
    out = lambda c, lo, hi: F.col(c).isNotNull() & ~F.col(c).between(lo, hi)
    host = F.try_parse_url(F.col("url"), F.lit("HOST"))
    bad = [
        ("url", F.col("url").isNull() | host.isNull()),
        ("width", out("width", *SIDE)),
        ("height", out("height", *SIDE)),
        ("blur_sigma", out("blur_sigma", *BLUR)),
        ("format", F.col("format").isNotNull() & ~F.col("format").isin(*formats.MEDIA_TYPES)),
    ]
    said = F.concat_ws(",", *[F.when(cond, name) for name, cond in bad])
    return F.when(said != "", said)


def validated(raw: DataFrame) -> DataFrame:
    return raw.withColumn("error", errors(raw))


def normalised(raw: DataFrame) -> DataFrame:
    """Wire rows as requests: sides as long, single-precision blur, the default format."""
    return raw.withColumns({"width": F.col("width").cast("long"), "height": F.col("height").cast("long"), "format": F.coalesce("format", F.lit("jpg")), "blur_sigma": F.col("blur_sigma").cast("float"), "grayscale": F.col("grayscale").cast("boolean")})


PARTS = ["url", "width", "height", "format", "blur_sigma", "grayscale"]


def with_key(requests: DataFrame, sub_path: str = "", separated: bool = False) -> DataFrame:
    make = keys.cache_key_v2 if separated else keys.cache_key
    return requests.withColumn("key", make(*[F.col(c) for c in PARTS], sub_path=sub_path))


def planned(requests: DataFrame) -> DataFrame:
    """With media type, kernel and whether gray and blur steps run."""
    return requests.withColumns({
        "content_type": formats.media_type(F.col("format")),
        "kernel": geometry.kernel(F.col("width"), F.col("height")),
        "does_gray": F.col("grayscale").eqNullSafe(True),
        "does_blur": F.coalesce(F.col("blur_sigma") > 0, F.lit(False)),
    })


def deduplicated(requests: DataFrame) -> DataFrame:
    """One request a key (the least request_id), so that equal requests are made once."""
    return requests.groupBy("key").agg(F.min_by(F.struct(*[c for c in requests.columns if c != "key"]), "request_id").alias("r")).select("key", "r.*")


# Benchmark configuration: comma lists to rows.


def parts(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda s: F.trim(s))


def levels(text: Column) -> Column:
    """The list's whole numbers; others fall away."""
    return F.filter(F.transform(parts(text), lambda s: s.try_cast("long")), lambda n: n >= 0)


def sizes(text: Column) -> Column:
    """(width, height) of each ``WxH`` item, either side null where empty or no number; items without an x fall away."""

    def pair(s: Column) -> Column:
        side = lambda t: F.when(t.rlike("^[+]?[0-9]+$"), t.try_cast("long"))
        return F.struct(side(F.regexp_extract(s, "^([^x]*)x", 1)).alias("width"), side(F.regexp_extract(s, "^[^x]*x(.*)$", 1)).alias("height"))

    return F.transform(F.filter(parts(text), lambda s: F.contains(s, F.lit("x"))), pair)


def base_url(host: Column, port: Column) -> Column:
    return F.format_string("http://%s:%s", host, port.cast("string"))


def request_url(base: Column, url: Column, width: Column, height: Column, fmt: Column) -> Column:
    query = F.concat_ws("&", F.concat(F.lit("width="), width.cast("string")), F.concat(F.lit("height="), height.cast("string")), F.concat(F.lit("format="), fmt))
    return F.concat(base, F.lit("/api/images/resize?url="), keys.percent_encoded(url), F.lit("&"), query)


def config_error(config: DataFrame) -> Column:
    """What is wrong with a benchmark configuration (levels, urls, sizes, timeout_s), first fault first; null where nothing is."""
    none = lambda items: F.coalesce(F.size(items), F.lit(0)) <= 0
    return (
        F.when(none(levels(F.col("levels"))), "no valid concurrency levels")
        .when(none(F.filter(parts(F.col("urls")), lambda u: u != "")), "no valid urls")
        .when(none(sizes(F.col("sizes"))), "no valid sizes")
        .when(F.coalesce(F.col("timeout_s"), F.lit(0)) <= 0, "the timeout must be over 0")
    )


def bench_requests(config: DataFrame, *by: str) -> DataFrame:
    """One row for each request of each level of each configuration, told apart by the columns ``by``: lists pair round-robin.
    ``config``: host, port, levels, urls, sizes, format."""
    one = config.select(*by, base_url(F.col("host"), F.col("port")).alias("base"), "format", levels(F.col("levels")).alias("levels"), parts(F.col("urls")).alias("urls"), sizes(F.col("sizes")).alias("sizes"))
    each = one.where((F.size("levels") > 0) & (F.size("sizes") > 0)).select("*", F.explode("levels").alias("level")).where("level > 0")
    each = each.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("level") - 1)).alias("i"))
    pick = lambda c: F.element_at(c, (F.col("i") % F.size(c) + 1).cast("int"))
    each = each.select(*by, "base", "format", "level", "i", pick("urls").alias("url"), pick("sizes").alias("size"))
    return each.select(*by, "level", "i", F.col("size.width").alias("width"), F.col("size.height").alias("height"), request_url(F.col("base"), F.col("url"), F.col("size.width"), F.col("size.height"), F.col("format")).alias("request"))
