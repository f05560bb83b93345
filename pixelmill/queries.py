"""Queries that exercise the operators on the supplied tables, and the same in SQL.

There are no images among the tables, so columns stand in: page urls for request urls, part sizes for image sizes, event
rows for run logs, 64 embedding values for 8 x 8 gray pixels. Equal results show an operator's logic, not parity of pixels
with any other implementation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import tables
from .functions import formats, geometry
from .operators import codecs, keyed, pixels, placing, requests as req, stats, store, tiles
from .plans import resize
from .sources import config

CDN = "https://cdn.example.com//"
SIZES = [(300, 300), (800, None), (None, 600), (1200, 800)]
BAD = [(9, 10, -1.0, "gif"), (10, 4096, 0.0, "jpg"), (4097, 9, 100.0, "webp"), (None, None, 101.0, None), (4096, 10, None, "png"), (0, -5, 0.1, "JPG")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page in four sizes; format, blur and gray follow the page's number."""
    sizes = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).cast("int").alias("w"), F.lit(h).cast("int").alias("h")) for i, (w, h) in enumerate(SIZES)])
    p = F.col("page_id")
    pick = lambda n, values: F.element_at(F.array(*[F.lit(v) for v in values]), (p % n + 1).cast("int"))
    return _table(spark, sf_dir, "pages").select("page_id", "url", F.explode(sizes).alias("s")).select(
        (p * 4 + F.col("s.i")).alias("request_id"),
        "page_id",
        "url",
        F.col("s.w").alias("width"),
        F.col("s.h").alias("height"),
        pick(4, ["jpg", "png", "webp", None]).alias("format"),
        pick(5, [None, 0.0, 0.5, 2.5, 5.0]).cast("float").alias("blur_sigma"),
        pick(3, [None, True, False]).alias("grayscale"),
    )


_SQL_REQUESTS = """
sizes(i, w, h) AS (VALUES (0, 300, 300), (1, 800, NULL), (2, NULL, 600), (3, 1200, 800)),
raw AS (
  SELECT page_id * 4 + i AS request_id, page_id, url, w AS width, h AS height,
         coalesce(['jpg', 'png', 'webp', NULL][page_id % 4 + 1], 'jpg') AS format,
         CAST([NULL, 0.0, 0.5, 2.5, 5.0][page_id % 5 + 1] AS FLOAT) AS blur_sigma, [NULL, true, false][page_id % 3 + 1] AS grayscale
  FROM pages, sizes
),
keyed AS (
  SELECT *, 'img/' || sha256(url || coalesce(CAST(width AS VARCHAR), 'None') || coalesce(CAST(height AS VARCHAR), 'None') || lower(format)
    || coalesce(rtrim(rtrim(CAST(CAST(CAST(blur_sigma AS VARCHAR) AS DECIMAL(38, 18)) AS VARCHAR), '0'), '.'), 'None')
    || coalesce(CAST(grayscale AS VARCHAR), 'None')) || '.' || format AS key
  FROM raw
)"""
_SQL_LOCATION = "'https://cdn.example.com/' || key"


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return req.with_key(req.normalised(_requests(spark, sf_dir)), "img/")


def resize_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _keyed(spark, sf_dir)
    return store.located(out.withColumn("found", F.lit(True)), CDN).select("request_id", "key", "location")


def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).cast("int").alias("width"), F.lit(h).cast("int").alias("height"), F.lit(b).cast("float").alias("blur_sigma"), F.lit(f).cast("string").alias("format")) for i, (w, h, b, f) in enumerate(BAD)])
    p = F.col("page_id")
    url = F.when(p % 7 == 0, None).when(p % 7 == 1, F.lit("no url")).otherwise(F.col("url"))
    raw = _table(spark, sf_dir, "pages").select("page_id", url.alias("url"), F.explode(rows).alias("r")).select("page_id", "url", "r.*")
    return req.validated(raw).select("page_id", "i", F.coalesce("error", F.lit("-")).alias("error"))


def mime_and_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = req.planned(req.normalised(_requests(spark, sf_dir)))
    return out.select("request_id", "content_type", "kernel", "does_gray", "does_blur")


def target_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).cast("long").alias("w"), F.lit(h).cast("long").alias("h")) for i, (w, h) in enumerate([*SIZES, (None, None)])])
    src = _table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 40).cast("long").alias("ow"), ((F.col("p_partkey") % 37 + 1) * 30).cast("long").alias("oh"), F.explode(sizes).alias("s"))
    w, h = F.col("s.w"), F.col("s.h")
    sw, sh = geometry.scaled_size(F.col("ow"), F.col("oh"), w, h)
    out = src.select("p_partkey", F.col("s.i").alias("i"), w.alias("w"), h.alias("h"), sw.alias("scaled_w"), sh.alias("scaled_h"))
    w, h, sw, sh = F.col("w"), F.col("h"), F.col("scaled_w"), F.col("scaled_h")
    both = w.isNotNull() & h.isNotNull()
    out = out.select("p_partkey", "i", "scaled_w", "scaled_h", F.when(both, geometry.crop_offset(sw, w)).otherwise(F.lit(0).cast("long")).alias("crop_x"), F.when(both, geometry.crop_offset(sh, h)).otherwise(F.lit(0).cast("long")).alias("crop_y"), geometry.final_size(sw, w, h).alias("out_w"), geometry.final_size(sh, h, w).alias("out_h"), geometry.kernel(w, h).alias("kernel"))
    size = lambda f: geometry.estimated_bytes(F.col("out_w"), F.col("out_h"), F.lit(f))
    return out.withColumns({"jpg_bytes": size("jpg"), "png_bytes": size("png"), "webp_bytes": size("webp"), "other_bytes": size("gif")})


def weighted_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of parts, taken for images of their size, by the estimated bytes of a derivative."""
    p = F.col("p_partkey")
    rows = _table(spark, sf_dir, "part").select("p_partkey", geometry.estimated_bytes(F.col("p_size") * F.when(p % 97 == 0, 900).otherwise(40), (p % 37 + 1) * 30, _picked("p_partkey", ["jpg", "png", "webp", "gif"])).alias("bytes"))
    return placing.binned(rows, ["p_partkey"], "bytes", 64 << 20).select("p_partkey", "bytes", "bin")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derivatives: the requests of even pages."""
    even = _keyed(spark, sf_dir).where("page_id % 2 = 0")
    return even.select("key", formats.media_type(F.col("format")).alias("content_type"), F.col("url").cast("binary").alias("content"), F.col("request_id").alias("seq"))


def cache_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.hits(_keyed(spark, sf_dir), _stored(spark, sf_dir)).select("request_id", "key")


def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.misses(_keyed(spark, sf_dir), _stored(spark, sf_dir)).select("request_id", "key")


def download_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = store.downloaded(_keyed(spark, sf_dir).select("request_id", "key"), _stored(spark, sf_dir))
    return out.select("request_id", "found", F.octet_length("content").alias("n_bytes"), "content_type", "cache_control", "error")


def keyed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``download_lookup`` in a store by key that was written three times and compacted in between: even pages, then every
    fourth again, then every eighth."""
    held = keyed.Store(spark, tables.new_path(spark, "store"), 16)
    page = F.floor(F.col("seq") / 4)
    for seq, (every, content) in enumerate([(2, F.concat(F.lit("old:"), F.col("content").cast("string"))), (4, F.col("content").cast("string")), (8, F.concat(F.col("content").cast("string"), F.lit("!")))]):
        held.append(_stored(spark, sf_dir).where(page % every == 0).withColumn("content", content.cast("binary")), seq)
        if seq == 1:
            held.compact()
    out = held.downloaded(_keyed(spark, sf_dir).select("request_id", "key"))
    return out.select("request_id", "found", F.octet_length("content").alias("n_bytes"), "content_type", "error")


def redirect_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.located(store.probed(_keyed(spark, sf_dir), _stored(spark, sf_dir)), CDN).select("request_id", "found", "location")


def latest_derivative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest(_table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def dedupe_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select(F.concat_ws(":", "user_id", "event_type").alias("key"), F.col("event_id").alias("request_id"), "value")
    return req.deduplicated(events).select("key", "request_id", "value")


def source_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    statuses = F.array(*[F.lit(s) for s in (200, 204, 299, 301, 404, 500, None)])
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.element_at(statuses, (d % 7 + 1).cast("int")).alias("status"), F.when(d % 5 == 0, None).otherwise(F.col("n_chars")).alias("content_length"))
    return store.guarded(rows, 2000)


def magic_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.array(*[F.unhex(F.lit(h)) for h in ("FFD8FFE0", "89504E47", "52494646AABBCCDD57454250", "52494646", "")])
    d = F.col("doc_id")
    content = F.concat(F.element_at(heads, (d % 5 + 1).cast("int")), F.when(d % 3 == 0, F.lit(b"\x00" * 7)).otherwise(F.col("text").cast("binary")))
    return _table(spark, sf_dir, "documents").select("doc_id", F.coalesce(formats.sniffed(content), F.lit("-")).alias("format"), F.octet_length(content).alias("n_bytes"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a run log: five levels, of a wall time of 60 seconds each."""
    levels = F.element_at(F.array(*[F.lit(n) for n in (1, 5, 10, 20, 50)]), (F.col("user_id") % 5 + 1).cast("int"))
    return _table(spark, sf_dir, "events").select(levels.alias("level"), (F.col("event_type") != "error").alias("success"), F.floor(F.col("value") * 1000).cast("long").alias("duration_us"), F.get_json_object("props", "$.k").try_cast("long").alias("content_length"), F.lit(60.0).alias("wall_s"), "event_type")


def bench_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    return stats.bench_stats(log.unionByName(log.where("level = 1").withColumn("level", F.lit(0)).withColumn("success", F.lit(False))))


def hit_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.counters(_table(spark, sf_dir, "events"), "event_type = 'view'", "event_type = 'click'")


def stage_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.stage_averages(_table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.floor("value").alias("ms")))


def latency_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms of each type's values by hour, merged by day, and their quantiles."""
    log = _table(spark, sf_dir, "events").select(F.window("ts", "1 hour").start.alias("hour"), "event_type", (F.col("value") - 1).alias("ms"))
    hours = stats.histogram(log, "ms", "hour", "event_type")
    days = stats.merged(hours.withColumn("day", F.date_format("hour", "yyyy-MM-dd")), "day", "event_type")
    out = stats.quantiles(days, [0.5, 0.9, 0.99], "day", "event_type")
    return out.select("day", "event_type", "n", *[F.round(c, 6).alias(c) for c in ("p50", "p90", "p99")])


def path_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = F.array(*[F.lit(p) for p in ("/health", "/metrics/x", "/api/images/resize", "/api/images/files", "/healthy", "/")])
    e = F.col("event_id")
    return stats.path_metrics(_table(spark, sf_dir, "events").select(F.element_at(paths, (e % 6 + 1).cast("int")).alias("path"), (200 + e % 3 * 100).alias("status")))


STORE_ROWS = ["s3", "MinIO", "local_fs", "LocalFS", "local", "in_memory", "InMemory", "memory", "disk", ""]


def _picked(n: str, values: list) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(n) % len(values) + 1).cast("int"))


def profile_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration for each customer: a profile's name in some case, and explicit settings over it, at eight processors."""
    rows = _table(spark, sf_dir, "customer").select(
        "c_custkey",
        _picked("c_custkey", ["High_Throughput", "low_latency", "MEMORY_EFFICIENT", "nonsense", None]).alias("profile"),
        F.when(F.col("c_nationkey") % 3 == 0, F.col("c_nationkey") + 1).alias("downloads"),
        F.when(F.col("c_nationkey") % 4 == 1, F.col("c_nationkey")).alias("threads"),
    )
    out = config.resolved_rows(rows, "profile", {"max_concurrent_downloads": "downloads", "cpu_pool": "threads"}, 8)
    return out.select("c_custkey", "max_concurrent_downloads", "max_concurrent_processing", "http_timeout_s", "max_image_bytes", "pool", "enable_http2", "connection_pool", "keep_alive_s")


def store_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store that each part's text, a store's name in some case or a brand, stands for."""
    name = F.when(F.col("p_partkey") % 11 == 0, F.col("p_brand")).otherwise(_picked("p_partkey", STORE_ROWS))
    return _table(spark, sf_dir, "part").select("p_partkey", F.coalesce(formats.store_name(name), F.lit("error")).alias("store"))


def _configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load test's lists for each page, of which some are no configuration."""
    p = F.col("page_id")
    return _table(spark, sf_dir, "pages").select(
        "page_id",
        F.try_parse_url("url", F.lit("HOST")).alias("host"),
        (p % 10 + 3000).cast("int").alias("port"),
        F.when(p % 7 == 3, "x,").otherwise(F.concat_ws(",", (p % 3 + 1).cast("string"), F.lit(" x"), F.format_string(" %d ", p % 4), F.lit(""))).alias("levels"),
        F.when(p % 11 == 5, " , ").otherwise(F.concat("url", F.lit("?q=a b&r=~*é, "), "url")).alias("urls"),
        _picked("page_id", ["300x300,800x, x600 ,bad,axb,1200x800", "10x10", "bad", "x", "5x7 , 7x"]).alias("sizes"),
        _picked("page_id", ["jpg", "png", "webp"]).alias("format"),
        (p % 13).cast("int").alias("timeout_s"),
    )


def config_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _configs(spark, sf_dir)
    return rows.select("page_id", F.coalesce(req.config_error(rows), F.lit("-")).alias("error"))


def bench_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return req.bench_requests(_configs(spark, sf_dir), "page_id")


SIDE, SMALL = 8, 4


def _cells(df: DataFrame, cells: str) -> DataFrame:
    return df.select("vec_id", F.posexplode(cells).alias("cell", "value")).select("vec_id", F.col("cell").cast("long").alias("cell"), (F.round(F.col("value").cast("double"), 4) + 0.0).alias("value"))


def _weighted(spark: SparkSession, sf_dir: str, w: np.ndarray) -> DataFrame:
    out = pixels.weighted(_table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")), "vec_id", "v", w, w)
    return out.select("vec_id", "cell", (F.round("value", 4) + 0.0).alias("value"))


def resample_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weighted(spark, sf_dir, pixels.weights(SIDE, SMALL, "triangle"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _resampled(v: pd.Series) -> pd.Series:
    w = pixels.weights(SIDE, SMALL, "triangle")
    images = np.stack([np.asarray(x, float) for x in v]).reshape(-1, SIDE, SIDE) if len(v) else np.empty((0, SIDE, SIDE))
    return pd.Series(list((w @ images @ w.T).reshape(-1, SMALL * SMALL)))


def resample_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(_table(spark, sf_dir, "embeddings").select("vec_id", _resampled("embedding").alias("cells")), "cells")


def _on_tiles(spark: SparkSession, sf_dir: str, new: int, **kernel) -> DataFrame:
    """8 x 8 images as tiles of 3 x 3 (and less at the edge), filtered tile by tile, as cells."""
    images = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w"))
    held = tiles.tiled(images, "vec_id", "embedding", "h", "w", 3).withColumns({"new_height": F.lit(new), "new_width": F.lit(new)})
    table = tiles.weight_table(spark, [(SIDE, new)], **kernel)
    out = tiles.pixels_of(tiles.filtered(held, 3, table, table), 3)
    return out.select(F.col("key").alias("vec_id"), (F.col("y") * new + F.col("x")).cast("long").alias("cell"), (F.round("v", 4) + 0.0).alias("value"))


def tiled_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _on_tiles(spark, sf_dir, SIDE, sigma=1.0)


def tiled_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _on_tiles(spark, sf_dir, 11, kernel="lanczos3")


def grayscale_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(_table(spark, sf_dir, "embeddings").select("vec_id", pixels.luma(F.col("embedding").cast("array<double>"), 21).alias("cells")), "cells")


def blur_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weighted(spark, sf_dir, pixels.blur_weights(SIDE, 1.0))


@F.pandas_udf(T.StructType([T.StructField("content", T.BinaryType()), T.StructField("size", T.IntegerType()), T.StructField("total", T.LongType()), T.StructField("same", T.BooleanType())]))
def _png(v: pd.Series) -> pd.DataFrame:
    out = []
    for x in v:
        image = pixels.rounded(np.asarray(x, float) * 127 + 128).reshape(SIDE, SIDE, 1)
        back = codecs.decode(data := codecs.encode(image, "png"))
        out.append((data, back.size, int(back.astype(int).sum()), bool((back == image).all())))
    return pd.DataFrame(out, columns=["content", "size", "total", "same"])


def png_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _table(spark, sf_dir, "embeddings").select("vec_id", _png("embedding").alias("r"))
    return out.select("vec_id", F.col("r.size").alias("n_pixels"), F.col("r.total").alias("total"), F.col("r.same").alias("same"), formats.sniffed(F.col("r.content")).alias("format"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _kernels(v: pd.Series) -> pd.Series:
    """Of an 8 x 8 image: Lanczos to 5 x 5 and to 11 x 11, and blurred, in whole pixels; then 21 RGB triples as gray."""
    out = []
    for x in v:
        image = pixels.rounded(np.asarray(x, float) * 127 + 128).reshape(SIDE, SIDE, 1)
        cells = [pixels.resized(image, 5, 5, "lanczos3"), pixels.resized(image, 11, 11, "lanczos3"), pixels.blurred(image, 1.0), pixels.gray(image.reshape(-1)[:63].reshape(1, 21, 3))]
        out.append(np.concatenate([c.reshape(-1) for c in cells]).astype(float))
    return pd.Series(out)


def pixel_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numpy steps of the pixel UDF, pixel by pixel."""
    return _cells(_table(spark, sf_dir, "embeddings").select("vec_id", _kernels("embedding").alias("cells")), "cells")


@F.pandas_udf(T.LongType())
def _pixel_sum(content: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else int(codecs.decode(bytes(x)).astype(int).sum()) for x in content], dtype="Int64")


def image_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for PNG sources made of embeddings, through validation, keys, deduplication, pixels and codecs. The sum of
    pixels is of PNG derivatives that were not blurred: as they were, or by Lanczos."""
    made = _table(spark, sf_dir, "embeddings").select("vec_id", F.format_string("http://img.example.com/%d.png", "vec_id").alias("url"), _png("embedding").alias("r"))
    sources = made.select("url", F.lit(200).alias("status"), F.octet_length("r.content").cast("long").alias("content_length"), F.col("r.content").alias("content"))
    v = F.col("vec_id")
    raw = made.select(v.alias("request_id"), "url", F.when(v % 3 > 0, 12 + v % 5).cast("int").alias("width"), F.when(v % 4 > 0, 10 + v % 7).cast("int").alias("height"), F.element_at(F.array(*map(F.lit, ("png", "webp", "jpg"))), (v % 3 + 1).cast("int")).alias("format"), F.when(v % 2 > 0, 0.8).cast("float").alias("blur_sigma"), (v % 5 == 0).alias("grayscale"))
    known = resize.prepared(raw)
    work, _ = tables.cut(resize.work_list(known, spark.createDataFrame([], store.DERIVATIVES)), "work")
    out = resize.derived(work, sources, 1 << 20).join(work.select("key", "does_blur"), "key")
    total = F.when(~F.col("does_blur") & (F.col("content_type") == "image/png"), _pixel_sum("content"))
    return out.select("key", "content_type", "error", F.col("out_width").cast("long").alias("out_width"), F.col("out_height").cast("long").alias("out_height"), formats.sniffed(F.col("content")).alias("format"), total.alias("pixel_sum"))


QUERIES = {f.__name__: f for f in (resize_keys, request_validation, mime_and_kernel, target_geometry, weighted_bins, cache_probe, cache_misses, download_lookup, keyed_lookup, redirect_location, latest_derivative, dedupe_requests, source_guard, magic_bytes, bench_stats, hit_ratio, stage_averages, latency_quantiles, path_metrics, profile_resolution, store_names, config_validity, bench_requests, resample_triangle, resample_udf, tiled_blur, tiled_resize, grayscale_array, blur_array, png_roundtrip, pixel_kernels, image_pipeline)}


def _values(rows: list[tuple]) -> str:
    said = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).upper() if isinstance(x, bool) else repr(x)
    return ", ".join(f"({', '.join(map(said, r))})" for r in rows)


def _matrix_sql(down: np.ndarray, across: np.ndarray) -> str:
    rows = [(y * len(across) + x, i * SIDE + j, float(down[y, i] * across[x, j])) for y in range(len(down)) for x in range(len(across)) for i in range(SIDE) for j in range(SIDE) if down[y, i] and across[x, j]]
    return f"""WITH w(cell, spot, f) AS (VALUES {_values(rows)})
SELECT vec_id, CAST(cell AS BIGINT) AS cell, round(sum(CAST(embedding[spot + 1] AS DOUBLE) * f), 4) + 0.0 AS value FROM embeddings, w GROUP BY vec_id, cell"""


def _whole_sql(matrices: list[tuple[np.ndarray, np.ndarray]]) -> str:
    """Whole pixels of matrices on 8 x 8 whole pixels, cells one matrix after another, then 21 triples as gray."""
    rows, first = [], 0
    for down, across in matrices:
        rows += [(first + y * len(across) + x, i * SIDE + j, float(down[y, i] * across[x, j])) for y in range(len(down)) for x in range(len(across)) for i in range(SIDE) for j in range(SIDE) if down[y, i] * across[x, j]]
        first += len(down) * len(across)
    r, g, b = pixels.LUMA
    return f"""WITH w(cell, spot, f) AS (VALUES {_values(rows)}),
p AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(greatest(least(floor(v::DOUBLE * 127 + 128 + 0.5), 255), 0) AS DOUBLE)) AS x FROM embeddings)
SELECT vec_id, CAST(cell AS BIGINT) AS cell, greatest(least(floor(sum(x[spot + 1] * f) + 0.5), 255), 0) + 0.0 AS value FROM p, w GROUP BY vec_id, cell
UNION ALL SELECT vec_id, {first} + k, floor((x[3 * k + 1] * {r} + x[3 * k + 2] * {g} + x[3 * k + 3] * {b}) / {r + g + b}) + 0.0 FROM p, range(21) t(k)"""


_TRIANGLE = pixels.weights(SIDE, SMALL, "triangle")
_BLUR = pixels.blur_weights(SIDE, 1.0)
_LANCZOS = [pixels.weights(SIDE, n, "lanczos3") for n in (5, 11)]
_BY_HEIGHT = {n: pixels.weights(SIDE, n, "lanczos3") for n in range(10, 17)}
_BY_HEIGHT_SQL = _values([(n, y * n + x, i * SIDE + j, float(w[y, i] * w[x, j])) for n, w in _BY_HEIGHT.items() for y in range(n) for x in range(n) for i in range(SIDE) for j in range(SIDE) if w[y, i] * w[x, j]])

_SQL_CONFIGS = """
c AS (
  SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1) AS host, page_id % 10 + 3000 AS port,
    CASE WHEN page_id % 7 = 3 THEN 'x,' ELSE (page_id % 3 + 1) || ', x, ' || (page_id % 4) || ' ,' END AS levels,
    CASE WHEN page_id % 11 = 5 THEN ' , ' ELSE url || '?q=a b&r=~*é, ' || url END AS urls,
    ['300x300,800x, x600 ,bad,axb,1200x800', '10x10', 'bad', 'x', '5x7 , 7x'][page_id % 5 + 1] AS sizes, ['jpg', 'png', 'webp'][page_id % 3 + 1] AS format, page_id % 13 AS timeout_s
  FROM pages
), p AS (
  SELECT *, list_filter(list_transform(string_split(levels, ','), lambda x: TRY_CAST(trim(x) AS BIGINT)), lambda x: x IS NOT NULL) AS l,
    list_transform(string_split(urls, ','), lambda x: trim(x)) AS u,
    list_filter(list_transform(string_split(sizes, ','), lambda x: trim(x)), lambda x: contains(x, 'x')) AS z FROM c
)"""

ORACLE_SQL = {
    "resize_keys": f"WITH {_SQL_REQUESTS} SELECT request_id, key, {_SQL_LOCATION} AS location FROM keyed",
    "request_validation": f"""
WITH r(i, width, height, blur, format) AS (VALUES {_values([(i, *r) for i, r in enumerate(BAD)])}),
q AS (SELECT page_id, i, width, height, CAST(blur AS FLOAT) AS blur, format, CASE page_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'no url' ELSE url END AS url FROM pages, r)
SELECT page_id, i, coalesce(nullif(concat_ws(',',
  CASE WHEN url IS NULL OR NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') THEN 'url' END,
  CASE WHEN width NOT BETWEEN 10 AND 4096 THEN 'width' END, CASE WHEN height NOT BETWEEN 10 AND 4096 THEN 'height' END,
  CASE WHEN blur NOT BETWEEN 0 AND 100 THEN 'blur_sigma' END, CASE WHEN format NOT IN ('png', 'webp', 'jpg') THEN 'format' END), ''), '-') AS error
FROM q""",
    "mime_and_kernel": f"""
WITH {_SQL_REQUESTS} SELECT request_id, CASE format WHEN 'jpg' THEN 'image/jpeg' WHEN 'png' THEN 'image/png' ELSE 'image/webp' END AS content_type,
  CASE WHEN width <= 300 AND height <= 300 THEN 'triangle' ELSE 'lanczos3' END AS kernel,
  coalesce(grayscale, false) AS does_gray, coalesce(blur_sigma > 0, false) AS does_blur FROM raw""",
    "target_geometry": f"""
WITH s(i, w, h) AS (VALUES {_values([(i, *s) for i, s in enumerate([*SIZES, (None, None)])])}),
src AS (SELECT p_partkey, i, w, h, p_size * 40 AS ow, (p_partkey % 37 + 1) * 30 AS oh FROM part, s),
r AS (SELECT *, CASE WHEN h IS NULL THEN w::DOUBLE / ow WHEN w IS NULL THEN h::DOUBLE / oh ELSE greatest(w::DOUBLE / ow, h::DOUBLE / oh) END AS k FROM src),
z AS (SELECT *, CASE WHEN w IS NULL AND h IS NULL THEN ow ELSE greatest(floor(ow * k + 0.5), 1) END::BIGINT AS scaled_w,
             CASE WHEN w IS NULL AND h IS NULL THEN oh ELSE greatest(floor(oh * k + 0.5), 1) END::BIGINT AS scaled_h FROM r),
o AS (SELECT *, w IS NOT NULL AND h IS NOT NULL AS b FROM z),
f AS (SELECT p_partkey, i, scaled_w, scaled_h, CASE WHEN b THEN greatest(scaled_w - w, 0) // 2 ELSE 0 END::BIGINT AS crop_x, CASE WHEN b THEN greatest(scaled_h - h, 0) // 2 ELSE 0 END::BIGINT AS crop_y,
             CASE WHEN b THEN least(scaled_w, w) ELSE scaled_w END::BIGINT AS out_w, CASE WHEN b THEN least(scaled_h, h) ELSE scaled_h END::BIGINT AS out_h,
             CASE WHEN w <= 300 AND h <= 300 THEN 'triangle' ELSE 'lanczos3' END AS kernel FROM o)
SELECT *, out_w * out_h // 2 AS jpg_bytes, out_w * out_h * 4 AS png_bytes, out_w * out_h // 3 AS webp_bytes, out_w * out_h * 3 AS other_bytes FROM f""",
    "weighted_bins": """
WITH w AS (SELECT p_partkey, (p_size * CASE WHEN p_partkey % 97 = 0 THEN 900 ELSE 40 END * ((p_partkey % 37 + 1) * 30))::BIGINT AS px, p_partkey % 4 AS f FROM part),
b AS (SELECT p_partkey, CASE f WHEN 0 THEN px // 2 WHEN 1 THEN px * 4 WHEN 2 THEN px // 3 ELSE px * 3 END AS bytes FROM w)
SELECT p_partkey, bytes, CAST((sum(bytes) OVER (ORDER BY p_partkey) - bytes) // 67108864 AS BIGINT) AS bin FROM b""",
    "cache_probe": f"WITH {_SQL_REQUESTS} SELECT request_id, key FROM keyed WHERE key IN (SELECT key FROM keyed WHERE page_id % 2 = 0)",
    "cache_misses": f"WITH {_SQL_REQUESTS} SELECT request_id, key FROM keyed WHERE key NOT IN (SELECT key FROM keyed WHERE page_id % 2 = 0)",
    "download_lookup": f"""
WITH {_SQL_REQUESTS}, st AS (SELECT key, max_by(struct_pack(format := format, n := strlen(url)), request_id) AS v FROM keyed WHERE page_id % 2 = 0 GROUP BY key)
SELECT request_id, v IS NOT NULL AS found, CAST(coalesce(v.n, 0) AS INTEGER) AS n_bytes,
  CASE v.format WHEN 'jpg' THEN 'image/jpeg' WHEN 'png' THEN 'image/png' WHEN 'webp' THEN 'image/webp' END AS content_type,
  CASE WHEN v IS NOT NULL THEN '{formats.CACHE_CONTROL}' END AS cache_control, CASE WHEN v IS NULL THEN 'not found' END AS error
FROM keyed LEFT JOIN st USING (key)""",
    "keyed_lookup": f"""
WITH {_SQL_REQUESTS}, st AS (
  SELECT key, max_by(struct_pack(format := format, n := strlen(url) + CASE WHEN page_id % 8 = 0 THEN 1 WHEN page_id % 4 = 0 THEN 0 ELSE 4 END), CASE WHEN page_id % 8 = 0 THEN 2 WHEN page_id % 4 = 0 THEN 1 ELSE 0 END) AS v
  FROM keyed WHERE page_id % 2 = 0 GROUP BY key)
SELECT request_id, v IS NOT NULL AS found, CAST(coalesce(v.n, 0) AS INTEGER) AS n_bytes,
  CASE v.format WHEN 'jpg' THEN 'image/jpeg' WHEN 'png' THEN 'image/png' WHEN 'webp' THEN 'image/webp' END AS content_type, CASE WHEN v IS NULL THEN 'not found' END AS error
FROM keyed LEFT JOIN st USING (key)""",
    "redirect_location": f"WITH {_SQL_REQUESTS}, f AS (SELECT *, key IN (SELECT key FROM keyed WHERE page_id % 2 = 0) AS found FROM keyed) SELECT request_id, found, CASE WHEN found THEN {_SQL_LOCATION} ELSE url END AS location FROM f",
    "latest_derivative": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "dedupe_requests": "SELECT concat_ws(':', user_id, event_type) AS key, min(event_id) AS request_id, arg_min(value, event_id) AS value FROM events GROUP BY 1",
    "source_guard": """
SELECT doc_id, status, content_length, CASE WHEN status IS NULL OR status NOT BETWEEN 200 AND 299 THEN 'status' WHEN content_length > 2000 THEN 'too large' END AS error
FROM (SELECT doc_id, [200, 204, 299, 301, 404, 500, NULL][doc_id % 7 + 1] AS status, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE n_chars END AS content_length FROM documents)""",
    "magic_bytes": """
WITH c AS (SELECT doc_id, ['FFD8FFE0', '89504E47', '52494646AABBCCDD57454250', '52494646', ''][doc_id % 5 + 1] || CASE WHEN doc_id % 3 = 0 THEN '00000000000000' ELSE hex(encode(text)) END AS x FROM documents)
SELECT doc_id, CASE WHEN length(x) < 24 THEN '-' WHEN x LIKE 'FFD8FF%' THEN 'jpg' WHEN x LIKE '89504E47%' THEN 'png' WHEN x LIKE '52494646________57454250%' THEN 'webp' ELSE '-' END AS format,
  CAST(length(x) // 2 AS INTEGER) AS n_bytes FROM c""",
    "bench_stats": """
WITH l AS (SELECT [1, 5, 10, 20, 50][user_id % 5 + 1] AS level, event_type <> 'error' AS success, CAST(floor(value * 1000) AS BIGINT) AS us, TRY_CAST(props ->> '$.k' AS BIGINT) AS n FROM events),
a AS (SELECT * FROM l UNION ALL SELECT 0, false, us, n FROM l WHERE level = 1),
s AS (SELECT level, count(*) AS requests, count(*) FILTER (success) AS successes, sum(us) FILTER (success) AS t, min(us) FILTER (success) AS lo, max(us) FILTER (success) AS hi, coalesce(sum(n) FILTER (success), 0) AS b FROM a GROUP BY level)
SELECT level, requests, successes, CAST(CASE WHEN successes > 0 THEN t // successes // 1000 END AS BIGINT) AS avg_ms, lo // 1000 AS min_ms, hi // 1000 AS max_ms,
  CAST(CASE WHEN successes > 0 THEN b END AS BIGINT) AS total_bytes, CASE WHEN successes > 0 THEN round(successes / 60.0::DOUBLE, 6) END AS requests_per_s,
  CASE WHEN successes > 0 THEN round(b / 1048576.0::DOUBLE / 60.0::DOUBLE, 9) END AS mib_per_s FROM s""",
    "hit_ratio": """
WITH c AS (SELECT count(*) AS requests, count(*) FILTER (event_type = 'view') AS hits, count(*) FILTER (event_type = 'click') AS misses FROM events)
SELECT *, coalesce(round(hits::DOUBLE / nullif(hits + misses, 0), 9), 0.0) AS hit_ratio FROM c""",
    "stage_averages": "SELECT event_type AS stage, count(*) AS n, round(sum(floor(value)) / count(*), 6) AS avg_ms FROM events GROUP BY event_type",
    "latency_quantiles": """
WITH h AS (
  SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, CASE WHEN value > 1 THEN CAST(ceil(ln(value - 1) / ln(1.01::DOUBLE / 0.99::DOUBLE)) AS INTEGER) END AS bucket, count(*) AS n
  FROM events WHERE value IS NOT NULL GROUP BY ALL
), r AS (
  SELECT *, sum(n) OVER (PARTITION BY day, event_type) AS total, sum(n) OVER (PARTITION BY day, event_type ORDER BY bucket NULLS FIRST) AS until,
    coalesce(exp(bucket * ln(1.01::DOUBLE / 0.99::DOUBLE)) * 0.99::DOUBLE, 0) AS v FROM h
)
SELECT day, event_type, CAST(max(total) AS BIGINT) AS n, round(min(v) FILTER (until >= ceil(total * 0.5)), 6) AS p50, round(min(v) FILTER (until >= ceil(total * 0.9)), 6) AS p90,
  round(min(v) FILTER (until >= ceil(total * 0.99)), 6) AS p99
FROM r GROUP BY day, event_type""",
    "path_metrics": """
SELECT path, status, count(*) AS n FROM (SELECT ['/health', '/metrics/x', '/api/images/resize', '/api/images/files', '/healthy', '/'][event_id % 6 + 1] AS path, 200 + event_id % 3 * 100 AS status FROM events)
WHERE NOT (starts_with(path, '/health') OR starts_with(path, '/metrics')) GROUP BY path, status""",
    "profile_resolution": """
WITH p(name, d, n, s, mib, t, h, c, k) AS (VALUES ('', 20, 8, 30, 50, 8, false, 50, 60), ('high_throughput', 50, 16, 15, 100, 8, true, 100, 120), ('low_latency', 10, 8, 10, 20, 8, true, 25, 30), ('memory_efficient', 5, 4, 45, 10, 4, false, 10, 30)),
r AS (SELECT *, lower(['High_Throughput', 'low_latency', 'MEMORY_EFFICIENT', 'nonsense', ''][c_custkey % 5 + 1]) AS asked FROM customer)
SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN c_nationkey + 1 ELSE d END AS max_concurrent_downloads, n AS max_concurrent_processing, s AS http_timeout_s, mib * 1048576::BIGINT AS max_image_bytes,
  CASE WHEN c_nationkey % 4 = 1 THEN c_nationkey ELSE t END AS pool, h AS enable_http2, c AS connection_pool, k AS keep_alive_s
FROM r JOIN p ON p.name = CASE WHEN asked = 'nonsense' THEN '' ELSE asked END""",
    "store_names": f"""
SELECT p_partkey, CASE WHEN u IN ('S3', 'MINIO') THEN 's3' WHEN u IN ('LOCAL_FS', 'LOCALFS', 'LOCAL') THEN 'local' WHEN u IN ('IN_MEMORY', 'INMEMORY', 'MEMORY') THEN 'memory' ELSE 'error' END AS store
FROM (SELECT p_partkey, upper(CASE WHEN p_partkey % 11 = 0 THEN p_brand ELSE {STORE_ROWS!r}[p_partkey % 10 + 1] END) AS u FROM part)""",
    "config_validity": f"""
WITH {_SQL_CONFIGS}
SELECT page_id, CASE WHEN len(l) = 0 THEN 'no valid concurrency levels' WHEN len(list_filter(u, lambda x: x <> '')) = 0 THEN 'no valid urls'
  WHEN len(z) = 0 THEN 'no valid sizes' WHEN timeout_s <= 0 THEN 'the timeout must be over 0' ELSE '-' END AS error FROM p""",
    "bench_requests": f"""
WITH {_SQL_CONFIGS}, e AS (SELECT page_id, host, port, format, level, unnest(range(level)) AS i, u, z FROM (SELECT *, unnest(l) AS level FROM p WHERE len(l) > 0 AND len(z) > 0) WHERE level > 0),
q AS (SELECT *, u[i % len(u) + 1] AS url, TRY_CAST(nullif(split_part(z[i % len(z) + 1], 'x', 1), '') AS BIGINT) AS width, TRY_CAST(nullif(split_part(z[i % len(z) + 1], 'x', 2), '') AS BIGINT) AS height FROM e)
SELECT page_id, level, i, width, height, 'http://' || host || ':' || port || '/api/images/resize?url=' || replace(replace(url_encode(url), '+', '%20'), '*', '%2A') || '&'
  || concat_ws('&', 'width=' || width, 'height=' || height, 'format=' || format) AS request FROM q""",
    "resample_triangle": _matrix_sql(_TRIANGLE, _TRIANGLE),
    "resample_udf": _matrix_sql(_TRIANGLE, _TRIANGLE),
    "grayscale_array": """
SELECT vec_id, cell, round(0.2126::DOUBLE * embedding[3 * cell + 1]::DOUBLE + 0.7152::DOUBLE * embedding[3 * cell + 2]::DOUBLE + 0.0722::DOUBLE * embedding[3 * cell + 3]::DOUBLE, 4) + 0.0 AS value
FROM (SELECT vec_id, embedding, unnest(range(21)) AS cell FROM embeddings)""",
    "blur_array": _matrix_sql(_BLUR, _BLUR),
    "tiled_blur": _matrix_sql(_BLUR, _BLUR),
    "tiled_resize": _matrix_sql(_LANCZOS[1], _LANCZOS[1]),
    "png_roundtrip": """
SELECT vec_id, CAST(64 AS INTEGER) AS n_pixels, CAST(sum(greatest(least(floor(v::DOUBLE * 127 + 128 + 0.5), 255), 0)) AS BIGINT) AS total, true AS same, 'png' AS format
FROM (SELECT vec_id, unnest(embedding) AS v FROM embeddings) GROUP BY vec_id""",
    "pixel_kernels": _whole_sql([(w, w) for w in _LANCZOS] + [(_BLUR, _BLUR)]),
    "image_pipeline": f"""
WITH w(n, cell, spot, f) AS (VALUES {_BY_HEIGHT_SQL}),
x AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(greatest(least(floor(v::DOUBLE * 127 + 128 + 0.5), 255), 0) AS DOUBLE)) AS x FROM embeddings WHERE vec_id % 6 = 0),
s AS (SELECT vec_id, CAST(sum(greatest(least(floor(v + 0.5), 255), 0)) AS BIGINT) AS pixel_sum
      FROM (SELECT vec_id, cell, sum(x[spot + 1] * f) AS v FROM x JOIN w ON n = 10 + vec_id % 7 AND vec_id % 4 > 0 GROUP BY vec_id, cell) GROUP BY vec_id
      UNION ALL SELECT vec_id, CAST(list_sum(x) AS BIGINT) FROM x WHERE vec_id % 4 = 0),
q AS (SELECT vec_id, 'http://img.example.com/' || vec_id || '.png' AS url, CASE WHEN vec_id % 3 > 0 THEN 12 + vec_id % 5 END AS w, CASE WHEN vec_id % 4 > 0 THEN 10 + vec_id % 7 END AS h,
  ['png', 'webp', 'jpg'][vec_id % 3 + 1] AS f, CASE WHEN vec_id % 2 > 0 THEN '0.8' ELSE 'None' END AS b, CAST(vec_id % 5 = 0 AS VARCHAR) AS g FROM embeddings),
k AS (SELECT DISTINCT sha256(url || coalesce(w::VARCHAR, 'None') || coalesce(h::VARCHAR, 'None') || f || b || g) || '.' || f AS key, w, h, f, pixel_sum FROM q LEFT JOIN s USING (vec_id))
SELECT key, CASE f WHEN 'jpg' THEN 'image/jpeg' WHEN 'png' THEN 'image/png' ELSE 'image/webp' END AS content_type, CAST(NULL AS VARCHAR) AS error,
  CAST(coalesce(w, h, 8) AS BIGINT) AS out_width, CAST(coalesce(h, w, 8) AS BIGINT) AS out_height, f AS format, pixel_sum FROM k""",
}
