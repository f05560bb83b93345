"""Images over HTTP, from a DataFrame of urls. Off unless hosts are allowed by name.

Each distinct url is fetched once. A host's urls are dealt over ``per_host`` lanes by a hash, and a lane is one connection at a
time in one task, so a host is asked over ``per_host`` connections at most, however many tasks run; a host that holds most
urls is still spread over as many tasks. Tasks follow the number of urls, not of their bytes. Reading is idempotent: a task that
runs again fetches again. Redirects are followed only to allowed hosts. A body over ``max_bytes`` is an error whether or not
its length was declared. ``fetch_ms``: how long the fetch took.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .. import tables
from . import config

#: Urls of a task, as expected, and most tasks.
URLS, MOST_TASKS = 64, 1 << 16
SCHEMA = "url string, status int, content_length long, content binary, error string, fetch_ms long"


def allowed(url: str, hosts: set[str]) -> bool:
    parts = urlsplit(url)
    return parts.scheme in ("http", "https") and (parts.hostname or "").lower() in hosts


def fetch(url: str, hosts: set[str], timeout: float, most: int) -> tuple:
    import urllib.error
    import urllib.request

    class Same(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, req, fp, code, msg, headers, newurl):
            if not allowed(newurl, hosts):
                raise urllib.error.URLError("redirect to a host that is not allowed")
            return super().redirect_request(req, fp, code, msg, headers, newurl)

    if not allowed(url, hosts):
        return url, None, None, None, "host not allowed"
    try:
        with urllib.request.build_opener(Same).open(url, timeout=timeout) as r:
            declared = r.headers.get("Content-Length")
            length = int(declared) if declared and declared.isdigit() else None
            if not 200 <= r.status <= 299:
                return url, r.status, length, None, "status"
            if length is not None and length > most:
                return url, r.status, length, None, "too large"
            body = r.read(most + 1)
            return (url, r.status, length, body, None) if len(body) <= most else (url, r.status, length, None, "too large")
    except urllib.error.HTTPError as e:
        return url, e.code, None, None, "status"
    except (urllib.error.URLError, OSError, ValueError) as e:
        return url, None, None, None, str(e)


def lanes(urls: DataFrame, n: int, per_host: int, a_task: int = URLS) -> DataFrame:
    """``n`` urls with ``lane``, dealt over tasks: the lanes of a host go to tasks one after another."""
    tasks = min(max(1, -(-n // a_task)), MOST_TASKS)
    host = F.lower(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")))
    first, slot = F.xxhash64(host), F.pmod(F.xxhash64(F.lit(3), "url"), F.lit(per_host))
    placed = urls.select("url", (F.pmod(first, F.lit(1 << 40)) * per_host + slot).alias("lane"), F.pmod(F.pmod(first, F.lit(tasks)) + slot, F.lit(tasks)).cast("int").alias("task"))
    # A number of partitions that is given is left alone by adaptive execution, which would put so few bytes into one task.
    return placed.repartitionById(tasks, F.col("task")).select("url", "lane")


def fetched(requests: DataFrame, hosts: Iterable[str], settings: config.Performance | None = None, url: str = "url", per_host: int | None = None) -> DataFrame:
    """(url, status, content_length, content, error, fetch_ms) of the distinct urls of ``requests``; null urls are left out.
    ``per_host``: most connections to a host, by default the settings' downloads; a task has no more than these in all."""
    settings, hosts = settings or config.Performance(), {h.lower() for h in hosts}
    most, timeout, parallel = settings.max_image_bytes, float(settings.http_timeout_s), settings.max_concurrent_downloads
    urls, _ = tables.cut(requests.select(F.col(url).alias("url")).where("url is not null").distinct(), "urls")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from concurrent.futures import ThreadPoolExecutor

        def one(u: str) -> tuple:
            began = time.perf_counter()
            return *fetch(u, hosts, timeout, most), int((time.perf_counter() - began) * 1000)

        kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.string(), pa.int64()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        with ThreadPoolExecutor(parallel) as pool:
            for batch in batches:
                own, lane = batch.column("url").to_pylist(), batch.column("lane").to_pylist()
                for i in range(0, len(own), parallel):  # so many bodies are held at a time
                    queues: dict[int, list[str]] = {}
                    for u, k in zip(own[i : i + parallel], lane[i : i + parallel], strict=True):
                        queues.setdefault(k, []).append(u)
                    rows = [r for done in pool.map(lambda q: [one(u) for u in q], queues.values()) for r in done]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return lanes(urls, urls.count(), per_host or parallel).mapInArrow(task, SCHEMA)
