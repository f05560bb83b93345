"""Bins of bounded weight, and pixel tasks that follow them."""

import numpy as np
from pyspark.sql import functions as F

from pixelmill.operators import codecs, placing
from pixelmill.plans import resize


def test_bins_are_bounded_and_tasks_follow(spark):
    """Sizes over five orders of magnitude, in an order that puts the large ones together; AQE coalesces nothing."""
    rng = np.random.default_rng(1)
    sizes = np.sort(rng.lognormal(8, 2, 4000)).astype(int).tolist()
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(sizes)], "id long, bytes long").repartition(7)
    target = 2 * max(sizes)
    got = placing.binned(rows, ["id"], "bytes", target)
    at, want = 0, {}
    for i, w in enumerate(sizes):
        want[i] = at // target
        at += w
    assert {r["id"]: r["bin"] for r in got.collect()} == want and got.columns == ["id", "bytes", "bin"]
    tasks = placing.placed(got).withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.sum("bytes").alias("w"), F.countDistinct("bin").alias("bins")).collect()
    weights = [r["w"] for r in tasks]
    assert len(tasks) == max(want.values()) + 1 and all(r["bins"] == 1 for r in tasks)
    assert max(weights) <= 2 * np.mean(weights) and max(weights) < target + max(sizes)


def test_weights_that_are_odd(spark):
    rows = spark.createDataFrame([(1, None), (2, -5), (3, 10), (3, 10), (None, 10), (4, 0)], "id long, w long")
    got = sorted((r["id"] or 0, r["bin"]) for r in placing.binned(rows, ["id"], "w", 10).collect())
    assert got == [(0, 0), (1, 1), (2, 1), (3, 1), (3, 2), (4, 3)]
    empty = placing.binned(rows.limit(0), ["id"], "w", 10)
    assert empty.isEmpty() and placing.placed(empty).isEmpty()


def test_a_batch_in_bins(spark):
    raw = "request_id long, url string, width int, height int, format string, blur_sigma float, grayscale boolean"
    image = codecs.encode(np.full((12, 20, 3), 9, np.uint8), "png")
    sources = spark.createDataFrame([(f"http://a/{i}.png", 200, len(image), image) for i in range(6)], "url string, status int, content_length long, content binary")
    rows = [(i, f"http://a/{i % 7}.png", 10 + i % 3 * 40, None, "png", None, None) for i in range(30)]
    work = resize.prepared(spark.createDataFrame(rows, raw)).where("error is null").drop("error").dropDuplicates(["key"])
    plain, placed = (resize.derived(work, sources, 10**6, task_bytes=t) for t in (None, 30_000))
    said = lambda df: sorted((r["key"], bytes(r["content"] or b""), r["error"]) for r in df.collect())
    assert said(plain) == said(placed) and placed.rdd.getNumPartitions() >= 5
