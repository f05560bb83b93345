"""Counters of running plans, mergeable histograms, and the store as a stream's state."""

import time

import numpy as np
import pytest
from pyspark.sql import Observation, functions as F

from pixelmill.operators import codecs, keyed, metrics, stats
from pixelmill.plans import resize
from pixelmill.streaming import serve

RAW = "request_id long, url string, width int, height int, format string, blur_sigma float, grayscale boolean"


def png(value=9):
    return codecs.encode(np.full((12, 20, 3), value, np.uint8), "png")


def asked(i, url="http://a/1.png", width=10, fmt="png"):
    return (i, url, width, None, fmt, None, None)


def test_counters_come_from_the_job_that_runs_anyway(spark, tmp_path):
    sources = spark.createDataFrame([("http://a/1.png", 200, None, png())], "url string, status int, content_length long, content binary")
    rows = [asked(1), asked(2), asked(3, width=11), asked(4, width=5), asked(5, url="http://a/none.png")]
    kept, jobs = str(tmp_path / "s"), []
    for n in range(2):
        seen = Observation()
        spark.sparkContext.setJobGroup(f"with-{n}", "")
        answer = resize.resize_batch(spark.createDataFrame(rows, RAW), sources, kept, "http://cdn", observation=seen)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"with-{n}")))
        counted = stats.counters(answer, "cached", "not cached and error is null").first()
        assert (seen.get["requests"], seen.get["hits"], seen.get["misses"]) == (counted["requests"], counted["hits"], counted["misses"]) == ((5, 0, 3) if n == 0 else (5, 3, 0))
        assert seen.get["errors"] == 2 and metrics.ratio(seen.get) == counted["hit_ratio"] == float(n)
    spark.sparkContext.setJobGroup("without", "")
    resize.resize_batch(spark.createDataFrame(rows, RAW), sources, kept, "http://cdn")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("without")) == jobs[1]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_counters_of_a_stream(spark, tmp_path):
    sources = spark.createDataFrame([("http://a/1.png", 200, None, png())], "url string, status int, content_length long, content binary")
    inbox, running, kept = str(tmp_path / "in"), metrics.Running("x"), keyed.Store(spark, f"file://{tmp_path}/s", 2)
    for part in ([asked(1)], [asked(2), asked(3, width=1)]):
        spark.createDataFrame(part, RAW).write.mode("append").parquet(inbox)
        q = serve.serve(spark.readStream.schema(RAW).parquet(inbox), sources, kept, str(tmp_path / "out"), str(tmp_path / "cp"), "http://cdn", running=running)
        q.awaitTermination(120)
        assert q.exception() is None
    assert running.counts == {"requests": 3, "hits": 1, "misses": 1, "errors": 1, "hit_ratio": 0.5} and metrics.Running("y").counts["hit_ratio"] == 0.0
    kept.close()


def test_histograms_merge_and_quantiles_are_near(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.lognormal(3, 2, 20_000), np.zeros(50), [-5.0, 1e-9, 1e12]])
    log = spark.createDataFrame([(float(v), "a" if i % 3 else "b") for i, v in enumerate(values)] + [(None, "a")], "ms double, kind string")
    whole = stats.histogram(log, "ms", "kind")
    parts = stats.merged(stats.histogram(log.where("ms < 10"), "ms", "kind").unionByName(stats.histogram(log.where("ms >= 10"), "ms", "kind")), "kind")
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect())) and whole.count() < 4000
    wanted = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]
    for r in stats.quantiles(parts, wanted, "kind").collect():
        own = np.sort([v for i, v in enumerate(values) if (r["kind"] == "a") == bool(i % 3)])
        assert r["n"] == len(own)
        for q in wanted:
            exact = max(own[max(0, int(np.ceil(q * len(own))) - 1)], 0)
            assert abs(r[f"p{round(q * 100)}"] - exact) <= stats.ERROR * exact * 1.0001, q
    plan = stats.histogram(log, "ms", "kind")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_count") > plan.index("Exchange")
    assert stats.quantiles(stats.histogram(log.limit(0), "ms", "kind"), wanted, "kind").count() == 0


def test_histograms_over_event_time(spark, tmp_path):
    """The counts of a stream's windows, as they close, are those of the batch."""
    inbox = str(tmp_path / "in")
    rows = spark.range(400).selectExpr("timestamp_seconds(1700000000 + id * 30) as ts", "double(id % 37) as ms")
    for part in ("ts < '2023-11-14 23:30:00'", "ts >= '2023-11-14 23:30:00'"):
        rows.where(part).coalesce(1).write.mode("append").parquet(inbox)
    by = F.window("ts", "30 minutes")
    stream = spark.readStream.option("maxFilesPerTrigger", 1).schema(rows.schema).parquet(inbox).withWatermark("ts", "1 minute")
    q = stats.histogram(stream, "ms", by).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    closed = spark.read.parquet(str(tmp_path / "out"))
    want = stats.histogram(rows, "ms", by).join(closed.select("window").distinct(), "window", "left_semi")
    assert closed.select("window").distinct().count() >= 3 and sorted(map(str, closed.select("window", "bucket", "n").collect())) == sorted(map(str, want.select("window", "bucket", "n").collect()))


def test_a_store_in_a_streams_state(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    from pixelmill.streaming import memory

    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "1.png").write_bytes(png())
    inbox, running = str(tmp_path / "in"), metrics.Running("memory")
    spark.streams.addListener(running)

    def run(rows):
        spark.createDataFrame(rows, RAW).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.option("maxFilesPerTrigger", 1).schema(RAW).parquet(inbox)
        q = memory.serve(stream, memory.from_files(str(tmp_path / "src")), str(tmp_path / "out"), str(tmp_path / "cp"), "http://cdn/", name="memory")
        q.awaitTermination(240)
        assert q.exception() is None

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        run([asked(1), asked(2), asked(3, width=11), asked(4, width=5), asked(5, url="http://a/none.png")])
        (tmp_path / "src" / "1.png").unlink()  # what is answered now is answered from the state
        (tmp_path / "src" / "none.png").write_bytes(png(3))
        run([asked(6), asked(7, width=12), asked(8, url="http://a/none.png"), asked(9, url="http://a/none.png")])
        run([asked(10, url="http://a/none.png"), asked(11)])
        for _ in range(300):  # a batch's event follows it
            if running.counts["requests"] < 11:
                time.sleep(0.1)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
        spark.streams.removeListener(running)
    got = {r["request_id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert sorted(got) == list(range(1, 12)) and {i: r["cached"] for i, r in got.items()} == {i: i in (6, 10, 11) for i in range(1, 12)}
    assert got[1]["location"] == got[6]["location"] == f"http://cdn/{got[1]['key']}" and not any(got[i]["error"] for i in (1, 2, 3, 6, 8, 9, 10, 11))
    assert got[4]["error"] == "width" and got[5]["error"].startswith("no source") and got[7]["error"].startswith("no source") and got[7]["location"] == "http://a/1.png"
    assert running.counts["requests"] == 11 and running.counts["hits"] == 3 and running.counts["errors"] == 3
