"""The store by key: plans without an exchange on its side, buckets, snapshots, crashes, compaction, streams."""

import hashlib
import os
import re

import pytest
from pyspark.sql import functions as F

from pixelmill.operators import codecs, keyed, store
from pixelmill.plans import resize
from pixelmill.streaming import serve

import numpy as np


def key(i):
    return hashlib.sha256(str(i).encode()).hexdigest() + ".png"


def writes(spark, ids, said):
    return spark.createDataFrame([(key(i), "image/png", f"{said}{i}".encode()) for i in ids], "key string, content_type string, content binary")


def held(df):
    return {r["key"]: bytes(r["content"]).decode() for r in df.collect()}


@pytest.fixture
def kept(spark, tmp_path):
    s = keyed.Store(spark, f"file://{tmp_path}/store", 8)
    s.append(writes(spark, range(300), "a"), 1)
    s.append(writes(spark, range(200, 400), "b"), 2)
    yield s
    s.close()


WANT = {key(i): f"{'a' if i < 200 else 'b'}{i}" for i in range(400)}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df):
    """The scans of the store in a plan that ran: (files, rows)."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        elif name == "FileSourceScanExec":
            found.append((p.metrics().apply("numFiles").value(), p.metrics().apply("numOutputRows").value()))
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_many_keys_are_joined_without_an_exchange_of_the_store(spark, kept, monkeypatch):
    monkeypatch.setattr(keyed, "NAMED", 10)
    asked = spark.range(100, 5000).select(F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit(".png")).alias("key"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = kept.near(asked)
        for df in (asked.join(rows.select("key"), "key", "left_anti"), asked.join(rows.select("key"), "key", "left_semi"), kept.probed(asked)):
            said = plan(df)
            side = said[said.index("FileScan") - 900 : said.index("FileScan")]
            assert said.count("Exchange") == 1 and "SelectedBucketsCount: 8 out of 8" in said, said
            assert "Range (100, 5000" in said[said.index("Exchange") :] and "Exchange" not in side[side.rindex("Sort [") if "Sort [" in side else 0 :]
        assert asked.join(rows.select("key"), "key", "left_semi").count() == 300
        merged = plan(store.latest(kept.rows()))
        assert "Exchange" not in merged and "Bucketed: true" in merged
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {k: v for k, v in held(kept.downloaded(asked).where("found")).items()} == {k: v for k, v in WANT.items() if int(re.sub("[ab]", "", v)) >= 100}


def test_few_keys_read_their_buckets_alone(spark, kept):
    asked = writes(spark, [5, 250, 9999], "x").select("key")
    got = {r["key"]: (r["found"], bytes(r["content"]).decode(), r["error"]) for r in kept.downloaded(asked).collect()}
    assert got == {key(5): (True, "a5", None), key(250): (True, "b250", None), key(9999): (False, "", "not found")}
    near = kept.near(asked)
    files = {r["f"].rsplit("/", 1)[1] for r in kept.rows().select(F.input_file_name().alias("f")).distinct().collect()}
    buckets = {int(re.search(r"_(\d{5})\.", f)[1]) for f in files}
    read = {int(re.search(r"_(\d{5})\.", r["f"])[1]) for r in near.select("key", F.input_file_name().alias("f")).collect()}
    assert buckets == set(range(8)) and len(read) <= 2 and "SelectedBucketsCount" in plan(near) or "In(key" in plan(near)


def test_filters_tell_what_is_not_there(spark, tmp_path):
    """Keys that no file holds, within the range of those that it does: no row is read."""
    s = keyed.Store(spark, f"file://{tmp_path}/bloom", 2)
    s.append(spark.range(60_000).select(F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit(".png")).alias("key"), F.lit("image/png").alias("content_type"), F.lit(b"x").alias("content")))
    absent = s.near(writes(spark, [70_001], "x").select("key"))
    there = s.near(writes(spark, [7], "x").select("key"))
    (n_files, none), (_, some) = scans(absent)[0], scans(there)[0]
    assert n_files <= 2 and none == 0 and 0 < some <= 60_000 and there.count() == 1
    s.close()


def test_snapshots_and_a_crash_before_the_swap(spark, kept, monkeypatch):
    old = kept.snapshot()
    reader = kept.rows(old)
    assert held(store.latest(reader)) == WANT
    monkeypatch.setattr(keyed.Store, "_swapped", lambda self, new: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        kept.compact()
    with pytest.raises(RuntimeError):
        kept.append(writes(spark, range(50), "lost"), 3)
    monkeypatch.undo()
    assert kept.snapshot() == old and held(store.latest(kept.rows())) == WANT  # what was written is in no manifest
    assert kept.compact() and len(kept.snapshot().generations) == 1
    assert held(kept.rows()) == WANT and kept.rows().count() == 400
    assert held(store.latest(reader)) == WANT  # a reader that began before the swap
    assert not kept.compact()
    kept.append(writes(spark, [7], "c"), 3)
    assert held(store.latest(kept.rows())) == WANT | {key(7): "c7"}
    assert kept.vacuum(keep=1, older_s=10**6) == 0 and kept.vacuum(keep=1, older_s=-5) == 4
    assert held(store.latest(kept.rows())) == WANT | {key(7): "c7"}


def test_writers_that_meet(spark, kept, monkeypatch):
    """An append comes between a compaction's reading and its swap; another compaction's swap makes it give up."""
    merge = keyed.Store._generation

    def slow(self, rows):
        generation = merge(self, rows)
        monkeypatch.setattr(keyed.Store, "_generation", merge)
        self.append(writes(spark, [3, 1000], "late"), 9)
        return generation

    monkeypatch.setattr(keyed.Store, "_generation", slow)
    assert kept.compact() and len(kept.snapshot().generations) == 2
    assert held(store.latest(kept.rows())) == WANT | {key(3): "late3", key(1000): "late1000"}

    def beaten(self, rows):
        generation = merge(self, rows)
        monkeypatch.setattr(keyed.Store, "_generation", merge)
        assert self.compact()
        return generation

    monkeypatch.setattr(keyed.Store, "_generation", beaten)
    assert not kept.compact() and len(kept.snapshot().generations) == 1
    taken = keyed.Snapshot(kept.snapshot().version, 8, ())
    assert not kept._swapped(taken) and kept.snapshot().generations
    assert held(kept.rows()) == WANT | {key(3): "late3", key(1000): "late1000"}


def test_a_store_that_is_opened_again(spark, kept):
    path = kept.path
    kept.close()
    again = keyed.Store(spark, path, 999)
    assert again.buckets == 8 and held(store.latest(again.rows())) == WANT
    empty = keyed.Store(spark, path + "-none", 4)
    assert empty.rows().isEmpty() and not empty.compact() and empty.downloaded(writes(spark, [1], "x").select("key")).first()["error"] == "not found"
    empty.close()


def test_a_batch_and_a_stream_on_a_store_by_key(spark, tmp_path):
    raw = "request_id long, url string, width int, height int, format string, blur_sigma float, grayscale boolean"
    sources = spark.createDataFrame([("http://a/1.png", 200, None, codecs.encode(np.full((12, 20, 3), 9, np.uint8), "png"))], "url string, status int, content_length long, content binary")
    kept = keyed.Store(spark, f"file://{tmp_path}/s", 4)
    rows = [(i, "http://a/1.png", 10 + i % 3, None, "png", None, None) for i in range(6)]
    got = resize.resize_batch(spark.createDataFrame(rows[:2], raw), sources, kept, "http://cdn").collect()
    assert not any(r["cached"] for r in got) and kept.rows().count() == 2
    inbox = str(tmp_path / "in")
    for n in range(3):
        spark.createDataFrame(rows[2 * n : 2 * n + 2], raw).write.mode("append").parquet(inbox)
    stream = spark.readStream.option("maxFilesPerTrigger", 1).schema(raw).parquet(inbox)
    q = serve.serve(stream, sources, kept, str(tmp_path / "out"), str(tmp_path / "cp"), "http://cdn", compact_every=2)
    q.awaitTermination(240)
    assert q.exception() is None
    answers = spark.read.parquet(str(tmp_path / "out"))
    assert answers.count() == 6 and kept.rows().count() == 3 and answers.where("cached").count() >= 4
    assert len(kept.snapshot().generations) < 4 and len(os.listdir(tmp_path / "s" / "rows")) >= 3
    kept.close()
