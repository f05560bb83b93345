"""The shared folder, and tables that go with their scope."""

import threading
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from pixelmill import tables
from pixelmill.streaming import serve


def test_a_scope_takes_only_its_own_threads_tables(spark):
    opened, made = threading.Event(), threading.Event()
    inner = {}

    def other():
        with tables.scope(spark) as names:
            opened.set()
            made.wait(60)
            inner["df"], inner["path"] = tables.cut(spark.range(3), "inner")
            inner["names"] = list(names)

    thread = threading.Thread(target=other)
    thread.start()
    opened.wait(60)
    ours, path = tables.cut(spark.range(5), "ours")  # made while the other thread's scope is open
    made.set()
    thread.join(60)
    assert inner["names"] == [inner["path"]] and ours.count() == 5
    assert tables._fs(spark, path)[0].exists(tables._fs(spark, path)[1])
    fs, gone = tables._fs(spark, inner["path"])
    assert not fs.exists(gone)


def test_nested_scopes(spark):
    with tables.scope(spark):
        outer, _ = tables.cut(spark.range(2), "outer")
        with pytest.raises(ZeroDivisionError), tables.scope(spark):
            _, path = tables.cut(spark.range(2), "inner")
            raise ZeroDivisionError
        fs, gone = tables._fs(spark, path)
        assert outer.count() == 2 and not fs.exists(gone)


def test_a_stream_beside_a_batch_query(spark, tmp_path):
    """Micro-batches end their scopes while a batch query reads what it cut."""
    raw = "request_id long, url string, width int, height int, format string, blur_sigma float, grayscale boolean"
    inbox = str(tmp_path / "in")
    for n in range(3):
        spark.createDataFrame([(n, "http://a/1.png", 10, None, None, None, None)], raw).write.mode("append").parquet(inbox)
    sources = spark.createDataFrame([], "url string, status int, content_length long, content binary")
    stream = spark.readStream.option("maxFilesPerTrigger", 1).schema(raw).parquet(inbox)
    ours, _ = tables.cut(spark.range(7).withColumn("x", F.col("id") * 2), "before")
    query = serve.serve(stream, sources, str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "cp"), "http://cdn")
    during, _ = tables.cut(spark.range(9), "during")
    query.awaitTermination(180)
    assert query.exception() is None and ours.count() == 7 and during.count() == 9
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf:
        def __init__(self, **known):
            self.known = known

        def get(self, name, default=None):
            return self.known.get(name, default)

    def session(master, **known):
        context = SimpleNamespace(master=master, getConf=lambda: Conf())
        return SimpleNamespace(conf=Conf(**known), sparkContext=context, _jvm=spark._jvm, _jsc=spark._jsc)

    warehouse = {"spark.sql.warehouse.dir": "file:/home/x/spark-warehouse"}
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
            tables.shared_dir(session(master, **warehouse))
    with pytest.raises(ValueError):
        tables.shared_dir(session("yarn", **{"spark.sql.warehouse.dir": "/bare/path"}))
    assert tables.shared_dir(session("yarn", **warehouse, **{"spark.checkpoint.dir": "hdfs://n/shared/"})) == "hdfs://n/shared"
    assert tables.shared_dir(session("local[2]", **warehouse)).startswith("file://")
