"""The transactional sink of objects: whole commits, killed attempts, streams that run a batch again."""

import hashlib
import json
import os
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pixelmill.sources import sink


def key(i):
    return f"img/{hashlib.sha256(str(i).encode()).hexdigest()}.png"


def rows(spark, ids, said="v"):
    return spark.createDataFrame([(key(i), "image/png", f"{said}{i}".encode()) for i in ids], "key string, content_type string, content binary")


def there(spark, base):
    return {r["key"]: Path(r["object"].removeprefix("file://")).read_text() for r in sink.committed(spark, base).collect()}


def test_commits_are_whole_and_the_latest_counts(spark, tmp_path):
    base = f"file://{tmp_path}/o"
    assert sink.committed(spark, base).isEmpty()
    sink.write(rows(spark, range(40)).repartition(3), base, seq=1)
    sink.write(rows(spark, range(30, 50), "w").repartition(2), base, seq=2)
    sink.write(rows(spark, [45], "older"), base, seq=1)
    want = {key(i): f"{'v' if i < 30 else 'w'}{i}" for i in range(50)}
    assert there(spark, base) == want
    got = sink.published(spark, base).collect()
    assert len(got) == 50 and not any(r["error"] for r in got)
    assert {k: (tmp_path / "o" / k).read_text() for k in want} == want
    sink.write(rows(spark, []), base)
    assert there(spark, base) == want and sink.swept(spark, base, older_s=-5) == 0


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    base = f"file://{tmp_path}/o"
    sink.write(rows(spark, range(5)), base)
    for bad in (("../x.png", "image/png", b"x"), (key(1), "image/png", None)):
        with pytest.raises(Exception, match="unsafe key or no content"):
            sink.write(rows(spark, range(5, 20), "bad").unionByName(spark.createDataFrame([bad], "key string, content_type string, content binary")).coalesce(2), base, seq=9)
    assert there(spark, base) == {key(i): f"v{i}" for i in range(5)}
    assert sink.swept(spark, base) == 0 and sink.swept(spark, base, older_s=-5) >= 2 and there(spark, base) == {key(i): f"v{i}" for i in range(5)}


def test_attempts_of_one_task(tmp_path):
    """Of two attempts that both ended, one is in the commit."""
    writer = sink.BatchWriter(f"file://{tmp_path}/o", 0, "batch")
    batch = pa.RecordBatch.from_pydict({"key": [key(1)], "content_type": ["image/png"], "content": [b"x"]})
    lost, kept = writer.write(iter([batch])), writer.write(iter([batch]))
    writer.commit([kept, None, writer.write(iter([]))])
    (commit,) = (tmp_path / "o" / "_commits").iterdir()
    assert json.loads(commit.read_text())["lists"] == [kept.listed] != [lost.listed]


KILLED = """
import sys
sys.path.insert(0, {root!r})
import hashlib
from pyspark import TaskContext
from pyspark.sql import SparkSession, functions as F
import pixelmill
from pixelmill.sources import sink
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.execution.arrow.maxRecordsPerBatch", "5").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
pixelmill.ship(spark)

def dies(batches):
    for n, b in enumerate(batches):
        if n == 150 and TaskContext.get().attemptNumber() == 0:
            raise RuntimeError("killed")
        yield b

rows = spark.range(0, 3000, 1, 3).select(F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit(".png")).alias("key"), F.lit("image/png").alias("content_type"), F.repeat(F.col("id").cast("string"), 500).cast("binary").alias("content"))
sink.write(rows.mapInArrow(dies, rows.schema), {base!r})
got = sink.committed(spark, {base!r})
assert got.count() == 3000 == got.select("key").distinct().count() == got.select("object").distinct().count()
print("ALL THERE ONCE")
"""


def test_killed_attempts_leave_each_key_once(tmp_path):
    base, root = f"file://{tmp_path}/o", str(Path(__file__).resolve().parent.parent)
    out = subprocess.run([sys.executable, "-c", KILLED.format(root=root, base=base)], capture_output=True, text=True, timeout=240)
    assert "ALL THERE ONCE" in out.stdout, out.stderr[-2000:]
    staged = [os.path.join(d, f) for d, _, fs in os.walk(tmp_path / "o" / "_staged") for f in fs if f.endswith(".png")]
    assert len(staged) > 3000  # the attempts that were killed had written some


def test_a_stream_whose_batch_runs_again(spark, tmp_path):
    base, inbox, check = f"file://{tmp_path}/o", str(tmp_path / "in"), tmp_path / "cp"
    sink.register(spark)
    schema = "key string, content_type string, content binary"

    def run():
        q = spark.readStream.schema(schema).parquet(inbox).writeStream.format(sink.NAME).option("path", base).option("query", "q").option("checkpointLocation", str(check)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    for n in range(2):
        rows(spark, range(10 * n, 10 * n + 15), f"b{n}-").write.mode("append").parquet(inbox)
        run()
    want = {key(i): f"b{0 if i < 10 else 1}-{i}" for i in range(25)}
    assert there(spark, base) == want
    for f in [*(check / "commits").glob("1"), *(check / "commits").glob(".1.crc")]:  # the driver died after the sink's commit, before its own
        f.unlink()
    run()
    assert there(spark, base) == want and len(list((tmp_path / "o" / "_commits").glob("q-*.json"))) == 2
