"""The derivative store laid out by key: a bucketed table of generations under a manifest.

An append writes one generation, bucketed by key, and then adds it to the manifest; a compaction writes the latest row of each
key as one generation and puts it in place of those that it read. The manifest is a new file each time, which appears whole or
not at all, and only if no other writer's came first. What a reader opened stays as it was until ``vacuum`` takes it away.

A join by key needs no exchange on the store's side, whatever its size: requests go to the buckets. A few keys are looked up
in their buckets alone, where the files' Bloom filters tell most of those that are not there without reading a row.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import tables
from ..functions import keys
from . import store

#: Buckets of a new store: a bucket should stay under some hundred MB.
BUCKETS = 64
#: Most keys that are looked up by name; more are joined.
NAMED = 1000


@dataclass(frozen=True)
class Snapshot:
    version: int
    buckets: int
    generations: tuple[int, ...]


class Store:
    """The store at ``path``; made there with ``buckets`` buckets if there is none."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        if self._latest() is None:
            self._swapped(Snapshot(0, buckets, ()))  # or another writer's was first
        self.buckets = self.snapshot().buckets
        self.table = f"pixelmill_store_{hashlib.md5(self.path.encode()).hexdigest()}_{self.buckets}"
        quoted = self.path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({store.DERIVATIVES}, generation bigint) USING parquet OPTIONS ('parquet.bloom.filter.enabled#key' = 'true') "
            f"PARTITIONED BY (generation) CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{quoted}/rows'"
        )

    # The manifest.

    def _manifests(self) -> list[tuple[int, str]]:
        fs, folder = tables._fs(self.spark, f"{self.path}/_manifests")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted((int(n[1:-5]), n) for n in names if n[0] == "v" and n.endswith(".json"))

    def _latest(self) -> Snapshot | None:
        known = self._manifests()
        if not known:
            return None
        version, name = known[-1]
        text = self.spark.read.text(f"{self.path}/_manifests/{name}", wholetext=True).first()[0]
        held = json.loads(text)
        return Snapshot(version, held["buckets"], tuple(held["generations"]))

    def snapshot(self) -> Snapshot:
        return self._latest()

    def _swapped(self, new: Snapshot) -> bool:
        """Whether ``new`` became the manifest of its version; not if there is one already."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        fs, part = tables._fs(self.spark, f"{self.path}/_manifests/.{uuid.uuid4().hex}")
        _, final = tables._fs(self.spark, f"{self.path}/_manifests/v{new.version:010d}.json")
        out = fs.create(part)
        out.write(bytearray(json.dumps({"buckets": new.buckets, "generations": list(new.generations)}), "ascii"))
        out.close()
        try:
            # Fails where the name is taken, which FileSystem.rename does not promise.
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(
                fs.makeQualified(part), fs.makeQualified(final), self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            )
            return True
        except Py4JJavaError as e:
            fs.delete(part, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName() or fs.exists(final):
                return False
            raise

    # Reading.

    def rows(self, snapshot: Snapshot | None = None) -> DataFrame:
        """All writes that the snapshot (the present one) holds."""
        held = (snapshot or self.snapshot()).generations
        if not held:
            return self.spark.createDataFrame([], store.DERIVATIVES)
        self.spark.sql(f"ALTER TABLE {self.table} ADD IF NOT EXISTS " + " ".join(f"PARTITION (generation = {g})" for g in held))
        return self.spark.table(self.table).where(F.col("generation").isin(*held)).drop("generation")

    def near(self, wanted: DataFrame, snapshot: Snapshot | None = None) -> DataFrame:
        """Writes among which are all of the wanted keys: those of a few keys by name, else all, by bucket."""
        asked = wanted.select("key").where(keys.safe_key(F.col("key"))).distinct().limit(NAMED + 1).collect()
        rows = self.rows(snapshot)
        return rows if len(asked) > NAMED else rows.where(F.col("key").isin(*[r["key"] for r in asked]))

    def probed(self, requests: DataFrame, snapshot: Snapshot | None = None) -> DataFrame:
        return store.probed(requests, self.near(requests, snapshot))

    def downloaded(self, wanted: DataFrame, snapshot: Snapshot | None = None) -> DataFrame:
        return store.downloaded(wanted, self.near(wanted, snapshot))

    # Writing.

    def _generation(self, rows: DataFrame) -> int:
        """Writes a generation, which no one sees before it is in the manifest."""
        generation, view, session = uuid.uuid4().int >> 65, f"rows_{uuid.uuid4().hex}", rows.sparkSession  # a micro-batch has a session of its own
        rows.select("key", "content_type", "content", "seq").createOrReplaceTempView(view)
        try:
            session.sql(f"INSERT INTO {self.table} PARTITION (generation = {generation}) SELECT * FROM {view}")
        finally:
            session.catalog.dropTempView(view)
        return generation

    def append(self, derivatives: DataFrame, seq: int = 0) -> Snapshot:
        """Adds writes of one ``seq``; of a key's writes the one with the greatest counts. One that ran twice counts once."""
        rows = derivatives.select("key", "content_type", "content", F.lit(seq).cast("long").alias("seq"))
        new = self._generation(rows.repartition(self.buckets, "key"))
        while True:
            now = self.snapshot()
            then = Snapshot(now.version + 1, self.buckets, (*now.generations, new))
            if self._swapped(then):
                return then

    def compact(self) -> bool:
        """Merges all generations into one; whether it did. What was appended meanwhile stays beside it."""
        base = self.snapshot()
        if len(base.generations) < 2:
            return False
        new = self._generation(store.latest(self.rows(base)))  # bucket by bucket, without an exchange
        while True:
            now = self.snapshot()
            if not set(base.generations) <= set(now.generations):
                return False  # another compaction was first
            if self._swapped(Snapshot(now.version + 1, self.buckets, (new, *[g for g in now.generations if g not in base.generations]))):
                return True

    def vacuum(self, keep: int = 2, older_s: float = 86_400) -> int:
        """Deletes generations that none of the last ``keep`` manifests holds and that are older than ``older_s`` seconds, as a
        younger one may be on its way into the manifest; how many went."""
        fs, folder = tables._fs(self.spark, f"{self.path}/rows")
        known, held, gone = self._manifests(), set(), 0
        for _, name in known[-keep:]:
            held |= set(json.loads(self.spark.read.text(f"{self.path}/_manifests/{name}", wholetext=True).first()[0])["generations"])
        for status in fs.listStatus(folder) if fs.exists(folder) else []:
            name = status.getPath().getName()
            if name.startswith("generation=") and int(name[11:]) not in held and status.getModificationTime() / 1000 < time.time() - older_s:
                self.spark.sql(f"ALTER TABLE {self.table} DROP IF EXISTS PARTITION (generation = {name[11:]})")
                fs.delete(status.getPath(), True)
                gone += 1
        for _, name in known[:-keep]:
            tables.remove(self.spark, f"{self.path}/_manifests/{name}")
        return gone

    def close(self) -> None:
        """Forgets the table's name; the store stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
