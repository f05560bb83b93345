"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters the records over memory-sized buckets by a seeded hash of the whole record. Pass two puts each bucket in
a random order by a Fisher-Yates permutation (the algorithm behind Spark's ``shuffle``) of the bucket's positions. The
buckets one after another are then one uniformly shuffled stream; it is cut into shards whose row counts differ by one
at most, and written. The seed alone decides the result: neither how the table is dealt over tasks nor the number of
shuffle partitions counts, as a permutation's random numbers follow from the seed and the bucket.

Rows that are equal in every column have one hash, whatever their number; where they outweigh a quarter of a bucket they
are numbered first and scattered by hash and number.

Defined cases: null text counts as empty and is kept; null keys are scattered by the rest of their record; rows that are
equal in every column are kept as often as they come (they are interchangeable); an empty table gives no rows; columns
named as an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import shared

#: Bytes of text in a bucket on average, and most rows on average.
BUCKET_BYTES, BUCKET_ROWS = 16 << 20, 1 << 16
#: Most partitions that buckets are dealt over.
PARTITIONS = 1 << 16


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _record(docs: DataFrame, seed: int) -> Column:
    """A seeded hash of all columns (maps, which cannot be hashed, by their entries)."""
    return F.xxhash64(F.lit(seed), *[F.map_entries(f"`{f.name}`") if f.dataType.typeName() == "map" else F.col(f"`{f.name}`") for f in docs.schema.fields])


def permutations(counts: DataFrame, buckets: int, seed: int) -> DataFrame:
    """(bucket, before, perm) of (bucket, n): its Fisher-Yates permutation and how many rows the buckets before it hold.

    ``shuffle`` draws from a generator for each partition, row after row, so buckets are dealt to partitions by their own
    number. The rows are one per memory-sized bucket, so the running sum over all of them is small beside the data.
    """
    before = F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = min(buckets, 4096)
    dealt = counts.withColumn("before", before).repartitionById(parts, F.pmod("bucket", F.lit(parts)).cast("int")).sortWithinPartitions("bucket")
    return dealt.select("bucket", "before", F.shuffle(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), seed * 1_000_003).alias("perm"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows (__pm_record, ...) with ``__pm_i``, from 0 for each record: places in written parts, and what parts before hold."""
    rows, _ = shared.cut(rows.withColumn("__pm_at", F.monotonically_increasing_id()), "equal")
    rows = rows.withColumn("__pm_part", F.shiftright("__pm_at", 33))
    held = rows.groupBy("__pm_record", "__pm_part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("__pm_record").orderBy("__pm_part").rowsBetween(Window.unboundedPreceding, -1))
    held, _ = shared.cut(held.select("__pm_record", "__pm_part", F.coalesce(before, F.lit(0)).alias("__pm_first")), "parts")
    at = F.row_number().over(Window.partitionBy("__pm_record", "__pm_part").orderBy("__pm_at")) - 1
    return rows.withColumn("__pm_i", at).join(shared.small(held), ["__pm_record", "__pm_part"]).withColumn("__pm_i", F.col("__pm_i") + F.col("__pm_first")).drop("__pm_at", "__pm_part", "__pm_first")


def assign(docs: DataFrame, n_shards: int, seed: int = 7, bucket_bytes: int = BUCKET_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``shard`` (0 to ``n_shards`` - 1) and ``slot`` (gapless from 0 in each shard)."""
    docs = docs.drop("shard", "slot")
    docs = docs.withColumn("__pm_record", _record(docs, seed))
    records, _ = shared.cut(docs.select("__pm_record", size_of(F.col(text)).alias("size")), "records")
    total = records.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    n, buckets = total["n"], max(n_shards, -(-total["bytes"] // bucket_bytes), -(-total["n"] // BUCKET_ROWS))
    weight = records.groupBy("__pm_record").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    heavy, _ = shared.cut(weight.where((F.col("n") > 1) & ((F.col("bytes") * 4 > bucket_bytes) | (F.col("n") * 4 > BUCKET_ROWS))).select("__pm_record"), "heavy")
    bucket = lambda *more: F.pmod(F.xxhash64(F.lit(seed), "__pm_record", *more), F.lit(buckets)).cast("int").alias("__pm_bucket")
    if heavy.isEmpty():
        docs, scattered = docs.withColumn("__pm_bucket", bucket()), records.select(bucket())
    else:
        equal = _numbered(docs.join(shared.small(heavy), "__pm_record", "left_semi"))
        equal, _ = shared.cut(equal.withColumn("__pm_bucket", bucket("__pm_i")).drop("__pm_i"), "equal")
        docs = docs.join(shared.small(heavy), "__pm_record", "left_anti").withColumn("__pm_bucket", bucket()).unionByName(equal)
        scattered = records.join(shared.small(heavy), "__pm_record", "left_anti").select(bucket()).unionByName(equal.select("__pm_bucket"))
    counts = scattered.groupBy(F.col("__pm_bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    perms, _ = shared.cut(permutations(counts, buckets, seed).toDF("__pm_bucket", "__pm_before", "__pm_perm").withColumn("__pm_bytes", F.size("__pm_perm").cast("long") * 4), "perms")
    place = Window.partitionBy("__pm_bucket").orderBy(F.xxhash64(F.lit(~seed), "__pm_record"), "__pm_record")
    return (
        docs.repartition(min(buckets, PARTITIONS), "__pm_bucket")
        .withColumn("__pm_place", F.row_number().over(place) - 1)
        .join(shared.small(perms, weight="__pm_bytes"), "__pm_bucket")
        .withColumn("__pm_rank", F.col("__pm_before") + F.get("__pm_perm", F.col("__pm_place")))
        .withColumn("shard", F.expr(f"int(__pm_rank * {n_shards}L div {max(n, 1)}L)"))
        .withColumn("slot", F.expr(f"__pm_rank - (shard * {n}L + {n_shards - 1}L) div {n_shards}L"))
        .drop("__pm_record", "__pm_bucket", "__pm_place", "__pm_before", "__pm_perm", "__pm_bytes", "__pm_rank")
    )


def write(docs: DataFrame, path: str, n_shards: int = 16, **options) -> DataFrame:
    """Writes the shards to ``path/shard=N`` in slot order and returns them as read back."""
    spark = docs.sparkSession
    out = assign(docs, n_shards, **options).sortWithinPartitions("shard", "slot")
    out.write.partitionBy("shard").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: the documents in 16 shards under the law ``rows``."""
    out = write(shared.table(spark, sf_dir, "documents"), shared.new_path(spark, "shards"))
    return out.select(
        "doc_id",
        size_of(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
