"""Image files as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def images(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(url, status, content_length, content) of files; those over ``most`` bytes are not read (pushed to the scan)."""
    files = spark.read.format("binaryFile").load(path)
    files = files if most is None else files.where(F.col("length") <= most)
    return files.select(F.col("path").alias("url"), F.lit(200).alias("status"), F.col("length").alias("content_length"), "content")


def image_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILE_SCHEMA).load(path).select(F.col("path").alias("url"), "length", "content")
