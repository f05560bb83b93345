"""Statistics over run logs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F


def bench_stats(log: DataFrame, wall: str = "wall_s") -> DataFrame:
    """By level, of (level, success, duration_us, content_length) and the level's wall seconds: counts and, of successes
    alone, times and rates (null where none succeeded)."""
    ok = lambda c: F.when(F.col("success"), F.col(c))
    sums = log.groupBy("level").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if("success").alias("successes"),
        F.sum(ok("duration_us")).alias("total_us"),
        F.min(ok("duration_us")).alias("min_us"),
        F.max(ok("duration_us")).alias("max_us"),
        F.coalesce(F.sum(ok("content_length")), F.lit(0)).alias("total_bytes"),
        F.max(wall).alias("wall_s"),
    )
    some = lambda x: F.when(F.col("successes") > 0, x)
    return sums.select(
        "level",
        "requests",
        "successes",
        F.expr("if(successes > 0, total_us div successes div 1000, null)").alias("avg_ms"),
        F.expr("min_us div 1000").alias("min_ms"),
        F.expr("max_us div 1000").alias("max_ms"),
        some(F.col("total_bytes")).alias("total_bytes"),
        some(F.round(F.try_divide("successes", "wall_s"), 6)).alias("requests_per_s"),
        some(F.round(F.try_divide(F.col("total_bytes") / 1048576.0, F.col("wall_s")), 9)).alias("mib_per_s"),
    )


def counters(log: DataFrame, hit: str, miss: str) -> DataFrame:
    """Requests, hits, misses and hit ratio (0 without any) over boolean expressions."""
    return log.agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.expr(hit)).alias("hits"), F.count_if(F.expr(miss)).alias("misses")).withColumn(
        "hit_ratio", F.coalesce(F.round(F.try_divide(F.col("hits"), F.col("hits") + F.col("misses")), 9), F.lit(0.0))
    )


def stage_averages(log: DataFrame, by: str = "stage") -> DataFrame:
    """An extension: mean milliseconds of each stage."""
    return log.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ms"), 6).alias("avg_ms"))


def path_metrics(log: DataFrame) -> DataFrame:
    """An extension: requests by path and status, without the health and metrics paths."""
    return log.where(~(F.startswith("path", F.lit("/health")) | F.startswith("path", F.lit("/metrics")))).groupBy("path", "status").agg(F.count(F.lit(1)).alias("n"))


#: Quantiles from a histogram are within this share of a value that stands at their rank.
ERROR = 0.01


def histogram(log: DataFrame, value: str, *by) -> DataFrame:
    """(by, bucket, n): how many values lie in each of log-spaced buckets; bucket i holds those over g^(i - 1) up to g^i, where
    g = (1 + ERROR) / (1 - ERROR); values of 0 and less are in no bucket (null), null values nowhere. Counts of several tables add
    up (``merged``), and combine before the shuffle."""
    step = math.log((1 + ERROR) / (1 - ERROR))
    bucket = F.when(F.col(value) > 0, F.ceil(F.ln(value) / F.lit(step)).cast("int")).alias("bucket")
    return log.where(F.col(value).isNotNull()).groupBy(*by, bucket).agg(F.count(F.lit(1)).alias("n"))


def merged(histograms: DataFrame, *by) -> DataFrame:
    return histograms.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))


def quantiles(histograms: DataFrame, wanted: list[float], *by) -> DataFrame:
    """(by, n, p...): of each histogram the count and the quantiles, 0 for a value of 0 or less. A histogram has a row a bucket,
    some hundred for values of any size, so its running sum is small."""
    step = math.log((1 + ERROR) / (1 - ERROR))
    own = Window.partitionBy(*by)
    rows = histograms.select("*", F.sum("n").over(own).alias("total"), F.sum("n").over(own.orderBy(F.asc_nulls_first("bucket"))).alias("until"))
    # The middle of a bucket, by relative distance from its ends.
    middle = F.coalesce(F.exp(F.col("bucket") * F.lit(step)) * F.lit(1 - ERROR), F.lit(0.0))
    at = lambda q: F.min_by(middle, F.when(F.col("until") >= F.greatest(F.lit(1), F.ceil(F.col("total") * F.lit(q))), F.col("until")))
    return rows.groupBy(*by).agg(F.max("total").alias("n"), *[at(q).alias(f"p{round(q * 100)}") for q in wanted])
