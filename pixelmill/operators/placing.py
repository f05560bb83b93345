"""Rows in bins of bounded weight, and tasks that follow the bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import tables
from ..functions import geometry


def binned(rows: DataFrame, by: list[str], weight: str, target: int) -> DataFrame:
    """``rows`` with ``bin``: in the order of ``by`` (all columns of a key), a row goes to the bin that the weights before it
    reach, so a bin weighs less than ``target`` and one row more. Weights of null or under 0 count as 0.

    One sort by ranges, then sums within the ranges and over them (a row a task); nothing is summed in one task.
    """
    w = F.greatest(F.coalesce(F.col(weight).cast("long"), F.lit(0)), F.lit(0))
    ordered = rows.withColumn("__w", w).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    ordered, _ = tables.cut(ordered, "ordered")
    ordered = ordered.withColumn("__range", F.shiftright("__at", 33))
    before = lambda c, window: F.coalesce(F.sum(c).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ordered.groupBy("__range").agg(F.sum("__w").alias("__sum")).select("__range", before("__sum", Window.orderBy("__range")).alias("__first"))
    own = ordered.withColumn("__own", before("__w", Window.partitionBy("__range").orderBy("__at")))
    out = own.join(F.broadcast(ranges), "__range").withColumn("bin", F.expr(f"(__own + __first) div {target}L"))
    return out.drop("__w", "__at", "__range", "__own", "__first")


def placed(rows: DataFrame, bin: str = "bin") -> DataFrame:
    """The rows with each bin in a task of its own, as far as there are tasks."""
    n = rows.agg(F.coalesce(F.max(bin) + 1, F.lit(1))).first()[0]
    parts = min(int(n), 1 << 16)
    return rows.repartitionById(parts, F.pmod(F.col(bin), F.lit(parts)).cast("int"))


def pixel_weight(asked: Column, length: Column) -> Column:
    """Bytes that a pixel task holds for a source of ``length`` bytes (if it is known) and what is asked of it, roughly: a side
    that is not given counts as the other, and none as 1,000."""
    side = lambda r, one, other: F.coalesce(r[one], r[other], F.lit(1000))
    each = F.transform(asked, lambda r: geometry.estimated_bytes(side(r, "width", "height"), side(r, "height", "width"), r["format"]))
    return F.coalesce(length, F.lit(0)) + F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)
