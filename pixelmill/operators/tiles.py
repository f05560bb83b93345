"""Rasters as tiles, one a row, for images that are too large for a task: resampling and blur as joins with weights and sums.

A pixel takes part in all output pixels that it has a weight in, on whichever tile these lie, so tiles exchange their edges in
the shuffle of the sums; sums combine within a task first, so that what a tile gives to another is its part of the sum, once.
Rows first, then columns, as the kernels of ``pixels`` are separable.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import pixels

SIZES = ["height", "width", "new_height", "new_width"]


def weight_table(spark: SparkSession, pairs: list[tuple[int, int]], kernel: str = "triangle", sigma: float | None = None) -> DataFrame:
    """(old, new, at, to, weight) for the pairs of old and new sides: how much the pixel ``at`` counts in the pixel ``to``. With
    ``sigma`` a blur, where old and new are equal. As many rows as the pairs' kernels cover, whatever the number of images."""
    rows = []
    for old, new in sorted(set(pairs)):
        w = pixels.weights(old, new, kernel) if sigma is None else pixels.blur_weights(old, sigma)
        to, at = np.nonzero(w)
        rows += zip([old] * len(at), [new] * len(at), at.tolist(), to.tolist(), w[to, at].tolist(), strict=True)
    return spark.createDataFrame(rows, "old int, new int, at int, to int, weight double")


def tiled(images: DataFrame, key: str, values: str, height: str, width: str, side: int) -> DataFrame:
    """(key, height, width, ty, tx, values): images that hold their pixels row by row, as tiles of ``side`` or, at the edge, less."""
    each = images.select(F.col(key).alias("key"), F.col(height).cast("int").alias("height"), F.col(width).cast("int").alias("width"), F.posexplode(values).alias("i", "v"))
    each = each.select("key", "height", "width", F.expr("int(i div width)").alias("y"), (F.col("i") % F.col("width")).alias("x"), F.col("v").cast("double").alias("v"))
    return retiled(each, ["height", "width"], side)


def retiled(each: DataFrame, carried: list[str], side: int) -> DataFrame:
    """Pixels (key, y, x, v, carried) as tiles (key, carried, ty, tx, values); a tile has side x side pixels at most."""
    at = each.withColumns({"ty": F.expr(f"int(y div {side})"), "tx": F.expr(f"int(x div {side})")})
    held = at.groupBy("key", *carried, "ty", "tx").agg(F.sort_array(F.collect_list(F.struct("y", "x", "v"))).alias("p"))
    return held.select("key", *carried, "ty", "tx", F.col("p.v").alias("values"))


def pixels_of(tiles: DataFrame, side: int) -> DataFrame:
    """(key, sizes, y, x, v) of the tiles' pixels."""
    own = F.least(F.lit(side), F.col("width") - F.col("tx") * side)
    sizes = [c for c in SIZES if c in tiles.columns]
    each = tiles.select("key", *sizes, "ty", "tx", own.alias("own"), F.posexplode("values").alias("i", "v"))
    return each.select("key", *sizes, F.expr(f"int(ty * {side} + i div own)").alias("y"), F.expr(f"int(tx * {side} + i % own)").alias("x"), "v")


def _along(each: DataFrame, axis: str, size: str, table: DataFrame) -> DataFrame:
    keys = [c for c in each.columns if c not in (axis, "v")]
    met = each.join(F.broadcast(table), (F.col(size) == F.col("old")) & (F.col(f"new_{size}") == F.col("new")) & (F.col(axis) == F.col("at")))
    return met.groupBy(*keys, F.col("to").alias(axis)).agg(F.sum(F.col("v") * F.col("weight")).alias("v"))


def filtered(tiles: DataFrame, side: int, down: DataFrame, across: DataFrame) -> DataFrame:
    """(key, height, width, ty, tx, values): the tiles (with ``new_height`` and ``new_width``) of the images of the new sizes."""
    each = _along(_along(pixels_of(tiles, side), "y", "height", down), "x", "width", across)
    return retiled(each.select("key", F.col("new_height").alias("height"), F.col("new_width").alias("width"), "y", "x", "v"), ["height", "width"], side)
