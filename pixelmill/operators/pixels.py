"""Pixels in numpy (height x width x channels) and, for small fixed sizes, as column expressions over arrays.

Resampling is separable: a kernel, stretched by the scale when shrinking, weighs the pixels around each output centre;
weights are normalised and edges use the pixels there are. Rows first, then columns, in double precision; results are
rounded half away from zero and clamped.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: Luma weights in ten-thousandths.
LUMA = (2126, 7152, 722)


def _triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(1 - np.abs(x), 0)


def _lanczos3(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)


KERNELS = {"triangle": (_triangle, 1.0), "lanczos3": (_lanczos3, 3.0)}


def _weights(old: int, new: int, kernel, support: float) -> np.ndarray:
    """(new, old): how much each old pixel counts in each new one."""
    ratio = old / new
    scale = max(ratio, 1.0)
    centre = (np.arange(new) + 0.5) * ratio
    left = np.clip(np.floor(centre - support * scale), 0, old - 1)
    right = np.clip(np.ceil(centre + support * scale), left + 1, old)
    at = np.arange(old)
    w = kernel((at[None, :] - (centre[:, None] - 0.5)) / scale)
    w = np.where((at >= left[:, None]) & (at < right[:, None]), w, 0.0)
    return w / w.sum(1, keepdims=True)


@lru_cache(maxsize=256)
def weights(old: int, new: int, kernel: str) -> np.ndarray:
    return _weights(old, new, *KERNELS[kernel])


@lru_cache(maxsize=256)
def blur_weights(size: int, sigma: float) -> np.ndarray:
    return _weights(size, size, lambda x: np.exp(-(x * x) / (2 * sigma * sigma)), 2 * sigma)


def _apply(image: np.ndarray, down: np.ndarray | None, across: np.ndarray | None) -> np.ndarray:
    x = image.astype(float)
    if down is not None:
        x = np.tensordot(down, x, (1, 0))
    if across is not None:
        x = np.moveaxis(np.tensordot(across, x, (1, 1)), 0, 1)
    return x


def rounded(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(x + 0.5), 0, 255).astype(np.uint8)


def resized(image: np.ndarray, width: int, height: int, kernel: str) -> np.ndarray:
    """Exactly width x height, without regard to aspect."""
    h, w = image.shape[:2]
    if (w, h) == (width, height):
        return image.copy()
    return rounded(_apply(image, weights(h, height, kernel), weights(w, width, kernel)))


def scaled_size(w: int, h: int, width: int | None, height: int | None) -> tuple[int, int]:
    if width is None and height is None:
        return w, h
    ratio = width / w if height is None else height / h if width is None else max(width / w, height / h)
    return max(int(np.floor(w * ratio + 0.5)), 1), max(int(np.floor(h * ratio + 0.5)), 1)


def fitted(image: np.ndarray, width: int | None, height: int | None, kernel: str) -> np.ndarray:
    """By width or height keeping aspect; both: cover, then the centre; neither: as it is."""
    h, w = image.shape[:2]
    image = resized(image, *scaled_size(w, h, width, height), kernel)
    if width is not None and height is not None:
        h, w = image.shape[:2]
        x, y = max(w - width, 0) // 2, max(h - height, 0) // 2
        image = image[y : y + min(height, h), x : x + min(width, w)]
    return image


def gray(image: np.ndarray) -> np.ndarray:
    """One luma channel (and alpha, where there is one)."""
    if image.shape[2] < 3:
        return image
    luma = (image[:, :, :3].astype(np.uint32) * np.array(LUMA, np.uint32)).sum(2) // sum(LUMA)
    return np.dstack([luma.astype(np.uint8), *([image[:, :, 3]] if image.shape[2] == 4 else [])])


def blurred(image: np.ndarray, sigma: float) -> np.ndarray:
    h, w = image.shape[:2]
    return rounded(_apply(image, blur_weights(h, sigma), blur_weights(w, sigma)))


def processed(image: np.ndarray, width: int | None, height: int | None, kernel: str, grayscale: bool | None, sigma: float | None) -> np.ndarray:
    """Resize, gray, blur, in this order."""
    image = fitted(image, width, height, kernel)
    image = gray(image) if grayscale else image
    return blurred(image, sigma) if sigma is not None and sigma > 0 else image


# The same on arrays of values, inside Catalyst.


def weighted(images: DataFrame, key: str, values: str, down: np.ndarray, across: np.ndarray) -> DataFrame:
    """(key, cell, value) of ``down @ image @ across.T`` for the images that the array column ``values`` holds row by row; rows
    that share a key are added up. A join of pixels with the weights that are not 0, and a sum, which combines before the
    shuffle; there are as many weights as the two matrices make, whatever the number of images."""
    down_y, down_i = np.nonzero(down)
    across_x, across_j = np.nonzero(across)
    f = down[down_y, down_i][:, None] * across[across_x, across_j][None, :]
    cell = down_y[:, None] * len(across) + across_x[None, :]
    spot = down_i[:, None] * across.shape[1] + across_j[None, :]
    rows = list(zip(spot.ravel().tolist(), cell.ravel().tolist(), f.ravel().tolist(), strict=True))
    table = images.sparkSession.createDataFrame(rows, "spot int, cell long, weight double")
    each = images.select(F.col(key).alias("key"), F.posexplode(values).alias("spot", "v"))
    met = each.join(F.broadcast(table), "spot")
    return met.groupBy("key", "cell").agg(F.sum(F.col("v") * F.col("weight")).alias("value")).withColumnRenamed("key", key)


def luma(array: Column, pixels: int) -> Column:
    """Luma of RGB triples held one after another."""
    total = float(sum(LUMA))
    return F.array(*[sum((array[3 * i + c] * F.lit(LUMA[c] / total) for c in range(1, 3)), array[3 * i] * F.lit(LUMA[0] / total)) for i in range(pixels)])
