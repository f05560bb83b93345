"""Tiles against whole images."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.operators import pixels, tiles


@pytest.mark.parametrize("side", [3, 4, 32])
def test_tiles_are_as_whole_images(spark, side):
    """Images of several sizes, larger and smaller, with steps at tile edges."""
    rng = np.random.default_rng(side)
    rows, want = [], {}
    for k, (h, w, nh, nw) in enumerate([(9, 13, 5, 20), (13, 9, 13, 9), (1, 7, 3, 7), (16, 16, 4, 4)]):
        image = rng.integers(0, 256, (h, w)).astype(float)
        image[:, : min(side, w)] = 255
        rows.append((k, image.ravel().tolist(), h, w, nh, nw))
        want[k] = pixels._apply(image[:, :, None], pixels.weights(h, nh, "lanczos3"), pixels.weights(w, nw, "lanczos3"))[:, :, 0]
    df = spark.createDataFrame(rows, "id long, v array<double>, h int, w int, new_height int, new_width int")
    held = tiles.tiled(df, "id", "v", "h", "w", side).join(df.select(F.col("id").alias("key"), "new_height", "new_width"), "key")
    assert held.where(F.size("values") > side * side).isEmpty()
    down = tiles.weight_table(spark, [(r[2], r[4]) for r in rows], "lanczos3")
    across = tiles.weight_table(spark, [(r[3], r[5]) for r in rows], "lanczos3")
    out = tiles.filtered(held, side, down, across)
    got = {k: np.full(w.shape, np.nan) for k, w in want.items()}
    for r in tiles.pixels_of(out, side).collect():
        got[r["key"]][r["y"], r["x"]] = r["v"]
    for k, w in want.items():
        assert np.allclose(got[k], w, atol=1e-9), k
    said = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in said and "Arrow" not in said and "BroadcastHashJoin" in said
