"""Exact squared distances to the nearest marked cell, at a cost that does not grow with the square of the radius."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 256
FAR = 1e9


def down_columns(mask: np.ndarray) -> np.ndarray:
    """Rows to the nearest marked cell of the same column, FAR where there is none."""
    rows = np.arange(len(mask), dtype=float)[:, None]
    above = np.maximum.accumulate(np.where(mask, rows, -FAR), axis=0)
    below = np.minimum.accumulate(np.where(mask, rows, FAR)[::-1], axis=0)[::-1]
    return np.minimum(np.minimum(rows - above, below - rows), FAR)


def lower_envelopes(f: np.ndarray) -> np.ndarray:
    """min over j of (x - j)^2 + f[:, j] for each row and x: the envelope of a row's parabolas, all rows at once.

    Parabolas come from left to right; one hides those on its left from which it takes over before they take over themselves.
    """
    height, width = f.shape
    each = np.arange(height)
    at = np.zeros((height, width), np.int64)  # the parabolas of the envelope
    start = np.full((height, width + 1), np.inf)  # from where each holds
    start[:, 0] = -np.inf
    top = np.zeros(height, np.int64)
    for x in range(1, width):
        left = each
        while left.size:
            last = at[left, top[left]]
            cross = ((f[left, x] + x * x) - (f[left, last] + last * last)) / (2 * (x - last))
            hidden = cross <= start[left, top[left]]
            over = left[~hidden]
            top[over] += 1
            at[over, top[over]] = x
            start[over, top[over]] = cross[~hidden]
            start[over, top[over] + 1] = np.inf
            left = left[hidden]
            top[left] -= 1
    out, k = np.empty_like(f), np.zeros(height, np.int64)
    for x in range(width):
        while (on := start[each, k + 1] < x).any():
            k += on
        j = at[each, k]
        out[:, x] = (x - j) ** 2 + f[each, j]
    return out


def squared_distances(mask: np.ndarray) -> np.ndarray:
    """Squared Euclidean distance of each cell to the nearest marked one; FAR or more without any."""
    return lower_envelopes(np.minimum(down_columns(mask) ** 2, FAR))


def distances(cells: DataFrame, radius: float, by: list[str] | None = None, tile: int = TILE) -> DataFrame:
    """by, row, col, d2 for every cell within ``radius`` of a marked one (by, row, col) of the same key.

    Tiles get the marks within the radius around them, so that a mark goes to four tiles at most if a tile is wider than two radii; the
    transform is separable: distances down columns, then lower envelopes along rows, in the part of the tile that marks
    can reach. No task holds more than a tile and its halo. A radius of 0 gives the marks; no marks give no rows.
    """
    if not (math.isfinite(radius) and radius >= 0):
        raise ValueError("radius must be finite and not negative")
    by, halo = by or [], math.floor(radius)
    tile = max(tile, 2 * halo + 1)
    owners = lambda x: F.explode(F.sequence(F.floor((F.col(x) - halo) / tile), F.floor((F.col(x) + halo) / tile)))
    marks = cells.select(*by, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))
    dealt = marks.withColumn("tile_r", owners("row")).withColumn("tile_c", owners("col"))
    kinds = dict(marks.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["tile_r"].iloc[0]) * tile, int(pdf["tile_c"].iloc[0]) * tile
        y, x = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        top, left = max(r0, int(y.min()) - halo), max(c0, int(x.min()) - halo)
        bottom, right = min(r0 + tile, int(y.max()) + halo + 1), min(c0 + tile, int(x.max()) + halo + 1)
        y0, x0 = min(top, int(y.min())), min(left, int(x.min()))
        box = np.zeros((max(bottom, int(y.max()) + 1) - y0, max(right, int(x.max()) + 1) - x0), bool)
        box[y - y0, x - x0] = True
        d2 = squared_distances(box)[top - y0 : bottom - y0, left - x0 : right - x0]
        a, b = np.nonzero(d2 <= radius * radius)
        out = {k: pdf[k].iloc[0] for k in by} | {"row": a + top, "col": b + left, "d2": d2[a, b].astype(np.int64)}
        return pd.DataFrame(out)[[*by, "row", "col", "d2"]]

    schema = ", ".join([f"`{k}` {kinds[k]}" for k in by] + ["row long", "col long", "d2 long"])
    return dealt.groupBy(*by, "tile_r", "tile_c").applyInPandas(run, schema)
