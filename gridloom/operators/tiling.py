"""Tiles: windows, patches, blending and sampling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.grid import materialise
from gridloom.operators.order import ranked


def tile_starts(length: int, patch: int, overlap: int) -> list[int]:
    """Starts at the stride, and a last one that ends at the edge; one start if the patch covers all."""
    if patch < 1 or not 0 <= overlap < patch:
        raise ValueError("patch must be positive and overlap less than it")
    if length <= patch:
        return [0]
    out = list(range(0, length - patch + 1, patch - overlap))
    return out if out[-1] == length - patch else [*out, length - patch]


def windows(spark: SparkSession, height: int, width: int, patch: int, overlap: int) -> DataFrame:
    """tile, row0, col0, height, width in row-major order."""
    rows = [(r, c, min(patch, height), min(patch, width)) for r in tile_starts(height, patch, overlap) for c in tile_starts(width, patch, overlap)]
    return spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "tile long, row0 long, col0 long, height long, width long")


def _starts_over(x: str, length: int, patch: int, overlap: int) -> Column:
    """The starts whose window covers the coordinate, as an array: at most a few, found by arithmetic and not by a join."""
    if length <= patch:
        return F.array(F.lit(0).cast("long"))
    stride, last = patch - overlap, length - patch
    low = F.greatest(F.lit(0), F.ceil((F.col(x) - patch + 1) / stride)).cast("long")
    high = F.least(F.floor(F.col(x) / stride), F.lit(last // stride)).cast("long")
    grid = F.when(high >= low, F.transform(F.sequence(low, high), lambda k: k * stride)).otherwise(F.expr("cast(array() as array<bigint>)"))
    return grid if last % stride == 0 else F.concat(grid, F.when(F.col(x) >= last, F.array(F.lit(last).cast("long"))).otherwise(F.expr("cast(array() as array<bigint>)")))


def to_tiles(cells: DataFrame, height: int, width: int, patch: int, overlap: int) -> DataFrame:
    """``cells`` once for each tile over them, with row0 and col0."""
    out = cells.withColumn("row0", F.explode(_starts_over("row", height, patch, overlap)))
    return out.withColumn("col0", F.explode(_starts_over("col", width, patch, overlap)))


def _hann(i: Column, n: int) -> Column:
    return F.lit(0.5) - F.lit(0.5) * F.cos(i * (2 * np.pi / (n - 1)))


def blend_weights(patch: int, floor: float = 0.05) -> Column:
    """Of row - row0 and col - col0: the product of two Hann windows, at least ``floor`` before it is divided by its largest."""
    if patch <= 2:
        return F.lit(1.0)
    w = np.maximum(np.outer(np.hanning(patch), np.hanning(patch)), floor)
    product = _hann(F.col("row") - F.col("row0"), patch) * _hann(F.col("col") - F.col("col0"), patch)
    return F.greatest(product, F.lit(floor)) / F.lit(float(w.max()))


def blend(tiles: DataFrame, patch: int) -> DataFrame:
    """row, col, p: the weighted mean of the tiles over each cell; cells that no tile covers have no row."""
    w = blend_weights(patch)
    return tiles.withColumn("w", w).groupBy("row", "col").agg((F.sum(F.col("w") * F.col("p")) / F.sum("w")).alias("p"))


def extract_patch(cells: DataFrame, row0: int, col0: int, patch: int, value: str, fill: float) -> DataFrame:
    """All patch * patch cells, those outside the raster filled."""
    spark = cells.sparkSession
    frame = spark.range(patch * patch).select((F.lit(row0) + F.floor(F.col("id") / patch)).alias("row"), (F.lit(col0) + F.col("id") % patch).alias("col"))
    own = cells.where(F.col("row").between(row0, row0 + patch - 1) & F.col("col").between(col0, col0 + patch - 1)).select("row", "col", value)
    return frame.join(own, ["row", "col"], "left").fillna({value: fill})


def touched(tiles: DataFrame, selected: str) -> DataFrame:
    """row0, col0 of tiles that hold a selected cell."""
    return tiles.where(selected).select("row0", "col0").distinct()


def least_hashed(rows: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """``n`` of the rows (all if there are fewer), those of the least MD5 of seed and keys: as good as drawn, and the same each time."""
    drawn = rows.withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), *keys).cast("binary")))
    return ranked(drawn, [], ["h", *keys]).where(F.col("rank") <= n).drop("h", "rank")


def training_origins(tiles: DataFrame, patch: int, ratio: float, allowed_fraction: float, seed: int) -> DataFrame:
    """row0, col0, positive: all tiles with truth that are allowed enough, and ratio times as many of the others, drawn by ``seed``.

    The exact number is taken by ranks of hashes in ranges; only counts come to the driver.
    """
    stats = tiles.groupBy("row0", "col0").agg(F.bool_or("truth").alias("positive"), (F.count_if("allowed") / F.lit(float(patch * patch))).alias("share"))
    good = materialise(stats.where(F.col("share") >= allowed_fraction).select("row0", "col0", "positive"), "tiles")
    n = int(ratio * good.where("positive").count())
    return good.where("positive").union(least_hashed(good.where("not positive"), ["row0", "col0"], n, seed))


def patchify(cells: DataFrame, patch: int) -> DataFrame:
    """patch_r, patch_c, y, x of each cell without overlap; a side that divides evenly still gets a whole patch of padding."""
    r, c = F.col("row"), F.col("col")
    return cells.withColumns({"patch_r": F.floor(r / patch), "patch_c": F.floor(c / patch), "y": r % patch, "x": c % patch})


def unpatchify(patches: DataFrame, patch: int) -> DataFrame:
    out = patches.withColumns({"row": F.col("patch_r") * patch + F.col("y"), "col": F.col("patch_c") * patch + F.col("x")})
    return out.drop("patch_r", "patch_c", "y", "x")


def padded_side(length: int, patch: int) -> int:
    """Patches of a side: always one more than fit whole."""
    return (length // patch + 1) * patch


def holdout_tiles(tiles: DataFrame, share: float, seed: int) -> DataFrame:
    """row0, col0 of a share (to the nearest number, halves to even) of the tiles with truth and some finite elevation, drawn by ``seed``."""
    good = tiles.groupBy("row0", "col0").agg(F.bool_or("truth").alias("t"), F.bool_or(F.col("elevation").isNotNull() & ~F.isnan("elevation")).alias("e"))
    good = materialise(good.where("t and e").select("row0", "col0"), "tiles")
    return least_hashed(good, ["row0", "col0"], round(share * good.count()), seed)


def accumulate(predictions: DataFrame, seeds: int) -> DataFrame:
    """Out-of-fold sum over seeds, divided by their number."""
    return predictions.groupBy("row", "col").agg((F.sum("p") / F.lit(float(seeds))).alias("p"))
