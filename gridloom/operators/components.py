"""Connected components of a mask, and reports of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.grid import materialise, spread
from gridloom.operators.order import exact_quantiles

TILE = 128


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each component of n nodes, by hooking and pointer jumping."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not (root[root] == root).all():
            root = root[root]


def label(mask: DataFrame, connectivity: int = 8, tile: int = TILE) -> DataFrame:
    """row, col, component of the cells in ``mask``; a component's number is that of its first cell, row * 2^32 + col.

    Components are found within tiles, then joined across tile seams: only cells at seams and one number for each
    tile's component take part in the second step, whose links are contracted until none is left.
    """
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        order = np.lexsort((c, r))
        r, c = r[order], c[order]
        key = r << 32 | c
        a, b = [], []
        for dy, dx in steps:
            want = (r + dy) << 32 | (c + dx)
            at = np.minimum(np.searchsorted(key, want), len(key) - 1)
            ok = (key[at] == want) & (c + dx >= 0)
            a.append(np.flatnonzero(ok))
            b.append(at[ok])
        return pd.DataFrame({"row": r, "col": c, "local": key[_roots(len(r), np.concatenate(a), np.concatenate(b))]})

    cells = mask.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).distinct()
    tiles = cells.groupBy(F.floor(F.col("row") / tile), F.floor(F.col("col") / tile))
    local = materialise(tiles.applyInPandas(within, "row long, col long, local long"), "tiles")
    edge = local.where(f"row % {tile} in (0, {tile - 1}) or col % {tile} in (0, {tile - 1})")
    moved = spread(edge, [(y, x, 1.0) for y, x in steps], ["local"]).withColumnRenamed("local", "a")
    links = moved.join(edge, ["row", "col"]).where("a <> local").select("a", F.col("local").alias("b")).distinct()
    roots = _contract(links)
    found = local.join(roots.toDF("local", "root"), "local", "left")
    return found.select("row", "col", F.coalesce("root", "local").alias("component"))


def _contract(links: DataFrame) -> DataFrame:
    """node, root: every node points to its least neighbour, pointers are doubled to their ends, and links contract to the ends."""
    links, found = materialise(links, "links"), None
    while True:
        both = links.union(links.select("b", "a")).toDF("node", "other")
        up = materialise(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("root")), "up")
        while True:
            over = up.toDF("root", "next")
            up = materialise(up.join(over, "root").select("node", F.col("next").alias("root"), (F.col("root") != F.col("next")).alias("moved")), "up")
            moved, up = not up.where("moved").isEmpty(), up.drop("moved")
            if not moved:
                break
        found = up if found is None else materialise(found.join(up.toDF("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        links = materialise(links.join(up.toDF("a", "x"), "a").join(up.toDF("b", "y"), "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
        if links.isEmpty():
            return found


def component_table(labelled: DataFrame, cell_metres: float = 100.0) -> DataFrame:
    """component, pixels, bounding box (stops exclusive) and its size in metres."""
    out = labelled.groupBy("component").agg(F.count(F.lit(1)).alias("pixels"), F.min("row").alias("row0"), (F.max("row") + 1).alias("row1"), F.min("col").alias("col0"), (F.max("col") + 1).alias("col1"))
    return out.withColumn("height_m", (F.col("row1") - F.col("row0")) * cell_metres).withColumn("width_m", (F.col("col1") - F.col("col0")) * cell_metres)


QUANTILES = [0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]


def component_report(labelled: DataFrame, valid_cells: int, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """One row of counts, prevalence and exact size quantiles; and the ``top`` largest components with their share (ties: lower number)."""
    table = component_table(labelled)
    counts = table.agg(F.count(F.lit(1)).alias("components"), F.sum("pixels").alias("pixels"))
    total = counts.join(F.broadcast(exact_quantiles(table, "pixels", QUANTILES).select(F.col("q").alias("size_quantiles"))))
    report = total.withColumn("prevalence", F.col("pixels") / F.lit(float(valid_cells)))
    largest = table.orderBy(F.desc("pixels"), "component").limit(top).join(F.broadcast(total.select(F.col("pixels").alias("all_pixels"))))
    return report, largest.withColumn("share", F.col("pixels") / F.col("all_pixels")).drop("all_pixels")


def block_report(cells: DataFrame, block: int = 256) -> DataFrame:
    """Per block: valid and truth cells; a block is usable if it has valid cells."""
    key = [F.floor(F.col("row") / block).alias("block_r"), F.floor(F.col("col") / block).alias("block_c")]
    out = cells.groupBy(*key).agg(F.count_if("valid").alias("valid_cells"), F.count_if(F.col("valid") & F.col("truth")).alias("truth_cells"))
    return out.withColumn("usable", F.col("valid_cells") > 0)


def block_quantiles(blocks: DataFrame) -> DataFrame:
    """One row over ``block_report``: blocks, usable and positive ones, and the quantiles of truth cells in positive blocks."""
    positive = F.col("truth_cells") > 0
    counts = blocks.agg(F.count(F.lit(1)).alias("blocks"), F.count_if("usable").alias("usable"), F.count_if(positive).alias("positive"))
    return counts.join(F.broadcast(exact_quantiles(blocks.where(positive), "truth_cells", QUANTILES).select(F.col("q").alias("truth_quantiles"))))
