"""Skeletons, their end points, and continuations from them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.features import SHIFTS
from gridloom.operators.grid import materialise, spread

#: The eight neighbours from the east, counter-clockwise; and the headings, clockwise as rows count downwards.
RING = ((0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1))
HEADINGS = (RING[0], *RING[:0:-1])


def _large(cells: DataFrame) -> DataFrame:
    """``cells`` as a side of a join that is never broadcast: the planner takes a table of exploded bands to be as small as the bands."""
    return cells.hint("merge")


def endpoints(skeleton: DataFrame) -> DataFrame:
    """Cells with exactly one of the eight neighbours."""
    cells = skeleton.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).distinct()
    near = spread(cells, [(y, x, 1.0) for y, x in SHIFTS]).join(_large(cells), ["row", "col"])
    found = near.groupBy("from_row", "from_col").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    return found.select(F.col("from_row").alias("row"), F.col("from_col").alias("col"))


def thin(mask: np.ndarray, most: int | None = None) -> np.ndarray:
    """Zhang-Suen thinning to its fixed point, or for ``most`` passes.

    The first half of a pass asks that one of east, north and west, and one of north, west and south be empty; the second the other two threes.
    """
    x = np.pad(mask.astype(bool), 1)
    changed, passes = True, 0
    while changed and passes != most:
        changed, passes = False, passes + 1
        for first in (True, False):
            e, ne, n, nw, w, sw, s, se = (np.roll(x, (-dy, -dx), (0, 1)) for dy, dx in RING)
            ring = [n, ne, e, se, s, sw, w, nw]
            count = sum(r.astype(np.int8) for r in ring)
            turns = sum((~a & b).astype(np.int8) for a, b in zip(ring, ring[1:] + ring[:1]))
            clear = ~(e & n & w) & ~(n & w & s) if first else ~(e & n & s) & ~(e & w & s)
            gone = x & (count >= 2) & (count <= 6) & (turns == 1) & clear
            if gone.any():
                x = x & ~gone
                changed = True
    return x[1:-1, 1:-1]


def thin_cells(cells: DataFrame, tile: int = 256, halo: int = 32) -> DataFrame:
    """row, col of the skeleton of all ``cells``.

    A pass looks two cells far, so tiles with a halo can take half as many passes as the halo is wide before they need
    their neighbours' state; rounds go on until one removes nothing. No task holds a whole component.
    """
    state = materialise(cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).distinct(), "thin")
    owners = lambda x: F.explode(F.sequence(F.floor((F.col(x) - halo) / tile), F.floor((F.col(x) + halo) / tile)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["tile_r"].iloc[0]) * tile - halo, int(pdf["tile_c"].iloc[0]) * tile - halo
        box = np.zeros((tile + 2 * halo, tile + 2 * halo), bool)
        box[pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0] = True
        y, x = np.nonzero(thin(box, halo // 2)[halo:-halo, halo:-halo])
        return pd.DataFrame({"row": y + r0 + halo, "col": x + c0 + halo})

    left = state.count()
    while True:
        dealt = state.withColumn("tile_r", owners("row")).withColumn("tile_c", owners("col"))
        state = materialise(dealt.groupBy("tile_r", "tile_c").applyInPandas(run, "row long, col long"), "thin")
        if (now := state.count()) == left:
            return state
        left = now


def thin_components(labelled: DataFrame) -> DataFrame:
    """component, row, col of each component's skeleton: components do not touch, so all are thinned at once."""
    return thin_cells(labelled).join(_large(labelled.select("component", "row", "col").distinct()), ["row", "col"]).select("component", "row", "col")


def orientations(tips: DataFrame, skeleton: DataFrame, window: int = 15, least_behind: float = 0.0, height: int | None = None, width: int | None = None) -> DataFrame:
    """row, col, dy, dx: unit vector out of each tip, by the principal axis of the skeleton within ``window``; fewer than 3 cells give no row.

    It is turned round if none of the three cells behind the tip (one, two and three units back, cut to whole numbers) is skeleton;
    or, with ``least_behind`` above 0, if fewer than that share of those inside the raster of ``height`` by ``width`` are. An axis has two
    directions; the one that points away from where most of the skeleton lies is tried first.
    """
    offsets = [(y, x, 1.0) for y in range(-window, window + 1) for x in range(-window, window + 1)]
    own = skeleton.select("row", "col")
    near = spread(tips, offsets).join(_large(own), ["row", "col"])
    y, x = F.col("row") - F.col("from_row"), F.col("col") - F.col("from_col")
    n, sy, sx = F.count(F.lit(1)), F.sum(y), F.sum(x)
    # n * n times the covariances, in whole numbers: the same in whatever order rows come, also where an axis is a tie
    stats = near.groupBy("from_row", "from_col").agg(
        n.alias("n"), (n * F.sum(y * y) - sy * sy).alias("a"), (n * F.sum(y * x) - sy * sx).alias("b"), (n * F.sum(x * x) - sx * sx).alias("c"), F.avg(y).alias("my"), F.avg(x).alias("mx")
    ).where("n >= 3")
    angle = F.atan2(2 * F.col("b"), F.col("a") - F.col("c")) / 2
    uy, ux = F.round(F.cos(angle), 12), F.round(F.sin(angle), 12)
    away = F.when(uy * F.col("my") + ux * F.col("mx") > 0, -1.0).otherwise(1.0)
    found = stats.select("from_row", "from_col", (away * uy).alias("dy"), (away * ux).alias("dx"))
    back = found.withColumn("k", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    back = back.withColumn("row", (F.col("from_row") - F.col("k") * F.col("dy")).cast("long")).withColumn("col", (F.col("from_col") - F.col("k") * F.col("dx")).cast("long"))
    met = back.join(_large(own.withColumn("met", F.lit(1))), ["row", "col"], "left")
    inside = F.lit(True) if height is None else (F.col("row") >= 0) & (F.col("row") < height) & (F.col("col") >= 0) & (F.col("col") < width)
    seen = met.groupBy("from_row", "from_col", "dy", "dx").agg(F.count_if(inside).alias("inside"), F.coalesce(F.sum(F.when(inside, F.col("met"))), F.lit(0)).alias("body"))
    turned = F.col("body") == 0 if least_behind <= 0 else (F.col("inside") > 0) & (F.col("body") < least_behind * F.col("inside"))
    sign = F.when(turned, -1.0).otherwise(1.0)
    return seen.select(F.col("from_row").alias("row"), F.col("from_col").alias("col"), (sign * F.col("dy")).alias("dy"), (sign * F.col("dx")).alias("dx"))


def extend(tips: DataFrame, cells: DataFrame, steps: int, decay: float = 0.1, least: float = 0.01, edge: str | None = None, edge_least: float = 0.3) -> DataFrame:
    """row, col, p: straight continuations of ``tips`` (row, col, dy, dx), painted p_tip * exp(-decay * step) until the first blocker.

    Steps end at the raster's edge, at skeleton cells and, if a column ``edge`` is named, where it is below ``edge_least``; halves are rounded
    to even places. Tips below ``least`` do not start. Paths never enter the skeleton and tips lie on it, so all tips can be
    extended at once; paint combines by the largest.
    """
    start = tips.join(_large(cells.select("row", "col", F.col("p").alias("p0"))), ["row", "col"]).where(F.col("p0") >= least)
    path = start.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    path = path.select(F.struct("row", "col").alias("tip"), "step", (F.col("p0") * F.exp(-decay * F.col("step"))).alias("paint"), F.rint(F.col("row") + F.col("dy") * F.col("step")).cast("long").alias("row"), F.rint(F.col("col") + F.col("dx") * F.col("step")).cast("long").alias("col"))
    blocked = F.col("skeleton") if edge is None else F.col("skeleton") | F.coalesce(F.col(edge) < edge_least, F.lit(False))
    met = path.join(_large(cells.select("row", "col", blocked.alias("blocked"))), ["row", "col"], "left")
    stop = met.groupBy("tip").agg(F.min(F.when(F.coalesce("blocked", F.lit(True)), F.col("step"))).alias("stop"))
    open_ = met.join(_large(stop), "tip").where(F.col("stop").isNull() | (F.col("step") < F.col("stop")))
    return open_.groupBy("row", "col").agg(F.max("paint").alias("p"))


def grow_path(p: np.ndarray, valid: np.ndarray, start: tuple[int, int], direction: tuple[float, float], steps: int, width: int = 3, penalty: float = 0.5, least: float = 0.3, shortest: int = 3) -> list[tuple[int, int]]:
    """Beam search from a valid tip: moves turn by 45 degrees at most, to valid cells of p at ``least`` or more that the path has not met.

    A move costs -log p of its cell and ``penalty`` times the squared turn in radians. Of the paths of most moves, ``shortest`` at
    least, the cheapest; of equally cheap ones the one found first, turns to the left first.
    """
    first = int(np.round(np.arctan2(*direction) / (np.pi / 4))) % 8
    beam: list[tuple[float, list[tuple[int, int]], int]] = [(0.0, [start], first)] if valid[start] else []
    best: list[tuple[int, int]] = []
    for step in range(1, steps + 1):
        grown = []
        for total, path, heading in beam:
            for turn in (-1, 0, 1):
                k = (heading + turn) % 8
                y, x = path[-1][0] + HEADINGS[k][0], path[-1][1] + HEADINGS[k][1]
                inside = 0 <= y < p.shape[0] and 0 <= x < p.shape[1]
                if inside and valid[y, x] and (y, x) not in path and p[y, x] >= least:
                    cost = penalty * (turn * np.pi / 4) ** 2 - np.log(p[y, x] + 1e-6)
                    grown.append((total + cost, [*path, (y, x)], k))
        if not grown:
            break
        beam = sorted(grown, key=lambda b: b[0])[:width]
        if step >= shortest:
            best = beam[0][1][1:]
    return best


def check_curved(steps: int, penalty: float, width: int, least: float, support: float, shortest: int, most: int, decay: float, window: int = 15, threshold: float = 0.5) -> None:
    """Refuse parameters of ``curved_paths`` outside their ranges."""
    rules = {
        "steps must be positive": steps >= 1, "penalty must not be negative": penalty >= 0, "width must be positive": width >= 1, "least must lie in [0, 1)": 0 <= least < 1,
        "support must lie in [0, 1]": 0 <= support <= 1, "shortest must be positive": shortest >= 1, "most must be positive": most >= 1, "decay must lie in (0, 1)": 0 < decay < 1,
        "window must be odd and at least 3": window >= 3 and window % 2 == 1, "threshold must lie in (0, 1)": 0 < threshold < 1,
    }
    if wrong := [text for text, right in rules.items() if not right]:
        raise ValueError("; ".join(wrong))


def best_tips(tips: DataFrame, cells: DataFrame, most: int) -> DataFrame:
    """The ``most`` tips of the largest mean p in the 3 x 3 cells around (to nine digits; ties: row, col)."""
    around = spread(tips, [(y, x, 1.0) for y in (-1, 0, 1) for x in (-1, 0, 1)]).join(_large(cells.select("row", "col", "p")), ["row", "col"])
    chosen = around.groupBy("from_row", "from_col").agg(F.round(F.avg("p"), 9).alias("mean")).orderBy(F.desc("mean"), "from_row", "from_col").limit(most)
    return chosen.select(F.col("from_row").alias("row"), F.col("from_col").alias("col"))


def curved_paths(tips: DataFrame, cells: DataFrame, steps: int = 3, threshold: float = 0.5, decay: float = 0.15, support: float = 0.4, most: int = 200, least: float = 0.3, penalty: float = 0.5, width: int = 3, shortest: int = 3) -> DataFrame:
    """row, col, p painted along grown paths from the ``most`` best of ``tips`` (row, col, dy, dx): threshold * exp(-decay * k) on a path's k-th cell, from 0.

    Paths stay on valid cells (column valid of ``cells``) and may cross the skeleton. Each tip's patch of (2 steps + 1) squared cells goes to
    a task with it; the number of tips bounds the whole. A path whose mean p is below ``support`` is not painted.
    """
    check_curved(steps, penalty, width, least, support, shortest, most, decay, threshold=threshold)
    chosen = tips.join(F.broadcast(best_tips(tips, cells, most)), ["row", "col"], "left_semi")
    offsets = [(y, x, 1.0) for y in range(-steps, steps + 1) for x in range(-steps, steps + 1)]
    patch = spread(chosen, offsets, ["dy", "dx"]).join(_large(cells.select("row", "col", "p", "valid")), ["row", "col"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["from_row"].iloc[0]), int(pdf["from_col"].iloc[0])
        n = 2 * steps + 1
        p, valid = np.zeros((n, n)), np.zeros((n, n), bool)
        y, x = pdf["row"].to_numpy() - r0 + steps, pdf["col"].to_numpy() - c0 + steps
        p[y, x], valid[y, x] = pdf["p"].to_numpy(), pdf["valid"].to_numpy().astype(bool)
        path = grow_path(p, valid, (steps, steps), (pdf["dy"].iloc[0], pdf["dx"].iloc[0]), steps, width, penalty, least, shortest)
        if path and np.mean([p[a] for a in path]) < support:
            path = []
        return pd.DataFrame({"row": [a + r0 - steps for a, _ in path], "col": [b + c0 - steps for _, b in path], "p": [threshold * np.exp(-decay * k) for k in range(len(path))]}).astype({"row": "int64", "col": "int64", "p": "float64"})

    painted = patch.groupBy("from_row", "from_col").applyInPandas(run, "row long, col long, p double")
    return painted.groupBy("row", "col").agg(F.max("p").alias("p"))


def raised(cells: DataFrame, paint: DataFrame) -> DataFrame:
    """``cells`` with p where paint (row, col, p) is not above it, and paint elsewhere."""
    return cells.join(paint.withColumnRenamed("p", "paint"), ["row", "col"], "left").withColumn("p", F.greatest("p", "paint")).drop("paint").select(*cells.columns)


def curved_continuation(cells: DataFrame, threshold: float, window: int = 15, **settings) -> tuple[DataFrame, DataFrame]:
    """``cells`` (row, col, p, valid) with curved continuations from the skeleton's ends; and one row of counts: skeleton_pixels, endpoints, budget, max_steps.

    The skeleton is that of the valid cells with p at ``threshold`` or more. ``settings`` are those of ``curved_paths``.
    """
    full = {"steps": 3, "penalty": 0.5, "width": 3, "least": 0.3, "support": 0.4, "shortest": 3, "most": 200, "decay": 0.15} | settings
    check_curved(**full, window=window, threshold=threshold)
    skeleton = thin_cells(cells.where(F.col("valid") & (F.col("p") >= threshold)))
    tips = materialise(endpoints(skeleton), "tips")
    counts = skeleton.agg(F.count(F.lit(1)).alias("skeleton_pixels")).join(F.broadcast(tips.agg(F.count(F.lit(1)).alias("endpoints"))))
    counts = counts.withColumns({"budget": F.lit(full["most"]), "max_steps": F.lit(full["steps"])})
    chosen = best_tips(tips, cells, full["most"])
    return raised(cells, curved_paths(orientations(chosen, skeleton, window), cells, threshold=threshold, **full)), counts
