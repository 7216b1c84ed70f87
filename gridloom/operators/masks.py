"""Masks within a distance, and leakage-safe cross-validation splits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.distance import distances
from gridloom.operators.grid import disk_offsets, materialise, spread
from gridloom.operators.order import exact_quantiles, ranked


#: Offsets of a disk up to which cells are spread over it (radii below 5); larger ones take the distance transform.
DISK = 64


def dilated(cells: DataFrame, radius: float, by: list[str] | None = None) -> DataFrame:
    """Distinct (by, row, col) within ``radius`` of the cells; a radius of 0 gives them back.

    Beyond a few cells each would be spread over some thousands, so tiles' distance transforms are taken instead.
    """
    by = by or []
    if 3.15 * radius * radius > DISK:
        return distances(cells, radius, by).select(*by, "row", "col")
    return spread(cells, disk_offsets(radius), by).select(*by, "row", "col").distinct()


def assign_blocks(height: int, width: int, block: int, folds: int, seed: int) -> np.ndarray:
    """Folds of square blocks: shuffled (PCG64), then dealt in turn."""
    if block < 1 or folds < 2:
        raise ValueError("block must be positive and folds at least 2")
    rows, cols = -(-height // block), -(-width // block)
    if rows * cols < folds:
        raise ValueError("fewer blocks than folds")
    order = np.random.default_rng(seed).permutation(rows * cols)
    out = np.empty(rows * cols, np.int16)
    out[order] = np.arange(rows * cols) % folds
    return out.reshape(rows, cols)


def block_folds(cells: DataFrame, assignment: np.ndarray, block: int) -> DataFrame:
    """``cells`` with fold: a lookup of the cell's block, which must be in the table; the planner chooses how to join it by its size."""
    table = [(int(r), int(c), int(assignment[r, c])) for r, c in np.ndindex(assignment.shape)]
    folds = cells.sparkSession.createDataFrame(table, "block_r long, block_c long, fold long")
    key = cells.withColumn("block_r", F.floor(F.col("row") / block)).withColumn("block_c", F.floor(F.col("col") / block))
    fold = F.coalesce("fold", F.raise_error(F.lit("a cell lies outside the table of blocks")).cast("long"))
    return key.join(folds, ["block_r", "block_c"], "left").drop("block_r", "block_c").withColumn("fold", fold)


def spatial_masks(cells: DataFrame, buffer: float) -> DataFrame:
    """fold, row, col, role for every fold k and valid cell: validation (own fold), excluded (within ``buffer`` of it) or train.

    Validation cells at a fold's edge are those with another fold beside them; only they can reach out, so only
    they are spread over the disk.
    """
    valid = cells.where("valid").select("row", "col", "fold")
    folds = valid.select(F.col("fold").alias("k")).distinct()
    beside = spread(valid, [(0, 1, 1.0), (0, -1, 1.0), (1, 0, 1.0), (-1, 0, 1.0)], ["fold"]).alias("s")
    v = valid.alias("v")
    same = (F.col("s.row") == F.col("v.row")) & (F.col("s.col") == F.col("v.col")) & (F.col("s.fold") == F.col("v.fold"))
    inner = beside.join(v, same).groupBy("s.fold", "s.from_row", "s.from_col").agg(F.count(F.lit(1)).alias("n")).where("n = 4")
    edge = valid.join(inner.select("fold", F.col("from_row").alias("row"), F.col("from_col").alias("col")), ["fold", "row", "col"], "left_anti")
    near = dilated(edge, buffer, ["fold"]).withColumnRenamed("fold", "k").withColumn("near", F.lit(True))
    every = valid.join(F.broadcast(folds)).join(near, ["k", "row", "col"], "left")
    role = F.when(F.col("fold") == F.col("k"), "validation").when(F.col("near"), "excluded").otherwise("train")
    return every.select(F.col("k").alias("fold"), "row", "col", role.alias("role"))


def discovery_masks(cells: DataFrame, buffer: float, exclusion: float, trace: bool = False) -> DataFrame:
    """Per fold k: train_truth, validation_truth, train and evaluation of every valid cell.

    ``cells`` has fold: of truth cells the fold of their fault (or of their trace's withheld end, -1 for its body).
    A fault split trains on the other folds' faults; a trace split on all that is not withheld, bodies too. Cells within
    ``buffer`` of withheld truth are not trained on; those within ``exclusion`` of training truth are not evaluated.
    """
    valid = cells.where("valid").select("row", "col", "truth", "fold")
    folds = valid.where("truth and fold >= 0").select(F.col("fold").alias("k")).distinct()
    truth = valid.where("truth").join(F.broadcast(folds))
    kept = (F.col("fold") != F.col("k")) if trace else (F.col("fold") != F.col("k")) & (F.col("fold") >= 0)
    known = truth.where(kept).select("k", "row", "col")
    held = truth.where("fold = k").select("k", "row", "col")
    mark = lambda df, name: df.withColumn(name, F.lit(True))
    out = valid.join(F.broadcast(folds))
    for table, name in ((known, "train_truth"), (held, "validation_truth"), (dilated(held, buffer, ["k"]), "withheld"), (dilated(known, exclusion, ["k"]), "excluded")):
        out = out.join(mark(table, name), ["k", "row", "col"], "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return out.select(F.col("k").alias("fold"), "row", "col", yes("train_truth").alias("train_truth"), yes("validation_truth").alias("validation_truth"), (~yes("withheld")).alias("train"), (~yes("excluded")).alias("evaluation"))


def training_cells(cells: DataFrame, bands: list[str], train: str = "train", truth: str = "train_truth") -> DataFrame:
    """row, col, bands, target and train: bands and target are 0 outside the training mask, so nothing withheld is seen."""
    own = F.col(train)
    return cells.select(
        "row", "col", *[F.when(own, F.col(b).cast("float")).otherwise(F.lit(0.0).cast("float")).alias(b) for b in bands],
        (own & F.col(truth)).cast("float").alias("target"), own.alias("train"),
    )


def split_errors(cells: DataFrame, scheme: str) -> list[str]:
    """What makes a fold map unusable; an empty list passes. ``cells``: valid, truth, fold, and component for truth cells."""
    whole = F.col("fold") == F.floor("fold")
    found = cells.agg(
        F.count_if(~whole | (F.col("fold") < -1) | F.col("fold").isNull()).alias("not_integer_or_below_minus_one"),
        F.count_if((F.lit(scheme) == "spatial") & F.col("valid") & (F.col("fold") < 0)).alias("valid_cells_unassigned"),
        F.count_if((F.lit(scheme) != "spatial") & ~F.col("truth") & (F.col("fold") >= 0)).alias("folds_off_truth"),
        (F.count_if((F.lit(scheme) == "trace") & F.col("truth") & (F.col("fold") < 0)) == F.lit(0)).cast("int").alias("no_body"),
    ).first()
    errors = [k for k, v in found.asDict().items() if v and (k != "no_body" or scheme == "trace")]
    if scheme == "fault":
        torn = cells.where("truth and component is not null").groupBy("component").agg(F.min("fold").alias("a"), F.max("fold").alias("b")).where("a <> b")
        errors += ["component_split_across_folds"] if not torn.isEmpty() else []
    return errors


def longest_first(counts: dict[int, int], folds: int) -> dict[int, list[int]]:
    """How many items of each size every fold gets, largest sizes first, each item to the fold of the least load (of equal ones the first).

    Items of a size are dealt at once: folds below a common level are filled up to it, then the rest one by one. So the work grows with the
    number of sizes, not of items.
    """
    if sum(counts.values()) < folds:
        raise ValueError("fewer components than folds")
    loads, out = [0] * folds, {}
    for size in sorted(counts, reverse=True):
        left, got = counts[size], [0] * folds
        low, high = min(loads), max(loads) + size * (left // folds + 1)
        while low < high:  # the highest load below which items still go, without going over their number
            mid = (low + high + 1) // 2
            if sum(max(0, -(-(mid - x) // size)) for x in loads) <= left:
                low = mid
            else:
                high = mid - 1
        for k in range(folds):
            got[k] = max(0, -(-(low - loads[k]) // size))
            loads[k] += got[k] * size
        for _ in range(left - sum(got)):
            k = min(range(folds), key=lambda i: (loads[i], i))
            got[k] += 1
            loads[k] += size
        out[size] = got
    return out


def assign_components(labelled: DataFrame, folds: int, seed: int) -> DataFrame:
    """component, fold: longest first onto the least loaded fold; of one size those of the least MD5 of seed and component come first.

    The driver sees how many components there are of each size, which are few numbers, and gives every fold its share of a size; components get their
    folds by their rank within their size.
    """
    sizes = materialise(labelled.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "sizes")
    counts = {r["n"]: r["c"] for r in sizes.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    shares = []
    for n, got in longest_first(counts, folds).items():
        after = 0
        for k, c in enumerate(got):
            shares.append((n, k, after, after + c))
            after += c
    table = labelled.sparkSession.createDataFrame([s for s in shares if s[2] < s[3]], "n long, fold int, low long, high long")
    rows = ranked(sizes.withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), "component").cast("binary"))), ["n"], ["h", "component"])
    return rows.join(table, "n").where((F.col("rank") > F.col("low")) & (F.col("rank") <= F.col("high"))).select("component", "fold")


def trace_ends(labelled: DataFrame, least: int = 24, fraction: float = 0.3) -> DataFrame:
    """component, row, col, withheld: the cells beyond the 1 - fraction quantile along the principal axis of large components.

    The axis is that of the 2 x 2 covariance in closed form, of whole-number moments, its larger coordinate made positive; places along it
    are taken to nine digits, so that cells side by side are equal. If no cell lies beyond the quantile, the last round(fraction * n)
    cells (1 to n - 1) are withheld. Quantiles and ranks are taken in ranges, so that a component of any size is shared by many tasks.
    """
    low = labelled.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("r0"), F.min("col").alias("c0")).where(F.col("n") >= least)
    cells = labelled.join(low, "component").withColumn("r", (F.col("row") - F.col("r0")).cast("long")).withColumn("c", (F.col("col") - F.col("c0")).cast("long"))
    moment = lambda x, y: F.count(F.lit(1)) * F.sum(F.col(x) * F.col(y)) - F.sum(x) * F.sum(y)
    angle = F.atan2(2 * F.col("rc"), F.col("rr") - F.col("cc")) / 2
    axes = cells.groupBy("component").agg(moment("r", "r").alias("rr"), moment("r", "c").alias("rc"), moment("c", "c").alias("cc"))
    axes = axes.select("component", F.round(F.cos(angle), 12).alias("ur"), F.round(F.sin(angle), 12).alias("uc"))
    sign = F.when(F.when(F.abs("ur") >= F.abs("uc"), F.col("ur")).otherwise(F.col("uc")) < 0, -1).otherwise(1)
    rows = cells.join(axes, "component").withColumn("along", F.round(sign * (F.col("r") * F.col("ur") + F.col("c") * F.col("uc")), 9))
    rows = materialise(rows.select("component", "row", "col", "n", "along"), "along")
    cut = rows.groupBy("component").agg(F.max("along").alias("most"), F.min("along").alias("fewest"))
    cut = cut.join(exact_quantiles(rows, "along", [1 - fraction], ["component"]).select("component", F.col("q")[0].alias("cut")), "component")
    parted = (F.col("most") >= F.col("cut")) & (F.col("fewest") < F.col("cut"))
    rows = rows.join(cut.withColumn("parted", parted), "component")
    beyond = rows.where("parted").select("component", "row", "col", (F.col("along") >= F.col("cut")).alias("withheld"))
    whole = ranked(rows.where("not parted").select("component", "row", "col", "n", "along"), ["component"], ["along", "row", "col"])
    last = F.col("rank") > F.col("n") - F.least(F.col("n") - 1, F.greatest(F.lit(1), F.round(F.col("n") * fraction).cast("long")))
    return beyond.union(whole.select("component", "row", "col", last.alias("withheld")))
