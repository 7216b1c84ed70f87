"""Exact threshold curves, calibration and leave-one-fold-out thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.grid import NAN, in_ranges, kernel_offsets, materialise, spread
from gridloom.operators.metric import RADIUS, tversky_score


def binary_threshold(p: Column, t: float) -> Column:
    """1 at or above ``t``, else 0; NaN stays."""
    return F.when(F.isnan(p), F.lit(NAN)).otherwise((p >= t).cast("double"))


def calibrated(p: Column, t: float, scale: float = 1.0) -> Column:
    if not 0 < t < 1:
        raise ValueError("threshold must lie between 0 and 1")
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), p * (0.5 / t) * scale))


def soft_remap(p: Column, t: Column | float) -> Column:
    """Above t, (p - t) / (1 - t); below, half of p / t. It falls from 0.5 to 0 at t, as it must for equal results."""
    t = t if isinstance(t, Column) else F.lit(t)
    out = F.when(p >= t, (p - t) / (1 - t + 1e-9)).otherwise(p / (t + 1e-9) * 0.5)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), out))


def descending_sums(events: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """``events`` (by, threshold, values; a row for each distinct threshold) with the values summed from the greatest threshold on.

    In two steps: sums of ranges of thresholds, of like numbers of rows, are accumulated, and rows within each range; so no task
    sees all thresholds.
    """
    events = in_ranges(events, [*by, "threshold"], "events")
    above = Window.partitionBy(*by).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    sums = events.groupBy(*by, "part").agg(*[F.sum(v).alias(v) for v in values])
    sums = sums.select(*by, "part", *[F.coalesce(F.sum(v).over(above), F.lit(0.0)).alias(f"{v}_above") for v in values])
    within = Window.partitionBy(*by, "part").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    out = events.join(sums, [*by, "part"]).select(*by, "threshold", *[(F.sum(v).over(within) + F.col(f"{v}_above")).alias(v) for v in values])
    return out


def threshold_curve(cells: DataFrame, by: list[str] | None = None, radius: float = RADIUS) -> DataFrame:
    """by, threshold, tp, fp, fn, score of the binary rasters at every distinct p, and of the empty one just above the largest.

    As the threshold falls, a truth cell gains where the best weight among the predictions near it grows, and
    each cell costs what its best weight does not excuse; so one pass over events gives all thresholds.
    """
    by = by or []
    cells = cells.where("valid").select(*by, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("p").cast("double").alias("p"), "truth")
    near = spread(cells.where("truth"), kernel_offsets(radius), by).join(cells.drop("truth"), [*by, "row", "col"])
    falling = Window.partitionBy(*by, "from_row", "from_col").orderBy(F.desc("p"))
    levels = near.groupBy(*by, "from_row", "from_col", "p").agg(F.max("w").alias("w"))
    levels = levels.withColumn("best", F.max("w").over(falling.rowsBetween(Window.unboundedPreceding, 0)))
    gain = F.col("best") - F.coalesce(F.lag("best").over(falling), F.lit(0.0))
    tp = levels.select(*by, F.col("p").alias("threshold"), gain.alias("tp"), F.lit(0.0).alias("fp"))
    excused = near.groupBy(*by, "row", "col").agg(F.max("w").alias("w"), F.first("p").alias("p"))
    free = excused.select(*by, F.col("p").alias("threshold"), F.lit(0.0).alias("tp"), (-F.col("w")).alias("fp"))
    fp = cells.select(*by, F.col("p").alias("threshold"), F.lit(0.0).alias("tp"), F.lit(1.0).alias("fp"))
    events = tp.union(free).union(fp).groupBy(*by, "threshold").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
    sums = descending_sums(events, by, ["tp", "fp"])
    truth = cells.groupBy(*by).agg(F.count_if("truth").alias("n_truth"), F.max("p").alias("top"))
    none = truth.select(*by, (F.col("top") + F.greatest(F.abs("top"), F.lit(1.0)) * 1e-12).alias("threshold"), F.lit(0.0).alias("tp"), F.lit(0.0).alias("fp"))
    curve = sums.union(none)
    curve = curve.join(truth.drop("top"), by) if by else curve.join(truth.drop("top"))
    fn = F.greatest(F.col("n_truth") - F.col("tp"), F.lit(0.0))
    return curve.select(*by, "threshold", "tp", "fp", fn.alias("fn")).withColumn("score", tversky_score())


def best_threshold(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The best score and its threshold, the larger of equal ones."""
    best = F.max(F.struct("score", "threshold")).alias("best")
    return curve.groupBy(*(by or [])).agg(best).select(*(by or []), F.col("best.threshold").alias("threshold"), F.col("best.score").alias("score"))


def optimal_threshold(cells: DataFrame, radius: float = RADIUS) -> DataFrame:
    """One row: threshold, score and method, of the whole curve; nothing is searched, so there is no grid, bracket or tolerance to give."""
    return best_threshold(threshold_curve(cells, radius=radius)).withColumn("method", F.lit("exact"))


def scores_at(curve: DataFrame, candidates: DataFrame, by: list[str]) -> DataFrame:
    """by, candidate, score: the curve's step at each candidate, that of the least threshold not below it; above all, the empty raster's.

    An as-of lookup: candidates and curve are merged and looked up within ranges of like size; where a range has no threshold
    above a candidate, the least one of the next range that has any is taken. So no task sees all of a curve.
    """
    c = candidates.select(*by, F.col("candidate").alias("t"), F.lit(None).cast("double").alias("s"), F.lit(0).alias("kind"))
    k = curve.select(*by, F.col("threshold").alias("t"), F.col("score").alias("s"), F.lit(1).alias("kind"))
    rows = in_ranges(c.union(k), [*by, "t", "kind"], "lookup")
    own = F.when(F.col("kind") == 1, F.struct("t", "s"))
    parts = rows.groupBy(*by, "part").agg(F.min(own).alias("least"), F.max(own).alias("top"))
    rising = Window.partitionBy(*by).orderBy("part")
    parts = parts.select(*by, "part", F.first("least", True).over(rising.rowsBetween(1, Window.unboundedFollowing)).alias("next"), F.max("top").over(Window.partitionBy(*by)).alias("top"))
    falling = Window.partitionBy(*by, "part").orderBy(F.desc("t"), F.desc("kind"))
    found = rows.withColumn("here", F.last("s", True).over(falling.rowsBetween(Window.unboundedPreceding, 0))).where("kind = 0")
    return found.join(parts, [*by, "part"]).select(*by, F.col("t").alias("candidate"), F.coalesce("here", "next.s", "top.s").alias("score"))


def lofo_thresholds(curve: DataFrame, step: int = 1000) -> DataFrame:
    """fold, threshold, fit_mean: for each fold, the candidate of the best mean score on the other folds, the lowest of equal ones.

    Candidates are a grid and the other folds' best thresholds. The curve, which is read three times, is written once.
    """
    curve = materialise(curve.select("fold", "threshold", "score"), "curve")
    folds = curve.select("fold").distinct()
    best = best_threshold(curve, ["fold"]).select(F.col("fold").alias("of"), F.col("threshold").alias("candidate"))
    grid = curve.sparkSession.range(step + 1).select((F.col("id") / F.lit(float(step))).alias("candidate"))
    every = folds.join(grid.union(best.select("candidate")).distinct())
    at = scores_at(curve, every, ["fold"]).select(F.col("fold").alias("other"), "candidate", "score")
    own = best.withColumnRenamed("of", "best_of")
    allowed = folds.join(grid).union(folds.join(own, F.col("fold") != F.col("best_of")).select("fold", "candidate")).distinct()
    fit = allowed.join(at, "candidate").where("fold <> other").groupBy("fold", "candidate").agg(F.avg("score").alias("fit_mean"))
    top = fit.groupBy("fold").agg(F.max(F.struct(F.round("fit_mean", 12).alias("m"), (-F.col("candidate")).alias("c"))).alias("b"))
    return top.select("fold", (-F.col("b.c")).alias("threshold"), F.col("b.m").alias("fit_mean"))
