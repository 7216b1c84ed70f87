"""Calibration protocols over threshold curves, and training losses as evaluations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import metric, stencils
from gridloom.operators.metric import tversky, tversky_score
from gridloom.operators.threshold import best_threshold, threshold_curve


def binarised(cells: DataFrame, thresholds: DataFrame, by: list[str]) -> DataFrame:
    """``cells`` with p made 1 or 0 by each key's threshold; one row a key is broadcast by size, as the planner sees fit."""
    return cells.join(thresholds.select(*by, F.col("threshold").alias("cut")), by).withColumn("p", (F.col("p") >= F.col("cut")).cast("double")).drop("cut")


def lofo_stitched(cells: DataFrame) -> DataFrame:
    """fold, threshold, score: each fold's threshold is fitted on the stitched cells of all other folds and scored on its own.

    The folds left out are keys of one job.
    """
    folds = cells.select(F.col("fold").alias("target")).distinct()
    rest = cells.join(F.broadcast(folds), F.col("fold") != F.col("target"))
    fitted = best_threshold(threshold_curve(rest, ["target"]), ["target"]).select(F.col("target").alias("fold"), "threshold")
    scores = tversky(binarised(cells, fitted, ["fold"]), ["fold"]).select("fold", "score")
    return fitted.join(scores, "fold")


def rival_threshold(expected: float, factor: float = 0.2) -> float:
    return factor * expected


def rival_scores(cells: DataFrame, fixed: float, lofo: DataFrame) -> DataFrame:
    """fold, rival, lofo and delta: one fixed threshold against the folds' own; a fold without a LOFO threshold is an error."""
    fixed_rows = cells.withColumn("p", (F.col("p") >= fixed).cast("double"))
    a = tversky(fixed_rows, ["fold"]).select("fold", F.col("score").alias("rival"))
    b = tversky(binarised(cells, lofo, ["fold"]), ["fold"]).select("fold", F.col("score").alias("lofo"))
    both = a.join(b, "fold", "left").withColumn("lofo", F.coalesce("lofo", F.raise_error(F.lit("a fold has no LOFO threshold")).cast("double")))
    return both.withColumn("delta", F.col("rival") - F.col("lofo"))


def fit_and_evaluate(cells: DataFrame) -> DataFrame:
    """One row: the best threshold on ``fit`` cells and its score there and on ``evaluate`` cells, which must not overlap and must be valid."""
    odd = cells.agg(
        F.count_if(F.col("fit") & F.col("evaluate")).alias("both"), F.count_if((F.col("fit") | F.col("evaluate")) & ~F.col("valid")).alias("invalid"),
        F.count_if("fit").alias("fit"), F.count_if("evaluate").alias("evaluate"),
    ).first()
    if odd["both"]:
        raise ValueError(f"{odd['both']} cells are for fitting and evaluation")
    if odd["invalid"]:
        raise ValueError(f"{odd['invalid']} cells are for fitting or evaluation but not valid")
    for name in ("fit", "evaluate"):
        if not odd[name]:
            raise ValueError(f"no cells to {name}")
    fitted = best_threshold(threshold_curve(cells.where("fit"))).first()
    held = cells.where("evaluate").withColumn("p", (F.col("p") >= fitted["threshold"]).cast("double"))
    out = tversky(held).select(F.col("score").alias("evaluation_score"))
    return out.select(F.lit(fitted["threshold"]).alias("threshold"), F.lit(fitted["score"]).alias("fit_score"), "evaluation_score")


def own_fold_thresholds(cells: DataFrame) -> DataFrame:
    """fold, threshold fitted on the fold that it is for (not a held-out estimate); 0.5 for a fold without truth."""
    best = best_threshold(threshold_curve(cells, ["fold"]), ["fold"])
    truth = cells.groupBy("fold").agg(F.count_if(F.col("valid") & F.col("truth")).alias("n"))
    return truth.join(best, "fold", "left").select("fold", F.when(F.col("n") > 0, F.col("threshold")).otherwise(0.5).alias("threshold"))


def soft_tversky_loss(cells: DataFrame) -> DataFrame:
    """One row: 1 - the soft Tversky score of valid cells."""
    p, t = F.col("p"), F.col("truth").cast("double")
    sums = cells.where("valid").agg(F.sum(p * t).alias("tp"), F.sum(p * (1 - t)).alias("fp"), F.sum((1 - p) * t).alias("fn"))
    return sums.withColumn("loss", 1 - tversky_score())


def training_loss(config: dict) -> Callable[[DataFrame], DataFrame]:
    """The loss that a configuration names, as an evaluation of cells; a column ``loss``."""
    kind = config.get("loss", "tversky")
    if kind == "tversky":
        return soft_tversky_loss
    if kind == "distance_tversky":
        return lambda cells: metric.loss(metric.tversky_components(cells, radius=config.get("radius", 3.0), core=config.get("core")))
    if kind == "background_softened":
        return lambda cells: metric.loss(metric.softened_components(cells, config.get("radius", 3.0), config.get("soften", 0.5)))
    if kind == "skeleton_recall":
        weight = config.get("skeleton_weight", 0.5)

        def run(cells: DataFrame) -> DataFrame:
            found = stencils.skeletons(cells, config["height"], config["width"], config.get("iterations", 5))
            recall = stencils.skeleton_recall_loss(found).select(F.col("loss").alias("recall"))
            return soft_tversky_loss(cells).join(recall).withColumn("loss", F.col("loss") + weight * F.col("recall"))

        return run
    raise ValueError(f"unknown loss {kind!r}")
