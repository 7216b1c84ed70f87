"""Ensembles of prediction rasters in long form: member, fold, row, col, p."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.grid import in_ranges, kernel_offsets, spread
from gridloom.operators.metric import RADIUS, tversky_score


def alignment_errors(members: DataFrame) -> DataFrame:
    """member, fold, cells of those whose fold set or number of cells is not the others'; no rows if all agree."""
    counts = members.groupBy("member", "fold").agg(F.count(F.lit(1)).alias("cells"))
    n = members.select("member").distinct().count()
    odd = counts.groupBy("fold").agg(F.count(F.lit(1)).alias("m"), F.min("cells").alias("a"), F.max("cells").alias("b")).where((F.col("m") != n) | (F.col("a") != F.col("b")))
    return counts.join(odd.select("fold"), "fold", "left_semi").select("member", "fold", "cells")


def mean(members: DataFrame) -> DataFrame:
    return members.groupBy("fold", "row", "col").agg(F.avg(F.col("p").cast("double")).cast("float").alias("p"))


def rank_average(members: DataFrame) -> DataFrame:
    """Mean over members of the rank of p among the member's finite cells, 0 to 1; equal p by row and col; one cell ranks 0.5.

    Ranks are taken in ranges of like size and raised by the counts of the ranges below, so no task has a whole raster, however
    many cells have one p.
    """
    finite = members.where(F.col("p").isNotNull() & ~F.isnan("p")).select("member", "fold", "row", "col", "p")
    finite = in_ranges(finite, ["member", "fold", "p", "row", "col"], "ranges")
    counts = finite.groupBy("member", "fold", "part").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("member", "fold")
    below = F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("member", "fold", "part", below.alias("below"), F.sum("n").over(own).alias("total"))
    within = Window.partitionBy("member", "fold", "part").orderBy("p", "row", "col")
    ranked = finite.withColumn("i", F.row_number().over(within)).join(counts, ["member", "fold", "part"])
    rank = F.when(F.col("total") == 1, F.lit(0.5)).otherwise((F.col("below") + F.col("i") - 1) / (F.col("total") - 1))
    return ranked.groupBy("fold", "row", "col").agg(F.avg(rank).alias("p"))


def weight_candidates(members: list[str]) -> list[dict[str, float]]:
    """Equal weights, each member alone and, for two or three members, the simplex in steps of 0.1; without repeats at 3 digits."""
    n = len(members)
    found = [tuple([1 / n] * n)] + [tuple(float(i == j) for j in range(n)) for i in range(n)]
    if n in (2, 3):
        found += [tuple(x / 10 for x in w) for w in itertools.product(range(11), repeat=n) if sum(w) == 10]
    unique = {tuple(round(x, 3) for x in w): w for w in reversed(found)}
    return [dict(zip(members, w)) for w in found if unique.get(tuple(round(x, 3) for x in w)) is w]


def candidate_scores(members: DataFrame, truth: DataFrame, names: list[str]) -> DataFrame:
    """candidate, fold, score of each weighted mean of the members.

    Which cells are near which truth does not depend on the weights, so pairs are found once and carry the members' predictions. What
    predictions cost is linear in them: sums by member do for all candidates. Only the best prediction near a truth
    cell is taken for each, from the pairs alone: a row a truth cell holds those of all candidates, side by side.
    """
    weights = weight_candidates(names)
    p = [F.coalesce(F.max(F.when(F.col("member") == m, F.col("p").cast("double"))), F.lit(0.0)).alias(f"p{i}") for i, m in enumerate(names)]
    own = [f"p{i}" for i in range(len(names))]
    cells = members.groupBy("fold", "row", "col").agg(*p)
    cells = cells.join(truth.where("valid").select("fold", "row", "col", "truth"), ["fold", "row", "col"])
    near = spread(cells.where("truth").select("fold", "row", "col"), kernel_offsets(RADIUS), ["fold"]).join(cells.drop("truth"), ["fold", "row", "col"])

    rows = F.array(*[F.struct(F.lit(j).alias("candidate"), *[F.lit(float(w[m])).alias(f"w{i}") for i, m in enumerate(names)]) for j, w in enumerate(weights)])
    mixed = sum((F.col(c) * F.col(f"c.w{i}") for i, c in enumerate(own)), F.lit(0.0))
    by = [sum((F.col(c) * F.lit(float(w[m])) for c, m in zip(own, names)), F.lit(0.0)) for w in weights]
    best = near.groupBy("fold", "from_row", "from_col").agg(*[F.max(F.col("w") * x).alias(f"b{j}") for j, x in enumerate(by)])
    best = best.groupBy("fold").agg(*[F.sum(f"b{j}").alias(f"b{j}") for j in range(len(by))])
    best = best.select("fold", F.posexplode(F.array(*[f"b{j}" for j in range(len(by))])).alias("candidate", "tp"))
    excused = near.groupBy("fold", "row", "col").agg(F.max("w").alias("w"), *[F.first(c).alias(c) for c in own])
    excused = excused.groupBy("fold").agg(*[F.sum(F.col("w") * F.col(c)).alias(f"hit_{c}") for c in own])
    totals = cells.groupBy("fold").agg(F.count_if("truth").alias("n_truth"), *[F.sum(c).alias(f"all_{c}") for c in own])
    free = [(F.col(f"all_{c}") - F.coalesce(f"hit_{c}", F.lit(0.0))).alias(c) for c in own]
    each = totals.join(excused, "fold", "left").select("fold", "n_truth", *free, F.explode(rows).alias("c"))
    each = each.select("fold", "n_truth", "c.candidate", mixed.alias("fp")).join(best, ["fold", "candidate"], "left").withColumn("tp", F.coalesce("tp", F.lit(0.0)))
    return each.withColumn("fn", F.col("n_truth") - F.col("tp")).select("candidate", "fold", tversky_score().alias("score"))


def lofo_weights(scores: DataFrame) -> DataFrame:
    """fold, candidate: the best mean score on the other folds, the first of equal ones; a lone fold takes equal weights."""
    folds = scores.select(F.col("fold").alias("target")).distinct()
    fit = folds.join(scores, F.col("target") != F.col("fold")).groupBy("target", "candidate").agg(F.avg("score").alias("mean"))
    best = fit.groupBy("target").agg(F.max(F.struct(F.round("mean", 12).alias("m"), (-F.col("candidate")).alias("c"))).alias("b"))
    return folds.join(best, "target", "left").select(F.col("target").alias("fold"), F.coalesce(-F.col("b.c"), F.lit(0)).alias("candidate"), F.col("b.m").alias("fit_mean"))


def apply(members: DataFrame, method: str, weights: DataFrame | None = None) -> DataFrame:
    """fold, row, col, p by ``method``: mean, rank_average or weighted, which takes ``weights`` (fold, member, weight).

    Weights of a fold must be finite, not negative and sum to 1 with one for each member; anything else is an error.
    """
    if method == "mean":
        return mean(members)
    if method == "rank_average":
        return rank_average(members)
    if method != "weighted":
        raise ValueError(f"unknown method {method!r}; one of mean, rank_average, weighted")
    if weights is None:
        raise ValueError("a weighted ensemble needs weights")
    w = F.col("weight")
    sums = weights.groupBy("fold").agg(F.sum(w).alias("total"), F.min(F.when(F.isnan(w), -1.0).otherwise(w)).alias("least"), F.count(w).alias("n"), F.count_distinct("member").alias("m"))
    want = members.groupBy("fold").agg(F.count_distinct("member").alias("members"))
    odd = want.join(sums, "fold", "left").where("total is null or abs(total - 1) > 1e-6 or least < 0 or n <> members or m <> members")
    if bad := sorted(r["fold"] for r in odd.select("fold").collect()):
        raise ValueError(f"weights of folds {bad} do not fit their members")
    mixed = members.join(F.broadcast(weights), ["fold", "member"])  # a row a fold and member
    return mixed.groupBy("fold", "row", "col").agg(F.sum(F.col("p").cast("double") * w).alias("p"))
