"""Training on the distance-tolerant loss: its value and subgradient are one aggregation, its few weights are fitted by L-BFGS."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.grid import kernel_offsets, materialise, spread
from gridloom.operators.metric import ALPHA, BETA, EPS, RADIUS


@dataclass(frozen=True)
class Examples:
    """What every step reads: a row a truth cell with the cells its kernel reaches, and a row a cell with what no truth excuses of it."""

    truths: DataFrame
    field: DataFrame
    bands: tuple[str, ...]


def examples(cells: DataFrame, bands: list[str], radius: float = RADIUS, core: str | None = None) -> Examples:
    """Tables for ``loss_and_gradient``, written once, from ``cells`` (row, col, truth, valid, bands; null and NaN bands count as 0).

    Only valid cells take part, and only core cells count (column ``core``, all by default). A truth cell keeps the cells near it, as many as the kernel
    has offsets at most, so steps need no join and no shuffle of rows.
    """
    counts = F.col(core) if core else F.lit(True)
    x = F.array(*[F.coalesce(F.nanvl(F.col(b).cast("double"), F.lit(0.0)), F.lit(0.0)) for b in bands], F.lit(1.0))
    own = materialise(cells.where("valid").select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "truth", counts.alias("counts"), x.alias("x")), "cells")
    near = materialise(spread(own.where("truth"), kernel_offsets(radius), ["counts"]).join(own.select("row", "col", "x", F.col("counts").alias("here")), ["row", "col"]), "near")
    truths = near.where("counts").groupBy("from_row", "from_col").agg(F.sort_array(F.collect_list(F.struct("row", "col", "w", "x"))).alias("near"))
    kernel = near.groupBy("row", "col").agg(F.max("w").alias("k"))
    field = own.where("counts").join(kernel, ["row", "col"], "left").select(F.col("truth").cast("double").alias("t"), (1 - F.coalesce("k", F.lit(0.0))).alias("miss"), "x")
    return Examples(materialise(truths, "truths"), materialise(field, "field"), tuple(bands))


def _p(x: Column, theta: list[float]) -> Column:
    z = sum((x[i] * float(w) for i, w in enumerate(theta[1:], 1)), x[0] * float(theta[0]))
    return 1 / (1 + F.exp(-z))


def loss_and_gradient(data: Examples, theta: list[float], alpha: float = ALPHA, beta: float = BETA, blend: float = 1.0) -> DataFrame:
    """One row: loss, tp, fp, fn and gradient (an entry a weight, the constant last) at the weights ``theta`` of p = logistic(theta x).

    loss is ``blend`` times the distance-tolerant one and the rest times the plain Tversky loss. Of a truth cell only the pair of the
    greatest weighted p has a gradient; of equal ones that of the smallest row, then column.
    """
    if not 0 <= blend <= 1 or len(theta) != len(data.bands) + 1:
        raise ValueError("blend must lie in [0, 1], with a weight a band and one more")
    n = len(theta)
    best = F.array_max(F.transform("near", lambda c: F.struct((c["w"] * _p(c["x"], theta)).alias("m"), (-c["row"]).alias("r"), (-c["col"]).alias("c"), c["w"].alias("w"), c["x"].alias("x"))))
    top = data.truths.select(best.alias("b")).select("b.m", "b.w", "b.x", _p(F.col("b.x"), theta).alias("p"))
    slope = F.col("p") * (1 - F.col("p"))
    part = lambda weight, name: [F.sum(weight * slope * F.col("x")[i]).alias(f"{name}{i}") for i in range(n)]
    near = top.agg(F.sum("m").alias("tp"), F.count(F.lit(1)).alias("g"), *part(F.col("w"), "dt"))
    own = data.field.select("t", "miss", "x", _p(F.col("x"), theta).alias("p"))
    t, p = F.col("t"), F.col("p")
    rest = own.agg(F.sum(p * F.col("miss")).alias("fp"), F.sum(p * t).alias("tp0"), F.sum(p * (1 - t)).alias("fp0"), F.sum((1 - p) * t).alias("fn0"), *part(F.col("miss"), "df"), *part(t, "dp"), *part(1 - t, "dn"))
    both = near.join(F.broadcast(rest))
    both = both.select(*[F.coalesce(F.col(c), F.lit(0.0)).alias(c) if c != "g" else F.col(c) for c in both.columns])
    fn = F.col("g") - F.col("tp")
    whole = F.col("tp") + alpha * F.col("fp") + beta * fn + EPS
    plain = F.col("tp0") + alpha * F.col("fp0") + beta * F.col("fn0") + EPS
    loss = blend * (1 - F.col("tp") / whole) + (1 - blend) * (1 - F.col("tp0") / plain)
    entries = []
    for i in range(n):
        dt, df, dp, dn = (F.col(f"{c}{i}") for c in ("dt", "df", "dp", "dn"))
        tolerant = -(dt * whole - F.col("tp") * (dt + alpha * df - beta * dt)) / (whole * whole)
        simple = -(dp * plain - F.col("tp0") * (dp + alpha * dn - beta * dp)) / (plain * plain)
        entries.append(blend * tolerant + (1 - blend) * simple)
    return both.select(loss.alias("loss"), "tp", "fp", fn.alias("fn"), F.array(*entries).alias("gradient"))


def lbfgs(f: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int = 20, memory: int = 6, tolerance: float = 1e-7) -> tuple[np.ndarray, list[float]]:
    """Weights and the losses step by step (never rising); a step is halved until the loss falls enough."""
    x, (value, slope), pairs = start.astype(float), f(start), []
    losses = [value]
    for _ in range(steps):
        if np.abs(slope).max() < tolerance:
            break
        q, used = slope.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (y @ s)
            used.append(a)
            q -= a * y
        q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(np.linalg.norm(slope), 1e-12)
        for (s, y), a in zip(pairs, reversed(used)):
            q += (a - (y @ q) / (y @ s)) * s
        if (down := -(q @ slope)) >= 0:
            q, down, pairs = slope.copy(), -(slope @ slope), []
        rate = 1.0
        while rate > 1e-6:
            now, (at, new) = x - rate * q, f(x - rate * q)
            if at <= value + 1e-4 * rate * down:
                break
            rate /= 2
        else:
            break
        if (now - x) @ (new - slope) > 1e-12:
            pairs = [*pairs, (now - x, new - slope)][-memory:]
        x, value, slope = now, at, new
        losses.append(value)
    return x, losses


def fit(data: Examples, start: list[float] | None = None, steps: int = 20, alpha: float = ALPHA, beta: float = BETA, blend: float = 1.0) -> tuple[list[float], list[float]]:
    """Weights (the constant last) that lower the loss, and the losses; each evaluation is one Spark job, and a row comes back."""

    def f(theta: np.ndarray) -> tuple[float, np.ndarray]:
        one = loss_and_gradient(data, theta.tolist(), alpha, beta, blend).first()
        return one["loss"], np.array(one["gradient"])

    theta, losses = lbfgs(f, np.zeros(len(data.bands) + 1) if start is None else np.array(start, float), steps)
    return theta.tolist(), losses


def predict(cells: DataFrame, bands: list[str], theta: list[float]) -> DataFrame:
    """``cells`` with p."""
    x = F.array(*[F.coalesce(F.nanvl(F.col(b).cast("double"), F.lit(0.0)), F.lit(0.0)) for b in bands], F.lit(1.0))
    return cells.withColumn("p", _p(x, theta))
