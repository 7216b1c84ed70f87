"""The distance-tolerant Tversky metric and the losses derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.grid import disk_offsets, kernel_offsets, spread

ALPHA, BETA, RADIUS, EPS = 0.2, 0.8, 3.0, 1e-12


def tversky_score(tp: Column | str = "tp", fp: Column | str = "fp", fn: Column | str = "fn", alpha: float = ALPHA, beta: float = BETA) -> Column:
    tp, fp, fn = (F.col(c) if isinstance(c, str) else c for c in (tp, fp, fn))
    return tp / (tp + alpha * fp + beta * fn + EPS)


def tversky_components(cells: DataFrame, by: list[str] | None = None, radius: float = RADIUS, core: str | None = None) -> DataFrame:
    """by, tp, fp, fn, n_valid and n_truth of ``cells`` (row, col, p, truth, valid).

    A truth cell gets the best weighted prediction near it; a prediction costs what no truth near it excuses.
    Outside ``valid``, p is 0 and there is no truth. With ``core`` (a boolean column) only core cells count, while
    the others still are context. ``by`` keys (fold, candidate) never see each other's cells. The
    sparse truth is spread over the kernel's offsets and meets predictions in one equi-join on the cell.
    """
    by = by or []
    counts = F.col(core) if core else F.lit(True)
    cells = cells.where("valid").select(*by, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("p").cast("double").alias("p"), "truth", counts.alias("counts"))
    totals = cells.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.col("counts"), F.col("p"))), F.lit(0.0)).alias("all_p"), F.count_if("counts").alias("n_valid"), F.count_if(F.col("counts") & F.col("truth")).alias("n_truth")
    )
    truth = cells.where("truth").withColumn("from_counts", F.col("counts"))
    near = spread(truth, kernel_offsets(radius), [*by, "from_counts"]).join(cells.drop("truth"), [*by, "row", "col"])
    best = near.where("from_counts").groupBy(*by, "from_row", "from_col").agg(F.max(F.col("w") * F.col("p")).alias("m"))
    excused = near.where("counts").groupBy(*by, "row", "col").agg((F.max("w") * F.first("p")).alias("m"))
    tp, hit = best.groupBy(*by).agg(F.sum("m").alias("tp")), excused.groupBy(*by).agg(F.sum("m").alias("hit"))
    if by:
        out = totals.join(tp, by, "left").join(hit, by, "left")
    else:  # one row each
        out = totals.join(tp).join(hit)
    tp, hit = F.coalesce("tp", F.lit(0.0)), F.coalesce("hit", F.lit(0.0))
    return out.select(*by, tp.alias("tp"), (F.col("all_p") - hit).alias("fp"), (F.col("n_truth") - tp).alias("fn"), "n_valid", "n_truth")


def tversky(cells: DataFrame, by: list[str] | None = None, radius: float = RADIUS, alpha: float = ALPHA, beta: float = BETA) -> DataFrame:
    return tversky_components(cells, by, radius).withColumn("score", tversky_score(alpha=alpha, beta=beta))


#: No shift, then the eight neighbours.
SHIFTS = ((0, 0), (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))


def shift_sensitivity(cells: DataFrame, shifts: tuple[tuple[int, int], ...] = SHIFTS, radius: float = RADIUS, alpha: float = ALPHA, beta: float = BETA) -> DataFrame:
    """dy, dx, tp, fp, fn, score, delta and worst of the predictions moved by every shift, the first of which is the baseline.

    A moved prediction counts where its cell and the one it came from are valid; elsewhere it is 0. A cell gathers its predictions under all shifts in one
    array first; truth is then spread over the kernel once and meets these arrays in one join, and sums are kept by shift. worst marks the lowest score (of equal ones the
    first shift).
    """
    n = len(shifts)
    valid = cells.where("valid").select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("p").cast("double").alias("p"), "truth")
    moves = F.array(*[F.struct(F.lit(i).alias("s"), F.lit(y).cast("long").alias("dy"), F.lit(x).cast("long").alias("dx")) for i, (y, x) in enumerate(shifts)])
    moved = valid.select("row", "col", "p", F.explode(moves).alias("m")).select((F.col("row") + F.col("m.dy")).alias("row"), (F.col("col") + F.col("m.dx")).alias("col"), "m.s", "p")
    wide = moved.groupBy("row", "col").agg(F.array(*[F.coalesce(F.max(F.when(F.col("s") == i, F.col("p"))), F.lit(0.0)) for i in range(n)]).alias("ps"))
    own = valid.select("row", "col", "truth").join(wide, ["row", "col"], "left").withColumn("ps", F.coalesce("ps", F.array(*[F.lit(0.0)] * n)))
    near = spread(own.where("truth"), kernel_offsets(radius)).join(own.drop("truth"), ["row", "col"])
    each = lambda weight, i: weight * F.col("ps")[i]
    best = near.groupBy("from_row", "from_col").agg(*[F.max(each(F.col("w"), i)).alias(f"m{i}") for i in range(n)]).agg(*[F.sum(f"m{i}").alias(f"tp{i}") for i in range(n)])
    hit = near.groupBy("row", "col").agg(F.max("w").alias("w"), F.first("ps").alias("ps")).agg(*[F.sum(each(F.col("w"), i)).alias(f"hit{i}") for i in range(n)])
    total = own.agg(F.count_if("truth").alias("g"), *[F.sum(F.col("ps")[i]).alias(f"all{i}") for i in range(n)])
    value = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    rows = F.array(*[F.struct(F.lit(i).alias("s"), F.lit(y).alias("dy"), F.lit(x).alias("dx"), value(f"tp{i}").alias("tp"), (value(f"all{i}") - value(f"hit{i}")).alias("fp"), (F.col("g") - value(f"tp{i}")).alias("fn")) for i, (y, x) in enumerate(shifts)])
    found = total.join(F.broadcast(best)).join(F.broadcast(hit)).select(F.transform(rows, lambda r: r.withField("score", tversky_score(r["tp"], r["fp"], r["fn"], alpha, beta))).alias("r"))
    least = F.array_min(F.transform("r", lambda r: F.struct(r["score"], r["s"])))
    out = found.select(F.explode("r").alias("x"), F.col("r")[0]["score"].alias("base"), least.alias("least"))
    return out.select("x.dy", "x.dx", "x.tp", "x.fp", "x.fn", "x.score", (F.col("x.score") - F.col("base")).alias("delta"), (F.col("x.s") == F.col("least.s")).alias("worst"))


def ambiguity_weights(cells: DataFrame, radius: float = RADIUS, soften: float = 0.5) -> DataFrame:
    """``cells`` with weight: 0 if invalid, ``soften`` strictly within ``radius`` of a valid truth cell but not on one, else 1."""
    near = [o for o in disk_offsets(radius) if 0 < (o[0] ** 2 + o[1] ** 2) ** 0.5 < radius]
    band = spread(cells.where("valid and truth").select("row", "col"), near).select("row", "col").distinct().withColumn("near", F.lit(True))
    weight = F.when(~F.col("valid"), 0.0).when(~F.col("truth") & F.col("near"), soften).otherwise(1.0)
    return cells.join(band, ["row", "col"], "left").withColumn("weight", weight).drop("near")


def softened_components(cells: DataFrame, radius: float = RADIUS, soften: float = 0.5) -> DataFrame:
    """Soft Tversky components with the background near faults weighed less."""
    t, w, p = F.col("truth").cast("double"), F.col("weight"), F.when(F.col("valid"), F.col("p")).otherwise(0.0)
    return ambiguity_weights(cells, radius, soften).agg(
        F.sum(w * p * t).alias("tp"), F.sum(w * p * (1 - t)).alias("fp"), F.sum(w * (1 - p) * t).alias("fn")
    )


def loss(components: DataFrame, alpha: float = ALPHA, beta: float = BETA) -> DataFrame:
    return components.withColumn("loss", 1 - tversky_score(alpha=alpha, beta=beta))


def macro(scores: DataFrame) -> DataFrame:
    """Mean and population deviation over folds."""
    return scores.agg(F.avg("score").alias("macro_mean"), F.stddev_pop("score").alias("macro_std"), F.count(F.lit(1)).alias("folds"))


def stitch(predictions: DataFrame, fold_map: DataFrame) -> DataFrame:
    """The out-of-fold raster: each cell's prediction by the fold that owns it. Pooled scores are taken on this, never summed over folds."""
    return fold_map.where("fold >= 0").join(predictions, ["row", "col", "fold"], "left")


def evaluate_discovery(predictions: DataFrame, cells: DataFrame, exclusion: float, trace: bool = False) -> DataFrame:
    """fold, tp, fp, fn, n_valid, n_truth, score of each fold's own predictions on its withheld faults (or trace ends).

    ``predictions`` has fold, row, col, p over the whole raster for each fold; ``cells`` is that of ``discovery_masks``. Cells within ``exclusion`` of
    truth that was trained on are not evaluated. Masks overlap on the background, so there is no pooled score: ``macro`` gives the mean and
    deviation. A fold without predictions, or predictions of another fold, are an error.
    """
    from gridloom.operators.masks import discovery_masks

    masks = discovery_masks(cells, 0, exclusion, trace).where("evaluation").select("fold", "row", "col", F.col("validation_truth").alias("truth"), F.lit(True).alias("valid"))
    a, b = ({r["fold"] for r in x.select("fold").distinct().collect()} for x in (predictions, masks))
    if a != b:
        raise ValueError(f"predictions are of folds {sorted(a)}, the map has {sorted(b)}")
    own = masks.join(predictions.select("fold", "row", "col", "p"), ["fold", "row", "col"], "left")
    return tversky(own, ["fold"])
