"""Band features by expressions: normalisation on the fit cells, gradients, shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.grid import NAN
from gridloom.operators.order import exact_quantiles

SHIFTS = [(y, x) for y in (-1, 0, 1) for x in (-1, 0, 1) if (y, x) != (0, 0)]


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def normalise_on_fit(cells: DataFrame, bands: list[str], fit: str) -> DataFrame:
    """(x - low) / (high - low) with the range of finite fit cells; not clipped; not finite and constant give 0."""
    stats = []
    for b in bands:
        x = F.when(F.col(fit) & finite(F.col(b).cast("double")), F.col(b).cast("double"))
        stats += [F.min(x).alias(f"{b}_lo"), F.max(x).alias(f"{b}_hi"), F.count(x).alias(f"{b}_n")]
    one = cells.agg(*stats)
    out = cells.join(F.broadcast(one))
    for b in bands:
        lo, hi, x = F.col(f"{b}_lo"), F.col(f"{b}_hi"), F.col(b).cast("double")
        n = F.when(F.col(f"{b}_n") == 0, F.raise_error(F.lit(f"band {b} has no finite fit cell"))).otherwise(F.lit(0.0))
        out = out.withColumn(b, F.when(finite(x) & (hi > lo), (x - lo) / (hi - lo)).otherwise(0.0) + n)
    return out.drop(*[f"{b}_{s}" for b in bands for s in ("lo", "hi", "n")])


def normalise_reference(cells: DataFrame, bands: list[str]) -> DataFrame:
    """The same over the whole raster; a constant band gives NaN."""
    one = cells.agg(*[f(F.when(~F.isnan(F.col(b).cast("double")), F.col(b).cast("double"))).alias(f"{b}_{n}") for b in bands for n, f in (("lo", F.min), ("hi", F.max))])
    out = cells.join(F.broadcast(one))
    for b in bands:
        out = out.withColumn(b, F.coalesce(F.try_divide(F.col(b).cast("double") - F.col(f"{b}_lo"), F.col(f"{b}_hi") - F.col(f"{b}_lo")), F.lit(NAN)))
    return out.drop(*[f"{b}_{n}" for b in bands for n in ("lo", "hi")])


def percentile_clip(cells: DataFrame, band: str, mask: str, clip: float = 2.0) -> DataFrame:
    """Between the exact clip and 100 - clip percentiles of the mask, clipped to 0..1; NaN outside, 0.5 if constant."""
    inside = cells.where(F.col(mask) & finite(F.col(band)))
    one = exact_quantiles(inside, band, [clip / 100, 1 - clip / 100]).select(F.col("q").alias("cut"))
    lo, hi, x = F.col("cut")[0], F.col("cut")[1], F.col(band)
    value = F.when(~F.col(mask) | lo.isNull() | ~finite(x), F.lit(NAN)).when(hi <= lo, 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(x - lo, hi - lo))))
    return cells.join(F.broadcast(one)).withColumn(band, value).drop("cut")


def _gradient(x: str, along: Window) -> Column:
    """Central differences, one-sided at the ends of ``along``."""
    before, after, own = F.lag(x).over(along), F.lead(x).over(along), F.col(x)
    return F.when(before.isNotNull() & after.isNotNull(), (after - before) / 2).when(after.isNotNull(), after - own).when(before.isNotNull(), own - before).otherwise(0.0)


def gradient_energy(cells: DataFrame, bands: list[str]) -> DataFrame:
    """row, col, energy: root of the mean over bands of the squared gradient; cells outside ``valid`` count as 0 and give 0."""
    zero = cells.select("row", "col", "valid", *[F.when(F.col("valid") & finite(F.col(b)), F.col(b)).otherwise(0.0).alias(b) for b in bands])
    down, across = Window.partitionBy("col").orderBy("row"), Window.partitionBy("row").orderBy("col")
    terms = [_gradient(b, w) for b in bands for w in (down, across)]
    total = sum((t * t for t in terms), F.lit(0.0))
    return zero.select("row", "col", F.when(F.col("valid"), F.sqrt(total / len(bands))).otherwise(0.0).alias("energy"))


def phase_edge(energy: DataFrame, epsilon: float = 1.0) -> DataFrame:
    x = 4 * epsilon * F.col("energy")
    return energy.withColumn("edge", x / (1 + x))


def shift_channels(cells: DataFrame, bands: list[str], dy: int, dx: int, fill: float = 0.0) -> DataFrame:
    """Bands moved by (dy, dx) without wrapping; a cell takes its source only if both are valid, else ``fill``."""
    source = cells.where("valid").select((F.col("row") + dy).alias("row"), (F.col("col") + dx).alias("col"), *[F.col(b).alias(f"{b}_from") for b in bands])
    out = cells.join(source, ["row", "col"], "left")
    return out.withColumns({b: F.when(F.col("valid"), F.coalesce(F.col(f"{b}_from"), F.lit(fill))).otherwise(fill) for b in bands}).drop(*[f"{b}_from" for b in bands])


def eigenvalues(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """Of the symmetric matrix [[a, b], [b, c]], larger first."""
    half = (a + c) / 2
    root = F.sqrt(F.greatest(half * half - (a * c - b * b), F.lit(0.0)))
    return half + root, half - root


def downsample_any(cells: DataFrame, mask: str, stride: int) -> DataFrame:
    key = [F.floor(F.col("row") / stride).alias("row"), F.floor(F.col("col") / stride).alias("col")]
    return cells.groupBy(*key).agg(F.bool_or(mask).alias(mask))


def band_groups(tags: DataFrame, categories: list[str], tag: str = "category") -> dict[str, list[int]]:
    """Zero-based bands of each category by the band tags (band, key, value); a repeated, empty or missing category is an error."""
    if len(set(categories)) != len(categories) or not all(categories):
        raise ValueError("categories must be distinct and not empty")
    rows = tags.where((F.col("key") == tag) & F.col("value").isin(categories)).orderBy("band").collect()
    out = {c: [r["band"] for r in rows if r["value"] == c] for c in categories}
    if missing := [c for c, bands in out.items() if not bands]:
        raise ValueError(f"no band is tagged {missing}")
    return out
