"""Exact order statistics and ranks without an order of all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.grid import in_ranges, materialise

#: Distinct values of a range that one window may order; ranges of more are parted again.
LIMIT = 1 << 16
#: Wanted ranges up to which they are broadcast.
BROADCAST = 1 << 14
PARTS = 4096


def octave_part(x: Column) -> Column:
    """A whole number that never falls as ``x`` rises: sign, binary exponent and ten bits after it.

    A logarithm that is rounded over a power of two gives the same number from either side.
    """
    a = F.abs(x)
    inside = F.when((x == 0) | F.isnan(x) | (a == float("inf")), 1.0).otherwise(a)
    e = F.least(F.floor(F.log2(inside)), F.lit(1023))
    size = (e + 1075) * 1024 + F.floor((inside / F.pow(F.lit(2.0), e) - 1) * 1024) + 1
    size = F.when(a == float("inf"), F.lit(1 << 40)).otherwise(size)
    return F.when(x == 0, F.lit(0)).when(x > 0, size).otherwise(-size).cast("long")


def _picked(counts: DataFrame, keys: list[str], part: str, keep: list[str]) -> DataFrame:
    """Of parts with n rows each the ones that hold wanted ranks, these ranks, and the rows before; parts of a key go through one window."""
    order = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = F.col("before") + F.sum("n").over(order)
    placed = counts.withColumn("after", after).withColumn("before", F.col("after") - F.col("n"))
    placed = placed.withColumn("ranks", F.filter("ranks", lambda r: (r >= F.col("before")) & (r < F.col("after"))))
    return placed.where(F.size("ranks") > 0).select(*keys, part, "before", "ranks", *keep)


def exact_quantiles(df: DataFrame, value: str | Column, qs: list[float], by: list[str] | None = None, limit: int = LIMIT) -> DataFrame:
    """by, n, q: for each key the number of values and the array of its quantiles, interpolated between the two nearest ranks.

    Rows are counted in ranges of values, all keys and quantiles at once; only the ranges with wanted ranks are read again, and
    ranges of more than ``limit`` distinct values are parted once more, each time into up to PARTS. So no task holds the values
    of a key, and rows are never sorted. The table is read twice.

    Null and NaN values do not count. Without keys there is one row, with a null q for no values; keys without values
    have no row. Infinite values are the first and last.
    """
    by = by or []
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = df.select(*by, (x + F.lit(0.0)).alias("x")).where("x is not null and not isnan(x)").withColumn("part", octave_part(F.col("x")))
    counts = materialise(rows.groupBy(*by, "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    whole = Window.partitionBy(*by)
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(q * (F.col("total") - 1)), F.ceil(q * (F.col("total") - 1))) for q in qs])))
    counts = counts.withColumn("total", F.sum("n").over(whole)).withColumn("ranks", ranks).withColumn("before", F.lit(0).cast("long"))
    wanted = materialise(_picked(counts, by, "part", ["total"]), "wanted")
    few = wanted.count() <= BROADCAST
    held = rows.join(F.broadcast(wanted.select(*by, "part")) if few else wanted.select(*by, "part"), [*by, "part"], "left_semi").groupBy(*by, "part", "x").agg(F.count(F.lit(1)).alias("n"))
    held = materialise(held.join(F.broadcast(wanted) if few else wanted, [*by, "part"]).withColumn("path", F.col("part").cast("string")).drop("part"), "held")
    keys = [*by, "path"]
    while True:
        ends = held.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("distinct"))
        if (ends.agg(F.max("distinct")).first()[0] or 0) <= limit:
            break
        at = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(PARTS - 1), F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * PARTS))).otherwise(0)
        parted = held.join(ends.drop("distinct"), keys).withColumn("sub", at).drop("lo", "hi")
        counts = parted.groupBy(*keys, "sub").agg(F.sum("n").alias("n"), F.first("before").alias("before"), F.first("ranks").alias("ranks"), F.first("total").alias("total"))
        kept = parted.drop("before", "ranks", "total").join(_picked(counts, keys, "sub", ["total"]), [*keys, "sub"])
        held = materialise(kept.withColumn("path", F.concat_ws("/", "path", "sub")).drop("sub"), "held")
    found = _picked(held, keys, "x", ["total"]).select(*by, "x", "total", F.explode("ranks").alias("rank"))
    one = found.groupBy(*by).agg(F.max("total").alias("n"), F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at"))

    def interpolated(q: float) -> Column:
        place = q * (F.col("n") - 1)
        lo, hi = F.col("at")[F.floor(place)], F.col("at")[F.ceil(place)]
        return F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (place - F.floor(place)))

    return one.select(*by, F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") > 0, F.array(*[interpolated(q) for q in qs])).alias("q"))


def ranked(df: DataFrame, by: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """``df`` with each row's place (from 1) among its key's in the order of ``order``, whose columns should tell the key's rows apart.

    Rows are dealt in ranges of all keys together, ordered within them, and raised by the counts of the ranges before: a key of any size is
    shared by many tasks.
    """
    placed = in_ranges(df, [*by, *order], "ranked")
    inner = Window.partitionBy("part", *by).orderBy(*order)
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("part", *by).agg(F.count(F.lit(1)).alias("in_part")).withColumn("base", F.coalesce(F.sum("in_part").over(before), F.lit(0))).drop("in_part")
    return placed.withColumn("inner", F.row_number().over(inner)).join(sizes, ["part", *by]).withColumn(name, F.col("inner") + F.col("base")).drop("part", "inner", "base")
