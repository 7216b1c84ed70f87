"""Exact quantiles and ranks by ranges, and distance transforms, against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import distance, masks
from gridloom.operators.grid import disk_offsets, spread
from gridloom.operators.order import exact_quantiles, octave_part, ranked

QS = [0, 0.01, 0.25, 0.5, 0.731, 0.99, 1]


def numbers():
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(size=900), r.normal(size=200) * 1e300, r.normal(size=200) * 1e-310, np.zeros(400), [np.inf, -np.inf, 1.7976931348623157e308, 5e-324, -0.0], 2.0 ** np.arange(-60, 60), -(2.0 ** np.arange(-60, 60))])
    return x, r.integers(0, 4, len(x))


@pytest.mark.parametrize("limit", [1 << 16, 3])
def test_quantiles_are_exact(spark, limit):
    x, k = numbers()
    rows = [(int(a), float(b)) for a, b in zip(k, x)] + [(0, None), (1, float("nan")), (9, None)]
    found = exact_quantiles(spark.createDataFrame(rows, "k int, x double").repartition(5), "x", QS, ["k"], limit).collect()
    assert sorted(r.k for r in found) == [0, 1, 2, 3]
    for row in found:
        own = np.sort(x[k == row.k])
        assert row.n == len(own)
        for q, got in zip(QS, row.q):
            at = q * (len(own) - 1)
            lo, hi = own[math.floor(at)], own[math.ceil(at)]
            want = lo if lo == hi else lo + (hi - lo) * (at - math.floor(at))
            assert got == want or np.isnan(got) and np.isnan(want)


def test_quantiles_of_a_million_values_without_a_percentile(spark):
    rows = spark.range(0, 1_000_000, 1, 8).select((F.hash("id") / F.lit(7.0)).alias("x"))
    got = exact_quantiles(rows, "x", [0.02, 0.5, 0.98], limit=500).first()
    want = np.quantile(np.array(rows.toPandas()["x"]), [0.02, 0.5, 0.98])
    assert got.n == 1_000_000 and np.allclose(got.q, want, rtol=1e-12)
    empty = exact_quantiles(rows.where("x is null"), "x", [0.5]).collect()
    assert len(empty) == 1 and empty[0].n == 0 and empty[0].q is None


def test_parts_never_fall(spark):
    x = np.sort(np.concatenate([numbers()[0], np.nextafter(2.0 ** np.arange(-60, 60), 0), np.nextafter(2.0 ** np.arange(-60, 60), np.inf)]))
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double")
    parts = [r.p for r in rows.select("i", octave_part(F.col("x")).alias("p")).orderBy("i").collect()]
    assert parts == sorted(parts)


def test_ranks_by_ranges(spark):
    x, k = numbers()
    rows = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(k, x))], "i int, k int, x double")
    found = ranked(rows, ["k"], ["x", "i"]).toPandas().sort_values(["k", "x", "i"])
    assert len(found) == len(x) and (found.groupby("k").cumcount() + 1 == found["rank"]).all()


def brute(mask, radius):
    y, x = np.nonzero(mask)
    found = {}
    for a, b in zip(y.tolist(), x.tolist()):
        for dy, dx, _ in disk_offsets(radius):
            d2 = dy * dy + dx * dx
            found[a + dy, b + dx] = min(d2, found.get((a + dy, b + dx), d2))
    return found


@pytest.mark.parametrize("density", [0.001, 0.02, 0.5])
def test_squared_distances(density):
    r = np.random.default_rng(int(density * 1000))
    for shape in ((1, 1), (1, 30), (30, 1), (23, 41)):
        mask = r.random(shape) < density
        mask[r.integers(shape[0]), r.integers(shape[1])] = True
        y, x = np.nonzero(mask)
        want = ((np.arange(shape[0])[:, None, None] - y) ** 2 + (np.arange(shape[1])[None, :, None] - x) ** 2).min(axis=2)
        assert (distance.squared_distances(mask) == want).all()
    assert (distance.squared_distances(np.zeros((3, 4), bool)) >= distance.FAR).all()


@pytest.mark.parametrize("radius", [0, 1, 2.5, 5, 7.2, 16, 40])
def test_distances_by_tiles_equal_the_disk(spark, radius):
    r = np.random.default_rng(1)
    points = sorted({(int(a), int(b)) for a, b in r.integers(-60, 60, (25, 2))})
    mask = {p for p in points}
    rows = spark.createDataFrame([(k, a, b) for k in ("x", "y") for a, b in points if k == "x" or a > 0], "k string, row int, col int")
    found = distance.distances(rows, radius, ["k"], tile=32).collect()
    for k in ("x", "y"):
        want = {}
        for a, b in mask if k == "x" else {p for p in mask if p[0] > 0}:
            for dy, dx, _ in disk_offsets(radius):
                want[a + dy, b + dx] = min(dy * dy + dx * dx, want.get((a + dy, b + dx), 1 << 30))
        own = [((r.row, r.col), r.d2) for r in found if r.k == k]
        assert dict(own) == want and len(own) == len(want)


def test_dilation_takes_either_way_alike(spark):
    rows = spark.createDataFrame([(1, 1), (9, 2), (9, 3), (-4, 70)], "row long, col long")
    near = {tuple(r) for r in masks.dilated(rows, 6).collect()}
    assert near == {tuple(r) for r in spread(rows, disk_offsets(6)).select("row", "col").distinct().collect()}
    assert "FlatMapGroupsInPandas" in masks.dilated(rows, 32)._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="radius"):
        distance.distances(rows, -1)
    assert distance.distances(rows.limit(0), 9).count() == 0
