"""Queries read all of their table: brute force on tables that go beyond the smallest driver tables."""

import hashlib
import os
import random

import pytest

from gridloom.operators import ensemble, tiling
from gridloom.plans import registry
from gridloom.plans.raster import raster
from gridloom.plans.spatial import members

LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string"


def test_mirrored_views_reads_all_orders(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, rng.randrange(50), rng.randrange(1, 9), rng.randrange(1, 3), rng.choice("AN")) for k in range(1, 60_000, 2500)]
    rows += [(s, 1, s, 1, "R") for s in (1, 2, 4)] + [(9000 + s, 1, s, 3 if s == 4 else 2, "R") for s in (1, 2, 4)]
    spark.createDataFrame(rows, LINES).write.parquet(f"{tmp_path}/lineitem.parquet")
    views = {}
    for order, part, supplier, line, flag in sorted(rows, key=lambda r: (r[0], r[3], r[1])):
        views.setdefault((supplier, flag), []).append(line)
    want = {(c, f, r) for (c, f), x in views.items() for (r, g), y in views.items() if c % 2 == 0 and r % 2 == 1 and f == g and x == y}
    assert (2, "R", 1) in want and (4, "R", 1) not in want
    assert {(r.candidate, r.scheme, r.run) for r in registry.queries()["mirrored_views"](spark, str(tmp_path)).collect()} == want


def test_decision_feeders_reads_all_orders(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, rng.randrange(1, 30), rng.randrange(1, 12), 1, "N") for k in range(1, 60_000, 1500)]
    spark.createDataFrame(rows, LINES).write.parquet(f"{tmp_path}/lineitem.parquet")
    edges = {(part, supplier) for _, part, supplier, *_ in rows}
    want = edges | {(a, d) for a, b in edges for c, d in edges if b == c}
    assert sorted((r.src, r.decision) for r in registry.queries()["decision_feeders"](spark, str(tmp_path)).collect()) == sorted(want)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="driver tables are not there")
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_tiles_cover_all_rows(spark, sf):
    data = f"/root/testdata/{sf}"
    cells = [(r.row, r.col, r.v, r.truth, r.valid) for r in raster(spark, data).collect()]
    height = 1 + max(r[0] for r in cells)
    touched, positive, allowed = set(), set(), {}
    for row, col, v, truth, valid in cells:
        for row0 in tiling.tile_starts(height, 16, 0):
            if row0 <= row < row0 + 16:
                tile = (row0, col // 16 * 16)
                touched |= {tile} if v > 0.4 else set()
                positive |= {tile} if truth and v > 0.25 else set()
                allowed[tile] = allowed.get(tile, 0) + valid
    enough = {t for t, n in allowed.items() if n / 256 >= 0.85}
    assert height > 496 and max(allowed)[0] == height - 16
    assert {(r.row0, r.col0) for r in registry.queries()["touched_tiles"](spark, data).collect()} == touched
    found = {(r.row0, r.col0): r.positive for r in registry.queries()["training_origins"](spark, data).collect()}
    n = int(0.5 * len(positive & enough))
    drawn = sorted(enough - positive, key=lambda t: hashlib.md5(f"7:{t[0]}:{t[1]}".encode()).hexdigest())[:n]
    assert found == {t: True for t in positive & enough} | {t: False for t in drawn} and 0 < n < len(enough - positive)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables are not there")
def test_lofo_weights_fit_all_members(spark, monkeypatch):
    seen = []
    scores = ensemble.candidate_scores
    monkeypatch.setattr(ensemble, "candidate_scores", lambda m, t, names: seen.append((m, t, names)) or scores(m, t, names))
    data = "/root/testdata/sf0.001"
    found = {r.fold: (r.candidate, r.fit_mean) for r in registry.queries()["lofo_weights"](spark, data).collect()}
    (m, truth, names), = seen
    own = {r.member for r in members(spark, data).select("member").distinct().collect()}
    assert set(names) == {r.member for r in m.select("member").distinct().collect()} == own and len(own) == 3
    by = {(r.candidate, r.fold): r.score for r in scores(m, truth, names).collect()}
    assert {c for c, _ in by} == set(range(67))
    for fold, (candidate, mean) in found.items():
        means = [sum(s for (c, k), s in by.items() if c == i and k != fold) / (len(found) - 1) for i in range(67)]
        best = max(round(x, 12) for x in means)
        assert candidate == [round(x, 12) for x in means].index(best) and mean == pytest.approx(best, abs=1e-6)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="driver tables are not there")
def test_block_folds_of_all_rows(spark):
    import numpy as np

    data = "/root/testdata/sf0.1"
    cells = raster(spark, data).select("row", "col").collect()
    rows = -(-(1 + max(r.row for r in cells)) // 16)
    order = np.random.default_rng(7).permutation(rows * 4)
    fold = {int(b): i % 5 for i, b in enumerate(order)}
    found = {(r.row, r.col): r.fold for r in registry.queries()["block_folds"](spark, data).collect()}
    assert len(found) == len(cells) and all(found[r.row, r.col] == fold[r.row // 16 * 4 + r.col // 16] for r in cells)


def test_component_folds_are_whole_and_even(spark):
    data = "/root/testdata/sf0.001"
    from gridloom.operators import components
    from gridloom.plans.spatial import marked

    sizes = {r.component: r.n for r in components.label(marked(spark, data), tile=32).groupBy("component").count().withColumnRenamed("count", "n").collect()}
    found = {r.component: r.fold for r in registry.queries()["component_folds"](spark, data).collect()}
    loads = [sum(sizes[c] for c, k in found.items() if k == fold) for fold in range(5)]
    assert set(found) == set(sizes) and set(found.values()) == set(range(5)) and max(loads) - min(loads) <= max(sizes.values())
