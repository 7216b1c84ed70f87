import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import components, ensemble, features, gate, geometry, grid, masks, metric, stencils, threshold, tiling


def table(spark, **arrays):
    shape = next(iter(arrays.values())).shape
    rows = [(int(r), int(c), *(a[r, c].item() for a in arrays.values())) for r, c in np.ndindex(shape)]
    kinds = {"b": "boolean", "f": "double", "i": "long"}
    return spark.createDataFrame(rows, "row long, col long, " + ", ".join(f"{k} {kinds[a.dtype.kind]}" for k, a in arrays.items()))


def brute_components(p, truth, valid, radius=3.0):
    p, truth = np.where(valid, p, 0), truth & valid
    tp, excused = 0.0, np.zeros(p.shape)
    cells = list(np.ndindex(p.shape))
    for g in cells:
        if truth[g]:
            best = 0.0
            for x in cells:
                k = 1 - math.hypot(x[0] - g[0], x[1] - g[1]) / radius
                if k > 0:
                    best = max(best, p[x] * k)
                    excused[x] = max(excused[x], k)
            tp += best
    return tp, float((p * (1 - excused))[valid].sum()), truth.sum() - tp


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    p, truth, valid = rng.choice([0, 0.1, 0.5, 0.9, 1], (6, 7)), rng.random((6, 7)) < 0.2, rng.random((6, 7)) < 0.8
    row = metric.tversky_components(table(spark, p=p, truth=truth, valid=valid)).first()
    assert np.allclose((row.tp, row.fp, row.fn), brute_components(p, truth, valid))


@pytest.mark.parametrize("offset,score", [(0, 1.0), (3, 0.0)])
def test_single_pixel(spark, offset, score):
    p, truth = np.zeros((9, 9)), np.zeros((9, 9), bool)
    truth[4, 4], p[4, 4 + offset] = True, 1.0
    row = metric.tversky(table(spark, p=p, truth=truth, valid=np.ones((9, 9), bool))).first()
    assert row.score == pytest.approx(score, abs=1e-9)


def test_seam_counts_only_when_stitched(spark):
    p, truth = np.zeros((10, 12)), np.zeros((10, 12), bool)
    truth[4, 5], p[4, 6] = True, 1.0
    fold = np.tile((np.arange(12) >= 6).astype(np.int64), (10, 1))
    cells = table(spark, p=p, truth=truth, valid=np.ones((10, 12), bool), fold=fold)
    assert metric.tversky(cells).first().score == pytest.approx(2 / 3 / (2 / 3 + 0.2 / 3 + 0.8 / 3), abs=1e-6)
    assert metric.macro(metric.tversky(cells, ["fold"])).first().macro_mean == pytest.approx(0, abs=1e-9)


def test_every_threshold_of_the_curve(spark):
    rng = np.random.default_rng(5)
    p, truth, valid = rng.choice([0, 0.1, 0.5, 0.9, 1], (6, 6)), rng.random((6, 6)) < 0.2, rng.random((6, 6)) < 0.9
    curve = threshold.threshold_curve(table(spark, p=p, truth=truth, valid=valid)).collect()
    assert len(curve) == len(np.unique(p[valid])) + 1
    for row in curve:
        assert np.allclose((row.tp, row.fp, row.fn), brute_components((p >= row.threshold).astype(float), truth, valid))


def test_no_truth_and_empty_table(spark):
    cells = table(spark, p=np.ones((2, 2)), truth=np.zeros((2, 2), bool), valid=np.ones((2, 2), bool))
    row = metric.tversky(cells).first()
    assert (row.tp, row.fn, row.score) == (0, 0, 0) and row.fp == 4
    assert metric.tversky(cells.limit(0)).first().score == 0


def test_predictions_are_checked(spark):
    p, valid = np.array([[0.5, math.nan]]), np.array([[True, False]])
    grid.check_predictions(table(spark, p=p, valid=valid))
    with pytest.raises(ValueError):
        grid.check_predictions(table(spark, p=p, valid=~valid))


@pytest.mark.parametrize("connectivity", [4, 8])
def test_labels_match_flood_fill_at_any_tile_size(spark, connectivity):
    rng = np.random.default_rng(3)
    mask = rng.random((23, 19)) < 0.45
    steps = [(y, x) for y in (-1, 0, 1) for x in (-1, 0, 1) if (y, x) != (0, 0) and (connectivity == 8 or 0 in (y, x))]
    seen = {}
    for start in zip(*np.nonzero(mask)):
        if start not in seen:
            todo, seen[start] = [start], start
            while todo:
                r, c = todo.pop()
                for y, x in steps:
                    n = (r + y, c + x)
                    if 0 <= n[0] < 23 and 0 <= n[1] < 19 and mask[n] and n not in seen:
                        seen[n] = start
                        todo.append(n)
    cells = table(spark, m=mask).where("m")
    for tile in (5, 64):
        found = {(r.row, r.col): r.component for r in components.label(cells, connectivity, tile).collect()}
        assert found == {k: (int(v[0]) << 32) + int(v[1]) for k, v in seen.items()}


def test_stencils_do_not_depend_on_tiles(spark):
    rng = np.random.default_rng(7)
    cells = table(spark, v=rng.normal(size=(20, 24)), valid=rng.random((20, 24)) < 0.9, fit=rng.random((20, 24)) < 0.7, p=rng.random((20, 24)), truth=rng.random((20, 24)) < 0.3)
    for run in (
        lambda t: stencils.smoothed(cells, "v", 1.0, 20, 24, t),
        lambda t: stencils.structure_tensor(cells, ["v"], 0.5, 0.5, 20, 24, t),
        lambda t: stencils.ridge_valley(cells, ["v"], [0.5], 0.5, "fit", 20, 24, t),
        lambda t: stencils.steerable(cells, ["v"], 0.5, 4.0, 3, "fit", 20, 24, t),
        lambda t: stencils.log_edges(cells, ["v"], 0.5, 0.5, "fit", 20, 24, t),
        lambda t: stencils.skeletons(cells, 20, 24, 2, t),
    ):
        a, b = ([list(map(float, r)) for r in run(t).orderBy("row", "col").collect()] for t in (7, 64))
        assert np.allclose(a, b, atol=1e-9)


def test_soft_skeleton_keeps_a_line():
    x = np.zeros((7, 9))
    x[3, 1:8] = 1
    assert (stencils.soft_skeleton(x) == x).all()


def test_thinning_leaves_a_thin_line():
    x = np.zeros((7, 12), bool)
    x[2:5, 1:11] = True
    thin = geometry.thin(x)
    assert thin.any() and thin.sum(0).max() == 1 and (geometry.thin(thin) == thin).all()


def test_endpoints_and_extension(spark):
    skeleton = np.zeros((9, 15), bool)
    skeleton[4, 3:9] = True
    cells = table(spark, skeleton=skeleton, p=np.where(skeleton, 0.8, 0.0))
    tips = geometry.endpoints(cells.where("skeleton"))
    assert {(r.row, r.col) for r in tips.collect()} == {(4, 3), (4, 8)}
    found = geometry.extend(geometry.orientations(tips, cells.where("skeleton"), 4), cells, 2, 0.15).collect()
    assert {(r.row, r.col) for r in found} == {(4, 2), (4, 1), (4, 9), (4, 10)}
    assert max(r.p for r in found) == pytest.approx(0.8 * math.exp(-0.15))


def test_blocks_and_greedy_folds():
    a = masks.assign_blocks(10, 10, 2, 5, 0)
    assert (np.bincount(a.ravel()) == 5).all() and (a == masks.assign_blocks(10, 10, 2, 5, 0)).all()
    shares = masks.longest_first({9: 1, 5: 1, 4: 1, 1: 1}, 2)
    assert sorted(sum(n * got[k] for n, got in shares.items()) for k in (0, 1)) == [9, 10]
    with pytest.raises(ValueError):
        masks.longest_first({1: 1}, 2)


def test_trace_ends_withhold_one_end(spark):
    rows = [(1, 2, c) for c in range(40)] + [(2, 9, c) for c in range(5)]
    found = masks.trace_ends(spark.createDataFrame(rows, "component long, row long, col long")).collect()
    held = sorted(r.col for r in found if r.withheld)
    assert {r.component for r in found} == {1} and held == list(range(28, 40))


def test_held_out_cells_do_not_reach_training_features(spark):
    rng = np.random.default_rng(1)
    v, fit = rng.normal(size=(8, 8)), np.ones((8, 8), bool)
    fit[:, 6:] = False
    moved = np.where(fit, v, v + 1000)
    a, b = (features.normalise_on_fit(table(spark, v=x, fit=fit), ["v"], "fit").where("fit").orderBy("row", "col").select("v").collect() for x in (v, moved))
    assert a == b


def test_tiles_cover_and_blend_back(spark):
    assert tiling.tile_starts(10, 4, 1) == [0, 3, 6] and tiling.tile_starts(11, 4, 1) == [0, 3, 6, 7] and tiling.tile_starts(3, 4, 0) == [0]
    p = np.random.default_rng(0).random((11, 9))
    tiles = tiling.to_tiles(table(spark, p=p), 11, 9, 4, 1)
    assert {(r.row0, r.col0) for r in tiles.select("row0", "col0").distinct().collect()} == {(r, c) for r in tiling.tile_starts(11, 4, 1) for c in tiling.tile_starts(9, 4, 1)}
    assert all(abs(r.p - p[r.row, r.col]) < 1e-12 for r in tiling.blend(tiles, 4).collect())


def test_rank_average_of_equal_members(spark):
    rows = [(m, 0, 0, c, p) for m in "ab" for c, p in enumerate([0.1, 0.1, 0.7, math.nan])]
    found = ensemble.rank_average(spark.createDataFrame(rows, "member string, fold int, row int, col int, p double")).orderBy("col").collect()
    assert [r.p for r in found] == [0, 0.5, 1]
    assert len(ensemble.weight_candidates(["a", "b"])) == 11 and len(ensemble.weight_candidates(list("abcd"))) == 5


def report(scores, view="spatial", aggregate=None, **protocol):
    tp, fp, fn = 5.0, 10.0, 5.0
    return {
        "scheme": view, "macro_mean": float(np.mean(scores)), "macro_std": float(np.std(scores)), "aggregate_score": tp / (tp + 0.2 * fp + 0.8 * fn + 1e-12) if aggregate is None else aggregate,
        "aggregate_components": {"tp_w": tp, "fp_w": fp, "fn_w": fn, "valid_pixels": 100 * len(scores), "truth_pixels": 10},
        "evaluation_protocol": {"schema_version": 2, "aggregation": gate.AGGREGATION[view], "metric": "distance_weighted_tversky", "known_fault_exclusion_pixels": 0, "alpha": 0.2, "beta": 0.8, "radius_pixels": 3.0, "truth_sha256": "a" * 64, "fold_map_sha256": "b" * 64} | protocol,
        "folds": [{"fold": i, "score": s, "valid_pixels": 100, "truth_pixels": 10 // len(scores)} for i, s in enumerate(scores)],
    }


def test_gate(spark, tmp_path):
    low, high = [0.1, 0.11], [0.3, 0.31]
    views = {v: report(low, v) for v in gate.VIEWS}
    better = {v: report(high, v) for v in gate.VIEWS}
    for v in (views["spatial"], better["spatial"]):
        assert gate.parse_report("spatial", v)["score"] == pytest.approx(v["aggregate_score"])
    out = gate.verify("c", views, better, 0)
    assert out["verdict"] == "REJECT"  # the pooled score did not move
    assert gate.compare("fault", views["fault"], better["fault"], 3).won
    assert not gate.compare("fault", views["fault"], report(high, "fault", seed=2), 0).comparable
    assert not gate.compare("fault", {}, better["fault"], 0).comparable
    assert gate.escalation(0) == 1 and gate.escalation(1) == 1.5 and gate.bonferroni(0.05, 5, 2) == pytest.approx(0.005)
    path = f"file://{tmp_path}/ledger"
    assert gate.count_trials(spark, path) == 0
    gate.record(spark, path, out, "2024-01-01T00:00:00Z")
    gate.record(spark, path, out, "2024-01-02T00:00:00Z")
    assert gate.count_trials(spark, path) == 2


def test_reports_are_checked_strictly():
    from copy import deepcopy

    good = report([0.3, 0.31])
    assert gate.report_errors("spatial", good) == []
    for path, bad in [
        (("scheme",), "fault"), (("evaluation_protocol", "radius_pixels"), 3), (("evaluation_protocol", "schema_version"), 1), (("evaluation_protocol", "metric"), "tversky"),
        (("evaluation_protocol", "aggregation"), "overlapping_background_macro"), (("evaluation_protocol", "truth_sha256"), "A" * 64), (("evaluation_protocol", "known_fault_exclusion_pixels"), 2),
        (("evaluation_protocol", "alpha"), None), (("macro_mean",), 0.5), (("macro_std",), True), (("folds", 0, "fold"), 1), (("folds", 0, "score"), 1.5), (("folds", 0, "valid_pixels"), 100.0),
        (("folds", 1, "truth_pixels"), 101), (("folds",), good["folds"][:1]), (("aggregate_components", "tp_w"), 4.0), (("aggregate_components", "valid_pixels"), 199), (("aggregate_score",), 0.9),
    ]:
        broken = deepcopy(good)
        at = broken
        for step in path[:-1]:
            at = at[step]
        at[path[-1]] = bad
        assert gate.report_errors("spatial", broken), path
        with pytest.raises(ValueError):
            gate.parse_report("spatial", broken)
    assert gate.report_errors("spatial", None) and gate.report_errors("spatial", {})


def test_candidate_wins_enough_views(spark):
    rows = [(v, run, k, 0.1 * k + (up if run == "b" else 0) + 0.001 * (k % 2)) for v, up in (("x", 0.2), ("y", 0.1), ("z", -0.1)) for run in "ab" for k in range(5)]
    rows = [(v, r, k, s + (0.002 * k if r == "b" else 0)) for v, r, k, s in rows]
    scores = spark.createDataFrame(rows, "view string, run string, fold int, score double")
    for r in gate.paired_gate(scores, ["view"], "a", "b").collect():
        assert r.p == pytest.approx(gate.p_value(r.mean_difference, r.std_error, r.n), abs=1e-12)
    found = gate.evaluate_candidate(scores, "a", "b", 2).first()
    assert (found.views, found.won, found.accepted) == (3, 2, True) and found.alpha == pytest.approx(0.05 / 9)
    assert not gate.evaluate_candidate(scores, "b", "a", 2).first().accepted
    for df in range(1, 9):
        one = spark.range(1).select(gate._t_cdf(F.lit(1.3), F.lit(df)).alias("p")).first().p
        assert one == pytest.approx(gate.student_t_cdf(1.3, df), abs=1e-12)
    with pytest.raises(Exception, match="two common folds"):
        gate.paired_gate(scores.where("fold = 0"), ["view"], "a", "b").collect()


def test_calibration_refuses_cells_that_do_not_fit(spark):
    from gridloom.operators import calibration

    rows = [(0, c, 0.1 * c, c % 3 == 0, c != 5, c < 4, c >= 6) for c in range(10)]
    cells = spark.createDataFrame(rows, "row int, col int, p double, truth boolean, valid boolean, fit boolean, evaluate boolean")
    assert calibration.fit_and_evaluate(cells).first().threshold == 0.0
    for bad in (cells.withColumn("evaluate", F.col("col") >= 3), cells.withColumn("fit", F.col("col") <= 5), cells.withColumn("fit", F.lit(False)), cells.withColumn("evaluate", F.lit(False))):
        with pytest.raises(ValueError):
            calibration.fit_and_evaluate(bad)


def test_curved_paths_pay_radians_and_have_a_least_length():
    from gridloom.operators import geometry

    p = np.full((9, 9), 0.2)
    p[4, 4:8] = (0.9, 0.6, 0.6, 0.6)
    p[3, 5] = 0.75  # a bend that a cost of 0.5 a turn of 45 degrees would not be worth, but one of 0.31 is with its way back
    every = np.ones((9, 9), bool)
    straight = [(4, 5), (4, 6), (4, 7)]
    assert geometry.grow_path(p, every, (4, 4), (0.0, 1.0), 3) == straight
    assert geometry.grow_path(p, every, (4, 4), (0.0, 1.0), 2) == []  # shorter than three moves
    assert geometry.grow_path(p, every, (4, 4), (0.0, 1.0), 2, shortest=1) == [(4, 5), (4, 6)]
    p[3, 6], p[3, 7] = 0.95, 0.95
    p[4, 5:8] = 0.5
    # the bend: 0.3084 and -log 0.75, 0.95, 0.95 against 3 x -log 0.5
    assert geometry.grow_path(p, every, (4, 4), (0.0, 1.0), 3) == [(3, 5), (3, 6), (3, 7)]
    assert geometry.grow_path(p, every, (4, 4), (0.0, 1.0), 3, least=0.6) == [(3, 5), (3, 6), (3, 7)]
    with pytest.raises(ValueError):
        geometry.check_curved(3, 0.5, 3, 1.0, 0.4, 3, 200, 0.15)


def test_discovery_is_scored_on_what_was_withheld(spark):
    from gridloom.operators import metric

    rng = np.random.default_rng(3)
    shape = (20, 24)
    truth = rng.random(shape) < 0.08
    fold = np.where(truth, rng.integers(-1, 3, shape), -1)
    valid = rng.random(shape) < 0.9
    p = {k: rng.random(shape) for k in range(3)}
    cells = spark.createDataFrame([(r, c, bool(truth[r, c]), bool(valid[r, c]), int(fold[r, c])) for r, c in np.ndindex(shape)], "row long, col long, truth boolean, valid boolean, fold long")
    predictions = spark.createDataFrame([(k, r, c, float(p[k][r, c])) for k in p for r, c in np.ndindex(shape)], "fold long, row long, col long, p double")
    disk = [(y, x) for y in range(-2, 3) for x in range(-2, 3) if y * y + x * x <= 4]
    for trace in (False, True):
        found = {r.fold: r for r in metric.evaluate_discovery(predictions, cells, 2, trace).collect()}
        assert set(found) == {0, 1, 2}
        for k in p:
            known = truth & valid & (fold != k) & ((fold >= 0) | trace)
            near = {(r + y, c + x) for r, c in zip(*np.nonzero(known)) for y, x in disk}
            own = {(r, c) for r, c in np.ndindex(shape) if valid[r, c] and (r, c) not in near}
            held = {(r, c) for r, c in own if truth[r, c] and fold[r, c] == k}
            weight = lambda a, b: max(0.0, 1 - math.hypot(a[0] - b[0], a[1] - b[1]) / 3)
            tp = sum(max((weight(t, q) * p[k][q] for q in own), default=0) for t in held)
            fp = sum(p[k][q] * (1 - max((weight(t, q) for t in held), default=0)) for q in own)
            assert (found[k].n_valid, found[k].n_truth) == (len(own), len(held))
            assert found[k].score == pytest.approx(tp / (tp + 0.2 * fp + 0.8 * (len(held) - tp) + 1e-12))
    with pytest.raises(ValueError):
        metric.evaluate_discovery(predictions.where("fold < 2"), cells, 2)


def test_chains_of_tasks(spark):
    from gridloom.operators import audit

    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("d", "c"), ("c", "e")], "src string, dst string")
    found = {r.node: (r.before, r.after, r.critical) for r in audit.chains(edges).collect()}
    assert found == {"a": (0, 3, True), "b": (1, 2, True), "c": (2, 1, True), "d": (0, 2, False), "e": (3, 0, True)}
    with pytest.raises(ValueError):
        audit.chains(spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string"))


def test_thinning_does_not_depend_on_tiles(spark):
    rng = np.random.default_rng(7)
    mask = rng.random((40, 33)) < 0.75
    mask[5:30, 8:20] = True
    cells = spark.createDataFrame([(int(r), int(c)) for r, c in zip(*np.nonzero(mask))], "row int, col int")
    want = set(zip(*(x.tolist() for x in np.nonzero(geometry.thin(mask)))))
    for tile, halo in ((8, 4), (16, 2), (64, 8)):
        assert {(r.row, r.col) for r in geometry.thin_cells(cells, tile, halo).collect()} == want


def test_lineament_settings():
    assert stencils.lineament_settings({}) == {"kind": "phase_edge", "sigma": 1.0, "epsilon": 1.0, "window": 3.0, "wavelength": 8.0, "angles": 8}
    assert stencils.lineament_settings({"kind": "wavelet_entropy", "wavelet_levels": [1, 2], "ridge_valley_scales": [1, 2], "other": 1})["levels"] == (1, 2)
    for bad in ({"kind": "x"}, {"wavelet_levels": [7]}, {"wavelet_levels": []}, {"sigma_pixels": -1}, {"steerable_orientations": 0}, {"ridge_valley_scales": [0]}):
        with pytest.raises(ValueError):
            stencils.lineament_settings(bad)


def test_queue_states(spark):
    from gridloom.operators import audit

    def state(*rows, hours=1):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, started timestamp, done timestamp, failed timestamp, locked boolean, waiting boolean")
        return audit.queue_state(df, F.lit("2024-01-01 00:00:00").cast("timestamp") + F.expr(f"interval {hours} hours")).first().state

    import datetime

    t = datetime.datetime(2024, 1, 1)
    assert state((t, t, None, True, False)) == "ALL-DONE" and state((t, None, t, True, False)) == "STOPPED"
    assert state((t, None, None, True, False)) == "RUNNING" and state((t, None, None, True, True)) == "RUNNING-WAIT-MEM" and state((t, None, None, True, False), hours=60) == "RUNNING-STALLED"
    assert state((t, None, None, False, False)) == "INTERRUPTED" and state((None, None, None, False, False)) == "NOT-RUNNING"


def test_reports_are_written_whole(spark, tmp_path):
    import json

    from gridloom.sources import reports

    reports.write_json({"b": 1, "a": float("inf")}, str(tmp_path / "r.json"))
    assert (tmp_path / "r.json").read_text().startswith('{\n  "a"') and [p.name for p in tmp_path.iterdir()] == ["r.json"]
    cells = spark.createDataFrame([(0, 0, 1.0, True)], "row long, col long, v double, valid boolean")
    found = reports.signature(cells, 1, 1, "EPSG:32611", (100.0, float("nan")), nodata=float("-inf"))
    assert found["dtypes"] == ["double", "boolean"] and found["nodata"] == "-inf" and found["transform"] == [100.0, "nan"] and json.dumps(found)


def test_runs_and_files_are_recorded(spark, tmp_path):
    import hashlib
    import json

    from gridloom import functions
    from gridloom.operators import audit, provenance

    (tmp_path / "a b").mkdir()
    contents = {"x.bin": b"x" * 100, "a b/y.bin": b"", "a b/z.bin": bytes(range(256)) * 50}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    found = {r.path: (r.bytes, r.sha256) for r in audit.fingerprint(spark, f"file://{tmp_path}", chunk=64).collect()}
    assert sorted(found.values()) == sorted((len(x), hashlib.sha256(x).hexdigest()) for x in contents.values())
    record = provenance.run_manifest(spark, "r", {"b": 1, "a": 2}, f"file://{tmp_path}")
    assert record["config_sha256"] == provenance.run_manifest(spark, "r", {"a": 2, "b": 1}, f"file://{tmp_path}")["config_sha256"]
    assert len(record["artifacts"]["files"]) == 3 and record["application"]["id"] == spark.sparkContext.applicationId and json.dumps(record)
    assert all(callable(getattr(functions, name)) for name in functions.__all__)


def test_training_origins_sample_negatives(spark):
    """All positive tiles that are allowed enough and as many negatives as the ratio asks for, those of the least hashes."""
    rng = np.random.default_rng(2)
    rows, share, positive = [], {}, {}
    for tile in [(r, c) for r in range(0, 40, 4) for c in range(0, 20, 4)]:
        truth, allowed = rng.random((4, 4)) < 0.01 * (1 + 9 * (rng.random() < 0.3)), rng.random((4, 4)) < 0.9
        share[tile], positive[tile] = allowed.mean(), bool(truth.any())
        rows += [(*tile, bool(t), bool(a)) for t, a in zip(truth.ravel(), allowed.ravel())]
    tiles = spark.createDataFrame(rows, "row0 long, col0 long, truth boolean, allowed boolean")
    enough = sorted(t for t in share if share[t] >= 0.85)
    negatives = [t for t in enough if not positive[t]]
    for ratio in (0.0, 0.5, 1.0, 1e6):
        found = {(r.row0, r.col0): r.positive for r in tiling.training_origins(tiles, 4, ratio, 0.85, 11).collect()}
        own = [t for t in enough if positive[t]]
        n = min(len(negatives), int(ratio * len(own)))
        want = set(sorted(negatives, key=lambda t: hashlib.md5(f"11:{t[0]}:{t[1]}".encode()).hexdigest())[:n])
        assert {t for t, x in found.items() if x} == set(own) and {t for t, x in found.items() if not x} == want and len(own) > 3


def test_t_distribution():
    assert gate.student_t_cdf(0, 4) == pytest.approx(0.5)
    assert gate.student_t_cdf(2.776445105, 4) == pytest.approx(0.975, abs=1e-7)
    assert gate.student_t_cdf(12.706204736, 1) == pytest.approx(0.975, abs=1e-7)
    assert gate.student_t_cdf(3.182446305, 3) == pytest.approx(0.975, abs=1e-7)
    assert (gate.p_value(1, 0, 3), gate.p_value(-1, 0, 3), gate.p_value(0, 0, 3)) == (0, 1, 0.5)


def test_png_holds_the_preview(spark, tmp_path):
    import struct
    import zlib

    from gridloom.operators import provenance

    picture = spark.createDataFrame([(0, 0, 255, 0, 64), (1, 2, 0, None, 64)], "row int, col int, r int, g int, b int")
    provenance.png(picture, str(tmp_path / "p.png"))
    data = (tmp_path / "p.png").read_bytes()
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", data[16:24]) == (3, 2)
    at = data.index(b"IDAT")
    (n,) = struct.unpack(">I", data[at - 4 : at])
    lines = zlib.decompress(data[at + 4 : at + 4 + n])
    assert lines == bytes([0, 255, 0, 64] + [0] * 6) + bytes([0] * 7 + [0, 0, 64])


def test_ensemble_dispatch_refuses_what_does_not_fit(spark):
    import pytest

    from gridloom.operators import ensemble

    cells = spark.createDataFrame([("a", 0, 0, 0, 0.2), ("b", 0, 0, 0, 0.6)], "member string, fold int, row int, col int, p double")
    weights = lambda *w: spark.createDataFrame([(0, m, x) for m, x in zip("ab", w)], "fold int, member string, weight double")
    assert abs(ensemble.apply(cells, "mean").first()["p"] - 0.4) < 1e-6
    assert abs(ensemble.apply(cells, "weighted", weights(0.25, 0.75)).first()["p"] - 0.5) < 1e-12
    for bad in (weights(0.5, 0.6), weights(-0.5, 1.5), weights(1.0), None):
        with pytest.raises(ValueError):
            ensemble.apply(cells, "weighted", bad)
    with pytest.raises(ValueError):
        ensemble.apply(cells, "median")


def test_every_kind_has_a_halo():
    from gridloom.operators import stencils

    assert all(stencils.tile_halo(k) > 0 for k in stencils.KINDS)
    assert stencils.tile_halo("wavelet_entropy", 0.0, levels=(1, 2, 6)) == 32


def test_baseline_ties_with_itself_however_scores_are_summed(spark):
    import random

    drawn = F.udf(lambda v, f: random.random(), "double").asNondeterministic()
    scores = spark.range(15).select(F.element_at(F.array(*map(F.lit, "ABC")), (F.col("id") % 3 + 1).cast("int")).alias("variant"), F.floor(F.col("id") / 3).alias("fold"))
    found = {r.variant: r for r in gate.ablation_summary(scores.withColumn("score", drawn("variant", "fold")), "A").collect()}
    assert set(found) == set("ABC") and found["A"].delta == 0 and (found["A"].wins, found["A"].losses, found["A"].ties) == (0, 0, 5)


def test_best_predictions_of_all_candidates_share_a_row(spark):
    cells = spark.range(64).selectExpr("0 as fold", "id div 8 as row", "id % 8 as col", "id % 10 / 10 as p", "id % 13 = 0 as truth", "true as valid")
    both = cells.selectExpr("'a' as member", "fold", "row", "col", "p").union(cells.selectExpr("'b' as member", "fold", "row", "col", "1 - p as p"))
    out = ensemble.candidate_scores(both, cells, ["a", "b"])
    truths = [(r.row, r.col) for r in cells.where("truth").collect()]
    p = {(r.row, r.col): float(r.p) for r in cells.collect()}
    found = {r.candidate: r.score for r in out.collect()}
    for j, w in enumerate(ensemble.weight_candidates(["a", "b"])):
        mixed = {k: w["a"] * x + w["b"] * (1 - x) for k, x in p.items()}
        reach = lambda k, t: max(0.0, 1 - math.dist(k, t) / 3)
        tp = sum(max(reach(k, t) * x for k, x in mixed.items()) for t in truths)
        fp = sum(x * (1 - max(reach(k, t) for t in truths)) for k, x in mixed.items())
        assert found[j] == pytest.approx(tp / (tp + 0.2 * fp + 0.8 * (len(truths) - tp)), abs=1e-9)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Aggregate" in x and "from_row" in x and "candidate" in x for x in plan.splitlines())


def test_chains_broadcast_no_tasks(spark, monkeypatch):
    from functools import partial

    plans, write = [], audit_module().materialise

    def noted(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, label)

    monkeypatch.setattr(audit_module(), "materialise", partial(noted))
    monkeypatch.setattr(audit_module(), "ROUNDS", 3, raising=False)
    edges = spark.range(1, 9).selectExpr("id as src", "id div 2 as dst").union(spark.range(3, 9).selectExpr("id as src", "id div 3 as dst"))
    found = {r.node: (r.before, r.after) for r in audit_module().chains(edges).collect()}
    assert found == {0: (4, 0), 1: (3, 1), 2: (2, 2), 3: (1, 2), 4: (1, 3), 5: (0, 3), 6: (0, 3), 7: (0, 3), 8: (0, 4)}
    assert not [label for label, p in plans if "BroadcastHashJoin" in p]


def audit_module():
    from gridloom.operators import audit

    return audit
