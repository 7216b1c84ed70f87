"""Audits of results and of a feature stack on small cases worked out by hand."""

import hashlib
import json

import numpy as np
import pytest

from gridloom.operators import bands, results
from gridloom.sources import raster, tiff


def listed(df):
    return {(r.severity, r.code, r.subject) for r in df.collect()}


def raw(spark, *runs):
    """(run, scores by fold, mean, std, aggregate, alpha, metric)"""
    folds = spark.createDataFrame([(r[0], "spatial", k, s) for r in runs for k, s in r[1].items()] or [("-", "-", 0, 0.0)], "run string, scheme string, fold int, score double")
    tops = spark.createDataFrame([(r[0], "spatial", *r[2:5], r[5], None, r[6]) for r in runs], "run string, scheme string, macro_mean double, macro_std double, aggregate_score double, alpha double, beta double, metric string")
    return tops, folds


def test_raw_scores(spark):
    good = {k: s for k, s in enumerate([0.10, 0.11, 0.09, 0.12, 0.10])}
    mean, std = float(np.mean(list(good.values()))), float(np.std(list(good.values())))
    tops, folds = raw(
        spark, ("ok", good, mean, std, 0.1, 0.2, "distance_weighted_tversky"), ("bare", good, None, None, None, None, None), ("mean", good, mean + 1e-3, std, 0.1, 0.2, None), ("std", good, mean, std * 1.2247, 1.2, 0.3, None),
        ("ids", {k: 0.1 for k in range(4)}, 0.1, 0.0, None, None, None), ("range", good | {2: 1.5}, None, None, None, None, "f1"), ("gap", good | {1: None}, None, None, float("nan"), None, None), ("none", {}, None, None, None, None, None),
    )
    assert listed(results.raw_score_findings(tops, folds)) == {("error", c, f"{r}/spatial") for r, c in (("mean", "MACRO_MEAN"), ("std", "MACRO_STD"), ("std", "AGGREGATE_RANGE"), ("std", "PROTOCOL"), ("ids", "FOLD_IDS"), ("range", "FOLD_SCORE_RANGE"), ("range", "PROTOCOL"), ("gap", "FOLD_SCORE_MISSING"), ("gap", "AGGREGATE_RANGE"), ("none", "NO_FOLDS"))}


def test_manifests(spark):
    old = spark.createDataFrame([("a", "runs/a/x.json", 3, "h1"), ("a", "runs/a/y.json", 3, "h2"), ("a", "runs/a/z.json", 3, "h3"), ("a", "runs/a/u.json", 3, "h4"), ("a", "runs/a/v.json", 3, "h5")], "run string, path string, bytes long, sha256 string")
    now = spark.createDataFrame([("a", "runs/a/x.json", 3, "h1"), ("a", "runs/a/y.json", 4, "h2"), ("a", "runs/a/z.json", 3, "other"), ("a", "runs/a/scores/u.json", 3, "h4"), ("b", "runs/b/v.json", 3, "h5")], "run string, path string, bytes long, sha256 string")
    runs = spark.createDataFrame([("a",), ("b",)], "run string")
    want = {("error", "SIZE", "a:runs/a/y.json"), ("error", "SHA256", "a:runs/a/z.json"), ("finding", "RELOCATED", "a:runs/a/u.json"), ("finding", "MISSING_ARTIFACT", "a:runs/a/v.json"), ("finding", "MISSING_MANIFEST", "b")}
    assert listed(results.manifest_findings(old, now, runs)) == want


VIEW = "name string, view string, comparable boolean, candidate_mean double, candidate_std double, incumbent_mean double, incumbent_std double, delta double, required_margin double, won boolean"


def gate_tables(spark):
    reports = spark.createDataFrame([("ok", "ACCEPT", 3, 2.0), ("verdict", "MAYBE", 0, 1.0), ("factor", "INCONCLUSIVE", 1, 1.4), ("reject", "REJECT", 0, 1.0), ("empty", "REJECT", 0, None)], "name string, verdict string, trials_before int, escalation_multiplier double")
    views = spark.createDataFrame([
        ("ok", "spatial", True, 0.3, 0.02, 0.2, 0.01, 0.1, 0.04, True), ("ok", "fault", False, None, None, None, None, None, None, None), ("verdict", "spatial", True, 0.3, 0.02, 0.2, 0.01, 0.2, 0.02, True),
        ("factor", "spatial", True, 0.3, 0.02, 0.3, 0.01, 0.0, 0.028, False), ("reject", "spatial", True, 0.3, 0.02, 0.2, 0.03, 0.1, 0.05, True), ("reject", "fault", True, 0.3, 0.02, 0.2, 0.03, 0.1, 0.03, False), ("reject", "trace", True, None, 0.0, 0.2, 0.03, 0.1, 0.03, False),
    ], VIEW)
    return reports, views


def test_gates(spark):
    want = {("VERDICT", "verdict"), ("DELTA", "verdict/spatial"), ("MULTIPLIER", "factor"), ("REJECT_BUT_WON", "reject"), ("MARGIN", "reject/spatial"), ("WON", "reject/fault"), ("FIELDS", "reject/trace"), ("NO_VIEWS", "empty")}
    assert listed(results.gate_findings(*gate_tables(spark))) == {("error", *w) for w in want}


def test_one_error_fails_the_audit(spark):
    tops, folds = raw(spark, ("r", {k: 0.1 for k in range(5)}, 0.1, 0.0, None, None, None))
    files = spark.createDataFrame([("r", "p", 1, "h")], "run string, path string, bytes long, sha256 string")
    runs, earlier = spark.createDataFrame([("r",), ("bare",)], "run string"), spark.createDataFrame([("finding", "ORPHAN", "x", "d")], "severity string, code string, subject string, detail string")
    reports, views = gate_tables(spark)
    fine = results.audit_results(tops, folds, files, files, runs, reports.where("name = 'ok'"), views.where("name = 'ok'"), earlier)
    assert {r.code for r in fine.collect()} == {"MISSING_MANIFEST", "ORPHAN"} and not results.fails(fine)
    assert results.fails(results.audit_results(tops, folds, files, files, runs, reports, views, earlier))


def test_status_and_readiness(spark):
    gates = spark.createDataFrame([("A", "i", "c"), ("B", "i", "d"), ("C", "i", "e")], "name string, incumbent_dir string, candidate_dir string")
    reports = spark.createDataFrame([("A", "REJECT"), ("B", None), ("Z", "ACCEPT")], "name string, verdict string")
    present = spark.createDataFrame([("e", "trace", 0), ("e", "spatial", 1), ("i", "fault", 0), ("e", "notes", 0)], "folder string, view string, errors int")
    assert {tuple(r) for r in results.gate_status(gates, reports, present).collect()} == {("A", "DECIDED", "REJECT"), ("B", "BROKEN", "none"), ("C", "PENDING", "spatial, trace"), ("Z", "ORPHAN", "ACCEPT")}
    makes = spark.createDataFrame([(0, "t0", "gate:d/fault"), (1, "t1", "gate:d/fault"), (2, "t2", "gate:i/fault")], "idx long, id string, artifact string")
    found = {(r.name, r.side, r.view): (r.status, r.producers) for r in results.gate_readiness(gates, reports, present, makes).collect()}
    assert len(found) == 12 and found["C", "candidate", "trace"] == ("VALID", 0) and found["C", "candidate", "spatial"] == ("INVALID", 0) and found["C", "candidate", "fault"] == ("MISSING", 0)
    assert found["B", "candidate", "fault"] == ("MISSING", 2) and found["B", "incumbent", "fault"] == ("VALID", 0)


@pytest.fixture
def organised(tmp_path):
    """A stack of three files with its manifest; bands of 8 by 8 cells, one of them nodata."""
    stack = bands.Stack("f.tif", "l.tif", "t.tif", ("x", "y"), roles={"base": ("x",)})
    geo = ((100.0, 100.0), (0.0, 0.0, 0.0, 300000.0, 4400000.0, 0.0), 32611)
    features = np.arange(128, dtype=np.float32).reshape(2, 8, 8)
    features[:, 0, 0] = -3e38
    labels, template = np.zeros((1, 8, 8), np.int8), np.full((1, 8, 8), 0.5, np.float32)
    labels[0, 4, 4], labels[0, 0, 0], template[0, 0, 0] = 1, -1, np.nan
    (tmp_path / "f.tif").write_bytes(tiff.encode(features, -3e38, *geo, tags=[{"band_name": "x", "units": "nT"}, {"band_name": "y"}]))
    (tmp_path / "l.tif").write_bytes(tiff.encode(labels, -1.0, *geo))
    (tmp_path / "t.tif").write_bytes(tiff.encode(template, np.nan, *geo))

    def manifest():
        files = [{"path": n, "bytes": (tmp_path / n).stat().st_size, "sha256": hashlib.sha256((tmp_path / n).read_bytes()).hexdigest(), "raster": raster.raster_signature(str(tmp_path / n))} for n in stack.files]
        own = {"files": files}
        return own | {"manifest_sha256": hashlib.sha256(json.dumps(own, sort_keys=True, separators=(",", ":")).encode()).hexdigest()}

    return stack, tmp_path, manifest, geo, features, labels


def test_statuses_of_the_band_audit(spark, organised):
    stack, folder, manifest, geo, features, labels = organised
    own = manifest()
    report = bands.build_report(spark, own, stack)
    assert report["status"] == "METADATA_ONLY" and [(b["role"], b["unit_verification"]) for b in report["bands"]] == [("base", "NOT_VERIFIED"), ("other_covariate", "NOT_REPORTED")]
    assert bands.build_report(spark, own | {"manifest_sha256": "0"}, stack)["status"] == "MANIFEST_FAILURE"
    whole = bands.build_report(spark, own, stack, str(folder))
    assert whole["status"] == "PASS" and whole["live"]["masks"]["feature_valid"] == 63 and whole["live"]["bands"][0]["coverage"] == 1.0 and whole["live"]["warnings"] == []
    assert bands.build_report(spark, own, stack, str(folder), verify_hashes=False)["status"] == "UNVERIFIED_HASHES"
    labels[0, 1, 1], labels[0, 0, 0] = 2, 1  # another value, and a fault outside the features
    (folder / "l.tif").write_bytes(tiff.encode(labels, -1.0, *geo))
    changed = bands.build_report(spark, own, stack, str(folder))
    assert changed["status"] == "FAIL" and any("sha256" in e for e in changed["live"]["errors"]) and "stack: LABEL_VALUES" in changed["live"]["errors"]
    assert {"stack: FEATURE_LABEL_MASKS", "stack: LABEL_TEMPLATE_MASKS", "stack: FAULTS_OUTSIDE_FEATURES"} <= set(changed["live"]["warnings"])
    features[1, 2:] = -3e38
    (folder / "f.tif").write_bytes(tiff.encode(features, -3e38, *geo, tags=[{"band_name": "x"}, {"band_name": "y"}]))
    assert "b2: BAND_INCOMPLETE" in bands.live_report(spark, manifest(), stack, str(folder))["warnings"]
    (folder / "l.tif").write_bytes(tiff.encode(labels[:, :4], -1.0, *geo))
    skipped = bands.live_report(spark, manifest(), stack, str(folder))
    assert skipped["status"] == "FAIL" and skipped["scan_skipped"] == ["grids differ"]
    with pytest.raises(ValueError, match="lacks"):
        bands.manifest_report({"files": own["files"][:2]}, stack)
    with pytest.raises(ValueError, match="by hand"):
        bands.live_report(spark, own | {"snapshot_description": "x"}, stack, str(folder))
