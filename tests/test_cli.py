import json

import pytest

from gridloom import cli
from gridloom.operators import gate
from gridloom.sources import reports, tiff
from test_operators import report, table

import numpy as np


def test_score_and_write(spark, tmp_path, capsys):
    p, truth, valid = np.array([[0.2, 0.9], [0.0, 0.4]]), np.array([[False, True], [False, False]]), np.array([[True, True], [True, False]])
    cells = table(spark, p=p, truth=truth, valid=valid, fold=np.array([[0, 0], [1, 1]]))
    cells.write.parquet(f"{tmp_path}/cells")
    assert cli.main(["score", f"{tmp_path}/cells"]) == 0
    assert json.loads(capsys.readouterr().out)[0]["n_truth"] == 1
    assert cli.main(["write", f"{tmp_path}/cells", f"{tmp_path}/cells", f"{tmp_path}/out"]) == 0
    back = {(r.row, r.col): r.p for r in reports.fold_predictions(spark, f"{tmp_path}/out", [0, 1]).collect()}
    assert back[0, 1] == pytest.approx(0.9) and np.isnan(back[1, 1])
    with pytest.raises(ValueError):
        reports.fold_predictions(spark, f"{tmp_path}/out", [0, 7])


def test_verify_command(spark, tmp_path, capsys):
    for name, scores in (("old", [0.1, 0.11]), ("new", [0.3, 0.31])):
        (tmp_path / name).mkdir()
        for v in gate.VIEWS:
            (tmp_path / name / f"{v}.json").write_text(json.dumps(report(scores, v)))
    assert cli.main(["verify", f"{tmp_path}/old", f"{tmp_path}/new", f"file://{tmp_path}/ledger"]) == 1
    assert "REJECT" in capsys.readouterr().out and gate.count_trials(spark, f"file://{tmp_path}/ledger") == 1
    rows = reports.fold_scores(reports.score_reports(spark, f"file://{tmp_path}/old")).collect()
    assert len(rows) == 6


def test_queue(spark, tmp_path):
    (tmp_path / "tasks.json").write_text(json.dumps([{"id": "a", "step": 1, "cmd": "bash scripts/x.sh configs/a.yaml 'scripts/no.sh'", "note": "n"}, {"id": "b", "step": 2, "cmd": "true"}]))
    from gridloom.operators import audit

    tasks = reports.tasks(spark, f"file://{tmp_path}/tasks.json")
    assert [(r.ord, r.id) for r in tasks.orderBy("ord").collect()] == [(0, "a"), (1, "b")]
    assert {r.path for r in audit.references(tasks).collect()} == {"scripts/x.sh", "configs/a.yaml"}
    assert [r.id for r in audit.insert_tasks(tasks, [{"id": "c", "cmd": "x"}, {"id": "d", "cmd": "y"}], "b").orderBy("ord").collect()] == ["a", "c", "d", "b"]
    with pytest.raises(ValueError):
        audit.insert_tasks(tasks, [{"id": "a", "cmd": "x"}], "b")


def test_table_commands(spark, tmp_path, capsys):
    rng = np.random.default_rng(0)
    shape = (12, 10)
    truth = rng.random(shape) < 0.2
    fold = np.indices(shape)[1] // 5
    table(spark, p=rng.random(shape), truth=truth, valid=np.ones(shape, bool), fold=fold).write.parquet(f"{tmp_path}/cells")
    cells = spark.read.parquet(f"{tmp_path}/cells")
    faults = cells.selectExpr("row", "col", "p", "valid", "truth", "case when truth then fold else -1 end as fold", "fold = 0 as fit", "fold = 1 as evaluate")
    faults.write.parquet(f"{tmp_path}/faults")
    cells.selectExpr("explode(array(0L, 1L)) as fold", "row", "col", "p").write.parquet(f"{tmp_path}/predictions")
    cells.selectExpr("explode(array('a', 'b')) as member", "fold", "row", "col", "p").write.parquet(f"{tmp_path}/members")
    spark.createDataFrame([("a", "b", "train"), ("b", "c", "train")], "src string, dst string, kind string").write.parquet(f"{tmp_path}/edges")
    scores = [(v, r, k, 0.1 * k + (0.3 if r == "new" else 0) + 0.01 * k * (r == "new")) for v in "xy" for r in ("old", "new") for k in range(4)]
    spark.createDataFrame(scores, "view string, run string, fold int, score double").write.parquet(f"{tmp_path}/scores")

    def run(*args):
        assert cli.main([args[0], *(f"{tmp_path}/{a}" if (tmp_path / a).exists() else a for a in args[1:])]) == 0
        return json.loads(capsys.readouterr().out)

    assert run("optimum", "cells")[0]["method"] == "exact"
    assert {r["fold"] for r in run("lofo-stitched", "cells")} == {0, 1} and len(run("own-fold", "cells")) == 2
    assert 0 <= run("calibrate", "faults")[0]["evaluation_score"] <= 1
    assert [set(r) >= {"rival", "lofo", "delta"} for r in run("rival", "cells", "0.5")] == [True, True]
    assert {r["fold"] for r in run("discovery", "predictions", "faults", "1")} == {r["fold"] for r in run("trace", "predictions", "faults", "1")} == {0, 1}
    assert len(run("weights", "members", "cells")) == 2 and run("align", "members") == []
    assert run("bands", "cells", "p")[0]["n"] == 120 and len(run("thin", "cells")) <= truth.sum()
    assert run("blocks", "cells")[0]["blocks"] == 1
    assert {r["node"]: r["before"] for r in run("chains", "edges")} == {"a": 0, "b": 1, "c": 2} and len(run("feeders", "edges")) == 3
    assert all(r["p"] < 0.01 for r in run("paired", "scores", "old", "new")) and run("decide", "scores", "old", "new", "0")[0]["accepted"] is True


def test_queue_and_result_commands(spark, tmp_path, capsys):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")

    put("tasks", [(0, "s1-score-a", "scripts/score_view.sh r spatial x g"), (1, "s1-train-a", "scripts/train_folds.sh r")], "idx long, id string, cmd string")
    put("decisions", [("d", "gate:g/spatial")], "decision string, artifact string")
    put("needs", [("s1-score-a", "pred:r")], "id string, artifact string")
    put("makes", [(0, "s1-score-a", "gate:g/spatial"), (1, "s1-train-a", "pred:r")], "idx long, id string, artifact string")
    put("present", [("x", "x", "x")], "artifact string, folder string, view string")
    put("done", [("none",)], "id string")
    put("gates", [("G", "g", "g")], "name string, incumbent_dir string, candidate_dir string")
    put("reports", [("Z", "ACCEPT", 0, 1.0)], "name string, verdict string, trials_before int, escalation_multiplier double")
    put("files", [("g", "fault", 0)], "folder string, view string, errors int")
    put("events", [("r", "start", "2024-01-01 00:00:00")], "run string, event string, t string")
    spark.read.parquet(f"{tmp_path}/events").selectExpr("run", "event", "cast(t as timestamp) as ts").write.parquet(f"{tmp_path}/timed")
    (tmp_path / "t.tif").write_bytes(tiff.encode(np.ones((1, 2, 3), np.float32), np.nan))
    put("cells", [(r, c, 0.5) for r in range(2) for c in range(3)], "row long, col long, p double")

    def run(*args):
        assert cli.main([args[0], *(f"{tmp_path}/{a}" if (tmp_path / a).exists() else a for a in args[1:])]) == 0
        return json.loads(capsys.readouterr().out)

    assert {r["artifact"] for r in run("order-audit", "tasks")} == {"triple:s1-a", "pred:r"}
    assert [r["id"] for r in sorted(run("resume", "tasks", "decisions", "needs", "makes", "present", "done"), key=lambda r: r["place"])] == ["s1-score-a", "s1-train-a"]
    assert run("inputs", "decisions", "makes", "present", "done")[0]["producers"] == 1
    assert {(r["name"], r["status"]) for r in run("gate-status", "gates", "reports", "present")} == {("G", "PENDING"), ("Z", "ORPHAN")}
    assert [r["status"] for r in run("readiness", "gates", "reports", "files", "makes")].count("VALID") == 2
    assert run("states", "timed", "2024-01-09")[0]["state"] == "RUNNING-STALLED"
    assert run("signature", "t.tif")["width"] == 3
    assert run("write-like", "cells", "t.tif", f"{tmp_path}/out")["written"].endswith("out") and run("signature", "out")["height"] == 2
