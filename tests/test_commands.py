import pytest

from gridloom.operators import commands

MAPS = {"spatial": "m/s.tif", "fault": "m/f.tif", "trace": "m/t.tif"}
CASES = [
    ("q/train_folds.sh runs/ref-cv-spatial-b16 configs/ref.yaml spatial m/s.tif 16", []),
    ("q/train_folds.sh runs/cand-log-fault-b16 configs/candidates/cand_log.yaml fault m/f.tif 16 20261010", []),
    ("q/train_folds.sh runs/cand-log-fault-b16 configs/ref.yaml fault m/s.tif 32 2026", ["BAD-SEED", "BUFFER-SUFFIX-MISMATCH", "CONFIG-DIR-MISMATCH", "STALE-FOLD-MAP"]),
    ("q/train_folds.sh runs/ref-cv-spatial configs/ref.yaml spatial m/s.tif 0", ["BAD-BUFFER"]),
    ("q/train_folds.sh runs/ref-cv-spatial configs/ref.yaml", ["ARG-COUNT"]),
    ("q/score_view.sh runs/x odd m/s.tif elsewhere", ["BAD-SCHEME"]),
    ("q/score_view.sh runs/ref-cv-fault trace m/t.tif elsewhere", ["BAD-GATE-DIR", "SCHEME-DIR-MISMATCH"]),
    ('record.sh a runs/b configs/c.yaml "h y p" notes', ["RECORD-ID-MISMATCH"]),
    ('record.sh b runs/b configs/c.yaml \\"h y p\\" notes', ["ESCAPED-QUOTE"]),
    ("record.sh b 'open", ["ARG-PARSE-ERROR"]),
    ("gate.sh nonsense a b c d", ["BAD-GATE-NAME"]),
    ("gate.sh CAND-LOG-B16 runs/gate/ref-b16 runs/gate/cand-log-b16 configs/candidates/cand_log.yaml h", []),
    ("gate.sh CAND-LOG-B16 runs/gate/ref-b16 runs/gate/cand-log-b32 configs/ref.yaml h", ["CONFIG-DIR-MISMATCH", "GATE-DIR-MISMATCH"]),
    ("rival_threshold.sh runs/ref-cv-trace trace m/t.tif 1.5 -1", ["BAD-EXPECTED-SCORE", "BAD-EXPECTED-SCORE"]),
    ("compare_seed.sh runs/gate/a runs/gate/b other runs/c", ["BAD-GATE-DIR"]),
    ("curved_view.sh runs/ref-cv-fault runs/x fault && score_view.sh a", ["ARG-COUNT", "SCHEME-DIR-MISMATCH"]),
    ("mkdir -p a && cp b c", []),
    (None, []),
]


def test_findings(spark):
    tasks = spark.createDataFrame([(str(i), c) for i, (c, _) in enumerate(CASES)], "id string, cmd string")
    found = [[] for _ in CASES]
    for r in commands.command_findings(tasks, MAPS, "configs/ref.yaml").collect():
        found[int(r["id"])].append(r["kind"])
    assert [sorted(x) for x in found] == [want for _, want in CASES]
    assert {r["id"] for r in commands.unchecked(tasks).collect()} == {str(i) for i, (c, _) in enumerate(CASES) if c is None or "mkdir" in c or "open" in c}
    assert commands.command_findings(tasks.limit(0), MAPS).count() == 0
