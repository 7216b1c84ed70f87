"""Command line: python -m gridloom.cli COMMAND ...; tables are Parquet cells, reports JSON."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridloom.operators import audit, calibration, commands, components, ensemble, geometry, gate, masks, metric, provenance, queue, results, threshold
from gridloom.sources import raster, reports
from gridloom.streaming import states


def _rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


#: Commands that print the rows of a table made of one or more Parquet tables, and from numbers after them.
TABLES = {
    "optimum": (["cells"], lambda t: threshold.optimal_threshold(t[0])),
    "lofo-stitched": (["cells"], lambda t: calibration.lofo_stitched(t[0])),
    "own-fold": (["cells"], lambda t: calibration.own_fold_thresholds(t[0])),
    "calibrate": (["cells"], lambda t: calibration.fit_and_evaluate(t[0])),
    "rival": (["cells", "expected"], lambda t, expected: calibration.rival_scores(t[0], calibration.rival_threshold(float(expected)), threshold.lofo_thresholds(threshold.threshold_curve(t[0], ["fold"])))),
    "discovery": (["predictions", "cells", "exclusion"], lambda t, exclusion: metric.evaluate_discovery(t[0], t[1], float(exclusion))),
    "trace": (["predictions", "cells", "exclusion"], lambda t, exclusion: metric.evaluate_discovery(t[0], t[1], float(exclusion), True)),
    "weights": (["members", "cells"], lambda t: ensemble.lofo_weights(ensemble.candidate_scores(t[0], t[1], sorted(r[0] for r in t[0].select("member").distinct().collect())))),
    "align": (["members"], lambda t: ensemble.alignment_errors(t[0])),
    "bands": (["cells", "names"], lambda t, names: audit.band_statistics(t[0], names.split(","))),
    "thin": (["cells"], lambda t: geometry.thin_cells(t[0].where("truth"))),
    "blocks": (["cells"], lambda t: components.block_quantiles(components.block_report(t[0]))),
    "paired": (["scores", "incumbent", "candidate"], lambda t, incumbent, candidate: gate.paired_gate(t[0], ["view"], incumbent, candidate)),
    "decide": (["scores", "incumbent", "candidate", "trials"], lambda t, incumbent, candidate, trials: gate.evaluate_candidate(t[0], incumbent, candidate, int(trials))),
    "ablation": (["scores", "baseline"], lambda t, baseline: gate.ablation_summary(t[0], baseline)),
    "chains": (["edges"], lambda t: audit.chains(t[0])),
    "feeders": (["edges"], lambda t: audit.feeders(t[0])),
    "drift": (["runs"], lambda t: audit.config_drift(t[0])),
    "orphans": (["ledger", "gates"], lambda t: audit.ledger_orphans(t[0], t[1])),
    "sync": (["queue", "checkout"], lambda t: audit.sync(t[0], t[1])),
    "stages": (["events"], lambda t: audit.furthest_stage(t[0])),
    "states": (["events", "now"], lambda t, now: states.run_states(t[0], F.lit(now).cast("timestamp"))),
    "shifts": (["cells"], lambda t: metric.shift_sensitivity(t[0])),
    "continue": (["cells", "threshold"], lambda t, threshold: geometry.curved_continuation(t[0].select("row", "col", "p", "valid"), float(threshold))[1]),
    "order-audit": (["tasks"], lambda t: queue.order_audit(t[0])),
    "inputs": (["decisions", "makes", "present", "done"], lambda t: queue.decision_inputs(*t)),
    "resume": (["tasks", "decisions", "needs", "makes", "present", "done"], lambda t: queue.resume_order(*t)),
    "gate-status": (["gates", "reports", "present"], lambda t: results.gate_status(*t)),
    "readiness": (["gates", "reports", "files", "makes"], lambda t: results.gate_readiness(*t)),
    "raw-findings": (["tops", "folds"], lambda t: results.raw_score_findings(*t)),
    "manifest-findings": (["artifacts", "files", "runs"], lambda t: results.manifest_findings(*t)),
    "gate-findings": (["reports", "views"], lambda t: results.gate_findings(*t)),
}
IS_TABLE = {"cells", "predictions", "members", "scores", "edges", "runs", "ledger", "gates", "queue", "checkout", "events", "tasks", "decisions", "needs", "makes", "present", "done", "reports", "files", "tops", "folds", "artifacts", "views"}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gridloom")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, *args in (
        ("score", "cells"), ("score-folds", "cells"), ("curve", "cells"), ("lofo", "cells"), ("profile", "cells"), ("fingerprint", "path"), ("order", "consumers", "producers"),
        ("verify", "incumbent", "candidate", "ledger"), ("spatial-masks", "cells", "buffer", "out"), ("write", "cells", "template", "out"), ("references", "queue"), ("arguments", "queue", "maps"), ("preview", "cells", "stride", "out"), ("signature", "raster"), ("write-like", "cells", "template", "out"),
    ):
        p = sub.add_parser(name)
        for a in args:
            p.add_argument(a)
    for name, (given, _) in TABLES.items():
        p = sub.add_parser(name)
        for a in given:
            p.add_argument(a)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("gridloom").getOrCreate()
    cells = spark.read.parquet(args.cells) if hasattr(args, "cells") else None
    out: object
    if args.command in TABLES:
        given, run = TABLES[args.command]
        tables = [spark.read.parquet(getattr(args, a)) for a in given if a in IS_TABLE]
        out = _rows(run(tables, *[getattr(args, a) for a in given if a not in IS_TABLE]))
    elif args.command == "score":
        out = _rows(metric.tversky(cells))
    elif args.command == "score-folds":
        folds = metric.tversky(cells, ["fold"])
        out = {"folds": _rows(folds), "macro": _rows(metric.macro(folds)), "pooled": _rows(metric.tversky(cells))}
    elif args.command == "curve":
        out = _rows(threshold.best_threshold(threshold.threshold_curve(cells)))
    elif args.command == "lofo":
        out = _rows(threshold.lofo_thresholds(threshold.threshold_curve(cells, ["fold"])))
    elif args.command == "profile":
        labelled = components.label(cells.where("truth and valid"))
        report, largest = components.component_report(labelled, cells.where("valid").count())
        out = {"report": _rows(report), "largest": _rows(largest), "blocks": _rows(components.block_report(cells))}
    elif args.command == "fingerprint":
        files = _rows(audit.fingerprint(spark, args.path))
        out = {"files": files, "sha256": audit.manifest_hash(files)}
    elif args.command == "order":
        out = _rows(audit.order_violations(spark.read.parquet(args.consumers), spark.read.parquet(args.producers)))
    elif args.command == "verify":
        load = lambda d: {v: json.loads(p.read_text()) for v in gate.VIEWS if (p := Path(d) / f"{v}.json").exists()}
        out = gate.verify(Path(args.candidate).name, load(args.incumbent), load(args.candidate), gate.count_trials(spark, args.ledger))
        gate.record(spark, args.ledger, out, provenance.datetime.now(provenance.UTC).isoformat())
        print(provenance.verdict_text(out))
        return 0 if out["verdict"] == "ACCEPT" else 1
    elif args.command == "spatial-masks":
        masks.spatial_masks(cells, float(args.buffer)).write.mode("overwrite").partitionBy("fold").parquet(args.out)
        out = {"written": args.out}
    elif args.command == "write":
        reports.write_predictions(cells, spark.read.parquet(args.template), args.out)
        out = {"written": args.out}
    elif args.command == "signature":
        out = raster.raster_signature(raster.members(args.raster)[1][0]["uri"])
    elif args.command == "write-like":
        raster.write_prediction(cells, args.template, args.out)
        out = {"written": args.out}
    elif args.command == "preview":
        provenance.png(provenance.preview(cells, int(args.stride)), args.out)
        out = {"written": args.out}
    elif args.command == "arguments":
        tasks = reports.tasks(spark, args.queue)
        out = {"findings": _rows(commands.command_findings(tasks, json.loads(Path(args.maps).read_text()))), "unchecked": _rows(commands.unchecked(tasks))}
        print(json.dumps(out, indent=2, sort_keys=True))
        return 1 if out["findings"] else 0
    else:
        out = _rows(audit.references(reports.tasks(spark, args.queue)))
    print(json.dumps(out, indent=2, sort_keys=True, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
