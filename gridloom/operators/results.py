"""Committed results as tables and what does not follow in them: raw scores, manifests and gate reports; and which gates are decided or ready."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.gate import METRIC
from gridloom.operators.queue import VIEWS

# Number of folds, tolerances of means and of arithmetic, verdicts.
FOLDS, MEANS, ARITHMETIC = 5, 1e-6, 1e-9
VERDICTS = ("ACCEPT", "REJECT", "INCONCLUSIVE")


def _far(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) > tolerance * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))


def _listed(rows: DataFrame, subject: Column, checks: list[tuple[str, str, Column]]) -> DataFrame:
    """severity, code, subject: a row for each check (severity, code, wrong) that a row of the table fails; one scan for all."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(wrong, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"))) for severity, code, wrong in checks]))
    return rows.select(subject.alias("subject"), F.explode(found).alias("x")).select("x.severity", "x.code", "subject")


def raw_score_findings(tops: DataFrame, folds: DataFrame) -> DataFrame:
    """severity, code, subject of raw score reports: fold scores outside 0..1 or absent, fold ids other than 0 to 4, means and deviations that their folds do not give,
    aggregates outside 0..1, another protocol.

    ``tops``: run, scheme, macro_mean, macro_std, aggregate_score, alpha, beta, metric (null where not recorded). ``folds``: run, scheme, fold, score.
    """
    each = folds.groupBy("run", "scheme").agg(
        F.count_if(F.col("score").isNull() | F.isnan("score")).alias("missing"), F.count_if((F.col("score") < 0) | (F.col("score") > 1)).alias("outside"),
        F.sort_array(F.collect_set("fold")).alias("ids"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"),
    )
    both = tops.join(each, ["run", "scheme"], "left")
    ids = F.array(*[F.lit(i) for i in range(FOLDS)])
    outside = lambda c: (F.col(c) < 0) | (F.col(c) > 1) | F.isnan(c)
    other = [F.col(k).isNotNull() & (F.col(k) != F.lit(METRIC[k])) for k in ("alpha", "beta", "metric")]
    return _listed(both, F.concat_ws("/", "run", "scheme"), [
        ("error", "NO_FOLDS", F.col("ids").isNull()), ("error", "FOLD_SCORE_MISSING", F.col("missing") > 0), ("error", "FOLD_SCORE_RANGE", F.col("outside") > 0),
        ("error", "FOLD_IDS", F.col("ids").isNotNull() & (F.transform("ids", lambda x: x.cast("int")) != ids)),
        ("error", "MACRO_MEAN", _far(F.col("macro_mean"), F.col("mean"), MEANS)), ("error", "MACRO_STD", _far(F.col("macro_std"), F.col("std"), MEANS)),
        ("error", "AGGREGATE_RANGE", outside("aggregate_score")), ("error", "PROTOCOL", other[0] | other[1] | other[2]),
    ])


def manifest_findings(artifacts: DataFrame, files: DataFrame, runs: DataFrame) -> DataFrame:
    """severity, code, subject of run manifests: other bytes or hashes than recorded, contents that lie elsewhere in the run, what is missing.

    ``artifacts``: run, path, bytes, sha256 as recorded. ``files``: run, path, bytes, sha256 as they are. ``runs``: run of every result folder;
    those without an artifact have no manifest. Of files that moved, the name must have stayed.
    """
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    own = files.select("path", F.col("bytes").alias("now"), F.col("sha256").alias("hash"))
    moved = files.select("run", name(F.col("path")).alias("name"), F.col("sha256")).distinct().withColumn("moved", F.lit(True))
    both = artifacts.join(own, "path", "left").withColumn("name", name(F.col("path"))).join(moved, ["run", "name", "sha256"], "left")
    gone = F.col("now").isNull()
    found = _listed(both, F.concat_ws(":", "run", "path"), [
        ("error", "SIZE", F.col("now") != F.col("bytes")), ("error", "SHA256", (F.col("now") == F.col("bytes")) & (F.col("hash") != F.col("sha256"))),
        ("finding", "RELOCATED", gone & F.col("moved")), ("finding", "MISSING_ARTIFACT", gone & F.col("moved").isNull()),
    ])
    bare = runs.select("run").distinct().join(artifacts.select("run").distinct(), "run", "left_anti")
    return found.union(bare.select(F.lit("finding"), F.lit("MISSING_MANIFEST"), F.col("run").cast("string")))


def gate_findings(reports: DataFrame, views: DataFrame) -> DataFrame:
    """severity, code, subject of gate reports whose numbers do not follow from each other.

    ``reports``: name, verdict, trials_before, escalation_multiplier. ``views``: name, view, comparable, candidate_mean, candidate_std, incumbent_mean, incumbent_std, delta,
    required_margin, won. Views that are not comparable are passed over.
    """
    won = views.groupBy("name").agg(F.count(F.lit(1)).alias("views"), F.count_if(F.col("comparable") & F.col("won")).alias("won_views"))
    top = reports.join(won, "name", "left")
    verdict, factor = F.col("verdict"), F.col("escalation_multiplier")
    whole = _listed(top, F.col("name").cast("string"), [
        ("error", "VERDICT", verdict.isNull() | ~verdict.isin(*VERDICTS)), ("error", "MULTIPLIER", _far(factor, 1 + 0.5 * F.log2(1 + F.col("trials_before")), ARITHMETIC)),
        ("error", "NO_VIEWS", F.col("views").isNull()), ("error", "REJECT_BUT_WON", (verdict == "REJECT") & (F.col("won_views") > 0)),
    ])
    numbers = [F.col(c) for c in ("candidate_mean", "incumbent_mean", "delta", "required_margin", "candidate_std", "incumbent_std")]
    absent = numbers[0].isNull()
    for n in numbers[1:]:
        absent = absent | n.isNull()
    own = views.where("comparable").join(reports.select("name", "escalation_multiplier"), "name")
    delta, margin = F.col("delta"), F.col("required_margin")
    parts = _listed(own, F.concat_ws("/", F.col("name").cast("string"), "view"), [
        ("error", "FIELDS", absent), ("error", "DELTA", ~absent & _far(delta, F.col("candidate_mean") - F.col("incumbent_mean"), ARITHMETIC)),
        ("error", "MARGIN", ~absent & _far(margin, F.greatest("candidate_std", "incumbent_std") * factor, ARITHMETIC)), ("error", "WON", ~absent & (F.coalesce("won", F.lit(False)) != (delta > margin))),
    ])
    return whole.union(parts)


def gate_status(gates: DataFrame, reports: DataFrame, present: DataFrame) -> DataFrame:
    """name, status, detail: DECIDED with its verdict, BROKEN with an unknown one, or PENDING with the candidate's views that are there; and ORPHAN for reports without a gate.

    ``gates``: name, candidate_dir. ``reports``: name, verdict. ``present``: folder, view.
    """
    there = present.where(F.col("view").isin(*VIEWS)).groupBy(F.col("folder").alias("candidate_dir")).agg(F.collect_set("view").alias("views"))
    shown = F.array_join(F.filter(F.array(*map(F.lit, VIEWS)), lambda v: F.array_contains("views", v)), ", ")
    both = gates.join(reports.withColumn("reported", F.lit(True)), "name", "left").join(there, "candidate_dir", "left")
    known = F.col("verdict").isin(*VERDICTS)
    status = F.when(F.col("reported") & F.coalesce(known, F.lit(False)), "DECIDED").when(F.col("reported"), "BROKEN").otherwise("PENDING")
    detail = F.when(F.col("reported"), F.coalesce("verdict", F.lit("none"))).otherwise(F.coalesce(shown, F.lit("")))
    orphans = reports.join(gates.select("name"), "name", "left_anti").select("name", F.lit("ORPHAN").alias("status"), F.coalesce("verdict", F.lit("none")).alias("detail"))
    return both.select("name", status.alias("status"), detail.alias("detail")).union(orphans)


def gate_readiness(gates: DataFrame, reports: DataFrame, files: DataFrame, makes: DataFrame) -> DataFrame:
    """name, side, view, status, producers of the six inputs of every gate without a verdict: VALID, INVALID (its report has errors) or MISSING, with the tasks that would make it.

    ``gates``: name, incumbent_dir, candidate_dir. ``files``: folder, view, errors (their number). ``makes``: idx, id, artifact as ``queue.produced`` gives them.
    """
    open_ = gates.join(reports.where(F.col("verdict").isin(*VERDICTS)).select("name").distinct(), "name", "left_anti")
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_dir").alias("folder"), F.lit(v).alias("view")) for s in ("incumbent", "candidate") for v in VIEWS])
    wants = open_.select("name", F.explode(sides).alias("x")).select("name", "x.*")
    made = makes.groupBy("artifact").agg(F.count_distinct("id").alias("n"))
    both = wants.join(files.select("folder", "view", "errors"), ["folder", "view"], "left").withColumn("artifact", F.concat(F.lit("gate:"), F.col("folder"), F.lit("/"), F.col("view"))).join(made, "artifact", "left")
    status = F.when(F.col("errors").isNull(), "MISSING").when(F.col("errors") > 0, "INVALID").otherwise("VALID")
    return both.select("name", "side", "view", status.alias("status"), F.when(status == "MISSING", F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).alias("producers"))


def audit_results(tops: DataFrame, folds: DataFrame, artifacts: DataFrame, files: DataFrame, runs: DataFrame, reports: DataFrame, views: DataFrame, earlier: DataFrame) -> DataFrame:
    """severity, code, subject, detail of all checks of committed results as one table: raw scores, manifests, gates, and ``earlier``, the findings of ``audit.result_findings``."""
    own = raw_score_findings(tops, folds).union(manifest_findings(artifacts, files, runs)).union(gate_findings(reports, views))
    return own.withColumn("detail", F.lit(None).cast("string")).union(earlier.select("severity", "code", "subject", "detail"))


def fails(findings: DataFrame) -> bool:
    """Whether an audit fails: one error is enough, findings and warnings are not."""
    return not findings.where("severity = 'error'").isEmpty()
