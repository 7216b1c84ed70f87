"""Fingerprints, result audits and the experiment queue as tables."""

from __future__ import annotations

import hashlib
import json
import shlex
from fnmatch import fnmatch
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators.grid import materialise
from gridloom.operators.order import exact_quantiles, ranked


def fingerprint(spark: SparkSession, path: str, pattern: str = "*", chunk: int = 8 << 20) -> DataFrame:
    """path, bytes, sha256 of every file below ``path``, sorted by path.

    Files are listed on the driver and read where a task runs, ``chunk`` bytes at a time, so they may be of any size, empty ones too.
    """
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed, rows = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(root, True), []
    while listed.hasNext():
        one = listed.next()
        if fnmatch(one.getPath().getName(), pattern):
            rows.append((one.getPath().toString(), one.getLen()))
    files = spark.createDataFrame(rows, "path string, length long").repartition(max(1, min(len(rows), spark.sparkContext.defaultParallelism)))

    def digest(batches):
        import pyarrow as pa
        from pyarrow import fs

        for b in batches:
            found = []
            for uri in b.column("path").to_pylist():
                local = uri.startswith("file:")
                files, place = (fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")) if local else fs.FileSystem.from_uri(uri)
                state = hashlib.sha256()
                with files.open_input_stream(place, buffer_size=0) as source:
                    while part := source.read(chunk):
                        state.update(part)
                found.append(state.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], ["path", "bytes", "sha256"])

    return files.mapInArrow(digest, "path string, bytes long, sha256 string").orderBy("path")


def manifest_hash(entries: list[dict]) -> str:
    """SHA-256 of the entries by path as canonical JSON."""
    text = json.dumps(sorted(entries, key=lambda e: e["path"]), sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()


def band_statistics(cells: DataFrame, bands: list[str]) -> DataFrame:
    """band, n, low, high, mean, std (population) and quantiles 0.01, 0.5, 0.99 of finite cells, all bands of the wide table at once."""
    long = cells.select(F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("x")) for b in bands])).alias("s")).select("s.*")
    own = long.where("x is not null and not isnan(x)")
    out = own.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    out = out.join(exact_quantiles(own, "x", [0.01, 0.5, 0.99], ["band"]).select("band", "q"), "band")
    return out.select("band", "n", "low", "high", "mean", "std", F.col("q")[0].alias("q01"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q99"))


def label_histogram(cells: DataFrame, label: str) -> DataFrame:
    return cells.groupBy(label).agg(F.count(F.lit(1)).alias("cells"))


def mask_differences(cells: DataFrame, a: str, b: str) -> DataFrame:
    return cells.agg(F.count_if(F.col(a) & ~F.col(b)).alias(f"only_{a}"), F.count_if(F.col(b) & ~F.col(a)).alias(f"only_{b}"), F.count_if(F.col(a) & F.col(b)).alias("both"))


def band_role(name: str | Column, roles: dict[str, list[str]]) -> Column:
    """The role whose set has the name, in the order given; else unknown."""
    name = F.col(name) if isinstance(name, str) else name
    out = F.lit("unknown")
    for role, names in reversed(roles.items()):
        out = F.when(name.isin(names), F.lit(role)).otherwise(out)
    return out


CEILING, UNSTABLE, DOMINATED = 0.999, 0.05, 0.20


def lofo_audit(folds: DataFrame) -> DataFrame:
    """By run and scheme: threshold statistics, calibration gain and flags. ``folds``: run, scheme, fold, threshold, raw_mean, calibrated_mean."""
    t = F.col("threshold")
    out = folds.groupBy("run", "scheme").agg(F.avg(t).alias("threshold_mean"), F.min(t).alias("threshold_min"), F.max(t).alias("threshold_max"), F.stddev_pop(t).alias("threshold_std"), F.first("raw_mean").alias("raw_mean"), F.first("calibrated_mean").alias("calibrated_mean"))
    out = out.withColumn("threshold_range", F.col("threshold_max") - F.col("threshold_min")).withColumn("gain", F.col("calibrated_mean") - F.col("raw_mean"))
    out = out.withColumn("gain_share", F.coalesce(F.try_divide("gain", "calibrated_mean"), F.lit(0.0)))
    flags = F.array(F.when(F.col("threshold_max") >= CEILING, F.lit("CEILING")), F.when(F.col("threshold_range") > UNSTABLE, F.lit("UNSTABLE")), F.when(F.col("gain_share") > DOMINATED, F.lit("CALIBRATION_DOMINATED")))
    return out.withColumn("flags", F.array_compact(flags))


def drain_forecast(manifests: DataFrame, pending: int, now: Column, cutoff: Column, buffer_days: float = 5.0, resume: Column | None = None) -> DataFrame:
    """One row: rate (manifests a day of their span), silence, drain and margin in days, and a verdict. ``manifests`` has ts.

    With ``resume``, work goes on then, or now if that is later. resume_by and resume_by_buffered are the last times at which it could.
    """
    start = now if resume is None else F.greatest(now, resume)
    day = 86400.0
    seconds = lambda c: c.cast("double")
    one = manifests.agg(F.count("ts").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    span = (seconds(F.col("last")) - seconds(F.col("first"))) / day
    one = one.withColumn("rate", F.when((F.col("n") >= 2) & (span > 0), F.col("n") / span))
    one = one.withColumn("silence_days", (seconds(now) - seconds(F.col("last"))) / day).withColumn("drain_days", F.lit(float(pending)) / F.col("rate"))
    one = one.withColumn("margin_days", (seconds(cutoff) - seconds(start)) / day - F.col("drain_days"))
    for name, spare in (("resume_by", 0.0), ("resume_by_buffered", buffer_days)):
        one = one.withColumn(name, F.timestamp_seconds(seconds(cutoff) - (F.col("drain_days") + spare) * day))
    m = F.col("margin_days")
    return one.withColumn("verdict", F.when(m.isNull(), "UNKNOWN").when(m >= buffer_days, "FEASIBLE").when(m >= 0, "TIGHT").otherwise("INFEASIBLE"))


def duplicates(rows: DataFrame, keys: list[str], exempt_prefix: str | None = None, id_col: str = "id") -> DataFrame:
    """kind, value, n, ids of every key that several rows share; ids with the exempt prefix do not count."""
    own = rows if exempt_prefix is None else rows.where(~F.col(id_col).startswith(exempt_prefix))
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in keys]))
    long = own.select(F.col(id_col).cast("string").alias("id"), parts.alias("s")).select("id", "s.*").where("value is not null")
    return long.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("n > 1")


def config_drift(runs: DataFrame) -> DataFrame:
    """run, status: MISMATCH (a recorded hash is not the config's), NO-HASH, MIXED (folds differ), DRIFT (the file has changed since) or OK."""
    out = runs.groupBy("run").agg(F.count_distinct("recorded").alias("kinds"), F.count_if(F.col("recorded").isNull()).alias("missing"), F.bool_or(F.col("recorded") != F.col("declared")).alias("mismatch"), F.bool_or(F.col("recorded") != F.col("current")).alias("drift"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return out.select("run", F.when(yes("mismatch"), "MISMATCH").when(F.col("missing") > 0, "NO-HASH").when(F.col("kinds") > 1, "MIXED").when(yes("drift"), "DRIFT").otherwise("OK").alias("status"))


def ledger_orphans(ledger: DataFrame, gates: DataFrame) -> DataFrame:
    """candidate, side: recorded without a gate report, or the other way round."""
    both = ledger.select("candidate").distinct().withColumn("l", F.lit(True)).join(gates.select("candidate").distinct().withColumn("g", F.lit(True)), "candidate", "full_outer")
    return both.where("l is null or g is null").select("candidate", F.when(F.col("l").isNull(), "not in ledger").otherwise("no gate report").alias("side"))


def lofo_matches(lofo: DataFrame, raw: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """run, scheme, finding of LOFO reports whose raw mean has no run, or not the run's, score."""
    both = lofo.join(raw.select("run", "scheme", F.col("macro_mean").alias("own")), ["run", "scheme"], "left")
    off = F.abs(F.col("raw_mean") - F.col("own")) > tolerance * F.greatest(F.lit(1.0), F.abs("own"))
    return both.withColumn("finding", F.when(F.col("own").isNull(), "no raw score").when(off, "raw mean differs")).where("finding is not null").select("run", "scheme", "finding")


#: Width of the grid's cells by which vectors meet, and where its lines lie, off round numbers; first coordinates that it parts.
CELL, LINES, FIRST = 1e-6, 0.37, 6


def mirrored(views: DataFrame, gates: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Gate views whose fold scores equal those of a run's view within ``tolerance``; vectors with a null or NaN equal none.

    Vectors meet by their length, the grid cells of their first coordinates and that of their sum, and are compared then. A gate's vector also goes to the next
    cell where a line is within the tolerance, so that no pair is missed; all vectors of a scheme never meet.
    """
    width = max(CELL, 4 * tolerance)
    sound = lambda df: df.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))
    total = F.aggregate("v", F.lit(0.0), lambda x, y: x + y)
    cell = lambda x, by=0.0: F.floor((x + by) / width + LINES)
    reach = F.size("v") * tolerance + F.abs(total) * 1e-12
    own = sound(views.select("run", "scheme", F.col("scores").cast("array<double>").alias("v")))
    own = own.withColumn("cells", F.transform(F.slice("v", 1, FIRST), lambda x: cell(x))).withColumn("sum", cell(total))
    g = sound(gates.select("candidate", "scheme", F.col("scores").cast("array<double>").alias("v")))
    both = lambda x, by: F.array_distinct(F.array(cell(x, -by), cell(x, by)))
    for i in range(FIRST):
        value = F.get("v", F.lit(i))
        g = g.withColumn(f"c{i}", F.explode(F.when(value.isNull(), F.array(F.lit(None).cast("long"))).otherwise(both(value, tolerance))))
    g = g.withColumn("cells", F.filter(F.array(*[f"c{i}" for i in range(FIRST)]), lambda x: x.isNotNull())).withColumn("sum", F.explode(F.sequence(cell(total, -reach), cell(total, reach))))
    g = g.select("candidate", "scheme", F.col("v").alias("gate_v"), "cells", "sum")
    near = F.forall(F.zip_with("v", "gate_v", lambda a, b: F.abs(a - b) <= tolerance), lambda x: x)
    met = g.join(own, ["scheme", "cells", "sum"]).where((F.size("v") == F.size("gate_v")) & near)
    return met.select("candidate", "scheme", "run")


def result_findings(ledger: DataFrame, gates: DataFrame, lofo: DataFrame, raw: DataFrame, views: DataFrame, gate_views: DataFrame) -> DataFrame:
    """severity, code, subject, detail: the checks of committed results as one table; an error makes the whole audit fail, a finding does not.

    Ledger against gate reports (candidate), LOFO reports against raw ones (run, scheme), and gate views that mirror no run's view.
    """
    row = lambda severity, code, subject, detail: [F.lit(severity).alias("severity"), F.lit(code).alias("code"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail")]
    orphans = ledger_orphans(ledger, gates).select(*row("finding", "ORPHAN", F.col("candidate"), F.col("side")))
    scores = lofo_matches(lofo, raw)
    place = F.concat_ws("/", F.col("run").cast("string"), "scheme")
    scores = scores.select(F.when(F.col("finding") == "raw mean differs", "error").otherwise("finding").alias("severity"), F.lit("LOFO_RAW").alias("code"), place.alias("subject"), F.col("finding").alias("detail"))
    alone = gate_views.join(mirrored(views, gate_views).select("candidate", "scheme").distinct(), ["candidate", "scheme"], "left_anti")
    alone = alone.select(*row("error", "UNMIRRORED", F.concat_ws("/", F.col("candidate").cast("string"), "scheme"), F.lit("no run has these fold scores")))
    return orphans.union(scores).union(alone)


def tokens(command: str) -> list[str]:
    return shlex.split(command)


def references(tasks: DataFrame) -> DataFrame:
    """id, path: the files that commands name (scripts, configs, results), quoted text left out."""
    bare = F.regexp_replace("cmd", r"'[^']*'|\"[^\"]*\"", " ")
    found = F.expr(r"regexp_extract_all(bare, '(?:scripts|configs|results|data|docs)/[A-Za-z0-9_./{}-]+', 0)")
    return tasks.withColumn("bare", bare).select("id", F.explode(F.array_distinct(found)).alias("path"))


def missing_references(tasks: DataFrame, files: DataFrame) -> DataFrame:
    return references(tasks).join(files.select("path"), "path", "left_anti").select("id", "path")


def order_violations(consumers: DataFrame, producers: DataFrame) -> DataFrame:
    """artifact, consumer, producer_idx: tasks that come before (or are) the earliest producer of what they need, or that none makes."""
    first = producers.groupBy("artifact").agg(F.min("idx").alias("producer_idx"))
    both = consumers.join(first, "artifact", "left")
    return both.where(F.col("producer_idx").isNull() | (F.col("producer_idx") >= F.col("idx"))).select("artifact", F.col("id").alias("consumer"), "producer_idx")


STAGES = ("PENDING", "TRAINED", "SCORED", "RECORDED")


def furthest_stage(events: DataFrame) -> DataFrame:
    """run, stage: the furthest of PENDING, TRAINED, SCORED, RECORDED that it reached."""
    rank = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    return events.groupBy("run").agg(F.max(rank).alias("r")).select("run", F.element_at(F.array(*map(F.lit, STAGES)), F.col("r").cast("int")).alias("stage"))


def insert_tasks(tasks: DataFrame, new: list[dict], anchor: str) -> DataFrame:
    """The queue with ``new`` tasks before the anchor, ordinals renumbered; the anchor must come once and ids be unique. Only counts come to the driver."""
    names = [t["id"] for t in new]
    seen = tasks.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord"))
    one = seen.agg(F.max("n").alias("n"), F.sum(F.when(F.col("id") == anchor, F.col("n"))).alias("anchors"), F.max(F.when(F.col("id") == anchor, F.col("ord"))).alias("at"), F.count_if(F.col("id").isin(names)).alias("taken")).first()
    if one["anchors"] != 1:
        raise ValueError("the anchor must come exactly once")
    if one["n"] > 1 or one["taken"] or len(set(names)) < len(names):
        raise ValueError("ids must be unique")
    rows = tasks.sparkSession.createDataFrame([(one["at"], i, t["id"], t.get("step"), t["cmd"], t.get("note")) for i, t in enumerate(new)], "ord long, k int, id string, step int, cmd string, note string")
    both = tasks.select(F.col("ord").cast("long").alias("ord"), F.lit(len(new)).alias("k"), "id", "step", "cmd", "note").union(rows)
    return ranked(both, [], ["ord", "k"], "place").select((F.col("place") - 1).cast("int").alias("ord"), "id", "step", "cmd", "note")


#: Targets that one list holds.
CHUNK = 4096


def feeders(edges: DataFrame, target: str = "decision") -> DataFrame:
    """Tasks, direct or through one level of others, that decisions need. ``edges``: src is needed by dst; kind of src.

    A path is sent as part of a list: what needs a task goes in lists of at most CHUNK to those that the task needs, and is spread out and told
    apart where the source's rows are, so pairs are not sent one by one.
    """
    edges = materialise(edges.select("src", "dst", "kind").distinct(), "edges")
    place = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    pairs = edges.select("src", "dst").distinct()
    lists = pairs.withColumn("chunk", F.floor((place - 1) / CHUNK)).groupBy("src", "chunk").agg(F.sort_array(F.collect_list("dst")).alias(target))
    two = edges.join(lists.select(F.col("src").alias("dst"), target).hint("merge"), "dst").select("src", "kind", target)
    both = two.union(edges.select("src", "kind", F.array("dst").alias(target))).repartition("src", "kind")
    return both.select("src", F.explode(target).alias(target), "kind").distinct()


#: Rounds whose finds are summed up together.
ROUNDS = 16


def chains(edges: DataFrame) -> DataFrame:
    """node, before, after, critical: the longest chains of tasks before and after each task, and whether it is on a longest one of all.

    ``edges``: src is needed by dst. Each round takes the tasks that the last one reached one edge further, so rounds are as many as the longest chain has; a cycle
    is an error. What rounds reach is summed up once in ROUNDS of them. Neither tasks nor edges are broadcast: files of numbers are far smaller than their rows.
    """
    edges = materialise(edges.select("src", "dst").distinct(), "edges")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    most = nodes.count()

    def longest(here: str, there: str, name: str) -> DataFrame:
        front = materialise(nodes.withColumn(name, F.lit(0).cast("long")), name)
        found, rounds = [front], 0
        while not front.isEmpty():
            if (rounds := rounds + 1) > most:
                raise ValueError("the dependencies form a cycle")
            front = front.join(edges.hint("merge"), F.col("node") == F.col(here)).groupBy(F.col(there).alias("node")).agg((F.max(name) + 1).alias(name))
            front = materialise(front, name)
            found.append(front)
            if len(found) == ROUNDS:
                found = [materialise(reduce(DataFrame.union, found).groupBy("node").agg(F.max(name).alias(name)), name)]
        return reduce(DataFrame.union, found).groupBy("node").agg(F.max(name).alias(name))

    both = materialise(longest("src", "dst", "before").join(longest("dst", "src", "after").hint("merge"), "node"), "chains")
    whole = F.col("before") + F.col("after")
    return both.join(both.agg(F.max(whole).alias("most"))).withColumn("critical", whole == F.col("most")).drop("most")


def queue_state(states: DataFrame, now: Column, stall_hours: float = 48.0) -> DataFrame:
    """One row, state: STOPPED if any task failed, else ALL-DONE, RUNNING, RUNNING-STALLED, INTERRUPTED or NOT-RUNNING. ``states``: id, started, done, failed (times), locked, and waiting if known: whether the runner waits for memory (RUNNING-WAIT-MEM)."""
    waiting = F.bool_or("waiting") if "waiting" in states.columns else F.lit(False)
    one = states.agg(F.count("failed").alias("failed"), F.count_if(F.col("done").isNull()).alias("left"), F.count_if(F.col("started").isNotNull() & F.col("done").isNull() & F.col("failed").isNull()).alias("active"), F.max("started").alias("last"), F.bool_or("locked").alias("locked"), waiting.alias("waiting"))
    hours = (now.cast("double") - F.col("last").cast("double")) / 3600
    return one.withColumn("state", F.when(F.col("failed") > 0, "STOPPED").when(F.col("left") == 0, "ALL-DONE").when(F.col("locked") & (F.col("active") > 0) & (hours > stall_hours), "RUNNING-STALLED").when(F.col("locked") & F.col("waiting"), "RUNNING-WAIT-MEM").when(F.col("locked"), "RUNNING").when(F.col("active") > 0, "INTERRUPTED").otherwise("NOT-RUNNING"))


def sync(queue: DataFrame, checkout: DataFrame) -> DataFrame:
    """file, difference: only in one of the two, or with another hash."""
    both = queue.select("file", F.col("sha256").alias("q")).join(checkout.select("file", F.col("sha256").alias("c")), "file", "full_outer")
    kind = F.when(F.col("q").isNull(), "only in checkout").when(F.col("c").isNull(), "only in queue").when(F.col("q") != F.col("c"), "differs")
    return both.select("file", kind.alias("difference")).where("difference is not null")
