"""The experiment queue as tables: what tasks make and need, the order they stand in, and which of them decisions wait for."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.grid import materialise
from gridloom.operators.order import ranked

# Views, script names with the kinds of task they start, operations in their order.
VIEWS = ("spatial", "fault", "trace")
SCRIPTS = {"endpoint_view.sh": "view", "curved_view.sh": "view", "train_folds.sh": "train", "score_view.sh": "score", "record.sh": "record", "gate.sh": "gate", "compare_seed.sh": "compare_seed", "compare_schedule.sh": "compare_schedule"}
OPERATIONS = ("train", "score", "record")
TRIPLE = r"^(s\d+[a-z]?)-(train|score|record)-(.+)$"


def parsed(tasks: DataFrame) -> DataFrame:
    """idx, id, kind, args of tasks (idx, id, cmd) whose command starts a known script with enough arguments, or copies files (assemble).

    args are the tokens after the script; of a copy, the sources and then the folder they go to; of a view, base run, run, view and the folder that
    a score of it in the same command names. Of several kinds the first counts in the order view, train, score, record, assemble, gate, compare.
    """
    tokens = F.filter(F.split("cmd", r"\s+"), lambda t: t != "")
    named = F.transform(tokens, lambda t: F.element_at(F.split(t, "/"), -1))
    out = tasks.withColumn("tokens", tokens).withColumn("named", named)
    found = F.array(*[F.struct(F.array_position("named", s).alias("at"), F.lit(k).alias("kind"), F.lit({"train": 1, "record": 2, "gate": 3, "view": 3}.get(k, 4)).alias("least")) for s, k in SCRIPTS.items()])
    first = F.filter(found, lambda x: (x["at"] > 0) & (F.size("tokens") >= x["at"] + x["least"]))
    copy = F.filter(F.split(F.regexp_replace("cmd", ";", "&&"), "&&"), lambda s: F.trim(s).rlike(r"^cp\s"))
    parts = F.filter(F.split(F.trim(copy[0]), r"\s+"), lambda t: (t != "cp") & ~t.startswith("-") & ~F.contains(t, F.lit(">")))
    assembles = F.col("cmd").contains("mkdir") & (F.size(copy) > 0) & (F.size(parts) >= 2)
    rows = out.withColumn("first", F.when(F.size(first) > 0, first[0]))
    late = F.col("first").isNull() | F.col("first.kind").isin("gate", "compare_seed", "compare_schedule")
    rows = rows.withColumn("kind", F.when(late & assembles, "assemble").otherwise(F.col("first.kind"))).where("kind is not null")
    after = F.expr("slice(tokens, int(first.at) + 1, size(tokens))")
    score = F.array_position("named", F.lit("score_view.sh"))
    view = F.concat(F.slice(after, 1, 3), F.array(F.when(score > 0, F.get("tokens", (score + 3).cast("int")))))
    args = F.when(F.col("kind") == "assemble", F.transform(parts, lambda x: F.regexp_replace(x, "/+$", ""))).when(F.col("kind") == "view", view).otherwise(after)
    return rows.select("idx", "id", "kind", args.alias("args"))


def _copied() -> Column:
    """folder/view of each source of a copy."""
    return F.transform(F.expr("slice(args, 1, size(args) - 1)"), lambda s: F.regexp_replace(s, r"\.[^./]+$", ""))


def produced(tasks: DataFrame) -> DataFrame:
    """idx, id, artifact of parsed tasks: pred:run, score:run, lofo:run/view, gate:folder/view, base:run/view (runs named after a base, a view and a buffer)."""
    a, kind = F.col("args"), F.col("kind")
    run = F.get(a, F.lit(0))
    base = F.regexp_extract(run, rf"^(.*)-({'|'.join(VIEWS)})-b\d+$", 1)
    view = F.regexp_extract(run, rf"^(.*)-({'|'.join(VIEWS)})-b\d+$", 2)
    made = F.when(kind == "train", F.array(F.concat(F.lit("pred:"), run), F.when(base != "", F.concat(F.lit("base:"), base, F.lit("/"), view))))
    made = made.when(kind == "view", F.array(F.concat(F.lit("pred:"), F.get(a, F.lit(1))), F.concat(F.lit("score:"), F.get(a, F.lit(1))), F.concat(F.lit("lofo:"), F.get(a, F.lit(1)), F.lit("/"), F.get(a, F.lit(2))), F.concat(F.lit("gate:"), F.get(a, F.lit(3)), F.lit("/"), F.get(a, F.lit(2)))))
    made = made.when(kind == "score", F.array(F.concat(F.lit("score:"), run), F.concat(F.lit("lofo:"), run, F.lit("/"), F.get(a, F.lit(1))), F.concat(F.lit("gate:"), F.get(a, F.lit(3)), F.lit("/"), F.get(a, F.lit(1)))))
    made = made.when(kind == "assemble", F.transform(_copied(), lambda s: F.concat(F.lit("gate:"), F.element_at(a, -1), F.lit("/"), F.element_at(F.split(s, "/"), -1))))
    return tasks.select("idx", "id", F.explode(made).alias("artifact")).where("artifact is not null").distinct()


def needed(tasks: DataFrame) -> DataFrame:
    """idx, id, artifact that parsed tasks read."""
    a, kind = F.col("args"), F.col("kind")
    views = lambda folder: [F.concat(F.lit("gate:"), folder, F.lit(f"/{v}")) for v in VIEWS]
    wants = F.when(kind == "score", F.array(F.concat(F.lit("pred:"), F.get(a, F.lit(0))))).when(kind == "record", F.array(F.concat(F.lit("score:"), F.get(a, F.lit(1)))))
    wants = wants.when(kind == "view", F.array(F.concat(F.lit("lofo:"), F.get(a, F.lit(0)), F.lit("/"), F.get(a, F.lit(2)))))
    wants = wants.when(kind == "assemble", F.transform(_copied(), lambda s: F.concat(F.lit("gate:"), s)))
    wants = wants.when(kind == "gate", F.array(*views(F.get(a, F.lit(1))), *views(F.get(a, F.lit(2)))))
    wants = wants.when(kind == "compare_seed", F.array(*views(F.get(a, F.lit(0))), *views(F.get(a, F.lit(1))), F.concat(F.lit("pred:"), F.get(a, F.lit(3)))))
    wants = wants.when(kind == "compare_schedule", F.array(*views(F.get(a, F.lit(0))), *views(F.get(a, F.lit(1))), *[F.concat(F.lit("base:"), F.get(a, F.lit(3)), F.lit(f"/{v}")) for v in VIEWS]))
    return tasks.select("idx", "id", F.explode(wants).alias("artifact")).distinct()


def order_findings(needs: DataFrame, makes: DataFrame) -> DataFrame:
    """artifact, consumer, consumer_idx, producer, producer_idx, kind: inputs that nothing makes (NO-PRODUCER), or only at or after their reader (ORDER-VIOLATION)."""
    first = makes.groupBy("artifact").agg(F.min(F.struct("idx", "id")).alias("p"))
    both = needs.join(first, "artifact", "left")
    kind = F.when(F.col("p").isNull(), "NO-PRODUCER").when(F.col("p.idx") >= F.col("idx"), "ORDER-VIOLATION")
    return both.withColumn("kind", kind).where("kind is not null").select("artifact", F.col("id").alias("consumer"), F.col("idx").alias("consumer_idx"), F.col("p.id").alias("producer"), F.col("p.idx").alias("producer_idx"), "kind")


def triple_findings(steps: DataFrame) -> DataFrame:
    """step, target, earlier, later, earlier_idx, later_idx: pairs of train, score and record that stand in the other order.

    ``steps``: step, target, op, idx. Of an operation that comes again its last place counts; operations that do not come are passed over. One
    grouping finds all three pairs.
    """
    last = [F.max(F.when(F.col("op") == op, F.col("idx"))).alias(op) for op in OPERATIONS]
    pairs = F.array(*[F.struct(F.lit(a).alias("earlier"), F.lit(b).alias("later"), F.col(a).alias("earlier_idx"), F.col(b).alias("later_idx")) for i, a in enumerate(OPERATIONS) for b in OPERATIONS[i + 1 :]])
    found = steps.where(F.col("op").isin(*OPERATIONS)).groupBy("step", "target").agg(*last).select("step", "target", F.explode(pairs).alias("x")).select("step", "target", "x.*")
    return found.where("earlier_idx > later_idx")


def order_audit(tasks: DataFrame) -> DataFrame:
    """artifact, consumer, consumer_idx, producer, producer_idx, kind over a queue (idx, id, cmd): triples of ids (number-operation-target), and what commands make and need."""
    ids = tasks.where(F.col("id").rlike(TRIPLE)).select(*[F.regexp_extract("id", TRIPLE, i).alias(n) for i, n in ((1, "step"), (2, "op"), (3, "target"))], "idx")
    name = lambda op: F.concat_ws("-", "step", op, "target")
    triples = triple_findings(ids).select(F.concat(F.lit("triple:"), F.col("step"), F.lit("-"), F.col("target")).alias("artifact"), name("later").alias("consumer"), F.col("later_idx").alias("consumer_idx"), name("earlier").alias("producer"), F.col("earlier_idx").alias("producer_idx"), F.lit("ORDER-VIOLATION").alias("kind"))
    own = materialise(parsed(tasks), "parsed")
    return triples.union(order_findings(needed(own), produced(own)))


def decision_inputs(decisions: DataFrame, makes: DataFrame, present: DataFrame, done: DataFrame) -> DataFrame:
    """decision, artifact, producers, flag of inputs that are not there: pending producers; or EVIDENCE-ELSEWHERE if all have run, NO-PRODUCER if there are none."""
    missing = decisions.join(present.select("artifact").distinct(), "artifact", "left_anti")
    made = makes.join(done.select("id").distinct().withColumn("over", F.lit(True)), "id", "left").groupBy("artifact").agg(F.count_if(F.col("over").isNull()).alias("producers"), F.count(F.lit(1)).alias("n"))
    flag = F.when(F.col("n").isNull(), "NO-PRODUCER").when(F.col("producers") == 0, "EVIDENCE-ELSEWHERE")
    return missing.join(made, "artifact", "left").select("decision", "artifact", F.coalesce("producers", F.lit(0)).alias("producers"), flag.alias("flag"))


#: The level of tasks that no level was found for: those that are broadcast, on cycles or behind them, and those that need no other one.
LAST = 1 << 30
#: Edges that may be broadcast, cells of decisions by tasks that a worker marks at a time, and rows that it hands on at a time.
CORE = 1 << 20
MARKS = 1 << 26
ROWS = 1 << 18


def task_levels(edges: DataFrame, most: int = 0) -> tuple[list[DataFrame], DataFrame, int]:
    """Of tasks that need others (``edges``: id needs src), the edges of those of each level; the edges of tasks without a level, and their number.

    All that need a task are on lower levels. Each round takes the tasks that no other one left needs, with their edges, until no more than ``most`` edges
    are left, or only tasks on cycles, or needed by such. Whatever a task that is left needs is left too. A round deals and writes the edges left once.
    """
    left, found = edges, []
    while (n := left.count()) > most:
        needed = left.select(F.col("src").alias("id")).distinct().withColumn("needed", F.lit(True))
        told = materialise(left.join(needed, "id", "left").select("id", "src", F.coalesce("needed", F.lit(False)).alias("needed")), "told", "needed")
        heads = told.where("not needed").select("id", "src")
        if heads.isEmpty():
            break
        found.append(heads)
        left = told.where("needed").select("id", "src")
    return found, left, n


class Core:
    """The edges (id, src) of a closed part of the graph, bounded in number, in every worker; its tasks are numbered."""

    def __init__(self, edges: DataFrame):
        ids = edges.select("id").union(edges.select("src")).distinct()
        self.nodes = materialise(ids.repartition(1).withColumn("n", F.monotonically_increasing_id()), "nodes")
        a, b = (F.broadcast(self.nodes.select(F.col("id").alias(c), F.col("n").alias(x))) for c, x in (("id", "a"), ("src", "b")))
        names, rows = self.nodes.orderBy("n").toArrow(), edges.join(a, "id").join(b, "src").select("a", "b").toArrow()
        a, b = (rows.column(x).to_numpy() for x in ("a", "b"))
        start = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=len(names)))]).astype(np.int64)
        self.held = edges.sparkSession.sparkContext.broadcast((names.column("id").combine_chunks(), start, b[np.argsort(a, kind="stable")]))

    def _dealt(self, pairs: DataFrame) -> DataFrame:
        """decision, id, n (-1: not in the core) of ``pairs``, each once, those of a decision one after the other in a partition."""
        parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        once = pairs.select("decision", "id").repartition(parts, "decision").distinct()
        return once.join(F.broadcast(self.nodes), "id", "left").select("decision", "id", F.coalesce("n", F.lit(-1)).alias("n")).sortWithinPartitions("decision")

    def pairs(self, pairs: DataFrame) -> DataFrame:
        """decision, id: ``pairs`` with all that their tasks in the core need, each once."""
        held = self.held

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, start, to = held.value
            for batch, decisions, who, node in reached(batches, start, to):
                if decisions is None:
                    yield batch.select(["decision", "id"])
                for i in range(0, len(who), ROWS):
                    yield pa.RecordBatch.from_arrays([decisions.take(pa.array(who[i : i + ROWS])), names.take(pa.array(node[i : i + ROWS]))], ["decision", "id"])

        return (dealt := self._dealt(pairs)).mapInArrow(run, dealt.select("decision", "id").schema)

    def counts(self, pairs: DataFrame) -> DataFrame:
        """id, decisions: how many decisions have each task in ``pairs``, or need it by them; in parts that are yet to be summed up."""
        held = self.held

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, start, to = held.value
            total, some, n = np.zeros(len(names), np.int64), [], 0
            for batch, _, _, node in reached(batches, start, to):
                if batch is not None:
                    yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.ones(len(batch), np.int64))], ["id", "decisions"])
                some.append(node)
                n += len(node)
                if n > len(total):
                    total += np.bincount(np.concatenate(some), minlength=len(total))
                    some, n = [], 0
            if some:
                total += np.bincount(np.concatenate(some), minlength=len(total))
            have = np.flatnonzero(total)
            for i in range(0, len(have), ROWS):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(have[i : i + ROWS])), pa.array(total[have[i : i + ROWS]])], ["id", "decisions"])

        return (dealt := self._dealt(pairs)).mapInArrow(run, dealt.select("id", F.lit(0).cast("long").alias("decisions")).schema)


def reached(batches: Iterator[pa.RecordBatch], start: np.ndarray, to: np.ndarray) -> Iterator[tuple[pa.RecordBatch | None, pa.Array | None, np.ndarray, np.ndarray]]:
    """Of rows (decision, id, n), those of a decision one after the other: a batch's rows outside the core as they are; or, of some decisions, pairs of
    a decision's place among them and a number in the core that it has or needs (``to[start[n]:start[n + 1]]`` are those that n needs), each once.

    A decision may have rows in many batches: what it has reached is kept for the next one.
    """
    none = np.zeros(0, np.int64)
    size = max(1, len(start) - 1)
    width = max(1, MARKS // size)
    seen = np.zeros(width * size, bool)
    last, kept = None, none
    for batch in batches:
        inside = batch.column("n").to_numpy() >= 0
        if not inside.all():
            yield batch.filter(pa.array(~inside)), None, none, none
        batch = batch.filter(pa.array(inside))
        coded = batch.column("decision").dictionary_encode(null_encoding="encode")
        whose, node = coded.indices.to_numpy().astype(np.int64), batch.column("n").to_numpy()
        for low in range(0, len(coded.dictionary), width):
            a, b = np.searchsorted(whose, (low, low + width))
            decisions = coded.dictionary[low : low + width]
            again = kept if last is not None and decisions[:1].equals(last) else none
            seen[again] = True
            front, found = (whose[a:b] - low) * size + node[a:b], [none]
            front = front[~seen[front]]
            while len(front):
                seen[front] = True
                found.append(front)
                at = front % size
                n = start[at + 1] - start[at]
                on = np.repeat(start[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
                on = np.repeat(front - at, n) + to[on]
                front = np.unique(on[~seen[on]])
            codes = np.concatenate(found)
            seen[codes] = seen[again] = False
            own = codes[codes // size == len(decisions) - 1] % size
            last, kept = decisions[-1:], np.concatenate([again, own]) if len(decisions) == 1 else own
            yield None, decisions, codes // size, codes % size


def _feeders(decisions: DataFrame, needs: DataFrame, makes: DataFrame, present: DataFrame, done: DataFrame) -> tuple[list[DataFrame], Core | None, DataFrame | None]:
    """Tables of decision, id, no pair twice; and the part of the graph that is broadcast, with pairs (some twice) that are to be followed there."""
    there = present.select("artifact").distinct()
    made = makes.join(done.select("id").distinct(), "id", "left_anti").join(there, "artifact", "left_anti").where("id is not null").select("artifact", "id")
    made = materialise(made, "made")
    edges = needs.join(made.withColumnRenamed("id", "src"), "artifact").select("src", "id")
    edges = materialise(edges.join(made.select("id").distinct(), "id", "left_semi").distinct().select("id", "src"), "edges")  # others are never reached
    heads, left, many = task_levels(edges, CORE)
    first, steps = decisions.join(made, "artifact").select("decision", "id"), None
    if not heads:
        first = first.withColumn("level", F.lit(LAST))
    else:
        at = F.coalesce("level", F.lit(LAST)).alias("level")
        own = reduce(DataFrame.union, [x.withColumn("own", F.lit(i)) for i, x in enumerate(heads)])
        levels = own.groupBy("id").agg(F.first("own").alias("level"))
        first = first.join(levels, "id", "left").select("decision", "id", at)
        steps = materialise(own.join(levels.withColumnRenamed("id", "src"), "src", "left").select("id", "src", at, "own"), "steps", "own")
    waiting: dict[int, list[DataFrame]] = {}

    def wait(pairs: DataFrame) -> None:
        pairs = materialise(pairs, "feeders", "level")
        for r in pairs.select("level").distinct().collect():  # as many as there are levels at most
            waiting.setdefault(r["level"], []).append(pairs.where(F.col("level") == r["level"]).select("decision", "id"))

    wait(first)
    found = []
    for level in range(len(heads)):
        if level in waiting:
            found.append(front := materialise(reduce(DataFrame.union, waiting.pop(level)).distinct(), "feeders"))
            wait(front.join(steps.where(F.col("own") == level), "id").select("decision", F.col("src").alias("id"), "level"))
    if LAST not in waiting:
        return found or [first.select("decision", "id")], None, None
    rest = reduce(DataFrame.union, waiting[LAST])
    if many <= CORE:
        return found, Core(left), rest
    front = rest = materialise(rest.distinct(), "feeders")
    while not front.isEmpty():
        on = front.join(left, "id").select("decision", F.col("src").alias("id")).distinct()
        front = materialise(on.join(rest, ["decision", "id"], "left_anti"), "feeders")
        rest = rest.union(front)
    return [*found, rest], None, None


def all_feeders(decisions: DataFrame, needs: DataFrame, makes: DataFrame, present: DataFrame, done: DataFrame) -> DataFrame:
    """decision, id: pending tasks that make what a decision lacks, directly or through other pending tasks.

    Tasks are taken level by level (``task_levels``), so a level's pairs are all known when it is reached, are told apart once, and go one step further
    once. When the tasks that are left have few enough edges (CORE) these are broadcast, and pairs that lead there are followed to their ends where they
    are: most pairs are found there, and these are neither dealt nor written. Only where too many edges are left, as cycles have no level, pairs are taken on in
    rounds, none twice. Nothing comes to the driver but which levels have pairs, and the bounded part. Tasks without an id are none.
    """
    found, core, rest = _feeders(decisions, needs, makes, present, done)
    return reduce(DataFrame.union, found if core is None else [*found, core.pairs(rest)])


def feeder_counts(decisions: DataFrame, needs: DataFrame, makes: DataFrame, present: DataFrame, done: DataFrame) -> DataFrame:
    """id, decisions: how many decisions have the task among ``all_feeders``; pairs in the bounded part are counted where they are found."""
    found, core, rest = _feeders(decisions, needs, makes, present, done)
    parts = [x.groupBy("id").agg(F.count(F.lit(1)).alias("decisions")) for x in found] + ([] if core is None else [core.counts(rest)])
    return reduce(DataFrame.union, parts).groupBy("id").agg(F.sum("decisions").alias("decisions"))


def resume_order(tasks: DataFrame, decisions: DataFrame, needs: DataFrame, makes: DataFrame, present: DataFrame, done: DataFrame) -> DataFrame:
    """place, id, idx, decisions, lacking, runnable of every pending task (idx, id), those that most decisions wait for first, then by idx.

    lacking counts the inputs of the task that are not there yet; it is runnable without any.
    """
    there = present.select("artifact").distinct()
    touched = feeder_counts(decisions, needs, makes, present, done)
    lacking = needs.join(there, "artifact", "left_anti").groupBy("id").agg(F.count_distinct("artifact").alias("lacking"))
    out = tasks.select("id", "idx").join(done.select("id").distinct(), "id", "left_anti").join(touched, "id", "left").join(lacking, "id", "left")
    out = out.select("id", "idx", F.coalesce("decisions", F.lit(0)).alias("decisions"), F.coalesce("lacking", F.lit(0)).alias("lacking")).withColumn("runnable", F.col("lacking") == 0)
    return ranked(out.withColumn("before", -F.col("decisions")), [], ["before", "idx", "id"], "place").drop("before")
