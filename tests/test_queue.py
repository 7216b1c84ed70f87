"""The queue's order, what decisions wait for, vectors that meet within a tolerance, balanced and drawn samples, and the tolerant loss."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import audit, masks, metric, provenance, queue, tiling, tolerant


def tasks(spark, *rows):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "idx long, id string, cmd string")


def test_triples_out_of_order(spark):
    rows = tasks(spark, ("s1-score-a", "x"), ("s1-train-a", "x"), ("s1-record-a", "x"), ("s2b-record-a", "x"), ("s2b-train-a", "x"), ("s3-train-a", "x"), ("s3-record-a", "x"), ("s3-train-a", "x"), ("other", "x"), ("s4-train-b", "x"), ("s4-score-b", "x"))
    found = {(r.artifact, r.consumer, r.consumer_idx, r.producer, r.producer_idx) for r in queue.order_audit(rows).collect()}
    assert found == {("triple:s1-a", "s1-score-a", 0, "s1-train-a", 1), ("triple:s2b-a", "s2b-record-a", 3, "s2b-train-a", 4), ("triple:s3-a", "s3-record-a", 6, "s3-train-a", 7)}


def test_inputs_before_their_producers(spark):
    rows = tasks(
        spark,
        ("a", "bash scripts/queue/score_view.sh run-1 spatial x results/gates/inc"),
        ("b", "bash scripts/queue/train_folds.sh run-1 16"),
        ("c", "scripts/queue/record.sh name run-1 'a hypothesis'"),
        ("d", "scripts/queue/record.sh name run-2"),
        ("e", "mkdir -p results/gates/cand && cp -f results/gates/inc/spatial.json results/gates/inc/fault.json results/gates/cand/ 2>/dev/null"),
        ("f", "scripts/queue/gate.sh G results/gates/inc results/gates/cand"),
        ("g", "scripts/queue/endpoint_view.sh run-1 run-1-ext spatial && scripts/queue/score_view.sh run-1-ext spatial x results/gates/ext"),
        ("h", "scripts/queue/compare_schedule.sh results/gates/ext results/gates/ext base cand"),
        ("i", "scripts/queue/train_folds.sh cand-spatial-b16"),
        ("j", "scripts/queue/compare_seed.sh results/gates/inc results/gates/inc base run-1"),
        ("k", "scripts/queue/train_folds.sh"),
        ("l", "true"),
    )
    own = {r.id: (r.kind, r.args) for r in queue.parsed(rows).collect()}
    assert {k: v[0] for k, v in own.items()} == {"a": "score", "b": "train", "c": "record", "d": "record", "e": "assemble", "f": "gate", "g": "view", "h": "compare_schedule", "i": "train", "j": "compare_seed"}
    assert own["g"][1] == ["run-1", "run-1-ext", "spatial", "results/gates/ext"] and own["e"][1] == ["results/gates/inc/spatial.json", "results/gates/inc/fault.json", "results/gates/cand"]
    found = {(r.consumer, r.artifact): (r.kind, r.producer) for r in queue.order_audit(rows).collect()}
    assert found[("a", "pred:run-1")] == ("ORDER-VIOLATION", "b") and ("c", "score:run-1") not in found and found[("d", "score:run-2")] == ("NO-PRODUCER", None)
    assert ("e", "gate:results/gates/inc/spatial") not in found and found[("e", "gate:results/gates/inc/fault")][0] == "NO-PRODUCER"
    assert {a for c, a in found if c == "f"} == {"gate:results/gates/inc/fault", "gate:results/gates/inc/trace", "gate:results/gates/cand/trace"}
    assert ("g", "lofo:run-1/spatial") not in found and {a for c, a in found if c == "h"} == {"gate:results/gates/ext/fault", "gate:results/gates/ext/trace", "base:cand/spatial", "base:cand/fault", "base:cand/trace"}
    assert found[("h", "base:cand/spatial")] == ("ORDER-VIOLATION", "i") and found[("h", "base:cand/fault")][0] == "NO-PRODUCER" and ("j", "pred:run-1") not in found
    assert queue.order_audit(rows.limit(0)).count() == 0


def test_feeders_rank_and_flags(spark):
    """train -> score -> assemble -> gate, another gate on the score alone, one input made but not there, one that nothing makes."""
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    makes = make([("train", "p"), ("score", "s"), ("copy", "c"), ("old", "o"), ("loop1", "l1"), ("loop2", "l2")], "id string, artifact string")
    needs = make([("score", "p"), ("copy", "s"), ("loop1", "l2"), ("loop2", "l1")], "id string, artifact string")
    decisions = make([("g1", "c"), ("g2", "s"), ("g2", "o"), ("g3", "none"), ("g3", "there"), ("g4", "l1")], "decision string, artifact string")
    present, done = make([("there",)], "artifact string"), make([("old",)], "id string")
    found = {tuple(r) for r in queue.all_feeders(decisions, needs, makes, present, done).collect()}
    assert found == {("g1", "copy"), ("g1", "score"), ("g1", "train"), ("g2", "score"), ("g2", "train"), ("g4", "loop1"), ("g4", "loop2")}
    flags = {(r.decision, r.artifact): (r.producers, r.flag) for r in queue.decision_inputs(decisions, makes, present, done).collect()}
    assert flags == {("g1", "c"): (1, None), ("g2", "s"): (1, None), ("g2", "o"): (0, "EVIDENCE-ELSEWHERE"), ("g3", "none"): (0, "NO-PRODUCER"), ("g4", "l1"): (1, None)}
    own = make([("copy", 0), ("score", 1), ("train", 2), ("old", 3), ("loop1", 4), ("loop2", 5)], "id string, idx long")
    order = queue.resume_order(own, decisions, needs, makes, present, done).orderBy("place").collect()
    assert [(r.id, r.decisions, r.lacking, r.runnable) for r in order] == [("score", 2, 1, False), ("train", 2, 0, True), ("copy", 1, 1, False), ("loop1", 1, 1, False), ("loop2", 1, 1, False)]


def test_vectors_that_meet_within_a_tolerance(spark):
    r = random.Random(4)
    base = [[r.choice([0.1, 0.2, 1 / 3, 0.63e-6, 5.0]) for _ in range(r.randint(0, 8))] for _ in range(60)]
    views = [(i, "a" if i % 3 else "b", v) for i, v in enumerate(base)] + [(100, "a", [None, 1.0]), (101, "a", [float("nan")])]
    gates = [(i, "a" if i % 2 else "b", [x + r.choice([0, 9e-10, -9e-10, 2e-9]) for x in r.choice(base)]) for i in range(200)] + [(500, "a", [None, 1.0]), (501, "a", [float("nan")])]
    found = audit.mirrored(spark.createDataFrame(views, "run int, scheme string, scores array<double>"), spark.createDataFrame(gates, "candidate int, scheme string, scores array<double>"))
    sound = lambda v: all(x is not None and not math.isnan(x) for x in v)
    want = sorted((c, s, i) for c, s, g in gates for i, t, v in views if s == t and len(g) == len(v) and sound(g) and sound(v) and all(abs(x - y) <= 1e-9 for x, y in zip(g, v)))
    assert sorted(map(tuple, found.collect())) == want and len(want) > 20


def test_vectors_of_a_scheme_do_not_all_meet(spark):
    vectors = [(i, "a", [((i * 7919 + k * 104729) % 1_000_003) / 1_000_003 for k in range(5)]) for i in range(100_000)]
    rows = spark.createDataFrame(vectors, "id long, scheme string, scores array<double>")
    found = audit.mirrored(rows.withColumnRenamed("id", "run"), rows.withColumnRenamed("id", "candidate"))
    assert found.count() == 100_000


def plain_longest_first(sizes, folds):
    loads = [0] * folds
    for n in sorted(sizes, reverse=True):
        k = min(range(folds), key=lambda i: (loads[i], i))
        loads[k] += n
    return loads


def test_balance_by_sizes_equals_balance_by_items():
    r = random.Random(6)
    for _ in range(300):
        folds, sizes = r.randint(2, 6), [r.choice([1, 1, 1, 2, 3, 5, 17, 40]) for _ in range(r.randint(6, 60))]
        counts = {n: sizes.count(n) for n in sizes}
        shares = masks.longest_first(counts, folds)
        assert {n: sum(g) for n, g in shares.items()} == counts
        assert sorted(sum(n * g[k] for n, g in shares.items()) for k in range(folds)) == sorted(plain_longest_first(sizes, folds))
    assert sum(map(sum, masks.longest_first({1: 10**9, 7: 10**8}, 5).values())) == 11 * 10**8


def test_components_are_balanced(spark):
    r = random.Random(2)
    sizes = {c: r.choice([1, 1, 2, 2, 3, 9]) for c in range(40)}
    rows = spark.createDataFrame([(c, i) for c, n in sizes.items() for i in range(n)], "component long, row long")
    found = {x.component: x.fold for x in masks.assign_components(rows, 3, 5).collect()}
    assert set(found) == set(sizes)
    assert sorted(sum(n for c, n in sizes.items() if found[c] == k) for k in range(3)) == sorted(plain_longest_first(sizes.values(), 3))
    assert found == {x.component: x.fold for x in masks.assign_components(rows.repartition(7), 3, 5).collect()}


def test_holdout_is_drawn_by_hash(spark):
    tiles = spark.createDataFrame([(r, c, (r + c) % 3 == 0, None if r == 4 else 1.0) for r in range(0, 40, 4) for c in range(0, 40, 4)], "row0 long, col0 long, truth boolean, elevation double")
    good = [(r, c) for r in range(0, 40, 4) for c in range(0, 40, 4) if (r + c) % 3 == 0 and r != 4]
    want = sorted(good, key=lambda t: hashlib.md5(f"9:{t[0]}:{t[1]}".encode()).hexdigest())[: round(0.25 * len(good))]
    assert sorted(map(tuple, tiling.holdout_tiles(tiles, 0.25, 9).collect())) == sorted(want)


def cells(spark):
    r = np.random.default_rng(8)
    rows = []
    for i in range(14):
        for j in range(16):
            truth = bool(j in (4, 11) and i % 5 != 0)
            rows.append((i, j, truth, bool(r.random() < 0.92), float(0.6 * truth + r.normal() * 0.4), float(r.normal()), float(r.random())))
    return spark.createDataFrame(rows, "row long, col long, truth boolean, valid boolean, a double, b double, p double")


@pytest.mark.parametrize("blend", [1.0, 0.5, 0.0])
def test_gradient_equals_differences(spark, blend):
    data = tolerant.examples(cells(spark), ["a", "b"])
    theta = [0.7, -0.4, -0.2]
    one = tolerant.loss_and_gradient(data, theta, blend=blend).first()
    for i in range(3):
        ends = []
        for d in (1e-5, -1e-5):
            ends.append(tolerant.loss_and_gradient(data, [t + d * (k == i) for k, t in enumerate(theta)], blend=blend).first().loss)
        assert one.gradient[i] == pytest.approx((ends[0] - ends[1]) / 2e-5, abs=1e-6)
    own = metric.tversky_components(tolerant.predict(cells(spark), ["a", "b"], theta)).first()
    assert (one.tp, one.fp, one.fn) == pytest.approx((own.tp, own.fp, own.fn))
    with pytest.raises(ValueError, match="blend"):
        tolerant.loss_and_gradient(data, theta, blend=1.5)


def test_training_lowers_the_tolerant_loss(spark):
    rows = cells(spark).withColumn("train", F.lit(True))
    theta, losses = tolerant.fit(tolerant.examples(rows, ["a", "b"]), steps=12)
    assert losses == sorted(losses, reverse=True) and losses[-1] < losses[0] - 0.02
    score = metric.tversky(tolerant.predict(rows.drop("p"), ["a", "b"], theta)).first().score
    assert score == pytest.approx(1 - losses[-1])
    logistic = metric.tversky(provenance.predict_cells(provenance.fit_cells(rows, ["a", "b"], "train"), rows)).first().score
    assert score > logistic
    none = tolerant.loss_and_gradient(tolerant.examples(rows.where("not truth"), ["a"]), [0.0, 0.0]).first()
    assert none.tp == 0 and none.fn == 0 and none.loss == pytest.approx(1.0)


def test_lbfgs_finds_a_minimum():
    a = np.diag([1.0, 40.0, 7.0])
    x, losses = tolerant.lbfgs(lambda v: (float((v - 2) @ a @ (v - 2)), 2 * a @ (v - 2)), np.zeros(3), 40)
    assert np.allclose(x, 2, atol=1e-4) and losses[-1] < 1e-7


def test_every_shift_equals_its_own_score(spark):
    rows = cells(spark)
    by = {(r.dy, r.dx): r for r in metric.shift_sensitivity(rows).collect()}
    valid = {(r.row, r.col): r.p for r in rows.where("valid").collect()}
    for (dy, dx), found in by.items():
        moved = rows.sparkSession.createDataFrame([(r, c, valid.get((r - dy, c - dx), 0.0)) for r, c in valid], "row long, col long, p double")
        own = metric.tversky(rows.drop("p").where("valid").join(moved, ["row", "col"])).first()
        assert (found.tp, found.fp, found.fn, found.score) == pytest.approx((own.tp, own.fp, own.fn, own.score))
        assert found.delta == pytest.approx(found.score - by[0, 0].score)
    worst = [r for r in by.values() if r.worst]
    assert len(worst) == 1 and worst[0].score == min(r.score for r in by.values())


def test_feeders_of_chains_are_told_apart_once(spark, monkeypatch):
    """A ladder of tasks, each of which needs the next two: pairs are met on paths of many lengths, but compared with those of their own level only."""
    plans, write = [], queue.materialise

    def noted(df, label, *by):
        if label == "feeders":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, label, *by)

    monkeypatch.setattr(queue, "materialise", noted)
    tasks = spark.range(9).select("id", F.col("id").alias("artifact"))
    needs = tasks.select("id", F.explode(F.array(F.col("id") + 1, F.col("id") + 2)).alias("artifact"))
    decisions = spark.createDataFrame([("x", 0), ("y", 6), ("z", 3)], "decision string, artifact long")
    none = tasks.where("id < 0")
    found = [tuple(r) for r in queue.all_feeders(decisions, needs, tasks, none.select("artifact"), none.select("id")).collect()]
    assert sorted(found) == [(d, i) for d, k in (("x", 0), ("y", 6), ("z", 3)) for i in range(k, 9)]
    assert plans and not any("LeftAnti" in p for p in plans)


def test_paths_of_two_are_sent_in_lists(spark, monkeypatch):
    """A hub whose targets fill several lists; nothing is dealt by pairs."""
    monkeypatch.setattr(audit, "CHUNK", 3)
    edges = {("a", "hub"), ("b", "hub"), ("b", "a"), ("c", "b")} | {("hub", f"t{i}") for i in range(8)}
    out = audit.feeders(spark.createDataFrame([(*e, "train") for e in sorted(edges)] * 2, "src string, dst string, kind string"))
    assert sorted((r.src, r.decision) for r in out.collect()) == sorted(edges | {(a, d) for a, b in edges for c, d in edges if b == c})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(src" in plan and "hashpartitioning(src#" in plan and not any("hashpartitioning" in x and "decision#" in x.split("hashpartitioning")[1].split(")")[0] for x in plan.splitlines())


def ladder(spark):
    """Three decisions over nine tasks, each of which needs the next two."""
    tasks = spark.range(9).select("id", F.col("id").alias("artifact"))
    needs = tasks.select("id", F.explode(F.array(F.col("id") + 1, F.col("id") + 2)).alias("artifact"))
    none = tasks.where("id < 0")
    return spark.createDataFrame([("x", 0), ("y", 6), ("z", 3)], "decision string, artifact long"), needs, tasks, none.select("artifact"), none.select("id")


def noted_pairs(monkeypatch):
    """Rows that are written with a decision."""
    rows, write = [], queue.materialise

    def noted(df, label, *by):
        out = write(df, label, *by)
        if "decision" in out.columns:
            rows.append(out.count())
        return out

    monkeypatch.setattr(queue, "materialise", noted)
    return rows


def test_pairs_below_the_levels_are_not_written(spark, monkeypatch):
    rows = noted_pairs(monkeypatch)
    found = queue.all_feeders(*ladder(spark)).collect()
    assert sorted(map(tuple, found)) == [(d, i) for d, k in (("x", 0), ("y", 6), ("z", 3)) for i in range(k, 9)]
    assert sum(rows) == 3


def test_decisions_are_counted_without_pairs(spark, monkeypatch):
    rows = noted_pairs(monkeypatch)
    own = spark.range(9).select("id", F.col("id").alias("idx"))
    found = queue.resume_order(own, *ladder(spark)).orderBy("place").collect()
    assert [(r.id, r.decisions) for r in found] == [(i, 3) for i in (6, 7, 8)] + [(i, 2) for i in (3, 4, 5)] + [(i, 1) for i in (0, 1, 2)]
    assert sum(rows) == 3


@pytest.mark.parametrize("core", [0, 12, 60, 1 << 20])
@pytest.mark.parametrize("cyclic", [False, True])
def test_feeders_against_plain_search(spark, monkeypatch, core, cyclic):
    """By levels, by broadcast and by rounds; a decision's rows in many batches, decisions null or of one task, tasks that need none."""
    monkeypatch.setattr(queue, "CORE", core)
    monkeypatch.setattr(queue, "MARKS", 90)
    monkeypatch.setattr(queue, "ROWS", 4)
    r = random.Random(11)
    edges = sorted({(f"t{a}", f"t{b}") for a, b in [(r.randrange(40), r.randrange(40)) for _ in range(70)] if a < b} | ({("t30", "t20"), ("t20", "t30"), ("t8", "t8")} if cyclic else set()))
    wants = sorted({(f"d{r.randrange(6)}", f"t{r.randrange(44)}") for _ in range(30)}) + [("all", f"t{i}") for i in range(44)] + [(None, "t1"), (None, "t43")]
    over = {"t5", "t13"}
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    makes = make([(f"t{i}", f"t{i}") for i in range(44)], "id string, artifact string")
    args = make(wants, "decision string, artifact string"), make(edges, "id string, artifact string"), makes, make([("t7",)], "artifact string"), make([(x,) for x in over], "id string")
    pairs = set()
    for d, t in wants:
        todo = [t]
        while todo:
            t = todo.pop()
            if t not in over | {"t7"} and (d, t) not in pairs:
                pairs.add((d, t))
                todo += [b for a, b in edges if a == t]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = [tuple(x) for x in queue.all_feeders(*args).collect()]
        counts = {x.id: x.decisions for x in queue.feeder_counts(*args).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len(pairs) and set(found) == pairs
    assert counts == {t: sum(x == t for _, x in pairs) for t in {x for _, x in pairs}}
