"""Queries: the remaining operators (validators, lookups, joins, sampling, audits) over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import audit, commands, components, ensemble, features, gate, grid, masks, provenance, queue, tiling
from gridloom.plans.control import sized
from gridloom.plans.collect import Plans
from gridloom.plans.raster import RASTER, raster
from gridloom.plans.scoring import rounded
from gridloom.plans.spatial import MEMBERS, marked, members, reach_sql
from gridloom.streaming import ledger

query = Plans()


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("normalise_reference", f"WITH {RASTER}, s AS (SELECT min(v) AS a, max(v) AS b, min(p) AS c, max(p) AS d FROM raster) SELECT row, col, round((v - a) / (b - a), 6) + 0.0 AS v, round((p - c) / (d - c), 6) + 0.0 AS p FROM raster, s")
def _(spark, sf_dir):
    return rounded(features.normalise_reference(raster(spark, sf_dir).select("row", "col", "v", "p"), ["v", "p"]))


@query("clean_features", f"WITH {RASTER} SELECT row, col, CASE WHEN v > 0.3 THEN 'NaN'::DOUBLE ELSE round(v, 6) + 0.0 END AS v, CASE WHEN label < 1 THEN 0 ELSE label END::INT AS label FROM raster")
def _(spark, sf_dir):
    cells = raster(spark, sf_dir).select("row", "col", F.when(F.col("v") > 0.3, F.lit(-3.4e38)).otherwise(F.col("v")).alias("v"), "label")
    return rounded(grid.clean_features(cells, ["v"], "label").withColumn("label", F.col("label").cast("int")))


@query("dilated_truth", f"""WITH {RASTER}, o AS (SELECT y.range - 3 AS dy, x.range - 3 AS dx FROM range(7) y, range(7) x WHERE (y.range - 3) ** 2 + (x.range - 3) ** 2 <= 9)
SELECT DISTINCT row + dy AS row, col + dx AS col FROM raster, o WHERE truth AND valid""")
def _(spark, sf_dir):
    return masks.dilated(raster(spark, sf_dir).where("truth and valid"), 3)


@query("training_cells", f"WITH {RASTER} SELECT row, col, CASE WHEN fold <> 2 AND valid THEN round(v::FLOAT::DOUBLE, 6) + 0.0 ELSE 0 END AS v, CASE WHEN fold <> 2 AND valid AND truth THEN 1.0 ELSE 0.0 END::DOUBLE AS target, fold <> 2 AND valid AS train FROM raster")
def _(spark, sf_dir):
    cells = raster(spark, sf_dir).withColumn("train", (F.col("fold") != 2) & F.col("valid"))
    return rounded(masks.training_cells(cells, ["v"], truth="truth").withColumns({c: F.col(c).cast("double") for c in ("v", "target")}))


@query("block_folds")
def _(spark, sf_dir):
    """No SQL: the blocks are dealt by a shuffled order (PCG64)."""
    cells, height, width = sized(spark, sf_dir)
    return masks.block_folds(cells.select("row", "col"), masks.assign_blocks(height, width, 16, 5, 7), 16)


@query("component_folds")
def _(spark, sf_dir):
    return masks.assign_components(components.label(marked(spark, sf_dir), tile=32), 5, 7)


TRACES = reach_sql("v > 0.1") + """, big AS (SELECT component, row, col, count(*) OVER w AS n, row - min(row) OVER w AS r, col - min(col) OVER w AS c FROM labelled WINDOW w AS (PARTITION BY component) QUALIFY n >= 6),
s AS (SELECT component, count(*) * sum(r * r) - sum(r) * sum(r) AS a, count(*) * sum(r * c) - sum(r) * sum(c) AS b, count(*) * sum(c * c) - sum(c) * sum(c) AS d FROM big GROUP BY component),
u AS (SELECT component, round(cos(atan2(2 * b, a - d) / 2), 12) AS ur, round(sin(atan2(2 * b, a - d) / 2), 12) AS uc FROM s),
x AS (SELECT component, row, col, n, round(CASE WHEN CASE WHEN abs(ur) >= abs(uc) THEN ur ELSE uc END < 0 THEN -1 ELSE 1 END * (r * ur + c * uc), 9) AS along FROM big JOIN u USING (component)),
q AS (SELECT component, quantile_cont(along, 0.7) AS cut FROM x GROUP BY component),
k AS (SELECT x.*, along >= cut AS beyond, row_number() OVER (PARTITION BY component ORDER BY along, row, col) AS turn FROM x JOIN q USING (component))
SELECT component::BIGINT AS component, row::BIGINT AS row, col::BIGINT AS col, CASE WHEN bool_or(beyond) OVER w AND NOT bool_and(beyond) OVER w THEN beyond
  ELSE turn > n - least(n - 1, greatest(1, round(n * 0.3)::BIGINT)) END AS withheld FROM k WINDOW w AS (PARTITION BY component)"""


@query("trace_ends", TRACES)
def _(spark, sf_dir):
    return masks.trace_ends(components.label(raster(spark, sf_dir).where("v > 0.1"), tile=32), 6)


@query("submission_report", f"""WITH {RASTER} SELECT count(*) FILTER (NOT valid AND col % 5 <> 0) AS finite_outside, count(*) FILTER (valid AND col % 5 = 0) AS missing_inside,
count(*) FILTER (valid AND col % 5 <> 0 AND (v < 0 OR v > 1)) AS out_of_range, min(v) FILTER (valid AND col % 5 <> 0) = max(v) FILTER (valid AND col % 5 <> 0) AS constant, 'width differs' AS geometry_errors FROM raster""")
def _(spark, sf_dir):
    cells = raster(spark, sf_dir)
    given = cells.where("col % 5 <> 0").select("row", "col", F.col("v").alias("p"))
    found = grid.submission_report(given, cells, grid.GridSpec(1, 63, "EPSG:32611"), grid.GridSpec(1, 64, "EPSG:32611"))
    return found.withColumn("geometry_errors", F.array_join("geometry_errors", ","))


@query("prediction_faults", f"WITH {RASTER} SELECT count(*) FILTER (valid AND label = 3) AS not_finite, count(*) FILTER (valid AND label <> 3 AND (v < 0 OR v > 1)) AS out_of_range FROM raster")
def _(spark, sf_dir):
    return grid.bad_predictions(raster(spark, sf_dir).select("valid", F.when(F.col("label") == 3, F.lit(float("nan"))).otherwise(F.col("v")).alias("p")))


@query("member_alignment", f"""WITH {MEMBERS}, c AS (SELECT member, fold, count(*) AS cells FROM members WHERE NOT (member = 'b' AND fold = 2) AND NOT (member = 'c' AND fold = 1 AND col = 0) GROUP BY ALL)
SELECT member, fold, cells FROM c WHERE fold IN (SELECT fold FROM c GROUP BY fold HAVING count(*) <> 3 OR min(cells) <> max(cells))""")
def _(spark, sf_dir):
    return ensemble.alignment_errors(members(spark, sf_dir).where("not (member = 'b' and fold = 2) and not (member = 'c' and fold = 1 and col = 0)"))


@query("ensemble_weighted", f"WITH {MEMBERS} SELECT fold, row, col, round(sum(p * CASE member WHEN 'a' THEN 0.5 WHEN 'b' THEN 0.3 ELSE 0.2 END), 6) AS p FROM members GROUP BY ALL")
def _(spark, sf_dir):
    weights = spark.createDataFrame([(k, m, w) for k in range(5) for m, w in (("a", 0.5), ("b", 0.3), ("c", 0.2))], "fold long, member string, weight double")
    return rounded(ensemble.apply(members(spark, sf_dir), "weighted", weights))


@query("label_histogram", f"WITH {RASTER} SELECT label, count(*) AS cells FROM raster GROUP BY label")
def _(spark, sf_dir):
    return audit.label_histogram(raster(spark, sf_dir), "label")


@query("band_roles", "SELECT n_name AS name, CASE WHEN n_name IN ('FRANCE', 'GERMANY') THEN 'elevation' WHEN n_name IN ('CHINA', 'INDIA') THEN 'gravity' ELSE 'unknown' END AS role FROM nation")
def _(spark, sf_dir):
    roles = {"elevation": ["FRANCE", "GERMANY"], "gravity": ["CHINA", "INDIA"]}
    return read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), audit.band_role("n_name", roles).alias("role"))


@query("symmetric_eigenvalues", f"WITH {RASTER}, r AS (SELECT row, col, (p + v) / 2 AS h, sqrt(greatest(((p + v) / 2) ** 2 - (p * v - 0.01), 0)) AS q FROM raster) SELECT row, col, round(h + q, 6) + 0.0 AS larger, round(h - q, 6) + 0.0 AS smaller FROM r")
def _(spark, sf_dir):
    larger, smaller = features.eigenvalues(F.col("p"), F.lit(0.1), F.col("v"))
    return rounded(raster(spark, sf_dir).select("row", "col", larger.alias("larger"), smaller.alias("smaller")))


@query("patchify", f"WITH {RASTER} SELECT row // 24 AS patch_r, col // 24 AS patch_c, row % 24 AS y, col % 24 AS x, round(p, 6) AS p FROM raster")
def _(spark, sf_dir):
    return rounded(tiling.patchify(raster(spark, sf_dir).select("row", "col", "p"), 24).drop("row", "col"))


@query("unpatchify", f"WITH {RASTER} SELECT row, col, round(p, 6) AS p FROM raster")
def _(spark, sf_dir):
    patches = tiling.patchify(raster(spark, sf_dir).select("row", "col", "p"), 24).drop("row", "col")
    return rounded(tiling.unpatchify(patches, 24))


@query("extract_patch", f"""WITH {RASTER}, f AS (SELECT range // 40 - 8 AS row, range % 40 + 40 AS col FROM range(1600))
SELECT f.row, f.col, coalesce(round(p, 6), -1) AS p FROM f LEFT JOIN raster r ON f.row = r.row AND f.col = r.col""")
def _(spark, sf_dir):
    return rounded(tiling.extract_patch(raster(spark, sf_dir), -8, 40, 40, "p", -1.0))


TILES = f"""WITH {RASTER}, starts AS (SELECT unnest(list_distinct(list_concat(range(0, n - 15, 16), [n - 16]))) AS row0 FROM (SELECT count(*) AS n FROM embeddings)),
t AS (SELECT *, col // 16 * 16 AS col0 FROM raster JOIN starts ON row >= row0 AND row < row0 + 16)"""


def tiles16(spark, sf_dir):
    cells, height, width = sized(spark, sf_dir)
    return tiling.to_tiles(cells, height, width, 16, 0)


@query("touched_tiles", TILES + " SELECT DISTINCT row0, col0 FROM t WHERE v > 0.4")
def _(spark, sf_dir):
    return tiling.touched(tiles16(spark, sf_dir), "v > 0.4")


@query("training_origins", TILES + """, g AS (SELECT row0, col0, bool_or(truth AND v > 0.25) AS positive FROM t GROUP BY row0, col0 HAVING count(*) FILTER (valid) / 256.0 >= 0.85),
d AS (SELECT *, row_number() OVER (PARTITION BY positive ORDER BY md5('7:' || row0 || ':' || col0), row0, col0) AS k FROM g)
SELECT row0, col0, positive FROM d WHERE positive OR k <= floor(0.5 * (SELECT count(*) FROM g WHERE positive))""")
def _(spark, sf_dir):
    tiles = tiles16(spark, sf_dir).withColumn("truth", F.expr("truth and v > 0.25")).withColumn("allowed", F.col("valid"))
    return tiling.training_origins(tiles, 16, 0.5, 0.85, 7)


@query("holdout_tiles", TILES + """, g AS (SELECT row0, col0 FROM t GROUP BY row0, col0 HAVING bool_or(truth) AND bool_or(v > 0)), d AS (SELECT *, row_number() OVER (ORDER BY md5('3:' || row0 || ':' || col0), row0, col0) AS k FROM g)
SELECT row0, col0 FROM d WHERE k <= round_even(0.2 * (SELECT count(*) FROM g), 0)""")
def _(spark, sf_dir):
    return tiling.holdout_tiles(tiles16(spark, sf_dir).withColumn("elevation", F.when(F.col("v") > 0, F.col("v"))), 0.2, 3)


@query("oof_mean", f"WITH {MEMBERS} SELECT row, col, round(sum(p) / 4, 6) AS p FROM members GROUP BY row, col")
def _(spark, sf_dir):
    return rounded(tiling.accumulate(members(spark, sf_dir), 4))


@query("centre_sample", f"WITH {RASTER}, n AS (SELECT max(row) AS h FROM raster) SELECT row // 6 AS row, col // 6 AS col, round(p, 6) AS p FROM raster, n WHERE row = least(row // 6 * 6 + 3, h) AND col = least(col // 6 * 6 + 3, 63)")
def _(spark, sf_dir):
    return rounded(provenance.centre_sample(raster(spark, sf_dir).select("row", "col", "p"), 6, read(spark, sf_dir, "embeddings").count(), 64))


@query("required_margin", "WITH s AS (SELECT user_id, count(*) AS n, stddev_pop(value) AS d FROM events GROUP BY user_id) SELECT user_id, round(1 + 0.5 * log2(1 + n), 6) AS multiplier, round(d * (1 + 0.5 * log2(1 + n)), 6) AS margin FROM s")
def _(spark, sf_dir):
    runs = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("value").alias("d"))
    times = gate.escalation(F.col("n"))
    return rounded(runs.select("user_id", times.alias("multiplier"), (F.col("d") * times).alias("margin")))


@query("ablation_plan", "SELECT v AS variant, f::INT AS fold, 'train ' || v || ' --fold ' || f AS command FROM (SELECT unnest(['a', 'b', 'c']) AS v), range(5) r(f)")
def _(spark, sf_dir):
    return gate.ablation_plan(spark, ["a", "b", "c"], list(range(5)), "train %s --fold %d")


@query("config_drift", """WITH r AS (SELECT o_custkey AS run, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderpriority[1:1] END AS recorded, CASE WHEN o_custkey % 3 = 0 THEN '9' ELSE NULL END AS declared, CASE WHEN o_custkey % 2 = 0 THEN '1' ELSE NULL END AS current_ FROM orders)
SELECT run, CASE WHEN coalesce(bool_or(recorded <> declared), false) THEN 'MISMATCH' WHEN count(*) FILTER (recorded IS NULL) > 0 THEN 'NO-HASH' WHEN count(DISTINCT recorded) > 1 THEN 'MIXED' WHEN coalesce(bool_or(recorded <> current_), false) THEN 'DRIFT' ELSE 'OK' END AS status FROM r GROUP BY run""")
def _(spark, sf_dir):
    key = F.col("o_custkey")
    recorded = F.when(F.col("o_orderkey") % 50 != 0, F.substring("o_orderpriority", 1, 1))
    runs = read(spark, sf_dir, "orders").select(key.alias("run"), recorded.alias("recorded"), F.when(key % 3 == 0, "9").alias("declared"), F.when(key % 2 == 0, "1").alias("current"))
    return audit.config_drift(runs)


@query("ledger_orphans", """WITH l AS (SELECT DISTINCT o_custkey AS candidate FROM orders), g AS (SELECT c_custkey AS candidate FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(l.candidate, g.candidate) AS candidate, CASE WHEN l.candidate IS NULL THEN 'not in ledger' ELSE 'no gate report' END AS side FROM l FULL JOIN g ON l.candidate = g.candidate WHERE l.candidate IS NULL OR g.candidate IS NULL""")
def _(spark, sf_dir):
    gates = read(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("candidate"))
    return audit.ledger_orphans(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("candidate")), gates)


@query("lofo_matches", """WITH l AS (SELECT n_nationkey AS run, 'spatial' AS scheme, n_nationkey / 10.0 AS raw_mean FROM nation), r AS (SELECT n_nationkey AS run, 'spatial' AS scheme, CASE WHEN n_regionkey = 1 THEN 5.0 ELSE n_nationkey / 10.0 END AS own FROM nation WHERE n_regionkey <> 2)
SELECT l.run, l.scheme, CASE WHEN own IS NULL THEN 'no raw score' ELSE 'raw mean differs' END AS finding FROM l LEFT JOIN r USING (run, scheme) WHERE own IS NULL OR abs(raw_mean - own) > 1e-6 * greatest(1, abs(own))""")
def _(spark, sf_dir):
    nation = read(spark, sf_dir, "nation")
    run, scheme, score = F.col("n_nationkey").alias("run"), F.lit("spatial").alias("scheme"), F.col("n_nationkey") / 10.0
    raw = nation.where("n_regionkey <> 2").select(run, scheme, F.when(F.col("n_regionkey") == 1, 5.0).otherwise(score).alias("macro_mean"))
    return audit.lofo_matches(nation.select(run, scheme, score.alias("raw_mean")), raw)


@query("mirrored_views", """WITH v AS (SELECT l_suppkey AS run, l_returnflag AS scheme, list(l_linenumber::DOUBLE ORDER BY l_orderkey, l_linenumber, l_partkey) AS scores FROM lineitem GROUP BY ALL)
SELECT g.run AS candidate, g.scheme, v.run FROM v JOIN v AS g ON v.scheme = g.scheme AND v.scores = g.scores AND g.run % 2 = 0 AND v.run % 2 = 1""")
def _(spark, sf_dir):
    order = F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey")))
    views = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("run"), F.col("l_returnflag").alias("scheme")).agg(order.alias("o"))
    views = views.select("run", "scheme", F.transform("o", lambda x: x["l_linenumber"].cast("double")).alias("scores"))
    return audit.mirrored(views.where("run % 2 = 1"), views.where("run % 2 = 0").withColumnRenamed("run", "candidate"))


@query("mirrored_scores", """WITH v AS (SELECT l_orderkey * 10 + l_linenumber AS run, l_orderkey % 2 = 0 AS gate, l_returnflag AS scheme, l_quantity AS a, l_discount AS b, l_tax AS c, round_even(l_extendedprice / 1000, 0) AS d FROM lineitem)
SELECT g.run AS candidate, g.scheme, v.run FROM v JOIN v AS g ON v.scheme = g.scheme AND v.a = g.a AND v.b = g.b AND v.c = g.c AND v.d = g.d AND g.gate AND NOT v.gate""")
def _(spark, sf_dir):
    """Lines of even orders, a little off, as a gate's views; those of odd orders as runs' views."""
    scores = F.array("l_quantity", "l_discount", "l_tax", F.rint(F.col("l_extendedprice") / 1000))
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("run"), (F.col("l_orderkey") % 2 == 0).alias("gate"), F.col("l_returnflag").alias("scheme"), scores.alias("scores"))
    gates = rows.where("gate").select(F.col("run").alias("candidate"), "scheme", F.transform("scores", lambda x: x + 4e-10).alias("scores"))
    return audit.mirrored(rows.where("not gate"), gates)


@query("missing_references", """WITH t AS (SELECT n_name AS id, 'scripts/' || n_regionkey || '.py' AS path FROM nation UNION SELECT n_name, 'configs/' || n_nationkey || '.yaml' FROM nation)
SELECT id, path FROM t WHERE path NOT IN (SELECT 'scripts/' || r_regionkey || '.py' FROM region WHERE r_regionkey < 3)""")
def _(spark, sf_dir):
    command = F.format_string("python scripts/%s.py --config configs/%s.yaml 'docs/quoted.md'", F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string"))
    tasks = read(spark, sf_dir, "nation").select(F.col("n_name").alias("id"), command.alias("cmd"))
    files = read(spark, sf_dir, "region").where("r_regionkey < 3").select(F.format_string("scripts/%s.py", F.col("r_regionkey").cast("string")).alias("path"))
    return audit.missing_references(tasks, files)


@query("queue_insert", """SELECT CASE WHEN n_nationkey >= 10 THEN n_nationkey + 2 ELSE n_nationkey END::INT AS ord, n_name AS id FROM nation UNION ALL VALUES (10, 'first'), (11, 'second')""")
def _(spark, sf_dir):
    nation = read(spark, sf_dir, "nation")
    anchor = nation.where("n_nationkey = 10").first()["n_name"]
    tasks = nation.select(F.col("n_nationkey").cast("int").alias("ord"), F.col("n_name").alias("id"), F.lit(None).cast("int").alias("step"), F.lit("true").alias("cmd"), F.lit(None).cast("string").alias("note"))
    return audit.insert_tasks(tasks, [{"id": "first", "cmd": "true"}, {"id": "second", "cmd": "true"}], anchor).select("ord", "id")


@query("decision_feeders", """WITH e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst, 'train' AS kind FROM lineitem)
SELECT src, dst AS decision, kind FROM e UNION SELECT a.src, b.dst, a.kind FROM e a JOIN e b ON a.dst = b.src""")
def _(spark, sf_dir):
    edges = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.lit("train").alias("kind")).distinct()
    return audit.feeders(edges)


@query("queue_state", """WITH s AS (SELECT user_id, min(ts) FILTER (event_type = 'view') AS started, min(ts) FILTER (event_type = 'purchase') AS done FROM events GROUP BY user_id),
o AS (SELECT count(*) FILTER (done IS NULL) AS left_, count(*) FILTER (started IS NOT NULL AND done IS NULL) AS active, max(started) AS last FROM s)
SELECT 0::BIGINT AS failed, left_, active, CASE WHEN left_ = 0 THEN 'ALL-DONE' WHEN active > 0 AND epoch_us(TIMESTAMP '2030-01-01') - epoch_us(last) > 48 * 3600e6 THEN 'RUNNING-STALLED' ELSE 'RUNNING' END AS state FROM o""")
def _(spark, sf_dir):
    e, ts = F.col("event_type"), F.col("ts").cast("timestamp")
    states = read(spark, sf_dir, "events").groupBy("user_id").agg(F.min(F.when(e == "view", ts)).alias("started"), F.min(F.when(e == "purchase", ts)).alias("done"))
    states = states.withColumn("failed", F.lit(None).cast("timestamp")).withColumn("locked", F.lit(True))
    return audit.queue_state(states, F.lit("2030-01-01").cast("timestamp")).select("failed", F.col("left").alias("left_"), "active", "state")


@query("queue_sync", """WITH q AS (SELECT page_id AS file, sha256(html) AS h FROM pages WHERE page_id % 3 <> 0), c AS (SELECT page_id AS file, CASE WHEN page_id % 5 = 1 THEN 'other' ELSE sha256(html) END AS h FROM pages WHERE page_id % 4 <> 0)
SELECT coalesce(q.file, c.file) AS file, CASE WHEN q.h IS NULL THEN 'only in checkout' WHEN c.h IS NULL THEN 'only in queue' ELSE 'differs' END AS difference FROM q FULL JOIN c ON q.file = c.file WHERE q.h IS NULL OR c.h IS NULL OR q.h <> c.h""")
def _(spark, sf_dir):
    files = read(spark, sf_dir, "pages").select(F.col("page_id").alias("file"), F.sha2("html", 256).alias("sha256"))
    other = files.withColumn("sha256", F.when(F.col("file") % 5 == 1, "other").otherwise(F.col("sha256")))
    return audit.sync(files.where("file % 3 <> 0"), other.where("file % 4 <> 0"))


@query("event_sessions", """WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events WHERE ts IS NOT NULL),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def _(spark, sf_dir):
    found = ledger.sessions(read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("command_findings", """WITH t AS (SELECT c_custkey AS id, CASE c_nationkey % 4 WHEN 0 THEN 'spatial' WHEN 1 THEN 'fault' WHEN 2 THEN 'trace' ELSE 'other' END AS scheme, c_custkey % 3 = 0 AS stale, c_custkey % 5 = 0 AS off_, c_custkey % 7 = 0 AS few FROM customer)
SELECT id::VARCHAR AS id, unnest(list_filter([CASE WHEN few THEN 'ARG-COUNT' END, CASE WHEN NOT few AND scheme = 'other' THEN 'BAD-SCHEME' END, CASE WHEN NOT few AND scheme <> 'other' AND stale THEN 'STALE-FOLD-MAP' END,
CASE WHEN NOT few AND scheme <> 'other' AND off_ THEN 'BAD-GATE-DIR' END], lambda x: x IS NOT NULL)) AS kind FROM t""")
def _(spark, sf_dir):
    k = F.col("c_custkey")
    scheme = F.element_at(F.array(*map(F.lit, ("spatial", "fault", "trace", "other"))), (F.col("c_nationkey") % 4 + 1).cast("int"))
    place = F.when(k % 7 == 0, "").when(k % 5 == 0, "elsewhere").otherwise("runs/gate/x")
    cmd = F.concat(F.lit("q/score_view.sh runs/ref-cv-"), scheme, F.lit(" "), scheme, F.when(k % 3 == 0, " old.tif ").otherwise(" now.tif "), place)
    tasks = read(spark, sf_dir, "customer").select(k.alias("id"), cmd.alias("cmd"))
    return commands.command_findings(tasks, dict.fromkeys(commands.SCHEMES, "now.tif")).select("id", "kind")


#: Tasks of a queue by event: train, score and record of a step and a target, in the order of events.
STEPS = """s AS (SELECT event_id AS idx, (user_id % 50)::VARCHAR AS step, (user_id // 50)::VARCHAR AS target, CASE event_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'score' ELSE 'record' END AS op FROM events)"""


@query("order_triples", f"""WITH {STEPS}, p AS (SELECT step, target, max(idx) FILTER (op = 'train') AS t, max(idx) FILTER (op = 'score') AS s, max(idx) FILTER (op = 'record') AS r FROM s GROUP BY ALL),
x AS (SELECT step, target, 'train' AS earlier, 'score' AS later, t AS earlier_idx, s AS later_idx FROM p UNION ALL SELECT step, target, 'train', 'record', t, r FROM p UNION ALL SELECT step, target, 'score', 'record', s, r FROM p)
SELECT * FROM x WHERE earlier_idx > later_idx""")
def _(spark, sf_dir):
    op = F.element_at(F.array(*map(F.lit, queue.OPERATIONS)), (F.col("event_id") % 3 + 1).cast("int"))
    steps = read(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), (F.col("user_id") % 50).cast("string").alias("step"), F.floor(F.col("user_id") / 50).cast("string").alias("target"), op.alias("op"))
    return queue.triple_findings(steps)


#: Orders as commands: a run for each customer, trained, scored, recorded, compared and gated in no good order.
@query("order_audit", """WITH o AS (SELECT o_orderkey AS idx, 't' || o_orderkey AS id, o_orderkey % 5 AS kind, 'r' || o_custkey AS run, CASE o_orderkey % 3 WHEN 0 THEN 'spatial' WHEN 1 THEN 'fault' ELSE 'trace' END AS view FROM orders),
makes AS (SELECT idx, id, 'pred:' || run AS artifact FROM o WHERE kind = 0 UNION ALL SELECT idx, id, unnest(['score:' || run, 'lofo:' || run || '/' || view, 'gate:g/' || run || '/' || view]) FROM o WHERE kind = 1
  UNION ALL SELECT idx, id, 'gate:h/' || run || '/' || view FROM o WHERE kind = 4),
needs AS (SELECT idx, id, 'pred:' || run AS artifact FROM o WHERE kind = 1 UNION ALL SELECT idx, id, 'score:' || run FROM o WHERE kind = 2
  UNION ALL SELECT DISTINCT idx, id, 'gate:' || d || '/' || run || '/' || v FROM o, (SELECT unnest(['g', 'h']) AS d), (SELECT unnest(['spatial', 'fault', 'trace']) AS v) WHERE kind = 3
  UNION ALL SELECT idx, id, 'gate:g/' || run || '/' || view FROM o WHERE kind = 4),
p AS (SELECT artifact, min(idx) AS producer_idx, min_by(id, idx) AS producer FROM makes GROUP BY artifact)
SELECT n.artifact, n.id AS consumer, n.idx AS consumer_idx, p.producer, p.producer_idx, CASE WHEN p.producer IS NULL THEN 'NO-PRODUCER' ELSE 'ORDER-VIOLATION' END AS kind
FROM needs n LEFT JOIN p USING (artifact) WHERE p.producer IS NULL OR p.producer_idx >= n.idx""")
def _(spark, sf_dir):
    run, view = F.concat(F.lit("r"), F.col("o_custkey")), F.element_at(F.array(*map(F.lit, queue.VIEWS)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    words = lambda *x: F.concat_ws(" ", *[F.lit(v) if isinstance(v, str) else v for v in x])
    kind = F.col("o_orderkey") % 5
    g, h = (F.concat(F.lit(d), run) for d in ("g/", "h/"))
    cmd = F.when(kind == 0, words("bash scripts/queue/train_folds.sh", run, "16")).when(kind == 1, words("bash scripts/queue/score_view.sh", run, view, "x", g)).when(kind == 2, words("scripts/queue/record.sh name", run))
    cmd = cmd.when(kind == 3, words("scripts/queue/gate.sh n", g, h)).otherwise(F.concat(F.lit("mkdir -p "), h, F.lit(" && cp -f "), g, F.lit("/"), view, F.lit(".json "), h, F.lit("/")))
    return queue.order_audit(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), F.concat(F.lit("t"), "o_orderkey").alias("id"), cmd.alias("cmd")))


#: A task an order, which makes the artifact of its number and needs those of smaller numbers; done if its status is F. A customer decides on artifacts of open orders.
GRAPH = """makes AS (SELECT o_orderkey AS id, o_orderkey AS artifact FROM orders), over AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'),
needs AS (SELECT DISTINCT l_orderkey AS id, l_orderkey // (l_linenumber + 1) AS artifact FROM lineitem), there AS (SELECT id AS artifact FROM over),
decisions AS (SELECT o_custkey AS decision, o_orderkey AS artifact FROM orders WHERE o_orderstatus <> 'F')"""
FEEDERS = f"""WITH RECURSIVE {GRAPH}, edges AS MATERIALIZED (SELECT DISTINCT m.id AS src, n.id FROM needs n JOIN makes m USING (artifact) WHERE m.id NOT IN (SELECT id FROM over) AND n.artifact NOT IN (SELECT artifact FROM there)),
f AS (SELECT d.decision, m.id FROM decisions d JOIN makes m USING (artifact) WHERE m.id NOT IN (SELECT id FROM over) AND d.artifact NOT IN (SELECT artifact FROM there) UNION SELECT f.decision, e.src FROM f JOIN edges e ON e.id = f.id)"""


def graph(spark, sf_dir):
    orders, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    makes = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("artifact"))
    done = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    needs = lines.select(F.col("l_orderkey").alias("id"), F.floor(F.col("l_orderkey") / (F.col("l_linenumber") + 1)).alias("artifact"))
    decisions = orders.where("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("decision"), F.col("o_orderkey").alias("artifact"))
    return decisions, needs, makes, done.withColumnRenamed("id", "artifact"), done


@query("all_feeders", FEEDERS + " SELECT decision, id FROM f")
def _(spark, sf_dir):
    return queue.all_feeders(*graph(spark, sf_dir))


@query("resume_order", FEEDERS + """, t AS (SELECT id, count(*) AS n FROM f GROUP BY id), l AS (SELECT id, count(DISTINCT artifact) AS n FROM needs WHERE artifact NOT IN (SELECT artifact FROM there) GROUP BY id)
SELECT row_number() OVER (ORDER BY coalesce(t.n, 0) DESC, m.id) AS place, m.id, m.id AS idx, coalesce(t.n, 0) AS decisions, coalesce(l.n, 0) AS lacking, l.n IS NULL AS runnable
FROM makes m LEFT JOIN t USING (id) LEFT JOIN l USING (id) WHERE m.id NOT IN (SELECT id FROM over)""")
def _(spark, sf_dir):
    decisions, needs, makes, present, done = graph(spark, sf_dir)
    return queue.resume_order(makes.select("id", F.col("artifact").alias("idx")), decisions, needs, makes, present, done)


@query("decision_inputs", f"""WITH {GRAPH}, want AS (SELECT n.id AS decision, n.artifact FROM needs n WHERE n.artifact % 7 <> 3),
made AS (SELECT artifact, count(*) FILTER (o.id IS NULL) AS producers FROM (SELECT id, artifact + 1 AS artifact FROM makes) m LEFT JOIN over o USING (id) GROUP BY artifact)
SELECT decision, artifact, coalesce(producers, 0) AS producers, CASE WHEN producers IS NULL THEN 'NO-PRODUCER' WHEN producers = 0 THEN 'EVIDENCE-ELSEWHERE' END AS flag FROM want LEFT JOIN made USING (artifact) WHERE artifact NOT IN (SELECT artifact FROM there)""")
def _(spark, sf_dir):
    _, needs, makes, present, done = graph(spark, sf_dir)
    return queue.decision_inputs(needs.where("artifact % 7 <> 3").distinct().withColumnRenamed("id", "decision"), makes.withColumn("artifact", F.col("artifact") + 1), present, done)
