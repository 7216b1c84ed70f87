"""Queries: stencils, gating, audits and event windows over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.operators import audit, calibration, components, gate, geometry, metric, provenance, stencils, threshold
from gridloom.plans import stencil_sql
from gridloom.plans.collect import Plans
from gridloom.plans.raster import RASTER, raster
from gridloom.plans.spatial import reach_sql
from gridloom.plans.scoring import LOFO, curve_sql, rounded, score_at
from gridloom.streaming import ledger, states

query = Plans()


def sized(spark, sf_dir):
    return raster(spark, sf_dir).withColumn("fit", F.col("fold") != 0), spark.read.parquet(f"{sf_dir}/embeddings.parquet").count(), 64


@query("masked_gaussian", stencil_sql.GAUSSIAN)
def _(spark, sf_dir):
    cells, h, w = sized(spark, sf_dir)
    return rounded(stencils.smoothed(cells, "v", 1.0, h, w))


@query("structure_tensor", stencil_sql.TENSOR)
def _(spark, sf_dir):
    cells, h, w = sized(spark, sf_dir)
    return rounded(stencils.structure_tensor(cells, ["v"], 1.0, 2.0, h, w))


@query("ridge_valley", stencil_sql.RIDGES)
def _(spark, sf_dir):
    cells, h, w = sized(spark, sf_dir)
    return rounded(stencils.ridge_valley(cells, ["v"], [1.0, 2.0], 1.0, "fit", h, w))


@query("steerable", stencil_sql.STEERABLE)
def _(spark, sf_dir):
    cells, h, w = sized(spark, sf_dir)
    return rounded(stencils.steerable(cells, ["v"], 1.0, 6.0, 4, "fit", h, w))


@query("log_edges", stencil_sql.LOG_EDGES)
def _(spark, sf_dir):
    cells, h, w = sized(spark, sf_dir)
    return rounded(stencils.log_edges(cells, ["v"], 1.0, 1.0, "fit", h, w))


WAVELET = stencil_sql.HEAD + stencil_sql.smooth("g", "base", 1.0) + """, z AS (SELECT row, col, valid, x FROM g), n AS (SELECT max(row) AS h, max(col) AS w FROM z),
s AS (SELECT z.*, d, CASE WHEN col + d > w THEN 2 * w - col - d ELSE col + d END AS beside, CASE WHEN row + d > h THEN 2 * h - row - d ELSE row + d END AS below FROM z CROSS JOIN n CROSS JOIN (SELECT unnest([1, 2, 4]) AS d) AS l),
e AS (SELECT s.row, s.col, s.valid, s.d, ((s.x + b.x) / 2 - (c.x + e.x) / 2) ** 2 + ((s.x - b.x) / 2 + (c.x - e.x) / 2) ** 2 + ((s.x - b.x) / 2 - (c.x - e.x) / 2) ** 2 AS e
  FROM s JOIN z AS b ON b.row = s.row AND b.col = s.beside JOIN z AS c ON c.row = s.below AND c.col = s.col JOIN z AS e ON e.row = s.below AND e.col = s.beside),
t AS (SELECT *, sum(e) OVER (PARTITION BY row, col) AS whole FROM e)
SELECT row, col, round(CASE WHEN bool_or(valid AND whole > 1e-12) THEN greatest(-sum(e / (whole + 1e-12) * ln(e / (whole + 1e-12) + 1e-12)), 0) ELSE 0 END, 5) + 0.0 AS entropy FROM t GROUP BY row, col"""


@query("wavelet_entropy", WAVELET)
def _(spark, sf_dir):
    cells, h, w = sized(spark, sf_dir)
    return stencils.wavelet_entropy(cells, ["v"], 1.0, [1, 2, 3], h, w).withColumn("entropy", F.round("entropy", 5) + 0.0)


@query("multiband_edges", stencil_sql.MULTIBAND)
def _(spark, sf_dir):
    cells, h, w = sized(spark, sf_dir)
    return rounded(stencils.multiband_edges(cells, ["v", "p"], 1.0, 0.1, "fit", h, w))


@query("lineament_phase_edge", stencil_sql.PHASE)
def _(spark, sf_dir):
    cells, h, w = sized(spark, sf_dir)
    return rounded(stencils.lineament_features(cells, {"both": ["v", "p"]}, "phase_edge", "fit", h, w))


@query("soft_skeleton", stencil_sql.SOFT)
def _(spark, sf_dir):
    cells, h, w = sized(spark, sf_dir)
    return rounded(stencils.skeletons(cells, h, w))


@query("skeleton_recall_loss", stencil_sql.RECALL)
def _(spark, sf_dir):
    cells, h, w = sized(spark, sf_dir)
    return rounded(stencils.skeleton_recall_loss(stencils.skeletons(cells, h, w)))


#: Passes of half an iteration, more than the raster of any of the tables needs; the ring's cells are bits from the north, clockwise.
THIN_STEPS = """o(dy, dx, bit) AS (VALUES (-1, 0, 1), (-1, 1, 2), (0, 1, 4), (1, 1, 8), (1, 0, 16), (1, -1, 32), (0, -1, 64), (-1, -1, 128)),
z(i, row, col) AS (
  SELECT 0, row, col FROM m
  UNION ALL
  SELECT i + 1, row, col FROM (
    SELECT a.i, a.row, a.col, coalesce(sum(CASE WHEN b.row IS NOT NULL THEN bit ELSE 0 END), 0)::INT AS ring FROM z a CROSS JOIN o LEFT JOIN z b ON b.row = a.row + dy AND b.col = a.col + dx GROUP BY ALL)
  WHERE i < 40 AND NOT (bit_count(ring) BETWEEN 2 AND 6 AND bit_count((255 - ring) & ((ring >> 1) | ((ring & 1) << 7))) = 1
    AND CASE WHEN i % 2 = 0 THEN ring & 69 <> 69 AND ring & 81 <> 81 ELSE ring & 21 <> 21 AND ring & 84 <> 84 END)
)"""
THIN = f"""{reach_sql("v > 0.1")}, {THIN_STEPS}
SELECT l.component::BIGINT AS component, z.row, z.col FROM z JOIN labelled l ON l.row = z.row AND l.col = z.col WHERE i = 40"""


@query("thinning", THIN)
def _(spark, sf_dir):
    return geometry.thin_components(components.label(raster(spark, sf_dir).where("v > 0.1"), tile=32))


def tips_sql(cells: str, window: int, turned: str, inside: str = "true") -> str:
    """CTEs: d (row, col, dy, dx), the ends of the cells of ``cells`` and the direction out of them."""
    return f"""tips AS (SELECT a.row, a.col FROM {cells} a JOIN {cells} b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND (a.row <> b.row OR a.col <> b.col) GROUP BY a.row, a.col HAVING count(*) = 1),
s AS (SELECT t.row, t.col, covar_pop(m.row - t.row, m.row - t.row) AS a, covar_pop(m.row - t.row, m.col - t.col) AS b, covar_pop(m.col - t.col, m.col - t.col) AS c, avg(m.row - t.row) AS my, avg(m.col - t.col) AS mx
  FROM tips t JOIN {cells} m ON abs(m.row - t.row) <= {window} AND abs(m.col - t.col) <= {window} GROUP BY t.row, t.col HAVING count(*) >= 3),
u AS (SELECT row, col, my, mx, round(cos(atan2(2 * b, a - c) / 2), 12) AS uy, round(sin(atan2(2 * b, a - c) / 2), 12) AS ux FROM s),
away AS (SELECT row, col, CASE WHEN uy * my + ux * mx > 0 THEN -uy ELSE uy END AS dy, CASE WHEN uy * my + ux * mx > 0 THEN -ux ELSE ux END AS dx FROM u),
back AS (SELECT row AS r, col AS c, dy, dx, trunc(row - k * dy)::BIGINT AS row, trunc(col - k * dx)::BIGINT AS col FROM away, (SELECT unnest([1, 2, 3]) AS k)),
body AS (SELECT r, c, dy, dx, count(*) FILTER ({inside}) AS inside, count(m.row) FILTER ({inside}) AS body FROM back x LEFT JOIN {cells} m ON m.row = x.row AND m.col = x.col GROUP BY r, c, dy, dx),
d AS (SELECT r AS row, c AS col, CASE WHEN {turned} THEN -dy ELSE dy END AS dy, CASE WHEN {turned} THEN -dx ELSE dx END AS dx FROM body)"""


EXTENSION = f"""WITH {RASTER}, m AS (SELECT row, col FROM raster WHERE v > 0.2), size AS (SELECT max(row) AS h FROM raster),
{tips_sql("m", 5, "inside > 0 AND body < 0.5 * inside", "x.row >= 0 AND x.row <= (SELECT h FROM size) AND x.col >= 0 AND x.col < 64")},
steps AS (SELECT d.row AS r, d.col AS c, step, p * exp(-0.1 * step) AS paint, round_even(d.row + dy * step, 0)::BIGINT AS row, round_even(d.col + dx * step, 0)::BIGINT AS col
  FROM d JOIN raster USING (row, col), (SELECT unnest([1, 2, 3, 4, 5]) AS step) WHERE p >= 0.01),
met AS (SELECT s.*, coalesce(v > 0.2 OR abs(v) * 4 < 0.3, true) AS blocked FROM steps s LEFT JOIN raster x ON x.row = s.row AND x.col = s.col),
open_ AS (SELECT *, min(CASE WHEN blocked THEN step END) OVER (PARTITION BY r, c) AS stop FROM met)
SELECT row, col, round(max(paint), 6) AS p FROM open_ WHERE stop IS NULL OR step < stop GROUP BY row, col"""


@query("endpoint_extension", EXTENSION)
def _(spark, sf_dir):
    cells, h, w = sized(spark, sf_dir)
    cells = cells.withColumn("skeleton", F.col("v") > 0.2).withColumn("edge", F.abs("v") * 4)
    skeleton = cells.where("skeleton")
    tips = geometry.orientations(geometry.endpoints(skeleton), skeleton, 5, 0.5, h, w)
    return rounded(geometry.extend(tips, cells, 5, edge="edge"))


#: All paths of up to three moves, so a beam of 27 leaves none out.
CURVED = f"""WITH RECURSIVE {RASTER}, m AS MATERIALIZED (SELECT row, col FROM raster WHERE valid AND p >= 0.6), {THIN_STEPS},
sk AS MATERIALIZED (SELECT row, col FROM z WHERE i = 40), {tips_sql("sk", 15, "body = 0")},
best AS (SELECT t.row, t.col, round(avg(r.p), 9) AS mean FROM tips t JOIN raster r ON abs(r.row - t.row) <= 1 AND abs(r.col - t.col) <= 1 GROUP BY t.row, t.col ORDER BY mean DESC, t.row, t.col LIMIT 200),
h(k, dr, dc) AS (VALUES (0, 0, 1), (1, 1, 1), (2, 1, 0), (3, 1, -1), (4, 0, -1), (5, -1, -1), (6, -1, 0), (7, -1, 1)),
g(tr, tc, depth, row, col, k, cost, path, ps) AS (
  SELECT d.row, d.col, 0, d.row, d.col, (round_even(atan2(dy, dx) / (pi() / 4), 0)::INT + 8) % 8, 0::DOUBLE, [d.row * 1000 + d.col], []::DOUBLE[] FROM d JOIN best b ON b.row = d.row AND b.col = d.col
  UNION ALL
  SELECT tr, tc, depth + 1, r.row, r.col, h.k, cost - ln(r.p + 1e-6) + 0.5 * (turn * pi() / 4) ** 2, list_append(path, r.row * 1000 + r.col), list_append(ps, r.p)
  FROM g CROSS JOIN (SELECT unnest([-1, 0, 1]) AS turn) JOIN h ON h.k = (g.k + turn + 8) % 8 JOIN raster r ON r.row = g.row + dr AND r.col = g.col + dc
  WHERE depth < 3 AND r.valid AND r.p >= 0.3 AND NOT list_contains(path, r.row * 1000 + r.col)
), chosen AS (SELECT * FROM g WHERE depth >= 2 QUALIFY row_number() OVER (PARTITION BY tr, tc ORDER BY depth DESC, cost) = 1),
paint AS (SELECT unnest(path[2:]) AS cell, 0.6 * exp(-0.15 * unnest(range(depth))) AS paint FROM chosen WHERE list_avg(ps) >= 0.4)
SELECT r.row, r.col, round(greatest(r.p, coalesce(max(x.paint), 0)), 6) AS p FROM raster r LEFT JOIN paint x ON x.cell = r.row * 1000 + r.col GROUP BY r.row, r.col, r.p"""


@query("curved_paths", CURVED)
def _(spark, sf_dir):
    cells = raster(spark, sf_dir).select("row", "col", "p", "valid")
    return rounded(geometry.curved_continuation(cells, 0.6, width=27, shortest=2)[0].drop("valid"))


@query("curved_diagnostics", f"""WITH RECURSIVE {RASTER}, m AS MATERIALIZED (SELECT row, col FROM raster WHERE valid AND p >= 0.6), {THIN_STEPS}, sk AS MATERIALIZED (SELECT row, col FROM z WHERE i = 40), {tips_sql("sk", 15, "body = 0")}
SELECT (SELECT count(*) FROM sk) AS skeleton_pixels, (SELECT count(*) FROM tips) AS endpoints, 200 AS budget, 3 AS max_steps""")
def _(spark, sf_dir):
    return geometry.curved_continuation(raster(spark, sf_dir).select("row", "col", "p", "valid"), 0.6)[1]


OTHERS = "(SELECT r.* EXCLUDE (fold), k AS fold FROM raster r JOIN (SELECT DISTINCT fold AS k FROM raster) ON r.fold <> k)"
STITCHED = f"""WITH fitted AS ({curve_sql("fold", OTHERS)} SELECT fold, max_by(threshold, (score, threshold)) AS threshold FROM curve GROUP BY fold),
own AS MATERIALIZED ({curve_sql("fold")} SELECT fold, threshold, score FROM curve)
SELECT f.fold, round(f.threshold, 6) + 0.0 AS threshold, round({score_at("own", "f.fold", "f.threshold")}, 6) + 0.0 AS score FROM fitted f"""


@query("lofo_stitched", STITCHED)
def _(spark, sf_dir):
    return rounded(calibration.lofo_stitched(raster(spark, sf_dir)))


RIVAL = f"""WITH own AS MATERIALIZED ({curve_sql("fold")} SELECT fold, threshold, score FROM curve),
fitted AS ({LOFO} SELECT fold, max_by(candidate, (round(fit_mean, 12), -candidate)) AS threshold FROM fit GROUP BY fold),
both_ AS (SELECT f.fold, {score_at("own", "f.fold", "0.1")} AS rival, {score_at("own", "f.fold", "f.threshold")} AS lofo FROM fitted f)
SELECT fold, round(rival, 6) + 0.0 AS rival, round(lofo, 6) + 0.0 AS lofo, round(rival - lofo, 6) + 0.0 AS delta FROM both_"""


@query("rival_threshold", RIVAL)
def _(spark, sf_dir):
    cells = raster(spark, sf_dir)
    return rounded(calibration.rival_scores(cells, calibration.rival_threshold(0.5), threshold.lofo_thresholds(threshold.threshold_curve(cells, ["fold"]))))


DISJOINT = f"""WITH fitted AS ({curve_sql("", "(SELECT * FROM raster WHERE fold < 3)")} SELECT max_by(threshold, (score, threshold)) AS threshold, max(score) AS score FROM curve),
held AS MATERIALIZED ({curve_sql("", "(SELECT * FROM raster WHERE fold >= 3)")} SELECT 0 AS fold, threshold, score FROM curve)
SELECT round(f.threshold, 6) + 0.0 AS threshold, round(f.score, 6) + 0.0 AS fit_score, round({score_at("held", "0", "f.threshold")}, 6) + 0.0 AS evaluation_score FROM fitted f"""


@query("disjoint_calibration", DISJOINT)
def _(spark, sf_dir):
    cells = raster(spark, sf_dir).withColumn("fit", F.col("valid") & (F.col("fold") < 3)).withColumn("evaluate", F.col("valid") & (F.col("fold") >= 3))
    return rounded(calibration.fit_and_evaluate(cells))


@query("own_fold_threshold", curve_sql("fold") + " SELECT fold, round(CASE WHEN max(n_truth) = 0 THEN 0.5 ELSE max_by(threshold, (score, threshold)) END, 6) AS threshold FROM curve JOIN truths USING (fold) GROUP BY fold")
def _(spark, sf_dir):
    return rounded(calibration.own_fold_thresholds(raster(spark, sf_dir)))


@query("soft_tversky_loss", f"""WITH {RASTER}, s AS (SELECT sum(p * truth::INT) AS tp, sum(p * (1 - truth::INT)) AS fp, sum((1 - p) * truth::INT) AS fn FROM raster WHERE valid)
SELECT round(1 - tp / (tp + 0.2 * fp + 0.8 * fn + 1e-12), 6) AS loss FROM s""")
def _(spark, sf_dir):
    return rounded(calibration.training_loss({"loss": "tversky"})(raster(spark, sf_dir)).select("loss"))


@query("fold_preview", f"WITH {RASTER} SELECT row // 4 AS row, col // 4 AS col, CASE WHEN bool_or(truth AND valid) THEN 255 ELSE 0 END AS r, (max(p) FILTER (valid) * 255)::INT AS g, CASE WHEN bool_or(valid) THEN 64 ELSE 0 END AS b FROM raster GROUP BY ALL")
def _(spark, sf_dir):
    return provenance.preview(raster(spark, sf_dir), 4)


@query("baseline_classifier")
def _(spark, sf_dir):
    cells = raster(spark, sf_dir).withColumn("train", F.col("fold") != 0)
    model = provenance.fit_cells(cells, ["v"], "train")
    return rounded(metric.tversky(provenance.predict_cells(model, cells.where("fold = 0"))))


@query("ablation_summary", """WITH s AS (SELECT l_returnflag AS variant, l_linenumber AS fold, avg(l_discount) AS score FROM lineitem GROUP BY ALL), b AS (SELECT fold, score AS base FROM s WHERE variant = 'A')
SELECT variant, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(avg(score - base), 6) + 0.0 AS delta, count(*) FILTER (score > base) AS wins, count(*) FILTER (score < base) AS losses, count(*) FILTER (score = base) AS ties,
count(*) FILTER (score IS NULL OR base IS NULL) AS unmatched FROM s FULL JOIN b USING (fold) GROUP BY variant""")
def _(spark, sf_dir):
    scores = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_returnflag").alias("variant"), F.col("l_linenumber").alias("fold")).agg(F.avg("l_discount").alias("score"))
    return rounded(gate.ablation_summary(scores, "A"))


#: One-sided p for seven folds (six degrees of freedom), by the finite sum.
COS2 = "(6 / (6 + (avg(d) / (stddev_samp(d) / sqrt(count(d)))) ** 2))"
P_VALUE = f"round(0.5 - (avg(d) / (stddev_samp(d) / sqrt(count(d)))) / sqrt(6 + (avg(d) / (stddev_samp(d) / sqrt(count(d)))) ** 2) / 2 * (1 + {COS2} / 2 + 3 * {COS2} ** 2 / 8), 6)"
GATED = """WITH s AS (SELECT l_linestatus AS view, l_returnflag AS run, l_linenumber AS fold, avg(l_tax) AS score FROM lineitem GROUP BY ALL),
d AS (SELECT view, fold, max(score) FILTER (run = 'R') - max(score) FILTER (run = 'N') AS d FROM s WHERE run IN ('R', 'N') GROUP BY view, fold)"""


def gated_scores(spark, sf_dir):
    keys = [F.col("l_linestatus").alias("view"), F.col("l_returnflag").alias("run"), F.col("l_linenumber").alias("fold")]
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(*keys).agg(F.avg("l_tax").alias("score")).where("run in ('R', 'N')")


@query("candidate_decision", GATED + f""", g AS (SELECT view, avg(d) AS gain, {P_VALUE} AS p FROM d GROUP BY view)
SELECT count(*) AS views, round(0.05 / (count(*) * 4), 6)::DOUBLE AS alpha, count(*) FILTER (p < 0.05 / ((SELECT count(*) FROM g) * 4) AND gain > 0) AS won,
count(*) FILTER (p < 0.05 / ((SELECT count(*) FROM g) * 4) AND gain > 0) >= 2 AS accepted FROM g""")
def _(spark, sf_dir):
    return rounded(gate.evaluate_candidate(gated_scores(spark, sf_dir), "N", "R", 3))


@query("paired_gate", """WITH s AS (SELECT l_linestatus AS view, l_returnflag AS run, l_linenumber AS fold, avg(l_tax) AS score FROM lineitem GROUP BY ALL),
d AS (SELECT view, fold, max(score) FILTER (run = 'R') - max(score) FILTER (run = 'N') AS d FROM s WHERE run IN ('R', 'N') GROUP BY view, fold)
SELECT view, count(d) AS n, round(avg(d), 6) + 0.0 AS mean_difference, round(stddev_samp(d) / sqrt(count(d)), 6) AS std_error, round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 6) AS t,
""" + P_VALUE + """ AS p FROM d WHERE d IS NOT NULL GROUP BY view""")
def _(spark, sf_dir):
    keys = [F.col("l_linestatus").alias("view"), F.col("l_returnflag").alias("run"), F.col("l_linenumber").alias("fold")]
    scores = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(*keys).agg(F.avg("l_tax").alias("score"))
    return rounded(gate.paired_gate(scores, ["view"], "N", "R"))


@query("lofo_audit", """WITH f AS (SELECT event_type AS run, 'spatial' AS scheme, user_id % 5 AS fold, avg(value) / 100 AS threshold, max(value) / 100 AS top FROM events GROUP BY ALL),
g AS (SELECT run, scheme, avg(threshold) AS m, min(threshold) AS lo, max(threshold) AS hi, stddev_pop(threshold) AS s, avg(threshold) AS raw, avg(top) AS calibrated FROM f GROUP BY run, scheme)
SELECT run, scheme, round(m, 6) AS threshold_mean, round(lo, 6) AS threshold_min, round(hi, 6) AS threshold_max, round(s, 6) AS threshold_std, round(raw, 6) AS raw_mean, round(calibrated, 6) AS calibrated_mean,
round(hi - lo, 6) AS threshold_range, round(calibrated - raw, 6) AS gain, round((calibrated - raw) / calibrated, 6) AS gain_share,
concat_ws(',', CASE WHEN hi >= 0.999 THEN 'CEILING' END, CASE WHEN hi - lo > 0.05 THEN 'UNSTABLE' END, CASE WHEN (calibrated - raw) / calibrated > 0.20 THEN 'CALIBRATION_DOMINATED' END) AS flags FROM g""")
def _(spark, sf_dir):
    value = F.col("value") / 100
    folds = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("event_type").alias("run"), (F.col("user_id") % 5).alias("fold")).agg(F.avg(value).alias("threshold"), F.max(value).alias("top"))
    run = Window.partitionBy("run")
    folds = folds.withColumns({"scheme": F.lit("spatial"), "raw_mean": F.avg("threshold").over(run), "calibrated_mean": F.avg("top").over(run)})
    return rounded(audit.lofo_audit(folds).withColumn("flags", F.array_join("flags", ",")))


@query("drain_forecast", """WITH o AS (SELECT count(ts) AS n, min(ts) AS first, max(ts) AS last FROM events), r AS (SELECT *, n / (epoch_us(last) / 1e6 - epoch_us(first) / 1e6) * 86400 AS rate FROM o)
SELECT n, round(rate, 6) AS rate, round((epoch_us(TIMESTAMP '2024-02-10') - epoch_us(last)) / 86400e6, 6) AS silence_days, round(5000 / rate, 6) AS drain_days, round(20 - 5000 / rate, 6) AS margin_days,
CASE WHEN 20 - 5000 / rate >= 5 THEN 'FEASIBLE' WHEN 20 - 5000 / rate >= 0 THEN 'TIGHT' ELSE 'INFEASIBLE' END AS verdict FROM r""")
def _(spark, sf_dir):
    at = lambda s: F.lit(s).cast("timestamp")
    out = audit.drain_forecast(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts")), 5000, at("2024-02-10"), at("2024-03-01"))
    return rounded(out.drop("first", "last", "resume_by", "resume_by_buffered"))


@query("duplicate_audit", """SELECT kind, value, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (
SELECT 'url' AS kind, url AS value, page_id::VARCHAR AS id FROM pages UNION ALL SELECT 'digest', sha256(html), page_id::VARCHAR FROM pages) WHERE value IS NOT NULL GROUP BY kind, value HAVING count(*) > 1""")
def _(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("id"), "url", F.sha2("html", 256).alias("digest"))
    return audit.duplicates(rows, ["url", "digest"])


@query("hash_manifest", "SELECT page_id, strlen(html) AS bytes, sha256(html) AS sha256 FROM pages")
def _(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.octet_length("html").cast("long").alias("bytes"), F.sha2("html", 256).alias("sha256"))


@query("band_statistics", f"""WITH {RASTER}, l AS (SELECT 'p' AS band, p AS x FROM raster UNION ALL SELECT 'v', v FROM raster)
SELECT band, count(*) AS n, round(min(x), 6) AS low, round(max(x), 6) AS high, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(quantile_cont(x, 0.01), 6) AS q01, round(quantile_cont(x, 0.5), 6) AS q50, round(quantile_cont(x, 0.99), 6) AS q99 FROM l GROUP BY band""")
def _(spark, sf_dir):
    return rounded(audit.band_statistics(raster(spark, sf_dir), ["p", "v"]))


@query("mask_differences", f"WITH {RASTER} SELECT count(*) FILTER (valid AND NOT truth) AS only_valid, count(*) FILTER (truth AND NOT valid) AS only_truth, count(*) FILTER (valid AND truth) AS both FROM raster")
def _(spark, sf_dir):
    return audit.mask_differences(raster(spark, sf_dir), "valid", "truth")


@query("order_violations", """WITH p AS (SELECT o_custkey AS artifact, min(o_orderkey) AS producer_idx FROM orders GROUP BY 1), c AS (SELECT c_custkey AS artifact, c_custkey * 7 AS idx, c_name AS id FROM customer)
SELECT artifact, id AS consumer, producer_idx FROM c LEFT JOIN p USING (artifact) WHERE producer_idx IS NULL OR producer_idx >= idx""")
def _(spark, sf_dir):
    producers = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("artifact"), F.col("o_orderkey").alias("idx"))
    consumers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("artifact"), (F.col("c_custkey") * 7).alias("idx"), F.col("c_name").alias("id"))
    return audit.order_violations(consumers, producers)


@query("furthest_stage", """SELECT user_id AS run, CASE max(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 4 ELSE 3 END) WHEN 1 THEN 'PENDING' WHEN 2 THEN 'TRAINED' WHEN 3 THEN 'SCORED' ELSE 'RECORDED' END AS stage FROM events GROUP BY user_id""")
def _(spark, sf_dir):
    e = F.col("event_type")
    stage = F.when(e == "view", "PENDING").when(e == "click", "TRAINED").when(e == "purchase", "RECORDED").otherwise("SCORED")
    return audit.furthest_stage(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("run"), stage.alias("stage")))


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return ledger.activity(events).withColumn("total", F.round("total", 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("task_chains", """WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey >= 2 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey >= 3),
n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
up(node, d) AS (SELECT node, 0 FROM n UNION SELECT e.dst, d + 1 FROM up JOIN e ON e.src = up.node), down(node, d) AS (SELECT node, 0 FROM n UNION SELECT e.src, d + 1 FROM down JOIN e ON e.dst = down.node),
b AS (SELECT node, max(d)::BIGINT AS before FROM up GROUP BY node), a AS (SELECT node, max(d)::BIGINT AS after FROM down GROUP BY node)
SELECT node, before, after, before + after = (SELECT max(before + after) FROM a JOIN b USING (node)) AS critical FROM a JOIN b USING (node)""")
def _(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    step = lambda k: part.where(F.col("p_partkey") >= k).select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / k).alias("dst"))
    return audit.chains(step(2).union(step(3)))


def discovery_sql(trace: bool) -> str:
    known = "fold <> k" if trace else "fold <> k AND fold >= 0"
    return f"""WITH {RASTER}, disk AS (SELECT y.range - 2 AS dy, x.range - 2 AS dx FROM range(5) y, range(5) x WHERE (y.range - 2) ** 2 + (x.range - 2) ** 2 <= 4),
offsets AS (SELECT y.range - 2 AS dy, x.range - 2 AS dx, 1 - sqrt((y.range - 2) ** 2 + (x.range - 2) ** 2) / 3 AS w FROM range(5) y, range(5) x),
v AS (SELECT row, col, p, truth, CASE WHEN truth AND col % 3 <> 0 THEN fold ELSE -1 END AS fold FROM raster WHERE valid), folds AS (SELECT DISTINCT fold AS k FROM v WHERE truth AND fold >= 0),
near AS (SELECT DISTINCT k, row + dy AS row, col + dx AS col FROM v, folds, disk WHERE truth AND {known}),
cell AS MATERIALIZED (SELECT k AS fold, row, col, p * (1 - k / 10.0::DOUBLE) AS p, truth AND v.fold = k AS truth FROM v CROSS JOIN folds LEFT JOIN (SELECT *, true AS out_ FROM near) n USING (k, row, col) WHERE out_ IS NULL),
pairs AS (SELECT t.fold, t.row AS tr, t.col AS tc, c.row, c.col, c.p, o.w FROM cell t, offsets o JOIN cell c ON c.row = t.row + o.dy AND c.col = t.col + o.dx AND c.fold = t.fold WHERE t.truth),
best AS (SELECT fold, sum(m) AS tp FROM (SELECT fold, tr, tc, max(w * p) AS m FROM pairs GROUP BY ALL) GROUP BY fold), hit AS (SELECT fold, sum(m) AS hit FROM (SELECT fold, row, col, max(w) * max(p) AS m FROM pairs GROUP BY ALL) GROUP BY fold),
total AS (SELECT fold, sum(p) AS all_p, count(*) AS n_valid, count(*) FILTER (truth) AS n_truth FROM cell GROUP BY fold),
parts AS (SELECT fold, coalesce(tp, 0) AS tp, all_p - coalesce(hit, 0) AS fp, n_truth - coalesce(tp, 0) AS fn, n_valid, n_truth FROM total LEFT JOIN best USING (fold) LEFT JOIN hit USING (fold))
SELECT fold, round(tp, 6) AS tp, round(fp, 6) AS fp, round(fn, 6) AS fn, n_valid, n_truth, round(tp / (tp + 0.2 * fp + 0.8 * fn + 1e-12), 6) AS score FROM parts"""


def discovery(spark, sf_dir, trace: bool):
    cells = raster(spark, sf_dir).withColumn("fold", F.when(F.col("truth") & (F.col("col") % 3 != 0), F.col("fold")).otherwise(-1))
    folds = spark.range(5).select(F.col("id").alias("k"))
    predictions = cells.select("row", "col", "p").join(F.broadcast(folds)).select(F.col("k").alias("fold"), "row", "col", (F.col("p") * (1 - F.col("k") / 10.0)).alias("p"))
    return rounded(metric.evaluate_discovery(predictions, cells, 2, trace))


@query("fault_discovery", discovery_sql(False))
def _(spark, sf_dir):
    return discovery(spark, sf_dir, False)


@query("trace_completion", discovery_sql(True))
def _(spark, sf_dir):
    return discovery(spark, sf_dir, True)


@query("exact_optimum", curve_sql() + " SELECT round(max_by(threshold, (score, threshold)), 6) AS threshold, round(max(score), 6) AS score, 'exact' AS method FROM curve")
def _(spark, sf_dir):
    return rounded(threshold.optimal_threshold(raster(spark, sf_dir)))


@query("block_quantiles", f"""WITH {RASTER}, b AS (SELECT row // 16, col // 16, count(*) FILTER (valid) AS n, count(*) FILTER (valid AND truth) AS t FROM raster GROUP BY ALL)
SELECT count(*) AS blocks, count(*) FILTER (n > 0) AS usable, count(*) FILTER (t > 0) AS positive, round(quantile_cont(t, 0.5) FILTER (t > 0), 6)::DOUBLE AS median, round(quantile_cont(t, 0.95) FILTER (t > 0), 6)::DOUBLE AS p95 FROM b""")
def _(spark, sf_dir):
    found = components.block_quantiles(components.block_report(raster(spark, sf_dir), 16))
    return rounded(found.select("blocks", "usable", "positive", F.col("truth_quantiles")[2].alias("median"), F.col("truth_quantiles")[5].alias("p95")))


@query("resume_forecast", """WITH o AS (SELECT count(ts) AS n, min(ts) AS first, max(ts) AS last FROM events), r AS (SELECT *, 5000 / (n / (epoch_us(last) / 1e6 - epoch_us(first) / 1e6) * 86400) AS drain FROM o)
SELECT round(drain, 6) AS drain_days, round(16 - drain, 6) AS margin_days, CASE WHEN 16 - drain >= 5 THEN 'FEASIBLE' WHEN 16 - drain >= 0 THEN 'TIGHT' ELSE 'INFEASIBLE' END AS verdict,
round((epoch_us(TIMESTAMP '2024-03-01') / 1e6 - drain * 86400 - epoch_us(TIMESTAMP '2024-02-14') / 1e6) / 86400, 4) AS resume_in_days FROM r""")
def _(spark, sf_dir):
    at = lambda s: F.lit(s).cast("timestamp")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"))
    out = audit.drain_forecast(events, 5000, at("2024-02-10"), at("2024-03-01"), resume=at("2024-02-14"))
    left = (F.col("resume_by").cast("double") - at("2024-02-14").cast("double")) / 86400
    return rounded(out.select("drain_days", "margin_days", "verdict", F.round(left, 4).alias("resume_in_days")))


@query("result_findings", """WITH l AS (SELECT DISTINCT o_custkey AS candidate FROM orders WHERE o_custkey % 3 = 0), g AS (SELECT c_custkey AS candidate FROM customer WHERE c_custkey % 6 = 0),
v AS (SELECT l_suppkey AS run, l_returnflag AS scheme, list(l_linenumber::DOUBLE ORDER BY l_orderkey, l_linenumber, l_partkey) AS scores FROM lineitem WHERE l_suppkey % 2 = 1 GROUP BY ALL),
w AS (SELECT run * 10 AS candidate, scheme, scores FROM v WHERE run % 4 = 1 UNION ALL SELECT run * 10 + 1, scheme, list_append(scores, 9.0) FROM v WHERE run % 4 = 3)
SELECT 'finding' AS severity, 'ORPHAN' AS code, coalesce(l.candidate, g.candidate)::VARCHAR AS subject, CASE WHEN l.candidate IS NULL THEN 'not in ledger' ELSE 'no gate report' END AS detail FROM l FULL JOIN g ON l.candidate = g.candidate WHERE l.candidate IS NULL OR g.candidate IS NULL
UNION ALL SELECT CASE WHEN n_regionkey = 1 THEN 'error' ELSE 'finding' END, 'LOFO_RAW', n_nationkey || '/spatial', CASE WHEN n_regionkey = 1 THEN 'raw mean differs' ELSE 'no raw score' END FROM nation WHERE n_regionkey IN (1, 2)
UNION ALL SELECT 'error', 'UNMIRRORED', candidate || '/' || scheme, 'no run has these fold scores' FROM w WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.scheme = w.scheme AND v.scores = w.scores)""")
def _(spark, sf_dir):
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ledger_, gates = read("orders").where("o_custkey % 3 = 0").select(F.col("o_custkey").alias("candidate")), read("customer").where("c_custkey % 6 = 0").select(F.col("c_custkey").alias("candidate"))
    run, scheme = F.col("n_nationkey").alias("run"), F.lit("spatial").alias("scheme")
    raw = read("nation").where("n_regionkey <> 2").select(run, scheme, F.when(F.col("n_regionkey") == 1, 50.0).otherwise(F.col("n_nationkey") / 10.0).alias("macro_mean"))
    lofo = read("nation").select(run, scheme, (F.col("n_nationkey") / 10.0).alias("raw_mean"))
    order = F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey")))
    views = read("lineitem").where("l_suppkey % 2 = 1").groupBy(F.col("l_suppkey").alias("run"), F.col("l_returnflag").alias("scheme")).agg(order.alias("o"))
    views = views.select("run", "scheme", F.transform("o", lambda x: x["l_linenumber"].cast("double")).alias("scores"))
    same = views.where("run % 4 = 1").select((F.col("run") * 10).alias("candidate"), "scheme", "scores")
    other = views.where("run % 4 = 3").select((F.col("run") * 10 + 1).alias("candidate"), "scheme", F.array_append("scores", F.lit(9.0)).alias("scores"))
    return audit.result_findings(ledger_, gates, lofo, raw, views, same.union(other))


@query("run_states", """WITH e AS (SELECT user_id::VARCHAR AS run, CASE event_type WHEN 'purchase' THEN CASE WHEN user_id % 3 = 0 THEN 'done' ELSE 'beat' END WHEN 'error' THEN CASE WHEN user_id % 5 = 0 THEN 'failed' ELSE 'beat' END ELSE 'beat' END AS event, ts FROM events),
o AS (SELECT run, bool_or(event = 'failed') AS failed, bool_or(event = 'done') AS done, max(ts) AS last FROM e WHERE ts IS NOT NULL GROUP BY run)
SELECT run, CASE WHEN failed THEN 'STOPPED' WHEN done THEN 'DONE' WHEN epoch_us(TIMESTAMP '2024-01-31') - epoch_us(last) >= 48 * 3600e6 THEN 'RUNNING-STALLED' ELSE 'RUNNING' END AS state FROM o""")
def _(spark, sf_dir):
    kind, user = F.col("event_type"), F.col("user_id")
    event = F.when((kind == "purchase") & (user % 3 == 0), "done").when((kind == "error") & (user % 5 == 0), "failed").otherwise("beat")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(user.cast("string").alias("run"), event.alias("event"), F.col("ts").cast("timestamp").alias("ts"))
    return states.run_states(events, F.lit("2024-01-31").cast("timestamp"))
