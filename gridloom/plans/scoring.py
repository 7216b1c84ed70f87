"""Queries: the metric, thresholds and ensembles over the canonical raster."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import metric, threshold, tolerant
from gridloom.plans.collect import Plans
from gridloom.plans.raster import RASTER, raster

query = Plans()


def rounded(df, *keep: str):
    return df.select(*[F.col(c) if c in keep or t not in ("double", "float") else (F.round(c, 6) + 0.0).alias(c) for c, t in df.dtypes])


OFFSETS = "offsets AS (SELECT y.range - 2 AS dy, x.range - 2 AS dx, 1 - sqrt((y.range - 2) ** 2 + (x.range - 2) ** 2) / 3 AS w FROM range(5) y, range(5) x)"


def components_sql(by: str = "", where: str = "valid", core: str = "true") -> str:
    on = f"AND t.{by} = c.{by}" if by else ""
    key, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    t_key = f"t.{by}, " if by else ""
    using = f"LEFT JOIN best USING ({by}) LEFT JOIN hit USING ({by})" if by else ", best, hit"
    return f"""WITH {RASTER}, {OFFSETS}, cell AS (SELECT *, {core} AS core FROM raster WHERE {where}), near AS (
  SELECT {t_key}t.row AS tr, t.col AS tc, t.core AS t_core, c.row, c.col, c.core, c.p, o.w
  FROM cell t, offsets o JOIN cell c ON c.row = t.row + o.dy AND c.col = t.col + o.dx {on} WHERE t.truth
), best AS (SELECT {key}sum(m) AS tp_ FROM (SELECT {key}tr, tc, max(w * p) AS m FROM near WHERE t_core GROUP BY ALL) {group}),
hit AS (SELECT {key}sum(m) AS hit_ FROM (SELECT {key}row, col, max(w) * max(p) AS m FROM near WHERE core GROUP BY ALL) {group}),
total AS (SELECT {key}sum(p) FILTER (core) AS all_p, count(*) FILTER (core) AS n_valid, count(*) FILTER (core AND truth) AS n_truth FROM cell {group}),
parts AS (SELECT {key}coalesce(tp_, 0) AS tp, all_p - coalesce(hit_, 0) AS fp, n_truth - coalesce(tp_, 0) AS fn, n_valid, n_truth FROM total {using})"""


ROUND = "round(tp, 6) AS tp, round(fp, 6) AS fp, round(fn, 6) AS fn"
SCORE = "tp / (tp + 0.2 * fp + 0.8 * fn + 1e-12)"


@query("tversky_components", components_sql() + f" SELECT {ROUND}, n_valid, n_truth, round({SCORE}, 6) AS score FROM parts")
def _(spark, sf_dir):
    return rounded(metric.tversky(raster(spark, sf_dir)))


@query("tversky_by_fold", components_sql("fold") + f" SELECT fold, {ROUND}, n_valid, n_truth, round({SCORE}, 6) AS score FROM parts")
def _(spark, sf_dir):
    return rounded(metric.tversky(raster(spark, sf_dir), ["fold"]))


@query("tversky_macro", components_sql("fold") + f" SELECT round(avg({SCORE}), 6) AS macro_mean, round(stddev_pop({SCORE}), 6) AS macro_std, count(*) AS folds FROM parts")
def _(spark, sf_dir):
    return rounded(metric.macro(metric.tversky(raster(spark, sf_dir), ["fold"])))


@query("tversky_stitched", components_sql() + f" SELECT {ROUND}, n_valid, n_truth, round({SCORE}, 6) AS score FROM parts")
def _(spark, sf_dir):
    cells = raster(spark, sf_dir)
    stitched = metric.stitch(cells.select("row", "col", "fold", "p"), cells.drop("p"))
    return rounded(metric.tversky(stitched))


@query("core_halo_components", components_sql(core="(col BETWEEN 8 AND 55)") + f" SELECT {ROUND}, n_valid, n_truth, round(1 - {SCORE}, 6) AS loss FROM parts")
def _(spark, sf_dir):
    cells = raster(spark, sf_dir).withColumn("core", F.col("col").between(8, 55))
    return rounded(metric.loss(metric.tversky_components(cells, core="core")))


BAND = f"""WITH {RASTER}, {OFFSETS}, band AS (
  SELECT DISTINCT t.row + o.dy AS row, t.col + o.dx AS col FROM raster t, offsets o WHERE t.truth AND t.valid AND (o.dy <> 0 OR o.dx <> 0)
), weighed AS (
  SELECT r.*, CASE WHEN NOT valid THEN 0.0 WHEN NOT truth AND b.row IS NOT NULL THEN 0.5 ELSE 1.0 END AS weight
  FROM raster r LEFT JOIN band b ON r.row = b.row AND r.col = b.col)"""


@query("softened_components", BAND + """, parts AS (SELECT sum(weight * p * truth::INT) FILTER (valid) AS tp, sum(weight * p * (1 - truth::INT)) FILTER (valid) AS fp, sum(weight * (1 - p) * truth::INT) FILTER (valid) AS fn FROM weighed)
SELECT """ + ROUND + f", round(1 - {SCORE}, 6) AS loss FROM parts")
def _(spark, sf_dir):
    return rounded(metric.loss(metric.softened_components(raster(spark, sf_dir))))


@query("ambiguity_band", BAND + " SELECT weight::DOUBLE AS weight, count(*) AS cells FROM weighed GROUP BY weight")
def _(spark, sf_dir):
    return metric.ambiguity_weights(raster(spark, sf_dir)).groupBy("weight").agg(F.count(F.lit(1)).alias("cells"))


def curve_sql(by: str = "", source: str = "raster") -> str:
    on, key, part = (f"AND t.{by} = c.{by}", f"{by}, ", f"PARTITION BY {by} ") if by else ("", "", "")
    t_key, c_key, group, join = (f"t.{by}, ", f"c.{by}, ", f"GROUP BY {by}", f"JOIN truths USING ({by})") if by else ("", "", "", ", truths")
    return f"""WITH {RASTER}, {OFFSETS}, cell AS MATERIALIZED (SELECT *, p AS q FROM {source} WHERE valid), near AS (
  SELECT {t_key}t.row AS tr, t.col AS tc, c.row, c.col, c.q AS p, o.w
  FROM cell t, offsets o JOIN cell c ON c.row = t.row + o.dy AND c.col = t.col + o.dx {on} WHERE t.truth
), levels AS (SELECT {key}tr, tc, p, max(w) AS w FROM near GROUP BY ALL),
grown AS (SELECT *, max(w) OVER (PARTITION BY {key}tr, tc ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS best FROM levels),
gains AS (SELECT {key}p, best - coalesce(lag(best) OVER (PARTITION BY {key}tr, tc ORDER BY p DESC), 0) AS tp, 0.0 AS fp FROM grown),
events AS (
  SELECT * FROM gains UNION ALL SELECT {c_key}c.q, 0.0, 1.0 FROM cell c
  UNION ALL SELECT {key}p, 0.0, -w FROM (SELECT {key}row, col, max(p) AS p, max(w) AS w FROM near GROUP BY ALL)
), steps AS (SELECT {key}p, sum(tp) AS tp, sum(fp) AS fp FROM events GROUP BY ALL),
truths AS (SELECT {key}count(*) FILTER (truth) AS n_truth, max(q) AS top FROM cell {group}),
sums AS (
  SELECT {key}p AS threshold, sum(tp) OVER ({part}ORDER BY p DESC) AS tp, sum(fp) OVER ({part}ORDER BY p DESC) AS fp FROM steps
  UNION ALL SELECT {key}top + 1e-12, 0, 0 FROM truths
), curve AS (SELECT {key}threshold, tp, fp, greatest(n_truth - tp, 0) AS fn, tp / (tp + 0.2 * fp + 0.8 * greatest(n_truth - tp, 0) + 1e-12) AS score FROM sums {join})"""


def score_at(curve: str, fold: str, t: str) -> str:
    """The score of ``curve`` (fold, threshold, score) at t: of its least threshold not below, or of its greatest."""
    return f"coalesce((SELECT min_by(score, threshold) FROM {curve} c WHERE c.fold = {fold} AND c.threshold >= {t}), (SELECT max_by(score, threshold) FROM {curve} c WHERE c.fold = {fold}))"


@query("threshold_curve", curve_sql() + " SELECT round(threshold, 6) AS threshold, round(tp, 6) AS tp, round(fp, 6) AS fp, round(fn, 6) AS fn, round(score, 6) AS score FROM curve")
def _(spark, sf_dir):
    return rounded(threshold.threshold_curve(raster(spark, sf_dir)))


@query("best_threshold", curve_sql("fold") + " SELECT fold, round(max_by(threshold, (score, threshold)), 6) AS threshold, round(max(score), 6) AS score FROM curve GROUP BY fold")
def _(spark, sf_dir):
    return rounded(threshold.best_threshold(threshold.threshold_curve(raster(spark, sf_dir), ["fold"]), ["fold"]))


LOFO = curve_sql("fold") + """, best AS (SELECT fold AS best_of, max_by(threshold, (score, threshold)) AS candidate FROM curve GROUP BY fold),
grid AS (SELECT range / 1000.0::DOUBLE AS candidate FROM range(1001)), folds AS (SELECT DISTINCT fold FROM curve),
allowed AS (SELECT fold, candidate FROM folds, grid UNION SELECT fold, candidate FROM folds JOIN best ON fold <> best_of),
every AS (SELECT DISTINCT f.fold AS other, candidate FROM folds f, (SELECT candidate FROM grid UNION SELECT candidate FROM best)),
at_ AS (SELECT e.other, e.candidate, coalesce((SELECT min_by(score, threshold) FROM curve c WHERE c.fold = e.other AND c.threshold >= e.candidate),
  (SELECT max_by(score, threshold) FROM curve c WHERE c.fold = e.other)) AS score FROM every e),
fit AS (SELECT a.fold, a.candidate, avg(score) AS fit_mean FROM allowed a JOIN at_ ON at_.candidate = a.candidate AND at_.other <> a.fold GROUP BY ALL)"""


@query("lofo_threshold", LOFO + " SELECT fold, round(max_by(candidate, (round(fit_mean, 12), -candidate)), 6) AS threshold, round(max(fit_mean), 6) AS fit_mean FROM fit GROUP BY fold")
def _(spark, sf_dir):
    return rounded(threshold.lofo_thresholds(threshold.threshold_curve(raster(spark, sf_dir), ["fold"])))


@query("calibrated_predictions", f"""WITH {RASTER} SELECT row, col, round(least(1, greatest(0, p * (0.5 / 0.4) * 0.9)), 6) AS calibrated,
CASE WHEN p >= 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE AS positive,
round(least(1, greatest(0, CASE WHEN p >= 0.6 THEN (p - 0.6) / (1 - 0.6 + 1e-9) ELSE p / (0.6 + 1e-9) * 0.5 END)), 6) AS remapped FROM raster""")
def _(spark, sf_dir):
    p = F.col("p")
    return rounded(raster(spark, sf_dir).select("row", "col", threshold.calibrated(p, 0.4, 0.9).alias("calibrated"), threshold.binary_threshold(p, 0.5).alias("positive"), threshold.soft_remap(p, 0.6).alias("remapped")))


@query("shift_sensitivity", f"""WITH {RASTER}, {OFFSETS}, shifts(s, dy, dx) AS (VALUES (0, 0, 0), (1, -1, -1), (2, -1, 0), (3, -1, 1), (4, 0, -1), (5, 0, 1), (6, 1, -1), (7, 1, 0), (8, 1, 1)),
cell AS MATERIALIZED (SELECT s, r.row, r.col, r.truth, coalesce(x.p, 0) AS p FROM raster r CROSS JOIN shifts LEFT JOIN (SELECT * FROM raster WHERE valid) x ON x.row = r.row - dy AND x.col = r.col - dx WHERE r.valid),
near AS (SELECT t.s, t.row AS tr, t.col AS tc, c.row, c.col, c.p, o.w FROM cell t, offsets o JOIN cell c ON c.s = t.s AND c.row = t.row + o.dy AND c.col = t.col + o.dx WHERE t.truth),
best AS (SELECT s, sum(m) AS tp FROM (SELECT s, tr, tc, max(w * p) AS m FROM near GROUP BY ALL) GROUP BY s), hit AS (SELECT s, sum(m) AS hit FROM (SELECT s, row, col, max(w) * max(p) AS m FROM near GROUP BY ALL) GROUP BY s),
parts AS (SELECT s, tp, sum(p) - hit AS fp, count(*) FILTER (truth) - tp AS fn FROM cell JOIN best USING (s) JOIN hit USING (s) GROUP BY s, tp, hit), scores AS (SELECT *, {SCORE} AS score FROM parts)
SELECT dy, dx, {ROUND}, round(score, 6) AS score, round(score - (SELECT score FROM scores WHERE s = 0), 6) + 0.0 AS delta, s = (SELECT s FROM scores ORDER BY score, s LIMIT 1) AS worst FROM scores JOIN shifts USING (s)""")
def _(spark, sf_dir):
    return rounded(metric.shift_sensitivity(raster(spark, sf_dir)))


#: Weights at which the loss and its gradient are compared.
THETA = [1.5, -0.5, -0.3]
GRADIENT = f"""WITH {RASTER}, {OFFSETS}, cell AS MATERIALIZED (SELECT row, col, truth, v, p AS q, 1 / (1 + exp(-(1.5 * v - 0.5 * p - 0.3))) AS p FROM raster WHERE valid),
near AS MATERIALIZED (SELECT t.row AS tr, t.col AS tc, c.*, o.w FROM cell t, offsets o JOIN cell c ON c.row = t.row + o.dy AND c.col = t.col + o.dx WHERE t.truth),
top AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY tr, tc ORDER BY w * p DESC, row, col) = 1),
t AS (SELECT sum(w * p) AS tp, count(*) AS g, sum(w * p * (1 - p) * v) AS t0, sum(w * p * (1 - p) * q) AS t1, sum(w * p * (1 - p)) AS t2 FROM top),
field AS (SELECT c.*, 1 - coalesce(k, 0) AS miss FROM cell c LEFT JOIN (SELECT row, col, max(w) AS k FROM near GROUP BY ALL) USING (row, col)),
f AS (SELECT sum(miss * p) AS fp, sum(miss * p * (1 - p) * v) AS f0, sum(miss * p * (1 - p) * q) AS f1, sum(miss * p * (1 - p)) AS f2 FROM field),
d AS (SELECT *, g - tp AS fn, tp + 0.2 * fp + 0.8 * (g - tp) + 1e-12 AS whole FROM t, f)
SELECT {ROUND}, round(1 - tp / whole, 6) AS loss, {', '.join(f'round(-(t{i} * whole - tp * (0.2 * t{i} + 0.2 * f{i})) / whole ** 2, 6) + 0.0 AS g{i}' for i in range(3))} FROM d"""


@query("tolerant_gradient", GRADIENT)
def _(spark, sf_dir):
    one = tolerant.loss_and_gradient(tolerant.examples(raster(spark, sf_dir), ["v", "p"]), THETA)
    return rounded(one.select("tp", "fp", "fn", "loss", *[F.col("gradient")[i].alias(f"g{i}") for i in range(3)]))


@query("tolerant_training")
def _(spark, sf_dir):
    cells = raster(spark, sf_dir)
    theta, _ = tolerant.fit(tolerant.examples(cells.where("fold <> 0"), ["v"]), steps=8)
    return rounded(metric.tversky(tolerant.predict(cells.where("fold = 0"), ["v"], theta)))
