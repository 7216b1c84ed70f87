"""Queries: masks, components, tiles, ensembles and features over the canonical raster."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import components, distance, ensemble, features, masks, tiling
from gridloom.plans.collect import Plans
from gridloom.plans.raster import RASTER, raster
from gridloom.plans.scoring import components_sql, rounded

query = Plans()


DISK2 = "disk AS (SELECT y.range - 2 AS dy, x.range - 2 AS dx FROM range(5) y, range(5) x WHERE (y.range - 2) ** 2 + (x.range - 2) ** 2 <= 4)"


@query("spatial_fold_masks", f"""WITH {RASTER}, {DISK2}, v AS (SELECT row, col, fold FROM raster WHERE valid), folds AS (SELECT DISTINCT fold AS k FROM v),
near AS (SELECT DISTINCT fold AS k, row + dy AS row, col + dx AS col FROM v, disk)
SELECT k AS fold, CASE WHEN v.fold = k THEN 'validation' WHEN n.row IS NOT NULL THEN 'excluded' ELSE 'train' END AS role, count(*) AS cells
FROM v CROSS JOIN folds LEFT JOIN near n USING (k, row, col) GROUP BY ALL""")
def _(spark, sf_dir):
    return masks.spatial_masks(raster(spark, sf_dir), 2).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("cells"))


@query("discovery_fold_masks", f"""WITH {RASTER}, {DISK2}, v AS (SELECT row, col, truth, CASE WHEN truth THEN fold ELSE -1 END AS fold FROM raster WHERE valid),
folds AS (SELECT DISTINCT fold AS k FROM v WHERE truth), known AS (SELECT k, row, col FROM v, folds WHERE truth AND fold <> k AND fold >= 0),
held AS (SELECT k, row, col FROM v, folds WHERE truth AND fold = k),
e AS (SELECT DISTINCT k, row + dy AS row, col + dx AS col FROM known, disk), w AS (SELECT DISTINCT k, row + dy AS row, col + dx AS col FROM held, disk)
SELECT k AS fold, count(*) FILTER (truth AND fold <> k) AS train_truth, count(*) FILTER (truth AND fold = k) AS validation_truth,
count(*) FILTER (w.row IS NULL) AS train, count(*) FILTER (e.row IS NULL) AS evaluation
FROM v CROSS JOIN folds LEFT JOIN e USING (k, row, col) LEFT JOIN w USING (k, row, col) GROUP BY k""")
def _(spark, sf_dir):
    cells = raster(spark, sf_dir).withColumn("fold", F.when(F.col("truth"), F.col("fold")).otherwise(-1))
    return masks.discovery_masks(cells, 2, 2).groupBy("fold").agg(*[F.count_if(c).alias(c) for c in ("train_truth", "validation_truth", "train", "evaluation")])


def within_sql(name: str, source: str, radius: int) -> str:
    """CTEs: (k, row, col) within ``radius`` of the cells (k, row, col) of ``source``: rows to the nearest mark up and down each column, then columns beside."""
    return f"""{name}_ends AS (SELECT min(row) - {radius} AS r0, max(row) + {radius} AS r1 FROM {source}),
{name}_line AS (SELECT k, col, row, m.row IS NOT NULL AS marked FROM (SELECT DISTINCT k, col FROM {source}) CROSS JOIN (SELECT unnest(range(r0, r1 + 1)) AS row FROM {name}_ends) LEFT JOIN {source} m USING (k, col, row)),
{name}_down AS (SELECT k, row, col, least(coalesce(row - max(CASE WHEN marked THEN row END) OVER up, 1000000), coalesce(min(CASE WHEN marked THEN row END) OVER down - row, 1000000)) AS g FROM {name}_line
  WINDOW up AS (PARTITION BY k, col ORDER BY row), down AS (PARTITION BY k, col ORDER BY row ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
{name} AS (SELECT DISTINCT k, row, (col + dx) AS col FROM {name}_down, (SELECT range - {radius} AS dx FROM range({2 * radius + 1})) WHERE g * g + dx * dx <= {radius * radius})"""


@query("spatial_fold_masks_32", f"""WITH {RASTER}, v AS (SELECT row, col, fold FROM raster WHERE valid), folds AS (SELECT DISTINCT fold AS k FROM v), own AS (SELECT fold AS k, row, col FROM v),
{within_sql("near", "own", 32)}
SELECT k AS fold, CASE WHEN v.fold = k THEN 'validation' WHEN n.row IS NOT NULL THEN 'excluded' ELSE 'train' END AS role, count(*) AS cells
FROM v CROSS JOIN folds LEFT JOIN near n USING (k, row, col) GROUP BY ALL""")
def _(spark, sf_dir):
    return masks.spatial_masks(raster(spark, sf_dir), 32).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("cells"))


@query("discovery_fold_masks_16", f"""WITH {RASTER}, v AS (SELECT row, col, truth AND v > 0.3 AS truth, CASE WHEN truth AND v > 0.3 THEN fold ELSE -1 END AS fold FROM raster WHERE valid),
folds AS (SELECT DISTINCT fold AS k FROM v WHERE truth), known AS (SELECT k, row, col FROM v, folds WHERE truth AND fold <> k AND fold >= 0),
held AS (SELECT k, row, col FROM v, folds WHERE truth AND fold = k), {within_sql("e", "known", 3)}, {within_sql("w", "held", 16)}
SELECT k AS fold, count(*) FILTER (truth AND fold <> k) AS train_truth, count(*) FILTER (truth AND fold = k) AS validation_truth,
count(*) FILTER (w.row IS NULL) AS train, count(*) FILTER (e.row IS NULL) AS evaluation
FROM v CROSS JOIN folds LEFT JOIN e USING (k, row, col) LEFT JOIN w USING (k, row, col) GROUP BY k""")
def _(spark, sf_dir):
    cells = raster(spark, sf_dir).withColumn("truth", F.expr("truth and v > 0.3")).withColumn("fold", F.when(F.col("truth"), F.col("fold")).otherwise(-1))
    return masks.discovery_masks(cells, 16, 3).groupBy("fold").agg(*[F.count_if(c).alias(c) for c in ("train_truth", "validation_truth", "train", "evaluation")])


@query("distance_transform", f"""WITH {RASTER}, m AS (SELECT row, col FROM raster WHERE truth AND v > 0.3)
SELECT (m.row + dy)::BIGINT AS row, (m.col + dx)::BIGINT AS col, min(dy * dy + dx * dx)::BIGINT AS d2 FROM m, (SELECT range - 16 AS dy FROM range(33)), (SELECT range - 16 AS dx FROM range(33))
WHERE dy * dy + dx * dx <= 256 GROUP BY ALL""")
def _(spark, sf_dir):
    return distance.distances(raster(spark, sf_dir).where("truth and v > 0.3"), 16)


def marked(spark, sf_dir):
    return raster(spark, sf_dir).where("v > 0.2")


def reach_sql(where: str) -> str:
    return f"""WITH RECURSIVE {RASTER}, m AS MATERIALIZED (SELECT row, col FROM raster WHERE {where}), near AS MATERIALIZED (
  SELECT a.row * 4294967296 + a.col AS a, b.row * 4294967296 + b.col AS b FROM m a, (SELECT range - 1 AS dy FROM range(3)), (SELECT range - 1 AS dx FROM range(3)) JOIN m b ON b.row = a.row + dy AND b.col = a.col + dx
), reach(a, b) AS (SELECT a, a FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a),
labelled AS (SELECT (a // 4294967296) AS row, (a % 4294967296) AS col, min(b) AS component FROM reach GROUP BY a)"""


REACH = reach_sql("v > 0.2")


@query("components8", REACH + " SELECT row::BIGINT AS row, col::BIGINT AS col, component::BIGINT AS component FROM labelled")
def _(spark, sf_dir):
    return components.label(marked(spark, sf_dir), tile=32)


@query("component_table", REACH + """ SELECT component::BIGINT AS component, count(*) AS pixels, min(row)::BIGINT AS row0, max(row)::BIGINT + 1 AS row1, min(col)::BIGINT AS col0, max(col)::BIGINT + 1 AS col1,
(max(row) + 1 - min(row)) * 100.0::DOUBLE AS height_m, (max(col) + 1 - min(col)) * 100.0::DOUBLE AS width_m FROM labelled GROUP BY component""")
def _(spark, sf_dir):
    return components.component_table(components.label(marked(spark, sf_dir), tile=32))


@query("component_report", REACH + """, sizes AS (SELECT component, count(*) AS pixels FROM labelled GROUP BY component)
SELECT count(*) AS components, sum(pixels)::BIGINT AS pixels, round(quantile_cont(pixels, 0.5), 6)::DOUBLE AS median, round(quantile_cont(pixels, 0.95), 6)::DOUBLE AS p95, round(sum(pixels) / (SELECT count(*) FROM raster WHERE valid)::DOUBLE, 6) AS prevalence,
array_to_string(list(pixels ORDER BY pixels DESC, component)[:3], ',') AS largest FROM sizes""")
def _(spark, sf_dir):
    report, largest = components.component_report(components.label(marked(spark, sf_dir), tile=32), raster(spark, sf_dir).where("valid").count(), 3)
    largest = largest.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("pixels")).alias("n"), "component"))), lambda x: (-x["n"]).cast("string")), ",").alias("largest"))
    return rounded(report.join(largest).select("components", "pixels", F.col("size_quantiles")[2].alias("median"), F.col("size_quantiles")[5].alias("p95"), "prevalence", "largest"))


@query("block_report", f"WITH {RASTER} SELECT row // 16 AS block_r, col // 16 AS block_c, count(*) FILTER (valid) AS valid_cells, count(*) FILTER (valid AND truth) AS truth_cells, count(*) FILTER (valid) > 0 AS usable FROM raster GROUP BY ALL")
def _(spark, sf_dir):
    return components.block_report(raster(spark, sf_dir), 16)


@query("endpoints8", f"""WITH {RASTER}, m AS (SELECT row, col FROM raster WHERE v > 0.2)
SELECT a.row, a.col FROM m a JOIN m b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND (a.row <> b.row OR a.col <> b.col) GROUP BY a.row, a.col HAVING count(*) = 1""")
def _(spark, sf_dir):
    from gridloom.operators import geometry

    return geometry.endpoints(marked(spark, sf_dir))


@query("tile_windows", """WITH s AS (SELECT unnest([0, 24, 48]) AS c0), r AS (SELECT unnest(list_distinct(list_concat(range(0, n - 32 + 1, 24), [n - 32]))) AS r0 FROM (SELECT count(*) AS n FROM embeddings)),
c AS (SELECT unnest(list_distinct(list_concat(range(0, 64 - 32 + 1, 24), [32]))) AS c0)
SELECT row_number() OVER (ORDER BY r0, c0) - 1 AS tile, r0 AS row0, c0 AS col0, 32::BIGINT AS height, 32::BIGINT AS width FROM r, c""")
def _(spark, sf_dir):
    height = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    return tiling.windows(spark, height, 64, 32, 8)


BLEND = f"""WITH {RASTER}, r AS (SELECT unnest(list_distinct(list_concat(range(0, n - 32 + 1, 24), [n - 32]))) AS row0 FROM (SELECT count(*) AS n FROM embeddings)),
c AS (SELECT unnest(list_distinct(list_concat(range(0, 33, 24), [32]))) AS col0),
t AS (SELECT row, col, row0, col0, p * (1 + (row0 % 3) * 0.1::DOUBLE) AS p, greatest((0.5 - 0.5 * cos(2 * pi() * (row - row0) / 31)) * (0.5 - 0.5 * cos(2 * pi() * (col - col0) / 31)), 0.05) AS w
  FROM raster JOIN r ON row >= row0 AND row < row0 + 32 JOIN c ON col >= col0 AND col < col0 + 32)
SELECT row, col, round(sum(w * p) / sum(w), 6) AS p FROM t GROUP BY row, col"""


@query("blend", BLEND)
def _(spark, sf_dir):
    height = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    tiles = tiling.to_tiles(raster(spark, sf_dir), height, 64, 32, 8).withColumn("p", F.col("p") * (1 + F.col("row0") % 3 * 0.1))
    return rounded(tiling.blend(tiles, 32))


def members(spark, sf_dir):
    cells = raster(spark, sf_dir)
    shifts = {"a": F.col("p"), "b": F.least(F.lit(1.0), F.col("p") * 1.2), "c": F.col("p") * F.col("p")}
    out = None
    for name, p in shifts.items():
        own = cells.select(F.lit(name).alias("member"), "fold", "row", "col", p.alias("p"))
        out = own if out is None else out.union(own)
    return out


MEMBERS = f"""{RASTER}, members AS (SELECT 'a' AS member, fold, row, col, p FROM raster UNION ALL SELECT 'b', fold, row, col, least(1.0, p * 1.2) FROM raster UNION ALL SELECT 'c', fold, row, col, p * p FROM raster)"""


@query("ensemble_mean", f"WITH {MEMBERS} SELECT fold, row, col, round(avg(p)::FLOAT::DOUBLE, 4) AS p FROM members GROUP BY fold, row, col")
def _(spark, sf_dir):
    return ensemble.mean(members(spark, sf_dir)).withColumn("p", F.round(F.col("p").cast("double"), 4))


@query("rank_average", f"""WITH {MEMBERS}, r AS (SELECT *, (row_number() OVER (PARTITION BY member, fold ORDER BY p, row, col) - 1) / (count(*) OVER (PARTITION BY member, fold) - 1)::DOUBLE AS rank FROM members)
SELECT fold, row, col, round(avg(rank), 6) AS p FROM r GROUP BY fold, row, col""")
def _(spark, sf_dir):
    return rounded(ensemble.rank_average(members(spark, sf_dir)))


WEIGHTS = f"""WITH {MEMBERS}, offsets AS (SELECT y.range - 2 AS dy, x.range - 2 AS dx, 1 - sqrt((y.range - 2) ** 2 + (x.range - 2) ** 2) / 3 AS w FROM range(5) y, range(5) x),
simplex AS (SELECT a.range / 10.0::DOUBLE AS a, b.range / 10.0::DOUBLE AS b, (10 - a.range - b.range) / 10.0::DOUBLE AS c FROM range(11) a, range(11) b WHERE a.range + b.range <= 10 AND greatest(a.range, b.range, 10 - a.range - b.range) < 10),
candidates AS (SELECT 3 + row_number() OVER (ORDER BY a, b, c) AS candidate, a, b, c FROM simplex UNION ALL VALUES (0, 1 / 3.0::DOUBLE, 1 / 3.0::DOUBLE, 1 / 3.0::DOUBLE), (1, 1, 0, 0), (2, 0, 1, 0), (3, 0, 0, 1)),
wide AS (SELECT fold, row, col, max(p) FILTER (member = 'a') AS pa, max(p) FILTER (member = 'b') AS pb, max(p) FILTER (member = 'c') AS pc FROM members GROUP BY ALL),
cell AS MATERIALIZED (SELECT w.*, truth FROM wide w JOIN raster r ON r.row = w.row AND r.col = w.col WHERE valid),
near AS MATERIALIZED (SELECT t.fold, t.row AS tr, t.col AS tc, c.row, c.col, c.pa, c.pb, c.pc, o.w FROM cell t, offsets o JOIN cell c ON c.row = t.row + o.dy AND c.col = t.col + o.dx AND c.fold = t.fold WHERE t.truth),
best AS (SELECT candidate, fold, sum(m) AS tp FROM (SELECT candidate, fold, tr, tc, max(w * (a * pa + b * pb + c * pc)) AS m FROM near, candidates GROUP BY ALL) GROUP BY ALL),
hit AS (SELECT candidate, fold, sum(m) AS hit FROM (SELECT candidate, fold, row, col, max(w) * max(a * pa + b * pb + c * pc) AS m FROM near, candidates GROUP BY ALL) GROUP BY ALL),
total AS (SELECT candidate, fold, sum(a * pa + b * pb + c * pc) AS all_p, count(*) FILTER (truth) AS n FROM cell, candidates GROUP BY ALL),
scores AS (SELECT candidate, fold, tp / (tp + 0.2 * (all_p - hit) + 0.8 * (n - tp) + 1e-12) AS score FROM total JOIN best USING (candidate, fold) JOIN hit USING (candidate, fold)),
fits AS (SELECT f.fold, candidate, avg(score) AS m FROM (SELECT DISTINCT fold FROM cell) f JOIN scores s ON s.fold <> f.fold GROUP BY ALL)
SELECT fold, max_by(candidate, (round(m, 12), -candidate))::INT AS candidate, round(max(m), 6) AS fit_mean FROM fits GROUP BY fold"""


@query("lofo_weights", WEIGHTS)
def _(spark, sf_dir):
    scores = ensemble.candidate_scores(members(spark, sf_dir), raster(spark, sf_dir), ["a", "b", "c"])
    return rounded(ensemble.lofo_weights(scores))


@query("minmax_fit", f"WITH {RASTER}, s AS (SELECT min(v) AS lo, max(v) AS hi FROM raster WHERE valid AND fold <> 0) SELECT row, col, round((v - lo) / (hi - lo), 6) AS v FROM raster, s")
def _(spark, sf_dir):
    cells = raster(spark, sf_dir).withColumn("fit", F.col("valid") & (F.col("fold") != 0))
    return rounded(features.normalise_on_fit(cells, ["v"], "fit").select("row", "col", "v"))


@query("percentile_clip", f"WITH {RASTER}, s AS (SELECT quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM raster WHERE valid) SELECT row, col, round(least(1, greatest(0, (v - lo) / (hi - lo))), 6) AS v FROM raster, s WHERE valid")
def _(spark, sf_dir):
    return rounded(features.percentile_clip(raster(spark, sf_dir), "v", "valid").where("valid").select("row", "col", "v"))


GRADIENT = f"""WITH {RASTER}, z AS (SELECT row, col, valid, CASE WHEN valid THEN v ELSE 0 END AS x FROM raster), n AS (
  SELECT *, lag(x) OVER d AS u, lead(x) OVER d AS b, lag(x) OVER a AS l, lead(x) OVER a AS r FROM z WINDOW d AS (PARTITION BY col ORDER BY row), a AS (PARTITION BY row ORDER BY col)
), g AS (SELECT row, col, valid, CASE WHEN u IS NOT NULL AND b IS NOT NULL THEN (b - u) / 2 WHEN b IS NOT NULL THEN b - x ELSE x - u END AS gy,
  CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN (r - l) / 2 WHEN r IS NOT NULL THEN r - x ELSE x - l END AS gx FROM n),
e AS (SELECT row, col, CASE WHEN valid THEN sqrt(gy * gy + gx * gx) ELSE 0 END AS energy FROM g)"""


@query("gradient_energy", GRADIENT + " SELECT row, col, round(energy, 6) AS energy FROM e")
def _(spark, sf_dir):
    return rounded(features.gradient_energy(raster(spark, sf_dir), ["v"]))


@query("phase_edge", GRADIENT + " SELECT row, col, round(energy, 6) AS energy, round(4 * 0.5 * energy / (1 + 4 * 0.5 * energy), 6) AS edge FROM e")
def _(spark, sf_dir):
    return rounded(features.phase_edge(features.gradient_energy(raster(spark, sf_dir), ["v"]), 0.5))


@query("shifted_bands", f"WITH {RASTER} SELECT a.row, a.col, CASE WHEN a.valid THEN coalesce(b.v, 0) ELSE 0 END::DOUBLE AS v FROM raster a LEFT JOIN (SELECT * FROM raster WHERE valid) b ON b.row = a.row - 1 AND b.col = a.col + 1")
def _(spark, sf_dir):
    return features.shift_channels(raster(spark, sf_dir), ["v"], 1, -1).select("row", "col", "v")


@query("downsample_any", f"WITH {RASTER} SELECT row // 4 AS row, col // 4 AS col, bool_or(truth) AS truth FROM raster GROUP BY ALL")
def _(spark, sf_dir):
    return features.downsample_any(raster(spark, sf_dir), "truth", 4)
