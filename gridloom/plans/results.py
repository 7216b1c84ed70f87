"""Queries: audits of results and of a feature stack over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import bands, results
from gridloom.operators.queue import VIEWS
from gridloom.plans.collect import Plans
from gridloom.plans.raster import RASTER, raster
from gridloom.plans.scoring import rounded

query = Plans()


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Users as runs with a score for each of up to five folds, some out of range, some means not theirs.
RAW = """f AS (SELECT user_id AS run, 'spatial' AS scheme, event_id % 5 AS fold, avg(value) / 150 AS score FROM events GROUP BY ALL),
t AS (SELECT run, scheme, avg(score) + CASE WHEN run % 7 = 0 THEN 0.01 ELSE 0 END AS macro_mean, stddev_pop(score) + CASE WHEN run % 11 = 0 THEN 0.01 ELSE 0 END AS macro_std, CASE WHEN run % 13 = 0 THEN 1.5 ELSE 0.5 END AS aggregate_score, CASE WHEN run % 17 = 0 THEN 0.3 ELSE 0.2 END AS alpha FROM f GROUP BY run, scheme),
e AS (SELECT run, scheme, count(*) FILTER (score < 0 OR score > 1) AS outside, list_sort(list(DISTINCT fold)) AS ids, avg(score) AS m, stddev_pop(score) AS s FROM f GROUP BY ALL)"""


@query("raw_score_findings", f"""WITH {RAW}, x AS (SELECT run || '/' || scheme AS subject, unnest(list_filter([CASE WHEN outside > 0 THEN 'FOLD_SCORE_RANGE' END, CASE WHEN ids <> [0, 1, 2, 3, 4] THEN 'FOLD_IDS' END,
CASE WHEN abs(macro_mean - m) > 1e-6 * greatest(1, abs(macro_mean), abs(m)) THEN 'MACRO_MEAN' END, CASE WHEN abs(macro_std - s) > 1e-6 * greatest(1, abs(macro_std), abs(s)) THEN 'MACRO_STD' END,
CASE WHEN aggregate_score > 1 THEN 'AGGREGATE_RANGE' END, CASE WHEN alpha <> 0.2 THEN 'PROTOCOL' END], lambda c: c IS NOT NULL)) AS code FROM t JOIN e USING (run, scheme)) SELECT 'error' AS severity, code, subject FROM x""")
def _(spark, sf_dir):
    folds = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run"), (F.col("event_id") % 5).alias("fold")).agg((F.avg("value") / 150).alias("score")).withColumn("scheme", F.lit("spatial"))
    run, off = F.col("run"), lambda k, a, b: F.when(F.col("run") % k == 0, a).otherwise(b)
    tops = folds.groupBy("run", "scheme").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s"))
    tops = tops.select(run, "scheme", (F.col("m") + off(7, 0.01, 0.0)).alias("macro_mean"), (F.col("s") + off(11, 0.01, 0.0)).alias("macro_std"), off(13, 1.5, 0.5).alias("aggregate_score"), off(17, 0.3, 0.2).alias("alpha"), F.lit(None).cast("double").alias("beta"), F.lit(None).cast("string").alias("metric"))
    return results.raw_score_findings(tops, folds)


#: Pages as files of runs by host number; recorded ones are of another size or content, or have moved or gone.
FILES = """p AS (SELECT page_id, page_id % 40 AS run, 'runs/' || page_id % 40 || '/' || page_id || '.json' AS path, strlen(html) AS bytes, sha256(html) AS sha256 FROM pages),
now AS (SELECT run, CASE WHEN page_id % 5 = 1 THEN 'runs/' || run || '/scores/' || page_id || '.json' ELSE path END AS path, CASE WHEN page_id % 5 = 2 THEN bytes + 1 ELSE bytes END AS bytes, CASE WHEN page_id % 5 = 3 THEN 'x' ELSE sha256 END AS sha256 FROM p WHERE page_id % 5 <> 4),
old AS (SELECT run, path, bytes, sha256 FROM p WHERE run % 9 <> 0)"""


@query("manifest_findings", f"""WITH {FILES}, b AS (SELECT o.*, n.bytes AS now, n.sha256 AS hash, EXISTS (SELECT 1 FROM now m WHERE m.run = o.run AND m.sha256 = o.sha256 AND split_part(m.path, '/', -1) = split_part(o.path, '/', -1)) AS moved FROM old o LEFT JOIN now n ON n.path = o.path)
SELECT CASE WHEN now IS NULL THEN 'finding' ELSE 'error' END AS severity, CASE WHEN now IS NULL AND moved THEN 'RELOCATED' WHEN now IS NULL THEN 'MISSING_ARTIFACT' WHEN now <> bytes THEN 'SIZE' ELSE 'SHA256' END AS code, run || ':' || path AS subject
FROM b WHERE now IS NULL OR now <> bytes OR hash <> sha256 UNION ALL SELECT 'finding', 'MISSING_MANIFEST', run::VARCHAR FROM (SELECT DISTINCT run FROM p WHERE run % 9 = 0)""")
def _(spark, sf_dir):
    i, run = F.col("page_id"), F.col("page_id") % 40
    pages = read(spark, sf_dir, "pages").select(i, run.alias("run"), F.concat(F.lit("runs/"), run, F.lit("/"), i, F.lit(".json")).alias("path"), F.octet_length("html").cast("long").alias("bytes"), F.sha2("html", 256).alias("sha256"))
    kind = i % 5
    now = pages.where(kind != 4).select("run", F.when(kind == 1, F.concat(F.lit("runs/"), "run", F.lit("/scores/"), i, F.lit(".json"))).otherwise(F.col("path")).alias("path"), F.when(kind == 2, F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes"), F.when(kind == 3, "x").otherwise(F.col("sha256")).alias("sha256"))
    return results.manifest_findings(pages.where("run % 9 <> 0").drop("page_id"), now, pages.select("run"))


#: Orders as gate reports, their lines as views.
GATES = """r AS (SELECT o_orderkey AS name, CASE o_orderstatus WHEN 'F' THEN 'REJECT' WHEN 'O' THEN 'ACCEPT' ELSE 'odd' END AS verdict, o_orderkey % 6 AS trials, 1 + 0.5 * log2(1 + o_orderkey % 6) + CASE WHEN o_orderkey % 19 = 0 THEN 0.1 ELSE 0 END AS factor FROM orders),
v AS (SELECT l_orderkey AS name, l_linenumber::VARCHAR AS view, l_returnflag <> 'N' AS comparable, CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE l_discount END AS cm, l_tax AS im, l_tax / 2 AS cs, l_discount / 4 AS si,
  l_discount - l_tax + CASE WHEN l_partkey % 29 = 0 THEN 0.001 ELSE 0 END AS delta, greatest(l_tax / 2, l_discount / 4) * (1 + 0.5 * log2(1 + l_orderkey % 6)) AS margin, l_partkey % 31 = 0 AS flip FROM lineitem)"""


@query("gate_findings", f"""WITH {GATES}, w AS (SELECT *, (delta > margin) <> flip AS won FROM v), n AS (SELECT name, count(*) FILTER (comparable AND won) AS won FROM w GROUP BY name),
top AS (SELECT name::VARCHAR AS subject, unnest(list_filter([CASE WHEN verdict = 'odd' THEN 'VERDICT' END, CASE WHEN name % 19 = 0 THEN 'MULTIPLIER' END, CASE WHEN n.won IS NULL THEN 'NO_VIEWS' END, CASE WHEN verdict = 'REJECT' AND n.won > 0 THEN 'REJECT_BUT_WON' END], lambda c: c IS NOT NULL)) AS code FROM r LEFT JOIN n USING (name)),
parts AS (SELECT w.name || '/' || view AS subject, unnest(CASE WHEN cm IS NULL THEN ['FIELDS'] ELSE list_filter([CASE WHEN abs(delta - (cm - im)) > 1e-9 THEN 'DELTA' END, CASE WHEN abs(margin - greatest(si, cs) * factor) > 1e-9 THEN 'MARGIN' END, CASE WHEN flip THEN 'WON' END], lambda c: c IS NOT NULL) END) AS code FROM w JOIN r USING (name) WHERE comparable)
SELECT 'error' AS severity, code, subject FROM top UNION ALL SELECT 'error', code, subject FROM parts""")
def _(spark, sf_dir):
    trials = F.col("o_orderkey") % 6
    verdict = F.when(F.col("o_orderstatus") == "F", "REJECT").when(F.col("o_orderstatus") == "O", "ACCEPT").otherwise("odd")
    reports = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("name"), verdict.alias("verdict"), trials.alias("trials_before"), (1 + 0.5 * F.log2(1 + trials) + F.when(F.col("o_orderkey") % 19 == 0, 0.1).otherwise(0.0)).alias("escalation_multiplier"))
    part, margin = F.col("l_partkey"), F.greatest(F.col("l_tax") / 2, F.col("l_discount") / 4) * (1 + 0.5 * F.log2(1 + F.col("l_orderkey") % 6))
    views = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("name"), F.col("l_linenumber").cast("string").alias("view"), (F.col("l_returnflag") != "N").alias("comparable"), F.when(part % 23 != 0, F.col("l_discount")).alias("candidate_mean"), F.col("l_tax").alias("incumbent_mean"),
        (F.col("l_tax") / 2).alias("candidate_std"), (F.col("l_discount") / 4).alias("incumbent_std"), (F.col("l_discount") - F.col("l_tax") + F.when(part % 29 == 0, 0.001).otherwise(0.0)).alias("delta"), margin.alias("required_margin"), (part % 31 == 0).alias("flip"),
    ).withColumn("won", (F.col("delta") > F.col("required_margin")) != F.col("flip"))
    return results.gate_findings(reports, views)


#: Customers as gates on folders; orders as the views that are there.
READY = """g AS (SELECT c_custkey AS name, 'i' || c_custkey % 97 AS incumbent_dir, 'c' || c_custkey AS candidate_dir FROM customer WHERE c_custkey % 10 <> 9), r AS (SELECT c_custkey AS name, CASE c_custkey % 3 WHEN 0 THEN 'ACCEPT' ELSE 'odd' END AS verdict FROM customer WHERE c_custkey % 4 = 1 OR c_custkey % 10 = 9),
f AS (SELECT DISTINCT 'c' || o_custkey AS folder, CASE o_orderkey % 3 WHEN 0 THEN 'spatial' WHEN 1 THEN 'fault' ELSE 'trace' END AS view FROM orders)"""


def gates(spark, sf_dir):
    own, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    queued = own.where("c_custkey % 10 <> 9").select(k.alias("name"), F.concat(F.lit("i"), k % 97).alias("incumbent_dir"), F.concat(F.lit("c"), k).alias("candidate_dir"))
    reports = own.where("c_custkey % 4 = 1 or c_custkey % 10 = 9").select(k.alias("name"), F.when(k % 3 == 0, "ACCEPT").otherwise("odd").alias("verdict"))
    view = F.element_at(F.array(*map(F.lit, VIEWS)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    files = read(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("folder"), view.alias("view")).distinct()
    return queued, reports, files


@query("gate_status", f"""WITH {READY}, t AS (SELECT folder, array_to_string(list_filter(['spatial', 'fault', 'trace'], lambda v: list_contains(list(view), v)), ', ') AS views FROM f GROUP BY folder)
SELECT g.name, CASE WHEN r.verdict = 'ACCEPT' THEN 'DECIDED' WHEN r.verdict IS NOT NULL THEN 'BROKEN' ELSE 'PENDING' END AS status, coalesce(r.verdict, t.views, '') AS detail FROM g LEFT JOIN r USING (name) LEFT JOIN t ON t.folder = g.candidate_dir
UNION ALL SELECT r.name, 'ORPHAN', r.verdict FROM r WHERE r.name NOT IN (SELECT name FROM g)""")
def _(spark, sf_dir):
    return results.gate_status(*gates(spark, sf_dir))


@query("gate_readiness", f"""WITH {READY}, x AS (SELECT name, side, CASE side WHEN 'incumbent' THEN incumbent_dir ELSE candidate_dir END AS folder, view FROM g, (SELECT unnest(['incumbent', 'candidate']) AS side), (SELECT unnest(['spatial', 'fault', 'trace']) AS view) WHERE name NOT IN (SELECT name FROM r WHERE verdict = 'ACCEPT')),
m AS (SELECT 'i' || s_suppkey % 97 AS folder, 'fault' AS view, count(DISTINCT s_suppkey) AS n FROM supplier GROUP BY ALL)
SELECT x.name, side, x.view, CASE WHEN f.folder IS NULL THEN 'MISSING' WHEN x.view = 'trace' THEN 'INVALID' ELSE 'VALID' END AS status, CASE WHEN f.folder IS NULL THEN coalesce(m.n, 0) ELSE 0 END AS producers FROM x LEFT JOIN f ON f.folder = x.folder AND f.view = x.view LEFT JOIN m ON m.folder = x.folder AND m.view = x.view""")
def _(spark, sf_dir):
    queued, reports, files = gates(spark, sf_dir)
    makes = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("idx"), F.col("s_suppkey").cast("string").alias("id"), F.concat(F.lit("gate:i"), F.col("s_suppkey") % 97, F.lit("/fault")).alias("artifact"))
    return results.gate_readiness(queued, reports, files.withColumn("errors", F.when(F.col("view") == "trace", 2).otherwise(0)), makes)


#: Masks and labels that differ in places, and a band that is missing in others.
STACK = f"{RASTER}, s AS (SELECT row, valid AS f, valid OR row % 14 = 3 AS y, valid AND row % 10 <> 2 AS t, CASE WHEN truth THEN 1 WHEN col = 5 THEN 2 ELSE 0 END AS label, CASE WHEN valid AND col > 2 THEN v END AS a, CASE WHEN valid THEN p END AS b FROM raster)"


def stack(spark, sf_dir):
    valid = F.col("valid")
    return raster(spark, sf_dir).select("row", "col", valid.alias("feature_valid"), (valid | (F.col("row") % 14 == 3)).alias("label_valid"), (valid & (F.col("row") % 10 != 2)).alias("template_valid"), F.when(F.col("truth"), 1).when(F.col("col") == 5, 2).otherwise(0).alias("label"), F.when(valid & (F.col("col") > 2), F.col("v")).alias("a"), F.when(valid, F.col("p")).alias("b"))


@query("band_scan", f"""WITH {STACK}, l AS (SELECT 'a' AS band, f, a AS x FROM s UNION ALL SELECT 'b', f, b FROM s)
SELECT band, count(x) AS valid_pixels, count(*) FILTER (x IS NULL) AS missing_pixels, count(*) FILTER (x IS NOT NULL AND f) AS inside, round(min(x), 6) AS minimum, round(max(x), 6) AS maximum, round(count(*) FILTER (x IS NOT NULL AND f) / count(*) FILTER (f), 6) AS coverage FROM l GROUP BY band""")
def _(spark, sf_dir):
    return rounded(bands.pixel_scan(stack(spark, sf_dir), ["a", "b"])[1])


@query("band_findings", f"""WITH {STACK} SELECT severity, code, subject FROM (SELECT 'error' AS severity, 'LABEL_VALUES' AS code, 'stack' AS subject, count(*) FILTER (y AND label > 1) AS n FROM s UNION ALL SELECT 'warning', 'FEATURE_LABEL_MASKS', 'stack', count(*) FILTER (f <> y) FROM s
UNION ALL SELECT 'warning', 'LABEL_TEMPLATE_MASKS', 'stack', count(*) FILTER (y <> t) FROM s UNION ALL SELECT 'warning', 'FAULTS_OUTSIDE_FEATURES', 'stack', count(*) FILTER (label > 0 AND y AND NOT f) FROM s
UNION ALL SELECT 'warning', 'BAND_INCOMPLETE', 'a', count(*) FILTER (f AND a IS NULL) FROM s UNION ALL SELECT 'warning', 'BAND_INCOMPLETE', 'b', count(*) FILTER (f AND b IS NULL) FROM s) WHERE n > 0""")
def _(spark, sf_dir):
    return bands.scan_findings(*bands.pixel_scan(stack(spark, sf_dir), ["a", "b"]))
