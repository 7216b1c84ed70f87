"""Queries: the canonical raster written as files and read back, and what the files say of themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators.grid import NAN, shared_path
from gridloom.plans.collect import Plans
from gridloom.plans.raster import RASTER, raster as canonical
from gridloom.plans.scoring import rounded
from gridloom.sources import raster

query = Plans()
#: Rows and columns of a file.
SIDE = 48


def written(spark, sf_dir) -> str:
    """The raster's v and p as files, with nodata outside valid cells."""
    cells = canonical(spark, sf_dir)
    uri = shared_path(spark, "raster")
    height = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    inside = [F.when(F.col("valid"), F.col(b)).otherwise(F.lit(NAN)).alias(b) for b in ("v", "p")]
    raster.write_raster(cells.select("row", "col", *inside), uri, ["v", "p"], height, 64, "float32", NAN, SIDE, (100.0, 100.0), (0.0, 0.0, 0.0, 300000.0, 4400000.0, 0.0), 32611)
    return uri


@query("raster_files", f"WITH {RASTER} SELECT row, col, valid, CASE WHEN valid THEN round(v::FLOAT::DOUBLE, 6) END AS v, CASE WHEN valid THEN round(p::FLOAT::DOUBLE, 6) END AS p FROM raster")
def _(spark, sf_dir):
    back = raster.read_raster(spark, written(spark, sf_dir))
    return rounded(back.select("row", "col", "valid", *[F.when(F.col("valid"), F.col(f"b{i}").cast("double")).alias(b) for i, b in ((1, "v"), (2, "p"))]))


@query("raster_signatures", f"""WITH n AS (SELECT count(*) AS height FROM embeddings), r AS (SELECT unnest(range(0, height, {SIDE})) AS row0, height FROM n), c AS (SELECT unnest(range(0, 64, {SIDE})) AS col0)
SELECT row0, col0, least({SIDE}, height - row0) AS height, least({SIDE}, 64 - col0) AS width, 2::BIGINT AS bands, 'float32' AS dtype, 'nan' AS nodata, 'EPSG:32611' AS crs,
(300000 + 100 * col0)::DOUBLE AS left, (4400000 - 100 * row0)::DOUBLE AS top, 100::DOUBLE AS cell FROM r, c""")
def _(spark, sf_dir):
    return raster.signatures(spark, written(spark, sf_dir))


@query("raster_block_scan", f"""WITH {RASTER} SELECT row // {SIDE} AS block_row, col // {SIDE} AS block_col, count(*) FILTER (valid) AS valid_pixels, count(*) FILTER (NOT valid) AS missing_pixels,
round(min(CASE WHEN valid THEN v END)::FLOAT::DOUBLE, 6) AS minimum, round(max(CASE WHEN valid THEN v END)::FLOAT::DOUBLE, 6) AS maximum FROM raster GROUP BY ALL""")
def _(spark, sf_dir):
    cells = raster.read_raster(spark, written(spark, sf_dir), [1])
    keys = [F.floor(F.col(x) / SIDE).alias(f"block_{x}") for x in ("row", "col")]
    value = F.when(F.col("valid"), F.col("b1").cast("double"))
    return rounded(cells.groupBy(*keys).agg(F.count_if("valid").alias("valid_pixels"), F.count_if(~F.col("valid")).alias("missing_pixels"), F.min(value).alias("minimum"), F.max(value).alias("maximum")))
