"""The canonical raster of the driver tables: each embedding is a row of 64 cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("row"), "label", F.posexplode("embedding").alias("col", "v"))
    row, col, v = F.col("row"), F.col("col").cast("long"), F.col("v").cast("double")
    block_row, block_col = F.floor(row / 64), F.floor(col / 16)
    return cells.select(
        "row", col.alias("col"), v.alias("v"), "label", F.least(F.lit(1.0), F.greatest(F.lit(0.0), v + 0.5)).alias("p"), (row % 7 != 3).alias("valid"),
        ((row * 31 + col * 17) % 41 == 0).alias("truth"), block_row.alias("block_row"), block_col.alias("block_col"), ((block_row * 4 + block_col) % 5).alias("fold"),
    )


RASTER = """cells AS (
  SELECT vec_id AS row, label, unnest(range(len(embedding)))::BIGINT AS col, unnest(embedding)::DOUBLE AS v FROM embeddings
), raster AS (
  SELECT row, col, v, label, least(1, greatest(0, v + 0.5)) AS p, row % 7 <> 3 AS valid, (row * 31 + col * 17) % 41 = 0 AS truth,
         row // 64 AS block_row, col // 16 AS block_col, ((row // 64) * 4 + col // 16) % 5 AS fold
  FROM cells
)"""
