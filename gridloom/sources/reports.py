"""Reports, queues and rasters as tables, and back."""

from __future__ import annotations

import json
import math
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.gate import REPORT
from gridloom.operators.grid import NAN


def score_reports(spark: SparkSession, path: str) -> DataFrame:
    """Score reports below ``path`` with their file name."""
    rows = spark.read.schema(REPORT).option("multiLine", True).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)
    return rows.withColumn("file", F.input_file_name())


def fold_scores(reports: DataFrame) -> DataFrame:
    return reports.select("file", "scheme", F.explode("folds").alias("f")).select("file", "scheme", "f.*")


def tasks(spark: SparkSession, path: str) -> DataFrame:
    """The queue with its order: ord, id, step, cmd, note."""
    rows = spark.read.option("wholetext", True).text(path)
    kind = "array<struct<id: string, step: int, cmd: string, note: string>>"
    return rows.select(F.posexplode(F.from_json("value", kind)).alias("ord", "t")).select("ord", "t.*")


def fold_predictions(spark: SparkSession, path: str, folds: list[int]) -> DataFrame:
    """row, col, p, fold of the folds asked for; other folds' partitions are not read. A fold without rows is an error."""
    rows = spark.read.parquet(path).where(F.col("fold").isin(folds))
    if missing := set(folds) - {r[0] for r in rows.select("fold").distinct().collect()}:
        raise ValueError(f"no predictions for folds {sorted(missing)}")
    return rows


def write_predictions(cells: DataFrame, template: DataFrame, path: str) -> None:
    """On the template's cells: finite in 0..1 inside its valid cells, NaN outside, float32, partitioned by fold if there is one."""
    from gridloom.operators.grid import check_predictions

    keys = ["row", "col"]
    out = template.select(*keys, "valid").join(cells.drop("valid"), keys, "left")
    check_predictions(out.select(F.coalesce("p", F.lit(NAN)).alias("p"), "valid"))
    out = out.withColumn("p", F.when(F.col("valid"), F.col("p")).otherwise(F.lit(NAN)).cast("float")).drop("valid")
    writer = out.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy("fold") if "fold" in out.columns else writer).parquet(path)


def write_fold_map(cells: DataFrame, path: str) -> None:
    """fold as a short, -1 where unassigned."""
    cells.select("row", "col", F.coalesce("fold", F.lit(-1)).cast("short").alias("fold")).write.mode("overwrite").parquet(path)


def write_json(report: dict, path: str) -> None:
    """Indented, with sorted keys, under another name first and then renamed, so that no reader sees half a report."""
    text = json.dumps(report, indent=2, sort_keys=True, default=str)
    with open(f"{path}.tmp", "w", encoding="utf-8") as out:
        out.write(text + "\n")
        out.flush()
        os.fsync(out.fileno())
    os.replace(f"{path}.tmp", path)


def signature(cells: DataFrame, height: int, width: int, crs: str | None = None, transform: tuple[float, ...] = (), bounds: tuple[float, ...] = (), nodata: float | None = None, tags: list[dict] | None = None) -> dict:
    """Geometry and bands of a cell table; numbers that are not finite become text."""
    plain = lambda x: x if x is None or math.isfinite(x) else str(x)
    bands = [f for f in cells.schema.fields if f.name not in ("row", "col")]
    return {
        "height": height, "width": width, "count": len(bands), "bands": [f.name for f in bands], "dtypes": [f.dataType.simpleString() for f in bands], "crs": crs,
        "transform": [plain(x) for x in transform], "bounds": [plain(x) for x in bounds], "nodata": plain(nodata), "band_tags": tags or [{} for _ in bands],
    }
