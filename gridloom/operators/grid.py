"""Rasters as cell tables: row, col and one column for each band or mask."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAN = float("nan")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the session's executors share, under the application's id."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file:///tmp/checkpoints"
    return f"{folder}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: loops stay short and recoverable. With ``by``, rows of one value of it are read without the others."""
    path = shared_path(df.sparkSession, label)
    (df.write if by is None else df.write.partitionBy(by)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def in_ranges(df: DataFrame, order: list[str], label: str) -> DataFrame:
    """``df`` with part: as many ranges of like size as the session shuffles to, in the order of ``order``.

    The table is written, so that every reader sees the same ranges. Columns should tell rows apart, so that no
    value that very many rows have makes a large range.
    """
    return materialise(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), label)


@dataclass(frozen=True)
class GridSpec:
    """The geometry that two rasters must share before their cells may be joined."""

    height: int
    width: int
    crs: str = ""
    transform: tuple[float, ...] = ()
    bounds: tuple[float, ...] = ()

    def errors(self, other: GridSpec) -> list[str]:
        return [f"{name} differs" for name in ("height", "width", "crs", "transform", "bounds") if getattr(self, name) != getattr(other, name)]


def clean_features(cells: DataFrame, bands: list[str], label: str | None = None) -> DataFrame:
    """Nodata (below -1e38) becomes NaN; labels below 1 become 0."""
    out = cells.withColumns({b: F.when(F.col(b) < -1e38, F.lit(NAN)).otherwise(F.col(b)) for b in bands})
    return out if label is None else out.withColumn(label, F.when(F.col(label) < 1, 0).otherwise(F.col(label)))


def kernel_offsets(radius: float) -> list[tuple[int, int, float]]:
    """Offsets of positive weight 1 - distance / radius; 25 of them at radius 3."""
    if not (math.isfinite(radius) and radius > 0):
        raise ValueError("radius must be finite and positive")
    reach = range(-math.ceil(radius), math.ceil(radius) + 1)
    return [(dy, dx, 1 - math.hypot(dy, dx) / radius) for dy in reach for dx in reach if math.hypot(dy, dx) < radius]


def disk_offsets(radius: float) -> list[tuple[int, int, float]]:
    """Offsets with y^2 + x^2 <= radius^2."""
    reach = range(-math.floor(radius), math.floor(radius) + 1)
    return [(dy, dx, 1.0) for dy in reach for dx in reach if dy * dy + dx * dx <= radius * radius]


def offset_column(offsets: list[tuple[int, int, float]]) -> Column:
    """An array literal of structs dy, dx, w; exploding it makes a distance join an equi-join."""
    return F.array(*[F.struct(F.lit(y).cast("long").alias("dy"), F.lit(x).cast("long").alias("dx"), F.lit(float(w)).alias("w")) for y, x, w in offsets])


def spread(cells: DataFrame, offsets: list[tuple[int, int, float]], keep: list[str] | None = None) -> DataFrame:
    """Every cell once for each offset: row and col moved, w, and the origin as from_row and from_col."""
    keep = keep or []
    out = cells.select(*keep, F.col("row").alias("from_row"), F.col("col").alias("from_col"), F.explode(offset_column(offsets)).alias("o"))
    return out.select(*keep, "from_row", "from_col", (F.col("from_row") + F.col("o.dy")).alias("row"), (F.col("from_col") + F.col("o.dx")).alias("col"), F.col("o.w").alias("w"))


def bad_predictions(cells: DataFrame) -> DataFrame:
    """One row: cells inside the valid mask that are not a number, and that lie outside 0 to 1; both must be 0."""
    p, valid = F.col("p"), F.col("valid")
    missing = p.isNull() | F.isnan("p")
    return cells.agg(F.count_if(valid & missing).alias("not_finite"), F.count_if(valid & ~missing & ((p < 0) | (p > 1))).alias("out_of_range"))


def check_predictions(cells: DataFrame) -> None:
    found = bad_predictions(cells).first()
    if found["not_finite"] or found["out_of_range"]:
        raise ValueError(f"predictions inside the valid mask: {found['not_finite']} not finite, {found['out_of_range']} outside 0 to 1")


def submission_report(cells: DataFrame, template: DataFrame, spec: GridSpec, template_spec: GridSpec, epsg: str = "EPSG:32611") -> DataFrame:
    """One row of findings: cells finite outside the template's valid cells, missing inside, out of range, and whether p is constant."""
    errors = spec.errors(template_spec) + ([] if spec.crs == epsg else [f"crs is not {epsg}"])
    both = template.select("row", "col", "valid").join(cells.select("row", "col", "p"), ["row", "col"], "full_outer")
    inside, missing = F.coalesce("valid", F.lit(False)), F.col("p").isNull() | F.isnan("p")
    return both.agg(
        F.count_if(~inside & ~missing).alias("finite_outside"),
        F.count_if(inside & missing).alias("missing_inside"),
        F.count_if(inside & ~missing & ((F.col("p") < 0) | (F.col("p") > 1))).alias("out_of_range"),
        (F.min(F.when(inside & ~missing, F.col("p"))) == F.max(F.when(inside & ~missing, F.col("p")))).alias("constant"),
    ).withColumn("geometry_errors", F.array(*map(F.lit, errors)).cast("array<string>"))
