"""Run manifests, previews, verdict text, and the substitute trainer."""

from __future__ import annotations

import hashlib
import json
import struct
import subprocess
import sys
import zlib
from datetime import UTC, datetime
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.audit import fingerprint, manifest_hash


#: Session settings that can change what a run computes or how it is split.
RECORDED = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.ansi.enabled", "spark.sql.session.timeZone", "spark.sql.files.maxPartitionBytes")


def _checkout() -> dict:
    ask = lambda *a: subprocess.run(["git", *a], capture_output=True, text=True)
    head = ask("rev-parse", "HEAD")
    return {"head": head.stdout.strip(), "clean": not ask("status", "--porcelain").stdout.strip()} if head.returncode == 0 else {}


def run_manifest(spark: SparkSession, run: str, config: dict, artifacts: str, inputs: str | None = None) -> dict:
    """What it takes to repeat a Spark run: application, settings, versions, checkout, and digests of configuration, inputs and artifacts."""
    from importlib.metadata import version

    digests = {name: [r.asDict() for r in fingerprint(spark, path).collect()] for name, path in (("inputs", inputs), ("artifacts", artifacts)) if path}
    canonical = json.dumps(config, sort_keys=True, separators=(",", ":")).encode()
    return {
        "run": run,
        "recorded": datetime.now(UTC).isoformat(),
        "application": {"id": spark.sparkContext.applicationId, "master": spark.sparkContext.master, "parallelism": spark.sparkContext.defaultParallelism},
        "settings": {k: spark.conf.get(k, None) for k in RECORDED},
        "versions": {"spark": spark.version, "python": sys.version.split()[0]} | {k: version(k) for k in ("numpy", "pandas", "pyarrow")},
        "checkout": _checkout(),
        "config_sha256": hashlib.sha256(canonical).hexdigest(),
    } | {name: {"files": rows, "sha256": manifest_hash(rows)} for name, rows in digests.items()}


def preview_stride(height: int, width: int, most: int) -> int:
    return max(1, -(-max(height, width) // most))


def preview(cells: DataFrame, stride: int) -> DataFrame:
    """row, col, r, g, b of a smaller picture: truth red (any cell of the block), prediction green (largest), valid area dim blue."""
    key = [F.floor(F.col("row") / stride).alias("row"), F.floor(F.col("col") / stride).alias("col")]
    out = cells.groupBy(*key).agg(F.bool_or(F.col("truth") & F.col("valid")).alias("t"), F.max(F.when(F.col("valid"), F.col("p"))).alias("p"), F.bool_or("valid").alias("v"))
    return out.select("row", "col", F.when(F.col("t"), 255).otherwise(0).alias("r"), F.rint(F.col("p") * 255).cast("int").alias("g"), F.when(F.col("v"), 64).otherwise(0).alias("b"))


def png(picture: DataFrame, path: str) -> None:
    """Write row, col, r, g, b as an 8-bit PNG; a preview is small by its stride, so its cells may come to the driver."""
    rows = picture.select("row", "col", *[F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in "rgb"]).toPandas()
    h, w = int(rows["row"].max()) + 1, int(rows["col"].max()) + 1
    pixels = np.zeros((h, w, 3), np.uint8)
    pixels[rows["row"], rows["col"]] = rows[["r", "g", "b"]].to_numpy()
    lines = np.concatenate((np.zeros((h, 1), np.uint8), pixels.reshape(h, w * 3)), axis=1)  # each line begins with its filter, none
    chunks = ((b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)), (b"IDAT", zlib.compress(lines.tobytes())), (b"IEND", b""))
    data = b"".join(struct.pack(">I", len(x)) + kind + x + struct.pack(">I", zlib.crc32(kind + x)) for kind, x in chunks)
    Path(path).write_bytes(b"\x89PNG\r\n\x1a\n" + data)


def centre_sample(cells: DataFrame, stride: int, height: int, width: int) -> DataFrame:
    """The cell at each block's centre, clamped to the raster."""
    half = stride // 2
    at = lambda x, n: F.col(x) == F.least(F.floor(F.col(x) / stride) * stride + half, F.lit(n - 1))
    return cells.where(at("row", height) & at("col", width)).withColumns({"row": F.floor(F.col("row") / stride), "col": F.floor(F.col("col") / stride)})


def verdict_text(report: dict) -> str:
    """A gate report as Markdown."""
    head = ["# " + report["candidate"], "", f"Verdict: **{report['verdict']}** (trials before: {report['trials_before']}, multiplier {report['escalation_multiplier']:.3f})", "", "| view | comparable | delta | margin | won | reason |", "|-|-|-|-|-|-|"]
    show = lambda x: "-" if x is None else f"{x:.6f}" if isinstance(x, float) else str(x)
    return "\n".join(head + ["| " + " | ".join(show(v[k]) for k in ("view", "comparable", "delta", "required_margin", "won", "reason")) + " |" for v in report["views"]])


def fit_cells(cells: DataFrame, bands: list[str], train: str):
    """A logistic regression on cells, in place of a network that needs what is not installed here."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = cells.where(F.col(train) & F.col("valid")).select(*bands, F.col("truth").cast("double").alias("label"))
    return Pipeline(stages=[VectorAssembler(inputCols=bands, outputCol="features", handleInvalid="skip"), LogisticRegression(maxIter=20, regParam=1e-4)]).fit(rows)


def predict_cells(model, cells: DataFrame) -> DataFrame:
    """``cells`` with p."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(cells.drop("p"))
    return out.withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
