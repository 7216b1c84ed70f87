"""The audit of a feature stack with its labels and template: what its manifest says, and what a scan of the files finds."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.audit import fingerprint
from gridloom.sources import raster

GEOMETRY = ("crs", "width", "height", "transform", "bounds", "resolution")


@dataclass(frozen=True)
class Stack:
    """The names of a stack's three files, and the bands, reference system and cell size that it must have; roles of bands (others are covariates)."""

    features: str
    labels: str
    template: str
    bands: tuple[str, ...]
    crs: str = "EPSG:32611"
    cell: float = 100.0
    roles: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def files(self) -> tuple[str, str, str]:
        return self.features, self.labels, self.template


def _entries(manifest: dict, stack: Stack) -> dict[str, dict]:
    entries = {e["path"]: e for e in manifest["files"]}
    if len(entries) < len(manifest["files"]):
        raise ValueError("the manifest has a path twice")
    if missing := sorted(set(stack.files) - set(entries)):
        raise ValueError(f"the manifest lacks {missing}")
    return entries


def _geometry(signature: dict) -> dict:
    return {k: signature.get(k) for k in GEOMETRY}


def manifest_report(manifest: dict, stack: Stack) -> dict:
    """status (METADATA_ONLY or MANIFEST_FAILURE), errors, warnings and a line a band, from the manifest alone; it holds a few signatures, no cells."""
    found = {n: _entries(manifest, stack)[n]["raster"] for n in stack.files}
    own, errors, warnings = found[stack.features], [], []
    if manifest.get("snapshot_description"):
        warnings.append("a snapshot made by hand")
    else:
        text = json.dumps({k: v for k, v in manifest.items() if k != "manifest_sha256"}, sort_keys=True, separators=(",", ":"))
        errors += [] if manifest.get("manifest_sha256") == hashlib.sha256(text.encode()).hexdigest() else ["the manifest's own hash is wrong"]
    tags = own.get("band_tags", [])
    checks = {
        "grids differ": all(_geometry(s) == _geometry(own) for s in found.values()), f"features have not {len(stack.bands)} bands": own.get("count") == len(stack.bands), "band tags are incomplete": len(tags) == own.get("count"),
        "bands are others or in another order": tuple(t.get("band_name") for t in tags[: len(stack.bands)]) == stack.bands, f"features are not {stack.crs} at {stack.cell:g}": own.get("crs") == stack.crs and own.get("resolution") == [stack.cell] * 2,
        "labels have not one band": found[stack.labels].get("count") == 1, "the template has not one band": found[stack.template].get("count") == 1,
    }
    errors += [text for text, right in checks.items() if not right]
    bands = []
    for i, t in enumerate(tags, 1):
        units = t.get("units") or t.get("unit")
        bands.append({"index": i, "name": (name := t.get("band_name", f"band_{i}")), "role": next((r for r, names in stack.roles.items() if name in names), "other_covariate"), "category": t.get("data_category"), "units": units, "unit_verification": "NOT_VERIFIED" if units else "NOT_REPORTED"})
    return {"status": "MANIFEST_FAILURE" if errors else "METADATA_ONLY", "errors": errors, "warnings": warnings, "bands": bands}


def pixel_scan(cells: DataFrame, bands: list[str]) -> tuple[DataFrame, DataFrame]:
    """One row of counts over masks and labels, and a row a band: band, valid_pixels, missing_pixels, inside, coverage, minimum, maximum. One scan each.

    ``cells``: row, col, feature_valid, label_valid, template_valid, label, and bands that are null or NaN where missing.
    """
    f, y, t = F.col("feature_valid"), F.col("label_valid"), F.col("template_valid")
    masks = cells.agg(
        F.count(F.lit(1)).alias("total_pixels"), F.count_if(f).alias("feature_valid"), F.count_if(y).alias("label_valid"), F.count_if(t).alias("template_valid"), F.count_if(f != y).alias("feature_label_disagreement"),
        F.count_if(y != t).alias("label_template_disagreement"), F.count_if((F.col("label") > 0) & y & ~f).alias("known_positive_outside_feature_support"), F.count_if(y & ~F.col("label").isin(0, 1)).alias("unexpected_valid_label_pixels"),
    )
    x = F.col("s.x")
    has = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    long = cells.select("feature_valid", F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("x")) for b in bands])).alias("s"))
    each = long.groupBy("s.band").agg(
        F.count_if(has).alias("valid_pixels"), F.count_if(~has).alias("missing_pixels"), F.count_if(has & F.col("feature_valid")).alias("inside"), F.count_if("feature_valid").alias("support"), F.min(F.when(has, x)).alias("minimum"), F.max(F.when(has, x)).alias("maximum")
    )
    return masks, each.withColumn("coverage", F.coalesce(F.try_divide(F.col("inside").cast("double"), F.col("support")), F.lit(0.0))).drop("support")


def scan_findings(masks: DataFrame, bands: DataFrame) -> DataFrame:
    """severity, code, subject from the two tables of ``pixel_scan``; any error makes the audit fail."""
    whole = [
        ("error", "LABEL_VALUES", F.col("unexpected_valid_label_pixels") > 0), ("error", "NO_STUDY_AREA", F.col("feature_valid") == 0), ("warning", "FEATURE_LABEL_MASKS", F.col("feature_label_disagreement") > 0),
        ("warning", "LABEL_TEMPLATE_MASKS", F.col("label_template_disagreement") > 0), ("warning", "FAULTS_OUTSIDE_FEATURES", F.col("known_positive_outside_feature_support") > 0),
    ]
    row = lambda s, c: F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"))
    top = masks.select(F.explode(F.array_compact(F.array(*[F.when(wrong, row(s, c)) for s, c, wrong in whole]))).alias("x")).select("x.*", F.lit("stack").alias("subject"))
    kind = F.when(F.col("valid_pixels") == 0, row("error", "BAND_EMPTY")).when(F.col("coverage") < 1, row("warning", "BAND_INCOMPLETE"))
    return top.union(bands.select(kind.alias("x"), F.col("band").alias("subject")).where("x is not null").select("x.*", "subject"))


def live_report(spark: SparkSession, manifest: dict, stack: Stack, folder: str, verify_hashes: bool = True) -> dict:
    """status (PASS, UNVERIFIED_HASHES or FAIL), errors, warnings, masks and bands of the files below ``folder`` against the manifest.

    Files are hashed and scanned where tasks run. Grids or band counts that do not fit end the audit before the scan.
    """
    if manifest.get("snapshot_description"):
        raise ValueError("a snapshot made by hand cannot vouch for files")
    expected, errors, warnings = _entries(manifest, stack), [], []
    uris = {n: f"{folder.rstrip('/')}/{n}" for n in stack.files}
    signs = {n: raster.raster_signature(u) for n, u in uris.items()}
    if verify_hashes:
        known = {r["path"].rpartition("/")[2]: r for r in fingerprint(spark, folder).collect() if r["path"].rpartition("/")[2] in stack.files}
        for n in stack.files:
            errors += [f"{n}: {what} differs from the manifest" for what in ("bytes", "sha256") if known[n][what] != expected[n][what]]
    else:
        warnings += [f"{n}: hash not verified" for n in stack.files]
    for n in stack.files:
        if other := sorted(k for k in {*signs[n], *expected[n]["raster"]} if signs[n].get(k) != expected[n]["raster"].get(k)):
            errors.append(f"{n}: {', '.join(other)} differ from the manifest")
    own = signs[stack.features]
    fits = {"grids differ": all(_geometry(s) == _geometry(own) for s in signs.values()), "band counts are wrong": own["count"] == len(stack.bands) and all(signs[n]["count"] == 1 for n in stack.files[1:])}
    if bad := [text for text, right in fits.items() if not right]:
        return {"status": "FAIL", "errors": errors + bad, "warnings": warnings, "scan_skipped": bad}
    cells = raster.read_raster(spark, uris[stack.features]).withColumnRenamed("valid", "feature_valid")
    nodata = own["nodata"]
    names = [f"b{i + 1}" for i in range(len(stack.bands))]
    if isinstance(nodata, (int, float)):
        gone = F.lit(float(nodata)).cast(cells.schema["b1"].dataType)
        cells = cells.withColumns({b: F.when(F.col(b) != gone, F.col(b)) for b in names})
    y = raster.read_raster(spark, uris[stack.labels]).select("row", "col", F.col("valid").alias("label_valid"), F.col("b1").alias("label"))
    t = raster.read_raster(spark, uris[stack.template]).select("row", "col", F.col("valid").alias("template_valid"))
    masks, bands = pixel_scan(cells.join(y, ["row", "col"]).join(t, ["row", "col"]), names)
    found = [r.asDict() for r in scan_findings(masks, bands).collect()]  # a few rows: checks and bands
    errors += [f"{r['subject']}: {r['code']}" for r in found if r["severity"] == "error"]
    warnings += [f"{r['subject']}: {r['code']}" for r in found if r["severity"] == "warning"]
    status = "FAIL" if errors else "PASS" if verify_hashes else "UNVERIFIED_HASHES"
    return {"status": status, "errors": errors, "warnings": warnings, "masks": masks.first().asDict(), "bands": [r.asDict() for r in bands.orderBy("band").collect()]}


def build_report(spark: SparkSession, manifest: dict, stack: Stack, folder: str | None = None, verify_hashes: bool = True) -> dict:
    """The manifest's report, and with ``folder`` that of its files as ``live``; FAIL if either has errors."""
    report = manifest_report(manifest, stack)
    if folder is not None:
        report["live"] = live_report(spark, manifest, stack, folder, verify_hashes)
        report["status"] = "FAIL" if report["errors"] or report["live"]["errors"] else report["live"]["status"]
    return report
