"""Raster files as cell tables and back: a Spark data source whose partitions are windows of a file's blocks."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from gridloom.operators.grid import NAN, check_predictions
from gridloom.sources import tiff

#: Decoded bytes of a partition, and rows and columns of a written file.
PART_BYTES, SIDE = 16 << 20, 1024
INDEX = "_raster.json"
KINDS = {"uint8": "short", "int8": "short", "int16": "int", "uint16": "int", "int32": "int", "uint32": "long", "int64": "long", "float32": "float", "float64": "double"}


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI; a path without a scheme, and file:, are local."""
    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def header(uri: str) -> tiff.Header:
    files, path = place(uri)
    with files.open_input_file(path) as source:
        return tiff.read_header(source)


def members(uri: str) -> tuple[dict, list[dict]]:
    """Geometry of the raster at ``uri``, and its files with their first row and column: one file, or a folder with an index."""
    files, path = place(uri)
    if files.get_file_info(path).type == fs.FileType.Directory:
        with files.open_input_stream(f"{path}/{INDEX}") as source:
            index = json.loads(source.read())
        return index, [m | {"uri": f"{uri.rstrip('/')}/{m['name']}"} for m in index["files"]]
    h = header(uri)
    return {"height": h.height, "width": h.width, "count": h.count, "dtype": h.dtype}, [{"uri": uri, "row0": 0, "col0": 0, "height": h.height, "width": h.width}]


@dataclass
class Window(InputPartition):
    """Some blocks in a row of one file, and the part of the raster that is wanted."""

    uri: str
    row0: int
    col0: int
    block_row: int
    first: int
    last: int
    wanted: tuple[int, int, int, int]


class RasterReader(DataSourceReader):
    def __init__(self, uri: str, bands: list[int], window: tuple[int, int, int, int] | None):
        self.uri, self.bands = uri, bands
        index, _ = members(uri)
        self.wanted = [0, index["height"], 0, index["width"]]
        if window:
            r, c, h, w = window
            self.narrow("row", r, r + h)
            self.narrow("col", c, c + w)

    def narrow(self, axis: str, low: int, stop: int) -> None:
        i = 0 if axis == "row" else 2
        self.wanted[i], self.wanted[i + 1] = max(self.wanted[i], low), min(self.wanted[i + 1], stop)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            axis, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if axis in (("row",), ("col",)) and isinstance(value, int):
                far = 1 << 62
                spans = {EqualTo: (value, value + 1), GreaterThan: (value + 1, far), GreaterThanOrEqual: (value, far), LessThan: (-far, value), LessThanOrEqual: (-far, value + 1)}
                if type(f) in spans:
                    self.narrow(axis[0], *spans[type(f)])
                    continue
            yield f

    def partitions(self) -> list[Window]:
        """Blocks that meet the window, in pieces of PART_BYTES; no block's place is read here."""
        out, (top, bottom, left, right) = [], self.wanted
        seen: dict[tuple, tiff.Header] = {}
        for m in members(self.uri)[1]:
            r, c = m["row0"], m["col0"]
            if r >= bottom or r + m["height"] <= top or c >= right or c + m["width"] <= left:
                continue
            size = (m["height"], m["width"])
            h = seen.get(size) or seen.setdefault(size, header(m["uri"]))  # files of one size have the same blocks
            one = h.block_height * h.block_width * len(self.bands) * np.dtype(h.dtype).itemsize
            step = max(1, PART_BYTES // one)
            for b in range(max(0, top - r) // h.block_height, -(-min(m["height"], bottom - r) // h.block_height)):
                first, last = max(0, left - c) // h.block_width, -(-min(m["width"], right - c) // h.block_width)
                out += [Window(m["uri"], r, c, b, k, min(k + step, last), tuple(self.wanted)) for k in range(first, last, step)]
        return out or [Window("", 0, 0, 0, 0, 0, tuple(self.wanted))]

    def read(self, partition: Window) -> Iterator[pa.RecordBatch]:
        if not partition.uri:
            return
        files, path = place(partition.uri)
        top, bottom, left, right = partition.wanted
        with files.open_input_file(path) as source:
            h = tiff.read_header(source)
            for k in range(partition.first, partition.last):
                if h.planar:
                    data = np.stack([tiff.read_block(source, h, partition.block_row, k, b)[:, :, 0] for b in self.bands], axis=2)
                else:
                    data = tiff.read_block(source, h, partition.block_row, k, 0)[:, :, self.bands]
                y, x = partition.block_row * h.block_height, k * h.block_width
                r0, c0 = partition.row0 + y, partition.col0 + x
                data = data[max(0, top - r0) : min(h.height - y, bottom - r0), max(0, left - c0) : min(h.width - x, right - c0)]
                r0, c0 = max(r0, top), max(c0, left)
                row, col = (v.ravel() for v in np.indices(data.shape[:2], np.int64))
                missing = np.zeros(data.shape, bool) if h.nodata is None else np.isnan(data) if np.isnan(h.nodata) else data == np.array(h.nodata).astype(h.dtype)
                columns = [pa.array(row + r0), pa.array(col + c0), pa.array(~missing.all(axis=2).ravel())]
                columns += [pa.array(np.ascontiguousarray(data[:, :, i]).ravel()).cast({"short": pa.int16(), "int": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64()}[KINDS[h.dtype]]) for i in range(len(self.bands))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "col", "valid", *[f"b{b + 1}" for b in self.bands]])


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class RasterWriter(DataSourceArrowWriter):
    """One file a tile of the task's rows, which come tile by tile; names are new in each attempt, and the index says which files count."""

    def __init__(self, options: dict, overwrite: bool):
        self.uri, self.spec, self.overwrite = options["path"], json.loads(options["spec"]), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        s, done, held, tile = self.spec, [], None, None
        files, folder = place(self.uri)

        def finish() -> None:
            name = f"{tile[0]}-{tile[1]}-{uuid.uuid4().hex}.tif"
            scale, tie = tuple(s["scale"]), list(s["tie"])
            if scale:
                tie = [0.0, 0.0, 0.0, tie[3] + (tile[1] * s["side"] - tie[0]) * scale[0], tie[4] - (tile[0] * s["side"] - tie[1]) * scale[1], 0.0]
            with files.open_output_stream(f"{folder}/{name}") as out:
                out.write(tiff.encode(held, s["nodata"], scale, tuple(tie), s["epsg"], s["tags"]))
            done.append({"name": name, "row0": tile[0] * s["side"], "col0": tile[1] * s["side"], "height": held.shape[1], "width": held.shape[2]})

        for batch in iterator:
            table = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
            row, col = table["row"], table["col"]
            if len(row) and (row.min() < 0 or col.min() < 0 or row.max() >= s["height"] or col.max() >= s["width"]):
                raise ValueError("a cell lies outside the raster")
            key = row // s["side"] * (s["width"] // s["side"] + 1) + col // s["side"]
            for part in np.split(np.arange(len(row)), np.flatnonzero(np.diff(key)) + 1) if len(row) else []:
                own = (int(row[part[0]] // s["side"]), int(col[part[0]] // s["side"]))
                if own != tile:
                    if tile is not None:
                        finish()
                    tile = own
                    shape = [min(s["side"], s[n] - own[i] * s["side"]) for i, n in enumerate(("height", "width"))]
                    held = np.full((len(s["bands"]), *shape), 0 if s["nodata"] is None else s["nodata"], s["dtype"])
                for i, b in enumerate(s["bands"]):
                    held[i, row[part] - tile[0] * s["side"], col[part] - tile[1] * s["side"]] = table[b][part]
        if tile is not None:
            finish()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files, folder = place(self.uri)
        listed = sorted((f for m in messages if m for f in m.files), key=lambda f: (f["row0"], f["col0"]))
        places = [(f["row0"], f["col0"]) for f in listed]
        if len(set(places)) < len(places):
            raise ValueError("rows of one tile came to several tasks; deal them out by tile first")
        old = []
        if files.get_file_info(f"{folder}/{INDEX}").type == fs.FileType.File:
            if not self.overwrite:
                raise ValueError(f"{self.uri} has a raster already")
            old = members(self.uri)[1]
        index = {k: self.spec[k] for k in ("height", "width", "dtype", "side", "scale", "tie", "epsg", "nodata")} | {"count": len(self.spec["bands"]), "files": listed}
        with files.open_output_stream(f"{folder}/{INDEX}.new") as out:
            out.write(json.dumps(index, sort_keys=True).encode())
        files.move(f"{folder}/{INDEX}.new", f"{folder}/{INDEX}")
        for m in old:
            files.delete_file(f"{folder}/{m['name']}")

    def abort(self, messages: list[Written | None]) -> None:
        files, folder = place(self.uri)
        for f in (f for m in messages if m for f in m.files):
            files.delete_file(f"{folder}/{f['name']}")


class RasterSource(DataSource):
    """Format ``raster``. Options: path; bands (numbers from 1, by commas); window (row, col, height, width).

    Rows: row, col, valid (some band read is not nodata) and b1, b2, ... Comparisons of row and col with whole numbers reach the
    source: only blocks that meet them are opened.
    """

    @classmethod
    def name(cls) -> str:
        return "raster"

    def bands(self) -> list[int]:
        count = members(self.options["path"])[0]["count"]
        chosen = [int(b) - 1 for b in self.options["bands"].split(",")] if self.options.get("bands") else list(range(count))
        if any(not 0 <= b < count for b in chosen) or len(set(chosen)) < len(chosen):
            raise ValueError(f"bands are different numbers from 1 to {count}")
        return chosen

    def schema(self) -> str:
        kind = KINDS[members(self.options["path"])[0]["dtype"]]
        return "row long, col long, valid boolean, " + ", ".join(f"b{b + 1} {kind}" for b in self.bands())

    def reader(self, schema: StructType) -> RasterReader:
        window = self.options.get("window")
        return RasterReader(self.options["path"], self.bands(), tuple(map(int, window.split(","))) if window else None)

    def writer(self, schema: StructType, overwrite: bool) -> RasterWriter:
        return RasterWriter(dict(self.options), overwrite)


def read_raster(spark: SparkSession, uri: str, bands: list[int] | None = None, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Cells of a TIFF file, or of a folder that ``write_raster`` made."""
    spark.dataSource.register(RasterSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("raster").option("path", uri)
    if bands is not None:
        reader = reader.option("bands", ",".join(map(str, bands)))
    return (reader if window is None else reader.option("window", ",".join(map(str, window)))).load()


def write_raster(cells: DataFrame, uri: str, bands: list[str], height: int, width: int, dtype: str = "float32", nodata: float | None = None, side: int = SIDE, scale: tuple[float, ...] = (), tie: tuple[float, ...] = (), epsg: int | None = None, tags: list[dict] | None = None, overwrite: bool = False) -> None:
    """Files of ``side`` by ``side`` cells under ``uri`` and an index of them; cells that are absent or null become nodata (or 0).

    Tiles are dealt to tasks, each of which holds one tile at a time. The index is written last, so readers see a whole raster or none;
    a retried task writes files of other names.
    """
    if dtype not in KINDS or nodata is not None and dtype[0] != "f" and not np.isfinite(nodata):
        raise ValueError("no such type of samples, or nodata that it cannot hold")
    spark = cells.sparkSession
    spark.dataSource.register(RasterSource)
    files, folder = place(uri)
    files.create_dir(folder, recursive=True)
    spec = {"bands": bands, "height": height, "width": width, "dtype": dtype, "nodata": nodata, "side": side, "scale": scale, "tie": tie, "epsg": epsg, "tags": tags or [{} for _ in bands]}
    fill = F.lit(0.0 if nodata is None else nodata)
    rows = cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), *[F.coalesce(F.col(b).cast("double"), fill).alias(b) for b in bands])
    tile = [F.floor(F.col(x) / side) for x in ("row", "col")]
    rows.repartition(*tile).sortWithinPartitions(*tile).write.format("raster").mode("overwrite" if overwrite else "append").option("path", uri).option("spec", json.dumps(spec)).save()


def raster_signature(uri: str) -> dict:
    """Geometry, type, nodata and band tags of a TIFF file; of its bytes only the directory is read."""
    return header(uri).signature()


def signatures(spark: SparkSession, uri: str) -> DataFrame:
    """row0, col0, height, width, bands, dtype, nodata, crs, left, top, cell of every file of a raster, each read where a task runs."""
    rows = spark.createDataFrame([(m["uri"], m["row0"], m["col0"]) for m in members(uri)[1]], "uri string, row0 long, col0 long")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [raster_signature(u) for u in b.column("uri").to_pylist()]
            out = {"row0": b.column("row0"), "col0": b.column("col0")}
            for name, kind, value in (("height", pa.int64(), lambda s: s["height"]), ("width", pa.int64(), lambda s: s["width"]), ("bands", pa.int64(), lambda s: s["count"]), ("dtype", pa.string(), lambda s: s["dtypes"][0]),
                                      ("nodata", pa.string(), lambda s: str(s["nodata"])), ("crs", pa.string(), lambda s: s["crs"]), ("left", pa.float64(), lambda s: s["bounds"][0]), ("top", pa.float64(), lambda s: s["bounds"][3]), ("cell", pa.float64(), lambda s: s["resolution"][0])):
                out[name] = pa.array([value(s) for s in found], kind)
            yield pa.RecordBatch.from_pydict(out)

    return rows.repartition(max(1, min(rows.count(), spark.sparkContext.defaultParallelism))).mapInArrow(describe, "row0 long, col0 long, height long, width long, bands long, dtype string, nodata string, crs string, left double, top double, cell double")


def reference_cells(spark: SparkSession, features: str, labels: str) -> DataFrame:
    """row, col, valid, truth and the feature bands (NaN where nodata) of two rasters of one shape; labels below 1 are no truth."""
    a, b = members(features)[0], members(labels)[0]
    if (a["height"], a["width"]) != (b["height"], b["width"]):
        raise ValueError(f"features are {a['height']} x {a['width']}, labels {b['height']} x {b['width']}")
    own = read_raster(spark, features)
    bands = own.columns[3:]
    clean = own.select("row", "col", "valid", *[F.when((F.col(x) < -1e38) | ~F.col("valid"), F.lit(NAN)).otherwise(F.col(x)).alias(x) for x in bands])
    truth = read_raster(spark, labels, [1]).select("row", "col", (F.col("valid") & (F.col("b1") >= 1)).alias("truth"))
    return clean.join(truth, ["row", "col"]).select("row", "col", "valid", "truth", *bands)


def write_prediction(cells: DataFrame, template: str, uri: str, side: int = SIDE) -> None:
    """p of ``cells`` as a raster of the template's geometry: float32, NaN outside its valid cells; p must be finite and in 0..1 inside."""
    spark, (index, found) = cells.sparkSession, members(template)
    h = header(found[0]["uri"])
    both = read_raster(spark, template, [1]).select("row", "col", "valid").join(cells.select("row", "col", "p"), ["row", "col"], "left")
    if both.where("valid").isEmpty():
        raise ValueError("the template has no valid cell")
    check_predictions(both.select(F.coalesce("p", F.lit(NAN)).alias("p"), "valid"))
    out = both.select("row", "col", F.when(F.col("valid"), F.col("p")).otherwise(F.lit(NAN)).alias("p"))
    write_raster(out, uri, ["p"], index["height"], index["width"], "float32", NAN, side, h.scale, h.tie, h.epsg)
