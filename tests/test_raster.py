"""Raster files: formats written by hand, windows, pushed filters, round trips."""

import json
import struct
import zlib

import numpy as np
import pytest

from gridloom.sources import raster, tiff


def lzw(data):
    """Codes of nine bits only, with a clear code before the table grows: as any reader must take them."""
    bits = ""
    for i, x in enumerate(data):
        bits += ("100000000" if i % 200 == 0 else "") + f"{x:09b}"
    bits += "100000001"
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def tiled_file(values, order=">", big=False, compression=1, predictor=1, tile=16):
    """A tiled file with interleaved samples of either byte order and either size of offsets."""
    bands, height, width = values.shape
    chunks = []
    for r in range(0, height, tile):
        for c in range(0, width, tile):
            box = np.zeros((tile, tile, bands), values.dtype)
            part = values[:, r : r + tile, c : c + tile].transpose(1, 2, 0)
            box[: part.shape[0], : part.shape[1]] = part
            if predictor == 2:
                box[:, 1:] = np.diff(box, axis=1)
            raw = box.astype(box.dtype.newbyteorder(order)).tobytes()
            if predictor == 3:
                planes = np.frombuffer(box.astype(box.dtype.newbyteorder(">")).tobytes(), np.uint8).reshape(tile, tile * bands, -1).transpose(0, 2, 1).reshape(tile, -1, bands).copy()
                planes[:, 1:] = np.diff(planes, axis=1)
                raw = planes.tobytes()
            chunks.append(zlib.compress(raw) if compression == 8 else lzw(raw) if compression == 5 else raw)
    word, size = ("Q", 8) if big else ("I", 4)
    at, places = 16, []
    for x in chunks:
        places.append(at)
        at += len(x)
    kind = {"u": 1, "i": 2, "f": 3}[values.dtype.kind]
    fields = [(256, 4, [width]), (257, 4, [height]), (258, 3, [values.dtype.itemsize * 8] * bands), (259, 3, [compression]), (277, 3, [bands]), (284, 3, [1]), (317, 3, [predictor]), (322, 3, [tile]), (323, 3, [tile]),
              (324, 16 if big else 4, places), (325, 4, [len(x) for x in chunks]), (339, 3, [kind] * bands)]
    head = struct.pack(order + ("Q" if big else "H"), len(fields))
    after, extra, rows = at + len(head) + (20 if big else 12) * len(fields) + size, b"", b""
    for tag, type_, data in fields:
        raw = struct.pack(f"{order}{len(data)}{tiff.TYPES[type_][1]}", *data)
        rows += struct.pack(f"{order}HH{word}", tag, type_, len(data))
        rows += raw.ljust(size, b"\0") if len(raw) <= size else struct.pack(order + word, after + len(extra))
        extra += b"" if len(raw) <= size else raw
    mark = {"<": b"II", ">": b"MM"}[order]
    start = mark + (struct.pack(f"{order}HHHQ", 43, 8, 0, at) if big else struct.pack(f"{order}HI", 42, at) + b"\0" * 8)
    return start + b"".join(chunks) + head + rows + b"\0" * size + extra


def table(df):
    return sorted(map(tuple, df.collect()))


CASES = [("<", False, 1, 1, "float32"), (">", True, 8, 1, "float64"), ("<", False, 8, 3, "float32"), (">", False, 8, 2, "int16"), ("<", True, 5, 1, "uint8"), ("<", False, 8, 2, "uint16")]


@pytest.mark.parametrize(("order", "big", "compression", "predictor", "dtype"), CASES)
def test_reads_tiles_of_every_kind(spark, tmp_path, order, big, compression, predictor, dtype):
    r = np.random.default_rng(4)
    values = (r.normal(size=(3, 37, 50)) * 50 + (90 if dtype[0] == "u" else 0)).clip(0 if dtype[0] == "u" else -99).astype(dtype)
    (tmp_path / "a.tif").write_bytes(tiled_file(values, order, big, compression, predictor))
    cells = raster.read_raster(spark, str(tmp_path / "a.tif"), [3, 1])
    assert cells.columns == ["row", "col", "valid", "b3", "b1"]
    assert table(cells) == sorted((i, j, True, values[2, i, j].item(), values[0, i, j].item()) for i in range(37) for j in range(50))
    one = raster.read_raster(spark, str(tmp_path / "a.tif"), [2], window=(30, 45, 40, 40))
    assert table(one) == sorted((i, j, True, values[1, i, j].item()) for i in range(30, 37) for j in range(45, 50))


def test_long_lzw_codes():
    """Codes grow to 12 bits: an encoder as the format describes it."""
    data = bytes(np.random.default_rng(0).integers(0, 5, 30_000, dtype=np.uint8))
    codes, known, width, last = [(256, 9)], {bytes((i,)): i for i in range(256)}, 9, b""
    size = 258
    for x in data:
        now = last + bytes((x,))
        if now in known:
            last = now
            continue
        codes.append((known[last], width))
        known[now], size = size, size + 1
        width = 9 + sum(size >= end for end in (512, 1024, 2048))
        if size == 4094:
            codes.append((256, width))
            known, size, width = {bytes((i,)): i for i in range(256)}, 258, 9
        last = bytes((x,))
    bits = "".join(f"{c:0{w}b}" for c, w in [*codes, (known[last], width), (257, width)])
    bits += "0" * (-len(bits) % 8)
    assert tiff._lzw(bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))) == data
    assert tiff._packbits(b"\xfe\x07\x02abc\x80\x00z") == b"\x07\x07\x07abcz"


def test_a_filter_opens_only_its_blocks(spark, tmp_path):
    values = np.arange(64 * 64, dtype=np.float32).reshape(1, 64, 64)
    (tmp_path / "a.tif").write_bytes(data := tiled_file(values))
    spoiled = bytearray(data)
    h = tiff.read_header(open(tmp_path / "a.tif", "rb"))
    with open(tmp_path / "a.tif", "rb") as f:
        kind, n, at = h.sizes
        for i in range(16):  # all blocks but (1, 2) cannot be read
            if i != 6:
                struct.pack_into(">I", spoiled, at + 4 * i, 1 << 30)
        assert f and n == 16
    (tmp_path / "b.tif").write_bytes(spoiled)
    cells = raster.read_raster(spark, str(tmp_path / "b.tif")).where("row >= 16 and row < 32 and col > 31 and col <= 47")
    assert table(cells.select("b1")) == [(float(i),) for i in range(64 * 64) if 16 <= i // 64 < 32 and 32 <= i % 64 < 48]
    assert table(raster.read_raster(spark, str(tmp_path / "b.tif")).where("row = 20 and col = 40")) == [(20, 40, True, 20.0 * 64 + 40)]
    with pytest.raises(Exception, match="ends within"):
        raster.read_raster(spark, str(tmp_path / "b.tif")).collect()
    reader = raster.RasterReader(str(tmp_path / "a.tif"), [0], (0, 0, 16, 64))
    assert sum(p.last - p.first for p in reader.partitions()) == 4


def test_round_trip_in_many_files(spark, tmp_path):
    r = np.random.default_rng(1)
    rows = [(int(i), int(j), float(np.float32(r.normal())), None if (i + j) % 7 == 0 else float(i)) for i in range(45) for j in range(70) if (i, j) != (3, 3)]
    cells = spark.createDataFrame(rows, "row long, col long, a double, b double").repartition(5)
    uri = f"file://{tmp_path}/out"
    raster.write_raster(cells, uri, ["a", "b"], 45, 70, nodata=-9.0, side=32, scale=(100.0, 100.0), tie=(0.0, 0.0, 0.0, 300000.0, 4400000.0, 0.0), epsg=32611, tags=[{"band_name": "x & y"}, {}])
    found = {(x.row, x.col): x for x in raster.read_raster(spark, uri).collect()}
    assert len(found) == 45 * 70 and not found[3, 3].valid and found[3, 3].b1 == -9.0
    for i, j, a, b in rows:
        assert (found[i, j].b1, found[i, j].b2, found[i, j].valid) == (a, -9.0 if b is None else b, True)
    index, files = raster.members(uri)
    assert len(files) == 6 and index["height"] == 45
    last = raster.raster_signature(files[-1]["uri"])
    assert last["bounds"] == [300000.0 + 6400, 4400000.0 - 4500, 300000.0 + 7000, 4400000.0 - 3200] and last["crs"] == "EPSG:32611"
    assert last["band_tags"] == [{"band_name": "x & y"}, {}] and last["nodata"] == -9.0 and (last["height"], last["width"]) == (13, 6)
    with pytest.raises(Exception, match="already"):
        raster.write_raster(cells, uri, ["a"], 45, 70, side=32)
    raster.write_raster(cells.where("row < 5"), uri, ["a"], 45, 70, side=32, overwrite=True)
    assert raster.read_raster(spark, uri).count() == 32 * 70 and len(list((tmp_path / "out").glob("*.tif"))) == 3
    with pytest.raises(Exception, match="outside the raster"):
        raster.write_raster(cells, f"{uri}2", ["a"], 45, 60)


def test_predictions_like_a_template(spark, tmp_path):
    template = np.linspace(0.05, 0.95, 20, dtype=np.float32).reshape(1, 4, 5)
    template[0, 0] = np.nan
    path = str(tmp_path / "t.tif")
    (tmp_path / "t.tif").write_bytes(tiff.encode(template, np.nan, (100.0, 100.0), (0.0, 0.0, 0.0, 300000.0, 4400000.0, 0.0), 32611))
    cells = spark.createDataFrame([(i, j, 0.5 if i else 7.0) for i in range(4) for j in range(5)], "row long, col long, p double")
    raster.write_prediction(cells, path, str(tmp_path / "p"))
    found = raster.read_raster(spark, str(tmp_path / "p")).collect()
    assert all(x.b1 == 0.5 if x.row else np.isnan(x.b1) for x in found) and sum(x.valid for x in found) == 15
    sign = raster.raster_signature(raster.members(str(tmp_path / "p"))[1][0]["uri"])
    assert sign["bounds"] == raster.raster_signature(path)["bounds"] and sign["nodata"] == "nan" and json.dumps(sign)
    with pytest.raises(ValueError, match="outside 0 to 1"):
        raster.write_prediction(cells.withColumn("p", cells.p + 1), path, str(tmp_path / "q"))
    with pytest.raises(ValueError, match="not finite"):
        raster.write_prediction(cells.where("row < 3"), path, str(tmp_path / "q"))
    labels = np.array([[[-1, 0, 1, 2, 0]] * 4], np.int16)
    (tmp_path / "l.tif").write_bytes(tiff.encode(labels, -1.0))
    both = {(x.row, x.col): x for x in raster.reference_cells(spark, path, str(tmp_path / "l.tif")).collect()}
    assert [both[1, j].truth for j in range(5)] == [False, False, True, True, False] and not both[0, 2].valid and np.isnan(both[0, 2].b1)
    (tmp_path / "s.tif").write_bytes(tiff.encode(labels[:, :3], -1.0))
    with pytest.raises(ValueError, match="labels 3 x 5"):
        raster.reference_cells(spark, path, str(tmp_path / "s.tif"))


def test_files_that_are_none(tmp_path):
    (tmp_path / "x.tif").write_bytes(b"nothing of the kind")
    with pytest.raises(ValueError, match="not a TIFF"):
        raster.header(str(tmp_path / "x.tif"))
    (tmp_path / "x.tif").write_bytes(b"II*\0\x08\0\0\0")
    with pytest.raises(ValueError, match="ends within"):
        raster.header(str(tmp_path / "x.tif"))
