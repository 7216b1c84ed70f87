"""The TIFF format: directories, blocks and their bytes, read by ranges; and whole small files written."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field
from typing import BinaryIO
from xml.etree import ElementTree

import numpy as np

# Fixed values of the format: field types with their size and struct code, tags, compressions.
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, ROWS_A_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES, SAMPLE_FORMAT = 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS, METADATA, NODATA = 33550, 33922, 34735, 42112, 42113
PROJECTED, GEOGRAPHIC = 3072, 2048
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773


@dataclass(frozen=True)
class Header:
    """What a file's first directory says; block offsets stay in the file."""

    width: int
    height: int
    count: int
    dtype: str
    block_height: int
    block_width: int
    tiled: bool
    planar: bool
    compression: int
    predictor: int
    order: str
    offsets: tuple[int, int, int]
    sizes: tuple[int, int, int]
    nodata: float | None = None
    scale: tuple[float, ...] = ()
    tie: tuple[float, ...] = ()
    epsg: int | None = None
    tags: tuple[dict[str, str], ...] = field(default=())

    @property
    def across(self) -> int:
        return -(-self.width // self.block_width)

    @property
    def down(self) -> int:
        return -(-self.height // self.block_height)

    def signature(self) -> dict:
        """Geometry, type, nodata and band tags; numbers that are not finite become text."""
        dx, dy = self.scale[:2] if self.scale else (1.0, 1.0)
        x, y = (self.tie[3] - self.tie[0] * dx, self.tie[4] + self.tie[1] * dy) if self.tie else (0.0, 0.0)
        plain = lambda v: v if v is None or np.isfinite(v) else str(v)
        return {
            "driver": "GTiff", "width": self.width, "height": self.height, "count": self.count, "dtypes": [self.dtype] * self.count, "crs": f"EPSG:{self.epsg}" if self.epsg else None,
            "resolution": [dx, dy], "transform": [dx, 0.0, x, 0.0, -dy, y, 0.0, 0.0, 1.0], "bounds": [x, y - dy * self.height, x + dx * self.width, y], "nodata": plain(self.nodata), "band_tags": [dict(t) for t in self.tags],
        }


def _at(source: BinaryIO, place: int, size: int) -> bytes:
    source.seek(place)
    data = source.read(size)
    if len(data) < size:
        raise ValueError("the file ends within a field that its directory names")
    return data


def read_header(source: BinaryIO) -> Header:
    """The first directory of a classic or big TIFF of either byte order."""
    start = _at(source, 0, 8)
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    if order is None:
        raise ValueError("not a TIFF file")
    version = struct.unpack(f"{order}H", start[2:4])[0]
    if version == 42:
        place, head, entry, value, word = struct.unpack(f"{order}I", start[4:8])[0], "H", 12, 4, "I"
    elif version == 43:
        place, head, entry, value, word = struct.unpack(f"{order}Q", _at(source, 8, 8))[0], "Q", 20, 8, "Q"
    else:
        raise ValueError("not a TIFF file")
    size = struct.calcsize(head)
    entries = struct.unpack(order + head, _at(source, place, size))[0]
    data, fields = _at(source, place + size, entries * entry), {}
    for i in range(entries):
        tag, kind, n = struct.unpack(f"{order}HH{word}", data[entry * i : entry * (i + 1) - value])
        if kind in TYPES:
            inline = TYPES[kind][0] * n <= value
            at = place + size + entry * (i + 1) - value
            fields[tag] = (kind, n, at if inline else struct.unpack(order + word, data[entry * (i + 1) - value : entry * (i + 1)])[0])

    def get(tag: int, default=None):
        if tag not in fields:
            return default
        kind, n, at = fields[tag]
        raw = _at(source, at, TYPES[kind][0] * n)
        return raw.rstrip(b"\0").decode("utf-8", "replace") if kind == 2 else struct.unpack(f"{order}{n}{TYPES[kind][1]}" if kind != 5 else f"{order}{2 * n}I", raw)

    one = lambda tag, default=None: get(tag, (default,))[0]
    bits, kinds = set(get(BITS, (1,))), set(get(SAMPLE_FORMAT, (1,)))
    dtype = {(1, 8): "uint8", (1, 16): "uint16", (1, 32): "uint32", (2, 8): "int8", (2, 16): "int16", (2, 32): "int32", (2, 64): "int64", (3, 32): "float32", (3, 64): "float64"}.get((*kinds, *bits))
    if dtype is None:
        raise ValueError(f"samples of {sorted(bits)} bits and format {sorted(kinds)} are not read")
    tiled, width, height, count = TILE_AT in fields, one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    block = (one(TILE_HEIGHT), one(TILE_WIDTH)) if tiled else (min(one(ROWS_A_STRIP, height), height), width)
    keys, epsg = get(GEO_KEYS, ()), None
    for i in range(4, len(keys) - 3, 4):
        if keys[i] in (PROJECTED, GEOGRAPHIC) and keys[i + 1] == 0 and (epsg is None or keys[i] == PROJECTED):
            epsg = keys[i + 3]
    tags: list[dict[str, str]] = [{} for _ in range(count)]
    if METADATA in fields:
        for item in ElementTree.fromstring(get(METADATA)).iter("Item"):
            if item.get("sample") is not None and item.get("role") is None:
                tags[int(item.get("sample"))][item.get("name")] = item.text or ""
    nodata = get(NODATA)
    return Header(width, height, count, dtype, *block, tiled, one(PLANAR, 1) == 2, one(COMPRESSION, NONE), one(PREDICTOR, 1), order,
                  fields[TILE_AT if tiled else STRIP_AT], fields[TILE_BYTES if tiled else STRIP_BYTES], None if nodata is None else float(nodata),
                  tuple(get(PIXEL_SCALE, ())), tuple(get(TIE_POINT, ())[:6]), epsg, tuple(tags))


def _lzw(data: bytes) -> bytes:
    out, table, last = bytearray(), [], b""
    held, bits, width = 0, 0, 9
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        while bits >= width:
            code = held >> (bits - width) & ((1 << width) - 1)
            bits -= width
            if code == 257:
                return bytes(out)
            if code == 256:
                table, last, width = [], b"", 9
                continue
            if code < 256:
                now = bytes((code,))
            elif code - 258 < len(table):
                now = table[code - 258]
            else:
                now = last + last[:1]
            out += now
            if last:
                table.append(last + now[:1])
            last = now
            width = 9 + sum(len(table) + 258 >= end for end in (511, 1023, 2047))
    return bytes(out)


def _packbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            out += data[i + 1 : i + 2] * (257 - n) * (n != 128)
            i += 2 if n != 128 else 1
    return bytes(out)


def read_block(source: BinaryIO, header: Header, row: int, col: int, band: int) -> np.ndarray:
    """Block (row, col) of band ``band`` (from 0) as an array of rows, columns and samples; the file is read at this block only."""
    index = (band * header.down if header.planar else 0) * header.across + row * header.across + col

    def entry(place: tuple[int, int, int]) -> int:
        kind, _, at = place
        size, code = TYPES[kind]
        return struct.unpack(header.order + code, _at(source, at + size * index, size))[0]

    samples = 1 if header.planar else header.count
    height = header.block_height if header.tiled else min(header.block_height, header.height - row * header.block_height)
    dtype = np.dtype(header.dtype).newbyteorder(header.order)
    size = entry(header.sizes)
    if not size:  # a block that was never written
        return np.full((height, header.block_width, samples), 0 if header.nodata is None else header.nodata, header.dtype)
    data = _at(source, entry(header.offsets), size)
    if header.compression in (DEFLATE, OLD_DEFLATE):
        data = zlib.decompress(data)
    elif header.compression == LZW:
        data = _lzw(data)
    elif header.compression == PACKBITS:
        data = _packbits(data)
    elif header.compression != NONE:
        raise ValueError(f"compression {header.compression} is not read")
    shape = (height, header.block_width, samples)
    if header.predictor == 3:  # bytes of a row by significance, each the difference from the one before
        planes = np.frombuffer(data, np.uint8, height * header.block_width * samples * dtype.itemsize).reshape(height, -1, samples)
        planes = np.add.accumulate(planes, axis=1, dtype=np.uint8).reshape(height, dtype.itemsize, -1)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.dtype(header.dtype).newbyteorder(">")).reshape(shape).astype(header.dtype)
    out = np.frombuffer(data, dtype, height * header.block_width * samples).reshape(shape).astype(header.dtype)
    return np.add.accumulate(out, axis=1, dtype=out.dtype) if header.predictor == 2 else out


def encode(values: np.ndarray, nodata: float | None = None, scale: tuple[float, ...] = (), tie: tuple[float, ...] = (), epsg: int | None = None, tags: list[dict[str, str]] | None = None, rows: int = 64, compressed: bool = True) -> bytes:
    """A file of the array (bands, rows, columns): strips of ``rows`` rows, a band after the other."""
    bands, height, width = values.shape
    dtype = values.dtype.newbyteorder("<")
    pack = (lambda x: zlib.compress(x, 6)) if compressed else bytes
    strips = [pack(values[b, r : r + rows].astype(dtype).tobytes()) for b in range(bands) for r in range(0, height, rows)]
    at, places = 8, []
    for s in strips:
        places.append(at)
        at += len(s) + len(s) % 2
    kind = {"u": 1, "i": 2, "f": 3}[values.dtype.kind]
    fields: list[tuple[int, int, list | bytes]] = [
        (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [dtype.itemsize * 8] * bands), (COMPRESSION, 3, [DEFLATE if compressed else NONE]), (PHOTOMETRIC, 3, [1]), (STRIP_AT, 4, places),
        (SAMPLES, 3, [bands]), (ROWS_A_STRIP, 4, [rows]), (STRIP_BYTES, 4, [len(s) for s in strips]), (PLANAR, 3, [2]), (SAMPLE_FORMAT, 3, [kind] * bands),
    ]
    if scale:
        fields += [(PIXEL_SCALE, 12, [*scale, *[0.0] * (3 - len(scale))]), (TIE_POINT, 12, list(tie))]
    if epsg:
        fields.append((GEO_KEYS, 3, [1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, PROJECTED, 0, 1, epsg]))
    if tags and any(tags):
        root = ElementTree.Element("GDALMetadata")
        for i, own in enumerate(tags):
            for name, text in own.items():
                ElementTree.SubElement(root, "Item", name=name, sample=str(i)).text = text
        fields.append((METADATA, 2, ElementTree.tostring(root) + b"\0"))
    if nodata is not None:
        fields.append((NODATA, 2, repr(float(nodata)).encode() + b"\0"))
    directory, extra = struct.pack("<H", len(fields)), b""
    after = at + 2 + 12 * len(fields) + 4
    for tag, type_, data in fields:
        raw = data if isinstance(data, bytes) else struct.pack(f"<{len(data)}{TYPES[type_][1]}", *data)
        directory += struct.pack("<HHI", tag, type_, len(data))
        directory += raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", after + len(extra))
        extra += b"" if len(raw) <= 4 else raw + b"\0" * (len(raw) % 2)
    body = b"".join(s + b"\0" * (len(s) % 2) for s in strips)
    if after + len(extra) >= 1 << 32:
        raise ValueError("a file of this format holds less than 4 GiB")
    return b"II*\0" + struct.pack("<I", at) + body + directory + b"\0" * 4 + extra
