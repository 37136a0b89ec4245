"""Raster files as DataFrames: binaryFile rows are decoded tile by tile in Arrow batches.

Decoders are plain numpy: PNG (8 and 16 bit, not interlaced), PGM and PPM, SRTM HGT
(also gzipped), and TIFF or BigTIFF in strips or tiles, plain or packed by deflate, LZW or
PackBits, with either predictor. Each yields (bands, rows, cols) in its own type with
metadata; other formats are refused by name.
"""

from __future__ import annotations

import gzip
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TILE = 256
META = "path string, width int, height int, count int, dtype string, nodata double, transform array<double>, crs string, nbits int, georef_issue string"
TILES = "path string, band int, row0 long, col0 long, h int, w int, data array<double>"


def _unfilter(raw: bytes, rows: int, stride: int, bpp: int) -> np.ndarray:
    """Undo PNG's line filters."""
    out = np.zeros((rows, stride), np.uint8)
    before = np.zeros(stride, np.int64)
    for y in range(rows):
        kind = raw[y * (stride + 1)]
        line = np.frombuffer(raw, np.uint8, stride, y * (stride + 1) + 1).astype(np.int64)
        if kind == 1:
            line = np.cumsum(line.reshape(-1, bpp), axis=0).ravel() if stride % bpp == 0 else line
        elif kind == 2:
            line = line + before
        elif kind in (3, 4):
            for i in range(stride):
                a = line[i - bpp] if i >= bpp else 0
                b = before[i]
                if kind == 3:
                    line[i] = (line[i] + (a + b) // 2) & 255
                else:
                    c = before[i - bpp] if i >= bpp else 0
                    p = a + b - c
                    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    line[i] = (line[i] + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255
        before = line & 255
        out[y] = before
    return out


def read_png(b: bytes) -> tuple[np.ndarray, dict]:
    """Bands of a PNG; never georeferenced."""
    at, data, head = 8, b"", None
    while at < len(b):
        n, kind = struct.unpack(">I4s", b[at : at + 8])
        chunk = b[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            data += chunk
        at += 12 + n
    w, h, depth, color, _, _, interlaced = head
    if interlaced or depth not in (8, 16) or color not in (0, 2, 4, 6):
        raise ValueError("only 8 and 16 bit grey and colour PNG without interlacing is read")
    bands = {0: 1, 2: 3, 4: 2, 6: 4}[color]
    bpp = bands * depth // 8
    flat = _unfilter(zlib.decompress(data), h, w * bpp, bpp)
    a = flat.view(">u2") if depth == 16 else flat
    return a.reshape(h, w, bands).transpose(2, 0, 1), {"georef_issue": "image format without a coordinate system"}


def write_png(a: np.ndarray) -> bytes:
    """An 8-bit grey (h, w), RGB or RGBA (h, w, bands) PNG."""
    a = a[..., None] if a.ndim == 2 else a
    h, w, bands = a.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), a.astype(np.uint8).reshape(h, -1)], axis=1).tobytes()
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[bands], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def read_pnm(b: bytes) -> tuple[np.ndarray, dict]:
    """Bands of a binary PGM or PPM."""
    m = re.match(rb"(P[56])(?:\s+#[^\n]*)*\s+(\d+)\s+(\d+)\s+(\d+)\s", b)
    bands, (w, h, top) = {b"P5": 1, b"P6": 3}[m[1]], map(int, m.groups()[1:])
    kind = np.dtype("u1" if top < 256 else ">u2")
    a = np.frombuffer(b, kind, w * h * bands, m.end())
    return a.reshape(h, w, bands).transpose(2, 0, 1), {"georef_issue": "image format without a coordinate system"}


def read_hgt(b: bytes, path: str = "") -> tuple[np.ndarray, dict]:
    """A one-degree SRTM tile (gzipped or not); its name places it, samples are points."""
    b = gzip.decompress(b) if b[:2] == b"\x1f\x8b" else b
    n = int(round((len(b) / 2) ** 0.5))
    meta: dict = {"nodata": -32768.0}
    if m := re.search(r"([NS])(\d{2})([EW])(\d{3})\.hgt", path):
        lat = int(m[2]) * (1 if m[1] == "N" else -1)
        lon = int(m[4]) * (1 if m[3] == "E" else -1)
        step = 1 / (n - 1)
        meta |= {"crs": "EPSG:4326", "transform": [step, 0.0, lon - step / 2, 0.0, -step, lat + 1 + step / 2]}
    else:
        meta["georef_issue"] = "tile name without a place"
    return np.frombuffer(b, ">i2").reshape(1, n, n), meta


_SIZES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}


def unpack_lzw(b: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, highest bit first, one bit wider a code early;
    256 clears the table, 257 ends the data."""
    out, table, width, bits, held = bytearray(), [], 9, 0, 0
    last: bytes | None = None
    for byte in b:
        bits, held = bits << 8 | byte, held + 8
        if held < width:
            continue
        held -= width
        code, bits = bits >> held, bits & ((1 << held) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, None
            continue
        if last is None:
            piece = table[code]
        else:
            piece = table[code] if code < len(table) else last + last[:1]
            table.append(last + piece[:1])
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        out += piece
        last = piece
    return bytes(out)


def unpack_bits(b: bytes) -> bytes:
    """PackBits: runs of literal bytes and repeated ones."""
    out, i = bytearray(), 0
    while i < len(b):
        n = b[i]
        if n < 128:
            out += b[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += b[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


_UNPACK = {1: bytes, 5: unpack_lzw, 8: zlib.decompress, 32773: unpack_bits, 32946: zlib.decompress}


def _tags(b: bytes, o: str) -> dict:
    """Tags of the first directory, of a classic or a big file."""
    big = {42: False, 43: True}.get(struct.unpack(o + "H", b[2:4])[0])
    if big is None:
        raise ValueError("a TIFF of an unknown version is not read")
    word, count, entry, room = ("Q", "Q", 20, 8) if big else ("I", "H", 12, 4)
    read = lambda code, at: struct.unpack(o + code, b[at : at + struct.calcsize(o + code)])[0]
    at = read(word, 8 if big else 4)
    first, tags = at + struct.calcsize(o + count), {}
    for k in range(first, first + entry * read(count, at), entry):
        tag, kind, n = read("H", k), read("H", k + 2), read(word, k + 4)
        code = _SIZES.get(kind)
        if not code:
            continue
        size, value = struct.calcsize(o + code) * n, k + 4 + struct.calcsize(o + word)
        start = value if size <= room else read(word, value)
        raw = b[start : start + size]
        tags[tag] = raw.split(b"\0")[0].decode("latin-1") if kind == 2 else list(struct.unpack(o + code * n, raw))
    return tags


def _unpredict(raw: bytes, dtype: np.dtype, predictor: int, shape: tuple[int, int, int]) -> np.ndarray:
    """A block's samples (rows, columns, samples a pixel) without its predictor."""
    rows, width, per = shape
    if predictor == 3:
        # differences of bytes along a row, whose highest bytes stand first
        flat = np.frombuffer(raw, np.uint8, rows * width * per * dtype.itemsize).reshape(rows, -1)
        flat = np.cumsum(flat.reshape(rows, -1, per), axis=1, dtype=np.uint8).reshape(rows, dtype.itemsize, width * per)
        return np.ascontiguousarray(flat.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(shape)
    a = np.frombuffer(raw, dtype, rows * width * per).reshape(shape)
    return np.cumsum(a.astype(np.int64), axis=1).astype(dtype) if predictor == 2 else a


def read_tiff(b: bytes) -> tuple[np.ndarray, dict]:
    """Bands and georeference of a TIFF; rotated or point-only georeferences are demoted,
    with the reason."""
    o = {b"II": "<", b"MM": ">"}[b[:2]]
    tags = _tags(b, o)
    w, h, bands = tags[256][0], tags[257][0], tags.get(277, [1])[0]
    packed, predictor, planar = tags.get(259, [1])[0], tags.get(317, [1])[0], tags.get(284, [1])[0]
    if packed not in _UNPACK or predictor not in (1, 2, 3):
        raise ValueError(f"TIFF compression {packed} (predictor {predictor}) is not read")
    dtype = np.dtype(o + {1: "u", 2: "i", 3: "f"}[tags.get(339, [1])[0]] + str(tags.get(258, [8])[0] // 8))
    tiled = 324 in tags
    bw, bh = (tags[322][0], tags[323][0]) if tiled else (w, tags.get(278, [h])[0])
    offsets, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    out = np.zeros((bands, h, w), dtype)
    across, down = -(-w // bw), -(-h // bh)
    per = 1 if planar == 2 else bands
    for i, (start, size) in enumerate(zip(offsets, sizes, strict=True)):
        raw = _UNPACK[packed](b[start : start + size])
        plane, k = divmod(i, across * down)
        y, x = k // across * bh, k % across * bw
        rows = bh if tiled else min(bh, h - y)
        a = _unpredict(raw, dtype, predictor, (rows, bw, per))[: h - y, : w - x]
        for p in range(per):
            out[plane + p, y : y + a.shape[0], x : x + a.shape[1]] = a[..., p]
    meta: dict = {"nodata": float(tags[42113]) if tags.get(42113, "").strip() else None}
    keys = tags.get(34735, [])
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4)}
    if code := codes.get(3072) or codes.get(2048):
        meta["crs"] = f"EPSG:{code}"
    if 34264 in tags:
        m = tags[34264]
        meta["transform"] = [m[0], m[1], m[3], m[4], m[5], m[7]]
    elif 33550 in tags and 33922 in tags:
        sx, sy, t = tags[33550][0], tags[33550][1], tags[33922]
        meta["transform"] = [sx, 0.0, t[3] - t[0] * sx, 0.0, -sy, t[4] + t[1] * sy]
    elif 33922 in tags:
        meta["georef_issue"] = "ground control points only"
    t = meta.get("transform")
    if t and (t[1] or t[3]):
        meta |= {"georef_issue": "rotated grid", "transform": None}
    if not meta.get("transform") and "georef_issue" not in meta:
        meta["georef_issue"] = "no transform"
    if "crs" not in meta and "georef_issue" not in meta:
        meta["georef_issue"] = "no coordinate system"
    return out, meta


def write_tiff(a: np.ndarray, transform: list[float] | None = None, epsg: int | None = None, nodata: float = -9999.0) -> bytes:
    """A one-band float32 TIFF in deflated strips; NaN becomes nodata. transform: (x step,
    0, left, 0, y step, top)."""
    h, w = a.shape
    body = np.where(np.isfinite(a), a, nodata).astype("<f4")
    strips = [zlib.compress(body[y : y + 64].tobytes()) for y in range(0, h, 64)]
    tags: list[tuple[int, str, list | bytes]] = [
        (256, "I", [w]), (257, "I", [h]), (258, "H", [32]), (259, "H", [8]), (262, "H", [1]), (277, "H", [1]),
        (278, "I", [64]), (279, "I", [len(x) for x in strips]), (339, "H", [3]), (42113, "s", f"{nodata:g}".encode() + b"\0"),
    ]
    if transform:
        tags += [(33550, "d", [transform[0], -transform[4], 0.0]), (33922, "d", [0.0, 0.0, 0.0, transform[2], transform[5], 0.0])]
    if epsg:
        projected = not 4000 <= epsg < 5000
        tags.append((34735, "H", [1, 1, 0, 2, 1024, 0, 1, 1 if projected else 2, 3072 if projected else 2048, 0, 1, epsg]))
    tags.append((273, "I", [0] * len(strips)))
    tags.sort(key=lambda t: t[0])
    kinds = {"H": 3, "I": 4, "d": 12, "s": 2}
    pack = lambda c, v: v if c == "s" else struct.pack(f"<{len(v)}{c}", *v)
    far = 8 + 2 + 12 * len(tags) + 4
    place = far + sum(len(pack(c, v)) + len(pack(c, v)) % 2 for _, c, v in tags if len(pack(c, v)) > 4)
    starts = [place + sum(map(len, strips[:k])) for k in range(len(strips))]
    entries, tail = b"", b""
    for tag, c, v in tags:
        raw = pack(c, starts if tag == 273 else v)
        n = len(raw) if c == "s" else len(v)
        value = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", far + len(tail))
        tail += b"" if len(raw) <= 4 else raw + b"\0" * (len(raw) % 2)
        entries += struct.pack("<HHI", tag, kinds[c], n) + value
    return b"II" + struct.pack("<HIH", 42, 8, len(tags)) + entries + b"\0" * 4 + tail + b"".join(strips)


def tile_files(grid: DataFrame, size: int, prefix: str = "tile", transform: list[float] | None = None, epsg: int | None = None) -> DataFrame:
    """(path, content): a raster (row, col, v) as georeferenced TIFF files of size x size
    pixels, each made in a task of its own; pixels that are not there are nodata."""

    def run(key, pdf):
        import pandas as pd

        i, j = key
        a = np.full((size, size), np.nan)
        a[pdf["row"] - i * size, pdf["col"] - j * size] = pdf["v"].astype(float)
        # an image may end within its last tiles
        a = a[: int((pdf["row"] - i * size).max()) + 1, : int((pdf["col"] - j * size).max()) + 1]
        t = transform and [transform[0], 0.0, transform[2] + j * size * transform[0], 0.0, transform[4], transform[5] + i * size * transform[4]]
        return pd.DataFrame({"path": [f"{prefix}_{i}_{j}.tif"], "content": [write_tiff(a, t, epsg)]})

    dealt = grid.select("row", "col", "v", F.floor(F.col("row") / size).alias("i"), F.floor(F.col("col") / size).alias("j"))
    return dealt.groupBy("i", "j").applyInPandas(run, "path string, content binary")


def decode(path: str, b: bytes) -> tuple[np.ndarray, dict]:
    """Bands and metadata by the content's first bytes and the name."""
    if b[:8] == b"\x89PNG\r\n\x1a\n":
        return read_png(b)
    if b[:2] in (b"P5", b"P6"):
        return read_pnm(b)
    if b[:2] in (b"II", b"MM"):
        return read_tiff(b)
    if ".hgt" in path:
        return read_hgt(b, path)
    raise ValueError(f"unknown raster format: {path}")


def metadata(files: DataFrame) -> DataFrame:
    """One row of META for each file row (path, content)."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                a, m = decode(path, bytes(content))
                rows.append((path, a.shape[2], a.shape[1], a.shape[0], a.dtype.name, m.get("nodata"), m.get("transform"), m.get("crs"), m.get("nbits"), m.get("georef_issue")))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "count", "dtype", "nodata", "transform", "crs", "nbits", "georef_issue"])

    return files.select("path", "content").mapInPandas(run, META)


def tiles(files: DataFrame, size: int = TILE) -> DataFrame:
    """Rows of TILES: every band of every file in tiles of at most size x size; nodata and
    non-finite values are null. A file is one row of input, so a task holds one file."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                a, m = decode(path, bytes(content))
                for band in range(a.shape[0]):
                    for y in range(0, a.shape[1], size):
                        rows = []
                        for x in range(0, a.shape[2], size):
                            t = a[band, y : y + size, x : x + size].astype(np.float64)
                            bad = ~np.isfinite(t) | (t == m["nodata"] if m.get("nodata") is not None else False)
                            data = t.ravel().astype(object)
                            data[bad.ravel()] = None
                            rows.append((path, band, y, x, t.shape[0], t.shape[1], list(data)))
                        yield pd.DataFrame(rows, columns=["path", "band", "row0", "col0", "h", "w", "data"])

    return files.select("path", "content").mapInPandas(run, TILES)


def long_grid(tile_grid: DataFrame) -> DataFrame:
    """(path, band, row, col, v) from tiles."""
    x = tile_grid.select("path", "band", "row0", "col0", "w", F.posexplode("data").alias("i", "v"))
    return x.select("path", "band", (F.col("row0") + F.floor(F.col("i") / F.col("w"))).alias("row"), (F.col("col0") + F.col("i") % F.col("w")).alias("col"), "v")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Files (path, content) under a path, by Spark's binary source."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def mask_nodata(df: DataFrame, v: str, nodata: float | None) -> DataFrame:
    """df with nodata, NaN and infinite values of v as null."""
    c = F.col(v).cast("double")
    ok = ~F.isnan(c) & (F.abs(c) < float("inf"))
    if nodata is not None:
        ok &= c != nodata
    return df.withColumn(v, F.when(ok, c))


def window(df: DataFrame, r0: int, r1: int, c0: int, c1: int) -> DataFrame:
    """Pixels of a half-open window; the ranges reach a Parquet scan as filters."""
    return df.filter((F.col("row") >= r0) & (F.col("row") < r1) & (F.col("col") >= c0) & (F.col("col") < c1))


def sidecar(meta: dict) -> str:
    """Metadata as JSON text."""
    return json.dumps(meta, sort_keys=True, default=str)
