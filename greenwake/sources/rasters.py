"""GeoTIFF elevation rasters as tables: one row a raster, one row a known cell."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from greenwake.session import ship

# The sizes of TIFF field types and the tags that are read.
_SIZES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, STRIP_ROWS, COUNTS = 256, 257, 258, 259, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 317, 322, 323, 324, 325, 339
SCALE, TIE, MATRIX, GEO_KEYS, NODATA = 33550, 33922, 34264, 34735, 42113
RASTER_TYPE, GEOGRAPHIC, PROJECTED = 1025, 2048, 3072

RASTERS = "course_slug string, rows int, cols int, a double, c double, e double, f double, epsg int"
CELLS = "course_slug string, row int, col int, z double"


class RasterError(ValueError):
    pass


def directory(data: bytes) -> tuple[str, dict[int, tuple]]:
    """The byte order and the tags of a TIFF's first image."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise RasterError("not a TIFF file")
    at = struct.unpack_from(order + "I", data, 4)[0]
    tags = {}
    for i in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if code := _SIZES.get(kind):
            form = f"{order}{n}{code}"
            where = at + 10 + 12 * i
            if struct.calcsize(form) > 4:
                where = struct.unpack_from(order + "I", data, where)[0]
            tags[tag] = struct.unpack_from(form, data, where)
    return order, tags


def place(tags: dict[int, tuple]) -> tuple[float, float, float, float, int | None]:
    """(a, c, e, f, epsg): x = c + (col + 1/2) a and y = f + (row + 1/2) e of a cell's centre."""
    keys = tags.get(GEO_KEYS, (1, 1, 0, 0))
    geo = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    if SCALE in tags and TIE in tags:
        (sx, sy), (i, j, _, x, y) = tags[SCALE][:2], tags[TIE][:5]
        a, c, e, f = sx, x - i * sx, -sy, y + j * sy
    elif MATRIX in tags:
        m = tags[MATRIX]
        if m[1] or m[4]:
            raise RasterError("rotated rasters are not read")
        a, c, e, f = m[0], m[3], m[5], m[7]
    else:
        raise RasterError("the raster has no place on the ground")
    if geo.get(RASTER_TYPE) == 2:  # the tie point is a cell's centre
        c, f = c - a / 2, f - e / 2
    return a, c, e, f, geo.get(PROJECTED) or geo.get(GEOGRAPHIC)


def lzw(data: bytes) -> bytes:
    """The bytes of an LZW strip: codes of 9 to 12 bits, high bits first; 256 clears the table, 257 ends."""
    table: list[bytes] = []
    out, bits, held, width, last = [], 0, 0, 9, b""
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code >= len(table) and not last:
            raise RasterError("a broken LZW strip")
        entry = table[code] if code < len(table) else last + last[:1]
        out.append(entry)
        if last:
            table.append(last + entry[:1])
        last = entry
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


def _block(raw: bytes, order: str, tags: dict[int, tuple], rows: int, cols: int) -> np.ndarray:
    """The first band of one strip or tile."""
    method = tags.get(COMPRESSION, (1,))[0]
    if method in (8, 32946):
        raw = zlib.decompress(raw)
    elif method == 5:
        raw = lzw(raw)
    elif method != 1:
        raise RasterError(f"compression {method} is not read")
    bits, kind, bands = tags.get(BITS, (8,))[0], tags.get(FORMAT, (1,))[0], tags.get(SAMPLES, (1,))[0]
    if bits not in (8, 16, 32, 64) or kind not in (1, 2, 3):
        raise RasterError(f"cells of {bits} bits and format {kind} are not read")
    size = bits // 8
    dtype = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[kind] }{size}")
    rows = min(rows, len(raw) // (cols * bands * size))
    predictor = tags.get(PREDICTOR, (1,))[0]
    flat = np.frombuffer(raw, np.uint8, rows * cols * bands * size)
    if predictor == 3:
        # differences of bytes along a row whose values' high bytes all come first
        summed = flat.reshape(rows, cols * size, bands).cumsum(axis=1, dtype=np.uint8)
        planes = summed.reshape(rows, size, cols * bands).transpose(0, 2, 1)
        return np.ascontiguousarray(planes).view(f">{dtype.kind}{size}").reshape(rows, cols, bands)[:, :, 0]
    values = flat.view(dtype).reshape(rows, cols, bands)
    if predictor == 2:
        unsigned = values.astype(f"=u{size}", copy=False) if kind != 3 else values.view(f"{order}u{size}").astype(f"=u{size}")
        return unsigned.cumsum(axis=1, dtype=f"u{size}").view(f"={dtype.kind}{size}")[:, :, 0]
    return values[:, :, 0]


def blocks(data: bytes) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, first column, values) of every strip or tile; no-data and non-finite cells are NaN."""
    order, tags = directory(data)
    width, height = tags[WIDTH][0], tags[HEIGHT][0]
    tiled = TILE_OFFSETS in tags
    rows, cols = (tags[TILE_HEIGHT][0], tags[TILE_WIDTH][0]) if tiled else (min(height, tags.get(STRIP_ROWS, (height,))[0]), width)
    across = -(-width // cols)
    nodata = tags[NODATA][0].rstrip(b"\0 ").decode("ascii") if NODATA in tags else ""
    n = across * -(-height // rows)
    for i, (at, size) in enumerate(zip(tags[TILE_OFFSETS if tiled else OFFSETS][:n], tags[TILE_COUNTS if tiled else COUNTS][:n], strict=True)):
        row, col = i // across * rows, i % across * cols
        values = _block(data[at : at + size], order, tags, rows, cols)[: height - row, : width - col]
        z = values.astype(np.float64)
        if nodata:
            missing = float(nodata)
            z[z == (float(values.dtype.type(missing)) if values.dtype.kind == "f" else missing)] = np.nan
        z[~np.isfinite(z)] = np.nan
        yield row, col, z


def read_geotiff(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(rasters, cells) of GeoTIFF files, a course's slug being its file's name without the ending.

    Cells without a value have no row. A file is held by one task, its cells leave it a strip or tile at a time. Files
    that are no GeoTIFFs, are broken or of a kind that isn't read give no rows, so that their courses are told to lack
    elevation.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def slug(path: str) -> str:
        return PurePosixPath(path).stem

    def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, data in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    tags = directory(data.as_py())[1]
                    a, c, e, f, epsg = place(tags)
                    rows.append((slug(path.as_py()), tags[HEIGHT][0], tags[WIDTH][0], a, c, e, f, epsg))
                except (RasterError, struct.error, KeyError):
                    continue
            columns = zip(*rows, strict=True) if rows else [()] * 8
            types = (pa.string(), pa.int32(), pa.int32(), *[pa.float64()] * 4, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types, strict=True)], names=["course_slug", "rows", "cols", "a", "c", "e", "f", "epsg"])

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    for row, col, z in blocks(data.as_py()):
                        r, k = np.nonzero(~np.isnan(z))
                        yield pa.RecordBatch.from_arrays([pa.array([slug(path.as_py())] * len(r), pa.string()), pa.array((r + row).astype(np.int32)), pa.array((k + col).astype(np.int32)), pa.array(z[r, k])], names=["course_slug", "row", "col", "z"])
                except (RasterError, struct.error, KeyError, ValueError, zlib.error):
                    continue

    return files.mapInArrow(headers, RASTERS), files.mapInArrow(values, CELLS)
