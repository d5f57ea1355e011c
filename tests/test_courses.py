"""GeoTIFF decoding and the course pipeline, on rasters and map features made here."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from greenwake.sources import rasters

LON, LAT, STEP = -122.4, 37.7, 5e-5


def tiff(z, order="<", method=1, predictor=1, tile=None, strip=3, scale=(5.0, 5.0), tie=(100.0, 400.0), key=3072, epsg=32610):
    """A TIFF of z, in strips or tiles, with no-data -9999."""
    (h, w), size = z.shape, z.dtype.itemsize
    th, tw = tile or (strip, w)
    blocks = []
    for r in range(0, h, th):
        for c in range(0, w, tw):
            b = z[r : r + th, c : c + tw]
            if tile:
                b = np.pad(b, ((0, th - b.shape[0]), (0, tw - b.shape[1])))
            if predictor == 2:
                u = np.ascontiguousarray(b).view(f"u{size}")
                raw = np.diff(u, axis=1, prepend=u.dtype.type(0)).astype(f"{order}u{size}").tobytes()
            elif predictor == 3:
                planes = b.astype(f">f{size}").view(np.uint8).reshape(*b.shape, size).transpose(0, 2, 1).reshape(b.shape[0], -1)
                raw = np.diff(planes, axis=1, prepend=np.uint8(0)).tobytes()
            else:
                raw = b.astype(f"{order}{b.dtype.kind}{size}").tobytes()
            blocks.append(zlib.compress(raw) if method == 8 else raw)
    at = [8 + sum(map(len, blocks[:i])) for i in range(len(blocks))]
    tags = {256: ("I", [w]), 257: ("I", [h]), 258: ("H", [8 * size]), 259: ("H", [method]), 277: ("H", [1]), 317: ("H", [predictor]), 339: ("H", [{"u": 1, "i": 2, "f": 3}[z.dtype.kind]])}
    tags |= {33550: ("d", [*scale, 0.0]), 33922: ("d", [0.0, 0.0, 0.0, *tie, 0.0]), 34735: ("H", [1, 1, 0, 1, key, 0, 1, epsg]), 42113: ("s", b"-9999\0")}
    sizes = [len(b) for b in blocks]
    tags |= {322: ("I", [tw]), 323: ("I", [th]), 324: ("I", at), 325: ("I", sizes)} if tile else {278: ("I", [th]), 273: ("I", at), 279: ("I", sizes)}
    start = 8 + sum(sizes)
    entries, rest = b"", b""
    for tag, (kind, values) in sorted(tags.items()):
        raw = values if kind == "s" else struct.pack(f"{order}{len(values)}{kind}", *values)
        if len(raw) > 4:
            raw, rest = struct.pack(order + "I", start + 6 + 12 * len(tags) + len(rest)), rest + raw
        entries += struct.pack(order + "HHI", tag, {"I": 4, "H": 3, "d": 12, "s": 2}[kind], len(values)) + raw.ljust(4, b"\0")
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, start) + b"".join(blocks) + struct.pack(order + "H", len(tags)) + entries + b"\0" * 4 + rest


@pytest.mark.parametrize("dtype", ["f4", "f8", "i2", "u2", "i4"])
def test_tiff_kinds(dtype):
    rng = np.random.default_rng(0)
    z = (rng.integers(0, 999, (10, 7)) if dtype[0] == "u" else rng.normal(size=(10, 7)) * 100).astype(dtype)
    if dtype[0] != "u":
        z[2, 3] = -9999
    want = np.where(z == -9999, np.nan, z.astype(float)) if dtype[0] != "u" else z.astype(float)
    for order in "<>":
        for method in (1, 8):
            for predictor in (1, 2, 3) if dtype[0] == "f" else (1, 2):
                for tile in (None, (16, 16), (4, 4)):
                    data = tiff(z, order, method, predictor, tile)
                    got = np.full(z.shape, np.inf)
                    for r, c, b in rasters.blocks(data):
                        got[r : r + b.shape[0], c : c + b.shape[1]] = b
                    assert np.array_equal(got, want, equal_nan=True), (order, method, predictor, tile)
    assert rasters.place(rasters.directory(data)[1]) == (5.0, 100.0, -5.0, 400.0, 32610)


def pack_codes(codes, widths):
    bits = "".join(f"{c:0{w}b}" for c, w in zip(codes, widths, strict=True))
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def test_lzw():
    # 258 is "ab", 259 is "ba", 260 is the code just being made: "aba"
    assert rasters.lzw(pack_codes([256, 97, 98, 258, 260, 257], [9] * 6)) == b"ababaab"[:4] + b"aba"
    # 253 single bytes fill the table to 510, from where codes have 10 bits
    n = 254
    assert rasters.lzw(pack_codes([256, *range(n), 7, 257], [9] * (n + 1) + [10, 10])) == bytes([*range(n), 7])
    with pytest.raises(rasters.RasterError):
        rasters.lzw(pack_codes([256, 300], [9, 9]))


def test_files_that_are_no_rasters(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(tiff(np.full((4, 3), 7, "f4")))
    (tmp_path / "b.tif").write_bytes(b"<html>")
    (tmp_path / "c.tif").write_bytes(b"")
    table, cells = rasters.read_geotiff(spark, str(tmp_path))
    assert [r["course_slug"] for r in table.collect()] == ["a"] and cells.count() == 12


def box(lon, lat, w, h, **tags):
    ring = [[lon - w, lat - h], [lon + w, lat - h], [lon + w, lat + h], [lon - w, lat + h], [lon - w, lat - h]]
    return {"type": "Feature", "properties": tags, "geometry": {"type": "Polygon", "coordinates": [ring]}}


def line(number, lon, *lats):
    return {"type": "Feature", "properties": {"golf": "hole", "ref": str(number), "par": "4"}, "geometry": {"type": "LineString", "coordinates": [[lon, y] for y in lats]}}


def write_course(root, slug, layers):
    folder = root / "sources" / slug / "source"
    folder.mkdir(parents=True)
    for name, features in layers.items():
        (folder / f"{name}.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))


@pytest.fixture(scope="module")
def world(tmp_path_factory):
    root = tmp_path_factory.mktemp("world")
    bound = [box(LON, LAT, 0.004, 0.004, leisure="golf_course", id="9")]
    greens = [box(LON, LAT + 0.0015, 0.0001, 0.0001, golf="green", ref="1")]
    fairways = [box(LON, LAT, 0.0002, 0.0012, golf="fairway")]
    hole = line(1, LON, LAT - 0.0015, LAT + 0.0015)
    write_course(root, "alpha", {"bounds": bound, "holes": [hole, line(1, LON, LAT, LAT + 0.0002)], "areas": greens + fairways})
    write_course(root, "unbounded", {"holes": [hole]})
    write_course(root, "short", {"bounds": bound, "holes": [hole]})
    write_course(root, "flat", {"bounds": bound, "holes": [hole]})
    write_course(root, "bare", {"bounds": bound, "holes": [hole]})
    rows = np.arange(100)[:, None] + np.zeros((1, 100))
    z = (100 - (rows + 0.5) * STEP * 1000).astype("f8")
    place = {"scale": (STEP, STEP), "tie": (LON - 50 * STEP, LAT + 50 * STEP), "key": 2048, "epsg": 4326}
    (root / "rasters").mkdir()
    (root / "rasters" / "alpha.tif").write_bytes(tiff(z, method=8, **place))
    (root / "rasters" / "short.tif").write_bytes(tiff(z, **place))
    (root / "rasters" / "bare.tif").write_bytes(tiff(np.full((9, 9), -9999, "f4"), **place))
    (root / "rasters" / "flat.tif").write_bytes(b"not found")
    one = {"course_name": "x", "country": "US", "latitude": LAT, "longitude": LON, "hole_buffer_meters": 40}
    expected = {"alpha": 1, "unbounded": 1, "short": 2, "flat": 1, "bare": 1}
    (root / "courses.json").write_text(json.dumps([{**one, "course_slug": s, "expected_holes": n} for s, n in expected.items()]))
    return root


def arguments(root, out, *more):
    return ["courses", "--config", str(root / "courses.json"), "--sources", str(root / "sources"), "--rasters", str(root / "rasters"), "--out", str(out), "--point-resolution", "5", *more]


def test_courses_end_to_end(spark, world, tmp_path):
    from greenwake.__main__ import main

    out = tmp_path / "out"
    assert main(arguments(world, out, "--all", "--export-csv")) == 1  # two courses fail, the others are written
    state = {r["course_slug"]: r for r in spark.read.parquet(str(out / "manifests")).collect()}
    assert {k: r["status"] for k, r in state.items()} == {"alpha": "processed", "unbounded": "skipped", "short": "skipped", "flat": "failed", "bare": "failed"}
    assert state["alpha"]["processed_holes"] == 1 and state["alpha"]["duplicate_refs"] == [1] and state["short"]["missing_refs"] == [2]
    assert state["alpha"]["projected_crs"] == "EPSG:32610"
    codes = {(r["course_slug"], r["code"]) for r in spark.read.parquet(str(out / "issues")).collect()}
    assert codes >= {("unbounded", "NO_COURSE_BOUNDARY"), ("short", "EXPECTED_HOLES_MISMATCH"), ("flat", "DEM_DOWNLOAD_FAILED"), ("bare", "HOLE_PROCESSING_FAILED"), ("alpha", "DUPLICATE_HOLE_REFS")}
    hole = spark.read.parquet(str(out / "holes")).collect()[0]
    assert hole["hole_id"] == "alpha__01" and hole["par"] == 4 and abs(hole["hole_length_m"] - 333) < 2
    assert (hole["green_method"], hole["tee_method"]) == ("green_feature", "centerline_start")
    assert abs(hole["net_elevation_change_m"] - 3.0) < 1e-3 and hole["dem_coverage"] > 0.99
    assert abs(hole["avg_slope_percent"] - 0.9) < 0.02 and hole["quality_flags"] == ["COARSE_DEM_RESOLUTION"]
    points = spark.read.parquet(str(out / "points"))
    assert points.count() == hole["point_count"] == points.select("point_id").distinct().count()
    labels = {r["label"]: r["count"] for r in points.groupBy("label").count().collect()}
    assert labels["fairway"] > 100 and labels["green"] >= 4 and labels["rough_inferred"] > 100
    green = points.filter("label = 'green'").agg(F.avg("x_aligned_m"), F.avg("y_aligned_m")).first()
    assert abs(green[0]) < 4 and abs(green[1] - 333) < 4
    assert len(list((out / "holes_csv").glob("*.csv"))) >= 1


def test_courses_by_slug(spark, world, tmp_path, capsys):
    from greenwake.__main__ import main

    out = tmp_path / "out"
    assert main(arguments(world, out, "--course", "short", "--allow-dirty", "--max-points", "50")) == 0
    hole = spark.read.parquet(str(out / "holes")).collect()[0]
    assert hole["point_count"] == 50 and "POINT_LIMIT_REACHED" in hole["quality_flags"]
    assert main(arguments(world, out, "--course", "short", "--allow-dirty")) == 1  # there is a run already
    assert main(arguments(world, tmp_path / "no", "--course", "nowhere")) == 1
    assert main(arguments(world, tmp_path / "no", "--list")) == 0 and "alpha" in capsys.readouterr().out.split()
