"""Plane geometry and map projection as column expressions.

A line or ring is array<struct<x,y>>. Distances are Euclidean in metres; a point on a ring's edge is inside it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def segments(line: Column) -> Column:
    """array<struct<a,b>> of neighbouring vertices."""
    return F.arrays_zip(F.slice(line, 1, F.size(line) - 1).alias("a"), F.slice(line, 2, F.size(line) - 1).alias("b"))


def point_segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.nullif(length, F.lit(0.0)))))
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def point_line_distance(px: Column, py: Column, line: Column) -> Column:
    """Distance to the nearest segment of a line; null for a line without segments."""
    return F.array_min(F.transform(segments(line), lambda s: point_segment_distance(px, py, s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])))


def line_length(line: Column) -> Column:
    return F.aggregate(segments(line), F.lit(0.0), lambda acc, s: acc + F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]))


def merge_lines(parts: Column) -> Column:
    """One line of a multi-line's parts, in order."""
    return F.flatten(parts)


def _cross(s: Column, at: Column) -> Column:
    """Twice the signed area of a segment with the point `at`; from a near point, as products of coordinates as large
    as a map grid's would leave no digits for a small ring."""
    return (s["a"]["x"] - at["x"]) * (s["b"]["y"] - at["y"]) - (s["b"]["x"] - at["x"]) * (s["a"]["y"] - at["y"])


def signed_area(ring: Column) -> Column:
    first = F.get(ring, 0)
    return F.aggregate(segments(ring), F.lit(0.0), lambda acc, s: acc + _cross(s, first)) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def _vertex_mean(ring: Column, axis: str) -> Column:
    return F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + p[axis]) / F.nullif(F.size(ring), F.lit(0))


def centroid(ring: Column) -> Column:
    """struct<x,y>: area centroid of a closed ring, the mean of its vertices if it has no area."""
    twice, first = 6 * signed_area(ring), F.get(ring, 0)

    def axis(name: str) -> Column:
        total = F.aggregate(segments(ring), F.lit(0.0), lambda acc, s: acc + (s["a"][name] + s["b"][name] - 2 * first[name]) * _cross(s, first))
        return F.coalesce(first[name] + total / F.nullif(twice, F.lit(0.0)), _vertex_mean(ring, name))

    return F.struct(axis("x").alias("x"), axis("y").alias("y"))


def in_ring(px: Column, py: Column, ring: Column, edge: bool = True) -> Column:
    """Whether a point is in a closed ring, its edge included; without `edge` a point on an edge counts as the crossings
    say (lower and left edges in, upper and right ones out), so that rings side by side share no point."""

    def crosses(s: Column) -> Column:
        ay, by = s["a"]["y"], s["b"]["y"]
        at = s["a"]["x"] + (py - ay) * (s["b"]["x"] - s["a"]["x"]) / F.nullif(by - ay, F.lit(0.0))
        return ((ay > py) != (by > py)) & (px < at)

    odd = F.size(F.filter(segments(ring), crosses)) % 2 == 1
    return odd | F.coalesce(point_line_distance(px, py, ring) <= 1e-9, F.lit(False)) if edge else odd


def representative_point(ring: Column) -> Column:
    """A point within a ring: its centroid if that lies inside, else the middle of the widest span of the scanline
    through the ring's middle height."""
    mid = (F.array_min(F.transform(ring, lambda p: p["y"])) + F.array_max(F.transform(ring, lambda p: p["y"]))) / 2
    cuts = F.array_sort(F.transform(F.filter(segments(ring), lambda s: (s["a"]["y"] > mid) != (s["b"]["y"] > mid)), lambda s: s["a"]["x"] + (mid - s["a"]["y"]) * (s["b"]["x"] - s["a"]["x"]) / (s["b"]["y"] - s["a"]["y"])))
    spans = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(cuts) / 2 - 1).cast("int")), lambda i: F.struct((F.get(cuts, 2 * i + 1) - F.get(cuts, 2 * i)).alias("w"), ((F.get(cuts, 2 * i + 1) + F.get(cuts, 2 * i)) / 2).alias("x")))
    c = centroid(ring)
    return F.when(F.size(ring) == 1, F.element_at(ring, 1)).when(in_ring(c["x"], c["y"], ring) | (F.size(cuts) < 2), c).otherwise(F.struct(F.array_max(spans)["x"].alias("x"), mid.alias("y")))


def bounds(line: Column) -> Column:
    """struct<x0,y0,x1,y1>."""
    xs, ys = F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def interpolate(line: Column, fraction: Column) -> Column:
    """struct<x,y>: the point that far along a line, 0 to 1."""
    target = line_length(line) * fraction

    def step(state: Column, s: Column) -> Column:
        length = F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"])
        t = F.when(length == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), (target - state["run"]) / F.nullif(length, F.lit(0.0))))
        here = (state["run"] + length >= target) & ~state["done"]
        x = F.when(state["done"], state["x"]).when(here, s["a"]["x"] + t * (s["b"]["x"] - s["a"]["x"])).otherwise(s["b"]["x"])
        y = F.when(state["done"], state["y"]).when(here, s["a"]["y"] + t * (s["b"]["y"] - s["a"]["y"])).otherwise(s["b"]["y"])
        return F.struct((state["run"] + length).alias("run"), (state["done"] | here).alias("done"), x.alias("x"), y.alias("y"))

    first = F.element_at(line, 1)
    start = F.struct(F.lit(0.0).alias("run"), F.lit(False).alias("done"), first["x"].alias("x"), first["y"].alias("y"))
    return F.aggregate(segments(line), start, step, lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))


def align(x: Column, y: Column, tee_x: Column, tee_y: Column, green_x: Column, green_y: Column) -> tuple[Column, Column]:
    """Tee-relative coordinates turned so that the green lies on the +y axis."""
    angle = F.atan2(green_x - tee_x, green_y - tee_y)
    dx, dy = x - tee_x, y - tee_y
    return dx * F.cos(angle) - dy * F.sin(angle), dx * F.sin(angle) + dy * F.cos(angle)


# WGS 84 and UTM (fixed values).
_A, _F = 6378137.0, 1 / 298.257223563
_K0, _EAST, _SOUTH = 0.9996, 500000.0, 10000000.0
_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_C = 2 * math.sqrt(_N) / (1 + _N)


def utm_zone(lon: Column) -> Column:
    return F.least(F.lit(60), F.floor((lon + 180) / 6).cast("int") + 1)


def utm_srid(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)


def to_utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """(easting, northing) by the Krueger series; negative northings are shifted for the southern half."""
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - _C * F.atanh(_C * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return _EAST + _K0 * _RADIUS * east, F.when(lat < 0, _SOUTH).otherwise(0.0) + _K0 * _RADIUS * north


def from_utm(east: Column, north: Column, zone: Column, south: Column | None = None) -> tuple[Column, Column]:
    """(lon, lat), the inverse of to_utm."""
    shift = F.when(F.lit(False) if south is None else south, _SOUTH).otherwise(0.0)
    xi, eta = (north - shift) / (_K0 * _RADIUS), (east - _EAST) / (_K0 * _RADIUS)
    x, e = xi, eta
    for j, b in enumerate(_BETA, 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        e = e - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(e))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return zone * 6 - 183 + F.degrees(F.atan2(F.sinh(e), F.cos(x))), F.degrees(lat)
