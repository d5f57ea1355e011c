"""Hole features from packed points: a hole's points meet once, as compressed columns, and all features are taken there.

The definitions are those of `operators/features.py`; means are exact sums of values to 8 places, as there.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from greenwake.schema import LABEL_IDS
from greenwake.session import partitions, ship

#: Rows that a task packs at once.
ROWS = 1 << 19
#: Labels' numbers; 0 is any other label or none.
CODES = {name: i for i, name in enumerate(LABEL_IDS, 1)}
#: The NaN that stands for null.
LOST = np.array([0xFFF8_0000_0000_1057], dtype=np.uint64).view(np.float64)[0]
_PLACES = Decimal("1e-8")


def lost(column: np.ndarray) -> np.ndarray:
    """Where a packed column is null."""
    return np.ascontiguousarray(column).view(np.uint64) == LOST.view(np.uint64)


def _squeezed(column: np.ndarray) -> bytes:
    """Doubles with their bytes sorted by place, which compress better."""
    return np.ascontiguousarray(column.view(np.uint8).reshape(-1, 8).T).tobytes()


def _opened(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<f8").ravel()


def _blobs(parts: np.ndarray, hole: pa.Array, label: np.ndarray, xyz: list[np.ndarray]) -> pa.RecordBatch:
    coded = hole.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    order = np.lexsort((code, parts))
    parts, code, label, xyz = parts[order], code[order], label[order], [c[order] for c in xyz]
    new = np.r_[True, (parts[1:] != parts[:-1])]
    start = np.flatnonzero(new)
    squeeze, blobs = zstandard.ZstdCompressor(level=1).compress, []
    for lo, hi in zip(start, np.append(start[1:], len(parts)), strict=True):
        first = lo + np.flatnonzero(np.r_[True, code[lo + 1 : hi] != code[lo : hi - 1]])
        counts = np.diff(np.append(first, hi))
        blobs.append(squeeze(pickle.dumps((coded.dictionary.take(pa.array(code[first])), counts, label[lo:hi].tobytes(), *[_squeezed(c[lo:hi]) for c in xyz]), protocol=5)))
    return pa.RecordBatch.from_arrays([pa.array(parts[start], pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def out() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        hole = table["hole_id"].combine_chunks()
        hole = pa.concat_arrays(hole.chunks) if isinstance(hole, pa.ChunkedArray) else hole
        xyz = [table[c].to_numpy() if not table[c].null_count else np.where(pc.is_null(table[c]).to_numpy(), LOST, table[c].cast(pa.float64()).to_numpy(zero_copy_only=False)) for c in "xyz"]
        return _blobs(table["part"].to_numpy(), hole, table["label"].to_numpy().astype(np.uint8), xyz)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= ROWS:
            yield out()
            held, n = [], 0
    if n:
        yield out()


def fixed(value: np.ndarray) -> np.ndarray:
    """Values times 10^8 as integers, rounded half away from 0 by their shortest decimal form; NaN counts 0.

    Only values near a tie or beyond what a product of doubles tells are looked at one by one. Those beyond an int64 make
    the column one of Python integers.
    """
    v = np.where(np.isnan(value), 0.0, value)
    w = np.abs(v) * 1e8
    down = np.floor(w)
    near = (np.abs(w - down - 0.5) <= np.maximum(1e-3, 4 * np.spacing(w))) | (w > 2.0**51)
    slow = np.flatnonzero(near)
    exact = [int(Decimal(repr(float(x))).quantize(_PLACES, ROUND_HALF_UP).scaleb(8)) if abs(x) < 1e15 else int(Decimal(repr(float(x))).scaleb(8)) for x in v[slow].tolist()]
    huge = any(abs(x) >= 1 << 62 for x in exact)
    out = np.copysign(np.where(near, 0, np.floor(w + 0.5)), v).astype(np.int64)
    out = out.astype(object) if huge else out
    if len(slow):
        out[slow] = exact
    return out


class Holes:
    """Points sorted by hole, n holes; null values are NaN. Sums and ends are a hole each, NaN for none."""

    def __init__(self, owner: np.ndarray, n: int):
        self.owner, self.n = owner, n

    def count(self, at: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.owner if at is None else self.owner[at], minlength=self.n)

    def by(self, at: np.ndarray, code: np.ndarray, width: int) -> np.ndarray:
        """Points at `at` by hole and code."""
        return np.bincount(self.owner[at] * width + code[at], minlength=self.n * width).reshape(self.n, width)

    def sums(self, values: np.ndarray, owner: np.ndarray, n: int) -> list[int] | np.ndarray:
        """Integer sums of runs of equal owners, exact at any size."""
        out = np.zeros(n, dtype=values.dtype if values.dtype == object else np.int64)
        if not len(values):
            return out
        head = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        size = np.diff(np.append(head, len(owner))).max()
        if values.dtype != object and float(max(abs(int(values.max())), abs(int(values.min())))) * float(size) >= 2.0**62:
            high, low = values >> np.int64(26), values & np.int64((1 << 26) - 1)
            out = out.astype(object)
            out[owner[head]] = (np.add.reduceat(high, head).astype(object) * (1 << 26)) + np.add.reduceat(low, head).astype(object)
        else:
            out[owner[head]] = np.add.reduceat(values, head)
        return out

    def means(self, value: np.ndarray, whole: np.ndarray, at: np.ndarray, owner: np.ndarray | None = None, n: int | None = None) -> np.ndarray:
        """Means of values (whole: their fixed form) at sorted places `at`, nulls left out."""
        owner, n = self.owner if owner is None else owner, self.n if n is None else n
        at = at[~np.isnan(value[at])]
        count, total = np.bincount(owner[at], minlength=n), self.sums(whole[at], owner[at], n)
        wide = total.dtype == object or (np.abs(total) > 1 << 53).any()
        double = np.array([int(t) / 10**8 for t in total.tolist()], dtype=float) if wide else total / 1e8
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(count > 0, double / count, np.nan)

    def ends(self, value: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = at[~np.isnan(value[at])]
        lo, hi = np.full(self.n, np.nan), np.full(self.n, np.nan)
        if len(at):
            owner = self.owner[at]
            head = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lo[owner[head]], hi[owner[head]] = np.minimum.reduceat(value[at], head), np.maximum.reduceat(value[at], head)
        return lo, hi

    def percentiles(self, value: np.ndarray, at: np.ndarray, shares: tuple[float, ...]) -> list[np.ndarray]:
        at = at[~np.isnan(value[at])]
        at = at[np.lexsort((value[at], self.owner[at]))]
        count, ordered = self.count(at), value[at]
        start, some = np.cumsum(count) - count, np.flatnonzero(count)
        out = []
        for p in shares:
            place = (count[some] - 1) * p
            low, high = np.floor(place), np.ceil(place)
            a, b = ordered[start[some] + low.astype(np.int64)], ordered[start[some] + high.astype(np.int64)]
            one = np.full(self.n, np.nan)
            one[some] = np.where(a == b, a, (high - place) * a + (place - low) * b)
            out.append(one)
        return out

    def deviation(self, value: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(~np.isnan(value))
        owner, count = self.owner[at], self.count(at)
        base = self.ends(value, at)[0]
        with np.errstate(invalid="ignore", divide="ignore"):
            x = value[at] - base[owner]
            mean = np.bincount(owner, x, self.n) / count
            return np.sqrt(np.bincount(owner, (x - mean[owner]) ** 2, self.n) / count)


def _features(owner: np.ndarray, n: int, label: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> dict[str, np.ndarray]:
    from greenwake.operators import features as f

    h, every = Holes(owner, n), np.arange(len(owner))
    fx, fy, fz = fixed(x), fixed(y), fixed(z)
    width = len(CODES) + 1
    rough = [CODES[c] for c in f.ROUGH]
    named = lambda counts, name: counts[:, rough].sum(1) if name == "rough" else counts[:, CODES[name]]
    out: dict[str, np.ndarray] = {}
    with np.errstate(invalid="ignore", divide="ignore"):
        share = lambda part, whole: np.where(whole > 0, part / whole, np.nan)
        counts = h.by(every, label, width)
        green, points = np.flatnonzero(label == CODES["green"]), h.count()
        by_green = counts[:, CODES["green"]] >= f.MIN_GREEN
        far = h.percentiles(y, np.flatnonzero(~by_green[owner]), (0.98,))[0]
        g = out["green_y_m"] = np.where(by_green, h.means(y, fy, green), far)
        for name, value in (("x", x), ("y", y), ("z", z)):
            out[f"{name}_min"], out[f"{name}_max"] = h.ends(value, every)
        out["hole_width_m"], out["hole_depth_m"], out["z_range"] = (out[f"{c}_max"] - out[f"{c}_min"] for c in "xyz")
        out["point_count"], out["valid_point_count"] = points, h.count(np.flatnonzero(~(np.isnan(x) | np.isnan(y) | np.isnan(z))))
        out["z_mean"], out["z_std"] = h.means(z, fz, every), h.deviation(z)
        out["z_p10"], out["z_p50"], out["z_p90"] = h.percentiles(z, every, (0.1, 0.5, 0.9))
        out["green_relative_elevation"] = h.means(z, fz, green)
        for name in (*LABEL_IDS, "rough"):
            out[f"{name}_pct"] = share(named(counts, name), points)
        to = g[owner]
        zone = {
            "tee_zone": (y >= f.TEE_ZONE[0]) & (y < f.TEE_ZONE[1]), "drive_zone": (y >= f.DRIVE_ZONE[0]) & (y < f.DRIVE_ZONE[1]),
            "approach_zone": (y >= np.maximum(0.0, to - f.APPROACH_DEPTH)) & (y < to), "green_complex": (y >= np.maximum(0.0, to - f.GREEN_DEPTH)) & (y < to),
        }
        centre = {}
        for name, inside in zone.items():
            at = np.flatnonzero(inside)
            counts, total = h.by(at, label, width), h.count(at)
            for one in f.ZONE_LABELS:
                out[f"{name}_{one}_pct"] = share(named(counts, one), total)
            lo, hi = h.ends(z, at)
            out[f"{name}_mean_z"], out[f"{name}_z_range"] = h.means(z, fz, at), hi - lo
            if name not in ("drive_zone", "approach_zone"):
                continue
            for side, on in (("left", x < 0), ("right", x > 0)):
                counts = h.by(np.flatnonzero(inside & on), label, width)
                for one in f.PRESSURE_LABELS:
                    out[f"{name.removesuffix('_zone')}_{one}_{side}_pct"] = share(named(counts, one), total)
            at = np.flatnonzero(inside & (label == CODES["fairway"]) & ~np.isnan(x))
            low, high = h.percentiles(x, at, (0.05, 0.95))
            out[f"fairway_width_{name}"] = np.where(h.count(at) >= 5, high - low, np.nan)
            centre[name] = h.means(x, fx, at)
        out["fairway_centerline_shift"] = centre["approach_zone"] - centre["drive_zone"]
        at = np.flatnonzero((label == CODES["fairway"]) & (to > 0))
        along = (y[at] >= 0) & (y[at] < to[at])
        bin_ = np.where(along, np.minimum(f.BINS - 1, np.floor(y[at] / (to[at] / f.BINS))), 0).astype(np.int64)
        in_bins = at[along]
        slot = owner[in_bins] * f.BINS + bin_[along]
        order = np.argsort(slot, kind="stable")
        in_bins, slot = in_bins[order], slot[order]
        cells = n * f.BINS
        middle = np.abs(Holes(slot, cells).means(x[in_bins], fx[in_bins], np.arange(len(slot))))
        middle[np.bincount(slot, minlength=cells) < f.MIN_BIN] = np.nan
        off = np.fmax.reduce(middle.reshape(n, f.BINS), axis=1)
        out["dogleg_score"] = np.where(h.count(at) >= f.MIN_FAIRWAY, off / g, np.nan)
    return out


#: Columns that count; all others are doubles.
LONGS = ("point_count", "valid_point_count")


def _unpack(group: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Holes, and the points sorted by hole: their hole's number, label and x, y, z."""
    open_, holes, counts, label, xyz = zstandard.ZstdDecompressor().decompress, [], [], [], []
    for blob in group["blob"].to_pylist():
        own, n, labels, *columns = pickle.loads(open_(blob))
        holes.append(own), counts.append(n), label.append(np.frombuffer(labels, np.uint8)), xyz.append([_opened(c) for c in columns])
    coded = pa.concat_arrays(holes).dictionary_encode()
    owner = np.repeat(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate(counts))
    order = np.argsort(owner, kind="stable")
    return coded.dictionary, owner[order], np.concatenate(label)[order].astype(np.int64), [np.concatenate(c)[order] for c in zip(*xyz, strict=True)]


def wide(points: DataFrame, names: list[str]) -> DataFrame:
    """(hole_id, green_y_m and the features named), one row a hole of clean points; points without a hole are left out."""
    ship(points.sparkSession)
    parts = partitions(points.sparkSession)
    code = F.lit(0)
    for name, i in reversed(CODES.items()):
        code = F.when(F.col("label") == name, i).otherwise(code)
    slim = points.filter(F.col("hole_id").isNotNull()).select(F.pmod(F.xxhash64("hole_id"), F.lit(parts)).cast("int").alias("part"), "hole_id", code.cast("byte").alias("label"), *"xyz")
    kind = points.schema["hole_id"].dataType.simpleString()
    schema = f"hole_id {kind}, " + ", ".join(f"{c} {'long' if c in LONGS else 'double'}" for c in names)

    def task(group: pa.Table) -> pa.Table:
        holes, owner, label, xyz = _unpack(group)
        found = _features(owner, len(holes), label, *xyz)
        return pa.table([holes, *[pa.array(found[c].astype(np.int64) if c in LONGS else found[c].astype(float), from_pandas=True) for c in names]], names=["hole_id", *names])

    return slim.mapInArrow(_pack, "part int, blob binary").repartition(parts, "part").groupBy("part").applyInArrow(task, schema)
