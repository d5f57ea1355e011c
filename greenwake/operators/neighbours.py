"""Feature matrix, similarity modes and filtered nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from greenwake.functions.stats import standardised
from greenwake.operators import tiles
from greenwake.schema import ID_COLUMNS

# Weights of the length-aware modes, the length guard, and the columns of the partial modes.
LENGTH_WEIGHTS = {
    "hole_length_m": 4.0, "hole_length_yd": 0.0, "hole_depth_m": 2.0, "green_y_m": 3.0, "par": 2.0,
    "fairway_width_drive_zone": 1.5, "fairway_width_approach_zone": 1.5, "tee_to_green_elevation_change": 1.5,
    "rough_pct": 0.5, "rough_inferred_pct": 0.5,
}
GUARD_M, GUARD_PCT = 35.0, 0.12
#: Pairs whose distances a task holds at once, few enough for a processor's cache.
TILE = 1 << 18
_HAZARDS = ("trees", "bunker", "water")


def _sides(zone: str) -> list[str]:
    return [f"{zone}_{h}_{side}_pct" for h in _HAZARDS for side in ("left", "right")]


def _in(zone: str, labels: tuple[str, ...]) -> list[str]:
    return [f"{zone}_{label}_pct" for label in labels]


MODE_COLUMNS = {
    "off_the_tee": ["hole_length_m", "par", *_in("drive_zone", ("fairway", *_HAZARDS)), *_sides("drive"), "fairway_width_drive_zone", "dogleg_score", "fairway_centerline_shift"],
    "approach": [*_in("approach_zone", ("fairway", *_HAZARDS)), *_sides("approach"), "fairway_width_approach_zone", "tee_to_green_elevation_change", "green_relative_elevation"],
    "green_complex": ["green_pct", *_in("green_complex", _HAZARDS), "green_complex_mean_z", "green_complex_z_range", "green_relative_elevation", "tee_to_green_elevation_change"],
    "hazard": [*[f"{h}_pct" for h in (*_HAZARDS, "sand")], *[c for z in ("drive_zone", "approach_zone", "green_complex") for c in _in(z, _HAZARDS)], *_sides("drive"), *_sides("approach")],
    "terrain": [*[f"z_{s}" for s in ("min", "max", "mean", "std", "range", "p10", "p50", "p90")], "tee_to_green_elevation_change", "green_relative_elevation", *[f"{z}_{s}" for z in ("tee_zone", "drive_zone", "approach_zone", "green_complex") for s in ("mean_z", "z_range")]],
    "shot_shape": ["dogleg_score", "fairway_centerline_shift", "hole_width_m", "hole_depth_m", "fairway_width_drive_zone", "fairway_width_approach_zone", "x_min", "x_max", "y_min", "y_max"],
}


@dataclass(frozen=True)
class Mode:
    columns: list[str] | None = None
    weights: dict[str, float] = field(default_factory=dict)
    same_par: bool = False
    exclude_same_course: bool = False
    max_length_diff_m: float | None = None
    max_length_diff_pct: float | None = None


MODES: dict[str, Mode] = {
    "v1": Mode(),
    "length_weighted": Mode(weights=LENGTH_WEIGHTS),
    "same_par_length_guarded": Mode(None, LENGTH_WEIGHTS, True, False, GUARD_M, GUARD_PCT),
    "cross_course_same_par_length_guarded": Mode(None, LENGTH_WEIGHTS, True, True, GUARD_M, GUARD_PCT),
    "overall_v2": Mode(None, LENGTH_WEIGHTS, True, False, GUARD_M, GUARD_PCT),
    **{name: Mode(columns) for name, columns in MODE_COLUMNS.items()},
}
GOLF_MODES = ("overall_v2", *MODE_COLUMNS)


def mode_named(name: str) -> Mode:
    if name not in MODES:
        raise KeyError(f"unknown similarity mode {name!r}; choose from {sorted(MODES)}")
    return MODES[name]


def feature_columns(features: DataFrame) -> list[str]:
    """Numeric columns that aren't identifiers."""
    return [f.name for f in features.schema if isinstance(f.dataType, T.NumericType) and f.name not in ID_COLUMNS and f.name not in ("course_id",)]


def mode_columns(features: DataFrame, name: str) -> tuple[list[str], list[str]]:
    """(columns that a mode uses, columns it misses); ValueError if it would use none."""
    have, wanted = feature_columns(features), mode_named(name).columns
    if wanted is None:
        return have, []
    use = [c for c in wanted if c in have]
    if not use:
        raise ValueError(f"similarity mode {name!r} has no usable feature column here")
    return use, [c for c in wanted if c not in have]


def matrix(features: DataFrame, columns: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """(hole_id, v array<double>) of imputed, standardised, weighted features."""
    return standardised(features.select("hole_id", *columns), columns, weights).select("hole_id", F.array(*columns).alias("v"))


def matrix_long(features: DataFrame, columns: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """(hole_id, feature, value)."""
    return standardised(features.select("hole_id", *columns), columns, weights).unpivot(["hole_id"], columns, "feature", "value")


def missing_summary(features: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(feature, missing_count, missing_fraction), most missing first, from one pass."""
    columns = columns or feature_columns(features)
    counts = features.agg(F.count(F.lit(1)).alias("__n"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns])
    long_ = counts.unpivot(["__n"], columns, "feature", "missing_count")
    return long_.select("feature", "missing_count", F.try_divide(F.col("missing_count").cast("double"), F.col("__n").cast("double")).alias("missing_fraction")).orderBy(F.desc("missing_count"), "feature")


def length_limit(q: Column, max_m: float | None, max_pct: float | None) -> Column:
    """How far a candidate's length may be from the query's; unknown lengths are always within."""
    return F.greatest(*[F.lit(0.0), F.lit(0.0) if max_m is None else F.lit(max_m), F.lit(0.0) if max_pct is None else q * max_pct])


def _nearest(k: int, exclude_same_course: bool, guarded: bool):
    """Of a block of queries and one of candidates, what can be among a query's k nearest.

    Distances from products of matrices only leave out what is farther than the k-th by more than their error and the
    rounding; what stays is summed in the order of the columns.
    """

    def run(q: pa.Table, c: pa.Table) -> Iterator[pa.RecordBatch]:
        if not len(q) or not len(c):
            return
        c = c.take(pa.array(np.argsort(c["hole_id"].to_numpy(zero_copy_only=False), kind="stable")))
        width = int(max(np.nanmax(np.r_[0, tiles.doubles(pc.list_value_length(t["v"]))]) for t in (q, c)))
        (a, a_size, a_lost), (b, b_size, b_lost) = tiles.rows(q["v"], width), tiles.rows(c["v"], width)
        a_id, b_id = tiles.codes(q["hole_id"], c["hole_id"])
        a_course, b_course = tiles.codes(q["course_slug"], c["course_slug"]) if exclude_same_course else (None, None)
        a_length, b_length, limit = (tiles.doubles(q["hole_length_m"]), tiles.doubles(c["hole_length_m"]), tiles.doubles(q["limit"])) if guarded else (None, None, None)
        with np.errstate(all="ignore"):
            a2, b2 = (a * a).sum(1), (b * b).sum(1)
            # vectors whose products say nothing: not finite, with a null, or of another length
            a_odd, b_odd = (~(x2 < 1e300) | lost | (size != width) for x2, lost, size in ((a2, a_lost, a_size), (b2, b_lost, b_size)))
            # one product of matrices gives the squares of distances: -2 a b + a a + b b
            a_safe = np.where(a_odd[:, None], 0, np.c_[-2 * a, a2, np.ones(len(a))])
            b_safe = np.where(b_odd[:, None], 0, np.c_[b, np.ones(len(b)), b2]).T.copy()
            odd_ones, most = a_odd.any() or b_odd.any(), np.max(b2[~b_odd], initial=0.0)
            error = 8 * (width + 4) * np.finfo(float).eps
            step = max(1, TILE // len(b))
            for i in range(0, len(a), step):
                part = slice(i, i + step)
                near = a_safe[part] @ b_safe
                out = a_id[part, None] == b_id
                if exclude_same_course:
                    out |= a_course[part, None] == b_course
                if guarded:
                    out |= np.abs(a_length[part, None] - b_length) > limit[part, None]
                odd = (a_odd[part, None] | b_odd) & ~out if odd_ones else None
                np.copyto(near, np.inf, where=out if odd is None else out | odd)
                slack = error * (a2[part] + most)
                bound = (np.sqrt(np.maximum(_least(near, k) + slack, 0)) + 4e-9) ** 2 + slack
                if odd_ones:
                    row, col = np.nonzero(odd | (near <= bound[:, None]) & (near < np.inf) | np.isnan(near))
                else:
                    row, col = np.divmod(np.flatnonzero(near <= np.minimum(bound, np.finfo(float).max)[:, None]), len(b))
                d = np.zeros(len(row))
                for j in range(width):
                    e = a[row + i, j] - b[col, j]
                    d += e * e
                d = np.sqrt(d)
                unknown = a_lost[row + i] | b_lost[col] | (a_size[row + i] != b_size[col])
                # the order of the ranks: numbers, then infinity and NaN, then unknown
                least = np.where(unknown, np.inf, np.where(np.isnan(d), np.inf, d))
                cuts = np.searchsorted(row, np.arange(len(near) + 1))
                keep = [lo + x for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) if hi > lo for x in [_kept(least[lo:hi], d[lo:hi], unknown[lo:hi], k)]]
                if keep:
                    keep = np.concatenate(keep)
                    yield pa.RecordBatch.from_arrays([q["hole_id"].take(pa.array(row[keep] + i)).combine_chunks(), c["hole_id"].take(pa.array(col[keep])).combine_chunks(), pa.array(d[keep], mask=unknown[keep])], ["query_hole_id", "similar_hole_id", "distance"])

    return run


def _least(near: np.ndarray, k: int) -> np.ndarray:
    """Of each row a value that at least k are not above, if it has as many: the k-th least of the least of groups."""
    groups = max(8 * k, 64)
    if near.shape[1] >= 4 * groups:
        whole = near.shape[1] // groups * groups
        least = near[:, :whole].reshape(len(near), -1, groups).min(1)
        near = np.where(np.isnan(least), np.inf, least)
    return np.partition(near, k - 1, axis=1)[:, k - 1] if k < near.shape[1] else np.full(len(near), np.inf)


def _kept(least: np.ndarray, d: np.ndarray, unknown: np.ndarray, k: int) -> np.ndarray:
    finite = np.flatnonzero(least < np.inf)
    out = finite[tiles.first(least[finite], k, 4e-9)]
    if len(finite) < k:
        rest = [np.flatnonzero(~unknown & np.isinf(d)), np.flatnonzero(~unknown & np.isnan(d)), np.flatnonzero(unknown)]
        out = np.concatenate([out, *[x[:k] for x in rest]])
    return out


def neighbours(vectors: DataFrame, holes: DataFrame, k: int = 10, same_par: bool = False, exclude_same_course: bool = False, max_length_diff_m: float | None = None, max_length_diff_pct: float | None = None, only: str | None = None, blocks: int = 8) -> DataFrame:
    """(query_hole_id, similar_hole_id, distance, rank) of each hole's k nearest others, ties by id; a distance of
    unknown vectors is null and comes last.

    holes has hole_id, course_slug, par and hole_length_m as far as the filters need them. Holes are dealt to blocks on
    both sides, within equal par if that is asked; each pair of blocks gives about k rows a query.
    """
    have = [c for c in ("course_slug", "par", "hole_length_m") if c in holes.columns]
    side = vectors.join(holes.select("hole_id", *have), "hole_id")
    guarded = "hole_length_m" in have and (max_length_diff_m is not None or max_length_diff_pct is not None)
    use = ["hole_id", F.col("v").cast("array<double>").alias("v"), *(["par"] if same_par else []), *(["course_slug"] if exclude_same_course else []), *([F.col("hole_length_m").cast("double").alias("hole_length_m")] if guarded else [])]
    limit = [length_limit(F.col("hole_length_m"), max_length_diff_m, max_length_diff_pct).cast("double").alias("limit")] if guarded else []
    q, c = side.select(*use, *limit), side.select(*use)
    if only is not None:
        q = q.filter(F.col("hole_id") == only)
    kind = vectors.schema["hole_id"].dataType.simpleString()
    near = tiles.paired(q, c, ["par"] if same_par else [], "hole_id", _nearest(k, exclude_same_course, guarded), f"query_hole_id {kind}, similar_hole_id {kind}, distance double", blocks)
    near = near.withColumn("distance", F.round("distance", 9))
    rank = F.row_number().over(Window.partitionBy("query_hole_id").orderBy(F.asc_nulls_last("distance"), "similar_hole_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k)


def mode_neighbours(features: DataFrame, name: str, k: int = 10, exclude_same_course: bool | None = None) -> DataFrame:
    mode = mode_named(name)
    columns, _ = mode_columns(features, name)
    cross = mode.exclude_same_course if exclude_same_course is None else exclude_same_course
    out = neighbours(matrix(features, columns, mode.weights), features, k, mode.same_par, cross, mode.max_length_diff_m, mode.max_length_diff_pct)
    return out.withColumn("similarity_mode", F.lit(name))


def similar_holes(features: DataFrame, hole_id: object, name: str = "v1", k: int = 10) -> DataFrame:
    """Neighbours of one hole; KeyError if it isn't there."""
    if not features.filter(F.col("hole_id") == hole_id).limit(1).count():
        raise KeyError(f"no hole {hole_id!r}")
    mode, (columns, _) = mode_named(name), mode_columns(features, name)
    return neighbours(matrix(features, columns, mode.weights), features, k, mode.same_par, mode.exclude_same_course, mode.max_length_diff_m, mode.max_length_diff_pct, only=hole_id)


def with_pair_columns(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """pairs with both holes' lengths (2 places), their difference, same_par and same_course (unknown: false)."""
    def side(p: str) -> DataFrame:
        return features.select(F.col("hole_id").alias(f"{p}_hole_id"), F.col("par").alias(f"{p}_par"), F.col("course_slug").alias(f"{p}_course_slug"), F.round("hole_length_m", 2).alias(f"{p}_length_m"))

    out = pairs.join(side("query"), "query_hole_id", "left").join(side("similar"), "similar_hole_id", "left")
    out = out.withColumn("length_diff_m", F.round(F.abs(F.col("query_length_m") - F.col("similar_length_m")), 2))
    same = lambda c: F.coalesce(F.col(f"query_{c}") == F.col(f"similar_{c}"), F.lit(False)).alias(f"same_{'par' if c == 'par' else 'course'}")
    return out.select(*pairs.columns, "query_length_m", "similar_length_m", "length_diff_m", same("par"), same("course_slug"))


def compare(features: DataFrame, query: object, match: object, columns: list[str]) -> DataFrame:
    """(feature, query_value, match_value, difference) of two holes, difference to 3 places."""
    def one(hole: object, name: str) -> DataFrame:
        return features.filter(F.col("hole_id") == hole).select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "feature", name)

    both = one(query, "query_value").join(one(match, "match_value"), "feature")
    return both.withColumn("difference", F.round(F.col("match_value") - F.col("query_value"), 3))
