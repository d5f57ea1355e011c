"""Plausibility of similar-hole pairs: flags, score, reasons and the presented table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Columns compared, thresholds and penalties.
WATER = ("water_pct", "drive_zone_water_pct", "approach_zone_water_pct", "green_complex_water_pct")
HAZARD = ("bunker_pct", "water_pct", "trees_pct")
GEOMETRY = ("hole_width_m", "hole_depth_m", "green_y_m", "dogleg_score", "fairway_centerline_shift")
LIMITS = {"length_m": 55.0, "length_pct": 0.15, "water": 0.08, "hazard": 0.12, "geometry": 0.45}
PENALTIES = {
    "par_mismatch": 0.40, "length_mismatch": 0.30, "same_course_violation": 0.20, "water_mismatch": 0.15,
    "hazard_mismatch": 0.15, "geometry_mismatch": 0.15,
}
MIN_SCORE, MATCHES = 0.75, 10


def _differences(columns: list[str], relative: bool = False) -> Column:
    """array of the columns' absolute (or symmetric relative) differences that both sides know."""
    out = []
    for c in columns:
        q, s = F.col(f"q.{c}").cast("double"), F.col(f"c.{c}").cast("double")
        gap, size = F.abs(q - s), F.abs(q) + F.abs(s)
        out.append(F.when(size < 1e-9, F.lit(0.0)).otherwise(gap / F.nullif(size, F.lit(0.0))) if relative else gap)
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<double>")


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(values), F.lit(0)).cast("double")


def flags(pairs: DataFrame, features: DataFrame, exclude_same_course: bool = True) -> DataFrame:
    """pairs(query_hole_id, similar_hole_id, ...) with differences, flags, count of bad flags, score and reasons.

    A pair with a hole that features doesn't have gets par and length as bad flags, and score 0.
    """
    have = set(features.columns)
    q, c = features.alias("q"), features.alias("c")
    joined = pairs.alias("p").join(q, F.col("p.query_hole_id") == F.col("q.hole_id"), "left").join(c, F.col("p.similar_hole_id") == F.col("c.hole_id"), "left")
    lost = F.col("q.hole_id").isNull() | F.col("c.hole_id").isNull()
    no = F.lit(False)
    same_par = F.coalesce(F.col("q.par") == F.col("c.par"), no)
    same_course = F.coalesce(F.col("q.course_slug") == F.col("c.course_slug"), no)
    gap = F.abs(F.col("q.hole_length_m") - F.col("c.hole_length_m"))
    part = gap / F.nullif(F.col("q.hole_length_m"), F.lit(0.0))
    water = F.array_max(_differences([x for x in WATER if x in have]))
    hazard = _mean(_differences([x for x in HAZARD if x in have]))
    shape = _mean(_differences([x for x in GEOMETRY if x in have], relative=True))
    out = joined.select(
        "p.*", F.col("q.course_slug").alias("query_course_slug"), F.col("c.course_slug").alias("similar_course_slug"),
        F.col("q.hole_length_m").alias("query_length_m"), F.col("c.hole_length_m").alias("similar_length_m"),
        F.round(gap, 2).alias("length_diff_m"), F.round(part, 4).alias("length_diff_pct"),
        same_par.alias("same_par"), same_course.alias("same_course"), (lost | ~same_par).alias("par_mismatch"),
        (lost | F.coalesce(gap > LIMITS["length_m"], no) | F.coalesce(part > LIMITS["length_pct"], no)).alias("length_mismatch"),
        F.coalesce(water > LIMITS["water"], no).alias("water_mismatch"), F.coalesce(hazard > LIMITS["hazard"], no).alias("hazard_mismatch"),
        F.coalesce(shape > LIMITS["geometry"], no).alias("geometry_mismatch"), F.round(water, 4).alias("water_diff"),
        F.round(hazard, 4).alias("hazard_diff"), F.round(shape, 4).alias("geometry_mismatch_score"),
        (same_course if exclude_same_course else no).alias("same_course_violation"), lost.alias("__lost"),
    )
    count = sum((F.col(f).cast("int") for f in PENALTIES), F.lit(0))
    score = F.round(1.0 - sum((F.when(F.col(f), p).otherwise(0.0) for f, p in PENALTIES.items()), F.lit(0.0)), 6)
    out = out.withColumn("presentable_bad_flag_count", count)
    out = out.withColumn("plausibility_score", F.when(F.col("__lost"), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))))
    return out.withColumn("plausibility_reasons", reasons()).drop("__lost")


def reasons() -> Column:
    """The bad flags in words, in a fixed order; `ok` if there are none."""
    length = F.coalesce(F.concat(F.lit("length diff "), F.format_string("%.1f", "length_diff_m"), F.lit("m")), F.lit("length mismatch"))
    text = F.concat_ws(
        "; ", F.when(F.col("same_course_violation"), "same course"), F.when(F.col("par_mismatch"), "different par"), F.when(F.col("length_mismatch"), length),
        F.when(F.col("water_mismatch"), "water profile mismatch"), F.when(F.col("hazard_mismatch"), "hazard profile mismatch"), F.when(F.col("geometry_mismatch"), "geometry mismatch"),
    )
    return F.when(text == "", "ok").otherwise(text)


def presentable(min_score: float = MIN_SCORE, same_par: bool = True, cross_course: bool = True, max_bad_flags: int | None = None) -> Column:
    ok = F.col("plausibility_score") >= min_score
    if same_par:
        ok = ok & F.col("same_par")
    if cross_course:
        ok = ok & ~F.col("same_course")
    return ok if max_bad_flags is None else ok & (F.col("presentable_bad_flag_count") <= max_bad_flags)


def presented(pairs: DataFrame, features: DataFrame, n: int = MATCHES, min_score: float = MIN_SCORE, allow_same_course: bool = False, allow_different_par: bool = False) -> DataFrame:
    """Each query's n most plausible pairs, then the nearest; rank and distance become raw_rank and raw_distance."""
    judged = flags(pairs, features, not allow_same_course).withColumn("is_presentable", presentable(min_score, not allow_different_par, not allow_same_course))
    kept = judged.filter("is_presentable").withColumnsRenamed({"rank": "raw_rank", "distance": "raw_distance"})
    order = Window.partitionBy("query_hole_id").orderBy(F.desc("plausibility_score"), "raw_distance", "similar_hole_id")
    return kept.withColumn("presented_rank", F.row_number().over(order)).filter(F.col("presented_rank") <= n)
