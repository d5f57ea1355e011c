"""Hole features over labelled points (hole_id, x, y, z, label): as aggregates, and all of a hole at once (`packed`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from greenwake.functions.stats import exact_mean, known, share
from greenwake.operators import packed
from greenwake.schema import LABEL_IDS

# The labels and zones that features are named after, in metres along the hole.
ZONE_LABELS = ("fairway", "rough", "trees", "bunker", "water", "sand", "cartpath")
PRESSURE_LABELS = ("trees", "bunker", "water")
ROUGH = ("rough_osm", "rough_inferred")
TEE_ZONE, DRIVE_ZONE, APPROACH_DEPTH, GREEN_DEPTH = (0.0, 75.0), (175.0, 300.0), 175.0, 75.0
MIN_GREEN, MIN_FAIRWAY, BINS, MIN_BIN = 3, 20, 12, 5


def _is(label: str) -> Column:
    return F.col("label").isin(*ROUGH) if label == "rough" else F.col("label") == label


def clean_points(points: DataFrame) -> DataFrame:
    return points.select("hole_id", *[known(F.col(c).cast("double")).alias(c) for c in "xyz"], "label")


def green_y(points: DataFrame) -> DataFrame:
    """(hole_id, green_y_m): mean y of the green's points if there are three, else the 98th percentile of y."""
    green = F.col("label") == "green"
    return points.groupBy("hole_id").agg(F.when(F.count(F.when(green, 1)) >= MIN_GREEN, exact_mean(F.when(green, F.col("y")))).otherwise(F.percentile("y", 0.98)).alias("green_y_m"))


def _zones() -> dict[str, Column]:
    y, g = F.col("y"), F.col("green_y_m")
    return {
        "tee_zone": (y >= TEE_ZONE[0]) & (y < TEE_ZONE[1]),
        "drive_zone": (y >= DRIVE_ZONE[0]) & (y < DRIVE_ZONE[1]),
        "approach_zone": (y >= F.greatest(F.lit(0.0), g - APPROACH_DEPTH)) & (y < g),
        "green_complex": (y >= F.greatest(F.lit(0.0), g - GREEN_DEPTH)) & (y < g),
    }


def geometry() -> list[Column]:
    whole = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
    return [
        F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"),
        (F.max("x") - F.min("x")).alias("hole_width_m"), (F.max("y") - F.min("y")).alias("hole_depth_m"),
        F.count(F.lit(1)).alias("point_count"), F.count(F.when(whole, 1)).alias("valid_point_count"),
    ]


def elevation() -> list[Column]:
    tenths = F.percentile("z", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return [
        F.min("z").alias("z_min"), F.max("z").alias("z_max"), exact_mean(F.col("z")).alias("z_mean"), F.stddev_pop("z").alias("z_std"),
        (F.max("z") - F.min("z")).alias("z_range"), *[tenths[i].alias(f"z_p{p}") for i, p in enumerate((10, 50, 90))],
        exact_mean(F.when(F.col("label") == "green", F.col("z"))).alias("green_relative_elevation"),
    ]


def labels() -> list[Column]:
    return [share(_is(name)).alias(f"{name}_pct") for name in LABEL_IDS] + [share(_is("rough")).alias("rough_pct")]


def zones() -> list[Column]:
    out = []
    for name, inside in _zones().items():
        z = F.when(inside, F.col("z"))
        out += [share(_is(label), inside).alias(f"{name}_{label}_pct") for label in ZONE_LABELS]
        out += [exact_mean(z).alias(f"{name}_mean_z"), (F.max(z) - F.min(z)).alias(f"{name}_z_range")]
    return out


def pressure() -> list[Column]:
    zone = _zones()
    sides = {"left": F.col("x") < 0, "right": F.col("x") > 0}
    return [share(_is(h) & on, zone[f"{z}_zone"]).alias(f"{z}_{h}_{side}_pct") for z in ("drive", "approach") for h in PRESSURE_LABELS for side, on in sides.items()]


def shape() -> list[Column]:
    """Fairway widths (five points at least) and the shift of its centre from the drive to the approach zone."""
    zone, out, centre = _zones(), [], {}
    for name in ("drive_zone", "approach_zone"):
        x = F.when(_is("fairway") & zone[name], F.col("x"))
        ends = F.percentile(x, F.array(F.lit(0.05), F.lit(0.95)))
        out.append(F.when(F.count(x) >= 5, ends[1] - ends[0]).alias(f"fairway_width_{name}"))
        centre[name] = exact_mean(x)
    return [*out, (centre["approach_zone"] - centre["drive_zone"]).alias("fairway_centerline_shift")]


def dogleg(points_with_green: DataFrame) -> DataFrame:
    """(hole_id, dogleg_score): the fairway centre's largest offset over 12 bins of y, by the green's distance."""
    fairway = points_with_green.filter((F.col("label") == "fairway") & (F.col("green_y_m") > 0))
    along = (F.col("y") >= 0) & (F.col("y") < F.col("green_y_m"))
    bin_ = F.when(along, F.least(F.lit(BINS - 1), F.floor(F.col("y") / (F.col("green_y_m") / BINS)))).otherwise(-1)
    centres = fairway.groupBy("hole_id", "green_y_m", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), exact_mean(F.col("x")).alias("cx"))
    far = F.max(F.when((F.col("bin") >= 0) & (F.col("n") >= MIN_BIN), F.abs("cx")))
    scored = centres.groupBy("hole_id", "green_y_m").agg(F.sum("n").alias("n"), far.alias("far")).filter((F.col("n") >= MIN_FAIRWAY) & F.col("far").isNotNull())
    return scored.select("hole_id", (F.col("far") / F.col("green_y_m")).alias("dogleg_score"))


def with_green(points: DataFrame) -> DataFrame:
    return points.join(green_y(points), "hole_id")


def aggregate(points: DataFrame, *columns: Column) -> DataFrame:
    return points.groupBy("hole_id").agg(*columns)


#: What hole_features takes from the points.
FEATURES = [
    "green_y_m", *[f"{c}_{end}" for c in "xyz" for end in ("min", "max")], "hole_width_m", "hole_depth_m", "point_count", "valid_point_count",
    "z_mean", "z_std", "z_range", "z_p10", "z_p50", "z_p90", "green_relative_elevation", *[f"{name}_pct" for name in (*LABEL_IDS, "rough")],
    *[f"{zone}_{what}" for zone in ("tee_zone", "drive_zone", "approach_zone", "green_complex") for what in (*[f"{name}_pct" for name in ZONE_LABELS], "mean_z", "z_range")],
    *[f"{zone}_{name}_{side}_pct" for zone in ("drive", "approach") for name in PRESSURE_LABELS for side in ("left", "right")],
    "fairway_width_drive_zone", "fairway_width_approach_zone", "fairway_centerline_shift", "dogleg_score",
]


def hole_features(points: DataFrame, holes: DataFrame | None = None) -> DataFrame:
    """One row a hole with points: identifiers of `holes`, green_y_m, then the features sorted by name.

    holes may carry net_elevation_change_m, which is preferred as tee_to_green_elevation_change. The points are read and
    shuffled once, packed; the features are those of the aggregates above.
    """
    wide = packed.wide(clean_points(points), FEATURES)
    ids = ["hole_id"]
    if holes is not None:
        wide = holes.join(wide, "hole_id")
        ids = list(holes.columns)
    net = F.col("net_elevation_change_m") if holes is not None and "net_elevation_change_m" in holes.columns else F.lit(None).cast("double")
    wide = wide.withColumn("tee_to_green_elevation_change", F.coalesce(known(net), "green_relative_elevation"))
    first = [c for c in ids if c != "net_elevation_change_m"] + ["green_y_m"]
    return wide.select(*first, *sorted(c for c in wide.columns if c not in first and c != "net_elevation_change_m"))
