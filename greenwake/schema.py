"""Schemas and the semantic dictionary of the terrain engine."""

from __future__ import annotations

from pyspark.sql import types as T

# Label ids (append only), priorities (lower wins) and the layers' labels.
LABEL_IDS = {
    "unknown": 0, "tee": 1, "green": 2, "fairway": 3, "rough_osm": 4, "bunker": 5, "water": 6, "trees": 7,
    "cartpath": 8, "sand": 9, "rough_inferred": 10,
}
LABEL_PRIORITY = {
    "green": 1, "tee": 2, "bunker": 3, "water": 4, "fairway": 5, "cartpath": 6, "sand": 7, "trees": 8,
    "rough_osm": 9, "rough_inferred": 10, "unknown": 11,
}
LAYER_TO_LABEL = {
    "tees": "tee", "greens": "green", "fairways": "fairway", "bunkers": "bunker", "sand": "sand",
    "rough_osm": "rough_osm", "water": "water", "trees": "trees", "cartpaths": "cartpath",
}
HOLE_OWNED_LAYERS = ("tees", "greens", "fairways", "bunkers", "sand", "rough_osm")
SHARED_LAYERS = ("water", "trees", "cartpaths")
LAYERS = HOLE_OWNED_LAYERS + SHARED_LAYERS
# The order in which a feature's tags are tried, and the tags of each layer (None: any value).
LAYER_RESOLUTION_ORDER = ("greens", "tees", "bunkers", "water", "fairways", "cartpaths", "sand", "trees", "rough_osm")
LAYER_TAGS: dict[str, list[tuple[str, str | None]]] = {
    "tees": [("golf", "tee")],
    "greens": [("golf", "green")],
    "fairways": [("golf", "fairway")],
    "rough_osm": [("golf", "rough")],
    "bunkers": [("golf", "bunker")],
    "water": [("golf", "water_hazard"), ("golf", "lateral_water_hazard"), ("natural", "water"), ("water", None)],
    "trees": [("natural", "wood"), ("landuse", "forest"), ("natural", "tree_row"), ("natural", "tree")],
    "cartpaths": [("golf", "cartpath"), ("highway", "path"), ("highway", "service"), ("highway", "track")],
    "sand": [("natural", "sand")],
}
SURFACES = ("fairway", "green", "bunker", "water", "tee")
METERS_TO_YARDS = 1.09361
SCHEMA_VERSION = "1.0.0"
ID_COLUMNS = ("hole_id", "course_slug", "course_name", "hole_number")

HOLE_POINTS = T.StructType(
    [T.StructField("hole_id", T.StringType()), T.StructField("point_id", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in ("x_abs_m", "y_abs_m", "z_abs_m", "x_rel_m", "y_rel_m", "z_rel_m", "x_aligned_m", "y_aligned_m")]
    + [T.StructField("label", T.StringType()), T.StructField("label_id", T.IntegerType()), T.StructField("source", T.StringType()), T.StructField("confidence", T.DoubleType())]
)
POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
LINE = T.ArrayType(POINT)
COURSE_CONFIG = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("course_slug", "course_name", "city", "state", "country", "dem_type", "osm_relation_id")]
    + [T.StructField(c, T.DoubleType()) for c in ("latitude", "longitude", "hole_buffer_meters", "search_radius_m")]
    + [T.StructField("expected_holes", T.IntegerType())]
)
SURFACE_METADATA = T.StructType(
    [T.StructField("hole_id", T.StringType()), T.StructField("course_slug", T.StringType()), T.StructField("hole_number", T.IntegerType()), T.StructField("par", T.IntegerType()), T.StructField("yards", T.DoubleType())]
    + [T.StructField(f"has_{s}", T.BooleanType()) for s in ("tee", "green", "fairway", "bunker", "water")]
    + [T.StructField("course_name", T.StringType()), T.StructField("tee_elevation_m", T.DoubleType()), T.StructField("green_elevation_m", T.DoubleType())]
)
SURFACE_POINTS = T.StructType(
    [T.StructField("hole_id", T.StringType()), T.StructField("surface", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ("x_lateral_m", "y_down_hole_m", "z_relative_m", "point_weight")]
)
COMPACT = T.StructType(
    [T.StructField("schema_version", T.StringType()), T.StructField("hole_id", T.StringType()), T.StructField("course_slug", T.StringType()), T.StructField("hole_number", T.IntegerType()), T.StructField("label_map", T.MapType(T.StringType(), T.StringType())), T.StructField("points", T.ArrayType(T.ArrayType(T.DoubleType())))]
)
