"""Writers, the SQL catalog and driver-side documents."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The index's first columns, in order.
INDEX_COLUMNS = (
    "hole_id", "course_slug", "course_name", "hole_number", "par", "handicap", "hole_length_m", "hole_length_yd",
    "tee_elevation_m", "green_elevation_m", "net_elevation_change_m", "point_count", "quality_flags",
)


def flat(df: DataFrame) -> DataFrame:
    """df with text cells only: null as "", booleans in lower case, lists of text joined by `;`, the rest as JSON."""
    out = []
    for f in df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            c = F.array_join(c, ";")
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        elif isinstance(f.dataType, T.BooleanType):
            c = F.lower(c.cast("string"))
        out.append(F.coalesce(c.cast("string"), F.lit("")).alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """A CSV with header; refuses an existing path unless told to overwrite."""
    flat(df).write.mode("overwrite" if overwrite else "errorifexists").csv(path, header=True, emptyValue="", nullValue="")


def write_points(points: DataFrame, path: str) -> None:
    """Points partitioned by course and sorted by hole, so that both prune."""
    points.repartition("course_slug").sortWithinPartitions("course_slug", "hole_id").write.mode("overwrite").partitionBy("course_slug").parquet(path)


def concat(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames over the union of their columns."""
    if not frames:
        raise ValueError("nothing to concatenate")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def index_order(df: DataFrame) -> DataFrame:
    """df with the index's preferred columns first and the others after."""
    first = [c for c in INDEX_COLUMNS if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def geojson(features: DataFrame) -> DataFrame:
    """One row `value`: a FeatureCollection a layer (layer, parts, tags); lists in tags are joined by `;`."""
    tags = [c for c in flat(features.drop("parts")).columns if c not in ("layer", "geom_type")]
    row = flat(features.drop("parts")).columns
    shaped = features.select("layer", F.to_json(F.struct(F.lit("Feature").alias("type"), F.map_from_arrays(F.array(*map(F.lit, tags)), F.array(*[F.col(t).cast("string") for t in tags])).alias("properties"), F.struct(F.lit("MultiLineString").alias("type"), F.transform("parts", lambda p: F.transform(p, lambda v: F.array(v["x"], v["y"]))).alias("coordinates")).alias("geometry"))).alias("f")) if row else features
    return shaped.groupBy("layer").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.sort_array(F.collect_list("f")), ","), F.lit("]}")).alias("value"))


# The columns of the terrain view, in order.
TERRAIN_STATS = (
    "hole_id", "tee_elevation_m", "green_elevation_m", "net_elevation_change_m", "min_elevation_m", "max_elevation_m", "mean_elevation_m",
    "avg_slope_deg", "max_slope_deg", "avg_slope_percent", "max_slope_percent",
)


def register_catalog(spark: SparkSession, holes: DataFrame, points: DataFrame) -> None:
    """Temporary views `holes`, `hole_terrain_stats` (a column that holes lack is null) and `hole_points`."""
    holes.createOrReplaceTempView("holes")
    points.createOrReplaceTempView("hole_points")
    holes.select(*[F.col(c) if c in holes.columns else F.lit(None).cast("double").alias(c) for c in TERRAIN_STATS]).createOrReplaceTempView("hole_terrain_stats")


def write_document(spark: SparkSession, document: dict, path: str, overwrite: bool = False) -> None:
    """A small JSON document (a manifest) as a one-row text table."""
    spark.createDataFrame([(json.dumps(document, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").text(path)
