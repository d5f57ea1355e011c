"""Readers of map features, elevation cells, point clouds, surfaces and batch results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from greenwake.functions.stats import known
from greenwake.schema import COMPACT, HOLE_POINTS, LABEL_IDS, SURFACE_METADATA, SURFACES

TAGS = ("golf", "leisure", "natural", "water", "landuse", "highway", "ref", "name", "par", "handicap", "id", "element")


def read_geojson(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row a feature of FeatureCollections: tags as text, parts as array of lines, the file's layer name.

    Files that can't be parsed, and empty collections, give no rows. course_slug is the folder that holds the file, or
    the one above it if that is called `source`.
    """
    schema = "features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>"
    raw = spark.read.text(paths, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.*json").select(F.from_json("value", schema).alias("j"), F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.(geo)?json$", 1).alias("layer"), F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/(?:source/)?[^/]+$", 1).alias("course_slug"))
    rows = raw.select("layer", "course_slug", F.explode("j.features").alias("f")).select("layer", "course_slug", "f.properties", F.col("f.geometry.type").alias("geom_type"), F.col("f.geometry.coordinates").alias("c"))
    return rows.select("layer", "geom_type", _parts(F.col("geom_type"), F.col("c")).alias("parts"), *[F.col("properties").getItem(t).alias(t) for t in TAGS], "course_slug")


def _parts(kind: Column, text: Column) -> Column:
    """array<line> of GeoJSON coordinates; of polygons the outer rings."""
    pt = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    line = lambda a: F.transform(a, pt)
    parsed = lambda t: F.from_json(text, t)
    return (
        F.when(kind == "Point", F.array(F.array(pt(parsed("array<double>")))))
        .when(kind == "LineString", F.array(line(parsed("array<array<double>>"))))
        .when(kind == "MultiLineString", F.transform(parsed("array<array<array<double>>>"), line))
        .when(kind == "Polygon", F.array(line(F.get(parsed("array<array<array<double>>>"), 0))))
        .when(kind == "MultiPolygon", F.transform(parsed("array<array<array<array<double>>>>"), lambda p: line(p[0])))
    )


def read_cells(spark: SparkSession, path: str, nodata: float | None = None) -> DataFrame:
    """Elevation cells (course_slug, row, col, z); the no-data value and non-finite ones become null."""
    cells = spark.read.parquet(path)
    z = known(F.col("z").cast("double"))
    return cells.withColumn("z", z if nodata is None else F.when(z == nodata, None).otherwise(z))


def tiff_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, is_tiff) of raster files, by their first bytes; only those bytes are needed."""
    magic = F.substring("content", 1, 2)
    return spark.read.format("binaryFile").load(path).select("path", "length", magic.isin(F.lit(b"II"), F.lit(b"MM")).alias("is_tiff"))


def read_points(spark: SparkSession, path: str, columns: tuple[str, ...] = ("x_aligned_m", "y_aligned_m", "z_rel_m", "label")) -> DataFrame:
    """Labelled points with the columns asked for; only those are read."""
    have = {f.name for f in HOLE_POINTS}
    if unknown := set(columns) - have:
        raise ValueError(f"not point columns: {sorted(unknown)}")
    return spark.read.parquet(path).select("hole_id", *columns)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The hole index; ValueError if it has no rows (a missing path is Spark's own error)."""
    df = spark.read.parquet(path)
    if not df.limit(1).count():
        raise ValueError(f"{path} holds no holes")
    return df


def compact_points(compact: DataFrame) -> DataFrame:
    """(hole_id, x, y, z, label_id, label) of compact clouds; labels by the file's map, then the global one."""
    names = F.create_map(*[F.lit(v) for name, i in LABEL_IDS.items() for v in (str(i), name)])
    p = compact.select("hole_id", "label_map", F.explode("points").alias("p")).withColumn("label_id", F.col("p")[3].cast("int"))
    key = F.col("label_id").cast("string")
    label = F.coalesce(F.try_element_at("label_map", key), F.try_element_at(names, key), F.lit("unknown"))
    return p.select("hole_id", *[F.col("p")[i].alias(c) for i, c in enumerate("xyz")], "label_id", label.alias("label"))


def read_compact(spark: SparkSession, path: str) -> DataFrame:
    return compact_points(spark.read.schema(COMPACT).json(path, multiLine=True))


def surface_points(points: DataFrame) -> DataFrame:
    """The points on scored surfaces, in the surface schema."""
    return points.filter(F.col("label").isin(*SURFACES)).select("hole_id", F.col("label").alias("surface"), F.col("x").alias("x_lateral_m"), F.col("y").alias("y_down_hole_m"), F.col("z").alias("z_relative_m"), F.lit(1.0).alias("point_weight"))


def surface_metadata(holes: DataFrame, points: DataFrame, tee_z: Column | None = None) -> DataFrame:
    """Hole metadata with has_<surface> from the points, and elevations from the tee's and the tee-to-green change."""
    has = points.groupBy("hole_id").agg(*[F.bool_or(F.col("surface") == s).alias(f"has_{s}") for s in SURFACES])
    out = holes.join(has, "hole_id", "left").withColumns({f"has_{s}": F.coalesce(f"has_{s}", F.lit(False)) for s in SURFACES})
    return out if tee_z is None else out.withColumn("tee_elevation_m", tee_z).withColumn("green_elevation_m", tee_z + F.col("tee_to_green_elevation_change"))


def read_surfaces(spark: SparkSession, metadata: str, points: str) -> tuple[DataFrame, DataFrame]:
    """(metadata, points) of a surface artifact, Parquet or CSV by extension; weights default to 1, has_* to what
    the points show. ValueError names missing columns."""
    def read(path: str) -> DataFrame:
        return spark.read.csv(path, header=True, inferSchema=True) if path.rstrip("/").endswith(".csv") else spark.read.parquet(path)

    meta, pts = read(metadata), read(points)
    for df, need in ((meta, ("hole_id", "course_slug", "hole_number", "par", "yards")), (pts, ("hole_id", "surface", "x_lateral_m", "y_down_hole_m", "z_relative_m"))):
        if lost := [c for c in need if c not in df.columns]:
            raise ValueError(f"missing columns: {lost}")
    pts = pts.withColumn("point_weight", F.coalesce("point_weight", F.lit(1.0)) if "point_weight" in pts.columns else F.lit(1.0))
    seen = surface_metadata(meta.select("hole_id"), pts)
    explicit = [c for c in SURFACE_METADATA.fieldNames() if c.startswith("has_") and c in meta.columns]
    meta = meta.withColumnsRenamed({c: f"__{c}" for c in explicit}).join(seen, "hole_id")
    meta = meta.withColumns({c: F.coalesce(f"__{c}", c) for c in explicit}).drop(*[f"__{c}" for c in explicit])
    return meta, pts


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_manifests(spark: SparkSession, pattern: str, schema: T.StructType | str) -> DataFrame:
    """Course manifests, one JSON document each; unreadable ones are left out."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(pattern)


def read_batches(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Batch results of several configurations, config_name being the folder's; folders of reports are left out."""
    df = spark.read.csv(roots, header=True, inferSchema=True, recursiveFileLookup=True, pathGlobFilter="*.csv")
    name = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+(?:/part-[^/]*)?$", 1)
    return df.select("*", name.alias("__dir")).filter("__dir != '_validation'").withColumn("config_name", F.coalesce("config_name", "__dir") if "config_name" in df.columns else F.col("__dir")).drop("__dir")
