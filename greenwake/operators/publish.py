"""Index, curation, feature dictionary, inventories and the views' data."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from greenwake.schema import LABEL_PRIORITY

# Names and endings of files that are never published, and the largest file that is hashed.
SECRET_NAMES = ("credentials.json", "service_account.json", "id_rsa", "id_ed25519", ".netrc", ".npmrc", ".pypirc", "secrets.toml")
SECRET_ENDINGS = (".pem", ".key", ".p12", ".pfx", ".jks")
HASH_LIMIT = 50 * 1024 * 1024


def aggregate_index(manifests: DataFrame, summaries: DataFrame) -> DataFrame:
    """Holes of processed courses: a course's own columns win over the summaries'."""
    done = manifests.filter("status = 'processed'")
    over = [c for c in done.columns if c != "course_slug"]
    return done.join(summaries.drop(*over), "course_slug").withColumn("hole_id", F.format_string("%s__%02d", "course_slug", F.col("hole_number").cast("int")))


def course_rollup(holes: DataFrame) -> DataFrame:
    """Length, yards and par of a course (unknown ones left out) and its holes in order."""
    row = F.struct("hole_number", "hole_id")
    return holes.groupBy("course_slug").agg(F.count(F.lit(1)).alias("holes"), F.sum("hole_length_m").alias("length_m"), F.sum("hole_length_yd").alias("length_yd"), F.sum("par").alias("par"), F.transform(F.sort_array(F.collect_list(row)), lambda x: x["hole_id"]).alias("hole_ids"))


def dataset_counts(holes: DataFrame) -> DataFrame:
    points = F.sum("point_count") if "point_count" in holes.columns else F.lit(None).cast("long")
    return holes.agg(F.count_distinct("course_slug").alias("courses"), F.count_distinct("hole_id").alias("holes"), F.count(F.lit(1)).alias("rows"), points.alias("points"))


def curated(features: DataFrame, anchor: object | None = None, neighbours: DataFrame | None = None, n: int = 4) -> DataFrame:
    """(hole_id, priority): the anchor (else the first hole), its n nearest, the shortest par 3, the wettest and the
    hilliest, each once at its first place."""
    have = features.select("hole_id")
    first = features.agg(F.min("hole_id").alias("low"), F.max(F.when(F.col("hole_id") == anchor, F.col("hole_id")) if anchor is not None else F.lit(None)).alias("own"))
    first = first.select(F.coalesce(F.col("own").cast(features.schema["hole_id"].dataType), "low").alias("hole_id"), F.lit(0).alias("priority")).filter("hole_id is not null")
    picks = [first]
    if neighbours is not None:
        picks.append(neighbours.join(F.broadcast(first.select(F.col("hole_id").alias("query_hole_id"))), "query_hole_id").filter(F.col("rank") <= n).select(F.col("similar_hole_id").alias("hole_id"), F.col("rank").cast("int").alias("priority")))

    def pick(rows: DataFrame, by: Column, priority: int) -> DataFrame:
        return rows.filter(by.isNotNull()).agg(F.min_by("hole_id", F.struct(by, F.col("hole_id"))).alias("hole_id")).filter("hole_id is not null").withColumn("priority", F.lit(priority))

    if {"par", "hole_length_m"} <= {*features.columns}:
        picks.append(pick(features.filter("par = 3"), F.col("hole_length_m"), 100))
    picks += [pick(features, -F.col(c), 101 + i) for i, c in enumerate(("water_pct", "z_range")) if c in features.columns]
    out = picks[0]
    for p in picks[1:]:
        out = out.unionByName(p)
    return out.groupBy("hole_id").agg(F.min("priority").alias("priority")).join(have, "hole_id", "left_semi")


_ZONE = "(tee_zone|drive_zone|approach_zone|green_complex)"
GROUPS = (
    ("identifier", r"hole_id|course_slug|course_name|hole_number|par|handicap|hole_length_(m|yd)", ""),
    ("strategic_shape", r"dogleg_score", "score"),
    ("strategic_shape", r"fairway_centerline_shift|fairway_width_(drive|approach)_zone", "m"),
    ("left_right_pressure", r"(drive|approach)_(trees|bunker|water)_(left|right)_pct", "fraction[0,1]"),
    ("zone_composition", _ZONE + r"_(fairway|rough|trees|bunker|water|sand|cartpath)_pct", "fraction[0,1]"),
    ("zone_elevation", _ZONE + r"_(mean_z|z_range)", "m"),
    ("elevation", r"z_(min|max|mean|std|range|p10|p50|p90)|green_relative_elevation|tee_to_green_elevation_change", "m"),
    ("geometry", r"(valid_)?point_count", "count"),
    ("geometry", r"[xy]_(min|max)|hole_(width|depth)_m|green_y_m", "m"),
    ("label_composition", r"[a-z_]+_pct", "fraction[0,1]"),
    ("other", r".*", ""),
)


def feature_dictionary(features: DataFrame) -> DataFrame:
    """(column, group, unit, dtype) of every column, the first matching group counting; from the schema alone."""
    rows = []
    for f in features.schema:
        group, unit = next((g, u) for g, p, u in GROUPS if re.fullmatch(p, f.name))
        rows.append((f.name, group, unit, f.dataType.simpleString()))
    return features.sparkSession.createDataFrame(rows, "column string, group string, unit string, dtype string")


def is_secret(path: Column) -> Column:
    name = F.lower(F.regexp_extract(path, r"([^/]+)/?$", 1))
    return name.startswith(".env") | name.isin(*SECRET_NAMES) | name.rlike("(" + "|".join(re.escape(e) for e in SECRET_ENDINGS) + ")$")


def secret_name(name: str) -> bool:
    name = name.lower()
    return name.startswith(".env") or name in SECRET_NAMES or name.endswith(SECRET_ENDINGS)


def _names(spark: SparkSession, root: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    while found.hasNext():
        yield found.next().getPath().getName()


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """(path, section, bytes, sha256) of a tree's files; larger ones aren't hashed. RuntimeError if one looks secret."""
    if bad := [n for n in _names(spark, root) if secret_name(n)][:5]:  # the file source doesn't show hidden files
        raise RuntimeError(f"files that look like secrets: {bad}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relative = F.regexp_replace("path", r"^.*?" + re.escape(root.rstrip("/").rsplit("/", 1)[-1]) + "/", "")
    return files.select(relative.alias("path"), F.when(relative.contains("/"), F.split(relative, "/")[0]).otherwise("root").alias("section"), F.col("length").alias("bytes"), F.when(F.col("length") <= HASH_LIMIT, F.sha2("content", 256)).alias("sha256"))


def section_totals(files: DataFrame) -> DataFrame:
    return files.groupBy("section").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def human_bytes(n: Column) -> Column:
    """A size with one decimal in the largest unit that fits, bytes whole."""
    out = F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B")))
    for i, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(n < 1024 ** (i + 1), F.format_string(f"%.1f {unit}", n / float(1024**i)))
    return out.otherwise(F.format_string("%.1f TB", n / float(1024**4)))


def label_priority() -> list[str]:
    """Labels from the highest priority to the lowest."""
    return sorted(LABEL_PRIORITY, key=LABEL_PRIORITY.get)


def hole_label(slug: Column, number: Column, par: Column, yards: Column) -> Column:
    return F.concat_ws(" - ", F.format_string("%s #%d", slug, number.cast("int")), F.when(par.isNotNull(), F.format_string("par %d", par.cast("int"))), F.when(yards.isNotNull(), F.format_string("%d yd", F.round(yards).cast("int"))))


def view(pairs: DataFrame, features: DataFrame, query: object, n: int = 10, same_par: bool = False, exclude_same_course: bool = False) -> DataFrame:
    """A hole's matches with the other hole's columns, nearest first."""
    other = features.select(F.col("hole_id").alias("similar_hole_id"), *[F.col(c).alias(f"similar_{c}") for c in ("course_slug", "par", "hole_length_m") if c in features.columns])
    out = pairs.filter(F.col("query_hole_id") == query).join(other, "similar_hole_id", "left")
    own = features.filter(F.col("hole_id") == query).select(F.col("par").alias("q_par"), F.col("course_slug").alias("q_course"))
    out = out.join(F.broadcast(own))  # one row: the query hole
    if same_par:
        out = out.filter("similar_par = q_par")
    if exclude_same_course:
        out = out.filter("similar_course_slug != q_course")
    return out.drop("q_par", "q_course").orderBy("distance", "similar_hole_id").limit(n)


def plot_limits(points: DataFrame, pad: float = 0.05) -> DataFrame:
    """Shared axis limits of x and y, padded."""
    out = points.agg(*[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))])
    for c in "xy":
        span = (F.col(f"max_{c}") - F.col(f"min_{c}")) * pad
        out = out.withColumns({f"min_{c}": F.col(f"min_{c}") - span, f"max_{c}": F.col(f"max_{c}") + span})
    return out


def plot_sample(points: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n points drawn evenly at random; a sampling operator for plots."""
    return points.orderBy(F.rand(seed)).limit(n)


def slope_ceiling(cells: DataFrame) -> DataFrame:
    """The colour scale's top of a hole's slope plot: the 98th percentile, 1 at least."""
    return cells.groupBy("hole_id").agg(F.greatest(F.lit(1.0), F.percentile("slope_pct", 0.98)).alias("vmax"))


def course_order(holes: DataFrame) -> DataFrame:
    return holes.withColumn("place", F.row_number().over(Window.partitionBy("course_slug").orderBy("hole_number")))
