"""The course pipeline: map features and elevation rasters of many courses at once to holes, points and reports.

All courses go through one plan, keyed by course and hole; what fails is told a course or a hole in the issues, and
the others go on. Coordinates are the UTM zone's of the course's centre.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from greenwake.functions import geometry as G
from greenwake.operators import course, terrain
from greenwake.operators.exports import _exists
from greenwake.schema import LAYER_TO_LABEL, METERS_TO_YARDS, SCHEMA_VERSION
from greenwake.session import cut, drop_cut, partitions
from greenwake.sources import sinks

#: Metres of a degree of latitude, for the cell size of rasters in degrees.
DEGREE_M = 111_320.0
WGS84 = 4326


def project(features: DataFrame, courses: DataFrame) -> DataFrame:
    """features with parts in metres, and the columns of their course; features of other courses go."""
    own = courses.select("course_slug", "zone", "hole_buffer_meters", "expected_holes", F.col("cx"), F.col("cy"), "osm_relation_id")

    def metres(p: Column) -> Column:
        x, y = G.to_utm(p["x"], p["y"], F.col("zone"))
        return F.struct(x.alias("x"), y.alias("y"))

    out = features.join(own, "course_slug").withColumn("parts", F.transform("parts", lambda line: F.transform(line, metres)))
    return out.withColumn("feature_id", F.xxhash64("course_slug", "layer", "parts", "ref"))


def with_centres(courses: DataFrame) -> DataFrame:
    """Courses with their zone, SRID and centre in metres."""
    out = courses.withColumn("zone", G.utm_zone(F.col("longitude"))).withColumn("srid", G.utm_srid(F.col("longitude"), F.col("latitude")))
    cx, cy = G.to_utm(F.col("longitude"), F.col("latitude"), F.col("zone"))
    return out.withColumn("cx", cx).withColumn("cy", cy)


def boundaries(features: DataFrame) -> DataFrame:
    """The chosen boundary of each course: of its golf_course features the largest ring each."""
    some = features.filter("leisure = 'golf_course' and geom_type in ('Polygon', 'MultiPolygon')")
    ring = F.array_max(F.transform("parts", lambda r: F.struct(G.area(r).alias("s"), r.alias("ring"))))["ring"]
    return course.select_boundary(some.select("course_slug", "id", "element", ring.alias("ring"), "cx", "cy", "osm_relation_id"))


def raster_steps(rasters: DataFrame, courses: DataFrame) -> DataFrame:
    """Rasters of the courses that are in degrees or in the course's own zone, with their cell size in metres."""
    own = rasters.join(courses.select("course_slug", "zone", "srid", "latitude"), "course_slug")
    degrees = F.col("epsg") == WGS84
    size = F.when(degrees, (F.col("a") * F.cos(F.radians("latitude")) + F.abs("e")) / 2 * DEGREE_M).otherwise((F.col("a") + F.abs("e")) / 2)
    south = F.col("latitude") < 0
    return own.filter(degrees | (F.col("epsg") == F.col("srid"))).select("course_slug", "a", "c", "e", "f", "zone", south.alias("south"), degrees.alias("degrees"), size.alias("step"))


def elevations(points: DataFrame, keys: list[str], rasters: DataFrame, cells: DataFrame) -> DataFrame:
    """(*keys, z) of points (course_slug, *keys, x, y): bilinear over the four cells around, known if all four are.
    Points and cells meet by an equi-join on the cell."""
    at = points.join(rasters, "course_slug")
    lon, lat = G.from_utm(F.col("x"), F.col("y"), F.col("zone"), F.col("south"))
    sx, sy = F.when(F.col("degrees"), lon).otherwise(F.col("x")), F.when(F.col("degrees"), lat).otherwise(F.col("y"))
    at = at.withColumn("u", (sx - F.col("c")) / F.col("a") - 0.5).withColumn("v", (sy - F.col("f")) / F.col("e") - 0.5)
    du, dv = F.col("u") - F.floor("u"), F.col("v") - F.floor("v")
    corners = F.array(*[F.struct((F.floor("v") + j).cast("int").alias("row"), (F.floor("u") + i).cast("int").alias("col"), ((du if i else 1 - du) * (dv if j else 1 - dv)).alias("w")) for j in (0, 1) for i in (0, 1)])
    apart = at.select("course_slug", *keys, F.explode(F.filter(corners, lambda k: k["w"] > 0)).alias("k"))
    spread = apart.select("course_slug", *[F.col(k).alias(f"p_{k}") for k in keys], "k.row", "k.col", "k.w")
    met = spread.join(cells.select("course_slug", "row", "col", "z"), ["course_slug", "row", "col"], "left")
    out = met.groupBy(*[f"p_{k}" for k in keys]).agg(F.when(F.count(F.lit(1)) == F.count("z"), F.sum(F.col("z") * F.col("w"))).alias("z"))
    return out.select(*[F.col(f"p_{k}").alias(k) for k in keys], "z")


def hole_grid(holes: DataFrame, rasters: DataFrame) -> DataFrame:
    """(course_slug, hole_id, row, col, x, y, inside, step): each hole's box of cells as large as its raster's, rows
    from north to south; inside within the hole's buffer."""
    r, s = F.col("hole_buffer_meters"), F.col("step")
    b = G.bounds(F.col("line"))
    box = holes.join(rasters.select("course_slug", "step"), "course_slug").select("course_slug", "hole_id", "line", "hole_buffer_meters", "step", b.alias("b"))
    # few and small rows become many: dealt out first, or one task would make every hole's cells
    box = box.repartition(partitions(holes.sparkSession), "hole_id")
    rows = F.sequence(F.floor(-(F.col("b.y1") + r) / s), F.floor(-(F.col("b.y0") - r) / s))
    cols = F.sequence(F.floor((F.col("b.x0") - r) / s), F.floor((F.col("b.x1") + r) / s))
    grid = box.withColumn("row", F.explode(rows)).withColumn("col", F.explode(cols)).withColumn("x", (F.col("col") + 0.5) * s).withColumn("y", -(F.col("row") + 0.5) * s)
    return grid.withColumn("inside", G.point_line_distance(F.col("x"), F.col("y"), F.col("line")) < r).select("course_slug", "hole_id", "row", "col", "x", "y", "inside", "step")


def _issue(rows: DataFrame, severity: str, code: str, message: Column | str, hole: bool = True) -> DataFrame:
    text = F.lit(message) if isinstance(message, str) else message
    return rows.select("course_slug", (F.col("hole_id") if hole else F.lit(None).cast("string")).alias("hole_id"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), text.alias("message"))


def build(spark: SparkSession, courses: DataFrame, features: DataFrame, rasters: DataFrame, cells: DataFrame, out: str, strict: bool = True, spacing: float = 1.0, cap: int = 250_000, overwrite: bool = False) -> DataFrame:
    """Writes holes, assignments, anchors, points, issues and manifests of all courses below `out`; returns manifests.

    A course is skipped without a boundary or a hole, or, if strict, without exactly the expected holes; it fails
    without elevation or if none of its holes has any. A hole without known elevation is left out and told.
    """
    if not overwrite and _exists(spark, f"{out}/manifests"):
        raise FileExistsError(f"{out} holds a run already")
    cuts = []

    def kept(df: DataFrame, label: str) -> DataFrame:
        cuts.append(cut(df, label))
        return cuts[-1]

    courses = with_centres(courses)
    mapped = kept(project(features, courses), "features")
    boundary = kept(boundaries(mapped), "boundary")
    found = kept(course.detect_holes(course.hole_candidates(mapped, boundary), "expected_holes"), "detected")
    report = course.detection_report(found, courses, "expected_holes").join(boundary.select("course_slug", F.lit(True).alias("bounded")), "course_slug", "left")
    steps = kept(raster_steps(rasters, courses), "rasters")
    state = kept(report.join(steps.select("course_slug", F.lit(True).alias("raised")).distinct(), "course_slug", "left").join(courses.select("course_slug", "expected_holes"), "course_slug"), "state")
    status = F.when(F.col("bounded").isNull(), "skipped").when(F.col("detected") == 0, "skipped").when(F.lit(strict) & ~F.col("is_clean"), "skipped").when(F.col("raised").isNull(), "failed").otherwise("processed")
    going = state.withColumn("status", status).filter("status = 'processed'").select("course_slug")

    number = F.col("hole_number")
    lines = found.filter("chosen").join(going, "course_slug", "left_semi").join(courses.select("course_slug", "course_name", "hole_buffer_meters", "dem_type"), "course_slug")
    lines = lines.withColumn("hole_id", course.hole_id(F.col("course_slug"), number)).withColumn("par", course.clean_int(F.col("par"))).withColumn("handicap", course.clean_int(F.col("handicap"))).withColumn("name", course.clean_text(F.col("name")))
    holes = kept(lines, "holes")
    near = course.layers(mapped.join(going, "course_slug", "left_semi"), boundary)
    assigned = course.assign(near, holes, F.col("hole_buffer_meters")).select("course_slug", "hole_number", "feature_id", "canonical_layer", "geom_type", "ref", "parts", "assignment_method", "assignment_confidence")
    assigned = kept(assigned.withColumn("hole_id", course.hole_id(F.col("course_slug"), number)), "assigned")
    rings = assigned.filter("geom_type in ('Polygon', 'MultiPolygon')")
    placed = course.anchors(holes.select("course_slug", "hole_id", "hole_number", "line"), rings)
    ends = placed.select("course_slug", "hole_id", F.explode(F.array(*[F.struct(F.lit(n).alias("end"), F.col(f"{n}.x").alias("x"), F.col(f"{n}.y").alias("y")) for n in ("tee", "green")])).alias("p")).select("course_slug", "hole_id", "p.*")
    heights = elevations(ends, ["hole_id", "end"], steps, cells).groupBy("hole_id").pivot("end", ["tee", "green"]).agg(F.first("z"))
    placed = kept(placed.join(heights.select("hole_id", F.col("tee").alias("tee_z"), F.col("green").alias("green_z")), "hole_id", "left"), "anchors")

    grid = hole_grid(holes, steps)
    known = elevations(grid.filter("inside"), ["hole_id", "row", "col"], steps, cells)
    raised = kept(grid.join(known, ["hole_id", "row", "col"], "left"), "grid")
    # one cell is the unit here, so that the rise is a cell's and is divided by its size
    sloped = terrain.slope(raised, terrain.Transform(1.0, 0.0, -1.0, 0.0), ("hole_id",)).filter("inside").withColumn("slope_pct", F.col("slope_pct") / F.col("step")).withColumn("slope_deg", F.degrees(F.atan(F.col("slope_pct") / 100)))
    covers = raised.filter("inside").groupBy("hole_id").agg((F.count("z") / F.count(F.lit(1))).alias("dem_coverage"), F.first("step").alias("dem_resolution_m"))
    stats = kept(terrain.summary(sloped).join(covers, "hole_id"), "terrain")
    good = stats.filter("cell_count > 0").select("hole_id")

    stride = F.greatest(F.lit(1), F.bround(F.lit(float(spacing)) / F.col("step")).cast("int")) if spacing > 0 else F.lit(1)
    some = raised.filter(F.col("z").isNotNull() & (F.pmod("row", stride) == 0) & (F.pmod("col", stride) == 0)).select("hole_id", "row", "col", "x", "y", "z")
    names = F.create_map(*[F.lit(x) for kv in LAYER_TO_LABEL.items() for x in kv])
    shapes = rings.select("hole_id", F.element_at(names, F.col("canonical_layer")).alias("label"), F.explode("parts").alias("ring"))
    cloud = course.labelled_cloud(some, placed.select("hole_id", "tee", "green", "tee_z"), shapes, cap)
    sinks.write_points(cloud.withColumn("course_slug", F.regexp_extract("hole_id", r"^(.+)__\d+$", 1)), f"{out}/points")
    counts = spark.read.parquet(f"{out}/points").groupBy("hole_id").agg(F.count(F.lit(1)).alias("point_count"))
    limited = some.groupBy("hole_id").agg((F.count(F.lit(1)) > cap).alias("limited"))

    table = holes.join(good, "hole_id", "left_semi").join(placed.select("hole_id", "tee_method", "green_method", "anchor_confidence", "tee_z", "green_z"), "hole_id").join(stats, "hole_id").join(counts, "hole_id", "left").join(limited, "hole_id", "left")
    length = G.line_length(F.col("line"))
    flags = F.array_compact(F.array(F.when(F.col("tee_z").isNull(), "TEE_ELEVATION_NAN"), F.when(F.col("green_z").isNull(), "GREEN_ELEVATION_NAN"), F.when(F.col("dem_coverage") < 0.5, "LOW_DEM_COVERAGE"), F.when(F.col("dem_resolution_m") > 2.0, "COARSE_DEM_RESOLUTION"), F.when(F.col("limited"), "POINT_LIMIT_REACHED")))
    net, _ = terrain.elevation_change(F.col("tee_z"), F.col("green_z"))
    index = table.select(
        "hole_id", "course_slug", "course_name", "hole_number", "name", "par", "handicap", F.round(length, 2).alias("hole_length_m"), F.round(length * METERS_TO_YARDS, 2).alias("hole_length_yd"),
        F.col("tee_z").alias("tee_elevation_m"), F.col("green_z").alias("green_elevation_m"), net.alias("net_elevation_change_m"),
        "min_elevation_m", "max_elevation_m", "mean_elevation_m", F.col("mean_slope_deg").alias("avg_slope_deg"), "max_slope_deg", F.col("mean_slope_pct").alias("avg_slope_percent"), F.col("max_slope_pct").alias("max_slope_percent"),
        "dem_type", "dem_resolution_m", "dem_coverage", "tee_method", "green_method", "anchor_confidence", F.coalesce("point_count", F.lit(0)).alias("point_count"), flags.alias("quality_flags"),
    )
    mode = "overwrite" if overwrite else "errorifexists"
    sinks.index_order(index).write.mode(mode).parquet(f"{out}/holes")
    index = spark.read.parquet(f"{out}/holes")
    assigned.drop("parts").write.mode(mode).parquet(f"{out}/assignments")
    placed.select("course_slug", "hole_id", "tee", "green", "tee_z", "green_z", "tee_method", "green_method", "anchor_confidence").write.mode(mode).parquet(f"{out}/anchors")

    mismatch = F.format_string("expected %d holes, detected %d", F.col("expected_holes"), F.col("detected"))
    flagged = index.select("course_slug", "hole_id", F.explode("quality_flags").alias("code"))
    issues = reduce(DataFrame.unionByName, [
        _issue(state.filter("bounded is null"), "error", "NO_COURSE_BOUNDARY", "no usable boundary", False),
        _issue(state.filter("bounded and detected = 0"), "error", "NO_HOLE_FEATURES", "no usable hole lines", False),
        _issue(state.filter("bounded and detected > 0 and not is_clean"), "error" if strict else "warning", "EXPECTED_HOLES_MISMATCH", mismatch, False),
        _issue(state.filter("bounded and size(duplicate_refs) > 0"), "warning", "DUPLICATE_HOLE_REFS", F.concat(F.lit("resolved: "), F.array_join("duplicate_refs", ", ")), False),
        _issue(state.filter("raised is null"), "error", "DEM_DOWNLOAD_FAILED", "no elevation raster that can be read, in degrees or the course's zone", False),
        _issue(holes.join(good, "hole_id", "left_anti"), "error", "HOLE_PROCESSING_FAILED", "no known elevation in the hole's buffer"),
        flagged.select("course_slug", "hole_id", F.when(F.col("code") == "POINT_LIMIT_REACHED", "info").otherwise("warning").alias("severity"), "code", F.lit("").alias("message")),
    ])
    issues.write.mode(mode).parquet(f"{out}/issues")

    done = index.groupBy("course_slug").agg(F.count(F.lit(1)).alias("processed_holes"), F.sum("hole_length_m").alias("total_length_m"), F.sum("par").alias("total_par"), F.sort_array(F.collect_list(F.struct("hole_number", "hole_id", "point_count"))).alias("holes"))
    codes = spark.read.parquet(f"{out}/issues").groupBy("course_slug").agg(F.sort_array(F.collect_set("code")).alias("quality_flags"))
    reason = F.when(F.col("bounded").isNull(), "no usable boundary").when(F.col("detected") == 0, "no usable hole lines").when(F.lit(strict) & ~F.col("is_clean"), mismatch).when(F.col("raised").isNull(), "no elevation").when(F.col("processed_holes").isNull(), "no holes processed")
    every = courses.select("course_slug", "course_name", "country", "dem_type", "srid", "hole_buffer_meters").join(state, "course_slug").join(done, "course_slug", "left").join(codes, "course_slug", "left")
    manifests = every.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), "course_slug", "course_name", F.when((status == "processed") & F.col("processed_holes").isNull(), "failed").otherwise(status).alias("status"), reason.alias("reason"), "country",
        "expected_holes", F.col("detected").alias("detected_holes"), F.coalesce("processed_holes", F.lit(0)).alias("processed_holes"), "missing_refs", "duplicate_refs", "dem_type", F.concat(F.lit("EPSG:"), "srid").alias("projected_crs"),
        "hole_buffer_meters", "total_length_m", "total_par", F.coalesce("quality_flags", F.array().cast("array<string>")).alias("quality_flags"), "holes",
    )
    manifests.write.mode(mode).parquet(f"{out}/manifests")
    drop_cut(*cuts)
    return spark.read.parquet(f"{out}/manifests")
