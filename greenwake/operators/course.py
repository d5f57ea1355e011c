"""From map features to labelled, tee-aligned points: layers, boundary, holes, assignment, anchors, labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from greenwake.functions import geometry as G
from greenwake.functions.stats import even_subsample
from greenwake.operators.terrain import Transform, centres, clip
from greenwake.schema import HOLE_OWNED_LAYERS, LABEL_IDS, LABEL_PRIORITY, LAYER_RESOLUTION_ORDER, LAYER_TAGS, LAYER_TO_LABEL

# Confidence of an assignment by its method.
CONFIDENCE = {"shared_overlap": 0.5, "ref": 1.0, "nearest_centerline": 0.6}


def hole_id(slug: Column, number: Column) -> Column:
    return F.format_string("%s__%02d", slug, number.cast("int"))


def cloud_id(slug: Column, number: Column) -> Column:
    return F.format_string("%s:%d", slug, number.cast("int"))


def to_cloud_id(name: Column) -> Column:
    """`slug:N` of `slug__NN`; parsing splits at the last separator."""
    return F.concat(F.regexp_extract(name, r"^(.+)__(\d+)$", 1), F.lit(":"), F.regexp_extract(name, r"^(.+)__(\d+)$", 2).cast("int").cast("string"))


def ref_tokens(ref: Column) -> Column:
    """Numbers in a reference, in order; null if there are none."""
    tokens = F.transform(F.regexp_extract_all(ref.cast("string"), F.lit("([0-9]+)"), F.lit(1)), lambda x: x.cast("int"))
    return F.when(F.size(tokens) > 0, tokens)


def hole_number(ref: Column) -> Column:
    return F.get(ref_tokens(ref), 0)


def clean_int(value: Column) -> Column:
    return F.trim(value.cast("string")).try_cast("double").try_cast("int")


def clean_text(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def layer(columns: list[str]) -> Column:
    """A feature's canonical layer by its tags: the first in resolution order with a matching tag, else null."""
    def matches(name: str) -> Column:
        tests = [F.col(k).isNotNull() if v is None else F.col(k) == v for k, v in LAYER_TAGS[name] if k in columns]
        return reduce(lambda a, b: a | F.coalesce(b, F.lit(False)), tests, F.lit(False))

    return F.coalesce(*[F.when(matches(name), F.lit(name)) for name in LAYER_RESOLUTION_ORDER])


def intersects(parts: Column, ring: Column) -> Column:
    """Whether a feature's lines touch a ring: a vertex of either inside, or edges that cross."""
    def cross(s: Column, t: Column) -> Column:
        def side(p: Column, a: Column, b: Column) -> Column:
            return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])

        return (side(t["a"], s["a"], s["b"]) * side(t["b"], s["a"], s["b"]) < 0) & (side(s["a"], t["a"], t["b"]) * side(s["b"], t["a"], t["b"]) < 0)

    vertex = F.exists(F.flatten(parts), lambda p: G.in_ring(p["x"], p["y"], ring))
    edges = F.exists(F.flatten(F.transform(parts, G.segments)), lambda s: F.exists(G.segments(ring), lambda t: cross(s, t)))
    return vertex | edges


def layers(features: DataFrame, boundary: DataFrame) -> DataFrame:
    """Features of a layer that touch their course's boundary (course_slug, ring)."""
    near = features.withColumn("canonical_layer", layer(features.columns)).filter("canonical_layer is not null")
    return near.join(boundary.select("course_slug", "ring"), "course_slug").filter(intersects(F.col("parts"), F.col("ring"))).drop("ring")


def select_boundary(candidates: DataFrame) -> DataFrame:
    """One candidate a course (course_slug, id, element, ring, cx, cy, osm_relation_id): the relation asked for,
    relations before others; else the nearest to the centre, then the largest."""
    at = G.in_ring(F.col("cx"), F.col("cy"), F.col("ring"))
    scored = candidates.withColumns({
        "id_match": F.coalesce(F.col("id").cast("string") == F.col("osm_relation_id").cast("string"), F.lit(False)),
        "is_relation": F.coalesce(F.lower("element").contains("relation"), F.lit(False)),
        "dist_to_center_m": F.when(at, 0.0).otherwise(G.point_line_distance(F.col("cx"), F.col("cy"), F.col("ring"))),
        "area_m2": G.area(F.col("ring")),
    })
    return pick_boundary(scored)


def pick_boundary(scored: DataFrame) -> DataFrame:
    one = Window.partitionBy("course_slug")
    by_id = F.col("id_match")
    order = one.orderBy(F.desc("id_match"), F.desc(F.when(by_id, F.col("is_relation"))), F.when(by_id, F.lit(0.0)).otherwise(F.col("dist_to_center_m")), F.when(by_id, F.lit(0.0)).otherwise(-F.col("area_m2")), "id")
    picked = scored.withColumn("candidate_count", F.count(F.lit(1)).over(one)).withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")
    return picked.withColumn("selection_method", F.when(by_id, "osm_relation_id").otherwise("scoring")).withColumn("fallback_used", ~by_id & F.col("osm_relation_id").isNotNull())


def hole_candidates(features: DataFrame, boundary: DataFrame) -> DataFrame:
    """(course_slug, hole_number, line, inside, length_m, dist_center) of linear golf=hole features with a number."""
    lines = features.filter("golf = 'hole' and geom_type in ('LineString', 'MultiLineString')").withColumn("line", G.merge_lines(F.col("parts"))).withColumn("hole_number", hole_number(F.col("ref")))
    joined = lines.filter("hole_number is not null").join(boundary.select("course_slug", "ring"), "course_slug")
    c = G.centroid(F.col("ring"))
    return joined.select("course_slug", "hole_number", *[x for x in ("par", "handicap", "name", "feature_id", "expected_holes") if x in features.columns], "line", intersects(F.array("line"), F.col("ring")).alias("inside"), G.line_length(F.col("line")).alias("length_m"), G.point_line_distance(c["x"], c["y"], F.col("line")).alias("dist_center"))


def _expected(expected: int | str) -> Column:
    return F.col(expected) if isinstance(expected, str) else F.lit(expected)


def detect_holes(candidates: DataFrame, expected: int | str = 18) -> DataFrame:
    """candidates within 1..expected (a number, or the column that holds it) with `chosen`: inside first, then longest, then nearest the centre,
    then the smallest feature_id where there is one."""
    order = Window.partitionBy("course_slug", "hole_number").orderBy(F.desc("inside"), F.desc("length_m"), "dist_center", *[c for c in ("feature_id",) if c in candidates.columns])
    some = candidates.filter(F.col("hole_number").between(F.lit(1), _expected(expected)))
    return some.withColumn("r", F.row_number().over(order)).withColumn("chosen", F.col("r") == 1).drop("r")


def detection_report(detected: DataFrame, courses: DataFrame, expected: int | str = 18) -> DataFrame:
    """(course_slug, detected, missing_refs, duplicate_refs, rejected, is_clean) a course."""
    per = detected.groupBy("course_slug", "hole_number").agg(F.count(F.lit(1)).alias("n"))
    agg = per.groupBy("course_slug").agg(F.count(F.lit(1)).alias("detected"), F.sort_array(F.collect_list("hole_number")).alias("have"), F.sort_array(F.collect_list(F.when(F.col("n") > 1, F.col("hole_number")))).alias("duplicate_refs"), (F.sum("n") - F.count(F.lit(1))).alias("rejected"))
    out = courses.select("course_slug", *[c for c in (expected,) if isinstance(c, str)]).distinct().join(agg, "course_slug", "left")
    have = F.coalesce("have", F.array().cast("array<int>"))
    missing = F.array_except(F.sequence(F.lit(1), _expected(expected)), have)
    return out.select("course_slug", F.coalesce("detected", F.lit(0)).alias("detected"), missing.alias("missing_refs"), F.coalesce("duplicate_refs", F.array().cast("array<int>")).alias("duplicate_refs"), F.coalesce("rejected", F.lit(0)).alias("rejected"), (F.size(missing) == 0).alias("is_clean"))


def feature_line_distance(parts: Column, line: Column) -> Column:
    """Distance of a feature to a line: over the vertices of both, exact unless two edges cross away from them."""
    a = F.array_min(F.transform(F.flatten(parts), lambda p: F.coalesce(G.point_line_distance(p["x"], p["y"], line), F.lit(float("inf")))))
    b = F.array_min(F.transform(line, lambda p: F.array_min(F.transform(parts, lambda part: F.coalesce(G.point_line_distance(p["x"], p["y"], part), F.lit(float("inf")))))))
    return F.least(a, b)


def assign(features: DataFrame, holes: DataFrame, radius: float) -> DataFrame:
    """Features (feature_id, course_slug, canonical_layer, ref, parts) of each hole (hole_number, line).

    Shared layers go to every hole they come within radius of; owned ones by their reference, else to the nearest
    line, the smaller number on a tie. Each row has its method and confidence.
    """
    b, f = G.bounds(F.col("line")), G.bounds(F.flatten("parts"))
    gap = feature_line_distance(F.col("parts"), F.col("line"))
    pairs = features.join(holes.select("course_slug", "hole_number", "line"), "course_slug").withColumn("gap", gap)
    near = Window.partitionBy("course_slug", "feature_id").orderBy("gap", "hole_number")
    pairs = pairs.withColumn("nearest", F.row_number().over(near) == 1)
    tokens = ref_tokens(F.col("ref"))
    owned = F.col("canonical_layer").isin(*HOLE_OWNED_LAYERS)
    method = F.when(~owned, "shared_overlap").when(tokens.isNotNull(), F.when(F.array_contains(tokens, F.col("hole_number")), "ref")).when(F.col("nearest"), "nearest_centerline")
    inside = F.exists(F.col("parts"), lambda ring: G.in_ring(F.col("line")[0]["x"], F.col("line")[0]["y"], ring))
    touches = ((F.col("gap") <= radius) | inside) & (f["x0"] <= b["x1"] + radius) & (f["x1"] >= b["x0"] - radius) & (f["y0"] <= b["y1"] + radius) & (f["y1"] >= b["y0"] - radius)
    kept = pairs.withColumn("assignment_method", method).filter(touches & F.col("assignment_method").isNotNull())
    table = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    return kept.withColumn("assignment_confidence", F.element_at(table, F.col("assignment_method"))).drop("gap", "nearest", "line")


def assignment_counts(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("canonical_layer", "assignment_method").agg(F.count(F.lit(1)).alias("n"))


def anchors(holes: DataFrame, assigned: DataFrame) -> DataFrame:
    """Each hole's tee and green point: the layer's representative point nearest the line's start (end), else that
    end itself, with methods and the mean confidence (0.85 mapped, 0.6 from the line)."""
    out = holes.withColumn("start", F.element_at("line", 1)).withColumn("end", F.element_at("line", -1))
    for name, layer_, end in (("tee", "tees", "start"), ("green", "greens", "end")):
        some = assigned.filter(F.col("canonical_layer") == layer_).select("course_slug", "hole_number", F.explode("parts").alias("ring")).select("course_slug", "hole_number", G.representative_point(F.col("ring")).alias("p"))
        joined = holes.select("course_slug", "hole_number", F.element_at("line", 1 if end == "start" else -1).alias("to")).join(some, ["course_slug", "hole_number"])
        best = joined.groupBy("course_slug", "hole_number").agg(F.min_by("p", F.hypot(F.col("p.x") - F.col("to.x"), F.col("p.y") - F.col("to.y"))).alias(f"{name}_mapped"))
        out = out.join(best, ["course_slug", "hole_number"], "left").withColumn(name, F.coalesce(f"{name}_mapped", end)).withColumn(f"{name}_method", F.when(F.col(f"{name}_mapped").isNotNull(), f"{name}_feature").otherwise(f"centerline_{end}"))
    score = lambda n: F.when(F.col(f"{n}_mapped").isNotNull(), 0.85).otherwise(0.6)
    return out.withColumn("anchor_confidence", (score("tee") + score("green")) / 2).drop("tee_mapped", "green_mapped", "start", "end")


def label_points(points: DataFrame, polygons: DataFrame, keys: list[str], infer_rough: bool = True, tile: float = 64.0, edge: bool = True) -> DataFrame:
    """points(*keys, x, y, ...) with label, label_id, source and confidence: the polygon (label, ring) of least priority
    that holds the point (on its edge as `edge` of in_ring says), else inferred rough or unknown. A square tile's
    polygons are one array, which a point scans in order of priority, so points are joined once and need no identity."""
    rank = F.create_map(*[F.lit(x) for kv in LABEL_PRIORITY.items() for x in kv])
    ids = F.create_map(*[F.lit(x) for kv in LABEL_IDS.items() for x in kv])
    b = G.bounds(F.col("ring"))
    tiles = polygons.select(*keys, "label", "ring").withColumn("__tx", F.explode(F.sequence(F.floor(b["x0"] / tile), F.floor(b["x1"] / tile)))).withColumn("__ty", F.explode(F.sequence(F.floor(b["y0"] / tile), F.floor(b["y1"] / tile))))
    in_box = lambda b: F.col("x").between(b["x0"] - 1e-9, b["x1"] + 1e-9) & F.col("y").between(b["y0"] - 1e-9, b["y1"] + 1e-9)
    shapes = tiles.groupBy(*keys, "__tx", "__ty").agg(F.array_sort(F.collect_list(F.struct(F.element_at(rank, F.col("label")).alias("rank"), "label", "ring", G.bounds(F.col("ring")).alias("box")))).alias("__shapes"))
    keyed = points.withColumn("__tx", F.floor(F.col("x") / tile)).withColumn("__ty", F.floor(F.col("y") / tile))
    out = keyed.join(shapes, [*keys, "__tx", "__ty"], "left").withColumn("hit", F.get(F.filter("__shapes", lambda s: in_box(s["box"]) & G.in_ring(F.col("x"), F.col("y"), s["ring"], edge)), 0)["label"]).drop("__tx", "__ty", "__shapes")
    default = "rough_inferred" if infer_rough else "unknown"
    label = F.coalesce("hit", F.lit(default))
    source = F.when(F.col("hit").isNotNull(), F.concat(F.lit("osm:golf="), "hit")).otherwise("inferred:background" if infer_rough else "unknown")
    return out.withColumn("label", label).withColumn("label_id", F.element_at(ids, F.col("label"))).withColumn("source", source).withColumn("confidence", F.when(F.col("hit").isNotNull(), 0.9).otherwise(0.4 if infer_rough else 0.2)).drop("hit")


def point_cloud(cells: DataFrame, t: Transform, holes: DataFrame, polygons: DataFrame, radius: float, spacing: float = 1.0, cap: int = 250_000) -> DataFrame:
    """Labelled points of every hole (hole_id, line, tee, green, tee_z) over polygons (hole_id, label, ring)."""
    stride = t.stride(spacing)
    some = centres(cells, t, stride).select("row", "col", "z")
    return labelled_cloud(clip(some, holes, t, radius), holes, polygons, cap)


def labelled_cloud(inside: DataFrame, holes: DataFrame, polygons: DataFrame, cap: int = 250_000) -> DataFrame:
    """Labelled, tee-aligned points of inside (hole_id, row, col, x, y, z), at most cap a hole, evenly thinned."""
    inside = even_subsample(inside, ["hole_id"], ["row", "col"], F.lit(cap))
    numbered = inside.withColumn("point_id", F.row_number().over(Window.partitionBy("hole_id").orderBy("row", "col")) - 1)
    labelled = label_points(numbered, polygons, ["hole_id"])
    joined = labelled.join(holes.select("hole_id", "tee", "green", "tee_z"), "hole_id")
    ax, ay = G.align(F.col("x"), F.col("y"), F.col("tee.x"), F.col("tee.y"), F.col("green.x"), F.col("green.y"))
    r = lambda c, n: F.round(c, 3).alias(n)
    return joined.select(
        "hole_id", "point_id", r(F.col("x"), "x_abs_m"), r(F.col("y"), "y_abs_m"), r(F.col("z"), "z_abs_m"),
        r(F.col("x") - F.col("tee.x"), "x_rel_m"), r(F.col("y") - F.col("tee.y"), "y_rel_m"), r(F.col("z") - F.coalesce("tee_z", F.lit(0.0)), "z_rel_m"),
        r(ax, "x_aligned_m"), r(ay, "y_aligned_m"), "label", "label_id", "source", "confidence",
    )


def quality_flags(issues: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, quality_flags): distinct codes of issues (*keys, seq, code) in order of first sight."""
    first = issues.groupBy(*keys, "code").agg(F.min("seq").alias("seq"))
    return first.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "code"))), lambda x: x["code"]).alias("quality_flags"))


def compact_cloud(points: DataFrame) -> DataFrame:
    """One row a hole: its points as [x, y, z, label_id] arrays in point order."""
    p = F.struct("point_id", F.array(F.col("x_aligned_m"), F.col("y_aligned_m"), F.col("z_rel_m"), F.col("label_id").cast("double")).alias("p"))
    return points.groupBy("hole_id").agg(F.transform(F.sort_array(F.collect_list(p)), lambda s: s["p"]).alias("points"))


def label_counts(points: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return points.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))
