import dataclasses
import json
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from greenwake.functions import geometry as G
from greenwake.functions.stats import even_ordinals, even_subsample, standardised
from greenwake.operators import cloud, clusters, course, features, neighbours, plausibility, publish, terrain
from greenwake.plans.oracle import ORACLE
from greenwake.plans.queries import BASELINE, HAZARD, QUERIES
from greenwake.sources import configs, readers, sinks


def ring(*xy):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in xy])




def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_geometry(spark):
    px, square = F.lit(5.0), ring((0, 0), (10, 0), (10, 10), (0, 10), (0, 0))
    r = one(spark, G.area(square), G.in_ring(px, F.lit(5.0), square), G.in_ring(px, F.lit(10.0), square), G.in_ring(px, F.lit(11.0), square), G.line_length(ring((0, 0), (3, 4))), G.point_line_distance(F.lit(5.0), F.lit(3.0), ring((0, 0), (10, 0))), G.representative_point(square)["x"], G.interpolate(ring((0, 0), (10, 0), (10, 10)), F.lit(0.75))["y"])
    assert tuple(r) == (100.0, True, True, False, 5.0, 3.0, 5.0, 5.0)


def test_representative_point_of_a_concave_ring_is_inside(spark):
    u = ring((0, 0), (10, 0), (10, 10), (8, 10), (8, 2), (2, 2), (2, 10), (0, 10), (0, 0))
    p = G.representative_point(u)
    assert one(spark, G.in_ring(p["x"], p["y"], u))[0]


def test_alignment_puts_the_green_on_the_y_axis(spark):
    x, y = G.align(F.lit(30.0), F.lit(40.0), F.lit(0.0), F.lit(0.0), F.lit(30.0), F.lit(40.0))
    tx, ty = G.align(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(30.0), F.lit(40.0))
    r = one(spark, x, y, tx, ty)
    assert abs(r[0]) < 1e-9 and r[1] == pytest.approx(50) and r[2] == r[3] == 0


def test_utm_of_a_known_point(spark):
    e, n = G.to_utm(F.lit(-81.0), F.lit(0.0), F.lit(17))
    lon, lat = G.from_utm(F.lit(500000.0), F.lit(0.0), F.lit(17))
    assert tuple(round(v, 4) for v in one(spark, e, n, lon, lat)) == (500000.0, 0.0, -81.0, 0.0)


def test_slope_of_flat_and_ramp(spark):
    t = terrain.Transform(1.0, 0.0, -1.0, 20.0)
    cells = spark.range(400).select((F.col("id") / 20).cast("int").alias("row"), (F.col("id") % 20).cast("int").alias("col"), F.lit("c").alias("course_slug"))
    assert terrain.slope(cells.withColumn("z", F.lit(50.0)), t).agg(F.max("slope_pct")).first()[0] == 0
    r = terrain.slope(cells.withColumn("z", F.col("col") * 0.1), t).agg(F.min("slope_pct"), F.max("slope_deg")).first()
    assert r[0] == pytest.approx(10) and r[1] == pytest.approx(math.degrees(math.atan(0.1)))
    gap = cells.withColumn("z", F.when((F.col("row") == 5) & (F.col("col") == 5), None).otherwise(1.0))
    assert terrain.slope(gap, t).filter("slope_pct is null").count() == 4


def test_stride_rounds_half_to_even():
    assert terrain.Transform(2.0, 0, -2.0, 0).stride(5.0) == 2 and terrain.Transform(1.0, 0, -1.0, 0).stride(0.2) == 1


@pytest.mark.parametrize("ref, tokens", [("1", [1]), ("9;10", [9, 10]), ("9, 10", [9, 10]), (None, None), ("None", None), ("", None)])
def test_ref_tokens(spark, ref, tokens):
    assert one(spark, course.ref_tokens(F.lit(ref).cast("string")))[0] == tokens


def test_layer_order_and_ids(spark):
    df = spark.createDataFrame([("bunker", "sand", None), (None, "sand", None), (None, None, "x"), (None, None, None)], "golf string, natural string, water string")
    assert [r[0] for r in df.select(course.layer(df.columns)).collect()] == ["bunkers", "sand", "water", None]
    assert tuple(one(spark, course.hole_id(F.lit("a_b"), F.lit(7)), course.to_cloud_id(F.lit("a__b__07")))) == ("a_b__07", "a__b:7")


def test_holes_missing_and_duplicate(spark):
    rows = [("c", 1, True, 50.0, 1.0), ("c", 2, True, 50.0, 1.0), ("c", 2, True, 400.0, 9.0), ("c", 3, False, 10.0, 1.0), ("c", 99, True, 1.0, 1.0)]
    df = course.detect_holes(spark.createDataFrame(rows, "course_slug string, hole_number int, inside boolean, length_m double, dist_center double"), 4)
    assert [r["length_m"] for r in df.filter("chosen and hole_number = 2").collect()] == [400.0]
    r = course.detection_report(df, df, 4).first()
    assert (r["missing_refs"], r["duplicate_refs"], r["rejected"], r["is_clean"]) == ([4], [2], 1, False)


def test_assignment(spark):
    holes = spark.range(2).select(F.lit("c").alias("course_slug"), (F.col("id") + 1).cast("int").alias("hole_number"), F.transform(F.array(F.lit(0.0), F.lit(300.0)), lambda y: F.struct((F.col("id") * 100.0).alias("x"), y.alias("y"))).alias("line"))

    def box(x, y):
        return ring((x, y), (x + 10, y), (x + 10, y + 10), (x, y + 10), (x, y))

    feats = None
    for i, (layer, ref, x) in enumerate((("fairways", "1", 0), ("fairways", None, 95), ("fairways", "2", 0), ("water", None, 45))):
        row = spark.range(1).select(F.lit(i).alias("feature_id"), F.lit("c").alias("course_slug"), F.lit(layer).alias("canonical_layer"), F.lit(ref).cast("string").alias("ref"), F.array(box(x, 100)).alias("parts"))
        feats = row if feats is None else feats.unionByName(row)
    got = {(r["feature_id"], r["hole_number"]): r["assignment_method"] for r in course.assign(feats, holes, 60.0).collect()}
    assert got == {(0, 1): "ref", (1, 2): "nearest_centerline", (3, 1): "shared_overlap", (3, 2): "shared_overlap"}


def test_labels_by_priority(spark):
    pts = spark.createDataFrame([(1, 0, 50.0, 50.0), (1, 1, 15.0, 15.0), (1, 2, 90.0, 90.0), (1, 3, 500.0, 5.0)], "k int, point_id long, x double, y double")
    polys = None
    for label, (a, b) in (("fairway", (0, 100)), ("bunker", (10, 20)), ("green", (80, 95))):
        row = spark.range(1).select(F.lit(1).alias("k"), F.lit(label).alias("label"), ring((a, a), (b, a), (b, b), (a, b), (a, a)).alias("ring"))
        polys = row if polys is None else polys.unionByName(row)
    out = course.label_points(pts, polys, ["k"]).orderBy("point_id").collect()
    assert [(r["label"], r["label_id"], r["confidence"]) for r in out] == [("fairway", 3, 0.9), ("bunker", 5, 0.9), ("green", 2, 0.9), ("rough_inferred", 10, 0.4)]


def test_point_cloud_end_to_end(spark):
    t = terrain.Transform(5.0, 0.0, -5.0, 400.0)
    cells = spark.range(80 * 40).select((F.col("id") / 40).cast("int").alias("row"), (F.col("id") % 40).cast("int").alias("col")).withColumn("z", 100 + (400 - F.col("row") * 5) * 0.1)
    p = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    holes = spark.range(1).select(F.lit("c__01").alias("hole_id"), F.array(p(100.0, 50.0), p(100.0, 350.0)).alias("line"), p(100.0, 50.0).alias("tee"), p(100.0, 350.0).alias("green"), F.lit(105.0).alias("tee_z"))
    polys = spark.range(1).select(F.lit("c__01").alias("hole_id"), F.lit("fairway").alias("label"), ring((82, 60), (118, 60), (118, 335), (82, 335), (82, 60)).alias("ring"))
    out = course.point_cloud(cells, t, holes, polys, 50.0, 5.0)
    r = out.agg(F.count("*"), F.min("y_aligned_m"), F.max("x_aligned_m"), F.count_distinct("label")).first()
    assert r[0] > 1000 and -50 < r[1] < 0 and r[2] < 50 and r[3] == 2
    assert out.select("point_id").distinct().count() == r[0]


def points(spark, *specs):
    rows = [(1, float(x), float(y), float(z), label) for x, y, z, label, n in specs for _ in range(n)]
    return spark.createDataFrame(rows, "hole_id int, x double, y double, z double, label string")


def test_label_shares_and_zones(spark):
    r = features.hole_features(points(spark, (0, 10, 0, "fairway", 60), (0, 10, 0, "rough_osm", 10), (0, 10, 0, "rough_inferred", 30))).first()
    assert (r["fairway_pct"], r["rough_pct"], r["drive_zone_fairway_pct"]) == (0.6, 0.4, None)
    p = points(spark, (0, 500, 1, "green", 4), (0, 10, 0, "fairway", 2), (0, 10, 0, "trees", 2), (-5, 200, 0, "bunker", 1), (5, 200, 0, "water", 1), (0, 200, 0, "fairway", 2))
    r = features.hole_features(p).first()
    assert (r["green_y_m"], r["tee_zone_fairway_pct"], r["drive_bunker_left_pct"], r["drive_water_right_pct"], r["green_relative_elevation"]) == (500.0, 0.5, 0.25, 0.25, 1.0)
    assert len([c for c in r.asDict() if c != "hole_id"]) == 83


def table(spark):
    rng = np.random.default_rng(0)
    rows = [(f"h{i:02d}", f"c{i % 3}", i, 3 + i % 3, 300.0 + 10 * i, float(a), float(b), None if i == 3 else float(c)) for i, (a, b, c) in enumerate(rng.normal(size=(18, 3)))]
    return spark.createDataFrame(rows, "hole_id string, course_slug string, hole_number int, par int, hole_length_m double, feat_a double, feat_b double, feat_c double")


def test_neighbours_and_filters(spark):
    f = table(spark)
    out = neighbours.mode_neighbours(f, "v1", 4)
    assert out.count() == 72 and out.filter("query_hole_id = similar_hole_id").count() == 0
    guarded = neighbours.with_pair_columns(neighbours.mode_neighbours(f, "cross_course_same_par_length_guarded", 4), f)
    assert guarded.filter("not same_par or same_course").count() == 0
    assert neighbours.similar_holes(f, "h05", "v1", 3).count() == 3
    with pytest.raises(KeyError):
        neighbours.similar_holes(f, "nope")
    with pytest.raises(KeyError):
        neighbours.mode_named("nope")
    with pytest.raises(ValueError):
        neighbours.mode_columns(f.select("hole_id", "feat_a"), "terrain")
    m = standardised(f, ["feat_a", "feat_c"]).agg(F.avg("feat_a"), F.stddev_pop("feat_a"), F.count("feat_c")).first()
    assert abs(m[0]) < 1e-7 and m[1] == pytest.approx(1) and m[2] == 18


def test_plausibility(spark):
    f = spark.createDataFrame([(1, "a", 4, 400.0), (2, "b", 5, 400.0), (3, "b", 4, 520.0)], "hole_id int, course_slug string, par int, hole_length_m double")
    pairs = spark.createDataFrame([(1, 2, 1, 0.1), (1, 3, 2, 0.2), (1, 9, 3, 0.3)], "query_hole_id int, similar_hole_id int, rank int, distance double")
    r = {x["similar_hole_id"]: x for x in plausibility.flags(pairs, f).collect()}
    assert r[2]["plausibility_score"] == 0.6 and r[2]["plausibility_reasons"] == "different par"
    assert r[3]["length_diff_m"] == 120.0 and r[3]["plausibility_reasons"] == "length diff 120.0m"
    assert r[9]["plausibility_score"] == 0 and r[9]["presentable_bad_flag_count"] == 2


def test_chamfer():
    a = np.array([[0.0, 0, 0], [1, 0, 0]])
    assert cloud.chamfer(a, a) == 0 and cloud.chamfer(a[:0], a[:0]) == 0 and cloud.chamfer(a, a + [0, 3, 0]) == 3
    with pytest.raises(ValueError):
        cloud.chamfer(a, a[:0])


def test_candidate_filter_and_scores(spark):
    cols = "hole_id string, course_slug string, par int, yards double, has_tee boolean, has_green boolean, has_fairway boolean, tee_elevation_m double, green_elevation_m double"
    meta = spark.createDataFrame([("t:1", "t", 4, 400.0, True, True, True, 0.0, 6.0), ("a:1", "a", 4, 405.0, True, True, True, 0.0, 0.0), ("b:1", "b", 5, 400.0, True, True, True, 0.0, 0.0), ("c:1", "c", 4, 600.0, True, True, True, 0.0, 0.0), ("d:1", "d", 4, 400.0, True, False, True, 0.0, 0.0)], cols)
    grid = [(h, s, float(x), float(y), 0.0) for h in ("t:1", "a:1") for s in ("tee", "green", "fairway") for x in range(3) for y in range(3)]
    pts = spark.createDataFrame(grid, "hole_id string, surface string, x_lateral_m double, y_down_hole_m double, z_relative_m double")
    target = meta.filter("hole_id = 't:1'")
    best, pairs = cloud.batch(meta, pts, BASELINE, 5, target)
    reasons = {r["candidate_hole_id"]: r["filter_reason"] for r in pairs.collect()}
    assert reasons == {"a:1": "PASS", "b:1": "DIFFERENT_PAR", "c:1": "YARDAGE_TOO_DIFFERENT", "d:1": "MISSING_REQUIRED_SURFACE"}
    r = best.collect()
    assert len(r) == 1 and r[0]["elevation_penalty"] == pytest.approx(0.6) and r[0]["yardage_penalty"] == pytest.approx(0.75) and r[0]["bunker_score"] is None
    assert r[0]["total_score"] == pytest.approx(1.35)
    c = cloud.components(best, BASELINE).first()
    assert c["recomputed_total"] == pytest.approx(1.35) and c["share_elevation"] == pytest.approx(0.6 / 1.35)
    assert cloud.calibration(cloud.components(best, BASELINE), BASELINE).first()["elevation_correlation"] is None


@pytest.fixture(scope="module")
def course_tables(spark, tmp_path_factory):
    """40 holes with 90 points each as the driver's tables, and every passing pair's score by brute force."""
    d, rng = tmp_path_factory.mktemp("tables"), np.random.default_rng(5)
    spark.createDataFrame([(h, h % 4) for h in range(40)], "s_suppkey long, s_nationkey int").coalesce(1).write.parquet(f"{d}/supplier.parquet")
    items = [(h, int(k), int(n), float(q), float(e), float(c) / 100) for h in range(40) for k, n, q, e, c in zip(rng.integers(0, 500, 90), rng.integers(1, 8, 90), rng.integers(1, 51, 90), rng.integers(100, 90000, 90), rng.integers(0, 11, 90), strict=True)]
    spark.createDataFrame(items, "l_suppkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double").coalesce(1).write.parquet(f"{d}/lineitem.parquet")
    names, sets = {4: "green", 5: "bunker", 6: "water", 7: "tee", 0: "fairway", 1: "fairway", 2: "fairway", 3: "fairway"}, {}
    for h, k, n, q, e, c in items:
        r = (k * 7 + n * 3) % 11
        if r in names:
            sets.setdefault((h, names[r]), []).append((q - 25.5, 380 + c * 100 if r == 4 else e / 200, (c * 100 - 5)))
    for key, p in sets.items():
        p.sort()
        sets[key] = np.array([p[i] for i in even_ordinals(len(p), BASELINE.budgets[key[1]])] if len(p) > BASELINE.budgets[key[1]] else p) * BASELINE.scale
    yards = [(120 + 150 * (h % 3) + h * 37 % 60) * 1.09361 for h in range(40)]
    tee, total = {}, {c.config_name: {} for c in (BASELINE, HAZARD)}
    for a in range(40):
        for b in range(40):
            least, share = BASELINE.windows[3 + a % 3]
            if a != b and a % 3 == b % 3 and abs(yards[a] - yards[b]) <= max(least, share * yards[a]):
                score = {s: cloud.chamfer(sets[a, s], sets[b, s]) for s in BASELINE.weights}
                tee[a, b] = score["tee"]
                for c in (BASELINE, HAZARD):
                    total[c.config_name].setdefault(a, []).append((sum(score[s] * w for s, w in c.weights.items()) + abs(yards[a] - yards[b]) * 0.15 + abs(a % 7 - b % 7) * 0.1, b))
    return str(d), tee, {c: {a: sorted(x)[:5] for a, x in t.items()} for c, t in total.items()}


def test_all_holes_are_targets_and_candidates(spark, course_tables):
    d, tee, best = course_tables
    got = {(r["target_hole_id"], r["candidate_hole_id"]): r["chamfer"] for r in QUERIES["chamfer_tee"](spark, d).collect()}
    assert got.keys() == tee.keys() and all(got[k] == pytest.approx(v, abs=1e-5) for k, v in tee.items())
    want = {(a, b): (i + 1, t) for a, x in best["baseline"].items() for i, (t, b) in enumerate(x)}
    for name in ("rank_topn", "pair_score"):
        top = {(r["target_hole_id"], r["candidate_hole_id"]): (r["rank"], r["total_score"]) for r in QUERIES[name](spark, d).collect()}
        assert top.keys() == want.keys() and all(top[k] == (v[0], pytest.approx(v[1], abs=1e-4)) for k, v in want.items())
    parts = {(r["target_hole_id"], r["candidate_hole_id"]): r["recomputed_total"] for r in QUERIES["calibration_components"](spark, d).collect()}
    assert parts.keys() == want.keys() and all(parts[k] == pytest.approx(v[1], abs=1e-4) for k, v in want.items())
    assert QUERIES["calibration_summary"](spark, d).first()["n_pairs"] == len(want)


def test_configurations_are_compared_over_all_holes(spark, course_tables):
    d, _, best = course_tables
    ids = {c: {a: {b for _, b in x} for a, x in t.items()} for c, t in best.items()}
    got = {r["target_hole_id"]: (r["overlap_count"], r["union_count"]) for r in QUERIES["config_overlap"](spark, d).collect()}
    assert got == {a: (len(x & ids["hazard"][a]), len(x | ids["hazard"][a])) for a, x in ids["baseline"].items()}
    pairs = {c: {(a, b) for a, x in t.items() for b in x} for c, t in ids.items()}
    assert {tuple(r) for r in QUERIES["shared_all_configs"](spark, d).collect()} == pairs["baseline"] & pairs["hazard"]
    assert {(r["target_hole_id"], r["candidate_hole_id"]) for r in QUERIES["rank_comparison"](spark, d).collect()} == pairs["baseline"] | pairs["hazard"]


def test_even_subsample(spark):
    df = spark.range(23).select(F.lit(1).alias("k"), F.col("id"))
    got = [r["id"] for r in even_subsample(df, ["k"], ["id"], F.lit(7)).orderBy("id").collect()]
    assert got == even_ordinals(23, 7)


def test_ward_and_pca(spark):
    x = np.array([[0.0, 0], [0, 1], [10, 0], [10, 1]])
    assert clusters.ward_labels(x, 2).tolist() == [0, 0, 1, 1]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "hole_id int, v array<double>")
    p, ratio = clusters.pca(df)
    assert p.count() == 4 and ratio[0] > 0.9
    assert clusters.kmeans(df, 2, 3).select("kmeans_cluster").distinct().count() == 2


def test_config(spark, tmp_path):
    payload = {"model_name": "m", "model_version": "v", "config_name": "c", "candidate_filter": {"yardage_windows": {f"par_{p}": {"absolute_yards": 25, "percentage": 0.1} for p in (3, 4, 5)}}, "surface_weights": {"fairway": 0.5, "green": 0.5}}
    assert configs.cloud_config(payload).scale == (1.0, 1.0, 2.0)
    for bad in ({"surface_weights": {"fairway": 0.9}}, {"surface_weights": {"moon": 1.0}}, {"config_name": ""}, {"candidate_filter": {}}):
        with pytest.raises(configs.ConfigError):
            configs.cloud_config(payload | bad)
    (tmp_path / "c.json").write_text('{"courses": [{"course_slug": "x", "country": "us", "note": "n"}, {"course_slug": "y"}]}')
    df = configs.load_courses(spark, str(tmp_path / "c.json"))
    assert [(r["dem_type"], r["expected_holes"]) for r in df.orderBy("course_slug").collect()] == [("USGS1m", 18), ("COP30", 18)]
    with pytest.raises(KeyError):
        configs.course(df, "z")


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "greens.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"golf":"green","ref":"3"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}}]}')
    (tmp_path / "bad.geojson").write_text("not json")
    r = readers.read_geojson(spark, str(tmp_path / "*.geojson")).collect()
    assert len(r) == 1 and r[0]["layer"] == "greens" and len(r[0]["parts"][0]) == 4
    (tmp_path / "cloud.json").write_text('{"hole_id": "h", "label_map": {"2": "green"}, "points": [[1, 2, 3, 2], [1, 2, 3, 5], [1, 2, 3, 77]]}')
    assert [x["label"] for x in readers.read_compact(spark, str(tmp_path / "cloud.json")).collect()] == ["green", "bunker", "unknown"]
    df = spark.createDataFrame([("h", None, True, ["a", "b"])], "hole_id string, par int, ok boolean, quality_flags array<string>")
    assert tuple(sinks.flat(df).first()) == ("h", "", "true", "a;b")
    sinks.write_csv(df, str(tmp_path / "o"))
    with pytest.raises(Exception):
        sinks.write_csv(df, str(tmp_path / "o"))
    assert sinks.geojson(readers.read_geojson(spark, str(tmp_path / "greens.geojson"))).first()["value"].startswith('{"type":"FeatureCollection"')


def test_publish(spark, tmp_path):
    f = spark.createDataFrame([("a", 3, 100.0, 0.1, 5.0), ("b", 4, 300.0, 0.9, 1.0), ("c", 3, 90.0, 0.0, 9.0)], "hole_id string, par int, hole_length_m double, water_pct double, z_range double")
    assert {(r["hole_id"], r["priority"]) for r in publish.curated(f).collect()} == {("a", 0), ("c", 100), ("b", 101)}
    assert one(spark, publish.human_bytes(F.lit(1536)), publish.human_bytes(F.lit(12)))[0:2] == ("1.5 KB", "12 B")
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.txt").write_text("hi")
    assert publish.inventory(spark, str(tmp_path / "x")).first()["bytes"] == 2
    (tmp_path / "x" / ".env").write_text("k")
    with pytest.raises(RuntimeError):
        publish.inventory(spark, str(tmp_path / "x"))


def test_stream_counts(spark, tmp_path):
    from greenwake.streaming import label_counts

    (tmp_path / "p.json").write_text('{"hole_id": "h", "label": "green"}\n{"hole_id": "h", "label": "green"}\n')
    q = label_counts.counts(label_counts.stream_points(spark, str(tmp_path))).writeStream.outputMode("complete").format("memory").queryName("n").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("n").first()["n"] == 2


def test_command_line(spark, tmp_path):
    from greenwake.__main__ import main

    table(spark).write.parquet(str(tmp_path / "f"))
    args = ["modes", "--features", str(tmp_path / "f"), "--out", str(tmp_path / "o"), "--mode", "v1", "--neighbors", "2"]
    assert main(args) == 0 and spark.read.parquet(str(tmp_path / "o")).count() == 36
    assert main(args) == 1 and main(["modes"]) == 2 and main([*args, "--overwrite"]) == 0


def test_batch_outputs_and_sweep(spark, tmp_path):
    from dataclasses import replace

    from greenwake.operators import exports
    from greenwake.plans.queries import BASELINE

    meta = spark.createDataFrame([(f"h{i}", f"c{i % 2}", 4, 400.0 + 5 * i) for i in range(5)], "hole_id string, course_slug string, par int, yards double")
    for s in ("tee", "green", "fairway", "bunker", "water"):
        meta = meta.withColumn(f"has_{s}", F.lit(s in BASELINE.required))
    meta = meta.withColumns({"tee_elevation_m": F.lit(0.0), "green_elevation_m": F.lit(1.0)})
    points = spark.createDataFrame([(f"h{i}", s, float(x), float(i), 0.0) for i in range(5) for s in BASELINE.required for x in range(4)], "hole_id string, surface string, x_lateral_m double, y_down_hole_m double, z_relative_m double")
    root = str(tmp_path / "out")
    status = exports.write_sweep(meta, points, [BASELINE, replace(BASELINE, config_name="broken", scale=None)], root, top_n=3)
    assert [r["status"] for r in status] == ["ran", "failed"] and status[0]["rows"] == 15
    again = exports.write_sweep(meta, points, [BASELINE], root, top_n=3)
    assert again[0]["status"] == "skipped" and exports.config_names(spark, root) == ["baseline"]
    results = exports.load_results(spark, root)
    assert [r[0] for r in exports.available_targets(results).collect()] == [f"h{i}" for i in range(5)]
    manifest = exports.write_batch(meta, points, BASELINE, str(tmp_path / "few"), top_n=2, limit_targets=2)
    assert (manifest["total_targets"], manifest["total_written_rows"], manifest["total_scored_pairs"]) == (2, 4, 8)
    assert exports.write_surfaces(meta.filter("hole_id < 'h3'"), points, str(tmp_path / "p"), str(tmp_path / "m")) == {"holes": 3, "points": 36}
    exports.write_validation(results, ["baseline"], str(tmp_path / "v"), 2)
    docs = spark.createDataFrame([(json.dumps({"a": [1], "b": 1}),), (json.dumps({"a": [1, 2], "b": 2}),)], "value string")
    assert exports.merged_manifests(docs.coalesce(1)) == {"a": [1, 2], "b": 2} and exports.file_name("a b/c") == "a_b_c"


def _tables(spark, folder, lines, suppliers):
    """The two tables that the hole fixtures read."""
    cols = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double"
    spark.createDataFrame(lines, cols).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")
    return str(folder)


def _duck(folder, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("lineitem", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return con.execute(ORACLE[name]).fetchall()


def test_point_in_polygon_label_counts_points_on_an_edge_as_its_sql_does(spark, tmp_path):
    d = _tables(spark, tmp_path, [(i, 0, 1, 1, 10.0, p, 0.05) for i, p in enumerate((99875.0, 99874.0, 99876.0))], [(1, 3)])
    got = QUERIES["point_in_polygon_label"](spark, d).select("label", "label_id", "source", "confidence", "n").collect()
    assert sorted(map(tuple, got)) == sorted(_duck(d, "point_in_polygon_label"))


def test_neighbours_pair_blocks_and_put_unknown_distances_last(spark):
    rng = np.random.default_rng(7)
    v = [[float(x) for x in row] for row in rng.integers(0, 3, (40, 3))]
    v[5], v[6], v[7] = None, [1.0, None, 2.0], [float("inf"), 0.0, 0.0]
    rows = [(i, f"c{i % 4}" if i % 9 else None, 3 + i % 2 if i != 11 else None, 100.0 + i if i != 12 else None, x) for i, x in enumerate(v)]
    holes = spark.createDataFrame(rows, "hole_id long, course_slug string, par int, hole_length_m double, v array<double>")

    def far(a, b):
        if a is None or b is None or None in a or None in b:
            return (1, 0.0)
        d = math.sqrt(sum((x - y) * (x - y) for x, y in zip(a, b)))
        return (0, round(d, 9))  # inf before unknown; inf - inf is not met, as one vector has it

    for kw in ({}, {"same_par": True}, {"exclude_same_course": True}, {"same_par": True, "max_length_diff_m": 5.0, "max_length_diff_pct": 0.06}):
        out = neighbours.neighbours(holes.select("hole_id", "v"), holes.drop("v"), 6, blocks=2, **kw)
        want = set()
        for q in rows:
            ok = [c for c in rows if c[0] != q[0]]
            if kw.get("same_par"):
                ok = [c for c in ok if q[2] is not None and q[2] == c[2]]
            if kw.get("exclude_same_course"):
                ok = [c for c in ok if q[1] != c[1]]
            if "max_length_diff_m" in kw:
                ok = [c for c in ok if None in (q[3], c[3]) or abs(q[3] - c[3]) <= max(0.0, 5.0, q[3] * 0.06)]
            want |= {(q[0], c[0], n + 1) for n, c in enumerate(sorted(ok, key=lambda c: (far(q[4], c[4]), c[0]))[:6])}
        assert {(r["query_hole_id"], r["similar_hole_id"], r["rank"]) for r in out.collect()} == want
        assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2  # lengths and pars to each side, no pairs


@pytest.mark.parametrize("budgets", [BASELINE.budgets, {}])
def test_batch_ranks_copies_by_id_and_makes_no_row_a_pair(spark, budgets):
    config = dataclasses.replace(BASELINE, budgets=budgets)
    rng, n = np.random.default_rng(3), 36
    clouds = [{s: rng.uniform(0, 30, (m, 3)) for s, m in (("tee", 3), ("green", 4), ("fairway", 70), *([("bunker", 2)] if i != 1 else []))} for i in range(3)]
    yards = [400.0 + i % 5 * 3 for i in range(n)]
    meta = spark.createDataFrame([(i, f"c{i % 2}", 4 if i != 9 else None, yards[i], True, True, True) for i in range(n)], "hole_id long, course_slug string, par int, yards double, has_tee boolean, has_green boolean, has_fairway boolean")
    rows = [(i, s, *map(float, p)) for i in range(n) for s, ps in clouds[i % 3].items() for p in ps]
    pts = spark.createDataFrame(rows, "hole_id long, surface string, x_lateral_m double, y_down_hole_m double, z_relative_m double")
    best, _ = cloud.batch(meta, pts, config, 4, include_same_course=False)
    sets = {}
    for r in cloud.budgeted(pts, config).collect():
        sets.setdefault((r["hole_id"] % 3, r["surface"]), set()).add((r["x_lateral_m"], r["y_down_hole_m"], 2 * r["z_relative_m"]))
    sets = {k: np.array(sorted(v)) for k, v in sets.items()}

    def total(t, c):
        out = 0.0
        for s, w in config.weights.items():
            a, b = sets.get((t % 3, s)), sets.get((c % 3, s))
            out += 0.0 if a is None and b is None else w * (config.missing[s] if a is None or b is None else cloud.chamfer(a, b))
        return out + abs(yards[t] - yards[c]) * config.yardage_weight

    got = {(r["target_hole_id"], r["rank"]): (r["candidate_hole_id"], r["total_score"]) for r in best.collect()}
    for t in range(n):
        for rank, c in enumerate(sorted((c for c in range(n) if c % 2 != t % 2), key=lambda c: (round(total(t, c), 7), c))[:4]):
            assert got[t, rank + 1][0] == c and got[t, rank + 1][1] == pytest.approx(total(t, c))
    assert len(got) == 4 * n
    assert "EvalPython" not in best._jdf.queryExecution().optimizedPlan().toString()


def test_ward_takes_more_holes_than_a_matrix_of_pairs_would_allow(spark):
    rng = np.random.default_rng(2)
    middles = rng.permutation(np.repeat(np.arange(4), 1300))
    x = rng.normal(0, 0.1, (len(middles), 2)) + 10.0 * middles[:, None]
    out = clusters.ward(spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(x)], "hole_id long, v array<double>"), 4)
    names = {c: n for n, c in enumerate(dict.fromkeys(middles.tolist()))}
    assert [r["agglomerative_cluster"] for r in out.orderBy("hole_id").collect()] == [names[c] for c in middles.tolist()]


def test_points_are_read_once_and_let_go(spark):
    from greenwake.plans import queries as q

    for df in (q._features(spark, "/root/testdata/sf0.001"), q._meta(spark, "/root/testdata/sf0.001"), q.rank_topn(spark, "/root/testdata/sf0.001")):
        assert df.count() and not [f for f in df.inputFiles() if "lineitem" in f]


def test_packed_features_equal_the_aggregates(spark):
    rng = np.random.default_rng(3)
    labels = [*features.LABEL_IDS, "rough", "other", None]
    rows = []
    for hole in range(30):
        for _ in range(int(rng.integers(1, 400))):
            x, y, z = (None if rng.random() < 0.03 else float(v) for v in (np.round(rng.normal(0, 30), rng.integers(0, 10)), rng.uniform(-20, 420), np.round(rng.normal(), 9)))
            rows.append((f"h{hole}", x, float("nan") if rng.random() < 0.01 else y, z, labels[min(int(rng.integers(0, 14 if hole % 3 else 60)), 13) if hole % 3 else (3 if rng.random() < 0.7 else 1)]))
    rows += [("null", None, None, None, None), ("far", 1e9 + 0.123456789, 5e6 + 0.5e-8, 123456.000000015, "green"), ("far", 1e9, 5e6, -0.000000005, "green"), ("far", 1.0, 6e6, 0.000000025, "green"), (None, 1.0, 2.0, 3.0, "green")]
    p = spark.createDataFrame(rows, "hole_id string, x double, y double, z double, label string").repartition(5)
    clean = features.clean_points(p)
    both = features.with_green(clean)
    wanted = both.groupBy("hole_id", "green_y_m").agg(*features.geometry(), *features.elevation(), *features.labels(), *features.zones(), *features.pressure(), *features.shape())
    wanted = {r["hole_id"]: r for r in wanted.join(features.dogleg(both), "hole_id", "left").collect()}
    seen = features.hole_features(p).collect()
    assert sorted(r["hole_id"] for r in seen) == sorted(wanted) and len(seen) == 32
    for r in seen:
        one = wanted[r["hole_id"]].asDict()
        assert set(one) == set(r.asDict()) - {"tee_to_green_elevation_change"}
        for c, v in one.items():
            if c == "z_std" and v is not None:
                assert abs(r[c] - v) <= 1e-9 * max(1, abs(v))
            else:
                assert r[c] == v, (r["hole_id"], c)
    plan = features.hole_features(p)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "percentile" not in plan  # a point meets its hole once, packed


@pytest.mark.parametrize("budgets", [BASELINE.budgets, {"tee": 1, "green": 3, "water": 0}])
def test_picked_points_equal_the_budgeted_ones(spark, budgets):
    config = dataclasses.replace(BASELINE, budgets=budgets)
    rng, rows = np.random.default_rng(11), []
    for hole in range(12):
        for _ in range(int(rng.integers(1, 90))):
            x, y, z = (None if rng.random() < 0.05 else float("nan") if rng.random() < 0.05 else float(np.round(v, 0)) for v in rng.normal(0, 3, 3))
            rows.append((f"h{hole}", str(rng.choice([*BASELINE.surfaces, "trees"])), x, y, z))
    p = spark.createDataFrame([*rows, (None, "tee", 1.0, 2.0, 3.0)], "hole_id string, surface string, x_lateral_m double, y_down_hole_m double, z_relative_m double").repartition(3)
    told = lambda df: {r["hole_id"]: {s: None if r[f"p_{s}"] is None else [None if v is None or np.isnan(v) else v for v in r[f"p_{s}"]] for s in config.surfaces} for r in df.collect()}
    want = told(cloud._sets(cloud.budgeted(p, config), config.scale, config.surfaces).filter("hole_id is not null"))
    got = told(cloud.picked(p, config))
    assert got.pop("h0") == want.pop("h0") and got == {k: v for k, v in want.items() if k in got}
    assert all(v == dict.fromkeys(config.surfaces) for k, v in want.items() if k not in got)
    assert "Window" not in cloud.picked(p, config)._jdf.queryExecution().optimizedPlan().toString()


def test_bounds_spare_most_pairs_and_no_match(monkeypatch):
    rng, n = np.random.default_rng(4), 500
    scale = {"fairway": (50, 500, 20), "green": (50, 10, 20), "bunker": (50, 500, 20), "water": (50, 500, 20), "tee": (50, 500, 20)}

    def cloud_of(i, s):
        if s in ("bunker", "water") and i % 9 == 4 or s == "tee" and i % 50 == 7:
            return None
        p = rng.uniform(0, 1, (BASELINE.budgets[s] - i % 2, 3)) * scale[s]
        if i % 100 == 33:
            p[0, 0] = (np.nan, np.inf)[i // 100 % 2]
        if i == 3:
            p[:, 1] += 1e7
        return p.ravel().tolist()

    yards = rng.uniform(300, 380, n)
    yards[5] = np.nan
    columns = {
        "hole_id": np.arange(n), "course_slug": [f"c{i % 7}" for i in range(n)], "par": pa.array([None if i % 60 == 1 else 4.0 + (i % 4 == 0) for i in range(n)], pa.float64()),
        "yards": pa.array([None if np.isnan(y) else y for y in yards], pa.float64()), "whole": np.arange(n) % 31 != 2, "windowed": np.ones(n, bool), "allowed": np.full(n, 40.0), "delta": rng.uniform(-5, 5, n),
        **{f"p_{s}": pa.array([cloud_of(i, s) for i in range(n)], pa.list_(pa.float64())) for s in BASELINE.surfaces},
    }
    field, judged, chamfers = pa.table(columns), [0], cloud._Cloud.chamfers

    def counted(self, a, at, block=512):
        judged[0] += len(at)
        return chamfers(self, a, at, block)

    monkeypatch.setattr(cloud._Cloud, "chamfers", counted)
    found = pa.Table.from_batches(list(cloud._best(BASELINE, 5, False, True)(field, field))).to_pandas()
    spared = judged[0]
    monkeypatch.setattr(cloud._Bounds, "of", lambda self, rows, cols: np.full((len(rows), len(cols)), -1e9, dtype=np.float32))
    plain = pa.Table.from_batches(list(cloud._best(BASELINE, 5, False, True)(field, field))).to_pandas()
    keys = ["target_hole_id", "candidate_hole_id"]
    assert found.sort_values(keys).reset_index(drop=True).equals(plain.sort_values(keys).reset_index(drop=True))
    assert spared < 0.55 * (judged[0] - spared) and len(found) > 4 * n


def test_two_configurations_are_ranked_once(spark):
    from greenwake.plans import queries as q

    for name in ("config_overlap", "rank_comparison", "shared_all_configs"):
        plan = q.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapGroups" not in plan and "lineitem" not in plan
