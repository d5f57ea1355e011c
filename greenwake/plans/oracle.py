"""The queries of greenwake.plans.queries as SQL for another engine, written independently of the expressions."""

from __future__ import annotations

from greenwake.plans import fixtures

PC = f"WITH pc AS (SELECT hole_id, course_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z, label FROM ({fixtures.duck(fixtures.POINTS)}))"
HOLES = fixtures.duck(fixtures.HOLES)
LABELS = ("unknown", "tee", "green", "fairway", "rough_osm", "bunker", "water", "trees", "cartpath", "sand", "rough_inferred")
ROUGH = "label IN ('rough_osm', 'rough_inferred')"


def _is(label: str) -> str:
    return ROUGH if label == "rough" else f"label = '{label}'"


def _mean(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(18,8))) AS DOUBLE) / nullif(count({x}), 0)"


def _share(cond: str, among: str | None = None) -> str:
    if among is None:
        return f"count(*) FILTER ({cond}) / CAST(count(*) AS DOUBLE)"
    return f"count(*) FILTER ({cond} AND {among}) / CAST(nullif(count(*) FILTER ({among}), 0) AS DOUBLE)"


GREEN = f"gy AS (SELECT hole_id, CASE WHEN count(*) FILTER (label = 'green') >= 3 THEN {_mean("CASE WHEN label = 'green' THEN y END")} ELSE quantile_cont(y, 0.98) END AS green_y_m FROM pc GROUP BY hole_id)"
ZONE = {
    "tee_zone": "(y >= 0 AND y < 75)",
    "drive_zone": "(y >= 175 AND y < 300)",
    "approach_zone": "(y >= greatest(0.0, green_y_m - 175) AND y < green_y_m)",
    "green_complex": "(y >= greatest(0.0, green_y_m - 75) AND y < green_y_m)",
}
BOTH = f"{PC}, {GREEN}, pg AS (SELECT pc.*, green_y_m FROM pc JOIN gy USING (hole_id))"


def _cols(pairs: dict[str, str]) -> str:
    return ", ".join(f"{expr} AS {name}" for name, expr in pairs.items())


GEOMETRY = {
    "x_min": "min(x)", "x_max": "max(x)", "y_min": "min(y)", "y_max": "max(y)", "hole_width_m": "max(x) - min(x)", "hole_depth_m": "max(y) - min(y)",
    "point_count": "count(*)", "valid_point_count": "count(*) FILTER (x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL)",
}
ELEVATION = {
    "z_min": "round(min(z), 6)", "z_max": "round(max(z), 6)", "z_mean": _mean("z"), "z_std": "round(stddev_pop(z), 6)", "z_range": "round(max(z) - min(z), 6)",
    "z_p10": "round(quantile_cont(z, 0.1), 6)", "z_p50": "round(quantile_cont(z, 0.5), 6)", "z_p90": "round(quantile_cont(z, 0.9), 6)",
    "green_relative_elevation": _mean("CASE WHEN label = 'green' THEN z END"),
}
COMPOSITION = {f"{n}_pct": _share(_is(n)) for n in (*LABELS, "rough")}
ZONES = {
    name: expr
    for zone, cond in ZONE.items()
    for name, expr in [
        *[(f"{zone}_{n}_pct", _share(_is(n), cond)) for n in ("fairway", "rough", "trees", "bunker", "water", "sand", "cartpath")],
        (f"{zone}_mean_z", _mean(f"CASE WHEN {cond} THEN z END")),
        (f"{zone}_z_range", f"max(CASE WHEN {cond} THEN z END) - min(CASE WHEN {cond} THEN z END)"),
    ]
}
PRESSURE = {f"{z}_{h}_{side}_pct": _share(f"{_is(h)} AND x {op} 0", ZONE[f"{z}_zone"]) for z in ("drive", "approach") for h in ("trees", "bunker", "water") for side, op in (("left", "<"), ("right", ">"))}


def _fair(zone: str) -> str:
    return f"CASE WHEN label = 'fairway' AND {ZONE[zone]} THEN x END"


SHAPE = {f"fairway_width_{z}": f"CASE WHEN count({_fair(z)}) >= 5 THEN round(quantile_cont({_fair(z)}, 0.95) - quantile_cont({_fair(z)}, 0.05), 6) END" for z in ("drive_zone", "approach_zone")}
SHAPE["fairway_centerline_shift"] = f"round({_mean(_fair('approach_zone'))} - {_mean(_fair('drive_zone'))}, 6)"
DOGLEG = f"""dg AS (SELECT hole_id, round(max(abs(cx)) / max(green_y_m), 6) AS dogleg_score FROM (
 SELECT hole_id, green_y_m, least(11, floor(y / (green_y_m / 12))) AS b, {_mean("x")} AS cx FROM pg
 WHERE label = 'fairway' AND y >= 0 AND y < green_y_m AND hole_id IN (SELECT hole_id FROM pg WHERE label = 'fairway' GROUP BY 1 HAVING count(*) >= 20)
 GROUP BY 1, 2, 3 HAVING count(*) >= 5) GROUP BY hole_id)"""
WIDE_COLS = {n: f"round({e}, 6)" if "count" not in n else e for n, e in {**GEOMETRY, **ELEVATION, **COMPOSITION, **ZONES, **PRESSURE, **SHAPE}.items()}
FEATURES = f"""{BOTH}, {DOGLEG}, wide AS (SELECT hole_id, round(max(green_y_m), 6) AS green_y_m, {_cols(WIDE_COLS)} FROM pg GROUP BY hole_id),
holes AS ({HOLES}), feats AS (SELECT h.hole_id, h.course_slug, h.par, h.hole_length_m, w.* EXCLUDE (hole_id), dogleg_score, green_relative_elevation AS tee_to_green_elevation_change
 FROM holes h JOIN wide w USING (hole_id) LEFT JOIN dg USING (hole_id))"""
MODEL = ("green_y_m", "hole_depth_m", "z_mean", "fairway_pct", "bunker_pct", "water_pct", "trees_pct", "rough_pct", "par", "hole_length_m")


def _knn(on: str = "true", k: int = 5, where: str = "true") -> str:
    d = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in MODEL)
    return f"""knn AS (SELECT query_hole_id, similar_hole_id, round(distance, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_hole_id ORDER BY distance, similar_hole_id) AS rank FROM (
 SELECT a.hole_id AS query_hole_id, b.hole_id AS similar_hole_id, round(sqrt({d}), 9) AS distance FROM feats a JOIN feats b ON a.hole_id <> b.hole_id AND {on} WHERE {where})) WHERE rank <= {k})"""


GUARD = "a.par = b.par AND abs(a.hole_length_m - b.hole_length_m) <= greatest(35.0, a.hole_length_m * CAST(0.12 AS DOUBLE))"
ORACLE: dict[str, str] = {
    "hole_geometry": f"{PC} SELECT hole_id, {_cols(GEOMETRY)} FROM pc GROUP BY hole_id",
    "hole_elevation": f"{PC} SELECT hole_id, {_cols(ELEVATION)} FROM pc GROUP BY hole_id",
    "green_y": f"{PC}, {GREEN} SELECT * FROM gy",
    "label_composition": f"{PC} SELECT hole_id, {_cols(COMPOSITION)} FROM pc GROUP BY hole_id",
    "zone_blocks": f"{BOTH} SELECT hole_id, {_cols(ZONES)} FROM pg GROUP BY hole_id",
    "lr_pressure": f"{BOTH} SELECT hole_id, {_cols(PRESSURE)} FROM pg GROUP BY hole_id",
    "fairway_width_shift": f"{BOTH} SELECT hole_id, {_cols(SHAPE)} FROM pg GROUP BY hole_id",
    "dogleg": f"{BOTH}, {DOGLEG} SELECT * FROM dg",
    "hole_features_wide": f"{FEATURES} SELECT * FROM feats",
    "label_counts_sql": f"{PC} SELECT label, count(*) AS n FROM pc GROUP BY label",
    "knn_v1": f"{FEATURES}, {_knn()} SELECT * FROM knn",
    "knn_cross_course": f"{FEATURES}, {_knn('a.course_slug <> b.course_slug')} SELECT * FROM knn",
    "knn_same_par": f"{FEATURES}, {_knn('a.par = b.par')} SELECT * FROM knn",
    "knn_length_guard": f"{FEATURES}, {_knn(GUARD)} SELECT * FROM knn",
    "knn_single_hole": f"{FEATURES}, {_knn(where='a.hole_id = 7')} SELECT * FROM knn",
    "knn_pair_columns": f"""{FEATURES}, {_knn(GUARD)} SELECT knn.*, round(q.hole_length_m, 2) AS query_length_m, round(s.hole_length_m, 2) AS similar_length_m, round(abs(round(q.hole_length_m, 2) - round(s.hole_length_m, 2)), 2) AS length_diff_m,
 coalesce(q.par = s.par, false) AS same_par, coalesce(q.course_slug = s.course_slug, false) AS same_course FROM knn LEFT JOIN feats q ON query_hole_id = q.hole_id LEFT JOIN feats s ON similar_hole_id = s.hole_id""",
    "emb_knn": """SELECT query_hole_id, similar_hole_id, round(distance, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_hole_id ORDER BY distance, similar_hole_id) AS rank FROM (
 SELECT a.vec_id AS query_hole_id, b.vec_id AS similar_hole_id, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)) WHERE rank <= 3""",
    "dataset_counts": f"SELECT count(DISTINCT course_slug) AS courses, count(DISTINCT hole_id) AS holes, count(*) AS rows FROM ({HOLES})",
    "course_rollup": f"SELECT course_slug, count(*) AS holes, sum(hole_length_m) AS length_m, sum(hole_length_m * 2) AS length_yd, sum(par) AS par, string_agg(CAST(hole_id AS VARCHAR), ',' ORDER BY hole_id) AS hole_ids FROM ({HOLES}) GROUP BY 1",
    "ref_tokens": """SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(ref, '[0-9]+'), lambda x: CAST(CAST(x AS INT) AS VARCHAR)), ',') AS tokens, CAST(regexp_extract_all(ref, '[0-9]+')[1] AS INT) AS hole_number FROM (
 SELECT p_partkey, concat_ws('; ', CAST(p_partkey % 30 AS VARCHAR), CASE WHEN p_partkey % 4 = 0 THEN CAST(p_partkey % 18 AS VARCHAR) END) AS ref FROM part)""",
    "layer_resolution": """SELECT CASE p_partkey % 8 WHEN 0 THEN 'bunkers' WHEN 1 THEN 'greens' WHEN 2 THEN 'water' WHEN 3 THEN 'sand' WHEN 4 THEN 'trees' WHEN 5 THEN 'cartpaths' WHEN 6 THEN 'water' END AS canonical_layer, count(*) AS n FROM part GROUP BY 1""",
    "hole_dedupe": """SELECT course_slug, hole_number, inside, length_m, dist_center FROM (SELECT *, row_number() OVER (PARTITION BY course_slug, hole_number ORDER BY inside DESC, length_m DESC, dist_center) AS r FROM (
 SELECT CAST(o_custkey % 50 AS VARCHAR) AS course_slug, CAST(o_orderkey % 20 AS INT) AS hole_number, o_orderkey % 3 > 0 AS inside, CAST(o_totalprice AS DOUBLE) AS length_m, CAST(o_orderkey AS DOUBLE) AS dist_center FROM orders) WHERE hole_number BETWEEN 1 AND 18) WHERE r = 1""",
    "hole_report": """WITH h AS (SELECT DISTINCT CAST(o_custkey % 50 AS VARCHAR) AS course_slug, CAST(o_orderkey % 20 AS INT) AS n FROM orders), k AS (SELECT course_slug, list(n) AS have, count(*) AS detected FROM h WHERE n BETWEEN 1 AND 18 GROUP BY 1)
 SELECT course_slug, detected, array_to_string(list_filter(range(1, 19), lambda x: NOT list_contains(have, x)), ',') AS missing, CAST(0 AS BIGINT) AS rejected, detected = 18 AS is_clean FROM k""",
    "boundary_pick": """SELECT course_slug, id, area_m2, candidate_count, 'scoring' AS selection_method, false AS fallback_used FROM (SELECT *, count(*) OVER (PARTITION BY course_slug) AS candidate_count, row_number() OVER (PARTITION BY course_slug ORDER BY dist, area_m2 DESC, id) AS r FROM (
 SELECT CAST(o_custkey % 50 AS VARCHAR) AS course_slug, o_orderkey AS id, o_orderkey % 7 AS dist, CAST(o_totalprice AS DOUBLE) AS area_m2 FROM orders)) WHERE r = 1""",
    "align_transform": f"""{PC}, a AS (SELECT atan2(30.0, 40.0) AS t) SELECT hole_id, round((x - 1) * cos(t) - (y - 2) * sin(t), 6) AS ax, round((x - 1) * sin(t) + (y - 2) * cos(t), 6) AS ay FROM pc, a""",
    "nearest_centerline": f"""{PC}, p AS (SELECT DISTINCT hole_id, x, y FROM pc), l AS (SELECT * FROM (VALUES (1, 0.0), (2, 10.0), (3, -10.0)) AS t(n, cx)),
 d AS (SELECT hole_id, x, y, n, round(sqrt((x - cx) * (x - cx) + (y - greatest(0.0, least(300.0, y))) * (y - greatest(0.0, least(300.0, y)))), 6) AS d FROM p, l),
 m AS (SELECT *, row_number() OVER (PARTITION BY hole_id, x, y ORDER BY d, n) AS r FROM d)
 SELECT hole_id, n AS nearest, count(*) AS n, max(d) AS farthest FROM m WHERE r = 1 GROUP BY hole_id, m.n""",
    "point_in_polygon_label": f"""{PC}, p AS (SELECT row_number() OVER () AS id, x + 50.25 AS x, y / 5 + 0.125 AS y FROM pc), e AS ({fixtures.EDGES}),
 hit AS (SELECT id, label, priority FROM p JOIN e ON (y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * (x2 - x1) / nullif(CAST(y2 - y1 AS DOUBLE), 0) GROUP BY ALL HAVING count(*) % 2 = 1),
 best AS (SELECT id, arg_min(label, priority) AS label FROM hit GROUP BY id)
 SELECT coalesce(label, 'rough_inferred') AS label, CASE label WHEN 'green' THEN 2 WHEN 'bunker' THEN 5 WHEN 'fairway' THEN 3 ELSE 10 END AS label_id, CASE WHEN label IS NULL THEN 'inferred:background' ELSE 'osm:golf=' || label END AS source,
 CASE WHEN label IS NULL THEN CAST(0.4 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END AS confidence, count(*) AS n FROM p LEFT JOIN best USING (id) GROUP BY best.label""",
    "even_subsample_points": f"""{PC}, t AS (SELECT hole_id, x, y, z, row_number() OVER (PARTITION BY hole_id ORDER BY x, y, z) - 1 AS i, count(*) OVER (PARTITION BY hole_id) AS n FROM pc WHERE label = 'tee')
 SELECT hole_id, x, y, z FROM t WHERE n <= 10 OR EXISTS (SELECT 1 FROM range(10) AS g(j) WHERE floor(j * (n - 1) / CAST(9 AS DOUBLE)) = i)""",
    "label_mode_by_course": f"""{PC}, n AS (SELECT course_id, label, count(*) AS n FROM pc GROUP BY 1, 2) SELECT course_id, label, n, labels, points FROM (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY n DESC, label) AS r, count(*) OVER (PARTITION BY course_id) AS labels, CAST(sum(n) OVER (PARTITION BY course_id) AS BIGINT) AS points FROM n) WHERE r = 1""",
    "json_compact_roundtrip": f"""{PC} SELECT hole_id, x, y, z, CASE label WHEN 'tee' THEN 1 ELSE 2 END AS label_id, label FROM pc WHERE label IN ('tee', 'green')""",
    "quality_flags": f"""{PC}, e AS (SELECT hole_id, round(quantile_cont(z, 0.5), 6) AS m, round(max(z), 6) AS hi, round(min(z), 6) AS lo FROM pc GROUP BY 1), q AS (SELECT hole_id, concat_ws(';', CASE WHEN m > 0 THEN 'COARSE_DEM_RESOLUTION' END, CASE WHEN hi > 4 THEN 'SLOPE_OUTLIER' END, CASE WHEN lo < -4.5 THEN 'LOW_DEM_COVERAGE' END) AS quality_flags FROM e)
 SELECT * FROM q WHERE quality_flags <> ''""",
    "feature_comparison": f"""{FEATURES} SELECT a.feature, a.v AS query_value, b.v AS match_value, round(b.v - a.v, 3) AS difference FROM
 (SELECT feature, v FROM (UNPIVOT (SELECT CAST(green_y_m AS DOUBLE) AS green_y_m, hole_length_m, CAST(point_count AS DOUBLE) AS point_count, CAST(par AS DOUBLE) AS par FROM feats WHERE hole_id = 1) ON COLUMNS(*) INTO NAME feature VALUE v)) a JOIN
 (SELECT feature, v FROM (UNPIVOT (SELECT CAST(green_y_m AS DOUBLE) AS green_y_m, hole_length_m, CAST(point_count AS DOUBLE) AS point_count, CAST(par AS DOUBLE) AS par FROM feats WHERE hole_id = 2) ON COLUMNS(*) INTO NAME feature VALUE v)) b USING (feature)""",
    "feature_missing_summary": f"""{FEATURES}, j AS (SELECT green_y_m, z_mean, dogleg_score, fairway_width_drive_zone, drive_zone_mean_z, h.par FROM holes h LEFT JOIN feats f USING (hole_id)) """
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) - count({c}) AS missing_count, (count(*) - count({c})) / CAST(count(*) AS DOUBLE) AS missing_fraction FROM j" for c in ("green_y_m", "z_mean", "dogleg_score", "fairway_width_drive_zone", "drive_zone_mean_z", "par")),
    "standardised_matrix": f"{FEATURES} "
    + " UNION ALL ".join(
        f"SELECT hole_id, '{c}' AS feature, round((coalesce({c}, m) - a) / s * {w}, 5) AS value FROM feats, (SELECT median({c}) AS m FROM feats), (SELECT {_mean(c)} AS a, stddev_pop({c}) AS s FROM feats)"
        for c, w in (("green_y_m", "CAST(1 AS DOUBLE)"), ("z_mean", "CAST(1 AS DOUBLE)"), ("hole_length_m", "CAST(4 AS DOUBLE)"))
    ),
}

GRID = "g AS (SELECT CAST(i // 80 AS INT) AS \"row\", CAST(i % 80 AS INT) AS col, CASE WHEN i % 97 = 5 THEN NULL ELSE 100 + (i // 80) * (i // 80) * CAST(0.01 AS DOUBLE) + (i % 80) * CAST(0.2 AS DOUBLE) END AS z FROM range(4800) AS t(i))"


def _gradient(by: str, over: str) -> str:
    w = f"OVER (PARTITION BY {by} ORDER BY {over})"
    edge = {"col": 79, '"row"': 59}[over]
    return f"CASE WHEN {over} = 0 THEN lead(z) {w} - z WHEN {over} = {edge} THEN z - lag(z) {w} ELSE (lead(z) {w} - lag(z) {w}) / 2 END / 5"


ROW = '"row"'
ORACLE |= {
    "slope_grid": f"""WITH {GRID}, s AS (SELECT {ROW}, col, {_gradient(ROW, "col")} AS dx, {_gradient("col", ROW)} AS dy FROM g) SELECT {ROW}, col, round(sqrt(dx * dx + dy * dy) * 100, 6) AS slope_pct, round(degrees(atan(sqrt(dx * dx + dy * dy))), 6) AS slope_deg FROM s""",
    "cell_centers": f"""WITH {GRID} SELECT {ROW}, col, 1000 + (col + CAST(0.5 AS DOUBLE)) * 5 AS x, 2000 - ({ROW} + CAST(0.5 AS DOUBLE)) * 5 AS y, round(z, 6) AS z FROM g WHERE {ROW} % 3 = 0 AND col % 3 = 0 AND z IS NOT NULL""",
    "raster_sample": f"""WITH {GRID}, p AS (SELECT i AS id, i * CAST(0.77 AS DOUBLE) AS dx, i * CAST(0.53 AS DOUBLE) AS dy FROM range(500) AS t(i)) SELECT id, round(z, 6) AS z FROM p LEFT JOIN g ON col = floor((1000 + dx - 1000) / 5) AND {ROW} = floor((2000 - dy - 2000) / -5)""",
    "terrain_summary": f"""WITH {GRID} SELECT CAST({ROW} // 10 AS INT) AS hole_id, count(z) AS cell_count, round(min(z), 6) AS min_elevation_m, round(max(z), 6) AS max_elevation_m, round(avg(z), 6) AS mean_elevation_m FROM g GROUP BY 1""",
    "elevation_profile": f"""WITH {GRID} SELECT 1 AS hole_id, CAST(i AS INT) AS i, round(1002.5 + i * 200 / CAST(199 AS DOUBLE), 6) AS x, CAST(1997.5 AS DOUBLE) AS y, round(z, 6) AS z FROM range(200) AS t(i) LEFT JOIN g ON {ROW} = 0 AND col = floor((2.5 + i * 200 / CAST(199 AS DOUBLE)) / 5)""",
    "raster_reproject": """WITH t AS (SELECT CAST(i // 40 AS INT) AS "row", CAST(i % 40 AS INT) AS col, (i % 40 + CAST(0.5 AS DOUBLE)) / 2 - 0.5 AS u, (i // 40 + CAST(0.5 AS DOUBLE)) / 2 - 0.5 AS v FROM range(1600) AS t(i))
 SELECT "row", col, CASE WHEN u < 0 OR v < 0 OR u > 19 OR v > 19 THEN NULL ELSE round(3 * v + 2 * u, 6) END AS z FROM t""",
    "utm_roundtrip": """SELECT i AS id, CAST(least(60, floor((lon + 180) / 6) + 1) AS INT) AS zone, true AS lon_ok, true AS lat_ok FROM (SELECT i, i % 20 * CAST(17.3 AS DOUBLE) - 170 AS lon FROM range(400) AS t(i))""",
}

_META = f"""{PC}, has AS (SELECT hole_id, {", ".join(f"bool_or(label = '{s}') AS has_{s}" for s in ("tee", "green", "fairway"))} FROM pc GROUP BY hole_id),
 meta AS (SELECT h.hole_id, h.par, h.hole_length_m * CAST(1.09361 AS DOUBLE) AS yards, CAST(h.hole_id % 7 AS DOUBLE) AS delta, has_tee AND has_green AND has_fairway AS complete FROM ({HOLES}) h JOIN has USING (hole_id)),
 cand AS (SELECT t.hole_id AS target_hole_id, c.hole_id AS candidate_hole_id, CASE WHEN t.par <> c.par THEN 'DIFFERENT_PAR' WHEN NOT (t.complete AND c.complete) THEN 'MISSING_REQUIRED_SURFACE'
  WHEN abs(c.yards - t.yards) > greatest(CASE t.par WHEN 3 THEN 25 WHEN 4 THEN 40 ELSE 60 END, t.yards * CASE t.par WHEN 3 THEN CAST(0.12 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END) THEN 'YARDAGE_TOO_DIFFERENT' ELSE 'PASS' END AS filter_reason,
  abs(t.yards - c.yards) * CAST(0.15 AS DOUBLE) AS yp, abs(t.delta - c.delta) * CAST(0.1 AS DOUBLE) AS ep FROM meta t JOIN meta c ON t.hole_id <> c.hole_id)"""
_BUDGET = {"fairway": 12, "green": 8, "bunker": 8, "water": 8, "tee": 6}
_PENALTY = {"fairway": 999, "green": 999, "bunker": 40, "water": 50, "tee": 999}
_WEIGHTS = {"baseline": {"fairway": 0.30, "green": 0.25, "bunker": 0.25, "water": 0.15, "tee": 0.05}, "hazard": {"fairway": 0.15, "green": 0.15, "bunker": 0.35, "water": 0.30, "tee": 0.05}}
_CHAMFER = f"""{_META}, b AS (SELECT *, CASE label {" ".join(f"WHEN '{s}' THEN {n}" for s, n in _BUDGET.items())} END AS budget FROM pc),
 o AS (SELECT hole_id, label, x, y, z * 2 AS z, budget, row_number() OVER (PARTITION BY hole_id, label ORDER BY x, y, z) - 1 AS i, count(*) OVER (PARTITION BY hole_id, label) AS n FROM b WHERE budget IS NOT NULL),
 s AS (SELECT * FROM o WHERE n <= budget OR EXISTS (SELECT 1 FROM range(12) AS g(j) WHERE j < budget AND floor(j * (n - 1) / CAST(budget - 1 AS DOUBLE)) = i)),
 pr AS (SELECT * FROM cand WHERE filter_reason = 'PASS'),
 dd AS (SELECT target_hole_id, candidate_hole_id, p.label, p.i AS pi, q.i AS qi, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)) AS d FROM pr JOIN s p ON p.hole_id = target_hole_id JOIN s q ON q.hole_id = candidate_hole_id AND q.label = p.label),
 ch AS (SELECT * FROM (SELECT target_hole_id, candidate_hole_id, label, avg(m) AS ab FROM (SELECT target_hole_id, candidate_hole_id, label, pi, min(d) AS m FROM dd GROUP BY ALL) GROUP BY ALL)
  JOIN (SELECT target_hole_id, candidate_hole_id, label, avg(m) AS ba FROM (SELECT target_hole_id, candidate_hole_id, label, qi, min(d) AS m FROM dd GROUP BY ALL) GROUP BY ALL) USING (target_hole_id, candidate_hole_id, label))"""
_SURF = ("fairway", "green", "bunker", "water", "tee")


def _weighted(config: str, s: str) -> str:
    return f"coalesce({s}_score * CAST({_WEIGHTS[config][s]} AS DOUBLE), 0)"


def _results(config: str) -> str:
    return f"""res_{config} AS (SELECT *, row_number() OVER (PARTITION BY target_hole_id ORDER BY total_score, candidate_hole_id) AS rank FROM (SELECT '{config}' AS config_name, target_hole_id, candidate_hole_id, filter_reason,
 {" + ".join(_weighted(config, s) for s in _SURF)} + yp + ep AS total_score, yp AS yardage_penalty, ep AS elevation_penalty,
 {" + ".join(f"CASE WHEN {s}_lost THEN {_weighted(config, s)} ELSE 0 END" for s in _SURF)} AS missing_surface_penalty, {", ".join(f"{s}_score" for s in _SURF)} FROM sc) QUALIFY rank <= 5)"""


_SCORE = f"""{_CHAMFER}, hs AS (SELECT DISTINCT hole_id, label FROM s),
 lg AS (SELECT pr.target_hole_id, pr.candidate_hole_id, l.label, (a.label IS NULL) <> (c.label IS NULL) AS lost, CASE WHEN a.label IS NULL AND c.label IS NULL THEN NULL WHEN a.label IS NULL OR c.label IS NULL THEN CASE l.label {" ".join(f"WHEN '{s}' THEN {n}" for s, n in _PENALTY.items())} END ELSE (ab + ba) / 2 END AS score
  FROM pr CROSS JOIN (SELECT unnest({list(_SURF)!r}) AS label) l LEFT JOIN hs a ON a.hole_id = pr.target_hole_id AND a.label = l.label LEFT JOIN hs c ON c.hole_id = pr.candidate_hole_id AND c.label = l.label LEFT JOIN ch ON ch.target_hole_id = pr.target_hole_id AND ch.candidate_hole_id = pr.candidate_hole_id AND ch.label = l.label),
 sc AS (SELECT pr.*, w.* EXCLUDE (target_hole_id, candidate_hole_id) FROM pr JOIN (SELECT target_hole_id, candidate_hole_id, {", ".join(f"max(score) FILTER (label = '{s}') AS {s}_score, coalesce(bool_or(lost) FILTER (label = '{s}'), false) AS {s}_lost" for s in _SURF)} FROM lg GROUP BY ALL) w USING (target_hole_id, candidate_hole_id)),
 {_results("baseline")}, {_results("hazard")}, two AS (SELECT * FROM res_baseline UNION ALL SELECT * FROM res_hazard)"""
_NAMES = ("yardage", "elevation")
_PARTS = f"""parts AS (SELECT target_hole_id, candidate_hole_id, total_score, {", ".join(f"{_weighted('baseline', s)} AS contrib_{s}" for s in _SURF)}, yardage_penalty AS contrib_yardage, elevation_penalty AS contrib_elevation FROM res_baseline),
 tot AS (SELECT *, {" + ".join(f"contrib_{n}" for n in (*_SURF, *_NAMES))} AS recomputed_total FROM parts),
 sh AS (SELECT *, {", ".join(f"coalesce(contrib_{n} / nullif(recomputed_total, 0), 0) AS share_{n}" for n in (*_SURF, *_NAMES))} FROM tot)"""
_LOST = " + ".join(f"CASE WHEN abs(contrib_{s} - {_WEIGHTS['baseline'][s] * _PENALTY[s]}) <= 1e-6 + 1e-6 * {_WEIGHTS['baseline'][s] * _PENALTY[s]} THEN contrib_{s} ELSE 0 END" for s in _SURF)
_SUM = " + ".join(f"contrib_{s}" for s in _SURF)

ORACLE |= {
    "candidate_filter": f"{_META} SELECT target_hole_id, candidate_hole_id, filter_reason FROM cand",
    "filter_summary": f"{_META} SELECT filter_reason, count(*) AS n FROM cand GROUP BY 1",
    "chamfer_tee": f"{_CHAMFER} SELECT target_hole_id, candidate_hole_id, round((ab + ba) / 2, 6) AS chamfer FROM ch WHERE label = 'tee'",
    "pair_score": f"{_SCORE} SELECT config_name, target_hole_id, candidate_hole_id, filter_reason, rank, {', '.join(f'round({c}, 5) AS {c}' for c in ('total_score', 'yardage_penalty', 'elevation_penalty', 'missing_surface_penalty', *[f'{s}_score' for s in _SURF]))} FROM res_baseline",
    "rank_topn": f"{_SCORE} SELECT target_hole_id, candidate_hole_id, rank, round(total_score, 5) AS total_score FROM res_baseline",
    "config_overlap": f"""{_SCORE}, k AS (SELECT target_hole_id, config_name, list(CAST(candidate_hole_id AS VARCHAR)) AS s FROM two GROUP BY ALL), j AS (SELECT a.target_hole_id, a.config_name AS config_a, b.config_name AS config_b, list_sort(list_intersect(a.s, b.s)) AS i, len(list_distinct(list_concat(a.s, b.s))) AS u FROM k a JOIN k b ON a.target_hole_id = b.target_hole_id AND a.config_name < b.config_name)
 SELECT target_hole_id, config_a, config_b, 5 AS top_n, CAST(len(i) AS INT) AS overlap_count, CAST(u AS INT) AS union_count, round(len(i) / CAST(u AS DOUBLE), 6) AS jaccard_similarity, array_to_string(i, '|') AS shared_candidates FROM j""",
    "rank_comparison": f"""{_SCORE} SELECT target_hole_id, candidate_hole_id, {", ".join(f"max(rank) FILTER (config_name = '{c}') AS rank_{c}, round(max(total_score) FILTER (config_name = '{c}'), 5) AS total_score_{c}" for c in _WEIGHTS)}, count(*) AS configs_present_count, min(rank) AS best_rank, max(rank) AS worst_rank, max(rank) - min(rank) AS rank_spread FROM two GROUP BY 1, 2""",
    "shared_all_configs": f"{_SCORE} SELECT target_hole_id, candidate_hole_id FROM two GROUP BY 1, 2 HAVING count(*) = 2",
    "calibration_components": f"{_SCORE}, {_PARTS} SELECT target_hole_id, candidate_hole_id, {', '.join(f'round({c}, 5) AS {c}' for c in ('total_score', 'recomputed_total', *[f'{k}_{n}' for k in ('contrib', 'share') for n in (*_SURF, *_NAMES)]))} FROM sh",
    "calibration_summary": f"""{_SCORE}, {_PARTS}, c AS (SELECT count(*) AS n_pairs, {", ".join(f"round(avg(share_{n}), 5) AS mean_share_{n}" for n in (*_SURF, *_NAMES))}, round(avg(CASE WHEN coalesce(({_LOST}) / nullif(recomputed_total, 0), 0) > 0.5 THEN 1 ELSE 0 END), 5) AS missing_surface_dominant_fraction,
 round(avg(CASE WHEN coalesce((contrib_yardage + contrib_elevation) / nullif(recomputed_total, 0), 0) > 0.5 THEN 1 ELSE 0 END), 5) AS penalty_dominant_fraction, round(corr(contrib_elevation, {_SUM}), 5) AS elevation_correlation FROM sh)
 SELECT *, missing_surface_dominant_fraction > 0.25 AS missing_penalties_may_dominate, penalty_dominant_fraction > 0.25 AS penalties_may_dominate, coalesce(elevation_correlation > 0.5, false) AS elevation_possibly_double_counted FROM c""",
}

_SETS = {
    "off_the_tee": ["hole_length_m", "par", *[f"drive_zone_{x}_pct" for x in ("fairway", "trees", "bunker", "water")], *[f"drive_{h}_{s}_pct" for h in ("trees", "bunker", "water") for s in ("left", "right")], "fairway_width_drive_zone", "dogleg_score", "fairway_centerline_shift"],
    "approach": [*[f"approach_zone_{x}_pct" for x in ("fairway", "trees", "bunker", "water")], *[f"approach_{h}_{s}_pct" for h in ("trees", "bunker", "water") for s in ("left", "right")], "fairway_width_approach_zone", "tee_to_green_elevation_change", "green_relative_elevation"],
    "green_complex": ["green_pct", *[f"green_complex_{x}_pct" for x in ("trees", "bunker", "water")], "green_complex_mean_z", "green_complex_z_range", "green_relative_elevation", "tee_to_green_elevation_change"],
    "hazard": [*[f"{h}_pct" for h in ("trees", "bunker", "water", "sand")], *[f"{z}_{h}_pct" for z in ("drive_zone", "approach_zone", "green_complex") for h in ("trees", "bunker", "water")], *[f"{z}_{h}_{s}_pct" for z in ("drive", "approach") for h in ("trees", "bunker", "water") for s in ("left", "right")]],
    "shot_shape": ["dogleg_score", "fairway_centerline_shift", "hole_width_m", "hole_depth_m", "fairway_width_drive_zone", "fairway_width_approach_zone", "x_min", "x_max", "y_min", "y_max"],
    "terrain": [*[f"z_{x}" for x in ("min", "max", "mean", "std", "range", "p10", "p50", "p90")], "tee_to_green_elevation_change", "green_relative_elevation", *[f"{z}_{x}" for z in ("tee_zone", "drive_zone", "approach_zone", "green_complex") for x in ("mean_z", "z_range")]],
}
_ALL = [c for c in (*WIDE_COLS, "green_y_m", "dogleg_score", "tee_to_green_elevation_change", "par", "hole_length_m")]
_HEAVY = {"hole_length_m": 4.0, "hole_depth_m": 2.0, "green_y_m": 3.0, "par": 2.0, "fairway_width_drive_zone": 1.5, "fairway_width_approach_zone": 1.5, "tee_to_green_elevation_change": 1.5, "rough_pct": 0.5, "rough_inferred_pct": 0.5}


def _mode_sql(name: str, columns: list[str], weights: dict[str, float], on: str) -> str:
    med = ", ".join(f"median({c}) AS m_{c}" for c in columns)
    fill = ", ".join(f"coalesce(CAST({c} AS DOUBLE), m_{c}, 0) AS {c}" for c in columns)
    stat = ", ".join(f"{_mean(c)} AS a_{c}, CASE WHEN stddev_pop({c}) > 1e-12 THEN stddev_pop({c}) ELSE 1 END AS s_{c}" for c in columns)
    z = ", ".join(f"({c} - a_{c}) / s_{c} * CAST({weights.get(c, 1.0)} AS DOUBLE) AS {c}" for c in columns)
    d = " + ".join(f"(p.{c} - q.{c}) * (p.{c} - q.{c})" for c in columns)
    return f"""{FEATURES}, md AS (SELECT {med} FROM feats), fi AS (SELECT hole_id, {fill} FROM feats, md), st AS (SELECT {stat} FROM fi), zz AS (SELECT hole_id, {z} FROM fi, st)
 SELECT query_hole_id, similar_hole_id, round(distance, 5) AS distance, rank, '{name}' AS similarity_mode FROM (SELECT *, row_number() OVER (PARTITION BY query_hole_id ORDER BY distance, similar_hole_id) AS rank FROM (
 SELECT p.hole_id AS query_hole_id, q.hole_id AS similar_hole_id, round(sqrt({d}), 9) AS distance FROM zz p JOIN zz q ON p.hole_id <> q.hole_id JOIN feats a ON a.hole_id = p.hole_id JOIN feats b ON b.hole_id = q.hole_id AND {on})) WHERE rank <= 5"""


ORACLE |= {f"knn_mode_{n}": _mode_sql(n, c, {}, "true") for n, c in _SETS.items()}
ORACLE |= {
    "knn_mode_v1": _mode_sql("v1", _ALL, {}, "true"),
    "knn_mode_length_weighted": _mode_sql("length_weighted", _ALL, _HEAVY, "true"),
    "knn_mode_same_par_length_guarded": _mode_sql("same_par_length_guarded", _ALL, _HEAVY, GUARD),
    "knn_mode_overall_v2": _mode_sql("overall_v2", _ALL, _HEAVY, GUARD),
    "knn_mode_cross_course_same_par_length_guarded": _mode_sql("cross_course_same_par_length_guarded", _ALL, _HEAVY, f"{GUARD} AND a.course_slug <> b.course_slug"),
}

_W = ("water_pct", "drive_zone_water_pct", "approach_zone_water_pct", "green_complex_water_pct")
_G = ("hole_width_m", "hole_depth_m", "green_y_m", "dogleg_score", "fairway_centerline_shift")


def _avg(terms: list[str]) -> str:
    return f"list_sum(list_filter([{', '.join(terms)}], lambda x: x IS NOT NULL)) / nullif(len(list_filter([{', '.join(terms)}], lambda x: x IS NOT NULL)), 0)"


_FLAGS = f"""{FEATURES}, {_knn()}, raw AS (SELECT knn.query_hole_id, knn.similar_hole_id, knn.rank, knn.distance, q.course_slug AS query_course_slug, c.course_slug AS similar_course_slug, q.hole_length_m AS query_length_m, c.hole_length_m AS similar_length_m,
 abs(q.hole_length_m - c.hole_length_m) AS gap, abs(q.hole_length_m - c.hole_length_m) / nullif(q.hole_length_m, 0) AS part, q.par = c.par AS same_par, q.course_slug = c.course_slug AS same_course,
 list_max([{", ".join(f"abs(q.{c} - c.{c})" for c in _W)}]) AS water, {_avg([f"abs(q.{c} - c.{c})" for c in ("bunker_pct", "water_pct", "trees_pct")])} AS hazard,
 {_avg([f"CASE WHEN abs(q.{c}) + abs(c.{c}) < 1e-9 THEN 0 ELSE abs(q.{c} - c.{c}) / nullif(abs(q.{c}) + abs(c.{c}), 0) END" for c in _G])} AS shape FROM knn JOIN feats q ON query_hole_id = q.hole_id JOIN feats c ON similar_hole_id = c.hole_id),
 fl AS (SELECT *, NOT same_par AS par_mismatch, gap > 55 OR part > CAST(0.15 AS DOUBLE) AS length_mismatch, coalesce(water > CAST(0.08 AS DOUBLE), false) AS water_mismatch, coalesce(hazard > CAST(0.12 AS DOUBLE), false) AS hazard_mismatch, coalesce(shape > CAST(0.45 AS DOUBLE), false) AS geometry_mismatch FROM raw),
 pl AS (SELECT query_hole_id, similar_hole_id, rank, distance, query_course_slug, similar_course_slug, query_length_m, similar_length_m, round(gap, 2) AS length_diff_m, round(part, 4) AS length_diff_pct, same_par, same_course, par_mismatch, length_mismatch, water_mismatch, hazard_mismatch, geometry_mismatch,
 round(water, 4) AS water_diff, round(hazard, 4) AS hazard_diff, round(shape, 4) AS geometry_mismatch_score, same_course AS same_course_violation,
 CAST(par_mismatch AS INT) + CAST(length_mismatch AS INT) + CAST(same_course AS INT) + CAST(water_mismatch AS INT) + CAST(hazard_mismatch AS INT) + CAST(geometry_mismatch AS INT) AS presentable_bad_flag_count,
 greatest(CAST(0 AS DOUBLE), round(1 - (CASE WHEN par_mismatch THEN CAST(0.4 AS DOUBLE) ELSE 0 END + CASE WHEN length_mismatch THEN CAST(0.3 AS DOUBLE) ELSE 0 END + CASE WHEN same_course THEN CAST(0.2 AS DOUBLE) ELSE 0 END + CASE WHEN water_mismatch THEN CAST(0.15 AS DOUBLE) ELSE 0 END + CASE WHEN hazard_mismatch THEN CAST(0.15 AS DOUBLE) ELSE 0 END + CASE WHEN geometry_mismatch THEN CAST(0.15 AS DOUBLE) ELSE 0 END), 6)) AS plausibility_score,
 coalesce(nullif(concat_ws('; ', CASE WHEN same_course THEN 'same course' END, CASE WHEN par_mismatch THEN 'different par' END, CASE WHEN length_mismatch THEN 'length diff ' || printf('%.1f', round(gap, 2)) || 'm' END, CASE WHEN water_mismatch THEN 'water profile mismatch' END, CASE WHEN hazard_mismatch THEN 'hazard profile mismatch' END, CASE WHEN geometry_mismatch THEN 'geometry mismatch' END), ''), 'ok') AS plausibility_reasons FROM fl)"""
ORACLE |= {
    "plausibility_flags": f"{_FLAGS} SELECT * EXCLUDE (distance) FROM pl",
    "presented_similarity": f"""{_FLAGS} SELECT query_hole_id, similar_hole_id, rank AS raw_rank, plausibility_score, plausibility_reasons, row_number() OVER (PARTITION BY query_hole_id ORDER BY plausibility_score DESC, distance, similar_hole_id) AS presented_rank FROM pl WHERE plausibility_score >= 0.75 AND same_par AND NOT same_course QUALIFY presented_rank <= 10""",
    "curated_ids": f"""{FEATURES}, {_knn(GUARD)}, f AS (SELECT min(hole_id) AS h FROM feats), p AS (SELECT h AS hole_id, 0 AS priority FROM f UNION ALL SELECT similar_hole_id, CAST(rank AS INT) FROM knn, f WHERE query_hole_id = h AND rank <= 4
 UNION ALL SELECT * FROM (SELECT hole_id, 100 FROM feats WHERE par = 3 ORDER BY hole_length_m, hole_id LIMIT 1) UNION ALL SELECT * FROM (SELECT hole_id, 101 FROM feats ORDER BY water_pct DESC, hole_id LIMIT 1) UNION ALL SELECT * FROM (SELECT hole_id, 102 FROM feats ORDER BY z_range DESC, hole_id LIMIT 1))
 SELECT hole_id, min(priority) AS priority FROM p GROUP BY 1""",
}

_BOX = """f AS (SELECT CAST(p_partkey AS INT) AS feature_id, CAST(p_partkey % 25 AS VARCHAR) AS course_slug, (['tees', 'greens', 'fairways', 'bunkers', 'water', 'trees', 'cartpaths'])[CAST(p_partkey % 7 AS INT) + 1] AS canonical_layer,
  CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 3 + 1 END AS ref, CAST(p_partkey % 13 * 10 - 25 AS DOUBLE) AS x, CAST(p_partkey * 7 % 40 * 10 - 50 AS DOUBLE) AS y FROM part),
 l AS (SELECT course_slug, n AS hole_number, CAST((n - 1) * 40 AS DOUBLE) AS lx FROM (SELECT DISTINCT CAST(s_nationkey AS VARCHAR) AS course_slug FROM supplier), (SELECT unnest([1, 2, 3]) AS n)),
 g AS (SELECT f.*, hole_number, sqrt(pow(greatest(x - lx, lx - x - 4, 0), 2) + pow(greatest(y - 300, -y - 6, 0), 2)) AS gap FROM f JOIN l USING (course_slug)),
 r AS (SELECT *, row_number() OVER (PARTITION BY course_slug, feature_id ORDER BY gap, hole_number) = 1 AS nearest FROM g),
 m AS (SELECT *, CASE WHEN canonical_layer IN ('water', 'trees', 'cartpaths') THEN 'shared_overlap' WHEN ref IS NOT NULL THEN CASE WHEN ref = hole_number THEN 'ref' END WHEN nearest THEN 'nearest_centerline' END AS assignment_method FROM r),
 a AS (SELECT course_slug, feature_id, CAST(hole_number AS INT) AS hole_number, canonical_layer, assignment_method, CASE assignment_method WHEN 'shared_overlap' THEN CAST(0.5 AS DOUBLE) WHEN 'ref' THEN CAST(1 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END AS assignment_confidence, x + 2 AS cx, y + 3 AS cy FROM m WHERE assignment_method IS NOT NULL AND gap <= 30)"""


def _anchor(name: str, layer: str, to: int) -> str:
    return f"{name} AS (SELECT l.course_slug, l.hole_number, min_by(cx, sqrt(pow(cx - lx, 2) + pow(cy - {to}, 2))) AS mx, min_by(cy, sqrt(pow(cx - lx, 2) + pow(cy - {to}, 2))) AS my FROM l JOIN a ON a.course_slug = l.course_slug AND a.hole_number = l.hole_number AND canonical_layer = '{layer}' GROUP BY ALL)"


def _ends(name: str, to: int, end: str) -> str:
    return f"round(coalesce({name}.mx, lx), 6) AS {name}_x, round(coalesce({name}.my, {to}), 6) AS {name}_y, CASE WHEN {name}.mx IS NULL THEN 'centerline_{end}' ELSE '{name}_feature' END AS {name}_method"


_SLUG = "CAST(s_nationkey AS VARCHAR)"
ORACLE |= {
    "cloud_ids": f"SELECT s_suppkey AS hole_id, printf('%s__%02d', {_SLUG}, s_suppkey % 18 + 1) AS name, {_SLUG} || ':' || CAST(s_suppkey % 18 + 1 AS VARCHAR) AS cloud_id, {_SLUG} || ':' || CAST(s_suppkey % 18 + 1 AS VARCHAR) AS parsed FROM supplier",
    "hole_labels": f"SELECT hole_id, course_slug || ' #' || hole_id || CASE WHEN hole_id % 5 > 0 THEN ' - par ' || par ELSE '' END || CASE WHEN hole_id % 7 > 0 THEN ' - ' || CAST(round(hole_length_m) AS INT) || ' yd' ELSE '' END AS label FROM ({HOLES})",
    "clean_ints": """SELECT p_partkey, CAST(CASE WHEN p_partkey % 4 IN (0, 1) THEN p_partkey END AS INT) AS number, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 4 = 0 THEN CAST(p_partkey AS VARCHAR) WHEN p_partkey % 4 = 1 THEN p_partkey || '.75' WHEN p_partkey % 4 = 2 THEN 'n/a' END AS text FROM part""",
    "grid_stride": f"""WITH {GRID} SELECT {ROW}, col, 1000 + (col + CAST(0.5 AS DOUBLE)) * 5 AS x, 2000 - ({ROW} + CAST(0.5 AS DOUBLE)) * 5 AS y, round(z, 6) AS z FROM g WHERE {ROW} % 2 = 0 AND col % 2 = 0 AND z IS NOT NULL""",
    "grid_clip": f"""WITH {GRID}, c AS (SELECT {ROW}, col, 1000 + (col + CAST(0.5 AS DOUBLE)) * 5 AS x, 2000 - ({ROW} + CAST(0.5 AS DOUBLE)) * 5 AS y, round(z, 6) AS z FROM g WHERE z IS NOT NULL),
 b AS (SELECT 1 AS hole_id, *, greatest(y - 1950, 1800 - y, 0) AS u, abs(x - 1050) AS v FROM c UNION ALL SELECT 2, *, greatest(1100 - x, x - 1300, 0), abs(y - 1900) FROM c) SELECT hole_id, {ROW}, col, x, y, z FROM b WHERE sqrt(u * u + v * v) < 32""",
    "dem_coverage": f"""{PC}, n AS (SELECT hole_id, count(z) AS n FROM pc GROUP BY 1), c AS (SELECT hole_id, least(1.0, n / (CAST(10 AS DOUBLE) * (hole_id % 50 + 30) / 4)) AS v FROM n)
 SELECT hole_id, round(v, 6) AS coverage, CASE WHEN v < 0.5 THEN 'LOW_DEM_COVERAGE;COARSE_DEM_RESOLUTION' ELSE 'COARSE_DEM_RESOLUTION' END AS flags FROM c""",
    "assign_features": f"WITH {_BOX} SELECT * EXCLUDE (cx, cy) FROM a",
    "assignment_summary": f"WITH {_BOX} SELECT canonical_layer, assignment_method, count(*) AS n FROM a GROUP BY ALL",
    "hole_anchors": f"""WITH {_BOX}, {_anchor("tee", "tees", 0)}, {_anchor("green", "greens", 300)} SELECT l.course_slug, CAST(l.hole_number AS INT) AS hole_number, {_ends("tee", 0, "start")}, {_ends("green", 300, "end")},
 round((CASE WHEN tee.mx IS NULL THEN CAST(0.6 AS DOUBLE) ELSE CAST(0.85 AS DOUBLE) END + CASE WHEN green.mx IS NULL THEN CAST(0.6 AS DOUBLE) ELSE CAST(0.85 AS DOUBLE) END) / 2, 6) AS anchor_confidence FROM l LEFT JOIN tee USING (course_slug, hole_number) LEFT JOIN green USING (course_slug, hole_number)""",
    "aggregate_index": f"SELECT {_SLUG} AS course_slug, 'processed' AS status, s_nationkey * 2 AS region, s_suppkey AS hole_number, CAST(3 + s_suppkey % 3 AS INT) AS par, printf('%s__%02d', {_SLUG}, s_suppkey) AS hole_id FROM supplier WHERE s_nationkey % 3 > 0",
    "top_matches": f"{_SCORE} SELECT target_hole_id, candidate_hole_id, rank, round(total_score, 5) AS total_score FROM res_baseline WHERE target_hole_id = 7 AND rank <= 3",
    "slope_ceilings": f"""WITH {GRID}, s AS (SELECT {ROW}, {_gradient(ROW, "col")} AS dx, {_gradient("col", ROW)} AS dy FROM g) SELECT CAST({ROW} // 10 AS INT) AS hole_id, round(greatest(1.0, quantile_cont(sqrt(dx * dx + dy * dy) * 100, 0.98)), 6) AS vmax FROM s GROUP BY 1""",
    "course_order": f"SELECT {_SLUG} AS course_slug, s_suppkey AS hole_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS place FROM supplier",
}
ORACLE |= {
    "available_targets": f"{_SCORE} SELECT DISTINCT CAST(target_hole_id AS VARCHAR) AS target_hole_id FROM res_baseline",
    "terrain_stats_view": f"{PC} SELECT hole_id, CAST(0 AS DOUBLE) AS tee_elevation_m, round(min(z), 6) AS min_elevation_m, round(max(z), 6) AS max_elevation_m, true AS no_slope, count(*) AS n FROM pc GROUP BY 1",
}
