"""Command line: courses, features, modes, presented, cloud, calibrate, batch, sweep, validate,
surfaces. Exit codes: 0 done, 1 failed, 2 wrong usage."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from greenwake.operators import cloud, courses, exports, features, neighbours, plausibility
from greenwake.session import build_session
from greenwake.sources import configs, rasters, readers, sinks


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="greenwake")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *paths: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        for path in (*paths, "out"):
            p.add_argument(f"--{path}", required=True)
        p.add_argument("--overwrite", action="store_true")
        return p

    p = command("courses", "config", "sources", "rasters")
    which = p.add_mutually_exclusive_group(required=True)
    which.add_argument("--course", action="append", help="a slug; repeatable")
    which.add_argument("--all", action="store_true")
    which.add_argument("--list", action="store_true", help="print the slugs and do nothing")
    strict = p.add_mutually_exclusive_group()
    strict.add_argument("--strict-18", dest="strict", action="store_true", default=True)
    strict.add_argument("--allow-dirty", dest="strict", action="store_false")
    p.add_argument("--export-csv", action="store_true")
    p.add_argument("--point-resolution", type=float, default=1.0)
    p.add_argument("--max-points", type=int, default=250_000)
    command("features", "points", "holes")
    p = command("modes", "features")
    p.add_argument("--mode", action="append", choices=sorted(neighbours.MODES))
    p.add_argument("--neighbors", type=int, default=10)
    p = command("presented", "features", "pairs")
    p.add_argument("--n", type=int, default=plausibility.MATCHES)
    p.add_argument("--min-score", type=float, default=plausibility.MIN_SCORE)
    p.add_argument("--allow-same-course", action="store_true")
    p.add_argument("--allow-different-par", action="store_true")
    p = command("cloud", "config", "metadata", "points")
    which = p.add_mutually_exclusive_group(required=True)
    which.add_argument("--target-hole-id")
    which.add_argument("--all", action="store_true")
    p.add_argument("--top-n", type=int, default=25)
    p.add_argument("--include-same-course", action="store_true")
    p.add_argument("--include-self", action="store_true")
    command("calibrate", "config", "results")
    for name in ("batch", "sweep"):
        p = command(name, "metadata", "points")
        p.add_argument("--config", required=True, action="append", help="sweep takes several")
        p.add_argument("--top-n", type=int, default=25)
        p.add_argument("--limit-targets", type=int)
        p.add_argument("--exclude-same-course", action="store_true")
        p.add_argument("--include-self", action="store_true")
    p = command("validate", "results")
    p.add_argument("--top-n", type=int, default=10)
    command("surfaces", "metadata", "points")
    return top


def run(a: argparse.Namespace) -> None:
    spark = build_session()
    if a.command == "courses":
        return run_courses(spark, a)
    if a.command in ("batch", "sweep", "validate", "surfaces"):
        return run_outputs(spark, a)
    if a.command == "features":
        points = readers.read_points(spark, a.points).toDF("hole_id", "x", "y", "z", "label")
        out = features.hole_features(points, readers.read_index(spark, a.holes))
    elif a.command == "modes":
        table = readers.read_index(spark, a.features)
        out = sinks.concat([neighbours.mode_neighbours(table, m, a.neighbors) for m in a.mode or neighbours.GOLF_MODES])
    elif a.command == "presented":
        out = plausibility.presented(spark.read.parquet(a.pairs), readers.read_index(spark, a.features), a.n, a.min_score, a.allow_same_course, a.allow_different_par)
    else:
        config = configs.load_cloud_config(spark, a.config)
        if a.command == "cloud":
            meta, points = readers.read_surfaces(spark, a.metadata, a.points)
            targets = meta if a.all else meta.filter(F.col("hole_id") == a.target_hole_id)
            if not targets.limit(1).count():
                raise KeyError(f"no hole {a.target_hole_id!r}")
            # a batch of all targets ranks a course's own holes too, a single target only if asked
            out, _ = cloud.batch(meta, points, config, a.top_n, targets, a.all or a.include_same_course, a.include_self)
        else:
            out = cloud.calibration(cloud.components(spark.read.parquet(a.results), config), config)
    out.write.mode("overwrite" if a.overwrite else "errorifexists").parquet(a.out)


def run_courses(spark, a: argparse.Namespace) -> None:
    """Map features (<sources>/<slug>/*.geojson, or in a folder `source` there) and rasters (<rasters>/<slug>.tif) to
    holes, points and reports. An unknown slug ends the run before it starts; a course that fails doesn't."""
    every = configs.load_courses(spark, a.config)
    if a.list:
        for row in every.select("course_slug").orderBy("course_slug").collect():
            print(row[0])
        return
    for slug in a.course or []:
        configs.course(every, slug)
    chosen = every if a.all else every.filter(F.col("course_slug").isin(a.course))
    features = readers.read_geojson(spark, a.sources)
    table, cells = rasters.read_geotiff(spark, a.rasters)
    done = courses.build(spark, chosen, features, table, cells, a.out, a.strict, a.point_resolution, a.max_points, a.overwrite)
    if a.export_csv:
        sinks.write_csv(spark.read.parquet(f"{a.out}/holes"), f"{a.out}/holes_csv", a.overwrite)
    counts = {r["status"]: r["count"] for r in done.groupBy("status").count().collect()}
    print(", ".join(f"{k} {counts.get(k, 0)}" for k in ("processed", "skipped", "failed")))
    if counts.get("failed"):
        raise RuntimeError(f"{counts['failed']} courses failed; see {a.out}/issues")


def run_outputs(spark, a: argparse.Namespace) -> None:
    """The commands that write folders of several outputs."""
    if a.command == "validate":
        results = exports.load_results(spark, a.results)
        if results is None:
            raise FileNotFoundError(f"no results under {a.results}")
        return exports.write_validation(results, exports.config_names(spark, a.results), a.out, a.top_n, a.overwrite)
    meta, points = readers.read_surfaces(spark, a.metadata, a.points)
    if a.command == "surfaces":
        print(exports.write_surfaces(meta, points, f"{a.out}/points", f"{a.out}/metadata", a.overwrite))
        return None
    options = {"top_n": a.top_n, "include_self": a.include_self, "exclude_same_course": a.exclude_same_course, "limit_targets": a.limit_targets}
    chosen = [configs.load_cloud_config(spark, c) for c in a.config]
    if a.command == "batch":
        if len(chosen) != 1:
            raise ValueError("batch takes one --config")
        exports.write_batch(meta, points, chosen[0], a.out, overwrite=a.overwrite, sources=(a.metadata, a.points), **options)
    else:
        failed = [r for r in exports.write_sweep(meta, points, chosen, a.out, overwrite=a.overwrite, **options) if r["status"] == "failed"]
        if failed:
            raise RuntimeError("; ".join(f"{r['config_name']}: {r['error']}" for r in failed))
    return None


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        run(args)
    except Exception as e:  # noqa: BLE001 - the exit code tells, the text explains
        print(f"{type(e).__name__}: {e}"[:2000], file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
