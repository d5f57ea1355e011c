"""Deterministic stand-ins for courses, holes and point clouds over the driver's tables; the text runs in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = """
SELECT l_suppkey AS hole_id, s_nationkey AS course_id, l_quantity - 25.5 AS x,
       CASE WHEN (l_partkey * 7 + l_linenumber * 3) % 11 = 4 THEN 380.0 + l_discount * 100 ELSE l_extendedprice / 200.0 END AS y,
       l_discount * 100 - 5 AS z,
       CASE (l_partkey * 7 + l_linenumber * 3) % 11
            WHEN 4 THEN 'green' WHEN 5 THEN 'bunker' WHEN 6 THEN 'water' WHEN 7 THEN 'tee' WHEN 8 THEN 'trees'
            WHEN 9 THEN 'rough_osm' WHEN 10 THEN 'rough_inferred' ELSE 'fairway' END AS label
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey"""

HOLES = """
SELECT s_suppkey AS hole_id, s_nationkey AS course_id, CAST(s_nationkey AS STRING) AS course_slug, CAST(3 + s_suppkey % 3 AS INT) AS par,
       CAST(120 + 150 * (s_suppkey % 3) + (s_suppkey * 37) % 60 AS DOUBLE) AS hole_length_m
FROM {supplier}"""

EDGES = """
SELECT * FROM (VALUES ('fairway', 5, 0, 0, 100, 0), ('fairway', 5, 100, 0, 100, 100), ('fairway', 5, 100, 100, 0, 100), ('fairway', 5, 0, 100, 0, 0),
 ('bunker', 3, 10, 10, 20, 10), ('bunker', 3, 20, 10, 20, 20), ('bunker', 3, 20, 20, 10, 20), ('bunker', 3, 10, 20, 10, 10),
 ('green', 1, 80, 80, 95, 80), ('green', 1, 95, 80, 95, 95), ('green', 1, 95, 95, 80, 95), ('green', 1, 80, 95, 80, 80))
 AS t(label, priority, x1, y1, x2, y2)"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def run(spark: SparkSession, sf_dir: str, sql: str, sent: set[str] = frozenset()) -> DataFrame:
    """A statement whose {table} names are the driver's tables; those in `sent` are broadcast."""
    used = [t for t in TABLES if "{" + t + "}" in sql]
    return spark.sql(sql, **{t: F.broadcast(table) if t in sent else table for t in used for table in [spark.read.parquet(f"{sf_dir}/{t}.parquet")]})


def duck(sql: str) -> str:
    """The same statement for an engine where the tables are plain views."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql.replace("AS STRING)", "AS VARCHAR)")


#: Suppliers up to which they are sent to all executors (two numbers each, 8 MB), so that the lines aren't shuffled to meet them.
SENT = 500_000


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = spark.read.parquet(f"{sf_dir}/supplier.parquet").count() <= SENT
    return run(spark, sf_dir, POINTS, {"supplier"} if few else set()).selectExpr("hole_id", "course_id", "cast(x as double) x", "cast(y as double) y", "cast(z as double) z", "label")


def holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, HOLES)
