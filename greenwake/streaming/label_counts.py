"""Label counts kept up to date over a folder of point files; beyond what batch parity needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from greenwake.schema import HOLE_POINTS


def stream_points(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(HOLE_POINTS).json(path)


def counts(points: DataFrame) -> DataFrame:
    """(hole_id, label, n); state is one row a hole and label."""
    return points.groupBy("hole_id", "label").agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(points: DataFrame, ts: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window; rows later than `late` are dropped by the watermark and state is freed."""
    return points.withWatermark(ts, late).groupBy(F.window(ts, window), "label").agg(F.count(F.lit(1)).alias("n"))
