"""Raster operators over cell tables (course_slug, row, col, z) and a transform (a, c, e, f)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from greenwake.functions import geometry as G


@dataclass(frozen=True)
class Transform:
    """x = c + (col + 1/2) a, y = f + (row + 1/2) e of a cell's centre; e is negative for north-up rasters."""

    a: float
    c: float
    e: float
    f: float

    @property
    def resolution(self) -> float:
        return (abs(self.a) + abs(self.e)) / 2

    def stride(self, target: float) -> int:
        """Cells between samples for a spacing; halves go to the even side."""
        return max(1, round(target / self.resolution)) if target > 0 else 1


def slope(cells: DataFrame, t: Transform, keys: tuple[str, ...] = ("course_slug",)) -> DataFrame:
    """cells with slope_pct and slope_deg: central differences, one-sided at the raster's edge; a null neighbour
    gives null."""
    def along(by: str, over: str, step: float) -> Column:
        w = Window.partitionBy(*keys, by).orderBy(over)
        near, far = F.lag("z").over(w), F.lead("z").over(w)
        first, last = F.row_number().over(w) == 1, F.lead(F.lit(1)).over(w).isNull()
        return F.when(first & last, None).when(first, far - F.col("z")).when(last, F.col("z") - near).otherwise((far - near) / 2) / abs(step)

    out = cells.withColumn("dx", along("row", "col", t.a)).withColumn("dy", along("col", "row", t.e))
    rise = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    return out.withColumn("slope_pct", rise * 100).withColumn("slope_deg", F.degrees(F.atan(rise))).drop("dx", "dy")


def centres(cells: DataFrame, t: Transform, stride: int = 1) -> DataFrame:
    """Known cells at a stride with their centre x, y."""
    some = cells.filter((F.col("row") % stride == 0) & (F.col("col") % stride == 0) & F.col("z").isNotNull())
    return some.withColumn("x", t.c + (F.col("col") + 0.5) * t.a).withColumn("y", t.f + (F.col("row") + 0.5) * t.e)


def sample(points: DataFrame, cells: DataFrame, t: Transform) -> DataFrame:
    """points(x, y, ...) with z of the cell they fall in, by an equi-join on the cell."""
    keyed = points.withColumn("col", F.floor((F.col("x") - t.c) / t.a).cast("int")).withColumn("row", F.floor((F.col("y") - t.f) / t.e).cast("int"))
    return keyed.join(cells.select("row", "col", "z"), ["row", "col"], "left").drop("row", "col")


def profile(lines: DataFrame, cells: DataFrame, t: Transform, n: int = 200) -> DataFrame:
    """(hole_id, i, x, y, z) at n equal steps along each line."""
    steps = lines.select("hole_id", "line", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    at = steps.withColumn("p", G.interpolate(F.col("line"), F.col("i") / F.lit(float(n - 1)))).select("hole_id", "i", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    return sample(at, cells, t)


def clip(cells: DataFrame, lines: DataFrame, t: Transform, radius: float) -> DataFrame:
    """(hole_id, row, col, x, y, z) of the cells within radius of each hole's line; a box test comes first."""
    c = centres(cells, t)
    box = lines.withColumn("b", G.bounds(F.col("line")))
    near = (F.col("x") >= F.col("b.x0") - radius) & (F.col("x") <= F.col("b.x1") + radius) & (F.col("y") >= F.col("b.y0") - radius) & (F.col("y") <= F.col("b.y1") + radius)
    # cells and boxes meet on square tiles of the radius, so that no cell visits a far line
    size = max(radius * 4, 1.0)
    tiled = box.withColumn("tx", F.explode(F.sequence(F.floor((F.col("b.x0") - radius) / size), F.floor((F.col("b.x1") + radius) / size)))).withColumn("ty", F.explode(F.sequence(F.floor((F.col("b.y0") - radius) / size), F.floor((F.col("b.y1") + radius) / size))))
    keyed = c.withColumn("tx", F.floor(F.col("x") / size)).withColumn("ty", F.floor(F.col("y") / size))
    return keyed.join(tiled, ["tx", "ty"]).filter(near).filter(G.point_line_distance(F.col("x"), F.col("y"), F.col("line")) < radius).select("hole_id", "row", "col", "x", "y", "z")


def reproject(cells: DataFrame, source: Transform, target: Transform, rows: int, cols: int, inverse=None) -> DataFrame:
    """The raster on another grid, bilinear over the four neighbours; `inverse` maps target x, y to source x, y."""
    spark = cells.sparkSession
    grid = spark.range(rows * cols).select((F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    x, y = target.c + (F.col("col") + 0.5) * target.a, target.f + (F.col("row") + 0.5) * target.e
    sx, sy = (x, y) if inverse is None else inverse(x, y)
    at = grid.withColumn("u", (sx - source.c) / source.a - 0.5).withColumn("v", (sy - source.f) / source.e - 0.5)
    corners = F.array(*[F.struct((F.floor("v") + dv).cast("int").alias("r"), (F.floor("u") + du).cast("int").alias("k"), ((F.lit(1.0) - F.abs(F.col("u") - F.floor("u") - du)) * (F.lit(1.0) - F.abs(F.col("v") - F.floor("v") - dv))).alias("w")) for dv in (0, 1) for du in (0, 1)])
    part = at.withColumn("n", F.explode(corners)).filter("n.w > 0")
    joined = part.join(cells.select(F.col("row").alias("r"), F.col("col").alias("k"), "z"), (F.col("n.r") == F.col("r")) & (F.col("n.k") == F.col("k")), "left")
    whole = F.count(F.lit(1)) == F.count("z")
    return joined.groupBy("row", "col").agg(F.when(whole, F.sum(F.col("z") * F.col("n.w"))).alias("z"))


def summary(cells: DataFrame, keys: tuple[str, ...] = ("hole_id",)) -> DataFrame:
    """Elevation and slope ranges and means of a hole's cells; nulls are left out."""
    kinds = (("elevation_m", "z"), ("slope_deg", "slope_deg"), ("slope_pct", "slope_pct"))
    return cells.groupBy(*keys).agg(F.count("z").alias("cell_count"), *[f(c).alias(f"{n}_{name}") for name, c in kinds if c in cells.columns for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])


def elevation_change(tee_z: Column, green_z: Column) -> tuple[Column, Column]:
    """(net, absolute) change, null unless both ends are known."""
    return green_z - tee_z, F.abs(green_z - tee_z)


def coverage(finite: Column, buffer_area: Column, resolution: float) -> Column:
    return F.least(F.lit(1.0), F.try_divide(finite.cast("double"), buffer_area / (resolution * resolution)))


def coverage_flags(cover: Column, resolution: float) -> Column:
    return F.array_compact(F.array(F.when(cover < 0.5, "LOW_DEM_COVERAGE"), F.when(F.lit(resolution) > 2.0, "COARSE_DEM_RESOLUTION")))
