"""Statistics as expressions: exact means, shares, quantile ranges, even subsamples, standardisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def known(value: Column) -> Column:
    """A NaN or infinity becomes null; missing values are null everywhere past ingest."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def exact_mean(value: Column) -> Column:
    """Mean over an exact decimal sum, so that it doesn't depend on the order of rows."""
    return F.try_divide(F.sum(value.cast("decimal(18,8)")).cast("double"), F.count(value).cast("double"))


def share(condition: Column, among: Column | None = None) -> Column:
    """Rows of a group where condition holds, as a fraction of those where `among` holds; null if there are none."""
    both = condition if among is None else condition & among
    total = F.count(F.lit(1)) if among is None else F.count(F.when(among, 1))
    return F.try_divide(F.count(F.when(both, 1)).cast("double"), total.cast("double"))


def even_ordinals(n: int, budget: int) -> list[int]:
    """Ordinals that an even pick of `budget` among n keeps."""
    if budget <= 1:
        return [0] if n else []
    return sorted({int(i * (n - 1) / (budget - 1)) for i in range(budget)})


def even_subsample(df: DataFrame, keys: list[str], order: list[str], budget: Column) -> DataFrame:
    """At most `budget` rows of each group, spread evenly over its order; all of a group within budget, or if the
    budget is null or not positive. `order` has to be total for the pick to be the same in every run."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    numbered = df.withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).join(counts, keys)
    step = (F.col("__n") - 1).cast("double") / (budget - 1).cast("double")
    # row i is picked if floor(j * step) == i for some j, which is the least j with j * step >= i
    j = F.ceil(F.col("__i").cast("double") / step)
    hit = [F.floor(k * (F.col("__n") - 1) / (budget - 1)) == F.col("__i") for k in (j - 1, j, j + 1)]
    pick = (budget.isNull()) | (budget <= 0) | (F.col("__n") <= budget) | F.when(budget == 1, F.col("__i") == 0).otherwise(hit[0] | hit[1] | hit[2])
    return numbered.filter(pick).drop("__i", "__n")


def standardised(df: DataFrame, columns: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """df with each column's gaps filled by its median (0 if it has no value at all), centred, divided by its
    population deviation (a constant column gives 0) and weighted."""
    weights = weights or {}
    medians = df.agg(*[F.percentile(F.col(c).cast("double"), 0.5).alias(c) for c in columns]).first()
    filled = df.select(*[c for c in df.columns if c not in columns], *[F.coalesce(F.col(c).cast("double"), F.lit(float(medians[c] or 0.0))).alias(c) for c in columns])
    stats = filled.agg(*[exact_mean(F.col(c)).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    if stats is None or stats[f"m_{columns[0]}"] is None:
        return filled
    scaled = [((F.col(c) - stats[f"m_{c}"]) / (stats[f"s_{c}"] if (stats[f"s_{c}"] or 0) > 1e-12 else 1.0) * weights.get(c, 1.0)).alias(c) for c in columns]
    return filled.select(*[c for c in df.columns if c not in columns], *scaled)
