"""Reduction and clustering of the hole matrix."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from greenwake.session import ship


def pca(vectors: DataFrame, n: int = 2) -> tuple[DataFrame, list[float]]:
    """(hole_id, pca_1..n) of (hole_id, v) and the explained variance ratios; n is held to rows and width.

    Standardised columns are centred already; a component's sign is arbitrary.
    """
    first = vectors.select(F.size("v").alias("w")).first()
    n = max(1, min(n, first["w"] if first else 1, vectors.count()))
    data = vectors.withColumn("features", array_to_vector("v"))
    model = PCA(k=n, inputCol="features", outputCol="p").fit(data)
    out = model.transform(data).withColumn("p", vector_to_array("p"))
    return out.select("hole_id", *[F.col("p")[i].alias(f"pca_{i + 1}") for i in range(n)]), list(model.explainedVariance)


def kmeans(vectors: DataFrame, k: int = 8, seeds: int = 10) -> DataFrame:
    """(hole_id, kmeans_cluster): the cheapest of several seeds; k is held to the number of rows."""
    k = max(1, min(k, vectors.count()))
    if k == 1:
        return vectors.select("hole_id", F.lit(0).alias("kmeans_cluster"))
    data = vectors.withColumn("features", array_to_vector("v")).select("hole_id", "features").persist()
    models = [KMeans(k=k, seed=s, featuresCol="features", predictionCol="kmeans_cluster").fit(data) for s in range(seeds)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    out = best.transform(data).select("hole_id", "kmeans_cluster")
    data.unpersist()
    return out


def ward_labels(x: np.ndarray, k: int) -> np.ndarray:
    """Ward linkage cut at k clusters, numbered by first member. Merges are found along chains of nearest neighbours and
    cut by their heights; a cluster is its size and mean, so memory is that of the rows and not of their pairs."""
    n = len(x)
    k = max(1, min(k, n))
    x = x.astype(float).copy()
    # the clusters still apart lie in front, so that a search reads no row of one that is gone
    mean, size, name = x, np.ones(n), np.arange(n)
    at, alive, chain, merges = np.arange(n), n, [], []
    while alive > 1:
        if not chain:
            chain = [name[0]]
        i = at[chain[-1]]
        d = np.zeros(alive)
        for axis in range(mean.shape[1]):
            e = mean[:alive, axis] - mean[i, axis]
            d += e * e
        d *= size[:alive] * size[i] / (size[:alive] + size[i])
        d[i] = np.inf
        low = d.min()
        before = at[chain[-2]] if len(chain) > 1 else -1
        j = before if before >= 0 and d[before] == low else int(np.flatnonzero(d == low)[np.argmin(name[:alive][d == low])])
        if j != before:
            chain.append(name[j])
            continue
        a, b = sorted((name[i], name[j]))
        merges.append((low, len(merges), a, b))
        del chain[-2:]
        i, j = at[a], at[b]
        mean[i] = (size[i] * mean[i] + size[j] * mean[j]) / (size[i] + size[j])
        size[i] += size[j]
        alive -= 1
        mean[j], size[j], name[j] = mean[alive], size[alive], name[alive]
        at[name[j]] = j
    parent = np.arange(n)
    for _, _, a, b in sorted(merges)[: n - k]:
        parent[_root(parent, b)] = _root(parent, a)
    label = np.array([_root(parent, i) for i in range(n)])
    order = {c: r for r, c in enumerate(dict.fromkeys(label.tolist()))}
    return np.array([order[c] for c in label.tolist()])


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return int(i)


def ward(vectors: DataFrame, k: int = 8) -> DataFrame:
    """(hole_id, agglomerative_cluster). Linkage goes merge by merge, so one task holds all rows of the matrix; its time
    grows with their square."""
    ship(vectors.sparkSession)
    kind = vectors.schema["hole_id"].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("hole_id")
        return pd.DataFrame({"hole_id": group["hole_id"], "agglomerative_cluster": ward_labels(np.stack(group["v"].to_numpy()), k).astype("int32")})

    return vectors.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(run, f"hole_id {kind}, agglomerative_cluster int")


def cluster_table(features: DataFrame, vectors: DataFrame, k: int = 8) -> DataFrame:
    """Identifiers, both cluster labels and two components a hole."""
    ids = features.select("hole_id", *[c for c in ("course_slug", "course_name", "hole_number", "par") if c in features.columns])
    return ids.join(kmeans(vectors, k), "hole_id").join(ward(vectors, k), "hole_id").join(pca(vectors)[0], "hole_id")


def cluster_names(profile: DataFrame, columns: tuple[str, ...] = ("trees_pct", "water_pct", "bunker_pct")) -> DataFrame:
    """(cluster, name): the column that most exceeds 1.3 times its median over clusters, else `balanced`."""
    medians = profile.agg(*[F.median(c).alias(f"m_{c}") for c in columns])
    ratio = {c: F.coalesce(F.col(c) / F.nullif(f"m_{c}", F.lit(0.0)), F.lit(0.0)) for c in columns}
    joined = profile.join(F.broadcast(medians))  # one row of medians
    top = F.greatest(*ratio.values())
    name = F.when(top < 1.3, "balanced")
    for c in columns:
        name = name.when(ratio[c] == top, c.removesuffix("_pct"))
    return joined.select("cluster", name.alias("name"))
