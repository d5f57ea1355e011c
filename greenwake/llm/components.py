"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from greenwake.session import cut, drop_cut, ship

#: Edges (16 bytes each) up to which one task walks them all; beyond, they stay distributed.
ONE_TASK = 1 << 20


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node reachable from each of n nodes over edges a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for end in (root[a], root[b]):
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        u.append(batch.column(0).to_numpy()), v.append(batch.column(1).to_numpy())
    names, where = np.unique(np.concatenate([*u, *v]), return_inverse=True)
    a, b = np.split(where.ravel(), 2)
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[roots(a, b, len(names))])], names=["node", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b", one_task: int = ONE_TASK) -> DataFrame:
    """(node long, component long): the smallest node reachable from every node that has an edge.

    Self-edges, repeated edges and nulls are allowed and mean nothing; no edges give no rows. Up to one_task distinct
    edges, counted first, one task walks them. Beyond, each step keeps at most as many edges as it got, minima are
    pre-aggregated before they are shuffled, and each round's edges are written to the shared folder, so no star meets
    in one task and a lost executor repeats one round only.
    """
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).filter("u > v").distinct()
    e = cut(e, "edges")
    if e.count() <= one_task:
        ship(e.sparkSession)
        out = cut(e.coalesce(1).mapInArrow(_walked, "node long, component long"), "components")
        drop_cut(e)
        return out
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        new = cut(small, "edges")
        drop_cut(e)
        e = new
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
