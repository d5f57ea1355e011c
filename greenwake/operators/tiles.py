"""Searches over pairs of rows without pairs as rows: both sides are dealt to blocks, a task holds one block of each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from greenwake.session import ship

#: Cells of a tile of pairs that a task holds at once.
CELLS = 1 << 20


def paired(left: DataFrame, right: DataFrame, keys: list[str], id_col: str, run: Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]], schema: str, blocks: int | tuple[int, int] = 8) -> DataFrame:
    """run(left rows, right rows) of every pair of blocks, among equal keys (a null key meets nothing).

    A row travels once a block of the other side, not once a pair. The number of partitions is given, as a plan that goes by bytes would
    put the few bytes into one task.
    """
    ship(left.sparkSession)
    m, n = (blocks, blocks) if isinstance(blocks, int) else blocks
    here = lambda k: F.pmod(F.xxhash64(id_col), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    sides = left.select("*", F.lit(True).alias("__left"), here(m).alias("__l")).select("*", every(n).alias("__r")), right.select("*", F.lit(False).alias("__left"), here(n).alias("__r")).select("*", every(m).alias("__l"))
    both = sides[0].unionByName(sides[1], allowMissingColumns=True)
    for k in keys:
        both = both.filter(F.col(k).isNotNull())
    by = [*keys, "__l", "__r"]

    def task(group: pa.Table) -> pa.Table:
        side = group["__left"]
        out = list(run(group.filter(side), group.filter(pc.invert(side))))
        return pa.Table.from_batches(out) if out else empty

    empty = _empty(left, schema)
    return both.repartition(m * n, *by).groupBy(*by).applyInArrow(task, schema)


def _empty(df: DataFrame, schema: str) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema).empty_table()


def doubles(column: pa.ChunkedArray) -> np.ndarray:
    """A column of numbers as doubles, null as NaN."""
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False) if column.null_count < len(column) else np.full(len(column), np.nan)


def rows(column: pa.ChunkedArray, width: int, fill: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors as rows of `width`, filled up, their lengths, and which are null or hold a null."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.nan_to_num(doubles(pc.list_value_length(lists))).astype("int64")
    values = lists.flatten()
    row = np.repeat(np.arange(len(lists)), size)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    out = np.full((len(lists), width), fill)
    out[row, at] = doubles(values)
    lost = pc.is_null(lists).to_numpy(zero_copy_only=False).copy()
    lost[row[pc.is_null(values).to_numpy(zero_copy_only=False)]] = True
    return out, size, lost


def codes(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Two columns as numbers that are equal where the values are; null is -1."""
    both = pa.chunked_array([*a.chunks, *b.chunks], a.type).combine_chunks().dictionary_encode()
    both = both.combine_chunks() if isinstance(both, pa.ChunkedArray) else both
    n = both.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return n[: len(a)], n[len(a) :]


def first(value: np.ndarray, n: int, slack: float) -> np.ndarray:
    """Places, by value, of what can be among the first n once values are rounded: all within `slack` of the n-th, of
    equal values the first n, as the rest is decided by the id that the places go by."""
    order = np.argsort(value, kind="stable")
    ordered = value[order]
    if len(order) > n:
        ordered = ordered[: np.searchsorted(ordered, ordered[n - 1] + slack, side="right")] if ordered[n - 1] < np.inf else ordered
    run = np.r_[True, ordered[1:] != ordered[:-1]] if len(ordered) else np.zeros(0, dtype=bool)
    start = np.flatnonzero(run)
    return order[: len(ordered)][np.arange(len(ordered)) - start[np.cumsum(run) - 1] < n] if len(start) else order[:0]
