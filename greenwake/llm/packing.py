"""Conflict-constrained best-fit packing (operator 1).

Bins lie ordered by residual and carry two bitmaps, of sources and of duplicate clusters. An item looks up the
smallest residual that fits it and goes on to its successors until a compatible bin comes; so it gets the tightest
bin that neither holds a member of its duplicate cluster nor `per_source` items of its source already. Bins of one
residual share a class, whose bitmaps' intersection lets a class without a compatible bin be passed over at once.
Items go longest first. A text longer than a bin fills whole bins by itself and only its rest is packed.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from greenwake.session import ship

#: Items that are packed together on average; groups are dealt by a hash of the id.
GROUP = 16_384


class Bins:
    """Open bins ordered by residual."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.residuals: list[int] = []
        self.classes: dict[int, list[int]] = {}
        self.common: dict[int, tuple[int, int]] = {}
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []  # a plane for each item of a source that a bin may hold
        self.used: list[int] = []

    def _full(self, b: int) -> int:
        return self.sources[b][-1]

    def _move(self, b: int, old: int | None, new: int) -> None:
        if old is not None:
            some = self.classes[old]
            some.remove(b)
            if not some:
                del self.classes[old], self.common[old]
                self.residuals.pop(bisect_left(self.residuals, old))
        if new <= 0:
            return
        if new not in self.classes:
            insort(self.residuals, new)
            self.classes[new], self.common[new] = [], (-1, -1)
        insort(self.classes[new], b)
        c, s = self.common[new]
        self.common[new] = (c & self.clusters[b], s & self._full(b))

    def put(self, size: int, cluster: int, source: int) -> tuple[int, int]:
        """(bin, offset) for an item; cluster and source are single bits, 0 for none."""
        for r in self.residuals[bisect_left(self.residuals, size) :]:
            c, s = self.common[r]
            if c & cluster or s & source:
                continue
            for b in self.classes[r]:
                if not (self.clusters[b] & cluster or self._full(b) & source):
                    return b, self._place(b, r, size, cluster, source)
        self.clusters.append(0)
        self.sources.append([0] * self.per_source)
        self.used.append(0)
        b = len(self.used) - 1
        return b, self._place(b, None, size, cluster, source)

    def _place(self, b: int, old: int | None, size: int, cluster: int, source: int) -> int:
        offset = self.used[b]
        self.used[b] += size
        self.clusters[b] |= cluster
        for plane, held in enumerate(self.sources[b]):
            if not held & source:
                self.sources[b][plane] = held | source
                break
        self._move(b, old, self.capacity - self.used[b])
        return offset


def pack_items(items: list[tuple[int, object, object]], capacity: int, per_source: int) -> list[tuple[int, int]]:
    """(bin, offset) of each (size, cluster, source), sizes from 0 to capacity, in the order given."""
    bins = Bins(capacity, per_source)
    many = {c for c, n in Counter(c for _, c, _ in items).items() if n > 1 and c is not None}
    cluster_bit = {c: 1 << i for i, c in enumerate(sorted(many, key=repr))}
    source_bit: dict[object, int] = {}
    out = []
    for size, cluster, source in items:
        bit = source_bit.setdefault(source, 1 << len(source_bit)) if source is not None else 0
        out.append(bins.put(size, cluster_bit.get(cluster, 0), bit))
    return out


def pack(docs: DataFrame, capacity: int = 16_384, per_source: int = 2, size: Column | None = None, cluster: Column | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(doc_id, piece, piece_start, piece_size, bin_id, bin_offset) of every piece of every row.

    size: default the text's UTF-8 bytes, null counting as 0; cluster: default the text's hash. Pieces of `capacity`
    fill a bin each; the last piece of a row (of size 0 for an empty text) is packed. A null source conflicts with
    nothing. Repeated rows are packed each, rows of one text into different bins; rows without an id are packed too.
    Items are dealt by hash to groups of about GROUP and a bin holds items of one group only, so best fit looks at
    that group's open bins. bin_id is unique over all groups and the same in every run. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), (F.octet_length(text) if size is None else size).cast("long").alias("size"), (F.xxhash64(text) if cluster is None else cluster).cast("long").alias("cluster"))
    slim = slim.withColumn("size", F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)))
    groups = max(1, -(-docs.count() // GROUP))
    slim = slim.withColumn("pack", F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(groups)).cast("int"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "doc_id", "source", "cluster"], ascending=[False, True, True, True], na_position="last", kind="stable")
        whole = (group["size"].to_numpy() - 1).clip(0) // capacity
        rest = group["size"].to_numpy() - whole * capacity
        order = sorted(range(len(group)), key=lambda i: -rest[i])
        names = group["source"].where(group["source"].notna(), None).tolist()
        clusters = [None if pd.isna(c) else int(c) for c in group["cluster"]]
        placed = pack_items([(int(rest[i]), clusters[i], names[i]) for i in order], capacity, per_source)
        where = dict(zip(order, placed, strict=True))
        own = 1 + max((b for b, _ in placed), default=-1)
        base = int(group["pack"].iloc[0]) << 40
        rows = []
        for i, doc in enumerate(group["doc_id"].astype("object").where(group["doc_id"].notna(), None)):
            for piece in range(whole[i]):
                rows.append((doc, piece, piece * capacity, capacity, base + own, 0))
                own += 1
            rows.append((doc, int(whole[i]), int(whole[i]) * capacity, int(rest[i]), base + where[i][0], where[i][1]))
        return pd.DataFrame(rows, columns=["doc_id", "piece", "piece_start", "piece_size", "bin_id", "bin_offset"])

    return slim.groupBy("pack").applyInPandas(run, "doc_id long, piece long, piece_start long, piece_size long, bin_id long, bin_offset long")
