"""Sharding by a Hilbert curve over several metadata dimensions (operator 10).

Four dimensions are quantised to 10 bits each: language and source (the place among the distinct ones, in order, spread
over the range), size (its 32nd among the sizes) and id (its place between the smallest and the largest). Rows of equal
text take the metadata of the group's smallest id, so that copies lie side by side on the curve. Runs of the curve are cut
into shards whose row counts are at most one apart (law `rows`).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from greenwake.llm.names import unused
from greenwake.session import cut, partitions, ship

BITS = 10


def hilbert(axes: list[np.ndarray], bits: int) -> np.ndarray:
    """Index along the Hilbert curve of points with `bits`-bit coordinates, by Skilling's transposition."""
    x = [a.astype(np.int64).copy() for a in axes]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(len(x)):
            set_ = (x[i] & q) != 0
            t = np.where(set_, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(set_, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    out = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for a in x:
            out = (out << 1) | (((a ^ t) >> b) & 1)
    return out


@F.pandas_udf(LongType())
def _curve(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series(hilbert([v.to_numpy() for v in (a, b, c, d)], BITS))


def ranked(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """rows with `rank`, their gapless place from 0 in that order, and how many there are."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    dealt = cut(dealt, "ranked")
    held = sorted((r["p"], r["n"]) for r in dealt.groupBy(F.shiftright("__at", 33).alias("p")).agg(F.count("*").alias("n")).collect())  # a row for each partition
    starts, total = [], 0
    for part, n in held:
        starts.append((part, total))
        total += n
    begin = F.broadcast(spark.createDataFrame(starts, "__p long, __start long"))
    out = dealt.join(begin, F.shiftright("__at", 33) == F.col("__p")).withColumn("rank", F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    return out.drop("__at", "__p", "__start"), total


def _spread(rows: DataFrame, name: str, top: int) -> DataFrame:
    """(name, name_place): each distinct value's rank, spread over 0 to top."""
    values, n = ranked(rows.select(name).filter(F.col(name).isNotNull()).distinct(), [name])
    return values.select(name, F.floor(F.col("rank") * (top + 1) / max(n, 1)).cast("long").alias(f"{name}_place"))


def pruning(placed: DataFrame, docs: DataFrame) -> DataFrame:
    """(shard, langs, sources, least_size, most_size): what a reader that knows each shard's values has to open."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source")
    return placed.join(known, "doc_id").groupBy("shard").agg(F.count_distinct("lang").alias("langs"), F.count_distinct("source").alias("sources"), F.min("size").alias("least_size"), F.max("size").alias("most_size"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 40) -> None:
    """docs as Parquet with a folder a shard, rows in the order of their slots. Ids must be distinct and not null."""
    doc_id, shard, slot = unused(docs, "__doc_id", "shard", "slot")
    placed = shards(docs, n_shards).select(F.col("doc_id").alias(doc_id), F.col("shard").alias(shard), F.col("slot").alias(slot))
    joined = docs.join(placed, F.col("doc_id").cast("long") == F.col(doc_id)).drop(doc_id)
    joined.repartitionByRange(n_shards, shard, slot).sortWithinPartitions(shard, slot).drop(slot).write.partitionBy(shard).parquet(path)


def shards(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert) of every row of docs(doc_id, text, lang, source).

    A null text has size 16 and checksum 0, like an empty one; nulls in lang, source or doc_id take place 0 of their
    dimension. Repeated rows each get a slot; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"),
    )
    slim = cut(slim, "slim")
    first = cut(slim.groupBy("h", "size").agg(F.min(F.struct("doc_id", "lang", "source")).alias("one")).select("h", "size", "one.*"), "groups")
    low, high, steps = first.agg(F.min("doc_id"), F.max("doc_id"), F.percentile_approx("size", F.array(*[F.lit(i / 32) for i in range(1, 32)]))).first()
    low, span = low or 0, max(1, (high or 0) - (low or 0))
    top = (1 << BITS) - 1
    place = F.coalesce(((F.col("doc_id") - low).cast("double") / span * top).cast("long"), F.lit(0))
    step = F.size(F.filter(F.array(*map(F.lit, steps or [0])), lambda x: x < F.col("size"))).cast("long") * 32
    for name in ("lang", "source"):
        first = first.join(_spread(first, name, top), name, "left")
    lang, source = (F.coalesce(F.col(f"{name}_place"), F.lit(0)) for name in ("lang", "source"))
    groups = first.select("h", "size", _curve(lang, source, step, place).alias("hilbert"))
    rows, total = ranked(slim.join(groups, ["h", "size"]).select("doc_id", "size", "text_crc32", "hilbert", "h"), ["hilbert", "h", "doc_id", "text_crc32"])
    base, more = divmod(total, n_shards)
    wide = more * (base + 1)  # rows in the shards that have one more
    rank, floor_ = F.col("rank"), lambda a, n: F.floor(a / n).cast("long")
    early = rank < wide
    shard = F.when(early, floor_(rank, base + 1)).otherwise(more + floor_(rank - wide, max(base, 1)))
    slot = F.when(early, rank % (base + 1)).otherwise((rank - wide) % max(base, 1))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert")
