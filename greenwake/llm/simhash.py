"""SimHash fingerprints (operator 3): weighted term hashes vote on 64 signed bits; permuted block tables search.

Terms are the lower-cased words and the pairs of neighbouring words, each weighing ln(1 + its count). A text
without words has fingerprint 0. Likeness is 1 - Hamming distance / 64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from greenwake.llm.textbytes import shingles, utf8, words
from greenwake.session import cut, partitions, ship


def votes(hashes: np.ndarray) -> int:
    """Fingerprint of one text from its word hashes."""
    if not len(hashes):
        return 0
    terms = np.concatenate([hashes, shingles(hashes, 2)]) if len(hashes) > 1 else hashes
    terms, n = np.unique(terms, return_counts=True)
    weight = np.log1p(n)
    bits = np.unpackbits(terms.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ayes = weight @ bits
    return int.from_bytes(np.packbits(2 * ayes > weight.sum()).tobytes(), "big")


def fingerprints_of(texts: list[str]) -> list[int]:
    hashes, first = words(*utf8(pa.array(texts, pa.large_string())))
    return [votes(hashes[first[i] : first[i + 1]]) for i in range(len(texts))]


def likeness(a: int, b: int) -> float:
    return 1 - (a ^ b).bit_count() / 64


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint long) of every row; nulls count as empty texts."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, first = words(*utf8(batch.column(1)))
            prints = [votes(hashes[first[i] : first[i + 1]]) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, dtype=np.uint64).astype(np.int64))], names=[id_col, "fingerprint"])

    slim = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("__text"))
    return slim.mapInArrow(run, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, fingerprint long")


def _masks(radius: int, blocks: int) -> list[int]:
    """A signed 64-bit mask for each choice of blocks - radius of the blocks; prints within the radius agree under one."""
    if not 0 <= radius < blocks <= 64:
        raise ValueError("radius must be below the number of blocks")
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in some) for some in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _tables(prints: DataFrame, masks: list[int], *others: str) -> DataFrame:
    """A row (t, key, f) of each print in every permuted table; the key is the bits that the table's mask leaves."""
    keys = F.array(*[F.col("f").bitwiseAND(F.lit(m).cast("long")) for m in masks])
    return prints.select("f", *others, F.posexplode(keys).alias("t", "key"))


def _first_meeting(masks: list[int]) -> Column:
    """Whether t is the first table in which a and b agree, so that each pair comes once without a distinct."""
    apart = F.col("a").bitwiseXOR(F.col("b"))
    first = F.coalesce(*[F.when(apart.bitwiseAND(F.lit(m).cast("long")) == 0, F.lit(t)) for t, m in enumerate(masks)])
    return F.col("t") == first


def within_radius(prints: DataFrame, radius: int = 3, blocks: int = 6, column: str = "fingerprint") -> DataFrame:
    """Pairs a < b of distinct fingerprints at most radius bits apart, with their distance.

    The 64 bits are cut into `blocks` blocks; two prints within the radius agree on blocks - radius of them at
    least, so a table for each choice of that many blocks, keyed by their bits, finds every pair.
    """
    masks = _masks(radius, blocks)
    one = prints.select(F.col(column).alias("f")).filter("f is not null").distinct()
    tables = _tables(one, masks)
    pairs = tables.select("t", "key", F.col("f").alias("a")).join(tables.select("t", "key", F.col("f").alias("b")), ["t", "key"]).filter("a < b").filter(_first_meeting(masks)).select("a", "b")
    return pairs.withColumn("distance", F.bit_count(F.col("a").bitwiseXOR(F.col("b")))).filter(F.col("distance") <= radius)


def count_within_radius(queries: DataFrame, prints: DataFrame, radius: int = 3, blocks: int = 5, salts: int = 8, column: str = "fingerprint") -> DataFrame:
    """(column, n_within) of each distinct fingerprint of queries: how many rows of prints lie within the radius.

    Equal prints are counted into one row before they meet the tables. A block that many prints share is dealt over
    `salts` tasks by the print's hash, and the queries, few beside the prints, go to each of them. Null fingerprints
    count nowhere; a query that nothing lies near has no row.
    """
    masks = _masks(radius, blocks)
    known = prints.select(F.col(column).alias("f")).filter("f is not null").groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    asked = queries.select(F.col(column).alias("f")).filter("f is not null").distinct()
    rows = _tables(known.withColumn("salt", F.pmod(F.xxhash64("f"), F.lit(salts)).cast("int")), masks, "n", "salt").withColumnRenamed("f", "b")
    probes = _tables(asked, masks).withColumnRenamed("f", "a").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = probes.join(rows, ["t", "key", "salt"]).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).filter(_first_meeting(masks))
    return met.groupBy(F.col("a").alias(column)).agg(F.sum("n").alias("n_within"))


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _RESULT.split(", ")]


def _row(doc: int | None, text: str, following: str, prints: tuple[int, int, int]) -> tuple:
    own, changed, next_ = prints
    return (doc, len(text), hashlib.sha256(_edited(text, following).encode()).hexdigest(), f"{own:016x}", f"{changed:016x}", likeness(own, changed), likeness(own, next_))


def study(docs: DataFrame, radius: int = 3, every: int = 50) -> DataFrame:
    """edit_study with n_within: of documents whose id is divisible by `every`, the number of other documents whose
    fingerprint lies within the radius, found by the permuted block tables; null of all others and of null ids.
    Repeated rows count each, empty texts share fingerprint 0, an empty table gives no rows."""
    rows = edit_study(docs).withColumn("__f", F.conv("fingerprint", 16, -10).cast("long"))
    asks = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    queries = rows.filter(asks)
    near = count_within_radius(queries, rows, radius, column="__f")
    answered = queries.join(near, "__f", "left").withColumn("n_within", F.col("n_within") - 1)
    return answered.unionByName(rows.filter(~asks).withColumn("n_within", F.lit(None).cast("long"))).drop("__f")


def edit_study(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint beside that of its edited text and of the next document by ascending id.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next
    document's; after the last comes the first. Texts are dealt out by id once; where a partition ends, the two
    texts on either side of the seam (two a partition) are joined in a second, small step. Ids that repeat stand in
    the order of their texts, null ids come first.
    """
    spark = docs.sparkSession
    ship(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = slim.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, str] | None = None
        head = part = None
        seam = [None] * (len(_NAMES) - 1)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if not ids:
                continue
            part = batch.column(2)[0].as_py()
            if head is None:
                head = (ids[0], texts[0])
            if held is not None:
                ids, texts = [held[0], *ids], [held[1], *texts]
            out = []
            for at in range(0, len(ids) - 1, 512):
                some = texts[at : at + 513]
                plain = fingerprints_of(some)
                changed = fingerprints_of([_edited(x, y) for x, y in zip(some, some[1:], strict=False)])
                out += [(*_row(ids[at + i], some[i], some[i + 1], (plain[i], changed[i], plain[i + 1])), part, "done", "") for i in range(len(some) - 1)]
            held = (ids[-1], texts[-1])
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip([*_NAMES, "part", "kind", "text"], r, strict=True)) for r in out], schema=_schema())
        if held is not None:
            rows = [(head[0], *seam, part, "head", head[1]), (held[0], *seam, part, "tail", held[1])]
            yield pa.RecordBatch.from_pylist([dict(zip([*_NAMES, "part", "kind", "text"], r, strict=True)) for r in rows], schema=_schema())

    made = cut(dealt.mapInArrow(run, _RESULT + ", part int, kind string, text string"), "simhash")

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for r in rows:
                plain = fingerprints_of([r["tail"], r["head"], _edited(r["tail"], r["head"])])
                out.append(dict(zip(_NAMES, _row(r["doc_id"], r["tail"], r["head"], (plain[0], plain[2], plain[1])), strict=True)))
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(list(_schema())[: len(_NAMES)]))

    heads = made.filter("kind = 'head'").select("part", F.col("text").alias("head"))
    order = [r["part"] for r in heads.select("part").orderBy("part").collect()]  # partition numbers only
    after = spark.createDataFrame([(p, order[(i + 1) % len(order)]) for i, p in enumerate(order)], "part int, next int")
    seams = made.filter("kind = 'tail'").select("doc_id", "part", F.col("text").alias("tail")).join(F.broadcast(after), "part").join(heads.withColumnRenamed("part", "next"), "next").select("doc_id", "tail", "head")
    return made.filter("kind = 'done'").select(*_NAMES).unionByName(seams.mapInArrow(stitch, _RESULT))


def _schema() -> pa.Schema:
    return pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("kind", pa.string()), ("text", pa.string())])
