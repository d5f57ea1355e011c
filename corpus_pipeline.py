"""A training-data pipeline over `documents`: language ID, near-dedup, repeat removal, secret scan, packing."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from greenwake.llm import langid, minhash, packing, repeats, secrets
from greenwake.llm.names import unused
from greenwake.session import cut

#: The stages can't be said in SQL (trees, sketches, indexes, sequential packing); tests compare with brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter (null and empty ones among them) and those that no language's tree codes better than
    plain bytes; a null lang becomes the predicted one. With no labelled rows to learn from, only texts without a letter
    go. Repeated rows share their fate; an empty table stays empty."""
    if not (model := langid.train(docs))["langs"]:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    prefix = unused(docs, "lang_pred", "score", "bits_per_byte")[0].removesuffix("lang_pred") + "__"
    seen = langid.predict(docs, model, prefix=prefix)
    seen = seen.filter((F.col(f"{prefix}lang_pred") != langid.UNDETERMINED) & (F.col(f"{prefix}bits_per_byte") < 8))
    return seen.withColumn("lang", F.coalesce("lang", f"{prefix}lang_pred")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, the one of the smallest id, rows without an id coming last. Rows are
    told apart by id and text, so an id's other texts stay and a repeated row is a copy; rows without an id and without
    a word all stay. Of rows of one id and text that differ elsewhere, the least of their other columns stays. An empty
    table stays empty."""
    key_, bare_ = unused(docs, "key", "bare")
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(2**63 - 1))
    keyed = docs.withColumn(key_, key)
    seen = minhash.near_duplicates(keyed, n=5, percent=80, id_col=key_).select(F.col("doc_id").alias(key_), "n_shingles", "component_id").distinct()
    rows = keyed.select(key_, F.col("doc_id").alias("doc")).distinct().join(seen, key_)
    first = F.min(F.struct(F.col("doc").isNull().alias("last"), "doc", key_))
    kept = rows.groupBy("component_id").agg(first.alias("m"), F.max("n_shingles").alias("n")).select(F.col(f"m.{key_}").alias(key_), (F.col("n") == 0).alias(bare_))
    found = keyed.join(kept, key_)
    bare = F.col(bare_) & F.col("doc_id").isNull()
    others = [f.name for f in docs.schema if f.name != "text" and not re.search("map<|variant", f.dataType.simpleString())]
    one = found.filter(~bare).groupBy(key_).agg(F.min_by(F.struct(*docs.columns), F.struct(*others)).alias(bare_)).select(f"{bare_}.*")
    return one.unionByName(found.filter(bare).select(*docs.columns))


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that an earlier document holds are cut out; all rows stay, null and empty texts as
    they are. Rows without an id are neither cut nor cut from; an empty table stays empty."""
    return repeats.without_repeats(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all rows stay, null and empty texts as they are, repeated rows changed alike."""
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of the documents' pieces in bins; a null or empty text is a piece of size 0, repeated rows are packed
    each, an empty table gives no rows."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("repeat_removal", repeat_removal),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
