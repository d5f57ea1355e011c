"""Secret scans with corpus-wide ownership frequency (operator 7), in DataFrame functions only.

Three kinds of base span are found by pattern. The method then looks at candidate values, those of the base spans and
long mixed tokens in the open: a value's hash is counted by distinct repositories and owners over the whole corpus.
A value that more than `widely` owners or more than `often` repositories hold is an example that gets copied; any other
is owner-specific and looks live, and each of its places becomes a span of kind `live`. Values themselves are never
written: the shared folder holds places and SHA-256 hashes only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from greenwake.llm.names import unused
from greenwake.session import cut

#: Kinds of base span in order: pattern, group that holds the secret, its least length. A pattern that ends in + with
#: a least length for the whole match is written with that length, which finds the same spans.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
#: Long tokens in the open, of which those with a letter and a digit are candidates.
OPEN = r"[A-Za-z0-9+/_=-]{24,}"
#: A value held by more owners than this is an example.
WIDELY = 2
#: So is one held by more repositories than this, whoever owns them.
OFTEN = 25


def _spans(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """array<struct<start, kind, end, value>> of the matches, in code points, end exclusive."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    parts = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(whole)).alias("gap"), whole.alias("whole"), value.alias("value"))
    empty = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["whole"])
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= least, F.concat(state["out"], F.array(one))).otherwise(state["out"]).alias("out"))

    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda s: s["out"])
    return F.when(text.rlike(pattern), found).otherwise(empty)


def _joined(spans: Column, names: list[str]) -> Column:
    table = F.array(*map(F.lit, names))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(table, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", owner_col: str = "source", repository_col: str = "doc_id", widely: int = WIDELY, often: int = OFTEN) -> DataFrame:
    """(row, id, text_hash, base, live, copied) of every row: base and live are arrays of struct<start, kind, end> by
    start then kind, copied is the number of candidates that are held widely.

    A null or empty text has no spans; a null owner is one owner, a null repository one repository. Repeated rows are
    scanned each, but count as one repository. row tells repeated rows apart. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = [_spans(text, *spec, kind).alias(name) for kind, (name, spec) in enumerate(KINDS.items())]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), F.coalesce(F.col(repository_col).cast("string"), F.lit("")).alias("repository"), F.xxhash64(text).alias("text_hash"), *found, _spans(text, OPEN, 0, 24, len(KINDS)).alias("open"))
    rows = rows.withColumn("open", F.filter("open", lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")))
    hashed = F.transform(F.concat(*KINDS, "open"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.unhex(F.sha2(s["value"], 256)).alias("hash")))
    base = F.array_sort(F.transform(F.concat(*KINDS), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    rows = cut(rows.select(F.monotonically_increasing_id().alias("row"), "id", "owner", "repository", "text_hash", base.alias("base"), hashed.alias("candidates")), "secrets")
    values = rows.select("row", "owner", "repository", F.explode("candidates").alias("s")).select("row", "owner", "repository", "s.*")
    held = values.groupBy("hash").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories"))
    held = held.select("hash", ((F.col("owners") <= widely) & (F.col("repositories") <= often)).alias("own"))
    span = F.struct("start", F.lit(len(KINDS)).alias("kind"), "end")
    live = values.join(held, "hash").groupBy("row").agg(F.array_sort(F.array_distinct(F.collect_list(F.when(F.col("own"), span)))).alias("live"), F.count_if(~F.col("own")).alias("copied"))
    out = rows.drop("candidates", "owner", "repository").join(live, "row", "left")
    return out.withColumn("live", F.coalesce("live", F.filter("base", lambda _: F.lit(False)))).withColumn("copied", F.coalesce("copied", F.lit(0)))


def _of_kind(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def digests(docs: DataFrame) -> DataFrame:
    """Per row: counts of the base kinds, the base spans' digest, all spans as text, and how many spans are live and how
    many candidates are held widely. A null or empty text has none of them; a repeated row gives a repeated result."""
    names = [*KINDS, "live"]
    found = scan(docs)
    counts = [_of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(
        F.col("id").alias("doc_id"), *counts, F.sha2(_joined(F.col("base"), names), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "live")), names).alias("spans"), F.size("live").cast("long").alias("n_live"), F.col("copied").alias("n_copied"),
    )


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every span (base and live; what overlaps or touches is one) replaced by mark, n_chars made to fit.

    A null text stays null, an empty one empty; repeated rows are all changed alike, rows without an id too. Other
    columns, whatever their names, stay as they are; an empty table stays empty.
    """
    id_, found_hash, hash_, spans_ = unused(docs, "id", "found_hash", "hash", "spans")
    found = scan(docs).withColumn("all", F.array_sort(F.concat("base", "live"))).filter(F.size("all") > 0)
    spans = found.groupBy(F.col("id").alias(id_), F.col("text_hash").alias(found_hash)).agg(F.first("all").alias(spans_))
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumn(hash_, F.xxhash64(text))
    joined = keyed.join(spans, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(hash_) == F.col(found_hash)), "left")

    def step(state: Column, s: Column) -> Column:
        apart = (s["start"] > state["at"]) | (state["at"] == 0)
        gap = F.substring(F.col("text"), state["at"] + 1, s["start"] - state["at"])
        out = F.when(apart, F.concat(state["out"], gap, F.lit(mark))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda s: F.substring(F.col("text"), s["at"] + 1, F.length("text"))
    new = F.aggregate(F.col(spans_), start, step, lambda s: F.concat(s["out"], rest(s)))
    hit = F.col(spans_).isNotNull()
    joined = joined.withColumn("text", F.when(hit, new).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return joined.select(*docs.columns)
