"""MinHash near-dedup with bottom-k sketches of one hash function (operator 9).

A text's set is its distinct n-word shingles (fewer words: the whole sequence; none: empty, linked with nothing).
Texts of equal sets fall together first. A sketch is the k smallest hashes of the set. Two sets of likeness t
share about k*t sketch values, `need` of them five standard deviations below that, so it is enough to index each
sketch's rarest k - need + 1 values: values that only one sketch holds go first and cost nothing. Each inverted
list has a hub, the sketch with the most common values. Every sketch first meets the hub of its longest list alone.
Once those pairs are verified and joined to components, lists that still hold several of them give more: short ones
all pairs across components, longer ones the hub's. Members that their hub doesn't reach even so meet its other members
as far as their full sets, taken relative to the hub's, leave a link possible. The union-sketch estimate filters
candidates, exact likeness of the full sets decides. Intermediate tables are deleted as soon as nothing reads them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from greenwake.llm.components import components
from greenwake.llm.textbytes import shingles, utf8, words
from greenwake.session import cut, drop_cut, ship

K = 64
SHORT = 6
#: Further hubs that a list takes from among the members that no hub of theirs reaches.
LEADERS = 1
#: Estimated likeness to a hub from which a member counts as near, and up to which as far.
NEAR, FAR = 0.15, 0.6
#: Shingles of a hub, the first by hash, of which a member's row tells one by one whether it holds them.
HELD = 1024


def _sets(batch: pa.RecordBatch, column: int, n: int) -> Iterator[np.ndarray]:
    raw, at = utf8(batch.column(column))
    hashes, first = words(raw, at)
    for i in range(len(at) - 1):
        yield np.unique(shingles(hashes[first[i] : first[i + 1]], n))


def sketches(docs: DataFrame, n: int, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_id, sketch) of every row; set_id is null for an empty set."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, name, sketch = [], [], []
            for s in _sets(batch, 1, n):
                size.append(len(s))
                name.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sketch.append(s[:k].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(name, pa.binary()), pa.array(sketch, pa.binary())], names=["doc_id", "n_shingles", "set_id", "sketch"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__text"))
    return slim.mapInArrow(run, "doc_id long, n_shingles long, set_id binary, sketch binary")


def required(k: int, likeness: float) -> int:
    """Sketch values that two sets of this likeness share, but for a chance below 1e-6."""
    return max(1, math.floor(k * likeness - 5 * math.sqrt(k * likeness * (1 - likeness))))


def _floor(k: int, likeness: float) -> float:
    """The least estimate that sets of this likeness show, but for a chance below 1e-4."""
    return likeness - 4 * math.sqrt(likeness * (1 - likeness) / k)


def _postings(sets: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.frombuffer(x, dtype=np.int64) for x in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values))
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *values])), pa.array(ids)], names=["value", "id"])

    return sets.select("id", "sketch").mapInArrow(run, "value long, id long")


def _lists(sets: DataFrame, k: int, likeness: float) -> DataFrame:
    """(value, id, whole, weight) of each sketch's rarest values, those that a single sketch holds left out; whole is the
    full set's size, weight counts its values that are as common as this one or more, which is highest for the text that copies were made from."""
    postings = _postings(sets)
    held = postings.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    shared = postings.join(held, "value").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("by"))
    shared = shared.join(sets.select("id", "whole"), "id").withColumn("size", F.least(F.col("whole"), F.lit(k)))
    prefix = F.col("size") - F.least(F.lit(required(k, likeness)), F.ceil(F.col("size") * likeness - 1e-9)) + 1
    take = prefix - (F.col("size") - F.size("by"))
    central = F.col("size") - F.col("at") - (F.col("size") - F.col("many"))
    taken = shared.withColumn("take", take.cast("int")).filter("take > 0").select("id", "whole", "size", F.size("by").alias("many"), F.posexplode(F.expr("slice(by, 1, take)")).alias("at", "x"))
    return taken.select("x.value", "id", "whole", central.cast("long").alias("weight"))


def _estimated(pairs: DataFrame, sets: DataFrame, k: int, floor: float) -> DataFrame:
    """pairs whose union sketch estimates a likeness of floor or more, with the estimate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = np.zeros(batch.num_rows)
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                both = np.sort(np.concatenate([np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)]))
                twice = both[1:] == both[:-1]
                union = np.delete(both, np.flatnonzero(twice))[:k]
                # where neither sketch is cut short the estimate is the likeness itself
                value[i] = np.searchsorted(both[1:][twice], union[-1], "right") / len(union)
            made = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(value)], names=["a", "b", "e"])
            yield made.filter(pa.array(value >= floor - 1e-9))

    side = sets.select("id", "sketch")
    joined = pairs.join(side.select(F.col("id").alias("a"), F.col("sketch").alias("x")), "a").join(side.select(F.col("id").alias("b"), F.col("sketch").alias("y")), "b").select("a", "b", "x", "y")
    return joined.mapInArrow(run, "a long, b long, e double")


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """pairs with 100 * intersection >= percent * union over the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, both in _set_pairs(batches, n):
            keep = []
            for x, y in both:
                inter = int(np.isin(y, x, assume_unique=True).sum())
                keep.append(100 * inter >= percent * (len(x) + len(y) - inter))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _with_texts(pairs, texts, "a", "b").mapInArrow(run, "a long, b long")


def _relative(members: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """(hub, id, whole, common, rest, held, beyond) of members(hub, id): the size of the member's full set, how much of
    it the hub holds, the shingles that the hub doesn't hold, which of the hub's first HELD shingles the member holds
    (a bit each), and how many it holds of the hub's others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, both in _set_pairs(batches, n):
            whole, common, rest, held, beyond = [], [], [], [], []
            for x, y in both:
                own = y[~np.isin(y, x, assume_unique=True)]
                bits = np.zeros(-(-min(len(x), HELD) // 64) * 64, dtype=bool)
                bits[: min(len(x), HELD)] = np.isin(x[:HELD], y, assume_unique=True)
                whole.append(len(y)), common.append(len(y) - len(own)), rest.append(own.astype(np.int64))
                held.append(np.packbits(bits).view("<i8")), beyond.append(len(y) - len(own) - int(bits.sum()))
            columns = [pa.array(whole, pa.int64()), pa.array(common, pa.int64()), pa.array(rest, pa.list_(pa.int64())), pa.array(held, pa.list_(pa.int64())), pa.array(beyond, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["hub", "id", "whole", "common", "rest", "held", "beyond"])

    return _with_texts(members, texts, "hub", "id").mapInArrow(run, "hub long, id long, whole long, common long, rest array<long>, held array<long>, beyond long")


def _with_texts(pairs: DataFrame, texts: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, text of a, text of b), the pairs of one a side by side; texts are zstd-compressed."""
    wanted = texts.select("id", "packed")
    joined = pairs.select(a, b).join(wanted.select(F.col("id").alias(b), F.col("packed").alias("y")), b)
    return joined.join(wanted.select(F.col("id").alias(a), F.col("packed").alias("x")), a).select(a, b, "x", "y")


def _set_pairs(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, Iterator[tuple[np.ndarray, np.ndarray]]]]:
    """Each batch of _with_texts with the full sets of its rows; an a's set is made once for the rows that follow."""
    open_ = zstandard.ZstdDecompressor().decompress
    held: tuple[int | None, np.ndarray | None] = (None, None)

    def full(packed: bytes) -> np.ndarray:
        return next(_sets(pa.RecordBatch.from_arrays([pa.array([open_(packed)], pa.binary())], names=["t"]), 0, n))

    def rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        nonlocal held
        for i, left, right in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
            if held[0] != i:
                held = (i, full(left.as_py()))
            yield held[1], full(right.as_py())

    for batch in batches:
        yield batch, rows(batch)


def _packed(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, packed) of the texts with those ids, one a row id, zstd-compressed before they are moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([squeeze((t or "").encode()) for t in batch.column(1).to_pylist()], pa.binary())], names=["id", "packed"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("__text")).filter("id is not null")
    return texts.mapInArrow(run, "id long, packed binary").join(ids.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])


def _pairs(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def _placed(tagged: DataFrame, links: DataFrame) -> DataFrame:
    """tagged with the components of the member (c) and of its list's hub (hc)."""
    where = components(links).select(F.col("node").alias("id"), F.col("component").alias("c"))
    out = tagged.drop("c", "hc").join(where, "id", "left").join(where.select(F.col("id").alias("hub"), F.col("c").alias("hc")), "hub", "left")
    return out.withColumn("c", F.coalesce("c", "id")).withColumn("hc", F.coalesce("hc", "hub"))


def _open(placed: DataFrame) -> DataFrame:
    """The lists that hold several components."""
    return placed.join(placed.groupBy("value").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low != high").select("value"), "value")


def _more(links: DataFrame, pairs: DataFrame, sets: DataFrame, texts: DataFrame, n: int, percent: int, k: int, high: float) -> tuple[DataFrame, DataFrame]:
    """links (which go) and what pairs add to them, and the pairs whose estimate was high enough to be verified."""
    near = cut(_estimated(pairs, sets, k, high), "pairs")
    more = cut(links.unionByName(_verified(near, texts, n, percent)), "links")
    drop_cut(links)
    return more, near


def _met(rows: DataFrame, k: int, likeness: float) -> DataFrame:
    """Pairs (a, b) of rows(value, id, c, whole, weight) that meet in a list, unless they are of one component, their
    sizes rule a link out, or too few of their values are as common as the list's for it to be the rarest they share.
    With a column `alone`, one of a pair has it true."""
    alone = "alone" in rows.columns
    x, y = (rows.select("value", *[F.col(c).alias(f"{c}_{tag}") for c in ("id", "c", "whole", "weight", *(["alone"] if alone else []))]) for tag in "xy")
    small, large = F.least("whole_x", "whole_y"), F.greatest("whole_x", "whole_y")
    part = likeness / (1 + likeness) * (1 + small / large)  # of the larger set
    shown = F.when(large <= k, part * large).otherwise(k * part - 5 * F.sqrt(k * part * (1 - part)))
    fits = (small >= likeness * large - 1e-9) & (F.least("weight_x", "weight_y") >= F.least(shown, small) - 1e-9)
    if alone:
        fits = (F.col("alone_x") | F.col("alone_y")) & fits
    return _pairs(x.join(y, "value").filter(F.expr("id_x < id_y and c_x != c_y") & fits), "id_x", "id_y").distinct()


def _possible(seen: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that can still link, of members seen(hub, id, whole, common, rest, held, beyond, c, loose) of one hub
    and different components, one of them loose at least. Nothing that can link is left out.

    Two members share at most the lesser of their parts in common with the hub, and what they share of their rests.
    Of the hub's first HELD shingles the bits tell exactly what they share: members that were changed in different
    places lose different ones, so that of a family's pairs hardly more than its links are left.
    Pairs that share nothing of their rests are tried by classes of (whole, common), of which there are few however
    many members there are. Others meet on a shingle of their rests: a member that holds `common` of the hub must
    share at least percent% of itself less `common` with its partner's rest, so only that many less of its rarest
    rest shingles, rarest within the hub's members, are indexed; where two meet, what follows in both bounds the rest.
    """
    need = lambda x, y: percent * (F.col(x) + F.col(y))  # noqa: E731  (100 + percent) * intersection is that at least
    both = 100 + percent
    side = lambda df, tag, *more: df.select("hub", *[F.col(c).alias(f"{c}{tag}") for c in ("whole", "common", *more)])
    # no common rest: by classes
    classes = seen.groupBy("hub", "whole", "common").agg(F.max("loose").alias("loose"))
    close = F.least("common_x", "common_y") * both >= need("whole_x", "whole_y")
    bits = F.aggregate(F.zip_with("held_x", "held_y", lambda x, y: F.bit_count(x.bitwiseAND(y)).cast("long")), F.lit(0).cast("long"), lambda n, m: n + m)
    within = bits + F.least("beyond_x", "beyond_y")
    met = side(classes.filter("loose"), "_x").join(side(classes, "_y"), "hub").filter(close)
    bare = met.join(side(seen.filter("loose"), "_x", "id", "c", "held", "beyond"), ["hub", "whole_x", "common_x"]).join(side(seen, "_y", "id", "c", "held", "beyond"), ["hub", "whole_y", "common_y"])
    bare = bare.filter(F.expr("c_x != c_y") & (within * both >= need("whole_x", "whole_y"))).select(F.col("id_x").alias("x"), F.col("id_y").alias("y"))
    # a common rest: by its shingles
    tokens = seen.select("hub", "id", F.explode("rest").alias("token"))
    often = tokens.groupBy("hub", "token").agg(F.count("*").alias("df")).filter("df > 1")
    order = tokens.join(often, ["hub", "token"]).groupBy("hub", "id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("by"))
    shared = seen.drop("rest").join(order, ["hub", "id"]).withColumn("many", F.size("by"))
    least = F.greatest(F.lit(1), F.ceil(F.col("whole") * percent / 100 - 1e-9) - F.col("common"))
    shared = shared.withColumn("take", (F.col("many") - least + 1).cast("int")).filter("take > 0")
    shared = shared.select("hub", "id", "whole", "common", "c", "loose", "held", "beyond", "many", F.posexplode(F.expr("slice(by, 1, take)")).alias("at", "t")).withColumn("token", F.col("t.token"))
    x = shared.filter("loose").select("hub", "token", *[F.col(c).alias(f"{c}_x") for c in ("id", "whole", "common", "c", "held", "beyond", "many", "at")])
    y = shared.select("hub", "token", *[F.col(c).alias(f"{c}_y") for c in ("id", "whole", "common", "c", "held", "beyond", "many", "at")])
    left = F.least(F.col("many_x") - F.col("at_x"), F.col("many_y") - F.col("at_y"))
    alike = (F.least("common_x", "common_y") + left) * both >= need("whole_x", "whole_y")
    rich = x.join(y, ["hub", "token"]).filter(F.expr("c_x != c_y") & alike & ((within + left) * both >= need("whole_x", "whole_y"))).select(F.col("id_x").alias("x"), F.col("id_y").alias("y"))
    return _pairs(bare.unionByName(rich), "x", "y").distinct()


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs.

    component_id is the smallest id reachable over links of likeness percent/100 or more, kept whether it is the
    row's own. A null or empty text, or one of separators only, has n_shingles 0 and links with nothing. Rows of one
    id count as one document; a null id links with nothing (component_id null, kept true). Other columns of docs,
    whatever their names, are not read; an empty table gives none.
    """
    likeness = percent / 100
    drawn = cut(sketches(docs, n, k, id_col, text_col), "sketches")
    seen = cut(drawn.select("doc_id", "n_shingles", "set_id"), "sizes")
    named = seen.filter("set_id is not null and doc_id is not null")
    groups = named.groupBy("set_id").agg(F.min("doc_id").alias("id"))
    same = named.select("doc_id", "set_id").join(groups, "set_id").filter("doc_id != id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    first = named.join(groups.withColumnRenamed("id", "doc_id"), ["set_id", "doc_id"]).dropDuplicates(["set_id"]).select("doc_id", "set_id")
    sets = cut(drawn.join(first, ["doc_id", "set_id"]).dropDuplicates(["set_id"]).select(F.col("doc_id").alias("id"), "sketch", F.col("n_shingles").alias("whole")), "sets")
    drop_cut(drawn)
    lists = cut(_lists(sets, k, likeness), "lists")
    hubs = lists.groupBy("value").agg(F.max(F.struct("weight", -F.col("id"))).alias("m"), F.count("*").alias("n")).filter("n > 1")
    tagged = cut(lists.join(hubs.select("value", (-F.col("m.col2")).alias("hub"), "n"), "value"), "tagged")
    drop_cut(lists)
    texts = cut(_packed(docs, tagged, id_col, text_col), "texts")
    high = _floor(k, likeness)

    # 1: each sketch against the hub of its longest list
    one = tagged.groupBy("id").agg(F.max(F.struct("n", "value", "hub")).alias("m")).select("id", F.col("m.hub").alias("hub")).filter("id != hub")
    tried = cut(_estimated(_pairs(one, "id", "hub").distinct(), sets, k, 0), "pairs")
    links = cut(_verified(tried.filter(F.col("e") >= high), texts, n, percent), "links")

    # 2: lists that still hold several components: all pairs across them in short ones, the hub's in longer ones; then
    # the members of longer ones that no hub of theirs reaches take a further hub from among themselves, some times over
    open_ = cut(_open(_placed(tagged.withColumn("led", F.col("id") == F.col("hub")), links)), "open")
    drop_cut(tagged)
    pairs = _met(open_.filter(F.col("n") <= SHORT), k, likeness).unionByName(_pairs(open_.filter((F.col("n") > SHORT) & (F.col("c") != F.col("hc"))), "id", "hub"))
    links, near = _more(links, pairs.distinct().join(tried, ["a", "b"], "left_anti"), sets, texts, n, percent, k, high)
    drop_cut(tried, near)
    open_, before = cut(_open(_placed(open_.filter(F.col("n") > SHORT), links)), "open"), open_
    drop_cut(before)
    for _ in range(LEADERS):
        free = open_.join(open_.filter("led").select("value", "c").distinct(), ["value", "c"], "left_anti")
        lead = free.groupBy("value").agg((-F.max(F.struct("weight", -F.col("id")))["col2"]).alias("lead"))
        links, near = _more(links, _pairs(free.join(lead, "value").filter("id != lead"), "id", "lead").distinct(), sets, texts, n, percent, k, high)
        open_, before = cut(_open(_placed(open_.join(lead, "value", "left").withColumn("led", F.col("led") | F.coalesce(F.col("id") == F.col("lead"), F.lit(False))).drop("lead"), links)), "open"), open_
        drop_cut(before, near)

    # 3: members of longer lists that their hub doesn't reach, against the hub's other members. Likeness being a metric,
    # two that link are both near to the hub or both far from it (the bounds overlap by more than the estimates' errors).
    # Near ones: full sets relative to the hub's tell which can link at all. Far ones: pairs of a list, unless both are
    # near as well.
    members = open_.filter("id != hub").select("hub", "id", "c", (F.col("c") != F.col("hc")).alias("loose")).distinct()
    members = cut(_estimated(members.select(F.col("hub").alias("a"), F.col("id").alias("b")), sets, k, 0).withColumnsRenamed({"a": "hub", "b": "id"}).join(members, ["hub", "id"]), "members")
    relative = cut(_relative(members.filter(F.col("e") >= NEAR), texts, n).join(members.drop("e"), ["hub", "id"]), "relative")
    far = open_.join(members.filter((F.col("e") < FAR) & F.col("loose")).select("hub", "id", (F.col("e") < NEAR).alias("alone")), ["hub", "id"]).select("value", "id", "c", "whole", "weight", "alone")
    pairs = _possible(relative, percent).unionByName(_met(far, k, likeness)).distinct()
    links, last = _more(links, pairs, sets, texts, n, percent, k, high)
    drop_cut(open_, last, relative, members, texts, sets)

    whole = components(links.unionByName(same))
    out = seen.select("doc_id", "n_shingles").join(whole.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
