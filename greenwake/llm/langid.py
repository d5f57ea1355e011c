"""Language ID by prediction by partial matching (operator 6).

One byte context tree a language, orders 0 to 3, escape method C with exclusion, statistics frozen after
fitting. A text's score under a language is its exact code length; the shortest wins. Bytes that no training text
holds share one symbol. The trees are fitted on at most `max_texts` whole texts a language, the bound on what the driver
gathers; it unrolls them once, a language after the other, and broadcasts the finished single-precision tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from greenwake.llm.textbytes import utf8
from greenwake.session import ship

UNDETERMINED = "und"
_MADE = ("lang_pred", "score", "bits_per_byte")
_LETTER = regex.compile(r"\p{L}")


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", max_texts: int = 600) -> dict:
    """Frozen counts {'langs', 'grams', 'counts'}: 4-byte grams of labelled texts a language.

    The texts of a language are those of the smallest xxhash64 of their key; rows whose language or text is null
    don't take part. No rows: no languages, and every prediction is `und`.
    """
    ship(labelled.sparkSession)
    rows = labelled.select(F.xxhash64(F.col(key_col).cast("string")).alias("h"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null and text != ''")
    # the smallest hashes of a language by way of those of its parts, as one language may hold most rows
    few = rows.select("lang", "h").withColumn("part", F.pmod(F.col("h"), F.lit(PARTS)))
    for keys in (["lang", "part"], ["lang"]):
        few = few.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).filter(F.col("r") <= max_texts).drop("r")
    top = few.groupBy("lang").agg(F.max("h").alias("top"))
    sample = rows.join(F.broadcast(top), "lang").filter("h <= top").select("lang", "text")  # a row a language

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            raw, at = utf8(batch.column(1))
            out = {}
            for i, lang in enumerate(langs):
                b = np.concatenate([np.zeros(3, np.uint8), raw[at[i] : at[i + 1]]]).astype(np.uint32)
                out.setdefault(lang, []).append(b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:])
            for lang, parts in out.items():
                g, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    kept = sample.mapInArrow(grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(kept["lang"].unique())
    all_grams = np.sort(kept["gram"].unique()).astype(np.uint32)
    counts = np.zeros((len(langs), len(all_grams)), dtype=np.int32)
    for k, lang in enumerate(langs):
        own = kept[kept["lang"] == lang]
        counts[k, np.searchsorted(all_grams, own["gram"].to_numpy())] = own["n"]
    return {"langs": langs, "grams": all_grams, "counts": counts}


class Trees:
    """The context trees of a model, unrolled to one row of code lengths (bits) for each context."""

    def __init__(self, model: dict):
        self.langs = model["langs"]
        grams = model["grams"]
        b = np.stack([(grams >> s) & 0xFF for s in (24, 16, 8, 0)]).astype(np.int64)
        seen = np.zeros(256, dtype=bool)
        seen[np.unique(b)] = True
        self.symbol = np.full(256, seen.sum(), dtype=np.int32)
        self.symbol[seen] = np.arange(seen.sum())
        self.unseen = max(1, 256 - int(seen.sum()))  # bytes that share the last symbol
        size = self.size = int(seen.sum()) + 1
        s = self.symbol[b].astype(np.int64)
        keys, orders = [np.zeros(1, np.int64)], []
        for order in range(4):
            key = np.zeros(len(grams), np.int64)
            for j in range(3 - order, 3):
                key = key * size + s[j]
            ctx, inverse = np.unique(key, return_inverse=True)
            parent = np.zeros(len(ctx), np.int64) if order <= 1 else np.searchsorted(keys[-1], ctx % size ** (order - 1))
            orders.append((len(ctx), inverse.ravel(), parent))
            keys.append(ctx)
        # rows: contexts of order 2, of order 1, the empty one, then those of order 3; a context of order 3 that no tree
        # holds falls to its last two bytes, then to the last one, then to none
        two, three = keys[3], keys[4]
        ones = np.full(size, -1, np.int32)
        ones[keys[2]] = len(two) + np.arange(len(keys[2]))
        none = len(two) + len(keys[2])
        ones[ones < 0] = none
        tail = np.full(size**2, -1, np.int32)
        tail[two] = np.arange(len(two))
        tail = np.where(tail < 0, np.tile(ones, size), tail)
        self.row = np.tile(tail, size)
        self.row[three] = none + 1 + np.arange(len(three))
        self.bits = np.stack([self._unrolled(counts, s[3], orders) for counts in model["counts"]])

    def _unrolled(self, counts: np.ndarray, last: np.ndarray, orders: list) -> np.ndarray:
        """One language's code lengths, flat: escape method C, symbols seen in a context left out of what it escapes to."""
        below = np.full((1, self.size), 1 / 256)
        below[0, -1] = self.unseen / 256
        tables = []
        for n, inverse, parent in orders:
            cell = np.bincount(inverse * self.size + last, weights=counts, minlength=n * self.size).reshape(n, self.size)
            hit, below = cell > 0, below[parent]
            both = cell.sum(1, keepdims=True) + hit.sum(1, keepdims=True)
            free = 1 - (below * hit).sum(1, keepdims=True)
            escape = np.where(both > 0, hit.sum(1, keepdims=True) / np.maximum(both, 1), 1.0)
            below = np.where(hit, cell / np.maximum(both, 1), escape * below / np.maximum(free, 1e-9))
            tables.append(below)
        probability = np.concatenate([tables[2], tables[1], tables[0], tables[3]])
        probability[:, -1] /= self.unseen
        return -np.log2(np.maximum(probability, 2.0**-40)).astype(np.float32).ravel()

    def lengths(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length in bits of each text (row) under each language (column)."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        size, zero = np.int32(self.size), self.symbol[0]
        for start in range(0, len(raw), CHUNK):
            end = min(start + CHUNK, len(raw))
            s = self.symbol[raw[max(0, start - 3) : end]]
            s = np.concatenate([np.full(end - start + 3 - len(s), zero, np.int32), s])
            a, b, c, d = s[:-3].copy(), s[1:-2].copy(), s[2:-1].copy(), s[3:]
            heads = offsets[np.searchsorted(offsets, start - 2) : np.searchsorted(offsets, end)] - start
            for shift, hidden in enumerate(((a, b, c), (a, b), (a,))):  # a text sees no bytes of the one before it
                at = heads + shift
                at = at[(at >= 0) & (at < end - start)]
                for x in hidden:
                    x[at] = zero
            cell = self.row[(a * size + b) * size + c].astype(np.int64) * size + d
            first = np.searchsorted(offsets, start, "right")
            own = np.concatenate([[first - 1], np.arange(first, np.searchsorted(offsets, end))])
            own = own[offsets[own + 1] > offsets[own]]
            begin = np.maximum(offsets[own] - start, 0)
            for k in range(len(self.langs)):
                out[own, k] += np.add.reduceat(self.bits[k][cell].astype(np.float64), begin)
        return out


#: Bytes scored at once.
CHUNK = 1 << 20
#: Parts that a language's rows are dealt to before its sample is drawn.
PARTS = 64
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def _letters(raw: np.ndarray, at: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Whether each text holds a letter; only texts without an ASCII one are looked at as Unicode."""
    n = np.diff(at)
    out = np.zeros(len(n), dtype=bool)
    some = np.flatnonzero(n > 0)
    if len(some):
        out[some] = np.logical_or.reduceat(_ASCII_LETTER[raw], at[some])
    for i in np.flatnonzero(~out & (n > 0)):
        out[i] = _LETTER.search(texts[int(i)].as_py()) is not None
    return out


def predict(docs: DataFrame, model: dict, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with lang_pred, score and bits_per_byte (after prefix) of every whole text; columns so named are replaced.

    score is the winner's weight against the others, 2 to the minus code length each, lengths being scaled to at
    most 64 bytes of text. `und` with score 0: a null text, one without a letter, or a model without languages.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(Trees(model) if model["langs"] else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            texts = batch.column(at_text)
            raw, at = utf8(texts)
            n = np.diff(at)
            letter = _letters(raw, at, texts)
            if trees is None:
                lang, score, rate = [UNDETERMINED] * len(n), np.zeros(len(n)), np.zeros(len(n))
            else:
                bits = trees.lengths(raw, at)
                best = bits.argmin(axis=1)
                rate = bits[np.arange(len(n)), best] / np.maximum(n, 1)
                gap = (bits - bits.min(axis=1, keepdims=True)) * np.minimum(1, 64 / np.maximum(n, 1))[:, None]
                score = np.where(letter, 1 / np.exp2(-np.minimum(gap, 1000)).sum(axis=1), 0.0)
                lang = [trees.langs[k] if ok else UNDETERMINED for k, ok in zip(best.tolist(), letter.tolist(), strict=True)]
            made = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *made_names])

    made_names = [prefix + n for n in _MADE]
    slim = docs.drop(*made_names)
    at_text = slim.columns.index(text_col)
    schema = T.StructType([*slim.schema.fields, *(T.StructField(n, t) for n, t in zip(made_names, (T.StringType(), T.DoubleType(), T.DoubleType()), strict=True))])
    return slim.mapInArrow(run, schema)
