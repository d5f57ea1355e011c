"""Encoding, decoding and counting the tokens of a text column (operators 5 and 8).

Nulls and empty texts have no tokens. Repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from greenwake.llm.bpe import Transducer, transducer
from greenwake.session import cut, partitions, ship


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every text, as the tokenizer file's library encodes it without added tokens."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            ids = [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in machine.encode_batch(_texts(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    slim = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("__text"))
    return slim.mapInArrow(run, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """encoded with a column `text`: the text of its ids, special tokens included; null ids give null."""
    ship(encoded.sparkSession)

    @F.pandas_udf("string")
    def text(ids):
        machine = transducer(path)
        return ids.map(lambda x: None if x is None else machine.decode(x))

    return encoded.withColumn("text", text(F.col(ids_col)))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: n_tokens, SHA-256 of its ids (little-endian unsigned 32-bit) and of the text decoded from them."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            n, a, b = [], [], []
            size, ids_hash, text_hash, decoder = 0, hashlib.sha256(), hashlib.sha256(), machine.decoder()
            for _, ids, last in machine.encode_stream(t.as_py() or "" for t in batch.column(1)):
                size += len(ids) // 4
                ids_hash.update(ids)
                text_hash.update(decoder.feed(np.frombuffer(ids, dtype="<u4")).encode())
                if last:
                    text_hash.update(decoder.end().encode())
                    n.append(size), a.append(ids_hash.hexdigest()), b.append(text_hash.hexdigest())
                    size, ids_hash, text_hash, decoder = 0, hashlib.sha256(), hashlib.sha256(), machine.decoder()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    slim = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("__text"))
    kind = slim.schema[0].dataType.simpleString()
    return slim.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


class _Numbers(dict):
    """Numbers from 0 for whatever is looked up."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


def _packed(*arrays: np.ndarray) -> bytes:
    """Integer arrays, narrowed and byte-planed so that they compress."""
    wide = [np.asarray(a).astype("<u4") for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps([np.ascontiguousarray(a.view(np.uint8).reshape(-1, 4).T).tobytes() for a in wide], protocol=5))


def _unpacked(blob: bytes) -> list[np.ndarray]:
    planes = pickle.loads(zstandard.ZstdDecompressor().decompress(blob))
    return [np.ascontiguousarray(np.frombuffer(p, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64) for p in planes]


class _Block:
    """Pre-token frequencies of some texts."""

    def __init__(self):
        self.ids, self.n_bytes, self.plain, self.edges = [], [], [], [0]
        self.words, self.index, self.times, self.chars = _Numbers(), [], [], 0

    def add(self, machine: Transducer, doc, text: str) -> None:
        count: Counter = Counter()
        for segment in machine.segments(text):
            count.update(machine.parts(segment))
        plain = sum(count.pop(i) for i in [p for p in count if not isinstance(p, str)])  # special tokens
        self.index.extend(map(self.words.__getitem__, count))
        self.times.extend(count.values())
        self.ids.append(doc), self.n_bytes.append(len(text.encode())), self.plain.append(plain), self.edges.append(len(self.index))
        self.chars += len(text)

    def rows(self, number: int, groups: int) -> Iterator[tuple[int, int, bytes]]:
        """(block, group, words) of its distinct pre-tokens by group, then (block, -1, frequencies)."""
        words = [w.encode() for w in self.words]
        group = np.fromiter((zlib.crc32(w) % groups for w in words), np.int64, len(words))
        order = np.argsort(group, kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        have, first = np.unique(group[order], return_index=True)
        for g, lo, hi in zip(have.tolist(), first, np.append(first[1:], len(words)), strict=True):
            some = [words[i] for i in order[lo:hi]]
            yield number, g, _packed(list(map(len, some)), np.frombuffer(b"".join(some), np.uint8))
        edges, index = np.array(self.edges), place[np.array(self.index, np.int64)]
        doc = np.repeat(np.arange(len(self.ids)), np.diff(edges))
        order = np.lexsort((index, doc))
        steps = np.diff(index[order], prepend=0)
        steps[edges[:-1][np.diff(edges) > 0]] = index[order][edges[:-1][np.diff(edges) > 0]]  # a text starts from 0
        yield number, -1, pickle.dumps((self.ids, _packed(self.n_bytes, self.plain, np.diff(edges), steps, np.array(self.times, np.int64)[order])))


#: Characters of the texts whose pre-token frequencies make a block.
BLOCK = 1 << 22


def counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: n_bytes, n_tokens and over_limit (n_tokens > limit).

    Texts become pre-token frequencies, a block of texts at a time. The blocks' distinct pre-tokens meet by hash, where
    each distinct one of the corpus has its pieces counted once; the numbers go back to the blocks, are multiplied by
    the frequencies and summed. No ids are kept. A pre-token goes out once a block, however often the texts hold it.
    """
    spark = docs.sparkSession
    ship(spark)
    groups = 2 * partitions(spark)
    slim = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("__text"))
    kind = slim.schema[0].dataType.simpleString()

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, block, number = transducer(path), _Block(), TaskContext.get().partitionId() << 32

        def out() -> pa.RecordBatch:
            rows = list(block.rows(number, groups))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["block", "grp", "body"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block.add(machine, doc, text.as_py() or "")
                if block.chars >= BLOCK:
                    yield out()
                    block, number = _Block(), number + 1
        if block.ids:
            yield out()

    def pieces(rows: pd.DataFrame) -> pd.DataFrame:
        distinct, asked = _Numbers(), []
        for blob in rows["body"]:
            lengths, flat = _unpacked(blob)
            ends = np.cumsum(lengths).tolist()
            raw = flat.astype(np.uint8).tobytes()
            asked.append([distinct[raw[lo:hi]] for lo, hi in zip([0, *ends], ends, strict=False)])
        n = transducer(path).count(list(distinct))
        return pd.DataFrame({"block": rows["block"], "grp": rows["grp"], "n": [_packed(n[a]) for a in asked]})

    def summed(block: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        ids, sizes, tokens = [], [], []
        n = np.concatenate([np.zeros(0, np.int64), *(_unpacked(b)[0] for b in counted.sort_values("grp")["n"])])
        for body in block["body"]:
            docs_, blob = pickle.loads(body)
            n_bytes, plain, held, steps, times = _unpacked(blob)
            doc = np.repeat(np.arange(len(held)), held)
            run = np.concatenate([[0], np.cumsum(steps)])
            index = run[1:] - run[np.cumsum(held) - held][doc]
            ids += docs_
            sizes.append(n_bytes)
            tokens.append(plain + np.bincount(doc, weights=n[index] * times, minlength=len(held)).astype(np.int64))
        return pd.DataFrame({id_col: pd.Series(ids, dtype=object), "n_bytes": np.concatenate(sizes), "n_tokens": np.concatenate(tokens)})

    blocks = cut(slim.mapInArrow(frequencies, "block long, grp int, body binary"), "frequencies")
    counted = blocks.filter("grp >= 0").groupBy("grp").applyInPandas(pieces, "block long, grp int, n binary")
    out = blocks.filter("grp < 0").groupBy("block").cogroup(counted.groupBy("block")).applyInPandas(summed, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
