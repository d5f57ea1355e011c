"""Removal of long repeats between documents over run-length indexes (operator 2).

Every `span`-byte string of a document is assigned to its minimiser, the ANCHOR-byte string in it of least hash; a run
of strings with one minimiser and the bytes they cover are a context. Equal strings have equal minimisers, so a match
can only lie between contexts of one anchor. Hashes alone are moved first: anchors that one document alone holds are
dropped, and of equal contexts one stays, that of the smallest id, as the others repeat it whole. The distinct contexts
of anchors that have several meet in shards by anchor; each shard builds run-length indexes over them, each of whole anchors and
of bounded text, and streams every context's matching statistics through its own. Copies of a context within a batch of documents become one before they are
shuffled, so no shard gathers a passage from all documents.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from greenwake.llm.names import unused
from greenwake.llm.runindex import RunLengthIndex
from greenwake.llm.textbytes import mix, release, slices, utf8
from greenwake.session import cut, drop_cut, partitions, ship, small_batches

SPAN = 50
ANCHOR = 24
#: Windows whose minimisers are found at once.
CHUNK = 1 << 16
#: Bytes of texts, and of compressed texts, that a task looks at together.
BATCH, PACKED_BATCH = 4 << 20, 2 << 20
#: Bytes of texts of an index, unless one anchor has more, and contexts that are sorted together.
INDEX, SORTED = 1 << 19, 1 << 17
#: The bits of a context's hash that tell it from others of its anchor.
_NAME = np.uint64(0xFFFFFFFFFFFF)
#: The bits of an anchor's hash that tell it from others; the top ones choose where anchors are compared.
_ANCHOR_NAME = np.uint64(0xFFFFFFFFFF)


def _pack(*columns) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(columns, protocol=5))


def _unpack(blob: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


_UP = np.uint64(0x9E3779B97F4A7C15)
_DOWN = np.uint64(pow(int(_UP), -1, 1 << 64))


def _pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of whole documents of CHUNK bytes together, or of CHUNK bytes of a longer one, so that a document
    falls into the same contexts whatever lies beside it."""
    i, last = 0, len(offsets) - 1
    while i < last:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        for s in range(int(offsets[i]), max(int(offsets[j]), int(offsets[i]) + 1), CHUNK):
            yield s, min(s + CHUNK, int(offsets[j]))
        i = j


def contexts(raw: np.ndarray, offsets: np.ndarray, span: int = SPAN, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(document, start in it, strings, anchor's hash, context's hash) of the contexts of a batch of texts."""
    wide = span - anchor + 1
    docs, starts, counts, hashes, whole = [], [], [], [], []
    up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(CHUNK + span, _UP)]))
    down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(CHUNK + span, _DOWN)]))
    raw = np.ascontiguousarray(raw)
    closed = np.maximum(offsets[:-1], offsets[1:] - span + 1)  # a document's first place without a whole string
    with np.errstate(over="ignore"):
        for s, stop in _pieces(offsets):
            part = raw[s : min(stop + span - 1, len(raw))]
            if len(part) < span:
                continue
            eight = np.ndarray((len(part) - 7,), dtype="<u8", buffer=part, strides=(1,))
            n = len(part) - anchor + 1
            x = eight[:n] * np.uint64(0x9E3779B97F4A7C15)
            for o in [*range(8, anchor - 7, 8)]:
                x = (x ^ (x >> np.uint64(32))) + eight[o : n + o] * np.uint64(0xC2B2AE3D27D4EB4F)
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            low = (x & np.uint64(0xFFFFFFFFFFFE0000)) | np.arange(n, dtype=np.uint64)
            width = 1
            while 2 * width <= wide:
                low = np.minimum(low[:-width], low[width:])
                width *= 2
            if wide > width:
                low = np.minimum(low[: -(wide - width)], low[wide - width :])
            at = (low & np.uint64(0x1FFFF)).astype(np.int32)
            n = len(at)
            # documents that touch this chunk, and where in it their strings begin and end
            d = np.arange(max(0, np.searchsorted(offsets, s, "right") - 1), min(np.searchsorted(offsets, s + n, "left"), len(offsets) - 1))
            lo, hi = np.maximum(offsets[d], s) - s, np.minimum(closed[d], s + n) - s
            d, lo, hi = d[hi > lo], lo[hi > lo], hi[hi > lo]
            if not len(d):
                continue
            new = np.zeros(n + 1, dtype=bool)
            new[1:n] = at[1:] != at[:-1]
            new[lo], new[hi] = True, True
            begin = np.flatnonzero(new)
            owner = np.searchsorted(lo, begin, "right") - 1
            ok = (owner >= 0) & (begin < hi[np.maximum(owner, 0)])
            end = np.append(begin[1:], n)
            begin, end, owner = begin[ok], end[ok], owner[ok]
            docs.append(d[owner])
            starts.append(begin + s - offsets[d[owner]])
            counts.append(end - begin)
            hashes.append(x[at[begin]])
            run = np.concatenate([[np.uint64(0)], np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)])])
            whole.append(mix((run[end + span - 1] - run[begin]) * down[begin] + (end - begin).astype(np.uint64)))
    none = np.zeros(0, np.int64)
    return (np.concatenate([none, *docs]).astype(np.uint32), np.concatenate([none, *starts]).astype(np.uint32), np.concatenate([none, *counts]).astype(np.uint8), *(np.concatenate([none.astype(np.uint64), *h]) for h in (hashes, whole)))


def _names(anchor: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """64-bit names of contexts, by which documents find theirs again."""
    return (whole & _NAME) | anchor << np.uint64(48)


def _low(values: np.ndarray, n: int) -> np.ndarray:
    """The n low bytes of each value, a row each."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n])


def _high(rows: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(rows), 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return wide.view("<u8").ravel()


def _heads(*columns: np.ndarray) -> np.ndarray:
    """First places of the runs of equal rows in sorted columns."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _split(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, rows) of an integer column."""
    order = np.argsort(key, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if len(key) else []
    for i, lo in enumerate(edge):
        hi = edge[i + 1] if i + 1 < len(edge) else len(key)
        yield int(key[order[lo]]), order[lo:hi]


def _rows(pairs: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in pairs], pa.int32()), pa.array([b for _, b in pairs], pa.binary())], names=["key", "blob"])


def _table(pairs: list[tuple[int, bytes]]) -> pa.Table:
    return pa.Table.from_batches([_rows(pairs)])


def _blobs(group: pa.Table) -> Iterator[tuple]:
    """A group's blobs, opened one at a time."""
    for blob in group["blob"]:
        yield _unpack(blob.as_buffer())


def _indexed(of_anchor: dict[int, list[int]], size: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of the texts that share their anchor with others, as many whole anchors together as INDEX bytes hold."""
    own: list[int] = []
    held = 0
    for texts in of_anchor.values():
        if len(texts) < 2:
            continue
        n = int(size[texts].sum())
        if own and held + n > INDEX:
            yield np.sort(np.array(own, dtype=np.int64))
            own, held = [], 0
        own += texts
        held += n
    if own:
        yield np.sort(np.array(own, dtype=np.int64))


def _place(ids: np.ndarray, n: int) -> np.ndarray:
    """The part of n that gathers a document's findings."""
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n


class _Documents:
    """The (id, text hash) keys of documents met so far, numbered."""

    def __init__(self):
        self.ids, self.hashes, self.n = [], [], 0

    def add(self, ids: np.ndarray, hashes: np.ndarray) -> int:
        self.ids.append(ids)
        self.hashes.append(hashes)
        self.n += len(ids)
        return self.n - len(ids)

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *self.ids]), np.concatenate([none, *self.hashes])


def _by_document(doc: np.ndarray, ids: np.ndarray, hashes: np.ndarray, parts: int, *columns: np.ndarray) -> list[tuple[int, bytes]]:
    """Rows for the parts that gather documents' findings: the documents' keys, then the columns by document."""
    out = []
    for part, rows in _split(_place(ids[doc], parts)):
        used, back = np.unique(doc[rows], return_inverse=True)
        out.append((part, _pack(ids[used], hashes[used], back.astype(np.uint32), *(c[rows] for c in columns))))
    return out


def _joined(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs sorted by document and start, those of a document that touch made one."""
    if not len(doc):
        return doc.astype(np.int64), start.astype(np.uint32), end.astype(np.uint32)
    d = doc.astype(np.int64)
    s, e = start + d * (1 << 33), end + d * (1 << 33)
    top = np.maximum.accumulate(e)
    head = np.flatnonzero(np.concatenate([[True], s[1:] > top[:-1]]))
    return d[head], (s[head] - d[head] * (1 << 33)).astype(np.uint32), (top[np.append(head[1:] - 1, len(d) - 1)] - d[head] * (1 << 33)).astype(np.uint32)


def _regrouped(group: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Documents' keys (id, text hash), where each one's entries begin, and the columns of _by_document in that order."""
    seen, doc, columns = _Documents(), [], []
    for ids, hashes, back, *rest in _blobs(group):
        doc.append(back.astype(np.int64) + seen.add(ids, hashes))
        columns.append(rest)
    keys, number = np.unique(np.stack(seen.all(), axis=1), axis=0, return_inverse=True)
    own = number.ravel()[np.concatenate(doc)]
    order = np.argsort(own, kind="stable")
    return keys, np.searchsorted(own[order], np.arange(len(keys) + 1)), [np.concatenate(c)[order] for c in zip(*columns, strict=True)]


def spans(docs: DataFrame, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, starts binary, ends binary): sorted, disjoint byte runs (uint32) that repeat.

    A byte is in a run if a `span`-byte string over it also starts in a document with a smaller id. A null id
    neither repeats nor is repeated; rows of one id don't match one another.
    """
    spark = docs.sparkSession
    ship(spark)
    parts = partitions(spark)
    groups = 2 * parts  # shards; the keys after them carry what needs none
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= span))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn, batch in enumerate(slices(batches, 2, BATCH)):
            ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            doc, _, _, anchor, whole = contexts(*utf8(batch.column(2)), span)
            if not len(doc):
                continue
            whole &= _NAME
            order = np.lexsort((ids[doc], whole, anchor))
            doc, anchor, whole = doc[order], anchor[order], whole[order]
            head = _heads(anchor, whole)
            late = ids[doc] > np.repeat(ids[doc[head]], np.diff(np.append(head, len(doc))))
            once = np.zeros(len(doc), dtype=bool)
            once[_heads(anchor, whole, doc)] = True
            pairs = []
            sent = np.flatnonzero(once & ~late)
            for key, rows in _split((anchor[sent] >> np.uint64(48)).astype(np.int64) % groups):
                rows = sent[rows]
                rows = rows[np.argsort(doc[rows], kind="stable")]
                used, back = np.unique(doc[rows], return_inverse=True)
                pairs.append((key, _pack("ask", ids[used], hashes[used], np.diff(back, prepend=0).astype(np.uint16), _low(anchor[rows], 5), _low(whole[rows], 6))))
            rows = np.flatnonzero(once & late)
            if len(rows):
                pairs.append((groups + (int(ids[0]) + turn) % parts, _pack("known", ids, hashes, doc[rows], _names(anchor[rows] & _ANCHOR_NAME, whole[rows]))))
            yield _rows(pairs)

    def shared_anchors(group: pa.Table) -> pa.Table:
        release()
        seen, doc, anchor, whole = _Documents(), [], [], []
        out = []
        for part in _blobs(group):
            if part[0] == "known":
                _, ids, hashes, d, name = part
                out += _by_document(d, ids, hashes, parts, name, np.ones(len(d), np.uint8))
                continue
            _, ids, hashes, d, a, w = part
            doc.append((np.cumsum(d.astype(np.int64)) + seen.add(ids, hashes)).astype(np.int32)), anchor.append(_high(a)), whole.append(_high(w))
        if doc:
            ids, hashes = seen.all()
            doc, anchor, whole = (np.concatenate(x) for x in (doc, anchor, whole))
            turns, rows, lates = len(doc) // SORTED + 1, [], []
            for turn in range(turns):  # an anchor's contexts fall into one turn
                at = np.flatnonzero((anchor >> np.uint64(8)) % np.uint64(turns) == turn)
                if not len(at):
                    continue
                at = at[np.lexsort((ids[doc[at]], whole[at], anchor[at]))]
                own = ids[doc[at]]
                of_anchor, of_context = _heads(anchor[at]), _heads(anchor[at], whole[at])
                size = np.diff(np.append(of_anchor, len(at)))
                several = np.add.reduceat(np.isin(np.arange(len(at)), of_context, assume_unique=True).astype(np.int64), of_anchor) > 1
                shared = np.repeat(np.minimum.reduceat(own, of_anchor) < np.maximum.reduceat(own, of_anchor), size)
                late = own > np.repeat(own[of_context], np.diff(np.append(of_context, len(at))))
                found = late | (shared & np.repeat(several, size))
                rows.append(at[found]), lates.append(late[found].astype(np.uint8))
            rows, late = np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.uint8), *lates])
            out += _by_document(doc[rows], ids, hashes, parts, _names(anchor[rows], whole[rows]), late)
        return _table(out)

    def gathered(group: pa.Table) -> pa.Table:
        release()
        keys, edges, columns = _regrouped(group)
        places = [_pack(*(c[lo:hi] for c in columns)) for lo, hi in zip(edges, edges[1:], strict=False)]
        return pa.table([keys[:, 0], keys[:, 1], pa.array(places, pa.binary())], names=["doc_id", "text_hash", "places"])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        for turn, batch in enumerate(slices(batches, 2, PACKED_BATCH)):
            if not batch.num_rows:
                continue
            ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = [open_(x) for x in batch.column(2).to_pylist()]
            raw, offsets = utf8(pa.array(texts, pa.large_binary()))
            doc, start, count, anchor, whole = contexts(raw, offsets, span)
            name = _names(anchor & _ANCHOR_NAME, whole)
            found = np.full(len(doc), 2, np.uint8)  # 1: repeats whole, 0: goes to a shard, 2: neither
            first = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            for d, places in enumerate(batch.column(3).to_pylist()):
                wanted, late = _unpack(places)
                order = np.lexsort((late == 0, wanted))
                wanted, late = wanted[order], late[order]
                mine = name[first[d] : first[d + 1]]
                at = np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)
                found[first[d] : first[d + 1]] = np.where(wanted[at] == mine, late[at], 2)
            pairs: list[tuple[int, bytes]] = []
            begin = offsets[doc] + start
            for group, rows in _split(np.where(found == 0, (anchor & _ANCHOR_NAME).astype(np.int64) % groups, -1)):
                if group < 0:
                    continue
                used, back = np.unique(doc[rows], return_inverse=True)
                length = count[rows].astype(np.int64) + span - 1
                flat = b"".join(raw[b : b + n].tobytes() for b, n in zip(begin[rows].tolist(), length.tolist(), strict=True))
                pairs.append((group, _pack("ask", ids[used], hashes[used], back.astype(np.uint32), start[rows], anchor[rows] & _ANCHOR_NAME, length.astype(np.uint8), flat)))
            rows = np.flatnonzero(found == 1)
            if len(rows):
                rows = rows[np.lexsort((start[rows], doc[rows]))]
                d, s, e = _joined(doc[rows], start[rows], start[rows].astype(np.int64) + count[rows] + span - 1)
                pairs.append((groups + (int(ids[0]) + turn) % parts, _pack("known", ids, hashes, d, s, e)))
            yield _rows(pairs)

    def matched(group: pa.Table) -> pa.Table:
        release()
        out, seen = [], _Documents()
        number: dict[tuple[int, bytes], int] = {}
        of_anchor: dict[int, list[int]] = {}
        texts: list[bytes] = []
        where: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for part in _blobs(group):
            if part[0] == "known":
                _, ids, hashes, d, s, e = part
                out += _by_document(d, ids, hashes, parts, s, e)
                continue
            _, ids, hashes, back, start, anchor, lengths, flat = part
            base, at = seen.add(ids, hashes), 0
            text = np.empty(len(start), np.int64)
            for i, (h, n) in enumerate(zip(anchor.tolist(), lengths.tolist(), strict=True)):
                key = (h, flat[at : at + n])
                at += n
                t = number.get(key)
                if t is None:
                    t = number[key] = len(texts)
                    texts.append(key[1])
                    of_anchor.setdefault(h, []).append(t)
                text[i] = t
            where.append((text, back.astype(np.int64) + base, start.astype(np.int64)))
        if texts:
            ids, hashes = seen.all()
            text, doc, start = (np.concatenate(x) for x in zip(*where, strict=True))
            owner = np.full(len(texts), np.iinfo(np.int64).max)
            np.minimum.at(owner, text, ids[doc])
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            late = ids[doc] > owner[text]
            d, s, e = [doc[late]], [start[late]], [start[late] + size[text[late]]]
            hits, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for some in _indexed(of_anchor, size):
                hit, place = RunLengthIndex([texts[t] for t in some], owner[some], span).statistics()
                hits.append(some[hit]), places.append(place)
            hit, place = np.concatenate(hits), np.concatenate(places)
            if len(hit):
                order = np.lexsort((place, hit))
                hit, place = hit[order], place[order]
                first = np.searchsorted(hit, np.arange(len(texts) + 1))
                early = np.flatnonzero(~late & (np.diff(first)[text] > 0))
                n = np.diff(first)[text[early]]
                rows = np.repeat(early, n)
                nth = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
                p = place[first[text[rows]] + nth]
                d.append(doc[rows]), s.append(start[rows] + p), e.append(start[rows] + p + span)
            d, s, e = (np.concatenate(x) for x in (d, s, e))
            order = np.lexsort((s, d))
            d, s, e = _joined(d[order], s[order], e[order])
            out += _by_document(d, ids, hashes, parts, s, e)
        return _table(out)

    def merged(group: pa.Table) -> pa.Table:
        release()
        keys, edges, columns = _regrouped(group)
        starts, ends = [], []
        for lo, hi in zip(edges, edges[1:], strict=False):
            s, e = (c[lo:hi].astype(np.int64) for c in columns)
            order = np.argsort(s, kind="stable")
            s, e = s[order], np.maximum.accumulate(e[order])
            head = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
            starts.append(s[head].astype("<u4").tobytes())
            ends.append(e[np.append(head[1:] - 1, len(e) - 1)].astype("<u4").tobytes())
        return pa.table([keys[:, 0], keys[:, 1], pa.array(starts, pa.binary()), pa.array(ends, pa.binary())], names=["doc_id", "text_hash", "starts", "ends"])

    pair = "key int, blob binary"
    # what was shuffled for the places is gone before texts and contexts are shuffled
    with small_batches(spark):
        places = cut(slim.mapInArrow(anchors, pair).groupBy("key").applyInArrow(shared_anchors, pair).groupBy("key").applyInArrow(gathered, "doc_id long, text_hash long, places binary"), "places")
    asked = _squeezed(slim).join(places, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "packed", "places")
    found = asked.mapInArrow(extract, pair).groupBy("key").applyInArrow(matched, pair).groupBy("key").applyInArrow(merged, "doc_id long, text_hash long, starts binary, ends binary")
    with small_batches(spark):
        out = cut(found, "repeats")
    drop_cut(places)
    return out


def _squeezed(texts: DataFrame) -> DataFrame:
    """(doc_id, text_hash, packed) with texts compressed, so that moving them costs less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches, 2, BATCH):
            packed = [None if t is None else squeeze(t.encode()) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["doc_id", "text_hash", "packed"])

    return texts.select("doc_id", "text_hash", "text").mapInArrow(run, "doc_id long, text_hash long, packed binary")


def _kept(raw: bytes, starts: bytes | None, ends: bytes | None) -> tuple[bytes, int]:
    """What is left of a text without its repeated runs, and their number."""
    if not starts:
        return raw, 0
    s, e = np.frombuffer(starts, "<u4").tolist(), np.frombuffer(ends, "<u4").tolist()
    return b"".join(raw[a:b] for a, b in zip([0, *e], [*s, len(raw)], strict=True)), len(s)


def digests(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """Per row: n_bytes, n_removed, n_spans and the SHA-256 of the bytes that stay. A null or empty text has none to
    remove, nor has a row without an id; a repeated row gives a repeated result."""
    found = spans(docs, span)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = _squeezed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, 1, PACKED_BATCH):
            size, gone, runs, name = [], [], [], []
            for packed, s, e in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                raw = open_(packed)
                kept, n = _kept(raw, s, e)
                size.append(len(raw)), gone.append(len(raw) - len(kept)), runs.append(n), name.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (size, gone, runs)), pa.array(name, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = keyed.join(found, ["doc_id", "text_hash"], "left").select("doc_id", "packed", "starts", "ends")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """docs with the repeated runs cut from their texts, n_chars made to fit; what a cut leaves of a character goes too.

    A null text stays null, an empty one empty. Rows without an id stay as they are, rows of one id don't match one
    another. Other columns, whatever their names, stay as they are; an empty table stays empty.
    """
    found = spans(docs, span)

    @F.arrow_udf("string")
    def kept(text: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        some = pc.fill_null(pc.greater(pc.binary_length(starts), 0), False)
        new = [_kept(t.as_buffer().to_pybytes(), s.as_py(), e.as_py())[0].decode("utf-8", "ignore") for t, s, e in zip(text.filter(some), starts.filter(some), ends.filter(some), strict=True)]
        return pc.replace_with_mask(text, some, pa.array(new, text.type))

    id_, found_hash, starts, ends, text_hash = unused(docs, "id", "found_hash", "starts", "ends", "text_hash")
    found = found.toDF(id_, found_hash, starts, ends)
    keyed = docs.withColumn(text_hash, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    joined = keyed.join(found, (F.col("doc_id").cast("long") == F.col(id_)) & (F.col(text_hash) == F.col(found_hash)), "left")
    new = joined.withColumn("text", kept("text", starts, ends))
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(F.col(starts).isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return new.select(*docs.columns)
