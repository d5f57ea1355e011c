"""Byte-level BPE by a bounded-lookahead streaming transducer, and the piece counts taken from it.

The merge list alone decides how far to the right of a token's end a merge can still change that token: a
token made by rule r stands unless some earlier rule eats a piece on the right edge of its merge tree, which
needs that rule's right part, which again has an edge of its own. `lookahead` is the largest such sum over the
list. A window of bytes is merged, every token that ends at least `lookahead` bytes before the window's open end
is emitted, and the rest stays for the next window. A text is cut into segments where a space follows another
character, which always parts two pre-tokens, and its ids leave segment by segment; so apart from the text itself
memory is bounded by a segment group, a window and the memory of known runs. Windows of many runs advance side by side.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterable, Iterator

import numpy as np
import regex

#: The byte-level pre-tokenizer's pattern; words come first as they are the most, and no other alternative can
#: start where they can.
PATTERN = r" ?\p{L}++|'(?:[stmd]|re|ve|ll)| ?[^\s\p{L}\p{N}]++| ?\p{N}++|\s+(?!\S)|\s+"
#: Distinct pre-tokens a worker remembers; the memory is emptied when full, so results never depend on it.
REMEMBER = 500_000
#: Characters of a segment, and of the segments whose runs the transducer takes up at once.
SEGMENT, GROUP = 1 << 16, 1 << 20
WINDOW = 64
_NONE = np.uint32(0xFFFFFFFF)


def byte_characters() -> list[str]:
    """The printable stand-in of each byte: itself if printable Latin-1, else the next code point from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class Transducer:
    """Encoder and decoder of one byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._check(spec, path)
        chars = byte_characters()
        back = {c: b for b, c in enumerate(chars)}
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.pieces: list[bytes] = [b""] * size
        for text, i in vocab.items():
            self.pieces[i] = text.encode() if text in self.special else bytes(back[c] for c in text)
        for text, i in self.special.items():
            self.pieces[i] = text.encode()
        self.byte_id = np.array([vocab[c] for c in chars], dtype=np.uint32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.uint64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.uint64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.uint32)
        self._index(left, right, made)
        self.pair = {(a, b): r for r, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True))}
        self.lookahead = self._sufficient_lookahead(left.astype(np.int64), right.astype(np.int64), made.astype(np.int64))
        self.window = max(WINDOW, self.lookahead + max(map(len, self.pieces)))  # so a window's first token is always stable
        self.split = regex.compile(PATTERN)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.seam = None if any(regex.search(r"\s", t) for t in self.special) else regex.compile(r"(?<=\S)(?=\s)")
        self.sizes = np.array([*map(len, self.pieces), 1], dtype=np.int64)
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _check(spec: dict, path: str) -> None:
        """Refuses a file that asks for more than byte-level pre-tokens and plain merges."""
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and spec.get("post_processor") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [k for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip") if t.get(k)]
        if not plain or model.get("type", "BPE") != "BPE" or odd or (spec.get("decoder") or {}).get("type") != "ByteLevel":
            raise ValueError(f"{path}: not a plain byte-level BPE file {odd}")

    def _index(self, left: np.ndarray, right: np.ndarray, made: np.ndarray) -> None:
        """An open-addressed table from a pair of ids to (rank, product)."""
        bits = 18
        while (1 << bits) < 4 * len(left):
            bits += 1
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        key = (left << np.uint64(32)) | right
        slot = ((key * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)
        keys = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF), dtype=np.uint64)
        rank = np.full(1 << bits, _NONE, dtype=np.uint32)
        todo, order, self._probes = np.arange(len(key)), np.arange(len(key), dtype=np.uint32), 0
        while len(todo):
            free = keys[slot[todo]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            ask = todo[free]
            _, one = np.unique(slot[ask], return_index=True)
            put = ask[one]
            keys[slot[put]], rank[slot[put]] = key[put], order[put]
            todo = np.setdiff1d(todo, put)
            slot[todo] = (slot[todo] + 1) & self._mask
            self._probes += 1
        self._keys, self._rank, self._made = keys, rank, made

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.uint64) << np.uint64(32)) | b
        slot = ((key * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)
        out = np.where(self._keys[slot] == key, self._rank[slot], _NONE)
        open_ = np.flatnonzero((out == _NONE) & (self._keys[slot] != np.uint64(0xFFFFFFFFFFFFFFFF)))
        probes = 1
        while len(open_) and probes < self._probes:
            slot[open_] = (slot[open_] + 1) & self._mask
            hit = self._keys[slot[open_]] == key[open_]
            out[open_[hit]] = self._rank[slot[open_[hit]]]
            open_ = open_[~hit & (self._keys[slot[open_]] != np.uint64(0xFFFFFFFFFFFFFFFF))]
            probes += 1
        return out

    def _sufficient_lookahead(self, left: np.ndarray, right: np.ndarray, made: np.ndarray) -> int:
        """Bytes to the right of a token's end that can still change it, over all tokens."""
        size = [len(p) for p in self.pieces]
        made_by = {int(t): r for r, t in reversed(list(enumerate(made)))}
        eats: dict[int, tuple[list[int], list[int]]] = {}  # left part -> ranks, largest need so far
        longest = 0

        def need(edge: int, consumer: int) -> int:
            """What rules before consumer can need when the right edge is this token."""
            most, limit = 0, consumer
            while True:
                ranks, needs = eats.get(edge, ((), ()))
                at = int(np.searchsorted(ranks, limit)) if ranks else 0
                if at:
                    most = max(most, needs[at - 1])
                rule = made_by.get(edge)
                if rule is None:
                    return most
                edge, limit = int(right[rule]), rule

        for r in range(len(left)):
            a, b = int(left[r]), int(right[r])
            mine = size[b] + need(b, r)
            longest = max(longest, mine)
            ranks, needs = eats.setdefault(a, ([], []))
            ranks.append(r)
            needs.append(max(mine, needs[-1] if needs else 0))
        return longest

    def _merge(self, some: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """Ids of byte strings of about one length, a string a row, all rows merged together: one row's ids after the
        other's, and where they end."""
        length = np.fromiter(map(len, some), dtype=np.int64, count=len(some))
        n, width = len(some), int(length.max())
        filled = np.arange(width)[None, :] < length[:, None]
        ids = np.full((n, width), len(self.pieces), dtype=np.uint32)  # beyond a row's end: an id in no pair
        ids[filled] = self.byte_id[np.frombuffer(b"".join(some), dtype=np.uint8)]
        if width > 1:
            rank = self._ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
            row = np.arange(n)
            while len(row):
                at = rank[row].argmin(axis=1)
                best = rank[row, at]
                live = best != _NONE
                row, at, best = row[live], at[live], best[live]
                if not len(row):
                    break
                ids[row, at] = self._made[best]
                here = np.arange(width - 1)[None, :]
                later = np.minimum(here + 1 + (here >= at[:, None]), width - 1)
                ids[row, 1:] = np.take_along_axis(ids[row], later, 1)
                rank[row] = np.take_along_axis(rank[row], np.minimum(later - 1, width - 2), 1)
                rank[row, -1] = _NONE
                length[row] -= 1
                has_left = at > 0
                r, c = row[has_left], at[has_left]
                rank[r, c - 1] = self._ranks(ids[r, c - 1], ids[r, c])
                has_right = at + 1 < length[row]
                r, c = row[has_right], at[has_right]
                rank[r, c] = self._ranks(ids[r, c], ids[r, c + 1])
                end = ~has_right
                rank[row[end], at[end]] = _NONE
        filled = np.arange(width)[None, :] < length[:, None]
        return ids[filled], np.cumsum(length).tolist()

    def _merge_one(self, raw: bytes) -> list[int]:
        """Ids of one byte string, where there are few of its length."""
        ids = self.byte_id[np.frombuffer(raw, dtype=np.uint8)].tolist()
        pair, none = self.pair, len(self._made)
        rank = [pair.get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while rank and (best := min(rank)) < none:
            at = rank.index(best)
            ids[at : at + 2] = [int(self._made[best])]
            del rank[at]
            if at:
                rank[at - 1] = pair.get((ids[at - 1], ids[at]), none)
            if at < len(rank):
                rank[at] = pair.get((ids[at], ids[at + 1]), none)
        return ids

    def stream(self, data: bytes | Iterable[bytes]) -> Iterator[int]:
        """Ids of one unbroken run, emitted as soon as they are stable; data may come in pieces."""
        parts, hold, ended = iter([data] if isinstance(data, bytes) else data), bytearray(), False
        while True:
            while not ended and len(hold) <= self.window:
                piece = next(parts, None)
                if piece is None:
                    ended = True
                else:
                    hold += piece
            if not hold:
                return
            part = bytes(hold[: self.window])
            ids = np.array(self._merge_one(part))
            n, done = self._stable(ids, len(part), ended and len(hold) <= self.window)
            yield from ids[:n].tolist()
            del hold[:done]

    def _stable(self, ids: np.ndarray, size: int, last: bool) -> tuple[int, int]:
        """How many of a window's ids nothing to the window's right can change, and the bytes they cover."""
        if last:
            return len(ids), size
        ends = np.cumsum(self.sizes[ids])
        n = int(np.searchsorted(ends, size - self.lookahead, "right"))
        return n, int(ends[n - 1])

    def streamed(self, runs: list[bytes]) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(run, its next stable ids, whether they are its last) of unbroken runs, each advancing window by window."""
        at, live = [0] * len(runs), list(range(len(runs)))
        while live:
            by_size: dict[int, list[int]] = {}
            for i in live:
                size = min(len(runs[i]) - at[i], self.window)
                by_size.setdefault(size if size < 13 else 12 + (size // 8).bit_length(), []).append(i)
            live = []
            for some in by_size.values():
                for k in range(0, len(some), 1 << 12):
                    few = some[k : k + (1 << 12)]
                    windows = [runs[i][at[i] : at[i] + self.window] for i in few]
                    if len(few) < 16:
                        merged: Iterable[np.ndarray] = (np.array(self._merge_one(w), dtype=np.uint32) for w in windows)
                    else:
                        flat, ends = self._merge(windows)
                        merged = (flat[lo:hi] for lo, hi in zip([0, *ends], ends, strict=False))
                    for i, window, ids in zip(few, windows, merged, strict=True):
                        last = at[i] + len(window) == len(runs[i])
                        n, done = self._stable(ids, len(window), last)
                        at[i] += done
                        if not last:
                            live.append(i)
                        yield i, ids[:n], last

    def learn(self, fresh: list[str]) -> None:
        """Puts the ids of distinct pre-tokens, streamed through the transducer, into the worker's memory."""
        held: dict[int, list[bytes]] = {}
        for i, ids, last in self.streamed([w.encode() for w in fresh]):
            raw = ids.astype("<u4").tobytes()
            if not last:
                held.setdefault(i, []).append(raw)
            else:
                self.known[fresh[i]] = b"".join([*held.pop(i, ()), raw])

    def count(self, runs: list[bytes]) -> np.ndarray:
        """Number of pieces of each unbroken run; their ids are dropped window by window."""
        out = np.zeros(len(runs), dtype=np.int64)
        for i, ids, _ in self.streamed(runs):
            out[i] += len(ids)
        return out

    def parts(self, text: str) -> Iterator[str | int]:
        """Pre-tokens in order; a special token's string in the text comes as its id."""
        if self.specials is None or not any(s in text for s in self.special):
            yield from self.split.findall(text)
            return
        at = 0
        for m in self.specials.finditer(text):
            yield from self.split.findall(text[at : m.start()])
            yield self.special[m.group()]
            at = m.end()
        yield from self.split.findall(text[at:])

    def segments(self, text: str) -> Iterator[str]:
        """Pieces of a text that no pre-token and no special token reaches across, of about SEGMENT characters."""
        at = 0
        while self.seam is not None and len(text) - at > SEGMENT and (m := self.seam.search(text, at + SEGMENT)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def _emitted(self, group: list[tuple[int, list[str | int], bool]]) -> Iterator[tuple[int, bytes, bool]]:
        distinct = set().union(*(parts for _, parts, _ in group))
        fresh = [p for p in distinct if p not in self.known]
        if len(self.known) + len(fresh) > REMEMBER:
            self.known.clear()
            fresh = list(distinct)
        self.known.update((p, p.to_bytes(4, "little")) for p in fresh if not isinstance(p, str))
        self.learn([p for p in fresh if isinstance(p, str)])
        for i, parts, last in group:
            yield i, b"".join(map(self.known.__getitem__, parts)), last

    def encode_stream(self, texts: Iterable[str]) -> Iterator[tuple[int, bytes, bool]]:
        """(text's number, its next ids as little-endian unsigned 32-bit integers, whether they are its last) in order."""
        group, size = [], 0
        for i, text in enumerate(texts):
            done = 0
            for segment in self.segments(text):
                done += len(segment)
                group.append((i, list(self.parts(segment)), done == len(text)))
                size += len(segment)
                if size >= GROUP:
                    yield from self._emitted(group)
                    group, size = [], 0
        if group:
            yield from self._emitted(group)

    def encode_batch(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Each text's ids whole, as little-endian unsigned 32-bit integers."""
        held = []
        for _, ids, last in self.encode_stream(texts):
            held.append(ids)
            if last:
                yield b"".join(held)
                held = []

    def decoder(self) -> Decoder:
        """A fresh decoder of this file's ids."""
        return Decoder(self.pieces)

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """Text of ids."""
        machine = self.decoder()
        return "".join([*(machine.feed(ids[i : i + 4096]) for i in range(0, len(ids), 4096)), machine.end()])


class Decoder:
    """The incremental byte-to-text state machine: it holds the bytes of a character that is not whole yet, and gives
    U+FFFD for ill-formed ones."""

    def __init__(self, pieces: list[bytes]):
        self._pieces, self._machine = pieces, codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, ids: np.ndarray | list[int]) -> str:
        return self._machine.decode(b"".join(map(self._pieces.__getitem__, np.asarray(ids).tolist())))

    def end(self) -> str:
        return self._machine.decode(b"", True)


_loaded: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The worker's transducer of a file, loaded once."""
    if path not in _loaded:
        _loaded[path] = Transducer(path)
    return _loaded[path]
