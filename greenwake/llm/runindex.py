"""A run-length index over short texts: run-compressed Burrows-Wheeler transform with sampled run ends."""

from __future__ import annotations

import numpy as np

#: A byte that UTF-8 never holds ends each text.
END = 0xFF


def _ranked(key: np.ndarray) -> np.ndarray:
    """Dense ranks of 64-bit keys, from 1."""
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), dtype=np.uint64)
    new[1:] = key[order][1:] != key[order][:-1]
    rank = np.empty(len(key), dtype=np.uint64)
    rank[order] = np.cumsum(new)
    return rank


class RunLengthIndex:
    """Index of the distinct texts of one shard, each with the smallest id that holds it.

    Suffixes are sorted within their text, equal ones by text number, so stepping from a row to that of the character
    before it is exact. Kept are the runs of the transform (first row, character, row their first character maps to),
    the text positions at run ends, and for the intervals of suffixes that agree on `span` characters their first rows
    and the smallest id in each. The suffix array itself is dropped.
    """

    def __init__(self, texts: list[bytes], owner: np.ndarray, span: int):
        self.span = span
        size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        flat = np.frombuffer(bytes([END]).join(texts) + bytes([END]), dtype=np.uint8)
        n = self.n = len(flat)
        stop = np.repeat(np.cumsum(size + 1) - 1, size + 1)  # place of the END of each position's text
        left = stop - np.arange(n)
        padded = np.concatenate([flat, np.zeros(8, np.uint8)])
        key = np.zeros(n, dtype=np.uint64)
        known = min(8, span)
        for j in range(known):
            key |= np.where(left >= j, padded[j : n + j], 0).astype(np.uint64) << np.uint64(8 * (7 - j))
        rank = _ranked(key)
        longest = int(size.max(initial=0)) + 1
        spans = rank if known == span else None
        while known < longest:
            step = min(known, longest - known)
            if known < span <= known + step:  # stop at span once, for the intervals that agree on it
                step = span - known
            beyond = np.zeros(n, dtype=np.uint64)
            inside = np.flatnonzero(left >= step)
            beyond[inside] = rank[inside + step]
            rank, known = _ranked(rank << np.uint64(32) | beyond), known + step
            if known == span:
                spans = rank
        if spans is None:
            spans = rank
        sa = np.argsort(rank, kind="stable")
        bwt = flat[sa - 1]
        head = np.ones(n, dtype=bool)
        head[1:] = bwt[1:] != bwt[:-1]
        self.first = np.flatnonzero(head)
        self.character = bwt[self.first]
        by_character = np.argsort(self.character, kind="stable")
        length = np.diff(np.append(self.first, n))
        self.goes_to = np.empty(len(self.first), dtype=np.int64)
        self.goes_to[by_character] = np.cumsum(length[by_character]) - length[by_character]
        last = self.first + length - 1
        self.sampled = sa[last]
        at_span = spans[sa]
        new = np.ones(n, dtype=bool)
        new[1:] = at_span[1:] != at_span[:-1]
        self.interval = np.flatnonzero(new)
        number = np.searchsorted(np.cumsum(size + 1), sa, "right")
        self.least = np.minimum.reduceat(owner[number], self.interval)
        self.size, self.owner = size, owner
        # END sorts after every other byte, so the rows of the texts' ends are the last ones, in text order
        self.end_row = n - len(texts) + np.arange(len(texts))

    def back(self, row: np.ndarray) -> np.ndarray:
        """Rows of the suffixes one character longer."""
        run = np.searchsorted(self.first, row, "right") - 1
        return self.goes_to[run] + row - self.first[run]

    def position(self, row: int) -> int:
        """Text position of a row, from the next sampled run end on the way back."""
        steps = 0
        while True:
            run = int(np.searchsorted(self.first, row, "right")) - 1
            end = (self.first[run + 1] if run + 1 < len(self.first) else self.n) - 1
            if row == end:
                return int(self.sampled[run]) + steps
            row, steps = int(self.goes_to[run] + row - self.first[run]), steps + 1

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, start) of every match of `span` characters with a text of a smaller id.

        All texts stream backwards through the index together. At a place with `span` characters before its text's
        end the match reaches at least that far; the interval of its row tells the smallest id it reaches.
        """
        texts, starts = [], []
        row, text = self.end_row.copy(), np.arange(len(self.size))
        place = self.size.copy()
        while len(text):
            on = place > 0
            row, text, place = row[on], text[on], place[on] - 1
            row = self.back(row)
            whole = np.flatnonzero(self.size[text] - place >= self.span)
            interval = np.searchsorted(self.interval, row[whole], "right") - 1
            hit = whole[self.least[interval] < self.owner[text[whole]]]
            texts.append(text[hit])
            starts.append(place[hit])
        return np.concatenate([np.zeros(0, np.int64), *texts]), np.concatenate([np.zeros(0, np.int64), *starts])
