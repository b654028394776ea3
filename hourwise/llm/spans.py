"""Spans of text columns as numpy arrays: words and lines with their byte positions, and 64-bit hashes of spans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from hourwise.llm.common import NOT_SPACE, STEP, U, mix, powers, text_buffer

#: A 64-bit number for every byte.
_BYTE = mix(np.arange(256, dtype=np.uint64) + U(0x6A09E667F3BCC909))


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ascending, disjoint spans [start, end) of ``buf``, worked in steps of about ``STEP`` bytes."""
    out = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + STEP, "right")))
        s, e = start[at:to] - start[at], end[at:to] - start[at]
        p, inverse = powers(int(e[-1]) + 1)
        total = np.zeros(int(e[-1]) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[buf[start[at] : end[to - 1]]] * p[: int(e[-1])], out=total[1:])
        out[at:to] = mix((total[e] - total[s]) * inverse[s]) ^ mix((e - s).astype(np.uint64))
        at = to
    return out


class Texts:
    """Bytes and row offsets of a string column; nulls are empty."""

    def __init__(self, col: pa.Array):
        self.buf, self.off = text_buffer(col)
        self.rows = len(self.off) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every run of bytes other than white space, and the first word of each row (rows + 1)."""
        is_word = NOT_SPACE[self.buf]
        n = len(is_word)
        start, end = is_word.copy(), is_word.copy()
        if n:
            start[1:] &= ~is_word[:-1]
            end[:-1] &= ~is_word[1:]
            edges = self.off[(self.off > 0) & (self.off < n)]
            start[edges] = is_word[edges]
            end[edges - 1] = is_word[edges - 1]
        s = np.flatnonzero(start)
        return s, np.flatnonzero(end) + 1, np.searchsorted(s, self.off)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, start and end of every line, white space stripped at both ends; an empty row has one empty line."""
        feed = np.flatnonzero(self.buf == 10)
        row = np.concatenate([np.arange(self.rows), np.searchsorted(self.off, feed, "right") - 1])
        start = np.concatenate([self.off[:-1], feed + 1])
        order = np.lexsort((start, row))
        row, start = row[order], start[order]
        end = self.off[row + 1].copy()
        inner = np.flatnonzero(row[1:] == row[:-1])
        end[inner] = start[inner + 1] - 1
        solid = np.flatnonzero(NOT_SPACE[self.buf])
        if not len(solid):
            return row, start, start.copy()
        first = np.searchsorted(solid, start)
        last = np.searchsorted(solid, end)
        some = last > first
        s = np.where(some, solid[np.minimum(first, len(solid) - 1)], start)
        return row, s, np.where(some, solid[np.maximum(last, 1) - 1] + 1, start)

    def code_points(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Code points of spans of whole characters."""
        seen = np.concatenate([[0], np.cumsum((self.buf & 0xC0) != 0x80)])
        return seen[end] - seen[start]
