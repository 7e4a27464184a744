"""Whitespace tokens of Arrow string columns, in numpy over whole batches.

A token is a longest run of characters other than space, tab and newline; null text has none."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array (n + 1 offsets; null rows are empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = offsets[0] if len(offsets) else 0
    return raw[lo : offsets[-1]], offsets - lo


def blank(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | (raw == 10) | (raw == 9)


def counts(col: pa.Array) -> np.ndarray:
    """Tokens of each row."""
    raw, offsets = utf8(col)
    if len(raw) == 0:
        return np.zeros(len(offsets) - 1, np.int64)
    word = ~blank(raw)
    first = word.copy()
    first[1:] &= ~word[:-1]
    starts = offsets[:-1]
    full = starts < offsets[1:]
    first[starts[full]] = word[starts[full]]
    total = np.concatenate([[0], np.cumsum(first, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def spans(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the text, starts and ends of its tokens."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    word = np.zeros(len(a) + 2, np.int8)
    word[1:-1] = ~blank(a)
    turn = np.diff(word)
    return a, np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
