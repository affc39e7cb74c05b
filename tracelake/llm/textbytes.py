"""Whole-batch text helpers over Arrow string arrays (numpy views, no per-character Python)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: ASCII A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that separate words: blank and 0x09-0x0D.
IS_BLANK = np.zeros(256, dtype=bool)
IS_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def utf8_views(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    _, offsets, data = texts.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def utf8_list(texts: pa.Array) -> list[bytes]:
    """Each text as UTF-8 bytes; null counts as empty."""
    raw, off = utf8_views(texts)
    whole = raw.tobytes()
    return [whole[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]


def chunks(lengths: np.ndarray, at_most: int):
    """Row ranges whose lengths sum to about ``at_most`` (a longer row stands alone)."""
    start = total = 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and total + n > at_most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def words_of(raw: np.ndarray, off: np.ndarray, separator: np.ndarray = IS_BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each row + total) for the words of all rows of a batch."""
    inside = ~separator[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off[off <= len(raw)]] = True
    before = np.zeros(len(raw) + 1, bool)
    before[1:] = inside
    here = np.zeros(len(raw) + 1, bool)
    here[:-1] = inside
    start = np.flatnonzero(here & (~before | edge))
    end = np.flatnonzero(before & (~here | edge))
    return start, end, np.searchsorted(start, off)


_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64."""
    up = np.full(n + 1, _BASE, np.uint64)
    down = np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift-multiply rounds) over uint64."""
    x = x.copy()
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of raw[start:end] for each span, the same wherever the bytes stand."""
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of ``n`` words inside a row, repeats included; order matters."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = len(words) - n + 1
    h = np.zeros(count, np.uint64)
    for i in range(n):
        h = h * np.uint64(_BASE) + words[i : i + count]
    row = np.searchsorted(first, np.arange(count), side="right") - 1
    fits = np.arange(count) + n <= first[row + 1]
    return mixed(h[fits]), row[fits]
