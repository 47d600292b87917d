"""Words of Arrow text columns as NumPy arrays: spans, 64-bit hashes, hashes of runs of words.

A word is a maximal run of bytes other than ASCII white space.  All work is on
the bytes of many texts at once; no Python loop runs over words or texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from citegraph.llm.shared import by_value

by_value(__name__)

#: Bytes of text whose words are hashed at once; a longer text is a piece of its own.
CHUNK = 512 << 10
_BASE = 0x9E3779B97F4A7C15 | 1
_RUN = 0xD6E8FEB86659FD93 | 1
_TABLES: dict = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i in 0..n."""
    have = _TABLES.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, CHUNK + (1 << 16))
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _TABLES[base] = (out[0], out[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; a null has no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    if len(col) == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), at


def chunks(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of pieces of about CHUNK bytes, each of whole texts."""
    data, at = text_bytes(col)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK, "right")) - 1)
        hi = min(hi, n, lo + 60_000)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


_SOLID = np.ones(256, bool)
_SOLID[[32, 9, 10, 11, 12, 13]] = False


def spans(data: np.ndarray, at: np.ndarray, solid: np.ndarray = _SOLID) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the index of its first word (with the total at the end)."""
    inside = solid[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """A 64-bit hash of the bytes of each word, the same wherever the word stands."""
    power, inverse = _powers(base, len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def run_hashes(words: np.ndarray, k: int, base: int = _RUN) -> np.ndarray:
    """A hash of every k consecutive words; runs across texts are among them and are for the caller to leave out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, inverse = _powers(base, len(words) + 1)
    sums = np.empty(len(words) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(words * power[: len(words)], out=sums[1:])
    return mix((sums[k:] - sums[:n]) * inverse[:n])


def runs_within(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the runs of k words that lie in one text, and the text of each."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    total = np.cumsum(counts)
    return np.arange(len(text)) + (first[:-1] - (total - counts))[text], text
