"""Vectorised words, word hashes and shingle hashes over Arrow string batches.

A batch's UTF-8 buffer is handled as one byte array: separators give the word
boundaries, a rolling polynomial modulo 2**64 gives every word a hash, and
sums of neighbouring word hashes give the shingles. No per-word Python runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

#: Space and the bytes 0x09-0x0D separate words.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += 32

BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
STEP = np.uint64(0xD6E8FEB86659FD93)
BLOCK = 1 << 20

_powers: dict[str, np.ndarray] = {}


def _power(which: str, n: int) -> np.ndarray:
    """BASE**i or BASE**-i for i < n, kept for the next block."""
    have = _powers.get(which)
    if have is None or len(have) < n:
        seq = np.full(max(n, BLOCK + 4096), BASE if which == "up" else BASE_INV, np.uint64)
        seq[0] = 1
        _powers[which] = have = np.multiply.accumulate(seq)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most ``max_bytes`` of text (one row at least)."""
    col = batch.column(column)
    if batch.num_rows == 0:
        return
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False), np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
        yield batch.slice(at, to - at)
        at = to


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    col = pa.compute.fill_null(col, "") if col.null_count else col
    wide = pa.types.is_large_string(col.type)
    kind = np.int64 if wide else np.int32
    offs = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def _cuts(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Blocks of about BLOCK bytes that end at a separator or a row's end."""
    at, n = 0, len(data)
    while at < n:
        to = min(n, at + BLOCK)
        if to < n:
            row = int(offs[np.searchsorted(offs, to, "right") - 1])
            seps = np.flatnonzero(SEPARATORS[data[max(at, to - 4096) : to]])
            best = max(row, max(at, to - 4096) + int(seps[-1]) + 1 if len(seps) else 0)
            if best <= at:
                ahead = to
                while ahead < n:
                    hit = np.flatnonzero(SEPARATORS[data[ahead : ahead + BLOCK]])
                    if len(hit):
                        ahead += int(hit[0]) + 1
                        break
                    ahead += BLOCK
                nxt = int(offs[min(len(offs) - 1, np.searchsorted(offs, to, "left"))])
                best = min(n, ahead, nxt if nxt > at else n)
            to = best
        yield at, to
        at = to


def word_hashes(col: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word and, for each row, where its words start."""
    data, offs = utf8(col)
    table = LOWER if lower else np.arange(256, dtype=np.uint64)
    hashes, starts_all = [], []
    for at, to in _cuts(data, offs):
        part = data[at:to]
        word = ~SEPARATORS[part]
        rows = offs[(offs > at) & (offs < to)] - at
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        begin[rows] = word[rows]
        last = word.copy()
        last[:-1] &= ~word[1:]
        last[rows - 1] = word[rows - 1]
        s, e = np.flatnonzero(begin), np.flatnonzero(last)
        total = np.cumsum((table[part] + np.uint64(1)) * _power("up", to - at))
        h = total[e]
        inner = s > 0
        h[inner] -= total[s[inner] - 1]
        h *= _power("down", to - at)[s]
        hashes.append(mix(h))
        starts_all.append(s + at)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    starts = np.concatenate(starts_all)
    return np.concatenate(hashes), np.searchsorted(starts, offs, "left")


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word runs by row; a shorter row gives its whole sequence as one."""
    n = np.diff(bounds)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    to = np.zeros(len(bounds), np.int64)
    np.cumsum(count, out=to[1:])
    if not len(words):
        return np.zeros(0, np.uint64), to
    acc = np.zeros(len(words), np.uint64)
    factors = np.multiply.accumulate(np.array([1] + [STEP] * max(0, width - 1), np.uint64))
    for j in range(min(width, len(words))):
        acc[: len(words) - j] += words[j:] * factors[j]
    full = np.repeat(bounds[:-1] - to[:-1], count) + np.arange(to[-1])
    out = acc[full]
    for i in np.flatnonzero((n > 0) & (n < width)):
        few = words[bounds[i] : bounds[i + 1]]
        out[to[i]] = (few * factors[: len(few)]).sum(dtype=np.uint64) + np.uint64(len(few))
    return mix(out), to
