"""Vectorised work on UTF-8 text: whole Arrow string columns are tokenised and hashed in numpy.

Every hash here is a polynomial modulo 2**64 over the bytes, finished by an integer mixer. It
depends on the bytes alone, so it is the same in every process and for every batch layout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}
STRETCH = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words between ASCII white space.
SPACED = np.ones(256, dtype=bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: Words of ASCII digits, letters and every non-ASCII character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
ALNUM[128:] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses, at least n + 1 of each."""
    if len(_powers.get("up", ())) <= n:
        size = max(1 << 16, n + (n >> 3) + 2)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _powers[name] = np.cumprod(a, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    return h


def raw_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offset of each row; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.binary() if pa.types.is_large_binary(column.type) else pa.string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def slices(column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of runs of rows of about `most` bytes; a row stays whole."""
    buf, offs = raw_texts(column)
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        hi = min(hi, n, lo + 1024)
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row and the total); words never cross rows."""
    inside = is_word[buf]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = offs[(offs > 0) & (offs < len(buf))]
    begin[edges] |= inside[edges]
    close = inside.copy()
    close[:-1] &= ~inside[1:]
    close[edges - 1] |= inside[edges - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(close) + 1, np.searchsorted(starts, offs)


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    up, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A mixed hash of each span of bytes."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words in lower case (A-Z only). Taken in stretches of about STRETCH bytes, whatever a row's length."""
    if len(buf) <= 2 * STRETCH:
        return span_hashes(prefix_sums(LOWER[buf]), starts, ends)
    out = np.zeros(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(starts, base + STRETCH)))
        part = LOWER[buf[base : int(ends[hi - 1])]]
        out[lo:hi] = span_hashes(prefix_sums(part), starts[lo:hi] - base, ends[lo:hi] - base)
        lo = hi
    return out


def word_stretches(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of stretches, their rows): rows of more than 2 * STRETCH bytes are cut where no word is cut."""
    if not (np.diff(offs) > 2 * STRETCH).any():
        return offs, np.arange(len(offs) - 1)
    cuts, rows = [], []
    for row in range(len(offs) - 1):
        at, end = int(offs[row]), int(offs[row + 1])
        cuts.append(at)
        rows.append(row)
        while end - at > 2 * STRETCH:
            own = buf[at + STRETCH : end]
            gap = next((at + STRETCH + lo + int(np.argmin(w)) for lo in range(0, len(own), STRETCH) if not (w := is_word[own[lo : lo + STRETCH]]).all()), None)
            if gap is None:
                break
            at = gap
            cuts.append(at)
            rows.append(row)
    return np.array([*cuts, int(offs[-1])], np.int64), np.array(rows, np.int64)


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` consecutive words, wherever the rows end."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out *= np.uint64(0x8CB92BA72F3D8DD7)
        out += h[j : j + n]
    return mix(out + np.uint64(size))


def window_starts(first: np.ndarray, size: int) -> np.ndarray:
    """Indices of words at which a run of `size` words fits into the word's own row."""
    counts = np.diff(first)
    ok = counts >= size
    if not ok.any():
        return np.zeros(0, np.int64)
    lens = (counts - size + 1)[ok]
    base = np.repeat(first[:-1][ok] - np.concatenate(([0], np.cumsum(lens)[:-1])), lens)
    return base + np.arange(int(lens.sum()))
