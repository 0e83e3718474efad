"""Numpy kernels over the byte buffers of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows are handled in blocks of about so many bytes; a longer text is a block of its own.
BLOCK_BYTES = 1 << 19

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ASCII letters and digits and all bytes of other characters.
ALNUM = np.array([chr(c).isalnum() and c < 128 or c >= 128 for c in range(256)])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on each other."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 12), base, np.uint64)
        step[0] = 1
        _powers[base] = have = np.cumprod(step, dtype=np.uint64)
    return have[:n]


#: A second base and second codes, for hashes that don't depend on the first ones.
OTHER_BASE = 0xD1342543DE82EF95
OTHER_CODES = mix64(np.arange(1001, 1257, dtype=np.uint64))


def prefix_hashes(buf: np.ndarray, base: int = BASE, codes: np.ndarray = BYTE_CODES) -> np.ndarray:
    """Polynomial hashes of all prefixes of buf; span_hashes() reads any substring's from them."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(codes[buf] * powers(base, len(buf)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, inverse: int = INVERSE) -> np.ndarray:
    """The hash of each buf[start:end]: equal strings have equal hashes wherever they stand."""
    return (prefix[end] - prefix[start]) * powers(inverse, len(prefix))[start]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where its rows begin; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `most` bytes together."""
    buf, offsets = utf8(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end, buf[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each run of the bytes that `inside` marks; runs end with their row."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    is_in = inside[buf]
    first = is_in.copy()
    first[1:] &= ~is_in[:-1]
    last = is_in.copy()
    last[:-1] &= ~is_in[1:]
    heads, tails = offsets[:-1][offsets[:-1] < offsets[1:]], offsets[1:][offsets[:-1] < offsets[1:]] - 1
    first[heads] = is_in[heads]
    last[tails] = is_in[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (A-Z lower-cased) of all rows, and their rows."""
    start, end, row = words(buf, offsets, ~SPACES if inside is None else inside)
    prefix = prefix_hashes(LOWER[buf])
    return mix64(span_hashes(prefix, start, end) + (end - start).astype(np.uint64)), row


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """For each row, the sorted distinct 64-bit hashes of its shingles of `size` words.

    A text of fewer words is one shingle; one without a word has none.
    """
    odd = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
    for _, _, buf, offsets in blocks(column):
        hashes, row = word_hashes(buf, offsets)
        n = len(offsets) - 1
        bounds = np.searchsorted(row, np.arange(n + 1))
        whole = max(0, len(hashes) - size + 1)
        mixed = np.zeros(whole, np.uint64)
        for j in range(size):
            mixed += hashes[j : j + whole] * odd[j % 5]
        mixed = mix64(mixed)
        for i in range(n):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= size:
                yield np.unique(mixed[a : b - size + 1])
            elif b > a:
                part = (hashes[a:b] * np.array(odd[: b - a])).sum(dtype=np.uint64, keepdims=True)
                yield mix64(part ^ np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)
