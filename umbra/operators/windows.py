"""Very many strings looked for in texts at once: by hashes of all stretches of a text that are as long as one of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Texts are handled in blocks of about so many bytes; a longer text is a block of its own.
BLOCK_BYTES = 1 << 19
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bits of a table for each string in it: one in so many of other strings passes it.
SPARSE = 32

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on each other."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


CODES = mix64(np.arange(1, 257, dtype=np.uint64))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 12), base, np.uint64)
        step[0] = 1
        _powers[base] = have = np.cumprod(step, dtype=np.uint64)
    return have[:n]


def prefix_hashes(buf: np.ndarray) -> np.ndarray:
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(CODES[buf] * powers(BASE, len(buf)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each stretch from start to end: equal strings have equal hashes wherever they stand."""
    return mix64((prefix[end] - prefix[start]) * powers(INVERSE, len(prefix))[start])


def blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about BLOCK_BYTES together; null is empty."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1)
        yield at, buf[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def heads_of(sizes: list[int]) -> dict[int, int]:
    """size -> how many of its first bytes are looked for first: as many as the least size between the same powers of two has."""
    least: dict[int, int] = {}
    for n in sorted(sizes):
        least.setdefault(n.bit_length(), n)
    return {n: least[n.bit_length()] for n in sizes}


def form_hashes(forms: DataFrame, sizes: list[int]) -> pa.Table:
    """(n, head, whole): the bytes of each form (column form, A-Z lower-cased), and the hashes of its head and of itself, brought to the driver."""
    heads = np.zeros(max(sizes) + 1, np.int64)
    for n, head in heads_of(sizes).items():
        heads[n] = head

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, buf, offsets in blocks(batch.column(0)):
                prefix, n = prefix_hashes(buf), np.diff(offsets)
                head, whole = span_hashes(prefix, offsets[:-1], offsets[:-1] + heads[n]), span_hashes(prefix, offsets[:-1], offsets[1:])
                yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int32)), pa.array(head.view(np.int64)), pa.array(whole.view(np.int64))], names=["n", "head", "whole"])

    return forms.select("form").mapInArrow(hashed, "n int, head long, whole long").toArrow()


class Bits:
    """Which hashes may be among some: all that are, and one in SPARSE of the others."""

    def __init__(self, hashes: np.ndarray):
        width = max(10, (len(hashes) * SPARSE - 1).bit_length())
        self.shift = np.uint64(64 - width)
        place = hashes >> self.shift
        self.bits = np.zeros(1 << width - 3, np.uint8)
        np.bitwise_or.at(self.bits, place >> np.uint64(3), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))

    def among(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> self.shift
        return (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


class Windows:
    """Strings by the hashes of their heads and of themselves, as form_hashes() gives them."""

    def __init__(self, sizes: list[int], hashes: pa.Table):
        n, head, whole = (hashes.column(c).to_numpy() for c in ("n", "head", "whole"))
        head, whole = head.view(np.uint64), whole.view(np.uint64)
        self.whole = {size: np.sort(whole[n == size]) for size in sizes}
        self.bits = Bits(whole)
        first = heads_of(sizes)
        self.classes = [(width, [s for s in sizes if first[s] == width], Bits(np.unique(head[np.isin(n, [s for s in sizes if first[s] == width])]))) for width in sorted(set(first.values()))]

    def found(self, column: pa.Array, by_digits: bool) -> Iterator[tuple[int, str]]:
        """(row, string), once each, where the row's text, A-Z lower-cased, or its digits alone hold the string."""
        for first, buf, offsets in blocks(column):
            if by_digits:
                digit = (buf >= 48) & (buf <= 57)
                offsets = np.concatenate([[0], np.cumsum(digit)])[offsets]
                buf = buf[digit]
            else:
                buf = LOWER[buf]
            prefix, data = prefix_hashes(buf), buf.tobytes()
            for width, sizes, heads in self.classes:
                if len(buf) < width:
                    continue
                last = len(buf) - width + 1
                at = np.flatnonzero(heads.among(mix64((prefix[width:] - prefix[:last]) * powers(INVERSE, len(prefix))[:last])))
                row = np.searchsorted(offsets, at, "right") - 1
                left = offsets[row + 1] - at
                for size in sizes:
                    start, own = at[left >= size], row[left >= size]
                    whole = span_hashes(prefix, start, start + size)
                    some = np.flatnonzero(self.bits.among(whole))
                    known = self.whole[size]
                    some = some[known[np.minimum(np.searchsorted(known, whole[some]), len(known) - 1)] == whole[some]]
                    _, once = np.unique(np.stack([own[some].astype(np.uint64), whole[some]]), axis=1, return_index=True)
                    for i in some[once]:
                        yield first + int(own[i]), data[start[i] : start[i] + size].decode(errors="replace")
