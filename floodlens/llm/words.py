"""Words of whole texts as flat numpy arrays: one pass over an Arrow batch, no loop over words.

A word is a run of bytes other than the six ASCII white-space characters (`[^\\x20\\x09-\\x0D]+`).
Words and windows of words are compared by 64-bit hashes. A hash is a polynomial over random
values of the bytes (or words), taken from a prefix sum, so that every window costs one
subtraction; a final mix spreads it over all bits. Work runs in pieces that fit a processor cache
cut between words, whatever the length of a text or of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = (9, 10, 11, 12, 13, 32)
PIECE = 1 << 17
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

_is_space = np.zeros(256, dtype=bool)
_is_space[list(SPACES)] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits; one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_byte_value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_lower_value = _byte_value.copy()
_lower_value[65:91] = _byte_value[97:123]


class _Powers:
    """Powers of an odd multiplier and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base = [base, pow(base, -1, 1 << 64)]
        self.tables = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.tables[0]) < n:
            for i in (0, 1):
                table = self.tables[i]
                step = np.uint64(pow(self.base[i], len(table), 1 << 64))
                self.tables[i] = np.concatenate([table, table * step])
        return self.tables[0][:n], self.tables[1][:n]


_powers = [_Powers(base) for base in _MULTIPLIERS]


def _span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                 which: int = 0) -> np.ndarray:
    """Hash of values[start:end] for every span."""
    up, down = _powers[which].get(len(values) + 1)
    sums = np.empty(len(values) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(values * up[:len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                which: int = 0) -> np.ndarray:
    """Hash of values[start:end] for spans in order of their starts, in bounded pieces."""
    if len(values) <= PIECE:
        return _span_hashes(values, starts, ends, which)
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(starts, base + PIECE)))
        top = int(ends[at:to].max())
        out[at:to] = _span_hashes(values[base:top], starts[at:to] - base, ends[at:to] - base,
                                  which)
        at = to
    return out


def window_hashes(values: np.ndarray, starts: np.ndarray, size: int, which: int = 0
                  ) -> np.ndarray:
    """Hash of `size` values from every start."""
    return span_hashes(values, starts, starts + size, which)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each row begins; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of some rows: byte spans, hashes, and the first word of each row (one more at the end)."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """The words of rows data[offsets[i]:offsets[i + 1]], A-Z lower-cased in the hashes if asked."""
    starts, ends, hashes = [], [], []
    at, size = 0, len(data)
    values = _lower_value if lower else _byte_value
    while at < size:
        to = min(at + PIECE, size)
        while to < size:  # to the next white space; a text without any is one word anyway
            ahead = np.flatnonzero(_is_space[data[to - 1:to + PIECE]])
            if len(ahead):
                to += int(ahead[0])
                break
            to = min(to + PIECE, size)
        piece = data[at:to]
        solid = ~_is_space[piece]
        edge = np.zeros(len(piece) + 1, dtype=bool)  # a row begins here
        edge[offsets[np.searchsorted(offsets, at):np.searchsorted(offsets, to, "right")] - at] = True
        begin = solid.copy()
        begin[1:] &= ~solid[:-1] | edge[1:-1]
        finish = solid.copy()
        finish[:-1] &= ~solid[1:] | edge[1:-1]
        first, last = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        hashes.append(_span_hashes(values[piece], first, last))
        starts.append(first + at)
        ends.append(last + at)
        at = to
    if not starts:
        empty = np.empty(0, dtype=np.int64)
        return Words(empty, empty, np.empty(0, np.uint64), np.zeros(len(offsets), np.int64))
    joined = np.concatenate(starts)
    return Words(joined, np.concatenate(ends), np.concatenate(hashes),
                 np.searchsorted(joined, offsets))


def row_pieces(batch: pa.RecordBatch, text: str, limit: int = 4 << 20
               ) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Consecutive rows of a batch with at most `limit` bytes of text, or one row, at a time."""
    data, offsets = text_bytes(batch.column(text))
    row = 0
    while row < batch.num_rows:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        part = offsets[row:to + 1]
        yield batch.slice(row, to - row), data[part[0]:part[-1]], part - part[0]
        row = to


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
