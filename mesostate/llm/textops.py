"""Whole-batch text kernels shared by the corpus operators.

They work on the buffers of an Arrow string column, all texts of a batch at
once, and never cut a text.  A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: White space of the word pattern ``[^\x20\x09-\x0D]+``.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Texts are worked on in runs of about so many bytes; a longer text is a run of its own.
RUN_BYTES = 1 << 21

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x5851F42D4C957F2D)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a string column, and where each text starts and ends in them."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(batch: pa.RecordBatch, column: str = "text", most: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch, each with about ``most`` bytes of text or one longer text."""
    _, offsets = buffers(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the index of each text's first word (one more at the end)."""
    word = ~_IS_SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = word[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = word[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(word & ~before)
    return starts, np.flatnonzero(word & ~after) + 1, np.searchsorted(starts, offsets)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, equal for equal bytes wherever they stand; ranges ascend and do not overlap.

    Each byte gives a number that depends on it and on its place in the range, without any pattern from one place to
    the next; a hash is their sum.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    base = int(starts[0])
    place = np.arange(base, len(data), dtype=np.int64)
    place -= np.repeat(starts, np.diff(np.append(starts, len(data))))
    sums = np.zeros(len(data) - base + 1, np.uint64)
    np.cumsum(mix(((place.view(np.uint64) << np.uint64(8)) | data[base:]) * _GOLDEN + _BASE), out=sums[1:])
    return mix(sums[ends - base] - sums[starts - base] + (ends - starts).astype(np.uint64) * _GOLDEN)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` neighbouring word hashes, over text borders too; one for each word.

    The last ``size - 1`` values of a text do not stand for a shingle; the caller leaves them out.
    """
    out = np.zeros(len(words), np.uint64)
    for k in range(size):
        part = words[k:] if k else words
        out[: len(part)] = (out[: len(part)] * _BASE) + part
    return mix(out)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``start, start + 1, ...`` of each range, one range after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)
