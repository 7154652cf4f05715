"""Words and their hashes for whole batches of texts at once, on the UTF-8 bytes in Arrow's buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on uint64 whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an array of strings; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about `most` bytes of text each, so that memory doesn't follow the length of a batch."""
    _, at = raw(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words per text) of the runs `[^\\x20\\x09-\\x0D]+`."""
    inside = ~BLANK[data]
    n = len(data)
    first = np.empty(n, bool)
    last = np.empty(n, bool)
    if n:
        first[0], last[-1] = True, True
        first[1:] = ~inside[:-1]
        last[:-1] = ~inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < n)]
        first[edges] = True
        last[edges - 1] = True
    starts = np.flatnonzero(inside & first)
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of byte spans; with lower, A-Z count as a-z.

    A span is cut into blocks of eight bytes. Every block is mixed with its place before the blocks are added, so that
    sums of equal bytes in another order, or of any regular sequence, don't meet as they do in a polynomial modulo 2^64.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = _LOWER[data] if lower else data
    window = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = ends - starts
    blocks = (size + 7) >> 3
    first = np.cumsum(blocks) - blocks
    owner = np.repeat(np.arange(len(starts)), blocks)
    place = np.arange(len(owner)) - first[owner]
    left = size[owner] - 8 * place
    part = window[starts[owner] + 8 * place] & (np.uint64(2**64 - 1) >> (8 * (8 - np.minimum(left, 8))).astype(np.uint64))
    mixed = mix(mix(part + _ODD) + (place.astype(np.uint64) + np.uint64(1)) * _ODD)
    sums = np.zeros(len(starts), np.uint64)
    some = blocks > 0
    if some.any():
        sums[some] = np.add.reduceat(mixed, first[some])
    return mix(sums + mix(size.astype(np.uint64)))
