"""Words and hashes of many texts at once, as numpy arrays over their UTF-8 bytes.

Everything here works on a slice of an Arrow batch, so that the memory of a
task is bounded by `SLICE_BYTES` (or by one text, if that is longer).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_SPACE = np.ones(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words `[^\x20\x09-\x0D]+`.
SPACED = _SPACE
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, of lower-case text.
ALPHANUMERIC = _ALNUM
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_WORD_BASE = 0xD6E8FEB86659FD93


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches again, in slices of at most `limit` bytes of
    the text column (a longer text makes a slice of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin, before = 0, 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin, before = end, int(ends[end - 1])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts after one another (null: empty), and the n + 1
    offsets of the texts in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.fill_null("").cast(pa.large_binary())
    else:
        column = column.fill_null(b"").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words of each text.
    Words never cross texts."""
    texts = len(offsets) - 1
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(texts, np.int64)
    inside = is_word[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = np.flatnonzero(np.diff(offsets))
    first[offsets[full]] = inside[offsets[full]]
    last[offsets[full + 1] - 1] = inside[offsets[full + 1] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words at these places."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    powers = np.full(len(data), _BASE, np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers, out=sums[1:])
    # One over the power at the start, so that a word hashes alike anywhere.
    back = np.full(len(data), _BASE_INVERSE, np.uint64)
    back[0] = 1
    np.cumprod(back, out=back)
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * np.uint64(_WORD_BASE))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of each `size` consecutive words; those that cross texts
    are for the caller to leave out."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total = total * np.uint64(_WORD_BASE) + words[k : k + n]
    return mix(total)


def as_arrow(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch with these columns, in the schema's order and types."""
    return pa.RecordBatch.from_arrays(
        [columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema], schema=schema
    )
