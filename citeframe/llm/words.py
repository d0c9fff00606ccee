"""Words and word shingles as 64-bit hashes, computed on Arrow batches inside tasks.

A word is a run of bytes other than ASCII white space, with A-Z lower-cased; every
other character stays as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_CACHE_WORDS = 200_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


class _WordHashes(dict):
    """Remembers word hashes; forgets all of them when it has grown to its bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split() if text else []


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def mix(value: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the word (two rounds of multiply and shift)."""
    value = value * _MULTIPLIER
    value ^= value >> _SHIFT
    value *= np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(32)
    return value


def shingle_stream(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all `size`-word shingles in order, repeats included. A shorter text
    is one shingle; the seed holds the length, so it never equals a longer one."""
    width = min(size, len(hashes))
    if width == 0:
        return np.empty(0, np.uint64)
    count = len(hashes) - width + 1
    total = np.full(count, width, np.uint64)
    for k in range(width):
        total ^= hashes[k : k + count]
        total *= _MULTIPLIER
        total ^= total >> _SHIFT
    return mix(total)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return np.unique(shingle_stream(hash_words(split_words(text)), size))


def lists_of(arrays: list[np.ndarray]) -> pa.ListArray:
    """Arrow list column of 64-bit values, one list per array."""
    ends = np.cumsum([0, *map(len, arrays)])
    values = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(np.int64)))


def small_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about `limit` bytes of text, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        groups = np.cumsum(sizes) // limit
        starts = np.flatnonzero(np.diff(groups, prepend=-1))
        for start, end in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(start, end - start)
