"""Words of many texts at once, as numpy arrays over the texts' UTF-8 bytes.

A word is a maximal run of bytes that a 256-entry table admits.  Words are
known by 64-bit hashes of their bytes: each 8 bytes are mixed in, then the
length, by bijective steps, so that words of up to 8 bytes and equal length
never collide.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)

#: Bytes of text handled at once; a longer text makes a piece of its own.
PIECE_BYTES = 2 << 20


def tidied(run: Callable[..., Iterator], keeps: str = "") -> Callable[..., Iterator]:
    """run, before which the worker forgets what tasks of other kinds had it remember, and after which it gives freed memory back, as it lives on between tasks."""

    def each(*args):
        forget(keeps)
        yield from run(*args)
        give_back()

    return each


#: What a worker remembers between tasks, by name, and how it is forgotten.
_remembered: dict[str, Callable[[], None]] = {}


def remember(name: str, forgotten: Callable[[], None]) -> None:
    _remembered[name] = forgotten


def forget(keeps: str = "") -> None:
    for name in [n for n in _remembered if n != keeps]:
        _remembered.pop(name)()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)


def mix(z: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, a bijection of 64-bit values."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


@dataclass
class Words:
    """hash, row, start and end of each word; first: the word index at which each row begins, and the count of words."""

    buf: np.ndarray
    offsets: np.ndarray
    hash: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def of(self, i: int) -> slice:
        return slice(self.first[i], self.first[i + 1])


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (nulls: none) and where each row's begin, with the end."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_binary())
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1] if off and len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def eight(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each start, as numbers."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))[start] & _MASK[np.minimum(size, 8)]


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - start
    out = np.zeros(len(start), np.uint64)
    if not len(start):
        return out
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))
    out = mix(eight[start] & _MASK[np.minimum(size, 8)])
    k, more = 8, np.flatnonzero(size > 8)
    while len(more):
        part = eight[start[more] + k] & _MASK[np.minimum(size[more] - k, 8)]
        out[more] = mix(out[more] * _STEP + part)
        k += 8
        more = more[size[more] > k]
    return mix(out + size.astype(np.uint64) * _STEP)


def words(texts: pa.Array, table: np.ndarray = NOT_SPACE, lower: bool = False) -> Words:
    """Words of each text by the byte table; lower: with A-Z as a-z."""
    buf, offsets = bytes_of(texts)
    if lower:
        buf = _LOWER[buf]
    inside = table[buf]
    begins = np.zeros(len(buf) + 1, bool)
    begins[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(buf) else inside
    start = np.flatnonzero(inside & (~before | begins[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(buf) else inside
    end = np.flatnonzero(inside & (~after | begins[1:])) + 1
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(buf, offsets, word_hashes(buf, start, end), row, start, end, first)


def hash_of(word: str) -> np.uint64:
    """The hash that words() gives this word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return word_hashes(data, np.array([0]), np.array([len(data)]))[0]


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts take up to limit bytes, one row at least."""
    offsets = bytes_of(batch.column(batch.schema.get_field_index(column)))[1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and how often each occurs."""
    if not len(codes):
        return codes, np.zeros(0, np.int64)
    codes = np.sort(codes)
    at = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[at], np.diff(np.append(at, len(codes)))
