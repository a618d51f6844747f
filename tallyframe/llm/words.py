"""Words of Arrow text columns as numpy arrays: whole batches at once, no Python loop over words."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 4 << 20  # texts worked on together; a longer text stands alone

FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32

BLANK_SEPARATED = np.ones(256, dtype=bool)  # [^\x20\x09-\x0D]+
BLANK_SEPARATED[[0x20, *range(0x09, 0x0E)]] = False

LETTERS_DIGITS = np.zeros(256, dtype=bool)  # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, on folded text
LETTERS_DIGITS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_GOLD = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spread(n: int, salt: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers, made by rule."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_GOLD) + np.uint64(salt))


_BYTE = spread(256, 17)
_PLACE = spread(1 << 12, 29) | np.uint64(1)


def places(n: int) -> np.ndarray:
    global _PLACE
    if n > len(_PLACE):
        _PLACE = spread(2 * n, 29) | np.uint64(1)
    return _PLACE


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; a NULL is the empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of about `limit` bytes of text at most, unless one text is longer."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(text))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + limit - size, side="right")) - 1
            if end <= at and held:
                yield _joined(held)
                held, size = [], 0
                continue
            end = min(max(end, at + 1), batch.num_rows)
            held.append(batch.slice(at, end - at))
            size += int(offsets[end] - offsets[at])
            at = end
            if size >= limit:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def trim() -> None:
    """Gives memory that arrays have left behind back to the system: a worker lives on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class Words:
    """The words of some texts: `hash` of each word, `doc` it is in, and `first`, the index of each text's first word
    (one more entry at the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, fold: bool):
        if fold:
            data = FOLD[data]
        inside = kind[data]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        bounds = offsets[1:-1]
        bounds = bounds[bounds < len(data)]
        opens[bounds] = inside[bounds]
        at = np.flatnonzero(inside)
        starts = np.flatnonzero(opens)
        heads = np.searchsorted(at, starts)
        n = len(starts)
        lengths = np.diff(np.append(heads, len(at)))
        within = np.arange(len(at)) - np.repeat(heads, lengths)
        longest = int(lengths.max()) if n else 0
        values = _BYTE[data[at]] * places(longest)[within]
        self.hash = mixed(np.add.reduceat(values, heads) + lengths.astype(np.uint64)) if n else np.empty(0, np.uint64)
        self.first = np.searchsorted(starts, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.start, self.length = starts, lengths


def words(column: pa.Array, kind: np.ndarray, fold: bool = True) -> Words:
    data, offsets = text_bytes(column)
    return Words(data, offsets, kind, fold)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, doc) of the runs of `size` words of each text; a text of fewer words, but not none, is one run."""
    n = len(w.hash)
    lengths = np.diff(w.first)
    short = np.flatnonzero((lengths > 0) & (lengths < size))
    if n >= size:
        inside = w.doc[: n - size + 1] == w.doc[size - 1 :]
        at = np.flatnonzero(inside)
        value = np.zeros(len(at), np.uint64)
        for k in range(size):
            value = mixed(value * np.uint64(_GOLD) + w.hash[at + k])
        docs = w.doc[at]
    else:
        value, docs = np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(short):
        rest = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            some = lengths[short] > k
            rest[some] = mixed(rest[some] * np.uint64(_GOLD) + w.hash[w.first[short[some]] + k])
        rest = mixed(rest + lengths[short].astype(np.uint64))
        value, docs = np.concatenate([value, rest]), np.concatenate([docs, short])
    return value, docs
