"""Vectorised work on whole texts inside Arrow tasks: pieces of a batch, word and line spans, fingerprints of spans.

Texts are handled as the UTF-8 bytes of a batch. All separators are ASCII, so no multi-byte character is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The white space between words: U+0020 and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[ord("A") : ord("Z") + 1] += 32

PIECE_BYTES = 4 << 20


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of `column`; a longer text is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(np.maximum(1, np.nan_to_num(_lengths(batch.column(column)))))
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, base + limit, "right")))
            yield batch.slice(start, end - start)
            start = end


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.binary_length(column).to_numpy(zero_copy_only=False).astype(float)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts after each other, and where each starts (one entry more than texts); null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(buf: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each non-empty run of other bytes, and the runs before each text (one entry more than texts)."""
    inside = ~separator[buf]
    first, last = inside.copy(), inside.copy()
    if len(buf):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edge = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[edge] = inside[edge]
        edge = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        last[edge] = inside[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (one to one)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = np.random.default_rng(7).integers(0, 2**64, 256, np.uint64) | np.uint64(1)
_PLACE = np.random.default_rng(8).integers(0, 2**64, 1 << 12, np.uint64) | np.uint64(1)


def _places(n: int) -> np.ndarray:
    global _PLACE
    if n > len(_PLACE):
        while len(_PLACE) < n:
            k = len(_PLACE)
            _PLACE = np.concatenate([_PLACE, mix64(_PLACE + np.uint64(k)) | np.uint64(1)])
    return _PLACE[:n]


def fingerprints(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = SAME) -> np.ndarray:
    """64-bit fingerprint of each span's bytes after `fold`; equal spans have equal ones in every task."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    at = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(at, lengths)
    values = _BYTE[fold][buf[place + np.repeat(starts, lengths)]]
    values *= _places(int(lengths.max()))[place]
    return mix64(np.add.reduceat(values, at) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of sorted batches, one table for each run of equal keys."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [*np.flatnonzero(change), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if key != current and held:
                yield pa.Table.from_batches(held)
                held = []
            current = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
