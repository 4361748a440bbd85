"""Elias-Fano coding of rising sequences, and files of named arrays that are mapped rather than read."""

from __future__ import annotations

import json
import struct
import tempfile
from collections import defaultdict
from collections.abc import Iterator
from typing import IO

import numpy as np

from tidewatch.llm.inputs import filesystem

U = np.uint64


def _write(folder: str, name: str, parts: dict[str, tuple[str, int, Iterator[bytes]]], notes: dict) -> None:
    """One file: a header, then the arrays, each (type, length, its bytes). Written under another name first, so a file that is there is
    whole; a second writer of the same content puts an equal file in its place."""
    import uuid

    fs, base = filesystem(folder)
    fs.create_dir(base, recursive=True)
    at, places = 0, {}
    for key, (kind, n, _) in parts.items():
        places[key] = [kind, n, at]
        at += -(-n * np.dtype(kind).itemsize // 8) * 8
    header = json.dumps({"parts": places, "notes": notes}).encode()
    header += b" " * (-(len(header) + 8) % 8)
    path = f"{base}/{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(path) as out:
        out.write(struct.pack("<q", len(header)) + header)
        for kind, n, chunks in parts.values():
            for chunk in chunks:
                out.write(chunk)
            out.write(b"\0" * (-n * np.dtype(kind).itemsize % 8))
    fs.move(path, f"{base}/{name}")


def write_arrays(folder: str, name: str, arrays: dict[str, np.ndarray], notes: dict) -> None:
    """A file of arrays that are at hand."""
    _write(folder, name, {key: (x.dtype.str, len(x), iter([np.ascontiguousarray(x).data])) for key, x in arrays.items()}, notes)


class Growing:
    """A file whose arrays and rising sequences grow piece by piece. What has come lies in the task's temporary files, so no more than a
    piece is held; they go when the file is written."""

    CHUNK = 8 << 20

    def __init__(self) -> None:
        self.files: dict[str, tuple[IO[bytes], str]] = {}
        self.lengths: dict[str, int] = defaultdict(int)
        self.sequences: dict[str, dict[str, list[int]]] = {}

    def array(self, name: str, x: np.ndarray) -> None:
        if name not in self.files:
            self.files[name] = tempfile.TemporaryFile(), x.dtype.str
        file, kind = self.files[name]
        file.write(np.ascontiguousarray(x, kind).data)
        self.lengths[name] += len(x)

    def sequence(self, name: str, values: np.ndarray) -> None:
        """The next piece of a sequence; it rises inside a piece."""
        parts, own = EliasFano.encode(values)
        past = self.sequences.setdefault(name, {k: [] for k in own})
        n, words = sum(past["n"]), sum(past["words"])
        for key, first in (("high", None), ("before", n), ("zeros", 64 * words - n), ("low", None)):
            self.array(f"{name}.{key}", parts[key] if first is None else parts[key] + first)
        for k, v in own.items():
            past[k].append(v)

    def write(self, folder: str, name: str, notes: dict) -> None:
        def chunks(file: IO[bytes]) -> Iterator[bytes]:
            file.seek(0)
            while chunk := file.read(self.CHUNK):
                yield chunk

        _write(folder, name, {k: (kind, self.lengths[k], chunks(file)) for k, (file, kind) in self.files.items()}, notes | self.sequences)
        for file, _ in self.files.values():
            file.close()


def map_arrays(folder: str, name: str) -> tuple[dict[str, np.ndarray], dict]:
    """The arrays of a file as views of the mapped file (of its bytes, where the file system can't be mapped)."""
    fs, base = filesystem(folder)
    if fs.type_name == "local":
        raw = np.asarray(np.memmap(f"{base}/{name}", np.uint8, "r"))  # plain arrays are indexed faster
    else:
        with fs.open_input_file(f"{base}/{name}") as f:
            raw = np.frombuffer(f.read(), np.uint8)
    size = struct.unpack("<q", raw[:8].tobytes())[0]
    header = json.loads(raw[8 : 8 + size].tobytes())
    begin = 8 + size
    found = {}
    for key, (kind, n, at) in header["parts"].items():
        width = np.dtype(kind).itemsize
        found[key] = raw[begin + at : begin + at + n * width].view(kind)
    return found, header["notes"]


def _select_in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the set bit of that rank in each word."""
    place = np.zeros(len(word), np.int64)
    word, rank = word.copy(), rank.copy()
    for width in (32, 16, 8, 4, 2, 1):
        under = np.bitwise_count(word & U((1 << width) - 1)).astype(np.int64)
        over = rank >= under
        rank -= np.where(over, under, 0)
        word = np.where(over, word >> U(width), word)
        place += np.where(over, width, 0)
    return place


class EliasFano:
    """Rising sequences of n numbers each, one after the other (`piece` is the number of one): the low bits of each number packed one after
    the other, the high bits in unary. Places count through all pieces, so one search serves numbers of many pieces."""

    WIDEST = 56  # low bits are read as one word from any byte

    def __init__(self, parts: dict[str, np.ndarray], notes: dict) -> None:
        each = lambda k, kind=np.int64: np.array(notes[k], kind, ndmin=1)
        upto = lambda x: np.concatenate([[0], np.cumsum(x)])
        self.sizes, self.width, self.top = each("n"), each("width"), each("top", U)
        self.starts = upto(self.sizes)
        self.n = int(self.starts[-1])
        self.zeros_at = 64 * upto(each("words"))[:-1] - self.starts[:-1]
        self.low_at = 8 * upto(each("bytes"))[:-1] - self.starts[:-1] * self.width  # the bit of place 0, if the piece went back so far
        self.high, self.before, self.zeros = parts["high"], parts["before"], parts["zeros"]
        self.low = np.ndarray((len(parts["low"]) - 7,), "<u8", parts["low"], strides=(1,))

    @classmethod
    def encode(cls, values: np.ndarray) -> tuple[dict[str, np.ndarray], dict]:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = min(cls.WIDEST, max(0, ((top + 1) // n).bit_length() - 1)) if n else 0
        ones = (values >> U(width)).astype(np.int64) + np.arange(n) if n else np.zeros(0, np.int64)
        words = ((int(ones[-1]) + 2 if n else 1) + 63) // 64
        bits = np.zeros(words * 64, bool)
        bits[ones] = True
        high = np.packbits(bits, bitorder="little").view("<u8")
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)[:-1]])
        zeros = 64 * np.arange(words, dtype=np.int64) - before
        low = []
        if width:
            each = np.arange(width, dtype=np.uint64)
            for a in range(0, n, 1 << 16):  # a multiple of 8, so the pieces join on bytes
                low.append(np.packbits(((values[a : a + (1 << 16), None] >> each) & U(1)).astype(bool).ravel(), bitorder="little"))
        low = np.concatenate([*low, np.zeros(8, np.uint8)])
        return {"high": high, "before": before, "zeros": zeros, "low": low}, {"n": n, "width": width, "top": top, "words": words, "bytes": len(low)}

    def _low(self, i: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
        bit = at + i * width
        return (self.low[bit >> 3] >> (bit & 7).astype(np.uint64)) & ((U(1) << width.astype(np.uint64)) - U(1))

    def _before_zero(self, k: np.ndarray) -> np.ndarray:
        """Numbers that stand before the zero of that rank."""
        word = np.searchsorted(self.zeros, k, "right") - 1
        k = k - self.zeros[word]
        return self.before[word] + _select_in_word(~self.high[word], k) - k

    def piece_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, place, "right") - 1

    def access(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.before, i, "right") - 1
        place = 64 * word + _select_in_word(self.high[word], i - self.before[word])
        piece = self.piece_of(i)
        width = self.width[piece]
        return ((place - i - self.zeros_at[piece]).astype(np.uint64) << width.astype(np.uint64)) | self._low(i, self.low_at[piece], width)

    def successor(self, x: np.ndarray, piece: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first number of the piece that is at least x (where there is none, the place after its last), and whether it is x."""
        x, piece = x.astype(np.uint64), np.broadcast_to(piece, len(x))
        place, same = self.starts[piece + 1], np.zeros(len(x), bool)
        inside = np.flatnonzero((self.sizes[piece] > 0) & (x <= self.top[piece]))
        if not len(inside):
            return place, same
        x, piece = x[inside], piece[inside]
        at, width = self.low_at[piece], self.width[piece]
        head, tail = (x >> width.astype(np.uint64)).astype(np.int64), x & ((U(1) << width.astype(np.uint64)) - U(1))
        zero = self.zeros_at[piece] + head
        ends = self._before_zero(zero)
        a = np.where(head > 0, self._before_zero(np.maximum(zero - 1, 0)), self.starts[piece])
        b = ends.copy()
        open_ = np.flatnonzero(a < b)
        while len(open_):
            middle = (a[open_] + b[open_]) >> 1
            less = self._low(middle, at[open_], width[open_]) < tail[open_]
            a[open_] = np.where(less, middle + 1, a[open_])
            b[open_] = np.where(less, b[open_], middle)
            open_ = open_[a[open_] < b[open_]]
        place[inside] = a
        equal = a < ends
        equal[equal] = self._low(a[equal], at[equal], width[equal]) == tail[equal]
        same[inside] = equal
        return place, same


def get(arrays: dict[str, np.ndarray], notes: dict, name: str) -> EliasFano:
    return EliasFano({k: arrays[f"{name}.{k}"] for k in ("high", "before", "zeros", "low")}, notes[name])
