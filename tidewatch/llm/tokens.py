"""Token ids of whole texts by a public tokenizer file, inside Arrow tasks.

The tokenizer drops white space and never joins across it, so a text's ids are those of its words one after the other. Each distinct word
is encoded once for a worker and kept in a bounded table. `by_words=False` encodes whole texts instead, for files without that property.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidewatch.llm.text import fingerprints, spans, utf8

#: Words kept by a worker; the table is started anew when it is full.
TABLE_WORDS = 2_000_000
_encoders: dict[tuple[str, bool], Encoder] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str, by_words: bool = True) -> Encoder:
    if (path, by_words) not in _encoders:
        _encoders[path, by_words] = Encoder(path, by_words)
    return _encoders[path, by_words]


class Encoder:
    def __init__(self, path: str, by_words: bool) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = by_words
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.order = np.zeros(0, np.int64)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, `end_id` after each, and where each text's ids start (one entry more than texts)."""
        if not self.by_words:
            found = [np.array([*e.ids, end_id], np.int32) for e in self.tokenizer.encode_batch(texts.fill_null("").to_pylist(), add_special_tokens=False)]
            return np.concatenate(found), np.concatenate([[0], np.cumsum([len(x) for x in found])])
        buf, offsets = utf8(texts)
        starts, ends, bounds = spans(buf, offsets)
        slots = self._slots(buf, starts, ends)
        # a word's ids, and the end after the last word of each text
        first, count = self.at[slots], self.at[slots + 1] - self.at[slots]
        words_before = np.concatenate([[0], np.cumsum(count)])
        text_starts = words_before[bounds] + np.arange(len(bounds))
        out = np.full(int(words_before[-1]) + len(bounds) - 1, end_id, np.int32)
        if len(slots):
            text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            step = np.arange(int(words_before[-1])) - np.repeat(words_before[:-1], count)
            out[np.repeat(words_before[:-1] + text, count) + step] = self.ids[np.repeat(first, count) + step]
        return out, text_starts

    def _slots(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Place of each word in the table, which gains the new ones."""
        if not len(starts):
            return np.zeros(0, np.int64)
        coded = pa.array(fingerprints(buf, starts, ends)).dictionary_encode()
        distinct, index = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        if len(self.known) + len(distinct) > TABLE_WORDS:
            self._clear()
        place = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != distinct[inside]
        slot = np.empty(len(distinct), np.int64)
        slot[~new] = self.order[place[~new]]
        if new.any():
            first = np.empty(len(distinct), np.int64)
            first[index[::-1]] = np.arange(len(index))[::-1]
            words = [bytes(buf[a:b]).decode() for a, b in zip(starts[first[new]], ends[first[new]], strict=True)]
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            lengths = pc.list_value_length(flat := pa.array(lists, pa.list_(pa.int32()))).to_numpy()
            slot[new] = np.arange(len(words)) + len(self.at) - 1
            self.ids = np.concatenate([self.ids, flat.flatten().to_numpy()])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(lengths)])
            by = np.argsort(distinct[new])
            place = place[new][by]
            self.known, self.order = np.insert(self.known, place, distinct[new][by]), np.insert(self.order, place, slot[new][by])
        return slot[index]


def crc32_of(ids: np.ndarray, start: int = 0) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers, going on from `start`."""
    import zlib

    return zlib.crc32(np.ascontiguousarray(ids, "<u4").data, start)
