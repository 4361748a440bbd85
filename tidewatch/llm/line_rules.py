"""Quality rules, line first: lines that fail are removed, then documents that lose too much text are rejected.

A line fails as navigation where bars or symbols take much of it, as boilerplate where it holds a stock phrase, and for punctuation where
it is a short line without a closing mark or a line without any mark. A document is rejected where under `min_kept` of its words'
characters stay, or where one of the base measures fails.

Defined results: a null or empty text has zero measures, is failed by its length and is not kept, its clean text is null or empty; equal
rows give equal rows; no documents, no rows; other columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.inputs import table
from tidewatch.llm.text import NEWLINE, SPACE, fingerprints, mix64, pieces, spans, utf8

PHRASES = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of service", "terms of use", "enable javascript", "lorem ipsum",
    "click here", "read more", "sign up for", "log in to", "subscribe to", "share this", "skip to content",
)
MIN_KEPT = 0.5
SHORT_LINE_WORDS = 15
SYMBOL_SHARE = 0.1
MIN_WORDS = 50
REPEAT_PERCENT = 50


def _table(chars: str) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(chars.encode())] = True
    return found


SYMBOLS = _table("#*$%&|<>")
LOUD = _table("#*$%&|<>!")
MARKS = _table(".!?,;:")
CLOSING = _table(".!?:;\"')]")
#: The last three bytes of closing marks outside ASCII.
WIDE_CLOSING = np.array([int.from_bytes(c.encode()[-3:].rjust(3, b"\0"), "big") for c in "…”’。！？｡؟।"])

RESULT = (
    "doc_id long, clean_text string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_removed long, kept_chars long, base_failed boolean, kept boolean"
)


def _within(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[ends] - sums[starts]


def _per_text(flags_at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return _within(flags_at, bounds[:-1], bounds[1:])


def _distinct(keys: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys of each text."""
    _, first = np.unique(mix64(keys ^ mix64(doc.astype(np.uint64) + np.uint64(1))), return_index=True)
    return np.bincount(doc[first], minlength=n)


def measures(texts: pa.Array) -> dict[str, np.ndarray]:
    """Base measures of each text, its lines (start, end, bounds by text) and which of them fail the rules apart from phrases."""
    buf, offsets = utf8(texts)
    n = len(texts)
    starts, ends, bounds = spans(buf, offsets)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    leading = (buf & 0xC0) != 0x80
    leads = np.concatenate([[0], np.cumsum(leading, dtype=np.int64)])
    chars = leads[ends] - leads[starts]
    words = fingerprints(buf, starts, ends)
    covered = np.zeros(len(words), bool)
    if len(words) > 2:
        key = mix64(words[:-2] + mix64(words[1:-1] + mix64(words[2:])) + doc[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        inside = np.flatnonzero(doc[:-2] == doc[2:])
        _, inverse, counts = np.unique(key[inside], return_inverse=True, return_counts=True)
        twice = inside[counts[inverse] > 1]
        for k in range(3):
            covered[twice + k] = True
    line_starts, line_ends, line_bounds = spans(buf, offsets, NEWLINE)
    line_doc = np.repeat(np.arange(n), np.diff(line_bounds))
    first_word, after_word = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
    line_words = after_word - first_word
    worded = line_words > 0
    sums = np.concatenate([[0], np.cumsum(chars)])
    line_chars = sums[after_word] - sums[first_word]
    print_lines = fingerprints(buf, line_starts[worded], line_ends[worded])
    dup = np.bincount(line_doc[worded], minlength=n) - _distinct(print_lines, line_doc[worded], n)
    loud, marks = _within(LOUD[buf], line_starts, line_ends), _within(MARKS[buf], line_starts, line_ends)
    closed = np.zeros(len(line_starts), bool)
    stop = ends[after_word[worded] - 1] if len(ends) else np.zeros(0, np.int64)
    tail = buf[stop - 1].astype(np.int64) + (buf[np.maximum(stop - 2, 0)].astype(np.int64) << 8) + (buf[np.maximum(stop - 3, 0)].astype(np.int64) << 16) if len(stop) else stop
    closed[worded] = CLOSING[tail & 0xFF] | np.isin(tail, WIDE_CLOSING) | np.isin(tail & 0xFFFF, WIDE_CLOSING[WIDE_CLOSING < 1 << 16]) if len(stop) else False
    fails = worded & ((loud > SYMBOL_SHARE * line_chars) | (~closed & ((line_words < SHORT_LINE_WORDS) | (marks == 0))))
    return {
        "n_words": np.diff(bounds), "word_chars": _per_text(chars, bounds), "n_symbols": _within(SYMBOLS[buf], offsets[:-1], offsets[1:]),
        "n_dup_lines": dup, "n_repeat_words": _per_text(covered, bounds),
        "line_starts": line_starts - offsets[line_doc], "line_ends": line_ends - offsets[line_doc], "line_bounds": line_bounds,
        "line_chars": line_chars, "worded": worded, "fails": fails,
    }


def _clean(batches: Iterator[pa.RecordBatch], min_kept: float, phrases: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        texts = batch.column("text")
        m = measures(texts)
        fails, bounds = m["fails"], m["line_bounds"]
        cleaned = texts.to_pylist()
        kept_chars = np.zeros(len(cleaned), np.int64)
        for i, text in enumerate(cleaned):
            lines = slice(bounds[i], bounds[i + 1])
            if text:
                low = text.lower()
                hit = [p for p in phrases if p in low]
                if hit or fails[lines].any():
                    raw = text.encode()
                    own = [raw[a:b] for a, b in zip(m["line_starts"][lines], m["line_ends"][lines], strict=True)]
                    if hit:
                        fails[lines] |= [any(p in x.decode().lower() for p in hit) for x in own]
                    cleaned[i] = b"\n".join(x for x, bad in zip(own, fails[lines], strict=True) if not bad).decode()
            kept_chars[i] = m["line_chars"][lines][~fails[lines]].sum()
        per_line = np.stack([m["worded"], fails & m["worded"]]).astype(np.int64)
        sums = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(per_line, axis=1)], axis=1)
        n_lines, n_removed = sums[:, bounds[1:]] - sums[:, bounds[:-1]]
        failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * m["n_words"])
        kept = ~failed & (kept_chars >= min_kept * m["word_chars"])
        longs = [pa.array(m[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array(cleaned, pa.string()), *longs, pa.array(n_lines), pa.array(n_removed), pa.array(kept_chars), pa.array(failed), pa.array(kept)],
            names=["doc_id", "clean_text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_removed", "kept_chars", "base_failed", "kept"],
        )


def clean_lines(docs: DataFrame, min_kept: float = MIN_KEPT, phrases: tuple[str, ...] = PHRASES) -> DataFrame:
    """A row a document: its text without the failed lines, base measures, lines with a word, removed ones, and the verdict."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _clean(batches, min_kept, phrases), RESULT)


def op5_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = clean_lines(table(spark, sf_dir, "documents"))
    return cleaned.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_removed",
        F.crc32(F.coalesce("clean_text", F.lit("")).cast("binary")).alias("clean_crc32"),
    )


QUERIES = {"op5_line_rules": op5_line_rules}
ORACLES: dict[str, str] = {}
