"""Fill-in-middle transformation: cut a text at two token borders and move its middle to the end.

A token is a run of ASCII letters or one other character. The bytes of a batch of texts are classed as other character, first letter of a run,
further letter or further byte of a character, and the classes are held as a wavelet matrix: one bit vector a class bit, with counts for every
64 bits. A rank query gives how many bytes of a class come before a place; ranks of two classes together are the token borders before it, and
places less ranks of the last class are characters. A cut after k tokens is found by bisection on those ranks, for all texts of a batch at once.

Defined results: a null or empty text, and one that holds a sentinel, stays plain (n is its number of tokens); a null id is hashed as the empty
text; equal rows have equal results; no documents, no rows; other columns are passed by. Nothing but rows of one batch meets in a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.inputs import table
from tidewatch.llm.text import pieces, utf8

SEED = 1
#: Share of texts that are transformed, and of these in the order suffix, prefix, middle.
FORM_PERCENT, SPM_PERCENT = 90, 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

OTHER, FIRST, INSIDE, TAIL = range(4)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


class WaveletMatrix:
    """Ranks of the values 0 to 2**bits - 1 in a sequence. Each level holds one bit of every value, zeros of the level above before its ones."""

    def __init__(self, values: np.ndarray, bits: int = 2) -> None:
        self.bits, self.levels = bits, []
        for bit in range(bits - 1, -1, -1):
            ones = (values >> bit) & 1 == 1
            packed = np.zeros(len(values) // 64 + 1, np.uint64)
            packed.view(np.uint8)[: -(-len(values) // 8)] = np.packbits(ones, bitorder="little")
            counts = np.bitwise_count(packed).astype(np.int64)
            self.levels.append((packed, np.cumsum(counts) - counts, len(values) - int(counts.sum())))
            values = np.concatenate([values[~ones], values[ones]])

    def _ones(self, level: int, places: np.ndarray) -> np.ndarray:
        packed, before, _ = self.levels[level]
        word = places >> 6
        mask = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
        return before[word] + np.bitwise_count(packed[word] & mask)

    def rank(self, value: int, places: np.ndarray) -> np.ndarray:
        """How often the value stands before each place."""
        start, end = np.zeros(1, np.int64), places.astype(np.int64)
        for level in range(self.bits):
            a, b = self._ones(level, start), self._ones(level, end)
            zeros = self.levels[level][2]
            start, end = (zeros + a, zeros + b) if value >> (self.bits - 1 - level) & 1 else (start - a, end - b)
        return end - start


def character_classes(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Class of each byte; a run of letters ends with its text."""
    letter = _LETTER[buf]
    out = np.where(letter, INSIDE, np.where((buf & 0xC0) == 0x80, TAIL, OTHER)).astype(np.uint8)
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[edge] = letter[edge]
    out[begins] = FIRST
    return out


class TokenBorders:
    """Token borders of the texts of a batch, by ranks in one wavelet matrix over all their bytes."""

    def __init__(self, column: pa.Array) -> None:
        self.buf, self.offsets = utf8(column)
        self.matrix = WaveletMatrix(character_classes(self.buf, self.offsets))
        self.tokens = np.diff(self.borders(self.offsets))

    def borders(self, places: np.ndarray) -> np.ndarray:
        return self.matrix.rank(OTHER, places) + self.matrix.rank(FIRST, places)

    def characters(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (end - begin) - (self.matrix.rank(TAIL, end) - self.matrix.rank(TAIL, begin))

    def cuts(self, k: np.ndarray) -> np.ndarray:
        """Where each text's token k (from 0) begins; the text's end if it has k tokens."""
        low, high = self.offsets[:-1].copy(), self.offsets[1:].copy()
        wanted = self.borders(self.offsets[:-1]) + k
        while (open_ := low < high).any():
            middle = (low + high) // 2
            beyond = self.borders(middle + 1) > wanted
            low, high = np.where(open_ & ~beyond, middle + 1, low), np.where(open_ & beyond, middle, high)
        return low


def fill_in_middle(docs: DataFrame, seed: int = SEED, form_percent: int = FORM_PERCENT, spm_percent: int = SPM_PERCENT, prefix: str = PREFIX, suffix: str = SUFFIX, middle: str = MIDDLE) -> DataFrame:
    """doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output text of each row."""
    p, s, m = (x.encode() for x in (prefix, suffix, middle))

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = TokenBorders(batch.column("text"))
            h1, h2, h3, h4 = (batch.column(f"h{i}").to_numpy() for i in range(1, 5))
            one, two = h1 % (found.tokens + 1), h2 % (found.tokens + 1)
            low, high = found.cuts(np.minimum(one, two)), found.cuts(np.maximum(one, two))
            data, begin, end = found.buf.tobytes(), found.offsets[:-1], found.offsets[1:]
            forms, outputs = [], []
            for a, b, c, d, formed, spm in zip(begin.tolist(), low.tolist(), high.tolist(), end.tolist(), (h3 % 100 < form_percent).tolist(), (h4 % 100 < spm_percent).tolist(), strict=True):
                text = data[a:d]
                if not formed or not text or p in text or s in text or m in text:
                    forms.append("plain")
                    outputs.append(text)
                elif spm:
                    forms.append("spm")
                    outputs.append(b"".join((s, data[c:d], p, data[a:b], m, data[b:c])))
                else:
                    forms.append("psm")
                    outputs.append(b"".join((p, data[a:b], s, data[c:d], m, data[b:c])))
            plain = np.array([f == "plain" for f in forms], bool)
            columns = [
                batch.column("doc_id"), pa.array(found.tokens), pa.array(forms, pa.string()),
                pa.array(found.characters(begin, low), mask=plain), pa.array(found.characters(low, high), mask=plain), pa.array(outputs, pa.binary()).cast(pa.string()),
            ]
            yield pa.record_batch(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    numbers = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), *numbers)
    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(transform, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, prefix: str = PREFIX, suffix: str = SUFFIX, middle: str = MIDDLE) -> Column:
    """The text again. No transformed text holds a sentinel, so the sentinels split the output into its three parts."""
    part = F.split(output, "|".join(map(re.escape, (prefix, suffix, middle))), -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    )


_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
e AS (SELECT *, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
f AS (SELECT *, array_to_string(units[:least(a, b)], '') AS p, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(units[greatest(a, b) + 1:], '') AS s FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM f
"""

QUERIES = {"op13_fill_middle": op13_fill_middle}
ORACLES = {"op13_fill_middle": _SQL}
