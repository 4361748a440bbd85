"""Which of many tokens a text contains: an index of each token's rarest n-gram instead of one test a token.

A text that contains a token contains all its runs of four bytes, so it is enough to look the token up by the one that texts have least often (a
token of fewer than four bytes by itself). Only texts with that run are tested. Runs are counted in hashed buckets, a fixed number of counts a
task, and none of them are stored: texts are passed over once to count and once to look up, and moved once, to their candidates. Work grows
with the bytes of the texts and with the candidates, not with texts times tokens. Runs are numbers, cut by numpy from a whole Arrow batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.staging import staged

GRAM = 4
SPAN = 1 << 20  # bytes worked on at once
COUNT_BITS, LOOKUP_BITS = 18, 22  # buckets of the counts; bits that say which runs are looked up (512 KB)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _bucket(grams: np.ndarray, bits: int) -> np.ndarray:
    return ((grams.astype(np.uint64) * MULTIPLIER) >> np.uint64(64 - bits)).astype(np.int64)


def _grams(column: pa.Array, sizes: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, run of bytes as a number) of all rows, stretch by stretch; runs do not cross rows. There are no nulls."""
    if not len(column):
        return
    column = column.cast(pa.large_binary())
    _, ends, values = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.empty(0, np.uint8)
    for start in range(int(ends[0]), int(ends[-1]), SPAN):
        stop = min(start + SPAN, int(ends[-1]))
        part = data[start: min(stop + GRAM - 1, int(ends[-1]))].astype(np.int64)
        place = np.arange(start, stop)
        row = np.searchsorted(ends, place, side="right") - 1
        left = ends[row + 1] - place
        for n in sizes:
            usable = np.flatnonzero(left >= n)
            code = np.full(len(usable), n, np.int64)
            for k in range(n):
                code = (code << 8) | part[usable + k]
            yield row[usable], code


def _counts(sizes: list[int]) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            for _, grams in _grams(batch.column(0), sizes):
                total += np.bincount(_bucket(grams, COUNT_BITS), minlength=len(total))
        bucket = np.flatnonzero(total)
        yield pa.record_batch([pa.array(bucket), pa.array(total[bucket])], names=["bucket", "n"])

    return count


def _of_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of each token: those of four bytes, or the whole of a shorter one."""
    for batch in batches:
        tokens = batch.column(0)
        length = pc.binary_length(tokens).to_numpy(zero_copy_only=False)
        for size in range(1, GRAM + 1):
            part = tokens.filter(pa.array(np.minimum(length, GRAM) == size))
            for row, grams in _grams(part, [size]):
                yield pa.record_batch([part.take(pa.array(row)), pa.array(grams), pa.array(_bucket(grams, COUNT_BITS))], names=["token", "gram", "bucket"])


def _lookups(sizes: list[int], wanted: np.ndarray) -> Callable:
    """(key, run) of the runs whose bit is set; at least once each."""

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, grams in _grams(batch.column(1), sizes):
                bit = _bucket(grams, LOOKUP_BITS)
                found = np.flatnonzero((wanted[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
                row, grams = np.unique(np.stack([row[found], grams[found]]), axis=1) if len(found) else (row[:0], grams[:0])
                yield pa.record_batch([batch.column(0).take(pa.array(row)), pa.array(grams)], names=["key", "gram"])

    return look_up


def _wanted(grams: DataFrame) -> np.ndarray:
    """The bits of the runs, gathered as bytes that differ from 0: a row for each, 2^19 at most."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << (LOOKUP_BITS - 3), np.uint8)
        for batch in batches:
            bit = _bucket(batch.column(0).to_numpy(), LOOKUP_BITS)
            np.bitwise_or.at(held, bit >> 3, np.left_shift(np.uint8(1), (bit & 7).astype(np.uint8)))
        at = np.flatnonzero(held)
        yield pa.record_batch([pa.array(at), pa.array(held[at].astype(np.int64))], names=["at", "bits"])

    wanted = np.zeros(1 << (LOOKUP_BITS - 3), np.uint8)
    rows = grams.mapInArrow(bits, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    wanted[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint8)
    return wanted


def keyed_token_hits(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """Distinct (key, tag) where a text of the key contains a token of that tag. `rows` has key and text, `tokens` has token and tag.

    Null and empty tokens are in no text, null texts contain none; a repeated key has the tokens of all its texts, a null key has none. Tables of any
    size: texts and tokens meet by equi-joins on runs of bytes. `rows` is read three times.
    """
    known = staged(tokens.filter("token <> ''").select("token", "tag").distinct(), "tokens")
    size = F.least(F.octet_length("token"), F.lit(GRAM))
    sizes = sorted(r["n"] for r in known.select(size.alias("n")).distinct().collect())  # four rows at most
    texts = rows.select("key", "text").filter("text <> ''")
    if not sizes:
        return texts.select("key", F.lit(None).cast(tokens.schema["tag"].dataType).alias("tag")).limit(0)
    counts = texts.select("text").mapInArrow(_counts(sizes), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    own = known.select("token").distinct().mapInArrow(_of_tokens, "token string, gram bigint, bucket bigint")
    # at most 2^18 counts; a token with a run that no text has is in no text
    rarest = own.join(F.broadcast(counts), "bucket", "left").groupBy("token").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    chosen = staged(rarest.filter("r.n > 0").select("token", "r.gram"), "token-grams")
    shape = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("gram", T.LongType())])
    pairs = texts.mapInArrow(_lookups(sizes, _wanted(chosen.select("gram"))), shape).join(chosen, "gram").select("key", "token").distinct()
    found = texts.join(pairs, "key").filter(F.col("text").contains(F.col("token"))).select("key", "token")
    return found.join(known, "token").select("key", "tag").distinct()


def token_hits(texts: DataFrame, tokens: DataFrame) -> DataFrame:
    """Distinct (text, tag) where the text contains a token of that tag. `texts` has text; equal ones are looked up once. Else as `keyed_token_hits`."""
    distinct = staged(texts.filter("text <> ''").select("text").distinct().withColumn("key", F.monotonically_increasing_id()), "texts")
    return distinct.join(keyed_token_hits(distinct, tokens), "key").select("text", "tag")
