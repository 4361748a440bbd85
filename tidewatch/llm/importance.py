"""Target-distribution importance resampling: draw the documents that look most like a target corpus.

A text is its words and pairs of neighbouring words, hashed into buckets. How much more usual a bucket is in the target than in all documents
is its gain; the mean gain of a document's features is its weight, and weight plus Gumbel noise from its id is its score. Features are counted
and looked up as arrays, a batch of texts at a time, and only bucket counts leave a task. The highest scores are found without a global sort:
a cutoff is bisected by exact counts over the stored scores, then over ids among rows of that score; the drawn rows alone are sorted by ranges.

Defined results: a null or empty text has no words, weight 0, and is never drawn; a null id counts as the empty text in the hash and comes last
among ties; rows of one id and one score are drawn in the order of the table, each with a rank of its own; no target texts, and gains only
measure rarity; no documents, no rows; other columns are passed by.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.inputs import staged, table
from tidewatch.llm.text import pieces, spans, utf8

BUCKETS = 10_000
SEED = 7
#: Documents of fewer words are not drawn.
LEAST_WORDS = 20
PERCENT = 25
#: Thresholds that one count job tries; 15 halve the interval four times.
CUTS = 15
#: Drawn rows that one task sorts.
RANGE_ROWS = 500_000

#: Bytes that are no digit, no ASCII letter and not part of a longer character.
BREAK = np.zeros(256, bool)
BREAK[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

#: Longest word whose checksum is put together from tables; longer ones are computed one by one.
TABLE_LENGTH = 256


def _crc_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32 is linear: what a byte adds when d bytes follow it, what a checksum becomes when d bytes follow, and that of d zero bytes."""
    one = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    step = lambda c: (c >> np.uint32(8)) ^ one[c & np.uint32(255)]
    byte, after = [one], [np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])]
    for _ in range(TABLE_LENGTH):
        byte.append(step(byte[-1]))
        after.append(step(after[-1]))
    return np.stack(byte), np.stack(after), np.array([zlib.crc32(bytes(d)) for d in range(TABLE_LENGTH + 1)], np.uint32)


_BYTE, _AFTER, _ZEROS = _crc_tables()


def _shifted(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Checksums moved past `by` further bytes."""
    out = np.zeros(len(crc), np.uint32)
    for k in range(4):
        out ^= _AFTER[by, k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def word_checksums(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of each span of lower-cased bytes."""
    lengths = ends - starts
    out = np.zeros(len(starts), np.uint32)
    short = np.flatnonzero(lengths <= TABLE_LENGTH)
    if len(short):
        size = lengths[short]
        at = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(at, size)
        added = _BYTE[np.repeat(size, size) - 1 - place, buf[place + np.repeat(starts[short], size)]]
        out[short] = np.bitwise_xor.reduceat(added, at) ^ _ZEROS[size]
    for i in np.flatnonzero(lengths > TABLE_LENGTH):
        out[i] = zlib.crc32(buf[starts[i] : ends[i]])
    return out


def feature_checksums(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of texts: checksum of each word, of each pair of neighbouring words of a text, each pair's first word, and the words before each text."""
    buf, offsets = utf8(column)
    buf = _LOWER[buf]
    starts, ends, before = spans(buf, offsets, BREAK)
    word = word_checksums(buf, starts, ends)
    first = np.ones(len(word), bool)
    first[before[1:][before[1:] > 0] - 1] = False
    first = np.flatnonzero(first)
    gap = np.full(len(first), zlib.crc32(b" "), np.uint32) ^ _shifted(word[first], np.ones(len(first), np.int64))
    size = (ends - starts)[first + 1]
    pair = _shifted(gap, np.minimum(size, TABLE_LENGTH)) ^ word[first + 1]
    for i in np.flatnonzero(size > TABLE_LENGTH):
        pair[i] = zlib.crc32(buf[starts[first[i] + 1] : ends[first[i] + 1]], int(gap[i]))
    return word, pair, first, before


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n: features of all texts in it. A task gives one row a bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in pieces(batches, "text"):
            word, pair, _, _ = feature_checksums(batch.column("text"))
            total += np.bincount(word % buckets, minlength=buckets) + np.bincount(pair % buckets, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares in the target and in all documents; one number a bucket, whatever the tables."""
    found = {}
    for name, df in (("s", docs), ("t", target)):
        counts = np.zeros(buckets, np.int64)
        for row in bucket_counts(df, buckets).collect():  # at most one row a bucket
            counts[row.bucket] = row.n
        found[name] = counts
    s, t = found["s"].tolist(), found["t"].tolist()
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log(((b + 1.0) * all_s) / ((a + 1.0) * all_t))) for a, b in zip(s, t, strict=True)], np.int64)


def weighed(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of each row."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            word, pair, first, before = feature_checksums(batch.column("text"))
            gain = gains[word % len(gains)]
            gain[first] += gains[pair % len(gains)]
            sums = np.concatenate([[0], np.cumsum(gain)])[before]
            words = np.diff(before)
            features = words + np.maximum(words - 1, 0)
            weight = np.diff(sums) // np.maximum(features, 1)
            yield pa.record_batch([batch.column("doc_id"), *map(pa.array, (words, features, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(weigh, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise that only the id and the seed decide."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def smallest_covering(rows: DataFrame, key: str, k: int) -> tuple[int, int, int]:
    """The least value v for which at least k rows (of no fewer) have key <= v, how many have key < v, and how many have v.

    Each job counts all rows against a few thresholds and leaves a sixteenth of the interval; nothing is sorted.
    """
    low, high = rows.agg(F.min(key), F.max(key)).first()
    while low < high:
        cuts = sorted({low + (high - low) * i // (CUTS + 1) for i in range(1, CUTS + 1)})
        counts = rows.agg(*[F.count_if(F.col(key) <= F.lit(c).cast("long")).alias(f"c{i}") for i, c in enumerate(cuts)]).first()
        enough = [c for c, n in zip(cuts, counts, strict=True) if n >= k]
        short = [c for c, n in zip(cuts, counts, strict=True) if n < k]
        low, high = (max(short) + 1 if short else low), (min(enough) if enough else high)
    less, same = rows.agg(F.count_if(F.col(key) < F.lit(low).cast("long")), F.count_if(F.col(key) == F.lit(low).cast("long"))).first()
    return low, less, same


def within_first(rows: DataFrame, keys: list[str], k: int) -> Column:
    """Whether a row is one of the first k in ascending order of the keys, as a condition on its own keys. The last key tells rows apart."""
    if k <= 0:
        return F.lit(False)
    value, less, same = smallest_covering(rows, keys[0], k)
    own, cut = F.col(keys[0]), F.lit(value).cast("long")
    if less + same <= k or len(keys) == 1:
        return own <= cut
    return (own < cut) | ((own == cut) & within_first(rows.filter(own == cut), keys[1:], k - less))


def with_ranks(rows: DataFrame, keys: list[str], n_rows: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds rank (from 1) in ascending order of the keys: sorted ranges, and the rows of all ranges before."""
    ranges = max(1, -(-n_rows // range_rows))
    in_order = rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id())
    in_order = staged(in_order, "importance-ranges")
    part = F.shiftright("place", 33)
    sizes = in_order.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # a row a range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("part").alias("of_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return in_order.join(starts, part == F.col("of_part")).withColumn("rank", rank).drop("place", "of_part", "start")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null: not drawn) of each row of docs. Both tables need `text`, docs `doc_id` too."""
    scored = weighed(docs, bucket_gains(docs, target, buckets)).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    last = F.lit(2**63 - 1).cast("long")
    scored = staged(scored.withColumn("order_score", -F.col("score")).withColumn("order_id", F.coalesce(F.col("doc_id").cast("long"), last)).withColumn("order_row", F.monotonically_increasing_id()), "importance-scores")
    keys = ["order_score", "order_id", "order_row"]
    fit = scored.filter(F.col("n_words") >= least_words)
    k = percent * fit.count() // 100
    drawn = (F.col("n_words") >= least_words) & within_first(fit, keys, k)
    out = with_ranks(scored.filter(drawn), keys, k).unionByName(scored.filter(~drawn).withColumn("rank", F.lit(None).cast("long")))
    return out.drop(*keys)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


# The checksums of distinct features are worked out byte by byte, from the 256 of single bytes.
_SQL = r"""
WITH RECURSIVE step(i, k, c) AS (
  SELECT i, 0, CAST(i AS UINTEGER) FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END FROM step WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
texts AS (SELECT 's' AS side, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL SELECT 't', -row_number() OVER (), NULL, text FROM benchmark),
w AS (SELECT side, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
f AS (SELECT side, r, unnest(list_concat(words, [words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))])) AS feature FROM w),
g AS (SELECT side, r, feature, count(*) AS n FROM f GROUP BY ALL),
d AS (SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM g)),
b AS (SELECT feature, CAST(xor(list_reduce([CAST(('0x' || h[2 * i - 1:2 * i]) AS UINTEGER) FOR i IN range(1, len(h) // 2 + 1)],
    lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS BIGINT) + 1]), 4294967295::UINTEGER), 4294967295::UINTEGER) % 10000 AS BIGINT) AS bucket FROM d, tab),
gb AS (SELECT side, r, bucket, sum(n) AS n FROM g JOIN b USING (feature) GROUP BY ALL),
c AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 's'), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 't'), 0) AS t FROM gb GROUP BY bucket),
a AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM c),
gain AS (SELECT bucket, CAST(floor(1000 * ln(((CAST(t AS DOUBLE) + 1) * (CAST(all_s AS DOUBLE) + 10000)) / ((CAST(s AS DOUBLE) + 1) * (CAST(all_t AS DOUBLE) + 10000)))) AS BIGINT) AS gain FROM c, a),
x AS (SELECT r, sum(n) AS n_features, sum(n * gain) AS total FROM gb JOIN gain USING (bucket) WHERE side = 's' GROUP BY r),
y AS (SELECT doc_id, len(words) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features,
    CASE WHEN n_features > 0 THEN CAST((total - ((total % n_features) + n_features) % n_features) // n_features AS BIGINT) ELSE 0 END AS weight,
    (CAST(('0x' || sha256('7:' || doc_id)[1:8]) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE AS u FROM w LEFT JOIN x USING (r) WHERE side = 's'),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln(u))) AS BIGINT) AS score FROM y),
k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM z WHERE n_words >= 20)
SELECT z.doc_id, n_features, weight, score, n_words, CASE WHEN rank <= 25 * (SELECT count(*) FROM k) // 100 THEN rank END AS rank FROM z LEFT JOIN k ON z.doc_id = k.doc_id
"""

QUERIES = {"op11_importance": op11_importance}
ORACLES = {"op11_importance": _SQL}
