"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model reads characters: lower-cased, a capital inside a word is one symbol, digits one; every other character of the texts is a symbol of
its own, whatever its script. n-grams of up to four symbols are counted in the trusted texts of the training folds. The rest is joins of count
tables, sharded by context: counts with the sums of their contexts, and each order with the probabilities of the order below. A finished order
is written as sorted arrays, shard by shard in ranges of contexts, so it may grow with the trusted texts; tasks map the shards and look up the
distinct n-grams of a batch of texts. Sending the n-grams of every text to the shards instead would move several times the texts themselves.

Four symbols make one number of 63 bits for up to 55 108 symbols. Texts with more than DIRECT characters have the rarest written as two symbols
each, so none is left out.

A document is kept where its perplexity is within the range of its language: between quantiles of trusted documents of the held-out fold, each
widened by a factor that falls with the number of documents. Languages without such documents use the range of all trusted ones.

Defined results: a null or empty text has null perplexity and is not kept; a null language is a language of its own; without trusted text every
document with text is kept; equal rows give equal rows; no documents, no rows; other columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.elias_fano import map_arrays, write_arrays
from tidewatch.llm.inputs import column_or_null, fold, new_folder, staged, table, whole_row
from tidewatch.llm.text import pieces

ORDER = 4
FOLDS = 5
#: Quantiles of trusted documents' perplexity, and how far beyond them a document may be.
LOW, HIGH = 0.005, 0.995
WIDEN = 1.25
#: Quantiles of n documents are wider by this over the root of n.
FEW = 1.5
#: Characters that are one symbol; further ones are two, of these many second symbols.
DIRECT, SECOND = 50_000, 1_024
#: n-grams of a shard, and the most that a counting task holds.
SHARD_GRAMS = 1 << 20
CHARACTERS = 0x110000
#: Text that is worked on at a time, and shards that a worker holds open.
TEXT_BYTES = 1 << 20
OPEN_SHARDS = 64

_CAPITAL, _LINE = 1, 0x0A
_PLAIN = np.arange(1 << 16, dtype=np.int64)
_UPPER, _LETTER = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
for _c in range(1 << 16):
    if not 0xD800 <= _c < 0xE000:
        _s = chr(_c)
        if _s.isalpha():
            _LETTER[_c], _UPPER[_c] = True, _s.isupper()
            _PLAIN[_c] = ord(_s.lower()) if len(_s.lower()) == 1 else _c
        elif _s.isspace():
            _PLAIN[_c] = _LINE if _c == _LINE else 0x20
        elif _s.isdigit():
            _PLAIN[_c] = 0x30


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Plain characters of all texts, each text after three line ends, and where each begins (one entry more than texts)."""
    lead = "\n" * (ORDER - 1)
    points = np.frombuffer("".join(lead + t for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    low = np.minimum(points, 0xFFFF)
    plain = np.where(points == low, _PLAIN[low], points)
    inside = np.zeros(len(points), bool)
    inside[1:] = _UPPER[low[1:]] & _LETTER[low[:-1]]
    plain[inside] = _CAPITAL
    return plain, np.concatenate([[0], np.cumsum([len(t) + ORDER - 1 for t in texts])])


class Alphabet:
    """Codes of characters, the most frequent first; 0 is none of them. `size` counts all codes."""

    def __init__(self, characters: np.ndarray, direct: int = DIRECT, second: int = SECOND) -> None:
        self.characters, self.direct, self.second = characters, direct, second
        self.firsts = -(-max(0, len(characters) - direct) // second)
        self.size = 1 + min(len(characters), direct) + (self.firsts + second if self.firsts else 0)

    def codes(self, plain: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of plain characters, and where each text begins; rare characters are two symbols."""
        place = np.zeros(CHARACTERS, np.int32)
        place[self.characters] = np.arange(1, len(self.characters) + 1)
        found = place[plain].astype(np.int64)
        beyond = found - self.direct - 1
        rare = beyond >= 0
        if not rare.any():
            return found, begins
        found[rare] = self.direct + 1 + beyond[rare] // self.second
        twice = np.repeat(found, 1 + rare)
        twice[(np.arange(len(found)) + np.cumsum(rare))[rare]] = self.direct + 1 + self.firsts + beyond[rare] % self.second
        return twice, begins + np.concatenate([[0], np.cumsum(rare)])[begins]


def _codes(texts: list[str], alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """Code of the n-gram that ends at each symbol, and the text it is in."""
    s, begins = alphabet.codes(*symbols(texts))
    grams = s[ORDER - 1 :].copy()
    for back in range(1, ORDER):
        grams += s[ORDER - 1 - back : len(s) - back] * alphabet.size**back
    text = np.repeat(np.arange(len(texts)), np.diff(begins))
    whole = text[ORDER - 1 :] == text[: len(grams)]
    return grams[whole], text[ORDER - 1 :][whole]


def _count_symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CHARACTERS, np.int64)
    for batch in pieces(batches, "text", TEXT_BYTES):
        own = np.bincount(symbols(batch.column("text").to_pylist())[0])
        total[: len(own)] += own
    seen = np.flatnonzero(total)
    yield pa.record_batch([pa.array(seen), pa.array(total[seen])], names=["symbol", "n"])


def _summed(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[first], np.add.reduceat(counts, first)


def _count_grams(batches: Iterator[pa.RecordBatch], alphabet: Alphabet) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        return _summed(*map(np.concatenate, zip(*held, strict=True)))

    def rows() -> pa.RecordBatch:
        return pa.record_batch([pa.array(x) for x in held.pop()], names=["gram", "n"])

    for batch in pieces(batches, "text", TEXT_BYTES):
        held.append(np.unique(_codes(batch.column("text").to_pylist(), alphabet)[0], return_counts=True))
        if sum(len(g) for g, _ in held) > SHARD_GRAMS:
            held = [merged()]
            if len(held[0][0]) > SHARD_GRAMS // 2:
                yield rows()
    if held:
        held = [merged()]
        yield rows()


def _discounts(counts: DataFrame) -> list[float]:
    """Discounts of counts 1, 2 and 3 or more, from how many n-grams have each of the counts 1 to 4."""
    n = counts.agg(*[F.count_if(F.col("n") == i) for i in range(1, 5)]).first()
    if not n[0] or not n[1]:
        return [0.5, 0.75, 0.75]
    y = n[0] / (n[0] + 2 * n[1])
    raw = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 1.0]
    return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]


def orders(counts: DataFrame, k: int) -> list[DataFrame]:
    """For each order from 1: gram, share (interpolated probability of its last symbol) and left (what its context leaves to shorter ones).

    `counts` has gram and n of the highest order; an n-gram of a lower order counts the symbols that stand before it.
    """
    levels = [counts]
    for size in range(ORDER - 1, 0, -1):
        levels.insert(0, staged(levels[0].groupBy((F.col("gram") % k**size).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "kn-counts"))
    found: list[DataFrame] = []
    for size, level in enumerate(levels, 1):
        d = _discounts(level)
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        context = F.expr(f"gram DIV {k}")
        sums = level.groupBy(context.alias("context")).agg(F.sum("n").alias("all"), F.sum(cut).alias("cut"))
        rows = level.withColumn("context", context).join(sums, "context").withColumn("own", (F.col("n") - cut) / F.col("all")).withColumn("left", F.col("cut") / F.col("all"))
        if size == 1:
            shares = rows.withColumn("share", F.col("own") + F.col("left") / k)
        else:
            below = found[-1].select(F.col("gram").alias("shorter"), F.col("share").alias("below"))
            shares = rows.withColumn("shorter", F.col("gram") % k ** (size - 1)).join(below, "shorter").withColumn("share", F.col("own") + F.col("left") * F.col("below"))
        found.append(staged(shares.select("gram", "share", "left"), "kn-order"))
    return found


def _write_shares(batches: Iterator[pa.RecordBatch], folder: str, order: int, k: int) -> Iterator[pa.RecordBatch]:
    """A shard of an order: its n-grams in rising order, and what each of its contexts leaves to the order below."""
    rows = pa.Table.from_batches(list(batches), pa.schema([("gram", pa.int64()), ("share", pa.float64()), ("left", pa.float64())]))
    if not rows.num_rows:
        return
    grams = rows.column("gram").to_numpy()
    contexts, first = np.unique(grams // k, return_index=True)
    name = f"order-{order}-{contexts[0]}"
    write_arrays(folder, name, {"grams": grams, "shares": rows.column("share").to_numpy(), "contexts": contexts, "left": rows.column("left").to_numpy()[first]}, {})
    yield pa.record_batch([pa.array([order], pa.int32()), pa.array(contexts[:1])], names=["order", "first"])


class Model:
    """The sorted arrays of each order, in shards by the first context of each; a task maps those that its texts need."""

    def __init__(self, folder: str, alphabet: Alphabet, firsts: dict[int, np.ndarray]) -> None:
        self.folder, self.alphabet, self.firsts = folder, alphabet, firsts
        self.shards: dict[str, dict[str, np.ndarray]] = {}

    def _shard(self, order: int, first: int) -> dict[str, np.ndarray]:
        name = f"order-{order}-{first}"
        if name not in self.shards:
            if len(self.shards) >= OPEN_SHARDS:  # where files cannot be mapped a shard is read whole
                self.shards.pop(next(iter(self.shards)))
            self.shards[name] = map_arrays(self.folder, name)[0]
        return self.shards[name]

    def shares(self, grams: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Probability of the last symbol of each n-gram after the others; unseen ones get what their context leaves of the order below."""
        k = self.alphabet.size
        if not order:
            return np.full(len(grams), 1 / k)
        context = grams // k
        share, left = np.full(len(grams), np.nan), np.ones(len(grams))
        at = np.searchsorted(self.firsts[order], context, "right") - 1
        for i in np.unique(at[at >= 0]):
            own = np.flatnonzero(at == i)
            shard = self._shard(order, int(self.firsts[order][i]))
            place, same = _found(shard["grams"], grams[own])
            share[own[same]] = shard["shares"][place[same]]
            own = own[~same]
            place, same = _found(shard["contexts"], context[own])
            left[own[same]] = shard["left"][place[same]]
        unseen = np.flatnonzero(np.isnan(share))
        if len(unseen):
            shorter, of = np.unique(grams[unseen] % k ** (order - 1), return_inverse=True)
            share[unseen] = left[unseen] * self.shares(shorter, order - 1)[of]
        return share

    def perplexity(self, texts: list[str]) -> np.ndarray:
        """NaN for an empty text."""
        grams, text = _codes(texts, self.alphabet)
        n = np.bincount(text, minlength=len(texts))
        distinct, of = np.unique(grams, return_inverse=True)
        return np.exp(np.bincount(text, -np.log(self.shares(distinct))[of], len(texts)) / np.where(n > 0, n, np.nan))


def _found(ordered: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.minimum(np.searchsorted(ordered, asked), len(ordered) - 1)
    return place, ordered[place] == asked


_models: dict[str, Model] = {}


def _perplexity(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    if model.folder not in _models:  # a worker keeps the shards of one model
        _models.clear()
    model = _models.setdefault(model.folder, model)
    for batch in pieces(batches, "text", TEXT_BYTES):
        found = model.perplexity(batch.column("text").fill_null("").to_pylist())
        yield pa.record_batch([*batch.columns[:3], pa.array(found, pa.float64(), mask=np.isnan(found))], names=[*batch.schema.names[:3], "perplexity"])


def train(texts: DataFrame, everything: DataFrame, folder: str) -> Model | None:
    """The model of all texts of the one column `text`, with the characters of `everything`; None where there is no character.

    The trusted texts come from a join, which moves them; so they are read once, and the characters are those of all texts, which stay in place.
    """
    texts, everything = texts.filter(F.length("text") > 0), everything.filter(F.length("text") > 0)
    counted = everything.mapInArrow(_count_symbols, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n"))
    # at most a row for each character there is
    alphabet = Alphabet(np.array([r.symbol for r in counted.orderBy(F.desc("n"), "symbol").collect()], np.int64))
    if not len(alphabet.characters):
        return None
    k = alphabet.size
    counts = staged(texts.mapInArrow(lambda b: _count_grams(b, alphabet), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "kn-counts")
    if counts.isEmpty():
        return None
    firsts = {}
    for order, level in enumerate(orders(counts, k), 1):
        shards = max(1, -(-level.count() // SHARD_GRAMS))
        context = F.expr(f"gram DIV {k}")
        dealt = level.select("gram", "share", "left").repartitionByRange(shards, context).sortWithinPartitions("gram")
        written = staged(dealt.mapInArrow(lambda b, order=order: _write_shares(b, folder, order, k), "order int, first long"), "kn-shares")
        firsts[order] = np.array(sorted(r["first"] for r in written.collect()), np.int64)
    return Model(folder, alphabet, firsts)


def judge(docs: DataFrame, trusted: DataFrame, low: float = LOW, high: float = HIGH, widen: float = WIDEN) -> DataFrame:
    """doc_id, lang, print of the text, perplexity, floor, ceiling and kept of each row of `docs`. `trusted`: one column of doc_id."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", column_or_null(docs, "lang", "string").alias("lang"), F.xxhash64(text).alias("print"), text.alias("text"))
    ids = trusted.select(F.col("doc_id").alias("trusted_id")).filter("trusted_id IS NOT NULL").distinct()
    # ids grow with the documents, so they are never broadcast; the folds of the model only
    learned = F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != 0)
    known = rows.filter(learned).select("doc_id", "text").hint("merge").join(ids, F.col("doc_id") == F.col("trusted_id"), "left_semi")
    model = train(known.select("text"), rows.select("text"), new_folder(spark, "kneser-ney"))
    if model is None:
        return rows.select("doc_id", "lang", "print", *[F.lit(None).cast("double").alias(c) for c in ("perplexity", "floor", "ceiling")], (F.coalesce(F.length("text"), F.lit(0)) > 0).alias("kept"))
    kind = dict(rows.dtypes)["doc_id"]
    scored = staged(rows.mapInArrow(lambda b: _perplexity(b, model), f"doc_id {kind}, lang string, print long, perplexity double"), "kn-perplexity")
    held = scored.filter((fold(F.col("doc_id"), FOLDS) == 0) & F.col("perplexity").isNotNull()).join(ids, F.col("doc_id") == F.col("trusted_id"), "left_semi")
    ends = lambda q: F.percentile_approx("perplexity", q, 10_000)
    margin = F.lit(widen) * (1 + FEW / F.sqrt(F.count(F.lit(1))))
    ranges = held.groupBy(F.col("lang").alias("of_lang")).agg((ends(low) / margin).alias("floor"), (ends(high) * margin).alias("ceiling"))
    whole = held.agg(F.count(F.lit(1)).alias("n"), ends(low).alias("low"), ends(high).alias("high"), F.lit(widen).alias("w")).filter("n > 0")
    whole = whole.select(F.col("low") / (F.col("w") * (1 + FEW / F.sqrt("n"))), F.col("high") * F.col("w") * (1 + FEW / F.sqrt("n"))).first() or (None, None)
    floor, ceiling = F.coalesce("floor", F.lit(whole[0]).cast("double"), F.lit(0.0)), F.coalesce("ceiling", F.lit(whole[1]).cast("double"), F.lit(float("inf")))
    return (
        scored.join(ranges, F.col("lang").eqNullSafe(F.col("of_lang")), "left").withColumn("floor", floor).withColumn("ceiling", ceiling)
        .withColumn("kept", F.coalesce(F.col("perplexity").between(F.col("floor"), F.col("ceiling")), F.lit(False)))
        .select("doc_id", "lang", "print", "perplexity", "floor", "ceiling", "kept")
    )


def good_documents(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns. The verdict goes by id, language and text, so equal rows stay or go together."""
    found = staged(judge(docs, trusted), "kn-judged").filter("kept").select(F.col("doc_id").alias("of_doc"), F.col("lang").alias("of_lang"), F.col("print").alias("of_print")).distinct()
    rows = docs.select(whole_row(docs), "doc_id", column_or_null(docs, "lang", "string").alias("lang"), F.xxhash64(F.col("text").cast("string")).alias("print"))
    same = (F.col("print") == F.col("of_print")) & F.col("doc_id").eqNullSafe(F.col("of_doc")) & F.col("lang").eqNullSafe(F.col("of_lang"))
    return rows.join(found, same, "left_semi").select("whole.*")


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.filter((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select("doc_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), trusted_ids(table(spark, sf_dir, "labels"))).drop("print")


QUERIES = {"op7_quality": op7_quality}
ORACLES: dict[str, str] = {}
