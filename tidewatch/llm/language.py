"""Language identification by string kernels.

Two texts are as alike as the distinct n-grams of 1 to 3 characters they share (a blended-spectrum presence kernel), divided by the root
of the product of their own counts. Nyström landmarks turn the kernel into features, and one-versus-rest kernel ridge regression with
targets -1 and 1 gives a margin for each language. As margins are linear in the presence of the landmarks' n-grams, landmarks and weights
are multiplied into one matrix after fitting: a batch of texts is scored by one product of its presence matrix with it.

The landmarks are the first LANDMARKS labelled texts a language by a hash of doc_id (the method's bound: they span the features). All else is
learnt from every labelled text: the regression from sums of the texts' kernel rows and of their products, how many texts of a language have an
n-gram, and the floors. Tasks add these up; their size goes by the landmarks, not by the texts. Characters are lower-cased, white space and digits
are each one symbol; all other code points are themselves, so an n-gram is one exact number and no script shares symbols with another.

Margins add up to the same number for every text, so they only compare languages. Whether a text is in the found language at all is told by
its 3-grams: the mean, over all occurrences, of the logarithm of the share of the language's labelled texts that have the 3-gram (of the landmarks'
3-grams; others are in none). Shares are smoothed as if there were as many texts as landmarks. A text fits where that mean reaches the language's
floor, a low quantile of all its labelled texts (each without itself) cut to about the same length, lower by FEW / n of its distance to the median
for n texts. A language with one labelled text has no floor.

Defined results: null texts and texts without a letter are `und` with score 0; with no labelled row every text is `und`; ties go to the
first language by code point; equal texts get equal results; no documents, no rows; other columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from tidewatch.llm.inputs import column_or_null, fold, staged, table, whole_row
from tidewatch.llm.text import pieces

UNKNOWN = "und"
FOLDS = 5
LANDMARKS = 64
RIDGE = 1e-3
#: Quantile of labelled texts at which a language's floor lies, and how much lower it is for few texts.
FLOOR = 0.005
FEW = 10
#: Lengths, in characters, to which labelled texts are cut for the floor of texts from each length on.
LENGTHS = 4 ** np.arange(10)
#: A code point and one more is under 2^21, so three of them are one number.
BITS = 21
#: Texts whose kernel rows are multiplied at a time, and numbers of a row of sums.
ROWS, WIDTH = 512, 4096
#: Accuracy of Spark's quantiles: one over the error in rank, as a share.
RANKS = 100_000
#: Characters of a text whose n-grams are sorted at a time.
STRETCH = 1 << 20

_PLAIN = np.arange(1 << 17, dtype=np.int64)
_PLAIN[[c for c in range(1 << 17) if not 0xD800 <= c < 0xE000 and chr(c).isspace()]] = 0x20
_PLAIN[[c for c in range(1 << 17) if not 0xD800 <= c < 0xE000 and chr(c).isdigit()]] = 0x30


def _symbols(text: str) -> np.ndarray:
    """Code points of the lower-cased text, each one more; white space is 0x20, a digit 0x30 (none are beyond the second plane)."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where(points < len(_PLAIN), _PLAIN[np.minimum(points, len(_PLAIN) - 1)], points) + 1


def _distinct(grams: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        grams = np.sort(grams)
    else:
        order = np.argsort(grams, kind="stable")
        grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
    return grams[first], np.diff(np.append(first, len(grams))) if counts is None else np.add.reduceat(counts, first)


def _grams(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of 1 to 3 symbols in rising order, and how often each occurs."""
    found = []
    for a in range(0, len(symbols), STRETCH):
        part = symbols[max(0, a - 2) : a + STRETCH]
        lead = min(a, 2)  # symbols of the stretch before
        two = (part[:-1] << BITS) | part[1:]
        three = (two[:-1] << BITS) | part[2:]
        found.append(_distinct(np.concatenate([part[lead:], two[max(0, lead - 1) :], three])))
    if len(found) == 1:
        return found[0]
    return _distinct(np.concatenate([g for g, _ in found]), np.concatenate([n for _, n in found])) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _places(grams: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the numbers of `own` are in `grams`, and which of them are."""
    if not len(grams):
        return np.zeros(0, np.int64), np.zeros(len(own), bool)
    place = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
    same = grams[place] == own
    return place[same], same


class Landmarks:
    """Their distinct n-grams in rising order, and of each n-gram the landmarks that have it."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.norm = np.sqrt([len(x) for x in sets])
        mark, all_ = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
        order = np.argsort(all_, kind="stable")
        self.grams, counts = np.unique(all_, return_counts=True)
        self.marks, self.starts = mark[order].astype(np.int32), np.concatenate([[0], np.cumsum(counts)])

    def kernel(self, place: np.ndarray, own: int) -> np.ndarray:
        """A text's kernel with each landmark, from the places of its n-grams among theirs and the number of its own n-grams."""
        many = self.starts[place + 1] - self.starts[place]
        at = np.repeat(self.starts[place] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        return np.bincount(self.marks[at], minlength=len(self.norm)) / (np.sqrt(own) * self.norm)


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams = [_grams(_symbols(text))[0].tobytes() for text in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("lang"), pa.array(grams, pa.binary())], names=["lang", "grams"])


def _sums(batches: Iterator[pa.RecordBatch], marks: Landmarks, texts: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """Of a task's texts, languages weighing alike: sums of products of kernel rows, of kernel rows by language, and of n-grams by language."""
    at, m = {lang: i for i, lang in enumerate(texts)}, len(marks.norm)
    product, rows, having = np.zeros((m, m)), np.zeros((len(texts), m)), np.zeros((len(texts), len(marks.grams)))
    held: list[np.ndarray] = []
    for batch in pieces(batches, "text"):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own = _grams(_symbols(text))[0]
            place = _places(marks.grams, own)[0]
            kernel = marks.kernel(place, len(own))
            having[at[lang], place] += 1
            rows[at[lang]] += kernel / texts[lang]
            held.append(kernel / np.sqrt(texts[lang]))
            if len(held) == ROWS:
                product += np.array(held).T @ np.array(held)
                held = []
    if held:
        product += np.array(held).T @ np.array(held)
    whole = np.concatenate([product.ravel(), rows.ravel(), having.ravel()])
    for a in range(0, len(whole), WIDTH):
        if whole[a : a + WIDTH].any():
            yield pa.record_batch([pa.array([a]), pa.array([whole[a : a + WIDTH].tobytes()], pa.binary())], names=["at", "numbers"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, numbers in zip(batch.column("at").to_pylist(), batch.column("numbers").to_pylist(), strict=True):
            total[at] = total[at] + np.frombuffer(numbers) if at in total else np.frombuffer(numbers)
    yield pa.record_batch([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["at", "numbers"])


def _usual(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """How usual each labelled text, cut to each length that it reaches, is for its own language."""
    for batch in pieces(batches, "text"):
        langs, steps, values = [], [], []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            symbols, at = _symbols(text), model.languages.index(lang)
            for step in np.flatnonzero(LENGTHS <= len(symbols)):
                langs.append(lang)
                steps.append(int(step))
                values.append(model.usual(*_grams(symbols[: LENGTHS[step]]), at, True))
        yield pa.record_batch([pa.array(langs, pa.string()), pa.array(steps, pa.int32()), pa.array(values, pa.float64())], names=["lang", "step", "usual"])


class Model:
    """Languages, the n-grams of the landmarks, their weight for each language, each language's constant, in how many of each language's
    labelled texts an n-gram is, how many texts and landmarks those have, and the floors (a row a language, a column a length)."""

    def __init__(self, languages: list[str], grams: np.ndarray, weights: np.ndarray, constant: np.ndarray, having: np.ndarray, texts: np.ndarray, marks: np.ndarray) -> None:
        self.languages, self.grams, self.weights, self.constant, self.having, self.texts, self.marks = languages, grams, weights, constant, having, texts, marks
        self.floors = np.full((len(languages), len(LENGTHS)), -np.inf)

    def usual(self, own: np.ndarray, counts: np.ndarray, language: int, itself: bool = False) -> float:
        """Mean logarithm of the share of the language's labelled texts that have each 3-gram; `itself`: without the text, which is one of them."""
        longest = np.searchsorted(own, 1 << 2 * BITS)  # where n-grams of three begin; a shorter text has none
        if longest < len(own):
            own, counts = own[longest:], counts[longest:]
        place, same = _places(self.grams, own)
        having = np.zeros(len(own))
        having[same] = self.having[place, language]
        marks = self.marks[language]
        shares = (marks * np.maximum(having - itself, 0) / max(1, self.texts[language] - itself) + 0.5) / (marks + 1)
        return float(counts @ np.log(shares) / counts.sum())

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the text fits the language."""
        langs, scores, fits = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        if not self.languages:
            return langs, scores, fits
        for i, text in enumerate(texts):
            if not text or not any(map(str.isalpha, text)):
                continue
            symbols = _symbols(text)
            own, counts = _grams(symbols)
            margins = self.weights[_places(self.grams, own)[0]].sum(0) / np.sqrt(len(own)) + self.constant
            best = int(margins.argmax())
            langs[i], scores[i] = self.languages[best], min(1.0, max(0.0, (1 + float(margins[best])) / 2))
            fits[i] = self.usual(own, counts, best) >= self.floors[best, np.searchsorted(LENGTHS, len(symbols), "right") - 1]
        return langs, scores, fits


def _floors(found: list, languages: list[str], texts: np.ndarray) -> np.ndarray:
    """Texts get less spread with length, so a length that few of a language's texts reach has the floor of the length before."""
    floors = np.full((len(languages), len(LENGTHS)), -np.inf)
    values = {(r.lang, r.step): r for r in found}
    for i, lang in enumerate(languages):
        if texts[i] < 2:
            continue
        for step in range(len(LENGTHS)):
            own = values.get((lang, step))
            if step and (own is None or own.n < values[lang, 0].n / 2):
                floors[i, step] = floors[i, step - 1]
                continue
            floors[i, step] = own.low - (own.mid - own.low) * FEW / own.n
    return floors


def fit(labelled: DataFrame, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Learns from doc_id, text and lang of all rows that have a language and a letter."""
    usable = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang").filter(F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("doc_id"))
    # first the hashes alone find the cut of each language, so no whole language is sorted with its texts
    cells = staged(usable.groupBy("lang", F.shiftrightunsigned("h", 44).alias("cell")).agg(F.count(F.lit(1)).alias("n")), "language-cells")
    running = F.sum("n").over(Window.partitionBy("lang").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    cut = cells.withColumn("before", F.coalesce(running, F.lit(0))).groupBy("lang").agg(F.max(F.when(F.col("before") < landmarks, F.col("cell"))).alias("last"), F.sum("n").alias("n"))
    # a row a language, as the model has anyway; so texts are picked where they are
    found = cut.orderBy("lang").collect()
    if not found:
        return _nothing()
    texts = {r.lang: r.n for r in sorted(found, key=lambda r: r.lang)}
    few = usable.filter(F.shiftrightunsigned("h", 44) <= F.element_at(F.create_map(*[x for r in found for x in (F.lit(r.lang), F.lit(r["last"]))]), F.col("lang")))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text"))
    picked = staged(few.withColumn("turn", turn).filter(F.col("turn") <= landmarks).select("lang", "turn", "text").orderBy("turn", "lang"), "language-landmarks")
    rows = picked.orderBy("turn", "lang").select("lang", "text").mapInArrow(_presence, "lang string, grams binary").collect()
    languages, count = list(texts), np.array(list(texts.values()))
    sets = [np.frombuffer(r.grams, np.int64) for r in rows]
    marks, m = Landmarks(sets), len(sets)
    parts = usable.select("lang", "text").mapInArrow(lambda b: _sums(b, marks, texts), "at long, numbers binary")
    whole = np.zeros(m * m + len(languages) * (m + len(marks.grams)))
    for r in parts.repartition("at").mapInArrow(_added, "at long, numbers binary").collect():
        numbers = np.frombuffer(r.numbers)
        whole[r["at"] : r["at"] + len(numbers)] = numbers
    product, sums, having = np.split(whole, [m * m, m * m + len(languages) * m])
    product, sums, having = product.reshape(m, m), sums.reshape(len(languages), m), having.reshape(len(languages), -1).T
    places = [np.searchsorted(marks.grams, x) for x in sets]
    values, vectors = np.linalg.eigh(np.array([marks.kernel(p, len(x)) for p, x in zip(places, sets, strict=True)]))
    root = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
    # features are the kernel row times root, and 1; languages weigh alike, whatever their share of the texts
    gram = np.block([[root.T @ product @ root, (sums.sum(0) @ root)[:, None]], [(sums.sum(0) @ root)[None, :], np.full((1, 1), len(languages))]])
    penalty = ridge * np.eye(len(gram))
    penalty[-1, -1] = 0
    target = np.where(np.eye(len(languages)) > 0, 1.0, -1.0)
    solved = np.linalg.solve(gram + penalty, np.column_stack([sums @ root, np.ones(len(languages))]).T @ target)
    each = root @ solved[:-1] / marks.norm[:, None]
    weights = np.zeros((len(marks.grams), len(languages)))
    for i, place in enumerate(places):
        weights[place] += each[i]
    model = Model(languages, marks.grams, weights.astype(np.float32), solved[-1], having, count, np.array([sum(r.lang == x for r in rows) for x in languages]))
    usual = usable.select("lang", "text").mapInArrow(lambda b: _usual(b, model), "lang string, step int, usual double")
    ends = [F.percentile_approx("usual", q, RANKS).alias(n) for q, n in ((FLOOR, "low"), (0.5, "mid"))]
    model.floors = _floors(usual.groupBy("lang", "step").agg(F.count(F.lit(1)).alias("n"), *ends).collect(), languages, count)
    return model


def _nothing() -> Model:
    none = np.zeros((0, 0))
    return Model([], np.zeros(0, np.int64), none, np.zeros(0), none, np.zeros(0), np.zeros(0))


def _predict(batches: Iterator[pa.RecordBatch], model: Model, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        langs, scores, fits = model.predict(batch.column("text").to_pylist())
        yield pa.record_batch([*batch.columns, pa.array(langs, pa.string()), pa.array(scores), pa.array(fits)], names=names)


def predict(rows: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred, score and fits to rows with a text; columns that have these names are replaced."""
    rows = rows.drop("lang_pred", "score", "fits").withColumn("text", F.col("text").cast("string"))
    schema = StructType([*rows.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("fits", BooleanType())])
    return rows.mapInArrow(lambda b: _predict(b, model, schema.names), schema)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(fold(F.col("doc_id"), FOLDS) != 0))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame) -> DataFrame:
    """The documents whose text is in one of the learned languages, with their own columns."""
    model = fit(docs.select("doc_id", "text", column_or_null(docs, "lang", "string").alias("lang")))
    found = predict(docs.select(whole_row(docs), "text"), model)
    return found.filter("fits").select("whole.*")


QUERIES = {"op2_language": op2_language}
ORACLES: dict[str, str] = {}
