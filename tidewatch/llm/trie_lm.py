"""Language-model scores from an Elias-Fano n-gram trie.

Words (of the training texts, and one end of text, which also stands before a text's first word) have numbers by the order of their
fingerprints. The trie is dealt into shards by the first two words of an n-gram, so no frequent first word fills a shard alone. A level is an
Elias-Fano sequence of (place of the parent in the level above) x (number of words) + word, which rises; a word is looked for among its
context's successors by successor search for that number. Pointers to a context's first successor rise too and are coded alike. Beside
each entry is its smoothed probability, and for a context what it leaves to shorter ones, each as one of 256 steps of the logarithm.

Shards are as many as the training texts need, so that one fits a task; neighbouring ones lie in one file, as pieces of its sequences, and files are
`FILES` at most. A batch of texts asks each file once, for all of its shards, so scoring does not cost batches times shards. Files are mapped,
so a task holds the pages that it touches.

A probability is interpolated: P(w | uv) = a3(uvw) + b(uv) (a2(vw) + b(v) P(w)), with a(cw) = n(cw) / (n(c) + mu), b(c) = mu / (n(c) + mu)
and P(w) the base's add-0.1 share. As nothing but n(c) of the context is needed, each shard is smoothed by itself.

Counts are gathered from all training texts: tasks count n-grams of a stretch of texts, and send each shard what it needs of them, sorted and
compressed; a shard adds these up.

Defined results: a null or empty text is its end alone; with no training text every word is unknown and scores are those of one unknown word
for all; equal rows give equal rows; no documents, no rows; other columns are passed by.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.elias_fano import EliasFano, Growing, get, map_arrays
from tidewatch.llm.inputs import filesystem, fold, new_folder, staged, table
from tidewatch.llm.text import LOWER, fingerprints, groups, mix64, pieces, spans, utf8

FOLDS = 10
ADDED = 0.1
#: Weight of the shorter context against the counts of a context of one and of two words.
MU = (20.0, 5.0)
#: Words of training text for each shard of the n-grams, and of the words.
SHARD_WORDS = 1_000_000
#: Tokens that a task counts before it sends them on.
STRETCH_TOKENS = 1_500_000
#: Files that the shards lie in. Each is written by one task and asked once a batch.
FILES = 64
#: Bytes of files that a task holds where files can't be mapped.
HELD_BYTES = 256 << 20
SCORE_BYTES = 8 << 20
END = np.uint64(0x243F6A8885A308D3)
U = np.uint64


def _send(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, plane by plane (all lowest bytes first), compressed together."""
    head = struct.pack("<q", len(arrays)) + b"".join(struct.pack("<3sq", x.dtype.str.encode(), len(x)) for x in arrays)
    planes = [np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T).ravel() for x in arrays]
    return head + zstandard.ZstdCompressor(level=1).compress(np.concatenate(planes).tobytes())


def _receive(blob: bytes) -> list[np.ndarray]:
    each = struct.calcsize("<3sq")
    n_arrays = struct.unpack_from("<q", blob)[0]
    kinds = [struct.unpack_from("<3sq", blob, 8 + i * each) for i in range(n_arrays)]
    sizes = [n * np.dtype(kind.decode()).itemsize for kind, n in kinds]
    packed = memoryview(blob)[8 + n_arrays * each :]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed, max_output_size=max(1, sum(sizes))), np.uint8)
    ends = np.cumsum(sizes)
    return [
        np.ascontiguousarray(planes[end - size : end].reshape(np.dtype(kind.decode()).itemsize, n).T).view(kind.decode()).ravel()
        for (kind, n), size, end in zip(kinds, sizes, ends, strict=True)
    ]


def _added_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, their counts, and the place of each given key."""
    distinct, inverse = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(inverse, counts, len(distinct)).astype(np.int64), inverse


def _tight(counts: np.ndarray) -> np.ndarray:
    for kind in ("<u1", "<u2", "<u4"):
        if not len(counts) or counts.max() <= np.iinfo(kind).max:
            return counts.astype(kind)
    return counts.astype("<u8")


def _range_of(prints: np.ndarray, n: int) -> np.ndarray:
    """Shard of a fingerprint; shards are ranges."""
    return ((prints >> U(32)) * U(n) >> U(32)).astype(np.int64)


def _files(n_shards: int, limit: int) -> np.ndarray:
    """The file of each shard: as many files as shards, up to the limit; each has a range of shards."""
    return np.arange(n_shards) * min(n_shards, limit) // n_shards


def _piece_of(shards: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each asked shard among those of a file, and whether the file has it."""
    piece = np.minimum(np.searchsorted(shards, asked), len(shards) - 1)
    return piece, shards[piece] == asked


def _by_file(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, int, list[list[np.ndarray]]]]:
    """Of rows sorted by file and shard: file, whether it begins, shard, and what was sent to the shard."""
    last = None
    for shard in groups(batches, ["file", "shard"]):
        file = shard.column("file")[0].as_py()
        yield file, file != last, shard.column("shard")[0].as_py(), [_receive(b) for b in shard.column("blob").to_pylist()]
        last = file


def _words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words of all texts, and the words before each text."""
    buf, offsets = utf8(texts)
    starts, ends, bounds = spans(buf, offsets)
    return fingerprints(buf, starts, ends, LOWER), bounds


def _count_words(batches: Iterator[pa.RecordBatch], n_shards: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def total() -> tuple[np.ndarray, np.ndarray]:
        return _added_up(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))[:2]

    def sent() -> Iterator[pa.RecordBatch]:
        keys, counts = total()
        cuts = np.searchsorted(_range_of(keys, n_shards), np.arange(n_shards + 1))
        own = [i for i in range(n_shards) if cuts[i] < cuts[i + 1]]
        blobs = [_send(keys[cuts[i] : cuts[i + 1]], _tight(counts[cuts[i] : cuts[i + 1]])) for i in own]
        yield pa.record_batch([pa.array(own, pa.int64()), pa.array(blobs, pa.binary())], names=["shard", "blob"])

    for batch in pieces(batches, "text"):
        words, bounds = _words_of(batch.column("text"))
        keys, counts = np.unique(words, return_counts=True)
        held.append((np.append(keys, END), np.append(counts, len(bounds) - 1)))
        if sum(len(k) for k, _ in held) > STRETCH_TOKENS:
            held = [total()]
            if len(held[0][0]) > STRETCH_TOKENS // 2:
                yield from sent()
                held = []
    if held:
        yield from sent()


def _write_words(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    file: tuple[int, Growing, list[int], list[int]] | None = None

    def done() -> pa.RecordBatch:
        number, growing, shards, tokens = file
        growing.write(folder, f"words-{number}", {"shards": shards})
        n_words = sum(growing.sequences["prints"]["n"])
        return pa.record_batch([pa.array([number]), pa.array([n_words]), pa.array([sum(tokens)])], names=["file", "n_words", "n_tokens"])

    for number, begins, shard, received in _by_file(batches):
        if begins:
            if file:
                yield done()
            file = number, Growing(), [], []
        keys, counts, _ = _added_up(np.concatenate([r[0] for r in received]), np.concatenate([r[1].astype(np.int64) for r in received]))
        file[1].array("counts", counts)
        file[1].sequence("prints", keys)
        file[2].append(shard)
        file[3].append(int(counts.sum()))
    if file:
        yield done()


class Words:
    """The level of single words: numbers and counts."""

    def __init__(self, folder: str, sizes: list[int], n_tokens: int, file_of: np.ndarray) -> None:
        self.folder, self.n_tokens, self.file_of = folder, n_tokens, file_of
        self.bases = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.n_words, self.n_files = int(self.bases[-1]), len(sizes)
        self.open: dict[int, tuple[EliasFano, np.ndarray, np.ndarray]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"open": {}}

    def _file(self, i: int) -> tuple[EliasFano, np.ndarray, np.ndarray]:
        if i not in self.open:
            arrays, notes = map_arrays(self.folder, f"words-{i}")
            self.open[i] = get(arrays, notes, "prints"), arrays["counts"], np.array(notes["shards"])
        return self.open[i]

    def look_up(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1 where unknown) and count of each word, in order of fingerprint."""
        ids, counts = np.full(len(prints), -1, np.int64), np.zeros(len(prints), np.int64)
        shard = _range_of(prints, len(self.file_of))
        cuts = np.searchsorted(self.file_of[shard], np.arange(self.n_files + 1))
        for i in range(self.n_files):
            own = slice(cuts[i], cuts[i + 1])
            if cuts[i] < cuts[i + 1] and self.bases[i] < self.bases[i + 1]:
                sequence, all_counts, shards = self._file(i)
                piece, there = _piece_of(shards, shard[own])
                place, same = sequence.successor(prints[own], piece)
                same &= there
                ids[own] = np.where(same, place + self.bases[i], -1)
                counts[own][same] = all_counts[place[same]]
        return ids, counts

    def counts_of(self, ids: np.ndarray) -> np.ndarray:
        """Counts of words by number, in rising order."""
        counts = np.zeros(len(ids), np.int64)
        cuts = np.searchsorted(ids, self.bases)
        for i in range(self.n_files):
            if cuts[i] < cuts[i + 1]:
                counts[cuts[i] : cuts[i + 1]] = self._file(i)[1][ids[cuts[i] : cuts[i + 1]] - self.bases[i]]
        return counts

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers and counts of the tokens of all texts, each with an end before it and an end after it, and where each text begins."""
        prints, bounds = _words_of(texts)
        distinct, inverse = np.unique(np.append(prints, END), return_inverse=True)
        ids, counts = self.look_up(distinct)
        n = len(bounds) - 1
        begins = bounds + 2 * np.arange(n + 1)
        of = np.full(len(prints) + 2 * n, inverse[-1])
        if len(prints):
            of[np.arange(len(prints)) + 2 * np.repeat(np.arange(n), np.diff(bounds)) + 1] = inverse[:-1]
        return ids[of], counts[of], begins


def _shard_of(pair: np.ndarray, n: int) -> np.ndarray:
    return _range_of(mix64(pair), n)


def _count_grams(batches: Iterator[pa.RecordBatch], words: Words, n_shards: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def sent() -> Iterator[pa.RecordBatch]:
        pair, third = np.concatenate([p for p, _ in held]), np.concatenate([t for _, t in held])
        distinct, inverse, counts = np.unique(pair, return_inverse=True, return_counts=True)
        shard = _shard_of(distinct, n_shards)
        by = np.argsort(shard, kind="stable")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        has = third >= 0
        triples, triple_counts = np.unique((place[inverse[has]].astype(np.uint64) << U(32)) | third[has].astype(np.uint64), return_counts=True)
        distinct, counts = distinct[by], counts[by]
        children = np.bincount((triples >> U(32)).astype(np.int64), minlength=len(distinct))
        cuts = np.searchsorted(shard[by], np.arange(n_shards + 1))
        ends = np.searchsorted(triples, cuts.astype(np.uint64) << U(32))
        rows = []
        for i in range(n_shards):
            p, t = slice(cuts[i], cuts[i + 1]), slice(ends[i], ends[i + 1])
            if cuts[i] < cuts[i + 1]:
                rows.append((i, _send((distinct[p] >> U(32)).astype("<u4"), distinct[p].astype("<u4"), _tight(counts[p]), _tight(children[p]), triples[t].astype("<u4"), _tight(triple_counts[t]))))
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "blob"])

    for batch in pieces(batches, "text"):
        ids, _, begins = words.tokens(batch.column("text"))
        first = np.ones(len(ids), bool)  # tokens that begin a pair: all but a text's last
        first[begins[1:] - 1] = False
        first = np.flatnonzero(first)
        third = np.full(len(ids), -1, np.int64)
        third[:-2] = ids[2:]
        third[np.maximum(begins[1:] - 2, 0)] = -1
        held.append(((ids[first].astype(np.uint64) << U(32)) | ids[first + 1].astype(np.uint64), third[first]))
        if sum(len(p) for p, _ in held) > STRETCH_TOKENS:
            yield from sent()
            held = []
    if held:
        yield from sent()


def _steps(x: np.ndarray) -> tuple[np.ndarray, list[float]]:
    """Logarithms of shares over 256 even steps, and these steps."""
    logs = np.log10(x) if len(x) else np.zeros(0)
    low, high = (float(logs.min()), float(logs.max())) if len(x) else (0.0, 0.0)
    width = (high - low) / 255 or 1.0
    return np.round((logs - low) / width).astype(np.uint8), [low, width]


def _write_grams(batches: Iterator[pa.RecordBatch], folder: str, words: Words, mu: tuple[float, float]) -> Iterator[pa.RecordBatch]:
    file: tuple[int, Growing, list[int], dict[str, list[list[float]]]] | None = None

    def done() -> pa.RecordBatch:
        number, growing, shards, steps = file
        growing.write(folder, f"grams-{number}", {"shards": shards, "mu": mu, "steps": steps})
        sizes = [sum(growing.sequences[k]["n"]) for k in ("pairs", "triples")]
        return pa.record_batch([pa.array([x]) for x in (number, *sizes)], names=["file", "n_pairs", "n_triples"])

    for number, begins, shard, received in _by_file(batches):
        if begins:
            if file:
                yield done()
            file = number, Growing(), [], {k: [] for k in ("share2", "left2", "share3")}
        file[2].append(shard)
        _add_shard(file[1], file[3], received, words, mu)
        del received
    if file:
        yield done()


def _add_shard(file: Growing, steps: dict[str, list[list[float]]], received: list[list[np.ndarray]], words: Words, mu: tuple[float, float]) -> None:
    """The pairs and triples of a shard, added up and smoothed, as the next pieces of a file."""
    given = np.concatenate([(r[0].astype(np.uint64) << U(32)) | r[1] for r in received])
    pairs, counts, place = _added_up(given, np.concatenate([r[2].astype(np.int64) for r in received]))
    children = np.concatenate([r[3].astype(np.int64) for r in received])
    third = np.concatenate([r[4] for r in received]).astype(np.uint64)
    triples, triple_counts, _ = _added_up((np.repeat(place, children).astype(np.uint64) << U(32)) | third, np.concatenate([r[5].astype(np.int64) for r in received]))
    received.clear()
    del given, third, place, children
    parent, word = (pairs >> U(32)).astype(np.int64), pairs & U(0xFFFFFFFF)
    context, first, of_context = np.unique(parent, return_index=True, return_inverse=True)
    n_words = U(words.n_words)

    def share(name: str, x: np.ndarray) -> None:
        codes, own = _steps(x)
        file.array(name, codes)
        steps[name].append(own)

    file.sequence("contexts", context)
    file.sequence("pointers2", first)
    file.sequence("pairs", of_context.astype(np.uint64) * n_words + word)
    share("share2", counts / (words.counts_of(context)[of_context] + mu[0]))
    of_pair = (triples >> U(32)).astype(np.int64)
    followed = np.bincount(of_pair, triple_counts, len(pairs))
    share("left2", mu[1] / (followed + mu[1]))
    file.sequence("pointers3", np.searchsorted(of_pair, np.arange(len(pairs))))
    file.sequence("triples", of_pair.astype(np.uint64) * n_words + (triples & U(0xFFFFFFFF)))
    share("share3", triple_counts / (followed[of_pair] + mu[1]))


class GramFile:
    """The levels of pairs and triples of the shards of a file. Places count through all of them; a number in a level has the parent's place in
    its own shard."""

    def __init__(self, folder: str, number: int) -> None:
        self.arrays, self.notes = map_arrays(folder, f"grams-{number}")
        self.contexts, self.pointers2, self.pairs, self.pointers3, self.triples = (get(self.arrays, self.notes, k) for k in ("contexts", "pointers2", "pairs", "pointers3", "triples"))
        self.shards = np.array(self.notes["shards"])
        steps = {k: np.array(x)[:, :, None] for k, x in self.notes["steps"].items()}
        self.values = {k: 10 ** (x[:, 0] + x[:, 1] * np.arange(256)) for k, x in steps.items()}

    def value(self, kind: str, place: np.ndarray, piece: np.ndarray) -> np.ndarray:
        return self.values[kind][piece, self.arrays[kind][place]]

    def pair(self, first: np.ndarray, second: np.ndarray, piece: np.ndarray, n_words: int) -> np.ndarray:
        """Place of each pair, -1 where unknown."""
        context, known = self.contexts.successor(first.astype(np.uint64), piece)
        context = np.where(known, context - self.contexts.starts[piece], 0)
        place, same = self.pairs.successor(context.astype(np.uint64) * U(n_words) + second.astype(np.uint64), piece)
        return np.where(known & same, place, -1)

    def triple(self, pair: np.ndarray, third: np.ndarray, piece: np.ndarray, n_words: int) -> np.ndarray:
        parent = pair - self.pairs.starts[piece]
        place, same = self.triples.successor(parent.astype(np.uint64) * U(n_words) + third.astype(np.uint64), piece)
        return np.where(same, place, -1)

    def successors(self, pair: int, n_words: int) -> np.ndarray:
        """Words that follow a pair, between its pointer and the next."""
        piece = int(self.pairs.piece_of(np.array([pair]))[0])
        last = pair + 1 == self.pairs.starts[piece + 1]
        a = int(self.pointers3.access(np.array([pair]))[0])
        b = int(self.triples.sizes[piece]) if last else int(self.pointers3.access(np.array([pair + 1]))[0])
        found = self.triples.access(np.arange(a, b) + self.triples.starts[piece])
        return found - U(pair - int(self.pairs.starts[piece])) * U(n_words)


class Trie:
    """What a scoring task needs: the words, and the files of n-grams, opened when asked for."""

    def __init__(self, folder: str, words: Words, file_of: np.ndarray, mu: tuple[float, float], have: set[int]) -> None:
        self.folder, self.words, self.file_of, self.mu, self.have = folder, words, file_of, mu, have
        self.open: dict[int, GramFile] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"open": {}}

    def file(self, i: int) -> GramFile:
        if i not in self.open:
            mapped = filesystem(self.folder)[0].type_name == "local"
            if not mapped and sum(x.nbytes for f in self.open.values() for x in f.arrays.values()) > HELD_BYTES:
                self.open.clear()
            self.open[i] = GramFile(self.folder, i)
        return self.open[i]

    def score(self, texts: pa.Array) -> dict[str, np.ndarray]:
        ids, counts, begins = self.words.tokens(texts)
        n_words = self.words.n_words
        base = (counts + ADDED) / (self.words.n_tokens + ADDED * (n_words + 1))
        real = np.ones(len(ids), bool)
        real[begins[:-1]] = False
        at = np.flatnonzero(real)  # tokens to be scored; the one before each is its context
        starts = np.zeros(len(ids), bool)
        starts[begins[:-1] + 1] = True
        share2, left2, share3 = np.zeros(len(ids)), np.ones(len(ids)), np.zeros(len(ids))
        pair = (ids[at - 1].astype(np.uint64) << U(32)) | (ids[at].astype(np.uint64) & U(0xFFFFFFFF))
        known = np.flatnonzero((ids[at - 1] >= 0) & (ids[at] >= 0))
        shard = _shard_of(pair[known], len(self.file_of))
        by = np.lexsort((pair[known], shard))
        order, shard = known[by], shard[by]
        new = np.ones(len(by), bool)  # equal pairs are looked up once
        new[1:] = np.diff(pair[order]) != 0
        cuts = np.searchsorted(self.file_of[shard], np.arange(self.file_of[-1] + 2))
        for i in range(len(cuts) - 1):
            if cuts[i] == cuts[i + 1] or i not in self.have:
                continue
            own = at[order[cuts[i] : cuts[i + 1]]]
            grams = self.file(i)
            first = new[cuts[i] : cuts[i + 1]]
            one = own[first]
            piece, there = _piece_of(grams.shards, shard[cuts[i] : cuts[i + 1]][first])
            place = np.where(there, grams.pair(ids[one - 1], ids[one], piece, n_words), -1)
            of = np.cumsum(first) - 1
            piece, place = piece[of], place[of]
            own, piece, place = own[place >= 0], piece[place >= 0], place[place >= 0]
            share2[own] = grams.value("share2", place, piece)
            # the pair is the context of the token after it
            after = (own + 1 < len(ids)) & real[np.minimum(own + 1, len(ids) - 1)]
            next_, piece, place = own[after] + 1, piece[after], place[after]
            left2[next_] = grams.value("left2", place, piece)
            some = ids[next_] >= 0
            next_, piece, place = next_[some], piece[some], place[some]
            triple = grams.triple(place, ids[next_], piece, n_words)
            share3[next_[triple >= 0]] = grams.value("share3", triple[triple >= 0], piece[triple >= 0])
        left1 = self.mu[0] / (counts[at - 1] + self.mu[0])
        share = share3[at] + left2[at] * (share2[at] + left1 * base[at])
        doc = np.repeat(np.arange(len(begins) - 1), np.diff(begins) - 1)
        n = len(begins) - 1
        total = lambda x: np.bincount(doc, x, n)
        return {"n_tokens": np.diff(begins) - 1, "n_known": total(counts[at] > 0).astype(np.int64), "base_score": total(np.log10(base[at])), "score": total(np.log10(share))}


def _score(batches: Iterator[pa.RecordBatch], trie: Trie) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", SCORE_BYTES):
        found = trie.score(batch.column("text"))
        yield pa.record_batch([batch.column("doc_id"), *(pa.array(x) for x in found.values())], names=["doc_id", *found])


def train(docs: DataFrame, folder: str, mu: tuple[float, float] = MU, shard_words: int = SHARD_WORDS, files: int = FILES) -> Trie:
    """Writes the trie of all texts of `docs` to the folder. The driver sees one row of three numbers a file."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_shards = max(1, -(-size // (6 * shard_words)))  # about six bytes a word
    file_of = _files(n_shards, files)
    file = F.expr(f"shard * {int(file_of[-1]) + 1}L div {n_shards}L").alias("file")

    def gathered(count) -> DataFrame:
        sent = texts.mapInArrow(count, "shard long, blob binary").select(file, "shard", "blob")
        return sent.repartition("file").sortWithinPartitions("file", "shard")

    words = gathered(lambda b: _count_words(b, n_shards)).mapInArrow(lambda b: _write_words(b, folder), "file long, n_words long, n_tokens long")
    rows = {r.file: r for r in staged(words, "trie-words").collect()}
    level = Words(folder, [rows[i].n_words if i in rows else 0 for i in range(file_of[-1] + 1)], sum(r.n_tokens for r in rows.values()), file_of)
    grams = gathered(lambda b: _count_grams(b, level, n_shards)).mapInArrow(lambda b: _write_grams(b, folder, level, mu), "file long, n_pairs long, n_triples long")
    return Trie(folder, level, file_of, mu, {r.file for r in staged(grams, "trie-grams").collect()})


def score(docs: DataFrame, trie: Trie) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (log10 probability) of every text."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(lambda b: _score(b, trie), f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")


def op4_trie_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trie = train(docs.filter(fold(F.col("doc_id"), FOLDS) != 0), new_folder(spark, "trie"))
    held_out = (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out")
    return score(docs, trie).select("doc_id", held_out, "n_tokens", "n_known", F.lit(trie.words.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


QUERIES = {"op4_trie_lm": op4_trie_lm}
ORACLES: dict[str, str] = {}
