"""Benchmark passages in documents, found by latent semantic retrieval and confirmed by common subsequences."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm import _common as C
from panelspark.llm.tokens import sliced

WINDOW = 32  # words of a passage
STRIDE = 8  # words between the beginnings of a document's passages; benchmark segments: half a window
BLOCK = 1024  # terms of one message of sums
CELLS = 4_000_000  # cosines that a task holds at a time
FIT_TASKS = 8  # that add up the sketch of the corpus, at least
PIECE = 8  # passages of a term that are added up at a time
FORMS = 200_000  # written forms that a worker remembers
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_FORMS: dict[str, int] = {}  # the benchmark's words, and written forms that were looked up, with their term
_STAMP = [0]  # the vocabulary that these are of


def forget() -> None:
    _FORMS.clear()


@dataclass
class Limits:
    """A document has an item if a passage's latent cosine with a segment of the item reaches `cosine`, `lcs` of the
    item's words follow each other (with gaps) in the text around, and `answer` of the words of its last sentence do.

    The latent space has `rank` dimensions. It is fitted on the passages of all documents, and on the benchmark's segments.
    Each of the benchmark's words is a term; all other words of the corpus share `vocabulary` hashed terms.
    """

    cosine: float = 0.6
    lcs: float = 0.6
    answer: float = 0.5
    rank: int = 128
    oversample: int = 12
    block_items: int = 20_000
    vocabulary: int = 40_000


@dataclass
class Items:
    """A block of benchmark items as term numbers. Words without a number in the vocabulary have one of `hashed` terms after its."""

    vocabulary: dict[str, int]
    ids: list
    words: list[np.ndarray]
    answers: list[np.ndarray]
    segments: list[np.ndarray]  # words of each segment
    owner: np.ndarray  # item of each segment
    stamp: int = 0
    hashed: int = 0

    def kind(self) -> tuple[str, int]:
        """The type of term numbers, and the number of all words that are no term."""
        n = len(self.vocabulary) + self.hashed
        return ("<u2" if n < 65535 else "<i4"), n


def _bare(word: str) -> str:
    return _EDGE.sub("", word)


def read_items(rows: list[tuple], corpus_terms: list[str], hashed: int = 0) -> Items:
    vocabulary: dict[str, int] = {}
    number = lambda words: np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int32)
    out = Items(vocabulary, [], [], [], [], np.zeros(0, np.int64))
    owner = []
    for item, text in rows:
        words = [w for w in map(_bare, (text or "").lower().split()) if w]
        if not words:
            continue
        sentences = [s for s in re.split(r"(?<=[.!?])\s+", (text or "").lower()) if _bare(s)]
        last = [w for w in map(_bare, sentences[-1].split()) if w]
        if len(last) < 3:
            last = words[-max(3, len(words) // 4) :]
        ids = number(words)
        for at in range(0, max(1, len(ids) - WINDOW // 2), WINDOW // 2):
            out.segments.append(ids[at : at + WINDOW])
            owner.append(len(out.ids))
        out.ids.append(item)
        out.words.append(ids)
        out.answers.append(number(last))
    number(corpus_terms)
    out.owner = np.array(owner, np.int64)
    out.stamp, out.hashed = hash((tuple(vocabulary), hashed)), hashed
    return out


def _term_counts(batches):
    """Bare words of a task's documents, with how often they are there."""
    found: Counter = Counter()
    for batch in batches:
        for b in sliced(batch):
            found.update(chain.from_iterable(t.lower().split() for t in b.column("_text").to_pylist()))
    terms: Counter = Counter()
    for w, n in found.items():
        if w := _bare(w):
            terms[w] += n
    words = list(terms)
    for k in range(0, len(words), 20_000):
        part = words[k : k + 20_000]
        yield pa.record_batch([pa.array(part), pa.array([terms[w] for w in part], pa.int64())], names=["term", "n"])


def _terms(words: set[str], items: Items) -> dict[str, int]:
    known, crc, n, hashed = items.vocabulary.get, zlib.crc32, len(items.vocabulary), items.hashed
    out = {}
    for w in words:
        bare = w if w[0].isalnum() and w[-1].isalnum() else _bare(w)
        k = known(bare, -1)
        out[w] = n + crc(bare.encode()) % hashed if k < 0 and hashed and bare else k
    return out


def term_ids(texts: list[str], items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers of all words of the texts, -1 for others; and the words of each text."""
    cut = [t.lower().split() if t else [] for t in texts]
    if not _FORMS or _STAMP[0] != items.stamp:
        forget()
        _FORMS.update(items.vocabulary)
        _STAMP[0] = items.stamp
    sizes = np.array([len(c) for c in cut], np.int64)
    words = list(chain.from_iterable(cut))
    ids = np.fromiter(map(_FORMS.get, words, repeat(-2)), np.int32, len(words))
    new = np.flatnonzero(ids == -2)
    asked = [words[k] for k in new.tolist()]
    found = _terms(set(asked), items)
    ids[new] = [found[w] for w in asked]
    if len(_FORMS) < len(items.vocabulary) + FORMS:
        _FORMS.update((w, n) for w, n in found.items() if n >= 0)
    return ids, sizes


_IDS = "doc_id bigint, text_hash bigint, terms binary"


def _number(held):
    """Whole documents as term numbers; the highest number stands for all other words."""

    def run(batches):
        C.take_turn("terms", forget)
        items = held.value
        kind, none = items.kind()
        for batch in batches:
            for b in sliced(batch):
                ids, sizes = term_ids(b.column("_text").to_pylist(), items)
                ids = np.where(ids < 0, none, ids).astype(kind)
                ends = np.cumsum(sizes)
                blobs = [ids[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.record_batch([b.column("doc_id"), b.column("text_hash"), pa.array(blobs, pa.binary())], names=["doc_id", "text_hash", "terms"])

    return run


def _laid(blobs: list[bytes], kind: str, none: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents one after another, each begun at a multiple of WINDOW with at least WINDOW places of `none` before the next."""
    parts, starts, at = [], [], 0
    for x in blobs:
        ids = np.frombuffer(x, kind)
        pad = WINDOW - len(ids) % WINDOW + WINDOW
        parts += [ids, np.full(pad, none, kind)]
        starts.append(at)
        at += len(ids) + pad
    return np.concatenate([np.zeros(0, kind), *parts]), np.array(starts, np.int64)


_SUMS = "block int, data binary"


def _sums(total: np.ndarray):
    """The rows of an array, in messages of BLOCK rows; blocks of zeros need none."""
    for k in range(0, len(total), BLOCK):
        if total[k : k + BLOCK].any():
            yield pa.record_batch([pa.array([k // BLOCK], pa.int32()), pa.array([np.ascontiguousarray(total[k : k + BLOCK]).tobytes()], pa.binary())], names=["block", "data"])


def _add(dtype: str):
    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
                x = np.frombuffer(data, dtype)
                total[k] = total[k] + x if k in total else x
        for k, x in total.items():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["block", "data"])

    return run


def _totals(messages: DataFrame, dtype: str) -> DataFrame:
    """The sum of the tasks' arrays, a row for each block of terms."""
    return messages.repartition(C.partitions(messages.sparkSession), "block").mapInArrow(_add(dtype), _SUMS)


def _gathered(blocks: DataFrame, shape: tuple, dtype: str) -> np.ndarray:
    """An array of the vocabulary's length from its blocks, on the driver."""
    out = np.zeros(shape, dtype)
    for r in blocks.toLocalIterator():
        x = np.frombuffer(r.data, dtype).reshape(-1, *shape[1:])
        out[r.block * BLOCK : r.block * BLOCK + len(x)] += x
    return out


def _document_frequency(held):
    """Passages (every WINDOW words) that have each term, over the task's documents; at the last number: all passages."""

    def run(batches):
        kind, none = held.value.kind()
        total = np.zeros(none + 1, np.int64)
        for batch in batches:
            for b in sliced(batch):
                flat, _ = _laid(b.column("terms").to_pylist(), kind, none)
                rows = np.sort(flat.reshape(-1, WINDOW), axis=1)
                first = np.ones(rows.shape, bool)
                first[:, 1:] = rows[:, 1:] != rows[:, :-1]
                total[:none] += np.bincount(rows[first], minlength=none + 1)[:none]
                total[none] += int((rows[:, 0] != none).sum())
        yield from _sums(total)

    return run


def term_weights(df: np.ndarray) -> np.ndarray:
    """Inverse passage frequency of each term; 0 for words that are none."""
    out = (np.log((1 + df[-1]) / (1 + np.minimum(df, df[-1]))) + 0.05).astype(np.float32)
    out[-1] = 0
    return out


def _omega(v: int, width: int) -> np.ndarray:
    return np.random.default_rng(20).standard_normal((v, width), np.float32)


def _padded(segments: list[np.ndarray], none: int) -> np.ndarray:
    out = np.full((len(segments), WINDOW), none, np.int64)
    for k, s in enumerate(segments):
        out[k, : len(s)] = s
    return out


def _products(rows: np.ndarray, table: np.ndarray, out: np.ndarray) -> None:
    """Add to each term's row of out, for each place of it in a passage, the sum of the passage's rows of the table.
    The highest term is none, and its row of the table zero."""
    passages = np.zeros((len(rows) + 1, table.shape[1]), np.float32)  # the last stays zero
    for k in range(0, len(rows), 512):
        part = rows[k : k + 512]
        for j in range(rows.shape[1]):
            passages[k : k + len(part)] += np.take(table, part[:, j], axis=0, mode="clip")
    terms = rows.ravel()
    order = np.argsort(terms, kind="stable")
    terms = terms[order]
    order = order[: np.searchsorted(terms, len(table) - 1)] // rows.shape[1]
    terms = terms[: len(order)]
    new = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else terms
    terms, sizes, values = terms[new], np.diff(np.append(new, len(terms))), passages
    while len(terms):  # a term's rows are added up PIECE at a time, then the sums again
        pieces = -(-sizes // PIECE)
        first, begins = np.cumsum(pieces) - pieces, np.cumsum(sizes) - sizes
        dealt = np.full(int(pieces.sum()) * PIECE, len(values) - 1)
        dealt[np.arange(len(order)) + np.repeat(first * PIECE - begins, sizes)] = order
        dealt = dealt.reshape(-1, PIECE)
        sums = np.zeros((len(dealt) + 1, table.shape[1]), np.float32)
        for k in range(0, len(dealt), 1024):
            part = dealt[k : k + 1024]
            for j in range(PIECE):
                sums[k : k + len(part)] += np.take(values, part[:, j], axis=0, mode="clip")
        done = pieces == 1
        out[terms[done]] += sums[first[done]]
        order = np.flatnonzero(np.repeat(~done, pieces))
        terms, sizes, values = terms[~done], pieces[~done], sums


def _gram_times(rows: np.ndarray, idf: np.ndarray, omega: np.ndarray, out: np.ndarray) -> None:
    """Add A'(A omega) to out, for the TF-IDF rows A of passages given by their words' terms."""
    total = np.zeros(omega.shape)
    _products(rows, omega * idf[:, None], total)
    out += total * idf[:, None]


def _sketch(held, idf: np.ndarray, width: int):
    """A'(A Omega) of the task's passages, laid end to end."""

    def run(batches):
        kind, none = held.value.kind()
        table = _omega(none + 1, width) * idf[:, None]
        total = np.zeros(table.shape)
        for batch in batches:
            for b in sliced(batch, 2048):
                flat, _ = _laid(b.column("terms").to_pylist(), kind, none)
                rows = flat.reshape(-1, WINDOW)
                for k in range(0, len(rows), 16384):
                    _products(rows[k : k + 16384], table, total)
        yield from _sums((total * idf[:, None]).astype(np.float32))

    return run


def _half(small: np.ndarray, least: float, most: int | None = None) -> np.ndarray:
    """Columns that turn a factor L with L'L = small into one of orthogonal unit columns, largest directions first."""
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    kept = np.flatnonzero(values > least * max(values[-1], 1e-30))[::-1][:most]
    return vectors[:, kept] / np.sqrt(values[kept])


#: Directions under this share of the largest are noise of single precision.
_NOISE = 1e-6


def nystrom_basis(gram_omega: np.ndarray, omega: np.ndarray, rank: int) -> np.ndarray:
    """Leading right singular vectors of A from (A'A) Omega: randomised eigendecomposition of a semi-definite matrix.

    All that is as long as the vocabulary keeps the type given; the small matrices are in double precision. latent_table
    does the same by blocks of rows.
    """
    left = gram_omega @ _half((omega.T @ gram_omega).astype(np.float64), _NOISE).astype(gram_omega.dtype)
    return left @ _half((left.T @ left).astype(np.float64), 1e-12, rank).astype(left.dtype)


@dataclass
class Latent:
    """What tasks search with: a row for each term (its weight times its place in the latent space), and the segments' directions."""

    table: np.ndarray
    segments: np.ndarray


def make_latent(items: Items, idf: np.ndarray, basis: np.ndarray) -> Latent:
    return _placed(items, basis.astype(np.float32, copy=False) * idf[:, None])


def _placed(items: Items, table: np.ndarray) -> Latent:
    return Latent(table, _unit(table[_padded(items.segments, len(table) - 1)].sum(1)))


def latent_table(blocks: DataFrame, held, idf: np.ndarray, width: int, rank: int) -> np.ndarray:
    """Terms' places in the latent space times their weights, from the blocks of rows of (A'A) Omega of the corpus.

    Everything as long as the vocabulary stays in tasks, block by block, in double precision: the driver adds up small
    matrices (width by width), solves them, and gets the finished table, which all tasks search with. The benchmark's
    segments are added with as much weight as the corpus has.
    """
    terms = len(idf)
    weights = blocks.sparkSession.sparkContext.broadcast(idf)

    def each(function):
        """function(block, its rows of Omega, of the corpus's product, of the segments' product) over a task's blocks."""

        def run(batches):
            omega = segments = None
            for batch in batches:
                for k, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
                    if omega is None:
                        omega = _omega(terms, width)
                        segments = np.zeros_like(omega)
                        _gram_times(_padded(held.value.segments, terms - 1), weights.value, omega, segments)
                    rows = slice(k * BLOCK, min((k + 1) * BLOCK, terms))
                    yield k, function(rows, omega[rows].astype(float), np.frombuffer(data, "<f4").reshape(-1, width).astype(float), segments[rows].astype(float))

        return run

    def added(function, shape: tuple) -> np.ndarray:
        """The sum over all blocks of a small matrix of each; a task adds up its own."""

        def run(batches):
            parts = [x for _, x in each(function)(batches)]
            if parts:
                yield pa.record_batch([pa.array([np.sum(parts, axis=0).tobytes()], pa.binary())], names=["data"])

        return sum((np.frombuffer(r.data, float).reshape(shape) for r in blocks.mapInArrow(run, "data binary").collect()), np.zeros(shape))

    of_corpus, of_items = added(lambda rows, omega, own, segments: np.stack([omega.T @ own, omega.T @ segments]), (2, width, width))
    share = max(1.0, float(np.trace(of_corpus)) / max(float(np.trace(of_items)), 1e-9))
    half = _half(of_corpus + share * of_items, _NOISE)
    gram = lambda x: x.T @ x
    turn = half @ _half(added(lambda rows, omega, own, segments: gram((own + share * segments) @ half), (half.shape[1], half.shape[1])), 1e-12, rank)

    def finished(batches):
        for k, x in each(lambda rows, omega, own, segments: ((own + share * segments) @ turn) * weights.value[rows, None])(batches):
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([x.astype("<f4").tobytes()], pa.binary())], names=["block", "data"])

    return _gathered(blocks.mapInArrow(finished, _SUMS), (terms, turn.shape[1]), "<f4")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], 1e-9)


def _begun(begins: np.ndarray, sizes: np.ndarray, words: int) -> np.ndarray:
    """Which passages, of those at every STRIDE of so many laid words, begin inside a document."""
    moves = np.zeros(words // STRIDE + 1, np.int64)
    np.add.at(moves, begins // STRIDE, 1)
    np.add.at(moves, (begins + sizes + STRIDE - 1) // STRIDE, -1)
    return np.cumsum(moves)[:-1] > 0


def latent_candidates(flat: np.ndarray, latent: Latent, least: float, begun: np.ndarray | None = None):
    """(begin, segment, cosine) of all passages, begun at every STRIDE words of laid documents (where `begun` tells it),
    and segments that reach the cosine. A passage's vector is the sum of those of its words; sums over STRIDE words are shared by neighbours."""
    rank, n = latent.table.shape[1], len(latent.segments)
    each = max(WINDOW, min(1 << 16, CELLS // max(rank, 1), CELLS // max(n, 1) * STRIDE) // WINDOW * WINDOW)  # words at a time
    for at in range(0, len(flat), each):
        words = flat[at : at + each + WINDOW - STRIDE].reshape(-1, STRIDE)
        sums = np.take(latent.table, words[:, 0], axis=0)
        for j in range(1, STRIDE):
            sums += np.take(latent.table, words[:, j], axis=0, mode="clip")
        m = len(sums) - WINDOW // STRIDE + 1
        if m <= 0:
            continue
        passages = sum(sums[k : k + m] for k in range(WINDOW // STRIDE))
        places = np.arange(m) if begun is None else np.flatnonzero(begun[at // STRIDE : at // STRIDE + m])
        passages = passages[places]
        cosine = (_unit(passages) @ latent.segments.T).ravel()
        where = np.flatnonzero(cosine >= least)
        yield at + places[where // n] * STRIDE, where % n, cosine[where]


def lcs_length(a: np.ndarray, b: np.ndarray | list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for x in b if isinstance(b, list) else b.tolist():
        if m := where.get(x):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _score(held, limits: Limits):
    def run(batches):
        items, latent = held.value
        kind, none = items.kind()
        times = [Counter(w.tolist()) for w in items.words]
        fewest = [limits.lcs * len(w) - 1e-9 for w in items.words]
        for batch in batches:
            out = []
            for b in sliced(batch):
                blobs = b.column("terms").to_pylist()
                flat, begins = _laid(blobs, kind, none)
                sizes = np.array([len(x) for x in blobs], np.int64) // np.dtype(kind).itemsize
                best: dict[tuple[int, int], tuple] = {}
                plain = flat.tolist()
                for begin, segment, cosine in latent_candidates(flat, latent, limits.cosine, _begun(begins, sizes, len(flat))):
                    doc = np.searchsorted(begins, begin, "right") - 1
                    item = items.owner[segment]
                    # one row for each (document, item, passage), with the best segment's cosine
                    order = np.lexsort((-cosine, begin, item))
                    new = np.ones(len(order), bool)
                    new[1:] = (begin[order][1:] != begin[order][:-1]) | (item[order][1:] != item[order][:-1])
                    take = order[new]
                    for d, k, at, c in zip(doc[take].tolist(), item[take].tolist(), begin[take].tolist(), cosine[take].tolist(), strict=True):
                        a, n = int(begins[d]), len(items.words[k])
                        if at >= a + sizes[d]:
                            continue
                        around = plain[max(a, at - n) : min(a + int(sizes[d]), at + WINDOW + n)]
                        here = times[k]
                        if sum(map(here.__getitem__, here.keys() & set(around))) < fewest[k]:
                            continue  # it has too few of the item's words for any subsequence of that length
                        common = lcs_length(items.words[k], around) / n
                        if common < limits.lcs:
                            continue
                        answer = lcs_length(items.answers[k], around) / len(items.answers[k])
                        if answer >= limits.answer:
                            old = best.get((d, k), (0.0, 0.0, 0.0))
                            best[d, k] = (max(c, old[0]), *max((common, answer), old[1:]))
                docs, hashes = b.column("doc_id").to_pylist(), b.column("text_hash").to_pylist()
                out += [(docs[d], hashes[d], items.ids[k], *v) for (d, k), v in sorted(best.items())]
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "text_hash", "item_id", "cosine", "lcs", "answer"])

    return run


_FOUND = "doc_id bigint, text_hash bigint, item_id bigint, cosine double, lcs double, answer double"


def fit_latent(numbered: DataFrame, held, limits: Limits) -> Latent:
    """Weights from all passages of the corpus; a randomised SVD of them and the benchmark's segments.

    The segments weigh as much as the corpus, so that the leading directions tell them apart. Each task of the sketch sends
    an array of the vocabulary's length, so their number goes with the session's cores and not with the corpus.
    """
    items = held.value
    none = items.kind()[1]
    spark = numbered.sparkSession
    df = _gathered(_totals(numbered.select("terms").mapInArrow(_document_frequency(held), _SUMS), "<i8"), (none + 1,), "<i8")
    idf = term_weights(df)
    width = min(none + 1, limits.rank + limits.oversample)
    dealt = numbered.select("terms").coalesce(max(FIT_TASKS, 2 * spark.sparkContext.defaultParallelism))
    sums = _totals(dealt.mapInArrow(_sketch(held, idf, width), _SUMS), "<f4")
    every = spark.range(-(-(none + 1) // BLOCK)).select(F.col("id").cast("int").alias("block"))  # blocks that no passage has, too
    zeros = F.unhex(F.repeat(F.lit("00"), F.least(F.lit(BLOCK), F.lit(none + 1) - F.col("block") * BLOCK) * (width * 4)))
    blocks = C.materialise(every.join(sums, "block", "left").select("block", F.coalesce("data", zeros).alias("data")).repartition(C.partitions(spark), "block"), "sketch")
    table = latent_table(blocks, held, idf, width, limits.rank)
    C.discard(blocks)
    return _placed(items, table)


def _block_leaks(rows: DataFrame, items: Items, limits: Limits) -> DataFrame:
    context = rows.sparkSession.sparkContext
    held = context.broadcast(items)
    numbered = C.materialise(rows.mapInArrow(_number(held), _IDS), "benchmark-terms")
    latent = fit_latent(numbered, held, limits)
    return numbered.mapInArrow(_score(context.broadcast((items, latent)), limits), _FOUND)


def find_leaks(docs: DataFrame, benchmark: DataFrame, limits: Limits | None = None, text: str = "text", id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """(doc_id, text_hash, item_id, cosine, lcs, answer): a row for each document and benchmark item that it has.

    The benchmark is the query set: it is read in blocks of at most limits.block_items items, each held by every task;
    the cosines of a block cost time in proportion to passages times segments. Each of the benchmark's words is a term, and
    every other word has a hashed one, which it shares with some more. For a block, one pass over all texts writes them as
    term numbers; of these, one counts the passages of the whole corpus that have each term. The corpus's passages, with
    the benchmark's segments, are the TF-IDF matrix of a randomised SVD, whose sketch tasks add up by blocks of terms. Then
    every passage of every document is placed in the latent space. Its cosines with the segments alone choose the
    candidates; a longest common subsequence of the item with the text around confirms them, and one of its last
    sentence the answer. Cosine is the greatest of the document's confirmed passages.

    Defined results: null and empty texts have no items, null or empty items are in no document; rows equal in id and
    text give equal rows each; null ids are kept; an empty table on either side gives no rows; other columns are not read.
    """
    limits = limits or Limits()
    spark = docs.sparkSession
    C.prepare(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    queries = benchmark.select(F.col(item_col).cast("bigint").alias("i"), F.col(text if text in benchmark.columns else "text").alias("t"))
    n = queries.count()
    if not n:
        return spark.createDataFrame([], _FOUND)
    blocks = max(1, -(-n // limits.block_items))
    out = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        items = read_items([(r.i, r.t) for r in part.orderBy("i", "t").collect()], [], limits.vocabulary)
        if items.ids:
            found = _block_leaks(rows, items, limits)
            out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], _FOUND)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, limits: Limits | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows of docs that have no benchmark item, with all columns."""
    leaks = C.materialise(find_leaks(docs, benchmark, limits, text, id_col).select("doc_id", "text_hash").distinct(), "leaks")
    a, b = docs.alias("a"), leaks.alias("b").hint("shuffle_hash")
    same = F.col(f"a.{id_col}").cast("bigint").eqNullSafe(F.col("b.doc_id")) & (F.xxhash64(F.coalesce(F.col(f"a.{text}"), F.lit(""))) == F.col("b.text_hash"))
    return a.join(b, same, "left_anti")
