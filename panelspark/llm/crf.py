"""Languages of words in running text by a linear-chain conditional random field."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm import _common as C
from panelspark.llm.tokens import sliced

UNKNOWN = "und"
#: Feature hashes of a word: whole word, a prefix and a suffix of 3 letters, all n-grams of 2 and 3 letters.
SLOTS = 1 << 17
#: Distinct words whose scores a worker keeps, and the letters of the longest of them; others are scored where they stand.
MEMORY = 150_000
#: Words of a text whose scores are held at a time; longer texts are labelled in pieces that exchange messages.
PIECE = 1 << 16
REMEMBERED = 48
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each between two marks, one word after another; and lengths with the marks."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    out = np.zeros(int(sizes.sum()), np.uint64)
    inner = np.ones(len(out), bool)
    inner[ends - sizes] = inner[ends - 1] = False
    out[inner] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    out[ends - sizes], out[ends - 1] = 1, 2
    return out, sizes


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of words of any length, one word after another; and how many each word has."""
    code, size = _codes(words)
    begin = np.cumsum(size) - size
    mark = lambda h, kind: ((h * _MULT + np.uint64(kind * 0xC2B2AE3D27D4EB4F % 2**64)) >> np.uint64(40)) % np.uint64(SLOTS)
    word = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(code)) - begin[word]
    many = 2 * size - 2 + 2 * (size >= 4)  # size - 1 pairs, size - 2 triples, the whole, and two affixes
    at = np.cumsum(many) - many
    out = np.zeros(int(many.sum()), np.int64)
    two = code[:-1] * _MULT + code[1:]
    three = two[:-1] * _MULT + code[2:]
    for kind, gram, k, ahead in ((1, two, 2, 0 * size), (2, three, 3, size - 1)):
        use = np.flatnonzero(place[: len(gram)] + k <= size[word[: len(gram)]])
        out[(at + ahead)[word[use]] + place[use]] = mark(gram[use], kind)
    power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(int(size.max(initial=1)), _MULT))])
    whole = np.add.reduceat(code * power[place], begin) if len(words) else np.zeros(0, np.uint64)
    out[at + 2 * size - 3] = mark(whole, 3)
    long = np.flatnonzero(size >= 4)
    four = lambda i: ((code[i] * _MULT + code[i + 1]) * _MULT + code[i + 2]) * _MULT + code[i + 3]
    out[at[long] + 2 * size[long] - 2] = mark(four(begin[long]), 4)
    out[at[long] + 2 * size[long] - 1] = mark(four(begin[long] + size[long] - 4), 5)
    return out, many


@dataclass
class Crf:
    """Weights of slots, of lexicon membership and of transitions between labels."""

    labels: list[str]
    weights: np.ndarray  # (SLOTS, labels)
    lexicon: dict[str, int]  # word -> label whose documents it marks
    lexicon_weights: np.ndarray  # (labels, labels): weight for each label of a word in the lexicon of another
    transitions: np.ndarray  # (labels, labels)
    start: np.ndarray
    memory: dict[str, int] = field(default_factory=dict, repr=False)
    table: np.ndarray | None = field(default=None, repr=False)

    def forget(self) -> None:
        self.memory.clear()
        self.table = None

    def remember(self, base: int, rows: np.ndarray) -> None:
        """Keep the scores of words base, base + 1, ... in a table that doubles when full."""
        if self.table is None:
            self.table = np.zeros((4096, len(self.labels)), np.float32)
        while base + len(rows) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[base : base + len(rows)] = rows

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.labels)), np.float32)
        for k in range(0, len(words), 4096):
            slots, many = features(words[k : k + 4096])
            out[k : k + 4096] = np.add.reduceat(self.weights[slots], np.cumsum(many) - many, axis=0)
        known = np.fromiter((self.lexicon.get(w, -1) for w in words), np.int64, len(words))
        return out + np.where(known[:, None] >= 0, self.lexicon_weights[known], 0)


def marginals(emissions: np.ndarray, lengths: np.ndarray, start: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Forward-backward: P(label at each place | text) for texts laid in (texts, places, labels), longest first.

    Every step scales its messages to sum one; places past a text's end are left at zero.
    """
    n, width, k = emissions.shape
    e = np.exp(emissions - emissions.max(2, keepdims=True))
    t = np.exp(transitions - transitions.max())
    alive = [int(np.searchsorted(-lengths, -p, "left")) for p in range(width)]  # texts longer than p
    forward = np.zeros_like(e)
    a = np.exp(start - start.max())[None, :] * e[:, 0]
    forward[:, 0] = a / a.sum(1, keepdims=True)
    for p in range(1, width):
        m = alive[p]
        a = (forward[:m, p - 1] @ t) * e[:m, p]
        forward[:m, p] = a / a.sum(1, keepdims=True)
    backward = np.ones((n, k), e.dtype)
    for p in range(width - 2, -1, -1):
        m = alive[p + 1]
        b = (backward[:m] * e[:m, p + 1]) @ t.T
        backward[:m] = b / b.sum(1, keepdims=True)
        forward[:m, p] *= backward[:m]
    total = forward.sum(2, keepdims=True)
    return np.divide(forward, total, out=forward, where=total > 0)


def label_sums(emission, n: int, start: np.ndarray, transitions: np.ndarray, piece: int) -> np.ndarray:
    """The sum over a text's n places of P(label), as marginals gives them, with the scores of `piece` places at a time:
    emission(a, b) gives those of places a to b. A first pass keeps the forward message at the beginning of each piece; a
    second goes back piece by piece with the backward message."""
    t = np.exp(transitions - transitions.max()).astype(float)

    def scores(a: int) -> np.ndarray:
        e = emission(a, min(a + piece, n)).astype(float)
        return np.exp(e - e.max(1, keepdims=True))

    def forward(e: np.ndarray, before: np.ndarray | None) -> np.ndarray:
        out = np.empty_like(e)
        for p in range(len(e)):
            x = (np.exp(start - start.max()) if before is None else before @ t) * e[p]
            out[p] = before = x / x.sum()
        return out

    begins, message = list(range(0, n, piece)), None
    held = []
    for a in begins:
        held.append(message)
        message = forward(scores(a), message)[-1]
    total, back = np.zeros(len(start)), np.ones(len(start))
    for a, message in zip(begins[::-1], held[::-1], strict=True):
        e = scores(a)
        ahead = forward(e, message)
        for p in range(len(e) - 1, -1, -1):
            m = ahead[p] * back
            total += m / m.sum()
            back = t @ (back * e[p])
            back /= back.sum()
    return total


_WORD = re.compile(r"[^\W\d_]+")
#: The same with the marks (vowel signs, accents) and joiners that follow a letter, which texts of many scripts have.
_MARKED = regex.compile(r"\p{L}[\p{L}\p{M}\u200c\u200d]*")
_MARK = regex.compile(r"\p{M}")
_HIGH = re.compile("[\u0300-\U0010ffff]")  # no mark comes before these


def tokens_of(text: str) -> list[str]:
    """Runs of letters and of the marks on them in lower case, whole; none where no character is a letter."""
    text = text.lower()
    words = (_WORD if text.isascii() or not _HIGH.search(text) or not _MARK.search(text) else _MARKED).findall(text)
    return words if any(map(str.isalpha, words)) or any(c.isalpha() for w in words for c in w) else []


def train(texts: list[tuple[str, str]], words: int = 24, sequences: int = 6000, rounds: int = 2, batch: int = 64, seed: int = 7) -> Crf:
    """Fit on (text, language) pairs.

    Weights begin at the log-odds of counts; then AdaGrad follows the gradient of the conditional likelihood, observed
    less expected features, over code-switched sequences spliced from runs of words of different languages.
    """
    rng = np.random.default_rng(seed)
    labels = sorted({lang for _, lang in texts})
    k = len(labels)
    if not k:
        return Crf([], np.zeros((SLOTS, 0), np.float32), {}, np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0, np.float32))
    same: dict[str, str] = {}  # equal words are one object
    by = [[same.setdefault(w, w) for t, lang in texts if lang == x for w in tokens_of(t)] for x in labels]
    by = [w or ["?"] for w in by]
    counts = np.full((SLOTS, k), 0.5)
    seen: dict[str, np.ndarray] = {}
    for j, ws in enumerate(by):
        unique, number = np.unique(np.array(ws, object), return_counts=True)
        for at in range(0, len(unique), 4096):
            slots, many = features(list(unique[at : at + 4096]))
            counts[:, j] += np.bincount(slots, np.repeat(number[at : at + 4096], many), SLOTS)
        for w, c in zip(unique, number, strict=True):
            seen.setdefault(w, np.zeros(k))[j] = c / len(ws)
    share = counts / counts.sum(0)
    weights = (np.log(share) - np.log(share).mean(1, keepdims=True)).astype(np.float32) * 0.15
    lexicon = {w: int(s.argmax()) for w, s in seen.items() if s.max() >= 2e-4 and s.max() >= 0.8 * s.sum()}
    model = Crf(labels, weights, lexicon, np.eye(k, dtype=np.float32) - 1 / k, np.log(np.full((k, k), 0.05) + 0.9 * np.eye(k)).astype(np.float32), np.zeros(k, np.float32))
    if k < 2:
        return model
    grads = {name: np.full(getattr(model, name).shape, 1e-2, np.float32) for name in ("weights", "lexicon_weights", "transitions", "start")}

    def step(name, g, rate=0.1):
        grads[name] += g * g
        getattr(model, name)[...] += rate * g / np.sqrt(grads[name])

    for _ in range(rounds * sequences // batch):
        seqs, gold = [], np.zeros((batch, words), np.int64)
        for b in range(batch):
            row, at = [], 0
            while at < words:
                j = int(rng.integers(k))
                n = min(words - at, int(rng.geometric(1 / 12)))
                s = int(rng.integers(max(1, len(by[j]) - n)))
                part = by[j][s : s + n]
                row += part
                gold[b, at : at + len(part)] = j
                at += len(part)
            seqs.append(row)
        flat = [w for row in seqs for w in row]
        e = model.emissions(flat).reshape(batch, words, k)
        p = marginals(e, np.full(batch, words), model.start, model.transitions)
        observed = np.eye(k, dtype=np.float32)[gold]
        diff = (observed - p).astype(np.float32)
        slots, many = features(flat)
        change = np.repeat(diff.reshape(-1, k), many, axis=0)
        g = np.stack([np.bincount(slots, change[:, j], SLOTS) for j in range(k)], 1).astype(np.float32)
        step("weights", g / batch)
        known = np.fromiter((model.lexicon.get(w, -1) for w in flat), np.int64, len(flat))
        g = np.zeros_like(model.lexicon_weights)
        np.add.at(g, known[known >= 0], diff.reshape(-1, k)[known >= 0])
        step("lexicon_weights", g / batch)
        step("start", diff[:, 0].mean(0))
        t = np.exp(model.transitions - model.transitions.max())
        x = np.exp(e - e.max(2, keepdims=True))
        expected = np.zeros((k, k))
        a = np.exp(model.start)[None, :] * x[:, 0]
        forward = [a / a.sum(1, keepdims=True)]
        for q in range(1, words):
            a = (forward[-1] @ t) * x[:, q]
            forward.append(a / a.sum(1, keepdims=True))
        back = np.ones((batch, k))
        for q in range(words - 2, -1, -1):
            y = back * x[:, q + 1]
            pair = forward[q][:, :, None] * t[None] * y[:, None, :]
            expected += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
            back = y @ t.T
            back /= back.sum(1, keepdims=True)
        found = np.zeros((k, k))
        np.add.at(found, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
        step("transitions", ((found - expected) / batch).astype(np.float32))
    return model


def predict(model: Crf, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, score) of each text: the label with most expected words, and its share of them; und, 0.0 without a
    letter, and everywhere if the model knows no language."""
    if not model.labels:
        return [(UNKNOWN, 0.0)] * len(texts)
    memory = model.memory
    if len(memory) > MEMORY:
        memory.clear()
    cut: list[np.ndarray] = []  # of each text, the numbers of its words
    last: list[np.ndarray] = []  # of each text, the scores of its words too long to remember
    for k in range(0, len(texts), 256):
        part = [tokens_of(t) if t else [] for t in texts[k : k + 256]]
        seen = set().union(*part).difference(memory)
        if new := [w for w in seen if len(w) <= REMEMBERED]:
            base = len(memory)
            memory.update(zip(new, range(base, base + len(new)), strict=True))
            model.remember(base, model.emissions(new))
        if len(new) == len(seen):
            cut += [np.fromiter(map(memory.__getitem__, words), np.int32, len(words)) for words in part]
            last += [None] * len(part)
        else:
            for words in part:
                cut.append(np.fromiter((memory.get(w, -1) for w in words), np.int32, len(words)))
                long = [w for w in words if len(w) > REMEMBERED]
                last.append(model.emissions(long) if long else None)
    table = model.table
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    lengths = np.array([len(c) for c in cut])
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    at = 0
    while at < len(order) and lengths[order[at]] > PIECE:
        d, at = int(order[at]), at + 1
        words = cut[d]
        rare = np.cumsum(words < 0)  # the number of words up to each place that are too long to remember

        def emission(a: int, b: int, words=words, rare=rare, long=last[d]) -> np.ndarray:
            e = table[np.maximum(words[a:b], 0)] if table is not None else np.zeros((b - a, len(model.labels)), np.float32)
            off = words[a:b] < 0
            if off.any():
                e[off] = long[rare[a:b][off] - 1]
            return e

        p = label_sums(emission, len(words), model.start, model.transitions, PIECE) / len(words)
        out[d] = (model.labels[int(p.argmax())], float(min(p.max(), 1.0)))
    while at < len(order):
        longest, end = lengths[order[at]], at
        while end < len(order) and lengths[order[end]] * 5 >= longest * 4 and (end - at) * longest < 400_000:
            end += 1
        rows = order[at:end]
        e = np.zeros((len(rows), longest, len(model.labels)), np.float32)
        for r, d in enumerate(rows):
            if last[d] is None:
                e[r, : lengths[d]] = table[cut[d]]
            else:
                known = cut[d] >= 0
                e[r, : lengths[d]][~known] = last[d]
                if known.any():
                    e[r, : lengths[d]][known] = table[cut[d][known]]
        p = marginals(e, lengths[rows], model.start, model.transitions).sum(1, dtype=np.float64) / lengths[rows][:, None]
        for d, best, score in zip(rows, p.argmax(1), p.max(1), strict=True):
            out[d] = (model.labels[best], float(min(score, 1.0)))
        at = end
    return out


#: Labelled documents of each language in the training sample; their whole texts are read.
SAMPLE_ROWS = 500


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS, words: int = 24, sequences: int = 6000, rounds: int = 2) -> Crf:
    """Train on a bounded, stratified sample of labelled rows: of each language the sample_rows of least hash, or all of fewer.

    Rows are first thinned by their hash to about four times as many, by the languages' counts, so that the ranking reads
    a small table whatever the size of docs. Rows without a language or a letter are not used; without any there is no
    language to learn, and the model calls every text `und`. Counts of words and features are over the whole sample; the
    gradient then passes `rounds` times over `sequences` spliced sequences of `words` words.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).cast("string").alias("_l"), F.col(text).alias("_t"), F.xxhash64(F.col(id_col), F.col(text)).alias("_h"))
    counts = rows.groupBy("_l").count().collect()  # a row for each language
    if not counts:
        return train([])
    share = spark.createDataFrame([(r["_l"], -(2.0**63) + 2.0**64 * min(1.0, 4 * sample_rows / r["count"])) for r in counts], "_l string, _most double")
    thin = rows.join(F.broadcast(share), "_l").where(F.col("_h").cast("double") <= F.col("_most"))
    ranked = thin.withColumn("_r", F.row_number().over(Window.partitionBy("_l").orderBy("_h", "_t"))).where(F.col("_r") <= sample_rows)
    return train([(r["_t"], r["_l"]) for r in ranked.select("_l", "_t", "_r").orderBy("_l", "_r").collect()], words, sequences, rounds)


def _label(model: Crf, carry: bool):
    def run(batches):
        for batch in batches:
            for b in sliced(batch, 1024):
                found = predict(model, b.column("_text").to_pylist())
                names = [n for n in b.schema.names if n != "_text" or carry]
                yield pa.record_batch([*[b.column(n) for n in names], pa.array([x for x, _ in found]), pa.array([s for _, s in found], pa.float64())], names=[*names, "lang_pred", "score"])

    return run


def label_languages(docs: DataFrame, model: Crf, text: str = "text", carry_text: bool = False) -> DataFrame:
    """Rows of docs with lang_pred and score; the text itself only with carry_text.

    Whole texts are labelled word by word, a word being a run of letters, with the marks on them, of any length; the model goes to tasks with the code, and its size is fixed by SLOTS.
    Defined results: null texts and such without a letter are `und` with score 0; other rows depend on the text alone,
    so repeated rows and null ids are no special cases; an empty table gives no rows; columns that clash with the result's are left out.
    """
    C.prepare(docs.sparkSession)
    made = {"lang_pred", "score", "_text"}
    keep = [c for c in docs.columns if c.lower() not in made and c.lower() != text.lower()]
    rows = docs.select(*keep, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_text" or carry_text)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = held.value
        C.take_turn("languages", model.forget)
        yield from _label(model, carry_text)(batches)

    out = rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")
    return out.withColumnRenamed("_text", text)


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 3, is 1; a null id isn't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
