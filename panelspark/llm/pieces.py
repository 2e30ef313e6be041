"""SentencePiece BPE ids of whole texts by vectorised merge rounds, and texts of ids."""

from __future__ import annotations

import codecs
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm import _common as C
from panelspark.llm.tokens import sliced

MARK = "▁"  # stands for a space
_NONE = np.iinfo(np.int32).max

codecs.register_error("one-by-one", lambda e: ("�", e.start + 1))


class PieceBpe:
    """Encoder and decoder of a SentencePiece BPE file with byte fallback, a dummy prefix and no normalisation.

    A text is cut where no piece reaches across: before a space mark that follows another character, around line feeds
    if no piece has one, and between characters that stand side by side in no piece. The words so made are encoded
    together as one flat array of symbols. In each round every word finds the least rank among its pairs of neighbours
    (equal scores have equal ranks) and merges the leftmost such pair. All pairs of that rank merge in the same round
    if the merged piece is in no pair of the same or a better rank, so that one after another would give the same.
    Words without a pair are done and leave the arrays. Frequent words are remembered in a bounded table.
    """

    def __init__(self, path: str, remembered: int = 300_000, longest: int = 48):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.normalize("ﬁ  é ") != f"{MARK}ﬁ{MARK}{MARK}é{MARK}":
            raise ValueError("only models that change nothing but spaces, with a dummy prefix, are supported")
        n = self.size = sp.vocab_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        text = [sp.id_to_piece(i) for i in range(n)]
        score = np.array([sp.get_score(i) for i in range(n)])
        own = {x: i for i, x in enumerate(text) if not special[i]}
        if any(sp.is_unused(i) for i in range(n)) or sum(map(sp.is_byte, range(n))) != 256 or any(score[i] >= 0 for x, i in own.items() if len(x) > 1):
            raise ValueError("only BPE models with byte fallback, without unused or user-defined pieces, are supported")
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.uint32)
        alone = sorted({c for x in own for c in x} - own.keys())
        symbol = own | {c: n + k for k, c in enumerate(alone)}
        self.width = n + len(alone)
        self.of_char = np.full(0x110000, -1, np.int32)
        for c in symbol:
            if len(c) == 1:
                self.of_char[ord(c)] = symbol[c]
        self.rank = np.unique(-score, return_inverse=True)[1].astype(np.int32)
        pairs, beside, safe = {}, set(), np.ones(n, bool)
        for x, i in own.items():
            for k in range(1, len(x)):
                a, b = x[:k], x[k:]
                beside.add(int(self.of_char[ord(a[-1])]) * self.width + int(self.of_char[ord(b[0])]))
                if a in symbol and b in symbol:
                    pairs[symbol[a] * self.width + symbol[b]] = i
                    for y in (a, b):
                        if len(y) > 1 and self.rank[i] <= self.rank[symbol[y]]:
                            safe[symbol[y]] = False
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in sorted(pairs)], np.int32)
        self.beside = np.array(sorted(beside), np.int64)
        self.safe = safe
        self.line_feed = not any("\n" in x for x in own)
        if any(MARK in x.lstrip(MARK) for x in own):
            raise ValueError("only models whose pieces have space marks at their beginning are supported")
        # A run of marks grows from its left end, one by one, where runs up to some length are pieces of the worst score
        # and no other piece begins with two marks: a run of that length that two more marks follow is a word of its own.
        runs = {len(x): i for x, i in own.items() if len(x) > 1 and not x.strip(MARK)}
        most = max(runs, default=0)
        greedy = most > 1 and set(runs) == set(range(2, most + 1)) and all(score[i] == score.min() for i in runs.values()) and not any(x.startswith(MARK * 2) and x.strip(MARK) for x in own)
        cut = f"(?<=[^{MARK}])(?={MARK})" + ("|(?<=\n)|(?=\n)" if self.line_feed else "")
        self._cut = re.compile(cut)
        self._run = re.compile(f"(?:{MARK}{{{most}}})(?={MARK}{MARK})") if greedy else None
        self.known: dict[str, bytes] = {}
        self.remembered, self.longest = remembered, longest
        raw = [b"" if sp.is_control(i) else bytes([int(x[3:5], 16)]) if sp.is_byte(i) else " ⁇ ".encode() if sp.is_unknown(i) else x.replace(MARK, " ").encode() for i, x in enumerate(text)]
        self.raw, self._control = raw, [sp.is_control(i) for i in range(n)]
        self._marked = [x.startswith(MARK) and not s for x, s in zip(text, special, strict=True)]

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Piece of each pair of symbols, -1 where there is none."""
        key = a.astype(np.int64) * self.width + b
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[k] == key) & (a >= 0) & (b >= 0), self.made[k], -1).astype(np.int32)

    def _ranked(self, piece: np.ndarray) -> np.ndarray:
        return np.where(piece >= 0, self.rank[piece], _NONE)

    def merge(self, chars: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """chars: code points of words laid end to end; begins: where each word begins. Gives symbols and their places."""
        first = self.of_char[chars]
        out, live = first.copy(), np.ones(len(chars), bool)
        if len(chars) < 2:
            return out, np.flatnonzero(live)
        key = first[:-1].astype(np.int64) * self.width + first[1:]
        k = np.minimum(np.searchsorted(self.beside, key), len(self.beside) - 1)
        new = np.ones(len(chars), bool)
        new[1:] = (self.beside[k] != key) | (first[:-1] < 0) | (first[1:] < 0)
        new[begins] = True
        word = np.cumsum(new) - 1
        held = np.repeat(np.diff(np.append(np.flatnonzero(new), len(chars))) > 1, np.diff(np.append(np.flatnonzero(new), len(chars))))
        at, sym, word = np.flatnonzero(held), first[held], word[held]
        piece = np.full(len(sym), -1, np.int32)
        if len(sym):
            piece[:-1] = np.where(word[1:] == word[:-1], self._pair(sym[:-1], sym[1:]), -1)
        rank = self._ranked(piece)
        while len(sym):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(starts, len(sym)))
            least = np.minimum.reduceat(rank, starts)
            if (least == _NONE).any():  # these words are done
                go = np.repeat(least != _NONE, sizes)
                out[at[~go]] = sym[~go]
                at, sym, word, piece, rank = at[go], sym[go], word[go], piece[go], rank[go]
                sizes, least = sizes[least != _NONE], least[least != _NONE]
                if not len(sym):
                    break
            c = np.flatnonzero(rank == np.repeat(least, sizes))
            leftmost = np.append(True, word[c[1:]] != word[c[:-1]])
            run = np.append(True, c[1:] != c[:-1] + 1) | leftmost
            place = np.arange(len(c))
            even = (place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0
            t = c[leftmost | (even & self.safe[piece[c]])]
            sym[t] = piece[t]
            live[at[t + 1]] = False
            stay = np.ones(len(sym), bool)
            stay[t + 1] = False
            at, sym, word, piece, rank = at[stay], sym[stay], word[stay], piece[stay], rank[stay]
            t = t - np.arange(len(t))
            for i in (t, t[t > 0] - 1):  # pairs that the merged symbols begin or end
                ends = (i + 1 >= len(sym)) | (word[np.minimum(i + 1, len(sym) - 1)] != word[i])
                piece[i] = np.where(ends, -1, self._pair(sym[i], sym[np.minimum(i + 1, len(sym) - 1)]))
                rank[i] = self._ranked(piece[i])
        places = np.flatnonzero(live)
        return out[places], places

    def _encode(self, words: list[str]) -> list[bytes]:
        """Ids of words, each as little-endian uint32 bytes."""
        chars = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        ends = np.cumsum([len(x) for x in words])
        sym, places = self.merge(chars, ends - [len(x) for x in words])
        count = np.ones(len(sym), np.int64)
        lost = np.flatnonzero((sym < 0) | (sym >= self.size))  # characters that are no pieces: their UTF-8 bytes
        if len(lost):
            code = chars[places[lost]]
            count[lost] = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        ids = np.repeat(sym, count).astype("<u4")
        if len(lost):
            byte = np.frombuffer(code.tobytes().decode("utf-32-le").encode(), np.uint8)
            ids[np.repeat(np.isin(np.arange(len(sym)), lost), count)] = self.byte[byte]
        upto = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(places, np.concatenate([[0], ends]))] * 4
        whole = ids.tobytes()
        return [whole[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        x = MARK + text.replace(" ", MARK)
        if "\0" in x or MARK * 2 in x:
            if self._run is not None and MARK * 20 in x:  # long runs of spaces
                cut, at = [], 0
                for m in self._run.finditer(x):
                    cut += [x[at : m.start()], m[0]]
                    at = m.end()
                return [w for y in [*cut, x[at:]] if y for w in self._cut.split(y) if w]
            return [w for w in self._cut.split(x) if w]
        x = x.replace(MARK, "\0" + MARK)
        return [w for w in (x.replace("\n", "\0\n\0") if self.line_feed else x).split("\0") if w]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes; null is the empty text."""
        known = self.known
        cut = [self.words(x or "") for x in texts]
        new = list(set().union(*cut).difference(known))
        at = 0
        while at < len(new):
            k, room = at, 1 << 20
            while k < len(new) and (k == at or room > 0):
                room -= len(new[k])
                k += 1
            known.update(zip(new[at:k], self._encode(new[at:k]), strict=True))
            at = k
        out = [b"".join(map(known.__getitem__, w)) for w in cut]
        short = [x for x in new if len(x) <= self.longest]
        for x in [*(x for x in new if len(x) > self.longest), *short[max(0, self.remembered - len(known) + len(new)) :]]:
            del known[x]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces and bytes end to end, without the dummy prefix; bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        lead = next((i for i in ids if not self._control[i]), None)
        return (raw[1:] if lead is not None and self._marked[lead] else raw).decode("utf-8", "one-by-one")


_LOADED: dict[str, PieceBpe] = {}


def tokenizer(path: str) -> PieceBpe:
    """One encoder for each file and worker process."""
    C.take_turn("pieces", _LOADED.clear)
    if path not in _LOADED:
        _LOADED[path] = PieceBpe(path)
    return _LOADED[path]


def _run(path: str, keep: list[str], decode: bool):
    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            for b in sliced(batch, 256):
                ids = bpe.encode(b.column("_text").to_pylist())
                flat = np.frombuffer(b"".join(ids), "<i4")
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])])
                columns = [*[b.column(c) for c in keep], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))]
                if decode:
                    columns.append(pa.array([bpe.decode(flat[x:y].tolist()) for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.string()))
                yield pa.record_batch(columns, names=[*keep, "ids", *["decoded"] * decode])

    return run


def encode_pieces(docs: DataFrame, model_path: str, text: str = "text", decode: bool = False) -> DataFrame:
    """Rows of docs with `ids` (array<int>), the ids that the sentencepiece library gives for the whole text without
    begin or end ids; with decode also `decoded`, the text of those ids. The text itself is not carried.

    Rows stay in their partitions: nothing is shuffled. Defined results: a null or empty text has no ids and decodes to
    the empty text; null ids, ties and repeated rows are rows like others; an empty table gives no rows; columns of docs
    with the names made here are replaced, all others stay. Characters outside the vocabulary become their UTF-8 bytes.
    """
    C.prepare(docs.sparkSession)
    made = {"ids", "decoded"} if decode else {"ids"}
    keep = [c for c in docs.columns if c.lower() not in made | {text.lower()}]
    own = {f"_c{k}": c for k, c in enumerate(keep)}
    rows = docs.select(*[F.col(c).alias(k) for k, c in own.items()], F.col(text).alias("_text"))
    fields = [f"{k} {rows.schema[k].dataType.simpleString()}" for k in own]
    out = rows.mapInArrow(_run(model_path, list(own), decode), ", ".join([*fields, "ids array<int>", *["decoded string"] * decode]))
    return out.select(*[F.col(k).alias(c) for k, c in own.items()], "ids", *["decoded"] * decode)
