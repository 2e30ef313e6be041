"""Packing of documents into training sequences by the sum-of-squares rule."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm import _common as C
from panelspark.llm.tokens import sliced, tokenizer

ID_BYTES = 4


class SumOfSquares:
    """Online packing into windows of `capacity` tokens.

    level[h] counts the partially filled windows that hold h tokens. A piece of s tokens goes to the level h (0: a new
    window) for which the sum of level[h]**2 over all partial fills becomes least; of equal ones the fullest. Whole
    windows of long documents close at once. `finish` empties the emptiest windows into the fullest, cutting pieces, so
    that at most one window stays short.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.level = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[list]] = {}  # fill -> windows, each a list of pieces

    def place(self, piece, size: int) -> list | None:
        """piece: (key, start, ids). Gives the window if the piece filled it."""
        top = self.capacity - size
        fills = np.flatnonzero(self.level[1 : top + 1]) + 1
        best, where = 2 * self.level[size] + 1, 0
        if len(fills):
            after = self.level[fills + size]
            change = np.where(fills == top, 1 - 2 * self.level[fills], 2 - 2 * self.level[fills] + 2 * after)
            k = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[k] <= best:
                where = int(fills[k])
        window: list = []
        if where:
            window = self.open[where].pop()
            self.level[where] -= 1
        window.append(piece)
        if where + size == self.capacity:
            return window
        self.open.setdefault(where + size, []).append(window)
        self.level[where + size] += 1
        return None

    def finish(self) -> list[list]:
        left = [(h, w) for h in sorted(self.open, reverse=True) for w in self.open[h]]
        windows, i, j = [w for _, w in left], 0, len(left) - 1
        fills = [h for h, _ in left]
        while i < j:
            gap = self.capacity - fills[i]
            if not gap:
                i += 1
                continue
            key, start, ids = windows[j].pop()
            size = len(ids) // ID_BYTES
            take = min(gap, size)
            if take < size:
                windows[j].append((key, start + take, ids[take * ID_BYTES :]))
            windows[i].append((key, start, ids[: take * ID_BYTES]))
            fills[i] += take
            fills[j] -= take
            j -= not fills[j]
        self.open, self.level[:] = {}, 0
        return [w for w, h in zip(windows, fills, strict=True) if h]


def _pack(path: str, window: int, separator: int, doc_type: pa.DataType):
    end = np.array([separator], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        bpe, packer = tokenizer(path), SumOfSquares(window)
        made, out = TaskContext.get().partitionId() << 32, []

        def close(pieces):
            nonlocal made
            at = 0
            for (doc, total), start, ids in pieces:
                n = len(ids) // ID_BYTES
                out.append((doc, start, n, ids, total, made, at))
                at += n
            made += 1

        def flush():
            cols = list(zip(*out, strict=True))
            kinds = [doc_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            out.clear()
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            for b in sliced(batch):
                for doc, ids in zip(b.column(0).to_pylist(), bpe.encode(b.column(1).to_pylist()), strict=True):
                    ids += end
                    total = len(ids) // ID_BYTES
                    whole = total - total % window
                    for k in range(0, whole, window):
                        close([((doc, total), k, ids[k * ID_BYTES : (k + window) * ID_BYTES])])
                    if whole < total and (full := packer.place(((doc, total), whole, ids[whole * ID_BYTES :]), total - whole)):
                        close(full)
                if len(out) >= 2000:
                    yield flush()
        for pieces in packer.finish():
            close(pieces)
        if out:
            yield flush()

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = 1024, separator: int = 0, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    Every document's ids, ended by `separator`, are cut into whole windows and a rest; rests are placed by the
    sum-of-squares rule. Each task packs the documents of its own input partition as it reads them, so nothing is
    shuffled and memory holds only the partly filled windows; each task leaves at most one short sequence. A sequence id
    is the partition's number times 2**32 plus a count, so a task that runs again gives the same ids.

    Defined results: null text is the empty one (just the separator); null ids and repeated rows are packed like
    others; very long texts span many sequences; an empty table gives no rows; other columns of docs are not read.
    """
    C.prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("_text"))
    kind = rows.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    return rows.mapInArrow(_pack(tokenizer_path, window, separator, to_arrow_type(kind)), f"doc_id {kind.simpleString()}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
