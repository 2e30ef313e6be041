"""Line deduplication over whole corpora: sorted hashes in, keep bitmaps out."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm import _common as C
from panelspark.llm.tokens import sliced

_STRIP = b" \t\n\x0b\x0c\r"
_DOC = ["_null", "_doc", "_text_hash"]
_DOC_TYPES = "_null boolean, _doc bigint, _text_hash bigint"
_LINE = ["h1", "h2", *_DOC, "pos"]
DROP, PENDING, MARK = 0, 1, 2


def _with_key(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """A document is its id and text: rows equal in both are one document."""
    return docs.withColumns({
        "_null": F.col(id_col).isNull(),
        "_doc": F.coalesce(F.col(id_col).cast("bigint"), F.lit(0)),
        "_text_hash": F.xxhash64(F.coalesce(F.col(text), F.lit(""))),
        "_text": F.coalesce(F.col(text), F.lit("")),
    })


def _nothing() -> None:
    """Tasks here remember no words."""


def _line_keys(shortest: int):
    def run(batches):
        import xxhash

        C.take_turn("lines", _nothing)
        for batch in batches:
            for b in sliced(batch, 2048):
                digests, counts, where = [], [], []
                for text in b.column("_text").cast(pa.binary()).to_pylist():
                    keys = [x.strip(_STRIP).lower() for x in text.split(b"\n")]
                    kept = [k for k, x in enumerate(keys) if x and (shortest <= 1 or len(x.decode("utf-8", "replace")) >= shortest)]
                    digests.extend(xxhash.xxh3_128_digest(keys[k]) for k in kept)
                    counts.append(len(kept))
                    where.extend(kept)
                h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                doc = np.repeat(np.arange(b.num_rows), counts)
                yield pa.record_batch([pa.array(h[:, 0]), pa.array(h[:, 1]), *[b.column(c).take(pa.array(doc)) for c in _DOC], pa.array(np.array(where, np.int32))], names=_LINE)

    return run


def _runs(min_docs: int, keep_first: bool):
    """Streams sorted lines. A run is the lines of one hash in this partition; while it is open and short of min_docs
    documents its rows wait (fewer than min_docs documents), afterwards they are decided as they come. The first and the
    last run may go on in neighbouring partitions: they leave a MARK with their documents, and what is undecided is
    PENDING."""

    def run(batches):
        part = TaskContext.get().partitionId()
        waiting: pa.Table | None = None
        open_docs, open_rows, first_run = 0, 0, True  # of the open run: documents and rows already let go
        last_doc = None

        def rows(t: pa.Table, take: np.ndarray, kind: int, first: np.ndarray | None = None, n: int = 0):
            s = t.take(pa.array(np.flatnonzero(take)))
            k = s.num_rows
            f = first[take] if first is not None else np.zeros(k, bool)
            return pa.record_batch([pa.array(np.full(k, kind, np.int8)), pa.array(np.full(k, part, np.int32)), *[s.column(c).combine_chunks() for c in _LINE], pa.array(f), pa.array(np.full(k, n, np.int64))], names=["kind", "part", *_LINE, "is_first", "n_docs"])

        def settle(t: pa.Table, final: bool):
            nonlocal waiting, open_docs, open_rows, first_run, last_doc
            n = t.num_rows
            cols = [t.column(c).to_numpy() for c in _LINE]
            new_run = np.ones(n, bool)
            new_run[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
            new_doc = new_run.copy()
            for c in cols[2:5]:
                new_doc[1:] |= c[1:] != c[:-1]
            begun = open_rows > 0  # the first run of t goes on from rows let go before
            if begun:
                new_doc[0] = (cols[2][0], cols[3][0], cols[4][0]) != last_doc
            starts = np.flatnonzero(new_run)
            docs = np.add.reduceat(new_doc.astype(np.int64), starts)
            if begun:
                docs[0] += open_docs
            lengths = np.diff(np.append(starts, n))
            run_of = np.repeat(np.arange(len(starts)), lengths)
            many = docs[run_of] >= min_docs
            first = new_run.copy()
            if begun:
                first[0] = False
            edge = np.zeros(len(starts), bool)
            edge[0] = first_run
            if final:
                edge[-1] = True
            closed = np.ones(len(starts), bool)
            closed[-1] = final
            undecided = (edge[run_of] & (~many | (first & keep_first))) & closed[run_of]
            drop = many & ~undecided & ~(first & keep_first) & closed[run_of]
            opened = ~closed[run_of]
            if opened.any() and docs[-1] >= min_docs:
                is_edge = edge[-1]
                hold_first = first & keep_first & opened
                drop |= opened & ~hold_first
                if is_edge and hold_first.any():
                    yield rows(t, hold_first, PENDING, first)
                open_docs, open_rows = int(docs[-1]), (open_rows if begun and len(starts) == 1 else 0) + int(opened.sum())
                last_doc = tuple(c[-1] for c in cols[2:5])
                waiting = t.slice(0, 0)
                last_key = t.slice(n - 1, 1)
            else:
                if opened.any():
                    waiting, open_docs, open_rows = t.slice(int(starts[-1])), (open_docs if begun and len(starts) == 1 else 0), (open_rows if begun and len(starts) == 1 else 0)
                last_key = None
            if drop.any():
                yield rows(t, drop, DROP)
            if undecided.any():
                yield rows(t, undecided, PENDING, first)
            for k in np.flatnonzero(edge & closed):
                mark = np.zeros(n, bool)
                mark[starts[k]] = True
                yield rows(t, mark, MARK, None, int(docs[k]))
            if closed[0]:
                first_run = False
            self_key[0] = last_key

        self_key: list = [None]  # a row of the open run when its rows were let go
        seen = None  # the last row: rows of repeated documents come next to each other
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if t.num_rows == 0:
                continue
            fresh = np.zeros(t.num_rows, bool)
            for c in _LINE:
                x = t.column(c).to_numpy()
                fresh[1:] |= x[1:] != x[:-1]
            now = tuple(t.column(c)[0].as_py() for c in _LINE)
            fresh[0], seen = now != seen, tuple(t.column(c)[-1].as_py() for c in _LINE)
            if not fresh.all():
                t = t.filter(pa.array(fresh))
                if t.num_rows == 0:
                    continue
            if open_rows:
                k = self_key[0]
                same = t.column("h1")[0] == k.column("h1")[0] and t.column("h2")[0] == k.column("h2")[0]
                if not same:  # the open run ended with the last batch
                    if first_run:
                        yield rows(k, np.ones(1, bool), MARK, None, open_docs)
                    open_docs = open_rows = 0
                    first_run = False
            if waiting is not None and waiting.num_rows:
                t = pa.concat_tables([waiting, t])
            waiting = None
            yield from settle(t.combine_chunks(), False)
        if waiting is not None and waiting.num_rows:
            yield from settle(waiting.combine_chunks(), True)
        elif open_rows:
            yield rows(self_key[0], np.ones(1, bool), MARK, None, open_docs)

    return run


def _bitmaps(batches):
    for batch in batches:
        maps = []
        for n, drop in zip(batch.column("n_lines").to_pylist(), batch.column("dropped").to_pylist(), strict=True):
            keep = np.ones(-(-n // 8) * 8, bool)  # bits past the last dropped line are set
            keep[drop] = False
            maps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes()))
        yield pa.record_batch([*[batch.column(c) for c in _DOC], pa.array(maps, pa.binary())], names=[*_DOC, "keep_bitmap"])


def line_bitmaps(docs: DataFrame, min_docs: int = 10, shortest: int = 1, keep_first: bool = False, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Documents that lose lines: their key, and a zlib-compressed bitmap of the lines that stay (bit k of byte k // 8).

    Lines are compared by their key: white space stripped at both ends, A-Z in lower case; keys of fewer than `shortest`
    code points never match. Keys found in at least min_docs documents lose their lines in every document; with
    keep_first the first line in the order of (id, text hash, position) stays.

    128-bit key hashes are range-partitioned by (hash, document), so that a line of very many documents is spread over
    partitions, sorted by document and position, and streamed; a task holds fewer than min_docs documents of one run.
    Runs at the ends of partitions are settled by a small join of their counts.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    keyed = _with_key(docs.select(text, id_col), text, id_col).select(*_DOC, "_text")
    lines = keyed.mapInArrow(_line_keys(shortest), f"h1 bigint, h2 bigint, {_DOC_TYPES}, pos int")
    ordered = lines.repartitionByRange(C.partitions(spark), "h1", "h2", *_DOC).sortWithinPartitions(*_LINE)
    decided = C.materialise(ordered.mapInArrow(_runs(min_docs, keep_first), f"kind tinyint, part int, h1 bigint, h2 bigint, {_DOC_TYPES}, pos int, is_first boolean, n_docs bigint"), "line-runs")
    totals = decided.where(F.col("kind") == MARK).groupBy("h1", "h2").agg(F.sum("n_docs").alias("total"), F.min("part").alias("first_part"))
    pending = decided.where(F.col("kind") == PENDING).join(totals, ["h1", "h2"]).where(F.col("total") >= min_docs)
    if keep_first:
        pending = pending.where(~(F.col("is_first") & (F.col("part") == F.col("first_part"))))
    drops = decided.where(F.col("kind") == DROP).select(*_DOC, "pos").unionByName(pending.select(*_DOC, "pos"))
    by_doc = drops.groupBy(*_DOC).agg(F.collect_set("pos").alias("dropped"))
    # a bitmap ends with the byte of the last dropped line; later lines stay
    by_doc = by_doc.withColumn("n_lines", F.array_max("dropped") + 1)
    return by_doc.mapInArrow(_bitmaps, f"{_DOC_TYPES}, keep_bitmap binary")


def _apply(batches):
    for batch in batches:
        for b in sliced(batch, 1024):
            texts, lines, dropped = [], [], []
            for text, bitmap in zip(b.column("_text").cast(pa.binary()).to_pylist(), b.column("keep_bitmap").to_pylist(), strict=True):
                parts = text.split(b"\n")
                lines.append(len(parts))
                if bitmap is None:
                    texts.append(text)
                    dropped.append(0)
                    continue
                bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little").astype(bool).tolist()
                kept = [x for k, x in enumerate(parts) if k >= len(bits) or bits[k]]
                texts.append(b"\n".join(kept))
                dropped.append(len(parts) - len(kept))
            arrays = [c for name, c in zip(b.schema.names, b.columns, strict=True) if name not in ("_text", "keep_bitmap")]
            names = [n for n in b.schema.names if n not in ("_text", "keep_bitmap")]
            yield pa.record_batch([*arrays, pa.array(texts, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=[*names, "kept_text", "n_lines", "n_dropped"])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows of docs (without the text and columns that clash) with kept_text, n_lines (before dropping) and n_dropped."""
    made = {"kept_text", "n_lines", "n_dropped", "keep_bitmap", "_text", *_DOC}
    keep = [c for c in docs.columns if c.lower() not in made and c.lower() != text.lower()]
    rows = _with_key(docs, text, id_col).select(*keep, *_DOC, "_text")
    joined = rows.join(bitmaps.hint("shuffle_hash"), _DOC, "left").select(*keep, "_text", "keep_bitmap")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields if f.name in keep)
    return joined.mapInArrow(_apply, f"{kinds}, kept_text string, n_lines bigint, n_dropped bigint")


def dedup_lines(docs: DataFrame, min_docs: int = 10, shortest: int = 1, keep_first: bool = False, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """`line_bitmaps` applied to the same docs.

    Defined results: null or empty text is one empty line, which has no key and stays; null ids: rows with a null id are
    told apart by their texts; rows equal in id and text are one document and get the same result each; ties keep the
    order of position; an empty table gives no rows; columns of docs that clash with the made ones are left out.
    """
    return apply_bitmaps(docs, line_bitmaps(docs, min_docs, shortest, keep_first, text, id_col), text, id_col)
