"""Token ids of whole texts, and counts of them behind a digest cache."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import _common as C

_BLANK = frozenset(" \n\r\t")
#: A mark after a letter is a piece of its own: none of these begins a contraction.
_MARKS = frozenset(".,;:!?")
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_BREAK = re.compile(r"(?<=\S)(?=[ \n\r\t])")


class ByteBpe:
    """Ids of a byte-level BPE file as the tokenizers library gives them, with a bounded memory of frequent words.

    Byte-level pre-tokenisation always ends a piece where white space follows another character, so a text's ids are
    those of its parts cut there, one after another. Parts met before come from a dictionary; the others of a batch are
    encoded together, and their shares of the ids are told by the tokens' byte lengths.
    """

    def __init__(self, path: str, remembered: int = 400_000, longest: int = 48):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["pre_tokenizer"].get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer") or spec.get("post_processor"):
            raise ValueError("only plain byte-level BPE files can be cut at white space")
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if any(re.search(r"\s", x) for x in added):
            raise ValueError("added tokens with white space can't be cut at white space")
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.width[i] = len(token.encode()) if token in added else len(token)
        self.known: dict[str, bytes] = {}
        self.remembered, self.longest = remembered, longest

    def _encode(self, parts: list[str]) -> list[bytes]:
        """Ids of parts that are cut at white space, each as little-endian uint32 bytes."""
        spaced = [x if x[0] in _BLANK else "\n" + x for x in parts]
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(spaced)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(list(map(len, map(str.encode, spaced)))), "left") + 1
        starts = np.concatenate([[0], ends[:-1]]) + [x is not y for x, y in zip(spaced, parts, strict=True)]
        whole = ids.tobytes()
        return [whole[a:b] for a, b in zip((starts * 4).tolist(), (ends * 4).tolist(), strict=True)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes; null is the empty text."""
        known = self.known
        cut = [[] if not x else _BREAK.split(x) if "\0" in x else x.replace("\n", "\0\n").replace(" ", "\0 ").split("\0") for x in texts]
        new = set().union(*cut).difference(known)
        # no known part ends in white space, so a part that does, and can't be cut off, is among the new ones
        if blank := {x for x in new if x[-1:].isspace()}:
            cut = [p if blank.isdisjoint(p) else _BREAK.split(x) for x, p in zip(texts, cut, strict=True)]
            new = set().union(*cut).difference(known)
        ended = [x for x in new if x[-1:] in _MARKS and x[-2:-1] in _LETTERS]
        new.difference_update(ended)
        new.update([y for x in ended for y in (x[:-1], x[-1]) if y not in known])
        short = [x for x in new if x and len(x) <= self.longest and not x[-1].isspace()]
        for k in range(0, len(short), 2000):
            known.update(zip(short[k : k + 2000], self._encode(short[k : k + 2000]), strict=True))
        if rest := list(new.difference(known)):
            for x, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
                known[x] = np.array(e.ids, "<u4").tobytes()
        for x in ended:
            known[x] = known[x[:-1]] + known[x[-1]]
        out = [b"".join(map(known.__getitem__, p)) for p in cut]
        for x in [*rest, *(x for x in ended if len(x) > self.longest)]:
            del known[x]
        kept = [*short, *(x for x in ended if len(x) <= self.longest)]
        for x in kept[max(0, self.remembered - len(known) + len(kept)) :]:
            del known[x]
        return out


_LOADED: dict[str, ByteBpe] = {}


def tokenizer(path: str) -> ByteBpe:
    """One encoder for each file and worker process."""
    C.take_turn("tokens", _LOADED.clear)
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def sliced(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def tokenizer_version(path: str) -> str:
    """SHA-256 of the tokenizer file."""
    import hashlib

    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _count(path: str):
    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            for b in sliced(batch):
                n = [len(x) // 4 for x in bpe.encode(b.column("_text").to_pylist())]
                yield pa.record_batch([b.column("content_digest"), pa.array(n, pa.int64())], names=["content_digest", "n_tokens"])

    return run


_CACHE = "content_digest binary, n_tokens bigint, tokenizer_version string"


@dataclass
class DigestCache:
    """Stored counts by (content digest, tokenizer version): a folder with one Parquet table for each run that added to it.

    A run writes a folder of its own and is read once that is whole (has its _SUCCESS), so a job that failed half way
    leaves nothing behind. Runs that added the same content at one time do no harm: a key is read once.
    """

    spark: SparkSession
    path: str

    def _runs(self) -> list[str]:
        fs, _ = C.file_system(self.spark, self.path)
        done = fs.globStatus(C.hadoop_path(self.spark, f"{self.path}/run-*/_SUCCESS"))
        return [x.getPath().getParent().toString() for x in done or []]

    def _read(self, runs: list[str]) -> DataFrame:
        return self.spark.read.schema(_CACHE).parquet(*runs) if runs else self.spark.createDataFrame([], _CACHE)

    def counts(self, version: str, asked: DataFrame | None = None) -> DataFrame:
        """(content_digest, n_tokens), each digest once: of all contents, or of those whose digests `asked` has."""
        stored = self._read(self._runs()).where(F.col("tokenizer_version") == version)
        if asked is not None:
            stored = stored.join(asked.select("content_digest"), "content_digest", "left_semi")
        return stored.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))

    def compact(self) -> None:
        """Make one run of all. The old ones go once the new one is whole; no other job may read the cache meanwhile."""
        runs = self._runs()
        if len(runs) > 1:
            whole = self._read(runs).groupBy("content_digest", "tokenizer_version").agg(F.max("n_tokens").alias("n_tokens"))
            whole.select("content_digest", "n_tokens", "tokenizer_version").write.parquet(f"{self.path}/run-{uuid.uuid4().hex}")
            for run in runs:
                fs, path = C.file_system(self.spark, run)
                fs.delete(path, True)

    def append(self, counted: DataFrame, version: str) -> None:
        counted.withColumn("tokenizer_version", F.lit(version)).write.parquet(f"{self.path}/run-{uuid.uuid4().hex}")


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, text: str = "text", id_col: str = "doc_id", limit: int = 512) -> DataFrame:
    """Rows of docs with n_bytes, n_tokens and over_limit (n_tokens > limit).

    Counts live in a DigestCache keyed by (SHA-256 of the content, tokenizer version). Content is the text with null as
    the empty one, nothing else, as every byte counts. Distinct contents that the cache lacks for this version are encoded
    once and appended; then all rows take their counts from it. cache_path: a cache of earlier runs, made if absent;
    None: a new one. If nothing is missing, no text is moved and nothing is written.

    One row of each missing content carries its text to the encoders, found by small aggregates of digests: the one of
    the least id among ids that have the content once. Texts meet it in a join on (id, digest), so a content with very many
    copies is no hot key. Only contents that no id has once (repeated rows, null ids) are told apart further, by an
    aggregate of one text for each digest. The built side of the join has digests and ids only. Of the cache, only what is
    asked for is read on. Defined results: null text counts 0 bytes and 0 tokens; null ids and repeated rows are rows like
    others; empty table: no rows; of further columns only those of docs that don't clash with the result's names or with
    `_digest` and `content_digest` stay.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    version = tokenizer_version(tokenizer_path)
    cache = DigestCache(spark, cache_path or C.scratch_path(spark, "token-cache"))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("content_digest", C.sha256(F.col("_text")))
    each = rows.groupBy("content_digest", "_id").agg(F.count(F.lit(1)).alias("n")).groupBy("content_digest").agg(F.min(F.struct("n", "_id")).alias("o"))
    asked = C.materialise(each.select("content_digest", "o.n", "o._id"), "token-asked")
    missing = C.materialise(asked.join(cache.counts(version, asked).select("content_digest"), "content_digest", "left_anti"), "token-misses")
    have = {bool(r["more"]) for r in missing.select((F.col("n") > 1).alias("more")).distinct().collect()}
    if have:
        a, b = rows.alias("a"), missing.alias("b")
        texts = a.join(b, (F.col("a._id").eqNullSafe(F.col("b._id"))) & (F.col("a.content_digest") == F.col("b.content_digest"))).select("a.content_digest", "a._text", "b.n")
        once = texts.where("n = 1").select("content_digest", "_text")
        if True in have:
            again = texts.where("n > 1").groupBy("content_digest").agg(F.first("_text").alias("_text"))
            once = once.unionByName(again) if False in have else again
        cache.append(once.mapInArrow(_count(tokenizer_path), "content_digest binary, n_tokens bigint"), version)
    stored = C.materialise(cache.counts(version, asked), "token-counts")  # a table, so that the join of a content's copies can be split
    C.discard(missing, asked)
    made = ("n_bytes", "n_tokens", "over_limit")
    keep = [c for c in docs.columns if c.lower() not in (*made, "_digest", "content_digest")]
    out = docs.select(*keep, F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"), C.sha256(F.coalesce(F.col(text), F.lit(""))).alias("_digest"))
    joined = out.join(stored, out["_digest"] == stored["content_digest"], "left")
    return joined.select(*[out[c] for c in keep], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
