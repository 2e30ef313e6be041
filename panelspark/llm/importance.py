"""Importance resampling of documents toward a target distribution, with an exact cutoff found in a quantile bracket."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm import _common as C
from panelspark.llm.tokens import sliced

#: Bytes of words: digits, letters (capitals as small ones) and all bytes of characters beyond ASCII; others are spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Margins around the wanted quantile, in units of the sketch's error; the last bracket has every row.
_MARGINS = (2, 16, 128, 1024)


def _features(text: str | None, longest: int) -> tuple[int, list[bytes]]:
    """Number of words, and all runs of 1 to `longest` words joined by one space."""
    words = text.encode().translate(_FOLD).split() if text else []
    runs = [[b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] for n in range(2, longest + 1)]
    return len(words), [*words, *chain(*runs)] if runs else words


def _count(longest: int, buckets: int):
    """One row for each task: its features by bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for b in sliced(batch, 256):
                seen = Counter()
                for x in b.column("_text").to_pylist():
                    seen.update(_features(x, longest)[1])
                if seen:
                    np.add.at(total, np.fromiter(map(zlib.crc32, seen), np.int64, len(seen)) % buckets, np.fromiter(seen.values(), np.int64, len(seen)))
        if total.any():
            yield pa.record_batch([pa.array([total], pa.list_(pa.int64()))], names=["counts"])

    return run


def bucket_counts(texts: DataFrame, text: str = "text", longest: int = 1, buckets: int = 10000) -> list[int]:
    """Features of all texts in each bucket; only sums of a fixed number of buckets come to the driver."""
    C.prepare(texts.sparkSession)
    each = texts.select(F.col(text).alias("_text")).mapInArrow(_count(longest, buckets), "counts array<bigint>")
    sums = each.select(F.posexplode("counts").alias("bucket", "n")).where("n > 0").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = [0] * buckets
    for r in sums.collect():
        out[r.bucket] = r.n
    return out


def bucket_gains(corpus: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln of target share over corpus share) of each bucket, both with one feature added to each bucket."""
    n, s, t = len(corpus), float(sum(corpus)), float(sum(target))
    return [math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(corpus, target, strict=True)]


def _score(longest: int, buckets: int, keep: list[str], gains):
    def run(batches):
        gain = np.array(gains.value, np.int64)
        for batch in batches:
            for b in sliced(batch, 256):
                words, all_features = zip(*(_features(x, longest) for x in b.column("_text").to_pylist()), strict=True)
                flat = list(chain.from_iterable(all_features))
                own = set(flat)
                known = dict(zip(own, gain[np.fromiter(map(zlib.crc32, own), np.int64, len(own)) % buckets].tolist(), strict=True))
                upto = np.concatenate([[0], np.cumsum(np.fromiter(map(known.__getitem__, flat), np.int64, len(flat)))])
                n = np.array([len(x) for x in all_features], np.int64)
                ends = np.cumsum(n)
                yield pa.record_batch([*(b.column(c) for c in keep), pa.array(words, pa.int64()), pa.array(n), pa.array(upto[ends] - upto[ends - n])], names=[*keep, "n_words", "n_features", "weight"])

    return run


def gumbel(id_col: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of SHA-256 of 'seed:id'; a null id counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def quantile_bracket(scored: DataFrame, k: int, n: int, score: str = "score", accuracy: int = 10000) -> tuple[int, int, int]:
    """(low, high, above): scores between which the k-th largest of n lies, and how many are above high.

    Ends come from one quantile sketch. How many scores lie above and within is then counted exactly: a bracket that
    misses the k-th is widened and counted again, up to all scores.
    """
    at, points = 1 - k / n, []
    for m in _MARGINS:
        points += [max(0.0, at - m / accuracy), min(1.0, at + m / accuracy)]
    ends = scored.agg(F.percentile_approx(score, F.array(*map(F.lit, [*points, 0.0, 1.0])), F.lit(accuracy)).alias("q"), F.min(score).alias("lo"), F.max(score).alias("hi")).first()
    for low, high in [*zip(ends.q[:-2:2], ends.q[1:-2:2], strict=True), (ends.lo, ends.hi)]:
        c = scored.agg(F.count_if(F.col(score) > high).alias("above"), F.count_if(F.col(score).between(low, high)).alias("within")).first()
        if c.above <= k <= c.above + c.within:
            return low, high, c.above
    raise AssertionError("the last bracket has every row")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = 10000, seed: int = 2024, text: str = "text", id_col: str = "doc_id", columns: tuple[str, ...] = (), accuracy: int = 10000) -> DataFrame:
    """A row for each document: its id, the `columns` asked for, n_words, n_features, weight, score, and rank if drawn.

    Words are runs of digits, letters and characters beyond ASCII, capitals A-Z lowered. Features, the runs of 1 to
    `longest` words, fall into hashed buckets; a document's weight is the sum of its features' log ratios of target and
    corpus, its score adds Gumbel noise that depends on seed and id alone. floor(percent N / 100) of the N documents with
    `least_words` words or more are drawn without replacement by highest score, ties to the smaller id.

    Two passes over the texts (counts, then weights from the array of gains) shuffle sums of buckets only. The cutoff is
    located in a bracket of scores (quantile_bracket): only its rows are sorted for it, by ranges over all tasks. Drawn
    rows above the bracket are numbered in the same way for their ranks. Defined results: null texts have no words; null
    ids come after all others among ties; repeated rows are rows like others, and as many as the share says are drawn of
    rows equal in score and id; an empty table gives no rows and an empty target the negative logarithms alone; no
    other columns of docs are carried, so none can clash.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    gains = bucket_gains(bucket_counts(docs, text, longest, buckets), bucket_counts(target, text, longest, buckets))
    keep = {"_id": id_col} | {f"_c{k}": c for k, c in enumerate(columns)}
    rows = docs.select(*[F.col(c).alias(k) for k, c in keep.items()], F.col(text).alias("_text"))
    fields = [f"{k} {rows.schema[k].dataType.simpleString()}" for k in keep]
    weighed = rows.mapInArrow(_score(longest, buckets, list(keep), spark.sparkContext.broadcast(gains)), ", ".join([*fields, "n_words bigint, n_features bigint, weight bigint"]))
    scored = C.materialise(weighed.withColumn("score", F.col("weight") + gumbel(F.col("_id"), seed)), "scored")
    eligible = F.col("n_words") >= least_words
    n = scored.where(eligible).count()
    k = percent * n // 100
    names = [*[F.col(a).alias(c) for a, c in keep.items()], "n_words", "n_features", "weight", "score"]
    undrawn = F.lit(None).cast("bigint").alias("rank")
    if not k:
        return scored.select(*names, undrawn)
    low, high, above = quantile_bracket(scored.where(eligible), k, n, accuracy=accuracy)
    order = [F.col("score").desc(), F.col("_id").asc_nulls_last()]
    top = C.numbered(scored.where(eligible & (F.col("score") > high)), [], order, "_at", "drawn")
    edge = C.numbered(scored.where(eligible & F.col("score").between(low, high)), [], order, "_at", "bracket")
    rest = scored.where(~eligible | (F.col("score") < low))
    in_edge = F.when(F.col("_at") < k - above, F.col("_at") + above + 1).alias("rank")
    return top.select(*names, (F.col("_at") + 1).alias("rank")).unionByName(edge.select(*names, in_edge)).unionByName(rest.select(*names, undrawn))
