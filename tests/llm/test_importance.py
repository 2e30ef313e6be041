import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from panelspark.llm import importance as I
from panelspark.llm import queries as Q


def words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def runs(text, longest):
    w = words(text)
    return [" ".join(w[k : k + n]) for n in range(1, longest + 1) for k in range(len(w) - n + 1)]


def plain(docs, target, percent, least, longest, buckets, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in runs(x, longest)) for texts in ([d[1] for d in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for i, x in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in runs(x, longest))
        out.append((i, len(words(x)), len(runs(x, longest)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    drawn = fit[: percent * len(fit) // 100]
    return out, drawn


def corpus(n):
    rng = random.Random(5)
    bank = [f"word{k}" for k in range(80)] + ["É1", "naïve", "漢字", "x_y", "A-b"]
    docs = [(k, " ".join(rng.choice(bank) for _ in range(rng.randint(0, 60)))) for k in range(n)]
    return docs + [(n + 1, None), (n + 2, ""), (n + 3, "Zed " * 3000), (None, "word1 " * 30), (None, "word1 " * 30), (3, docs[3][1]) if n > 3 else (n + 4, "a")]


@pytest.mark.parametrize("n, longest, percent, least", [(400, 1, 10, 20), (300, 3, 40, 0), (30, 2, 100, 5), (6, 1, 10, 20)])
def test_against_plain_version(spark, n, longest, percent, least):
    docs, target = corpus(n), ["word1 word2 word3 naïve", None, "word7 word8 漢字 " * 5]
    df = spark.createDataFrame([(i, x, 0, "r") for i, x in docs], "doc_id long, text string, weight int, rank string")
    out = I.resample(df, spark.createDataFrame([(x,) for x in target], "text string"), percent, least, longest, buckets=500).collect()
    want, drawn = plain(docs, target, percent, least, longest, 500)
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in out) == Counter(want)
    got = sorted((r for r in out if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, len(drawn) + 1))
    assert [(r.doc_id, r.score) for r in got] == [(x[0], x[4]) for x in drawn]


def test_equal_scores_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "same words " * 20)] * 50, "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    out = I.resample(df, none, percent=30, columns=("text",)).collect()
    assert sorted(r["rank"] for r in out if r["rank"]) == list(range(1, 16)) and len(out) == 50 and all(r.text for r in out)
    assert I.resample(df.limit(0), none).count() == 0


def test_bracket_is_widened_until_it_holds_the_cutoff(spark):
    """A sketch far off the truth: exact counts outside reject its brackets, and the last has every row."""
    rng = random.Random(2)
    scores = [rng.randint(-10**9, 10**9) for _ in range(3000)] + [7] * 500
    df = spark.createDataFrame([(x,) for x in scores], "score long").repartition(7)
    for k in (1, 17, 350, 1750, 3499, 3500):
        for accuracy in (1, 20, 10000):
            low, high, above = I.quantile_bracket(df, k, len(scores), accuracy=accuracy)
            kth = sorted(scores, reverse=True)[k - 1]
            assert above == sum(x > high for x in scores) and (low <= kth <= high or above == k)
            if accuracy == 10000:
                assert sum(low <= x <= high for x in scores) < 600
    assert df.where(F.col("score") == 7).count() == 500


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    key = lambda r: r["doc_id"]
    got = sorted((r.asDict() for r in Q.QUERIES["op13_importance"](spark, sf).collect()), key=key)
    want = sorted(con.sql(Q.ORACLE_SQL["op13_importance"]).df().astype(object).to_dict("records"), key=key)
    assert [{k: None if v is None or v != v else int(v) for k, v in r.items()} for r in want] == got
