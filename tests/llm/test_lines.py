import hashlib
import random
from collections import defaultdict

import pytest
import xxhash

from panelspark.llm import lines as L

WS = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, min_docs, first, shortest=1):
    key = lambda x: x.strip(WS).translate(LOWER)
    where = defaultdict(list)
    signed = lambda t: (xxhash.xxh64_intdigest(t or "", seed=42) + 2**63) % 2**64 - 2**63
    ident = {(d is None, d or 0, signed(t), t or "") for d, t in docs}
    for doc in ident:
        for p, line in enumerate(doc[3].split("\n")):
            if len(key(line)) >= shortest:
                where[key(line)].append((doc, p))
    out = []
    for d, t in docs:
        doc = (d is None, d or 0, signed(t), t or "")
        kept = []
        for p, line in enumerate(doc[3].split("\n")):
            found = where.get(key(line), [])
            if len({x for x, _ in found}) < min_docs or (first and p == min(q for x, q in found if x == doc) and doc == min(x for x, _ in found)):
                kept.append(line)
        n = len(doc[3].split("\n"))
        out.append((str(d), n, n - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def make(seed, n):
    rng = random.Random(seed)
    pool = [f"Line {k} É" for k in range(12)] + ["", "  ", "HOT line", " hot LINE\t"]
    docs = [(k, "\n".join(rng.choice(pool + [f"own {rng.random()}"] * 6) for _ in range(rng.randint(1, 6)))) for k in range(n)]
    return docs + [(None, "hot line"), (None, "hot line"), (None, None), (n + 1, None), (n + 2, ""), (n + 3, "x\n" * 3000 + "hot line"), (5, docs[5][1]) if n > 5 else (5, "a")]


@pytest.mark.parametrize("first", [False, True])
@pytest.mark.parametrize("seed,n,parts", [(1, 200, 4), (2, 60, 13), (3, 0, 3), (4, 400, 40)])
def test_against_brute_force(spark, seed, n, parts, first):
    docs = make(seed, n)
    df = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, n_lines int").repartition(3)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        out = L.dedup_lines(df, 10, 1, first).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in out)
    assert got == brute(docs, 10, first)


def test_empty(spark):
    assert L.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
