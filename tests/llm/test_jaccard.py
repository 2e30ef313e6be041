import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelspark.llm import _common as C
from panelspark.llm import jaccard as J
from panelspark.llm.components import connected_components

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return sorted((str(d), len(sets[i]), str(least.get(find(i), d))) for i, (d, _) in enumerate(docs))


def corpus(seed, base, hot):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 5000)}"
    common = [word() for _ in range(30)]
    docs = []
    for _ in range(base):
        w = [word() for _ in range(rng.randint(0, 120))]
        if rng.random() < 0.5:
            w[3:3] = common
        docs.append(" ".join(w))
        for _ in range(rng.choice([0, 0, 1, 3])):
            v = list(w)
            for _ in range(rng.randint(0, 3)):
                if v:
                    v[rng.randrange(len(v))] = word()
            docs.append(rng.choice([" ", "\n", "\t  "]).join(v).upper() if rng.random() < 0.2 else " ".join(v))
    seed_words = [word() for _ in range(150)]
    for _ in range(hot):
        v = list(seed_words)
        for _ in range(rng.randint(0, 5)):
            v[rng.randrange(len(v))] = word()
        docs.append(" ".join(v))
    out = [(k, t) for k, t in enumerate(docs)]
    rng.shuffle(out)
    return out + [(None, None), (90001, ""), (90002, " \n"), (None, docs[0]), (5, docs[1]), (90003, "one two"), (90004, "One  two"), (90005, "two one"), (90006, "a " * 4000)]


@pytest.mark.parametrize("seed,base,hot", [(1, 60, 0), (2, 30, 90), (3, 0, 0)])
def test_against_brute_force(spark, monkeypatch, seed, base, hot):
    docs = corpus(seed, base, hot) if base else [(1, "just one")]
    monkeypatch.setattr(J, "HEADS", 5)
    monkeypatch.setattr(J, "UNIT_DOCS", 700 if seed == 1 else 65_000)
    df = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, digest int").repartition(3)
    out = J.jaccard_groups(df).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out) == brute(docs)


def test_empty(spark):
    assert J.jaccard_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(170)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}
    assert connected_components(spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))).count() == 0


@pytest.mark.parametrize("members", [17, 5000])
def test_block_of_many(spark, members):
    """Near copies of one text, with a chain of ever more changed ones that only links through the chain connect."""
    rng = random.Random(members)
    seed = [f"w{k}" for k in range(100)]
    docs = []
    for k in range(members):
        v = list(seed)
        for _ in range(rng.randint(0, 2)):
            v[rng.randrange(100)] = f"x{rng.randint(0, 400)}"
        docs.append((k, " ".join(v)))
    v = list(seed)
    for k in range(40):
        v[k] = f"y{k}"
        docs.append((10_000 + k, " ".join(v)))
    out = {r.doc_id: r.component_id for r in J.jaccard_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    if members < 100:
        assert sorted((str(d), str(c)) for d, c in out.items()) == [(d, c) for d, _, c in brute(docs)]
    else:
        assert set(out.values()) == {0}


def test_rows_grow_with_members_not_with_their_square(spark, monkeypatch):
    dealt = {}
    plain = J._verified

    def counted(pairs, sets, percent):
        dealt[members] = dealt.get(members, 0) + pairs.count()
        return plain(pairs, sets, percent)

    monkeypatch.setattr(J, "_verified", counted)
    for members in (500, 2000):
        rng = random.Random(3)
        docs = []
        for k in range(members):
            v = [f"w{k}" for k in range(80)]
            for _ in range(rng.randint(0, 2)):
                v[rng.randrange(80)] = f"x{rng.randint(0, 4000)}"
            docs.append((k, " ".join(v)))
        assert J.jaccard_groups(spark.createDataFrame(docs, "doc_id long, text string")).select("component_id").distinct().count() == 1
    assert dealt[2000] < 6 * dealt[500] and dealt[2000] < 40 * 2000


def test_settings_change_no_result(spark):
    docs = corpus(4, 30, 20)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 1)
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.jaccard_groups(df).collect()) == brute(docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_messages_are_compressed_and_restored():
    """Ascending hashes and small document numbers take clearly less than their bytes, and come back as they were."""
    rng = np.random.default_rng(4)
    tokens, docs = np.sort(rng.integers(0, 2**57, 3000, dtype=np.uint64)), rng.integers(0, 1500, 3000).astype("<u2")
    raw = [J._squeezed(tokens, True), J._squeezed(docs)]
    assert sum(map(len, raw)) < 0.85 * (tokens.nbytes + docs.nbytes)
    assert (J._restored(raw[0], "<u8", True) == tokens).all() and (J._restored(raw[1], "<u2") == docs).all()
    for x in (np.zeros(0, "<u8"), np.array([2**64 - 1], "<u8"), np.array([0, 5, 2**64 - 1], "<u8")):
        assert (J._restored(J._squeezed(x, True), "<u8", True) == x).all()


def test_workers_forget_words_when_another_operator_takes_its_turn(spark):
    docs = spark.range(0, 200, 1, 1).selectExpr("id as _doc", "concat('word', id, ' and some others') as _text", "id as _text_hash")
    C.prepare(spark)
    send = J._send(5, 4)

    def run(batches):
        messages = sum(1 for _ in send(batches))
        held = len(J._WORDS)
        C.take_turn("another", len)
        yield pa.record_batch([pa.array([messages]), pa.array([held]), pa.array([len(J._WORDS)])], names=["messages", "held", "left"])

    (r,) = docs.mapInArrow(run, "messages bigint, held bigint, left bigint").collect()
    assert r.messages and r.held >= 203 and r.left == 0
