import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from panelspark.llm import packing as K

FILE = P.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(FILE)


def test_rule_minimises_squares():
    rng = random.Random(3)
    p = K.SumOfSquares(10)
    for _ in range(300):
        s = rng.randint(1, 9)
        before = p.level.copy()
        p.place((0, 0, b"\0\0\0\0" * s), s)

        def squares(h, before=before, s=s):
            x = before.copy()
            if h:
                x[h] -= 1
            if h + s < 10:
                x[h + s] += 1
            return int((x**2).sum())

        assert int((p.level**2).sum()) == min(squares(h) for h in range(11 - s) if not h or before[h])


def check(docs, out, window):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in out:
        by_seq[r.sequence_id].append(r)
        by_doc[r.doc_id, r.doc_tokens].append(r)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
    want = sorted(PLAIN.encode(t or "", add_special_tokens=False).ids + [0] for _, t in docs)
    assert sum(r.length for r in out) == sum(map(len, want))
    return by_doc, by_seq


def test_round_trip(spark):
    rng = random.Random(1)
    docs = [(k, " ".join(rng.choice(["alpha", "be", "gamma12", "é"]) for _ in range(rng.choice([0, 3, 40, 300, 2000])))) for k in range(120)] + [(500, None), (None, "null id"), (7000, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as length", "'x' as `start`")
    out = K.pack_documents(df.coalesce(2), FILE, 256).collect()
    by_doc, by_seq = check(docs, out, 256)
    short = [s for s, rows in by_seq.items() if sum(r.length for r in rows) < 256]
    assert len(short) <= 2
    for k, t in docs:
        pieces = sorted((r for (d, _), rows in by_doc.items() if d == k for r in rows), key=lambda r: r.start)
        got = np.frombuffer(b"".join(bytes(r.ids) for r in pieces), "<u4").tolist()
        assert got == PLAIN.encode(t or "", add_special_tokens=False).ids + [0]
        assert [r.start for r in pieces] == np.cumsum([0, *[r.length for r in pieces[:-1]]]).tolist()
        assert all(r.length * 4 == len(r.ids) and zlib.crc32(bytes(r.ids)) >= 0 for r in pieces)


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "same text")] * 5, "doc_id long, text string")
    out = K.pack_documents(df, FILE, 16).collect()
    assert sum(r.length for r in out) == 5 * (len(PLAIN.encode("same text").ids) + 1)
    assert K.pack_documents(df.limit(0), FILE).count() == 0
