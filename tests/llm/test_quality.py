import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from panelspark.llm import quality as Q

WS = " \t\n\x0b\x0c\r"


def brute(docs, min_docs, share, depleted):
    norm = lambda x: x.strip(WS).lower()
    hosts, line_docs = defaultdict(set), defaultdict(set)
    for d, t, h in docs:
        hosts[h].add((d, t or ""))
        for x in (t or "").split("\n"):
            if norm(x):
                line_docs[h, norm(x)].add((d, t or ""))
    out = []
    for d, t, h in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(grams)
        cover = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if x.strip(WS)]
        total = sum(len(norm(x)) for x in lines)
        gone = sum(len(norm(x)) for x in lines if len(line_docs[h, norm(x)]) >= min_docs and len(line_docs[h, norm(x)]) > share * len(hosts[h]))
        clean = "\n".join(x for x in t.split("\n") if not (norm(x) and len(line_docs[h, norm(x)]) >= min_docs and len(line_docs[h, norm(x)]) > share * len(hosts[h])))
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        out.append((str(d), len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), failed, not failed and total - gone >= total * depleted, clean))
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)] + ["é", "日本", "#x", "<|>", "A", "a"]
    boiler = "Shared line " + " ".join(vocabulary[:60])
    docs = []
    for k in range(150):
        body = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 5))]
        if rng.random() < 0.4:
            body.append(boiler + "  \t" * (k % 2))
        if rng.random() < 0.3:
            body += body[:2]
        docs.append((k, "\n".join(body), rng.choice(["h0", "h0", "h0", "h1", None])))
    docs += [(900 + k, boiler + f"\nown {k}", "h0") for k in range(15)] + [(None, None, None), (None, "x", "h0"), (7, "", "h1"), (8, "ab " * 20_000, "h1"), (9, " \n\t\n", "h1")] + [docs[3]] * 4
    df = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, source string, kept int").withColumn("_hash", F.lit(3))
    out = Q.quality_rules(df, min_docs=10, share=0.05, depleted=0.3).collect()
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.cleaned_text) for r in out)
    assert got == brute(docs, 10, 0.05, 0.3)
    assert all(r._hash == 3 for r in out)
    assert any(not r.base_failed and not r.kept for r in out)
    assert Q.quality_rules(df.limit(0)).count() == 0


def test_line_that_only_copies_hold(spark):
    docs = [(k, "the same page\nshared footer", "h") for k in range(12)] + [(100 + k, f"own {k}", "h") for k in range(30)]
    out = Q.quality_rules(spark.createDataFrame(docs, "doc_id long, text string, source string"), min_words=1)
    assert {r.doc_id: r.removed_lines for r in out.collect()} == {d: 2 if d < 100 else 0 for d, _, _ in docs}
