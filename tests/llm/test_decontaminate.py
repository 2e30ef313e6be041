import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from panelspark.llm import decontaminate as D


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=30), st.lists(st.integers(-1, 4), max_size=40))
def test_lcs(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
    assert D.lcs_length(np.array(a, int), np.array(b, int)) == t[-1, -1]


def test_basis_spans_leading_space():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(200, 12)) @ rng.normal(size=(12, 60))
    omega = D._omega(60, 20)
    u = D.nystrom_basis(a.T @ (a @ omega), omega, 12)
    assert u.shape[1] == 12 and np.allclose(a @ u @ u.T, a, atol=1e-5)


def corpus(seed=1):
    rng = random.Random(seed)
    common = ["the", "of", "and", "to", "in", "is"]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(4, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, f"{text(rng.randint(14, 40))}. {text(8)}.") for k in range(25)] + [(98, None), (99, "")]
    docs, planted = [], set()
    for k in range(300):
        w = text(rng.randint(0, 400)).split()
        if k % 6 == 0:
            i = rng.randrange(25)
            part = items[i][1].split()
            if k % 12 == 0:  # a paraphrase: every seventh word replaced, one dropped
                part = [word() if j % 7 == 3 else x for j, x in enumerate(part) if j != 5]
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() if k % 4 == 0 else x for x in part]
            planted.add((k, i))
        docs.append((k, " ".join(w)))
    return items, docs, planted


def test_planted(spark):
    items, docs, planted = corpus()
    extra = [(None, items[3][1]), (700, None), (701, ""), (702, "word " * 30000 + items[4][1]), docs[6], docs[6]]
    df = spark.createDataFrame([(*d, 1) for d in docs + extra], "doc_id long, text string, lcs int").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = D.find_leaks(df, bench).collect()
    got = [(r.doc_id, r.item_id) for r in out]
    assert set(got) == planted | {(None, 3), (702, 4)}
    assert all(r.lcs >= 0.6 and r.cosine >= 0.6 for r in out)
    (i,) = [i for k, i in planted if k == 6]
    assert got.count((6, i)) == 3
    clean = D.drop_leaks(df, bench)
    assert clean.columns == df.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d) for d, _ in docs + extra if d is not None and d != 702 and d not in {k for k, _ in planted})


def test_blocks_and_empty(spark):
    items, docs, planted = corpus(2)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.find_leaks(df, bench, D.Limits(block_items=9)).collect()} == planted
    assert D.find_leaks(df.limit(0), bench).count() == 0
    assert D.find_leaks(df, bench.limit(0)).count() == 0


def summed(messages, shape, dtype):
    out = np.zeros(shape, dtype)
    for b in messages:
        for k, data in zip(b.column("block").to_pylist(), b.column("data").to_pylist(), strict=True):
            x = np.frombuffer(data, dtype).reshape(-1, *shape[1:])
            out[k * D.BLOCK : k * D.BLOCK + len(x)] += x
    return out


def parts(items, texts, rank=128):
    """Items, weights, latent space and numbered documents as tasks hold them; all documents are the sample."""
    n = pa.array(range(len(texts)), pa.int64())
    batch = pa.record_batch([n, n, pa.array(texts)], names=["doc_id", "text_hash", "_text"])
    terms = sorted({t for b in D._term_counts([batch]) for t, c in zip(b.column("term").to_pylist(), b.column("n").to_pylist(), strict=True) if c > 1})
    held = type("Held", (), {"value": D.read_items(items, terms)})
    none = held.value.kind()[1]
    rows = list(D._number(held)([batch]))
    idf = D.term_weights(summed(D._document_frequency(held)(rows), (none + 1,), "<i8"))
    width = min(none + 1, rank + 12)
    gram, omega = summed(D._sketch(held, idf, width)(rows), (none + 1, width), "<f4"), D._omega(none + 1, width)
    own = np.zeros_like(gram)
    D._gram_times(D._padded(held.value.segments, none), idf, omega, own)
    scale = max(1.0, np.einsum("ij,ij", omega, gram) / np.einsum("ij,ij", omega, own))
    latent = D.make_latent(held.value, idf, D.nystrom_basis(gram.astype(float) + scale * own, omega.astype(float), rank))
    return held.value, latent, rows


def brute(items, latent, rows, limits, cosine=True):
    """Every passage of every document against every segment, then common subsequences; without cosine: these alone."""
    found = {}
    for b in rows:
        for d, blob in zip(b.column("doc_id").to_pylist(), b.column("terms").to_pylist(), strict=True):
            text = np.frombuffer(blob, items.kind()[0]).astype(int)
            for at in range(0, len(text), D.STRIDE):
                here = latent.table[text[at : at + D.WINDOW]].sum(0)
                near = latent.segments @ here / max(np.linalg.norm(here), 1e-9)
                for k in range(len(items.ids)):
                    n, c = len(items.words[k]), near[items.owner == k].max()
                    if not cosine or c >= limits.cosine:
                        around = text[max(0, at - n) : at + D.WINDOW + n]
                        common, answer = (D.lcs_length(w, around) / len(w) for w in (items.words[k], items.answers[k]))
                        if common >= limits.lcs and answer >= limits.answer:
                            old = found.get((d, items.ids[k]), (-1, 0))
                            found[d, items.ids[k]] = (max(old[0], c), max(old[1], common))
    return found


def rewritten(seed=3):
    """Items, texts and which item each of the later texts rewrites: rare words replaced, or other words put between."""
    items = [x for x in corpus(seed)[0] if x[1]]
    rng = random.Random(5)
    common = {"the", "of", "and", "to", "in", "is"}
    texts, meant = [t for _, t in corpus(4)[1][:60]], []
    pool = [w for t in texts for w in t.split() if w not in common]
    new = lambda: rng.choice(pool)
    for k, text in items:
        words = text.split()
        bare = [D._bare(w) for w in words]
        gone = sorted(range(len(words)), key=lambda j: (bare[j] in common, rng.random()))[: int(0.35 * len(words))]
        replaced = [new() if j in gone else w for j, w in enumerate(words)]
        stretched = [x for j, w in enumerate(words) for x in ((w, new()) if j % 3 == 0 else (w,))]
        for part in (replaced, stretched):
            texts.append(" ".join([*(new() for _ in range(rng.randint(0, 90))), *part, *(new() for _ in range(40))]))
            meant.append((len(texts) - 1, k))
    return items, texts, meant


def scored(items, latent, rows, limits):
    held = type("Held", (), {"value": (items, latent)})
    return {(r["doc_id"], r["item_id"]): (r["cosine"], r["lcs"]) for b in D._score(held, limits)(rows) for r in b.to_pylist()}


def test_search_equals_brute_force_over_all_passages():
    items, texts, _ = rewritten()
    items, latent, rows = parts(items, texts)
    want = brute(items, latent, rows, D.Limits())
    got = scored(items, latent, rows, D.Limits())
    assert set(got) == set(want) and len(got) > 30
    assert all(np.allclose(got[x], want[x], atol=1e-3) for x in want)


def test_recall_of_rewritten_items():
    """Of all that the common subsequences alone would confirm, the latent cosine lets through at least nine tenths."""
    items, texts, meant = rewritten()
    items, latent, rows = parts(items, texts)
    every = brute(items, latent, rows, D.Limits(), cosine=False)
    got = scored(items, latent, rows, D.Limits())
    assert len(every) >= 40 and set(got) <= set(every)
    assert len(set(got) & set(every)) >= 0.9 * len(every)


def test_candidates_come_from_the_latent_space():
    """With the full rank few pairs of passage and segment are candidates, with one dimension most of them."""
    items, texts, _ = rewritten()
    share = {}
    for rank in (128, 1):
        read, latent, rows = parts(items, texts, rank)
        flat, _ = D._laid([x for b in rows for x in b.column("terms").to_pylist()], read.kind()[0], read.kind()[1])
        n = sum(len(begin) for begin, _, _ in D.latent_candidates(flat, latent, D.Limits().cosine))
        share[rank] = n / (len(flat) / D.STRIDE * len(latent.segments))
    assert share[128] < 0.03 and share[1] > 0.2


def test_blocks_solved_in_tasks_equal_one_matrix(spark, monkeypatch):
    """The latent table from blocks of rows in tasks against the whole product on one machine, up to the signs of directions."""
    monkeypatch.setattr(D, "BLOCK", 16)
    rng = np.random.default_rng(9)
    items = D.read_items([(k, " ".join(f"w{int(j)}" for j in rng.integers(0, 90, 40))) for k in range(20)], [f"c{k}" for k in range(60)])
    none = items.kind()[1]
    idf = rng.random(none + 1).astype(np.float32)
    idf[-1] = 0
    width, rank = 24, 8
    omega = D._omega(none + 1, width)
    gram, own = np.zeros_like(omega), np.zeros_like(omega)
    D._gram_times(rng.integers(0, none + 1, (300, D.WINDOW)), idf, omega, gram)
    D._gram_times(D._padded(items.segments, none), idf, omega, own)
    share = max(1.0, np.einsum("ij,ij", omega, gram) / np.einsum("ij,ij", omega, own))
    want = D.nystrom_basis(gram.astype(float) + share * own, omega.astype(float), rank) * idf[:, None]
    rows = [(k // 16, gram[k : k + 16].tobytes()) for k in range(0, none + 1, 16)]
    blocks = spark.createDataFrame(rows, "block int, data binary").repartition(3)
    got = D.latent_table(blocks, spark.sparkContext.broadcast(items), idf, width, rank)
    assert got.shape == want.shape
    assert np.allclose(got @ got.T, want @ want.T, atol=2e-3 * np.abs(want @ want.T).max())


def test_recall_over_thousands_of_items(spark):
    """2,000 items, each rewritten in a document of its own in one of three ways, found through the whole search: of the
    rewritings that the common subsequences would confirm, at least nine tenths of every kind."""
    rng = random.Random(6)
    common = ["the", "of", "and", "to", "in", "is", "a", "that"]
    bank = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 9))) for _ in range(6000)]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else bank[min(int(rng.paretovariate(0.6)), len(bank)) - 1] if rng.random() < 0.5 else rng.choice(bank)
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, f"{text(rng.randint(15, 45))}. {text(8)}.") for k in range(2000)]
    docs, meant = [], {}
    for k, item in items:
        w = item.split()
        kind = ("replaced", "stretched", "dropped")[k % 3]
        if kind == "replaced":
            gone = set(sorted(range(len(w)), key=lambda j: (D._bare(w[j]) in common, rng.random()))[: int(0.3 * len(w))])
            w = [word() if j in gone else x for j, x in enumerate(w)]
        elif kind == "stretched":
            w = [y for j, x in enumerate(w) for y in ((x, word()) if j % 3 == 0 else (x,))]
        else:
            w = [x for x in w if rng.random() > 0.2]
        docs.append((k, " ".join([text(rng.randint(0, 60)), *w, text(30)])))
        meant[k] = (kind, w)
    docs += [(5000 + k, text(120)) for k in range(1000)]
    found = {(r.doc_id, r.item_id) for r in D.find_leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")).collect()}
    read = D.read_items(items, [])
    ids = lambda words: np.array([read.vocabulary.get(D._bare(x), -1) for x in words])
    for kind in ("replaced", "stretched", "dropped"):
        due = []
        for k, (what, w) in meant.items():
            if what == kind and D.lcs_length(read.words[k], ids(w)) >= 0.6 * len(read.words[k]) and D.lcs_length(read.answers[k], ids(w)) >= 0.5 * len(read.answers[k]):
                due.append(k)
        recall = sum((k, k) in found for k in due) / len(due)
        print(kind, len(due), round(recall, 4))
        assert len(due) > 300 and recall >= 0.9, (kind, recall)
    assert sum(d != i for d, i in found) < 0.02 * len(found)


def test_only_passages_that_begin_in_a_document_are_compared():
    """Padding between documents begins no passage, and rare words without marks are not remembered."""
    sizes, begins = np.array([1, 40, 8, 0, 33]), np.array([0, 64, 160, 224, 288])
    got = np.flatnonzero(D._begun(begins, sizes, 384)) * D.STRIDE
    assert got.tolist() == [p for p in range(0, 384, D.STRIDE) if any(b <= p < b + n for b, n in zip(begins, sizes, strict=True))]
    D.forget()
    held = D.read_items([(1, "alpha beta gamma. One two three.")], ["delta"])
    ids, n = D.term_ids(["alpha, rare DELTA! (rare) _beta_ --- rarer", None, "gamma"], held)
    number = held.vocabulary
    assert ids.tolist() == [number["alpha"], -1, number["delta"], -1, number["beta"], -1, -1, number["gamma"]] and n.tolist() == [7, 0, 1]
    assert "rare" not in D._FORMS and D._FORMS["delta!"] == number["delta"]


def test_index_has_every_word_and_is_fitted_on_every_document(spark, monkeypatch):
    """Words that are found once have terms, and the sketch gets all of more documents than a sample would have."""
    rows, left = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    sketch = D._sketch

    def told(held, *rest):
        inner, (kind, none) = sketch(held, *rest), held.value.kind()

        def run(batches):
            def seen():
                for b in batches:
                    rows.add(b.num_rows)
                    left.add(sum(int((np.frombuffer(x, kind) == none).sum()) for x in b.column("terms").to_pylist()))
                    yield b

            return inner(seen())

        return run

    monkeypatch.setattr(D, "_sketch", told)
    items, docs, planted = corpus(7)
    docs += [(1000 + k, f"once{k} (twice{k // 2}) and the rest") for k in range(12_000)]
    out = D.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in out} == planted
    assert rows.value == len(docs) and left.value == 0


def test_products_equal_a_dense_matrix():
    """Terms found once, in few and in most passages, some of them twice in one; the highest term is none."""
    rng = np.random.default_rng(3)
    rows = np.minimum(rng.zipf(1.3, (700, D.WINDOW)) - 1, 400)
    idf = np.append(rng.random(400), 0).astype(np.float32)
    a = np.zeros((700, 401))
    np.add.at(a, (np.arange(700)[:, None], rows), idf[rows])
    omega = D._omega(401, 12)
    got = np.ones(omega.shape)
    D._gram_times(rows, idf, omega, got)
    want = 1 + a.T @ (a @ omega)
    assert np.allclose(got, want, atol=1e-4 * np.abs(want).max())
