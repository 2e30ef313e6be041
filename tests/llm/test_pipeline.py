"""Stages of corpus_pipeline against plain versions, and the whole run on a small corpus."""

import random

import pytest

import corpus_pipeline as CP
from panelspark.llm import lines as L
from test_jaccard import shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"aa": ["ka", "ti", "mo", "ru", "sa", "ne", "po"], "bb": ["schl", "ung", "eich", "ver", "gen", "ü", "tz"]}


def corpus():
    rng = random.Random(8)
    word = lambda x: "".join(rng.choice(SYLLABLES[x]) for _ in range(rng.randint(1, 4)))
    text = lambda x, n: " ".join(word(x) for _ in range(n))
    items = [(k, text("aa", 30)) for k in range(5)]
    docs = []
    for k in range(160):
        x = rng.choice(["aa", "bb"])
        t = "\n".join(text(x, 25) for _ in range(4))
        if k % 8 == 0:
            t += "\nAll rights reserved here."
        if k % 20 == 3:
            t = t + " " + items[k % 5][1]
        docs.append((k, t, x if k % 9 else None, f"s{k % 3}", len(t)))
    docs += [(1000 + k, docs[2][1], "aa", "s0", 1) for k in range(5)]  # copies
    near = docs[6][1].split(" ")
    near[10] = "changed"
    docs += [(2000, " ".join(near), "aa", "s0", 1), (3000, "123 456", "aa", "s0", 7), (3001, None, "aa", None, None), (3002, "", None, "s1", 0), (None, text("bb", 60), "bb", "s1", 9)]
    return items, docs


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    items, docs = corpus()
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def read(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_each_stage(spark, sf):
    items, docs = corpus()
    df = read(spark, sf)
    ids = lambda x: sorted(str(r.doc_id) for r in x.collect())
    kept = CP.language_id(spark, df, sf)
    assert kept.columns == df.columns and ids(kept) == sorted(str(d[0]) for d in docs if d[0] not in (3000, 3001, 3002))

    out = CP.line_dedup(spark, df, sf)
    texts = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == df.columns and all(r.n_chars == len(r.text) for r in out.collect())
    holders = [d[0] for d in docs if d[1] and "All rights reserved here." in d[1]]
    assert len(holders) >= 10
    assert [k for k in sorted(holders) if "All rights" in texts[k]] == [min(holders)]
    assert len(texts) == len({d[0] for d in docs})

    groups = CP.near_duplicates(spark, df, sf)
    left = ids(groups)
    assert "2000" not in left and not any(str(1000 + k) in left for k in range(5)) and {"2", "6", "3002", "None"} <= set(left)
    assert len(left) == len(docs) - 6
    sets = {str(d[0]): shingles(d[1]) for d in docs if str(d[0]) in left}
    keys = list(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            assert not (sets[a] and sets[b]) or 100 * len(sets[a] & sets[b]) < 75 * len(sets[a] | sets[b])

    clean = CP.decontamination(spark, df, sf)
    assert ids(clean) == sorted(str(d[0]) for d in docs if not (d[1] and any(i in d[1].replace("\n", " ") for _, i in items)))


def test_run(spark, sf):
    out = CP.run(spark, sf)
    rows = out.collect()
    assert rows and {"doc_id", "start", "length", "sequence_id", "offset", "ids_crc32"} <= set(out.columns)
    gone = {k for k in range(160) if k % 20 == 3} | {1000, 2000, 3000, 3001, 3002}
    assert not gone & {r.doc_id for r in rows} and len({r.doc_id for r in rows}) == 160 - 8 + 1
    assert [n for n, _ in CP.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "packing"]


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert CP.run(spark, str(tmp_path)).count() == 0
    assert L.dedup_lines(read(spark, str(tmp_path))).count() == 0


def test_null_ids_take_no_part_in_links(spark, tmp_path):
    _, docs = corpus()
    text = docs[5][1]
    near = text.replace(" ", "  ").replace("ka", "ka", 1) + " tail"
    rows = [(5, text, "aa", "s", 1), (None, near, "aa", "s", 1), (None, near, "aa", "s", 1), (7, near, "aa", "s", 1), (5, docs[9][1], "aa", "s", 1), (8, docs[9][1], "aa", "s", 1)]
    for more in ([], [(None, "something else entirely " * 9, "aa", "s", 1)]):
        out = CP.near_duplicates(spark, spark.createDataFrame(rows + more, SCHEMA), str(tmp_path)).collect()
        assert sorted((str(r.doc_id), r.text) for r in out) == sorted([("5", text), ("None", near), ("5", docs[9][1]), *[("None", m[1]) for m in more]])


def test_columns_with_clashing_names_keep_their_values(spark, sf):
    df = read(spark, sf)
    for name in ("score", "lang_pred", "n_lines", "kept_text", "n_dropped"):
        df = df.withColumn(name, df["doc_id"])
    for stage in (CP.language_id, CP.line_dedup):
        out = stage(spark, df, sf)
        assert out.columns == df.columns
        assert all(r.score == r.lang_pred == r.n_lines == r.kept_text == r.n_dropped == r.doc_id for r in out.collect())


def test_decontamination_leaves_no_word_out_of_its_index(spark, sf, monkeypatch):
    from panelspark.llm import decontaminate as D

    seen, left = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    sketch = D._sketch

    def told(held, *rest):
        inner, (kind, none) = sketch(held, *rest), held.value.kind()

        def run(batches):
            def counted():
                for b in batches:
                    blobs = b.column("terms").to_pylist()
                    seen.add(len(blobs))
                    left.add(sum(x[k : k + 2] == none.to_bytes(2, "little") for x in blobs for k in range(0, len(x), 2)))
                    yield b

            return inner(counted())

        return run

    monkeypatch.setattr(D, "_sketch", told)
    docs = read(spark, sf)
    kept = {r.doc_id for r in CP.decontamination(spark, docs, sf).collect()}
    assert {k for k in range(160) if k not in kept} == {k for k in range(160) if k % 20 == 3}
    assert seen.value == docs.count() and left.value == 0
