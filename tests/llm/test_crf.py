import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import crf
from panelspark.llm.queries import op8_language

SYLLABLES = {"xx": ["ka", "ti", "mo", "ru", "sa", "ne"], "yy": ["schl", "ung", "eich", "ver", "gen", "ü"], "zz": ["eau", "oux", "ère", "ille", "qu", "ment"]}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    lengths = np.array([4, 3, 1])
    e, start, t = rng.normal(size=(3, 4, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    got = crf.marginals(e, lengths, start, t)
    for i, n in enumerate(lengths):
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            s = start[path[0]] + sum(e[i, p, y] for p, y in enumerate(path)) + sum(t[a, b] for a, b in itertools.pairwise(path))
            for p, y in enumerate(path):
                want[p, y] += np.exp(s)
        assert np.allclose(got[i, :n], want / want.sum(1, keepdims=True))
        assert not got[i, n:].any()


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    return crf.train([(sentence(rng, x, 100), x) for x in SYLLABLES for _ in range(25)], sequences=1500)


def test_words_of_switched_text(model):
    rng = random.Random(2)
    right = total = 0
    for _ in range(40):
        parts = [(x, sentence(rng, x, rng.randint(4, 10)).split()) for x in rng.choices(list(SYLLABLES), k=4)]
        words, gold = [w for _, p in parts for w in p], [x for x, p in parts for _ in p]
        m = crf.marginals(model.emissions(words)[None], np.array([len(words)]), model.start, model.transitions)[0]
        right += sum(model.labels[k] == g for k, g in zip(m.argmax(1), gold, strict=True))
        total += len(words)
    assert right / total > 0.95
    assert all(model.transitions[k, k] > model.transitions[k].mean() for k in range(3))


def test_texts(model):
    rng = random.Random(3)
    texts = [None, "", "12 34 !!", "²  _", sentence(rng, "yy", 30000), *[sentence(rng, x, 40) for x in SYLLABLES], sentence(rng, "zz", 60) + " " + sentence(rng, "xx", 20)]
    out = crf.predict(model, texts)
    assert out[:4] == [("und", 0.0)] * 4
    assert [x for x, _ in out[4:]] == ["yy", "xx", "yy", "zz", "zz"] and all(0 <= s <= 1 for _, s in out)
    assert 0.6 < out[-1][1] < 0.9
    assert crf.predict(model, texts[::-1])[::-1] == out or all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-5 for a, b in zip(crf.predict(model, texts[::-1])[::-1], out, strict=True))


def test_held_out_accuracy_on_spark(spark):
    rng = random.Random(4)
    rows = [(k, sentence(rng, x, rng.randint(5, 80)), x if k % 11 else None) for k in range(400) for x in [rng.choice(list(SYLLABLES))]]
    truth = {}
    for k, t, _ in rows:
        truth[k] = max(SYLLABLES, key=lambda x, t=t: sum(s in t for s in SYLLABLES[x]))
    df = spark.createDataFrame([(*r, 0.5) for r in [*rows, (None, None, None), (900, "", "xx")]], "doc_id long, text string, lang string, score double")
    model = crf.fit(df.where(~crf.held_out("doc_id")), sample_rows=50)
    out = crf.label_languages(df, model).withColumn("h", crf.held_out("doc_id")).collect()
    assert len(out) == 402 and all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    tested = [r for r in out if r.h and r.doc_id in truth]
    assert sum(r.lang_pred == truth[r.doc_id] for r in tested) / len(tested) > 0.97
    assert {r.lang_pred for r in out if r.doc_id in (None, 900)} == {"und"}
    assert crf.label_languages(df.limit(0), model).count() == 0


def test_whole_of_texts_without_spaces(model):
    rng = random.Random(5)
    run = lambda lang, n: "".join(rng.choice(SYLLABLES[lang]) for _ in range(n))
    texts = [run("xx", 12) + run(x, 300) for x in ("yy", "zz")]  # 24 letters of xx, then another language
    assert all(crf.tokens_of(t) == [t] for t in texts)
    assert [x for x, _ in crf.predict(model, texts)] == ["yy", "zz"]
    mixed = [f"{run('xx', 3)} {run('yy', 60)} {run('xx', 2)}", run("yy", 40_000)]
    assert [x for x, _ in crf.predict(model, mixed)] == ["xx", "yy"] and not any(len(w) > crf.REMEMBERED for w in model.memory)


def plain_features(word):
    """Feature slots of one word, one by one."""
    m, mask = int(crf._MULT), 2**64 - 1
    mark = lambda h, kind: ((h * m + kind * 0xC2B2AE3D27D4EB4F & mask) >> 40) % crf.SLOTS
    c = [1, *map(ord, word), 2]

    def gram(x):
        h = 0
        for v in x:
            h = (h * m + v) & mask
        return h

    out = [mark(gram(c[k : k + n]), n - 1) for n in (2, 3) for k in range(len(c) - n + 1)]
    out.append(mark(sum(v * pow(m, k, 2**64) for k, v in enumerate(c)) & mask, 3))
    return out + ([mark(gram(c[:4]), 4), mark(gram(c[-4:]), 5)] if len(c) >= 4 else [])


def test_features_of_words_of_any_length():
    words = ["a", "ab", "é日", "a" * 24 + "b", "a" * 24 + "zzzz", "x" * 3000, "word"]
    slots, many = crf.features(words)
    cut = np.split(slots, np.cumsum(many)[:-1])
    assert all(sorted(got.tolist()) == sorted(plain_features(w)) for got, w in zip(cut, words, strict=True))
    assert cut[3][-1] != cut[4][-1]  # real suffixes


def test_rare_language_and_no_language(spark):
    rng = random.Random(6)
    rows = [(k, sentence(rng, "xx" if k % 400 else "zz", 30), "xx" if k % 400 else "zz") for k in range(1, 2401)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = crf.fit(df, sample_rows=20)
    assert model.labels == ["xx", "zz"]
    assert crf.predict(model, [sentence(rng, "zz", 30)])[0][0] == "zz"
    nothing = crf.fit(df.withColumn("lang", F.lit(None).cast("string")))
    out = crf.label_languages(df.limit(5), nothing).collect()
    assert [(r.lang_pred, r.score) for r in out] == [("und", 0.0)] * 5


@pytest.mark.parametrize("n", [0, 6])
def test_query_without_labels(spark, tmp_path, n):
    rows = [(k, "some text", None) for k in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    out = op8_language(spark, str(tmp_path)).collect()
    assert len(out) == n and all((r.lang_pred, r.score) == ("und", 0.0) for r in out)


def test_marks_stay_in_words():
    """Vowel signs, tone marks and accents of their own belong to the letter before them."""
    assert crf.tokens_of("हिन्दी भाषा, में!") == ["हिन्दी", "भाषा", "में"]
    assert crf.tokens_of("ภาษาไทยที่ดี x1y") == ["ภาษาไทยที่ดี", "x", "y"]
    assert crf.tokens_of("العَرَبِيَّةُ لغة") == ["العَرَبِيَّةُ", "لغة"]
    assert crf.tokens_of("Café au_lait e\u0301te\u0301 \u0301") == ["café", "au", "lait", "e\u0301te\u0301"]
    assert crf.tokens_of("\u0301\u0302 12 _") == [] and crf.tokens_of("می\u200cخواهم") in (["می\u200cخواهم"], ["می", "خواهم"])


def test_scripts_with_marks_are_told_apart():
    hindi = "यह हिन्दी भाषा में लिखा हुआ एक वाक्य है और इसमें कई शब्द हैं"
    marathi = "हे मराठी भाषेत लिहिलेले एक वाक्य आहे आणि त्यात अनेक शब्द आहेत"
    rng = random.Random(3)
    texts = [(" ".join(rng.choices(t.split(), k=30)), x) for x, t in (("hi", hindi), ("mr", marathi)) for _ in range(20)]
    out = crf.predict(crf.train(texts, sequences=600), [hindi, marathi])
    assert [x for x, _ in out] == ["hi", "mr"] and all(s > 0.8 for _, s in out)


def test_long_texts_in_pieces_equal_one_array(model, monkeypatch):
    rng = np.random.default_rng(4)
    e, start, t = rng.normal(size=(1, 50, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    want = crf.marginals(e, np.array([50]), start, t)[0].sum(0)
    for piece in (1, 7, 50, 60):
        assert np.allclose(crf.label_sums(lambda a, b: e[0, a:b].copy(), 50, start, t, piece), want)
    r = random.Random(8)
    texts = [sentence(r, "yy", 400) + " " + "q" * 60 + " " + sentence(r, "xx", 300), "ka" * 40, sentence(r, "zz", 30), " ".join(["ti" * 30] * 90)]
    whole = crf.predict(model, texts)
    monkeypatch.setattr(crf, "PIECE", 64)
    cut = crf.predict(model, texts)
    assert [x for x, _ in cut] == [x for x, _ in whole] and np.allclose([s for _, s in cut], [s for _, s in whole], atol=1e-4)
