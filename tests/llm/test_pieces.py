import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from panelspark.llm import pieces as S

FILE = P.path("piece_bpe_32k.model")
PLAIN = sentencepiece.SentencePieceProcessor(model_file=FILE)
ODD = ["", " ", "  ", "\n", " \n ", "a  b", "a\n\n  b\n", "▁x ▁▁y", "<s> hi </s> <unk> <0x0A>", "\0 zero\0\0", "日本語テキスト 梦ң", "é ﬁ ﻿", "trailing ", "\t\ttabs\t x", "🙂🙃 👩‍👩‍👧", "\U0010ffff", "<|endoftext|>"]
LONG = ["a" * 5000, "ab" * 3000, " " * 3000 + "x", "x" + " " * 333, " " * 17, " " * 18, "a " * 4000, "the" * 2000, "=" * 999 + " " * 40 + "-" * 999, "漢字" * 2000, "0123456789" * 300, "é" * 2000, "\n" * 500, " \n" * 300, "hahahaha" * 500, "inininginging" * 300]


def ids(texts):
    return [np.frombuffer(x, "<u4").tolist() for x in S.tokenizer(FILE).encode(texts)]


@pytest.mark.parametrize("text", ODD + LONG)
def test_ids_and_texts_equal_the_library(text):
    got = ids([text])[0]
    assert got == PLAIN.encode(text)
    assert S.tokenizer(FILE).decode(got) == PLAIN.decode(got)


CHARS = st.one_of(st.sampled_from(" \n\t\0aeinst▁é.<>0x漢"), st.characters(exclude_categories=["Cs"]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=CHARS, max_size=60), max_size=5))
def test_ids_of_any_texts(texts):
    got = ids(texts)
    assert got == [PLAIN.encode(x) for x in texts]
    assert [S.tokenizer(FILE).decode(x) for x in got] == [PLAIN.decode(x) for x in got]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet=st.sampled_from("abcdeinorst"), max_size=300), st.text(alphabet=st.sampled_from("ain "), max_size=200), st.lists(st.sampled_from(["the", "ing", "tion", "  ", "an", "s"]), max_size=60).map("".join)), max_size=4))
def test_ids_of_long_words(texts):
    assert ids(texts) == [PLAIN.encode(x) for x in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 31999) | st.integers(0, 300), max_size=12))
def test_text_of_any_ids(some):
    assert S.tokenizer(FILE).decode(some) == PLAIN.decode(some)


def test_memory_of_words_is_bounded():
    bpe = S.PieceBpe(FILE, remembered=50)
    texts = [f"word{k} another{k * 7} {'x' * 60}{k}" for k in range(200)]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode(texts)] == [PLAIN.encode(x) for x in texts]
    assert len(bpe.known) <= 50


def test_documents(spark):
    texts = [None, "", "one two", "one two", "x" * 20000, "naïve 漢\n", *LONG[:3]]
    docs = spark.createDataFrame([(k if k % 4 else None, t, k, "e") for k, t in enumerate(texts)], "doc_id long, text string, ids long, Decoded string")
    out = S.encode_pieces(docs.withColumnRenamed("ids", "k"), FILE, decode=True).collect()
    assert sorted(r.k for r in out) == list(range(len(texts)))
    for r in out:
        want = PLAIN.encode(texts[r.k] or "")
        assert (r.doc_id, r.ids, r.decoded) == (r.k if r.k % 4 else None, want, PLAIN.decode(want))
    assert S.encode_pieces(docs, FILE).columns == ["doc_id", "Decoded", "ids"]
    assert S.encode_pieces(docs.limit(0), FILE).count() == 0


def test_query(spark):
    from panelspark.llm import queries as Q

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in Q.QUERIES["op12_sentencepiece"](spark, sf).collect()}
    want = {i: PLAIN.encode(t or "") for i, t in texts.items()}
    assert got == {i: (len(x), sha(",".join(map(str, x))), sha(PLAIN.decode(x))) for i, x in want.items()}
