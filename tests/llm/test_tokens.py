import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelspark.llm import _common as C
from panelspark.llm import tokens as T

FILE = P.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(FILE)
ODD = ["", " ", "\n\n a", "a  b", "don't  stop  now\t\tx", "x\x1c y", "<|endoftext|>", "a <|endoftext|> b\n<|endoftext|>c", "\0 zero\0", "日本語 テキスト", "é́ ñ", "trailing ", "trailing\n", "a" * 5000, "w " * 5000, "\r\n\r\n line", "  em   sep"]


def ids(texts):
    import numpy as np

    return [np.frombuffer(x, "<u4").tolist() for x in T.tokenizer(FILE).encode(texts)]


@pytest.mark.parametrize("text", ODD)
def test_ids_equal_the_library(text):
    assert ids([text]) == [PLAIN.encode(text, add_special_tokens=False).ids]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\0a'sé1.<|>\x1c 　"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=5))
def test_ids_of_any_texts(texts):
    assert ids(texts) == [PLAIN.encode(x, add_special_tokens=False).ids for x in texts]


def test_counts_and_cache(spark, tmp_path):
    rows = [(1, "a b c", "x"), (1, "a b c", "y"), (2, None, "x"), (None, "a b c", None), (3, "", "x"), (4, "word " * 600, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").withColumnRenamed("n_tokens", "extra")
    cache = f"file://{tmp_path}/cache"
    for more in ([], [(9, "new text", "x")]):
        df = docs.union(spark.createDataFrame(more, docs.schema)) if more else docs
        out = T.token_counts(df, FILE, cache).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit, r.extra) for r in out) == sorted((str(i), len((t or "").encode()), len(PLAIN.encode(t or "").ids), len(PLAIN.encode(t or "").ids) > 512, e) for i, t, e in rows + more)
    assert spark.read.parquet(f"{cache}/run-*").count() == 4  # each content once over both runs
    assert T.token_counts(docs.limit(0), FILE).count() == 0


def test_cache_with_repeated_and_half_written_runs(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    cache = T.DigestCache(spark, f"file://{tmp_path}/cache")
    version = T.tokenizer_version(FILE)
    stored = spark.createDataFrame([("a b", 2)], "t string, n_tokens long").select(C.sha256(F.col("t")).alias("content_digest"), "n_tokens")
    cache.append(stored, version)
    cache.append(stored, version)  # two runs that added the same content
    cache.append(stored.withColumn("n_tokens", F.lit(77).cast("long")), "another version")
    (tmp_path / "cache" / "run-broken").mkdir()
    (tmp_path / "cache" / "run-broken" / "part-0.parquet").write_bytes(b"half a file")
    out = T.token_counts(docs, FILE, cache.path)
    assert sorted((r.doc_id, r.n_tokens) for r in out.collect()) == [(1, 2), (2, 1)]
    runs = len(list((tmp_path / "cache").glob("run-*/_SUCCESS")))
    assert T.token_counts(docs, FILE, cache.path).count() == 2
    assert len(list((tmp_path / "cache").glob("run-*/_SUCCESS"))) == runs  # only hits: nothing is written


def test_each_missing_content_is_encoded_once(spark, tmp_path):
    """The cache gets the rows that the encoders gave, so copies that were encoded again would show there."""
    rows = [(None, "many nulls")] * 50 + [(7, "equal rows")] * 20 + [(None, "both"), (9, "both"), (9, "both"), (3, "single"), (4, "single"), (None, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    cache = T.DigestCache(spark, f"file://{tmp_path}/cache")
    out = T.token_counts(docs, FILE, cache.path).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in out) == sorted((str(i), len(PLAIN.encode(t or "").ids)) for i, t in rows)
    assert spark.read.parquet(f"{cache.path}/run-*").count() == len({t or "" for _, t in rows})


def test_asked_counts_and_compaction(spark, tmp_path):
    cache = T.DigestCache(spark, f"file://{tmp_path}/cache")
    for k in range(3):
        T.token_counts(spark.createDataFrame([(1, f"text {k}"), (2, "shared")], "doc_id long, text string"), FILE, cache.path).count()
    version = T.tokenizer_version(FILE)
    asked = spark.createDataFrame([("text 1",), ("unknown",)], "t string").select(C.sha256(F.col("t")).alias("content_digest"))
    assert cache.counts(version, asked).count() == 1 and cache.counts(version).count() == 4
    cache.compact()
    assert len(list((tmp_path / "cache").glob("run-*"))) == 1 and cache.counts(version).count() == 4


def test_a_scope_deletes_the_scratch_of_operators(spark):
    import glob

    from panelspark.sources.scratch import scratch_scope

    docs = spark.createDataFrame([(1, "a b c"), (2, "d")], "doc_id long, text string")
    files = lambda: set(glob.glob(spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/*"))
    before = files()
    with scratch_scope():
        assert T.token_counts(docs, FILE).count() == 2
        assert files() > before
    assert files() == before
