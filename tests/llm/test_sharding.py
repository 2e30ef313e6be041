import itertools
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from panelspark.llm import sharding as S


def test_curve_visits_neighbours(spark):
    bits = 3
    points = list(itertools.product(range(2**bits), repeat=3))
    df = spark.createDataFrame(points, "a int, b int, c int").withColumn("h", S.hilbert_index([F.col("a"), F.col("b"), F.col("c")], bits))
    got = {r.h: (r.a, r.b, r.c) for r in df.collect()}
    assert sorted(got) == list(range(8**bits))
    for h in range(8**bits - 1):
        assert sum(abs(x - y) for x, y in zip(got[h], got[h + 1], strict=True)) == 1


def rows(n):
    out = [(k, "same" if k % 3 == 0 else "t é" * (k % 50), ["en", "fr", None][k % 3], f"s{k % 7}", 1) for k in range(n)]
    return out + [(None, None, None, None, 2)] * 3 + [(1, "x" * 30000, "en", "s1", 3)]


@pytest.mark.parametrize("law", ["rows", "bytes"])
@pytest.mark.parametrize("n", [0, 5, 500])
def test_shards(spark, law, n):
    data = rows(n)
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, shard int")
    out = S.hilbert_shards(df, 8, law).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in out) == sorted((str(d), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in data)
    slots, sizes = defaultdict(list), Counter()
    for r in out:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(8))
    if law == "rows":
        counts = [len(slots[k]) for k in range(8)]
        assert max(counts) - min(counts) <= 1
    else:
        total, largest = sum(sizes.values()), max(r.size for r in out)
        assert all(abs(sizes[k] - total / 8) <= 2 * largest for k in range(8))
    order = sorted(out, key=lambda r: (r.shard, r.slot))
    assert all(a.curve <= b.curve for a, b in itertools.pairwise(order))


def test_empty_and_manifest(spark, tmp_path):
    df = spark.createDataFrame(rows(300), "doc_id long, text string, lang string, source string, n int")
    assert S.hilbert_shards(df.limit(0), 8).count() == 0
    out = S.hilbert_shards(df, 8)
    S.write_shards(out, f"{tmp_path}/s")
    back = spark.read.parquet(f"{tmp_path}/s")
    assert back.count() == 304
    m = S.shard_manifest(out, ["lang", "size"]).collect()
    assert sum(r.rows for r in m) == 304 and all(r.min_size <= r.max_size for r in m)


def test_ranges_skip_files(spark, tmp_path):
    """Hundreds of sources: a reader who wants one of them, by the shards' ranges, opens few shards and misses no row."""
    rng = random.Random(1)
    data = [(k, f"text {k} " * rng.randint(1, 40), rng.choice(["de", "en", "fr"]), f"host{rng.randint(0, 299):03d}.org") for k in range(6000)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    out = S.hilbert_shards(df, 40)
    S.write_shards(out, f"{tmp_path}/s")
    m = S.shard_manifest(spark.read.parquet(f"{tmp_path}/s"), ["lang", "source", "size"]).collect()
    opened = total = 0
    for source in ("host000.org", "host077.org", "host150.org", "host299.org"):
        for lang in ("de", "en", "fr"):
            hit = [r.shard for r in m if r.min_source <= source <= r.max_source and r.min_lang <= lang <= r.max_lang]
            opened, total = opened + len(hit), total + 40
            rows = spark.read.parquet(f"{tmp_path}/s").where(F.col("shard").isin(hit) & (F.col("source") == source) & (F.col("lang") == lang)).count()
            assert rows == sum(x[2] == lang and x[3] == source for x in data)
    assert opened < 0.3 * total


def test_equal_texts_lie_together(spark):
    data = [(k, "one text" if k % 3 else f"own {k:04d}", "en", "s") for k in range(3000)]
    out = S.hilbert_shards(spark.createDataFrame(data, "doc_id long, text string, lang string, source string"), 8)
    order = [r.text_crc32 for r in out.orderBy("shard", "slot").collect()]
    same = [k for k, x in enumerate(order) if x == zlib.crc32(b"one text")]
    assert len(same) == 2000 and same[-1] - same[0] == 1999


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_only_cuts_split_equal_texts_of_many_sources(spark, law):
    """Copies under different languages and sources, null text and the empty one: rows of a text are consecutive in the
    order of all shards, so none is on two shards but where a shard ends."""
    rng = random.Random(4)
    data = [(k, rng.choice([f"copied text {k % 40} " * (k % 9), None, "", f"own {k}"]), rng.choice(["de", "en", None]), rng.choice([None, *(f"host{j}" for j in range(30))])) for k in range(2500)]
    out = S.hilbert_shards(spark.createDataFrame(data, "doc_id long, text string, lang string, source string"), 11, law).orderBy("shard", "slot").collect()
    places = defaultdict(list)
    for k, r in enumerate(out):
        places[(r.text_crc32, r.size)].append(k)
    assert len(places) < 2000 and all(v[-1] - v[0] == len(v) - 1 for v in places.values())
