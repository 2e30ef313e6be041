import glob
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from panelspark.llm import _common as C
from panelspark.llm import warc as W


def brute(pages):
    best = {}
    for p, _, h in pages:
        d = (h or "").encode()
        if len(d) >= 1000 and p is not None:
            best[d] = max(best.get(d, p), p)
    out = []
    for p, _, h in pages:
        d = (h or "").encode()
        keeper = best.get(d)
        revisit = keeper is not None and p != keeper
        out.append((str(p), len(d), hashlib.sha1(d).hexdigest(), "revisit" if revisit else "response", str(keeper if revisit else None)))
    return sorted(out)


def make(n):
    rng = random.Random(n)
    pool = ["é" * 700, "x" * 999, "y" * 1000, "<p>" * 5000 + "\r\n\r\n", "WARC/1.1\r\n\r\n" * 200]
    pages = [(k, f"https://{rng.choice('abc')}.Example.org:80/{rng.randint(0, 50)}?q=1#f", rng.choice([*pool, f"own {k} " * 300])) for k in range(n)]
    return pages + [(None, None, None), (None, "http://a.example.org/ä b", "y" * 1000), (n, "no url at all", ""), (n + 1, "ftp://u@h.x/y\nz", "tail"), *pages[:3]]


@pytest.mark.parametrize("n", [0, 200])
def test_round_trip(spark, n):
    pages = make(n)
    df = spark.createDataFrame([(*x, "z") for x in pages], "page_id long, url string, html string, digest string")
    folder = C.scratch_path(spark, "warc")
    index = W.write_archives(df, folder, block=7)
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in index.read().collect())
    assert got == brute(pages)
    files = glob.glob(folder.removeprefix("file://") + "/*.warc.gz")
    assert sum(gzip.open(f).read().count(b"\r\nWARC-Record-ID: <urn:uuid:") for f in files) == len(pages)
    payloads = sorted(bytes(r.payload) for r in index.read(with_payload=True).where("record_type = 'response'").collect())
    want = brute(pages)
    assert [hashlib.sha1(p).hexdigest() for p in payloads] and sorted(hashlib.sha1(p).hexdigest() for p in payloads) == sorted(w[2] for w in want if w[3] == "response")
    blocks = index.directory().orderBy("first_key").collect()
    assert all(b.first_key <= b.last_key for b in blocks)


def test_lookup(spark):
    pages = make(300)
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    index = W.write_archives(df, C.scratch_path(spark, "warc"), block=11)
    for url in [pages[5][1], "ftp://u@h.x/y\nz", "http://nowhere.org/"]:
        key = df.select(W.surt(F.lit(url))).first()[0]
        want = sorted(str(r.page_id) for r in df.where(W.surt(F.col("url")) == key).collect())
        assert sorted(str(r.page_id) for r in index.read([url]).collect()) == want
    assert index.read([]).count() == 0


def test_empty(spark):
    assert W.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), C.scratch_path(spark, "warc")).read().count() == 0


def test_surt(spark):
    one = lambda u: spark.range(1).select(W.surt(F.lit(u))).first()[0]
    assert one("HTTPS://User@WWW.Example.com:8080/A/b?x=1#frag") == "com,example,www)/A/b?x=1"


def test_lookup_of_keys_that_need_escapes(spark):
    urls = ["http://a/x y", "http://a/x!y", 'http://a/x"y', "http://a/x#y", "http://a/x$y", "http://a/x\ty", "http://a/x", "http://a/x%20z", None, "http://b/é\n1", "http://b/é 2"]
    pages = [(k, u, f"page {k}") for k, u in enumerate(urls)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for block in (1, 2, 100):
        index = W.write_archives(df, C.scratch_path(spark, "warc"), block=block)
        for k, u in enumerate(urls):
            same = [j for j, v in enumerate(urls) if (v or "").split("#")[0] == (u or "").split("#")[0]]
            assert sorted(r.page_id for r in index.entries([u]).collect()) == same, u
        assert sorted(r.page_id for r in index.read(df.select("url")).collect()) == list(range(len(urls)))


def test_key_of_many_captures(spark):
    pages = [(k, f"http://a/{'hot' if k % 2 else k}", f"page {k}") for k in range(300)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    index = W.write_archives(df, C.scratch_path(spark, "warc"), block=4)
    assert sorted(r.page_id for r in index.entries(["http://a/hot"]).collect()) == list(range(1, 300, 2))
    assert sorted(r.page_id for r in index.read(df.select("url")).collect()) == list(range(300))


@pytest.mark.parametrize("form", ["{}", "file:{}", "file://{}"])
def test_folder_forms(spark, tmp_path, form):
    """A bare path, file:/x and file:///x are one folder, for tasks as for Spark's readers, and later readers too."""
    pages = spark.createDataFrame([(k, f"http://a.org/{k}", "x" * 1200) for k in range(5)], "page_id long, url string, html string")
    folder = f"{tmp_path}/archives"
    index = W.write_archives(pages, form.format(folder))
    assert index.folder == f"file:{folder}" and list((tmp_path / "archives").glob("*.warc.gz")) and list((tmp_path / "archives").glob("*.cdxj.gz"))
    for other in ("{}", "file:{}", "file://{}"):
        again = W.CaptureIndex(spark, other.format(folder))
        assert again.read(pages.select("url")).count() == 5 and again.read().count() == 5
