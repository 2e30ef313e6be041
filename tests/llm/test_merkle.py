import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from panelspark.llm import merkle as M
from panelspark.llm import queries as Q

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain(nodes):
    """Root of nodes, and the siblings of each, level by level; each with its place among them."""
    paths, spans = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        up, up_spans = [], []
        for a in range(0, len(nodes), 8):
            run = nodes[a : a + 8]
            for j, below in enumerate(spans[a : a + 8]):
                for k in below:
                    paths[k].append((j, run[:j] + run[j + 1 :]))
            up.append(sha("".join(run)))
            up_spans.append([k for below in spans[a : a + 8] for k in below])
        nodes, spans = up, up_spans
    return (nodes[0] if nodes else None), paths


def fold(x, path):
    for j, others in path:
        x = sha("".join([*others[:j], x, *others[j:]]))
    return x


def expected(rows):
    """rows: (doc_id, source, lang, n_chars, text). Leaves, subroots, root, proofs, roots of altered leaves."""
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    done = {}
    for name in names:
        trees[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        done[name] = plain([leaf(r) for r in trees[name]])
    root, tops = plain([done[n][0] for n in names])
    out = []
    for name, top in zip(names, tops, strict=True):
        for r, path in zip(trees[name], done[name][1], strict=True):
            altered = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                altered = (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            whole = path + top
            folded = fold(leaf(altered), whole)
            out.append((r[0], leaf(r), done[name][0], root, sha("".join("".join(o) for _, o in whole)), folded, folded == root))
    return out


def key(r):
    return tuple(str(x) for x in r)


def result(df):
    altered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    m = M.build_manifest(df, COLUMNS, carry={"doc_id": F.col("doc_id"), "altered": M.leaf_digest(*[F.col(c) for c in COLUMNS[:4]], altered)})
    return m, shown(m)


def shown(m):
    out = M.fold(m.witnesses(), "altered", ["doc_id", "leaf", "subroot", "root"])
    return sorted(((r.doc_id, r.leaf.hex(), r.subroot.hex(), r.root.hex(), r.proof_sha256, r.folded_root.hex(), r.folded_root == r.root) for r in out.collect()), key=key)


def rows_of(sizes, start=0):
    rng = random.Random(3)
    out, n = [], start
    for lang, size in sizes.items():
        for _ in range(size):
            n += 1
            out.append((n, rng.choice(["a", "b", None]), lang, rng.randint(0, 9), rng.choice(["Text É", "", None, "all small", f"Own {n}"])))
    rng.shuffle(out)
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8, None: 1}, {"en": 9, "de": 64, "é": 65, "z": 7, None: 3}, {"en": 4200, "fr": 512, "de": 513, "": 520}, {f"l{k}": 1 + k % 3 for k in range(600)}])
def test_against_plain_version(spark, sizes):
    rows = rows_of(sizes)
    m, got = result(spark.createDataFrame(rows, SCHEMA))
    want = expected(rows)
    assert got == sorted(want, key=key)
    assert m.root.hex() == want[0][3]


def test_nulls_repeats_long_texts_and_clashing_columns(spark):
    rows = [(None, None, None, None, None)] * 3 + [(None, "a", "en", 1, "T" * 200000), (1, "a", "en", 2, "X"), (1, "a", "en", 2, "X"), (1, "a", "en", 2, "Y")] + [(k, "s", "en", 0, "Same") for k in range(2, 40)]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], SCHEMA + ", Witness string, place int")
    assert result(df)[1] == sorted(expected(rows), key=key)
    m = M.build_manifest(df.limit(0), COLUMNS)
    assert m.root is None and m.witnesses().count() == 0
    with pytest.raises(ValueError):
        M.build_manifest(df, COLUMNS, carry={"witness": F.lit(1)})


def test_appending_equals_building_at_once(spark, tmp_path):
    parts = [rows_of({"en": 700, "de": 3, None: 512}), rows_of({"en": 900, "de": 600, "fr": 1}, 5000), rows_of({"fr": 9, None: 1}, 9000)]
    carry = {"doc_id": F.col("doc_id"), "altered": M.leaf_digest(*map(F.col, COLUMNS))}
    m = M.build_manifest(spark.createDataFrame(parts[0], SCHEMA), COLUMNS, carry=carry)
    for part in parts[1:]:
        m.save(f"file://{tmp_path}/{len(part)}")
        m = M.Manifest.load(spark, f"file://{tmp_path}/{len(part)}")
        m = m.append(spark.createDataFrame(part, SCHEMA), COLUMNS, "lang", "doc_id", carry)
    every = [r for part in parts for r in part]
    whole = M.build_manifest(spark.createDataFrame(every, SCHEMA), COLUMNS, carry=carry)
    assert m.root == whole.root and shown(m) == shown(whole)
    assert m.root.hex() == expected(every)[0][3]


def test_any_other_value_is_told(spark):
    """Every column of a leaf counts, and so does its place: other values, a swap of columns or another leaf's witness fail."""
    rows = rows_of({"en": 70, "de": 3})
    m = M.build_manifest(spark.createDataFrame(rows, SCHEMA), COLUMNS, carry={"doc_id": F.col("doc_id")})
    w = {r.doc_id: r for r in m.witnesses().collect()}
    for r in rows:
        digest = bytes.fromhex(leaf(r))
        assert M.fold_witness(digest, w[r[0]].witness) == m.root
        for other in ((r[0] + 1, *r[1:]), (*r[:3], r[3] + 10, r[4]), (*r[:4], (r[4] or "") + " "), (r[0], r[4], *r[2:4], r[1])):
            if leaf(other) != leaf(r):
                assert M.fold_witness(bytes.fromhex(leaf(other)), w[r[0]].witness) != m.root
    assert M.fold_witness(bytes.fromhex(leaf(rows[0])), w[rows[1][0]].witness) != m.root


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r[c] for c in COLUMNS) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [tuple(r) for r in Q.QUERIES["op11_merkle"](spark, sf).collect()]
    assert sorted(got, key=key) == sorted(expected(rows), key=key)


def test_query_equals_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = [tuple(r[c] for c in names) for r in Q.QUERIES["op11_merkle"](spark, sf).collect()]
    want = con.sql(f"select {', '.join(names)} from ({Q.ORACLE_SQL['op11_merkle']})").fetchall()
    assert sorted(got) == sorted(want)
