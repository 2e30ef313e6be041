"""Merkle manifest of a dataset: a tree of leaves for each group, a tree over the groups' roots, and a witness for each leaf."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import _common as C

#: Children of a node.
ARITY = 8
#: Levels of one aligned block: a task appends ARITY**HEIGHT leaves to one frontier.
HEIGHT = 3
BLOCK = ARITY**HEIGHT
_SIZE = 32  # bytes of a digest


def node_digest(children: bytes) -> bytes:
    """SHA-256 of the children's digests, given end to end, as lower-case hex."""
    return hashlib.sha256(children.hex().encode()).digest()


def leaf_digest(*columns: Column) -> Column:
    """SHA-256 (binary) of the columns, each as its number of UTF-8 bytes, a colon and its text, or as - where it is null."""
    texts = [c.cast("string") for c in columns]
    told = [F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in texts]
    return F.unhex(F.sha2(F.concat(*told), 256))


def fold_witness(digest: bytes, witness: bytes) -> bytes:
    """The root that a leaf's digest and its witness lead to."""
    at = 0
    while at < len(witness):
        k, n = witness[at] * _SIZE, witness[at + 1] * _SIZE
        others = witness[at + 2 : at + 2 + n]
        digest = node_digest(others[:k] + digest + others[k:])
        at += 2 + n
    return digest


def witness_siblings(witness: bytes) -> bytes:
    """All siblings' digests of a witness, end to end, from the leaf's level upward."""
    out, at = [], 0
    while at < len(witness):
        n = witness[at + 1] * _SIZE
        out.append(witness[at + 2 : at + 2 + n])
        at += 2 + n
    return b"".join(out)


class Run:
    """Up to ARITY leaves under one parent, and the steps of their common witness so far.

    A step is a byte for a node's place among its siblings, a byte for how many others there are, and the others'
    digests from left to right. The leaves' own first step is told by the run itself. `hashed` is false only for a leaf
    that is a whole tree.
    """

    __slots__ = ("first", "leaves", "steps", "hashed")

    def __init__(self, first: int, leaves: list[bytes], hashed: bool = True):
        self.first, self.leaves, self.steps, self.hashed = first, leaves, [], hashed


class Frontier:
    """The open subtrees of one aligned block while leaves are appended from left to right.

    `levels[k]` holds the complete nodes of level k under a parent that is still open, each with the runs below it. When
    the last sibling of a node completes, the runs below every child take the other children as the next step of their
    witness, and the parent joins the level above. No more than one block's digests and witnesses are held.
    """

    def __init__(self):
        self.levels: list[list[tuple[bytes, list[Run]]]] = [[] for _ in range(HEIGHT + 1)]
        self.loose: list[bytes] = []
        self.count = 0

    def append(self, leaf: bytes) -> None:
        self.loose.append(leaf)
        self.count += 1
        if len(self.loose) == ARITY:
            self._close_run()

    def _close_run(self) -> None:
        run = Run(self.count - len(self.loose), self.loose)
        self.loose = []
        self._rise(1, node_digest(b"".join(run.leaves)), [run])

    def _rise(self, level: int, digest: bytes, runs: list[Run]) -> None:
        self.levels[level].append((digest, runs))
        if len(self.levels[level]) == ARITY and level < HEIGHT:
            self._close(level)

    def _close(self, level: int) -> None:
        nodes, self.levels[level] = self.levels[level], []
        for k, (_, runs) in enumerate(nodes):
            step = bytes([k, len(nodes) - 1]) + b"".join(d for j, (d, _) in enumerate(nodes) if j != k)
            for run in runs:
                run.steps.append(step)
        self._rise(level + 1, node_digest(b"".join(d for d, _ in nodes)), [r for _, runs in nodes for r in runs])

    def finish(self, whole: bool) -> tuple[bytes, list[Run]]:
        """Close what is open; gives the block's root and runs. whole: the block is a tree of its own, and the node that
        is left alone is its root; otherwise nodes rise to the block's height even where they are alone."""
        if whole and self.count == 1:
            return self.loose[0], [Run(0, self.loose, hashed=False)]
        if self.loose:
            self._close_run()
        for level in range(1, HEIGHT):
            alone = len(self.levels[level]) == 1 and not any(self.levels[level + 1 :])
            if self.levels[level] and not (whole and alone):
                self._close(level)
        return next(x[0] for x in self.levels if x)


def _grow(carried: list[str]):
    """Leaves sorted by (tree, place) as runs with witnesses up to their block's root. A block ends where the next begins."""

    def closed(frontier: Frontier, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        head = held[0].slice(0, 1).to_pylist()[0]
        root, runs = frontier.finish(head["total"] <= BLOCK)
        rows, n = pa.Table.from_batches(held).combine_chunks(), len(runs)
        cuts = pa.array([*(r.first for r in runs), frontier.count], pa.int32())
        out = {
            "tree": pa.array([head["tree"]] * n, pa.string()),
            "first": pa.array([head["place"] + r.first for r in runs], pa.int64()),
            "leaf_count": pa.array([len(r.leaves) for r in runs], pa.int32()),
            "leaves": pa.array([b"".join(r.leaves) for r in runs], pa.binary()),
            "hashed": pa.array([r.hashed for r in runs], pa.bool_()),
            "steps": pa.array([b"".join(r.steps) for r in runs], pa.binary()),
            "block_root": pa.array([root] * n, pa.binary()),
        } | {c: pa.ListArray.from_arrays(cuts, rows.column(c).chunk(0)) for c in carried}
        return pa.record_batch(list(out.values()), names=list(out))

    def run(batches):
        frontier, held = None, []
        for batch in batches:
            digests = batch.column("digest").to_pylist()
            starts = np.flatnonzero(batch.column("place").to_numpy() % BLOCK == 0).tolist()
            for a, b in zip([0, *starts], [*starts, batch.num_rows], strict=True):
                if a in starts and frontier is not None and a < b:
                    yield closed(frontier, held)
                    frontier, held = None, []
                if a < b:
                    frontier = frontier or Frontier()
                    for x in digests[a:b]:
                        frontier.append(x)
                    held.append(batch.slice(a, b - a))
        if frontier is not None:
            yield closed(frontier, held)

    return run


def _raised(rows: DataFrame, carried: list[str], what: str) -> DataFrame:
    """Runs of leaves (tree, place, digest, total, carried), a block to a task; a written table."""
    dealt = rows.withColumn("_block", F.expr(f"place div {BLOCK}"))
    dealt = dealt.repartition(C.partitions(rows.sparkSession), "tree", "_block").sortWithinPartitions("tree", "_block", "place").drop("_block")
    lists = [f"`{c}` array<{rows.schema[c].dataType.simpleString()}>" for c in carried]
    schema = ", ".join(["tree string, first bigint, leaf_count int, leaves binary, hashed boolean, steps binary, block_root binary", *lists])
    return C.materialise(dealt.mapInArrow(_grow(carried), schema), what)


def _nothing() -> Column:
    return F.unhex(F.lit(""))


def _per_leaf(runs: DataFrame, witness: str, carried: list[str]) -> DataFrame:
    """A row for each leaf: tree, place, digest, its own witness, and the carried columns."""
    each = runs.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("leaf_count") - 1)))
    k, n = F.col("_k"), F.col("leaf_count")
    byte = lambda c: F.unhex(F.lpad(F.hex(c), 2, "0"))
    others = F.concat(F.substring("leaves", F.lit(1), k * _SIZE), F.substring("leaves", (k + 1) * _SIZE + 1, (n - k - 1) * _SIZE))
    step = F.when(F.col("hashed"), F.concat(byte(k), byte(n - 1), others)).otherwise(_nothing())
    return each.select("tree", (F.col("first") + k).alias("place"), F.substring("leaves", k * _SIZE + 1, F.lit(_SIZE)).alias("digest"), F.concat(step, witness).alias("witness"), *[F.get(c, k).alias(c) for c in carried])


@dataclass
class _Climbed:
    """Levels of runs, the leaves' first, each a tree of blocks over the one below; and the root of each tree."""

    levels: list[DataFrame]
    roots: DataFrame  # tree, digest

    def witnesses(self) -> DataFrame:
        """The leaves' runs with `witness`, their steps to the root of their tree but for each leaf's own first one."""
        above = None
        for runs in reversed(self.levels):
            if above is None:
                whole = runs.withColumn("witness", F.col("steps"))
            else:
                up = above.select(F.col("tree").alias("_tree"), F.col("place").alias("_place"), F.col("witness").alias("_up"))
                met = runs.join(up, (F.col("tree") == F.col("_tree")) & (F.expr(f"first div {BLOCK}") == F.col("_place")), "left")
                whole = met.withColumn("witness", F.concat("steps", F.coalesce("_up", _nothing()))).drop("_tree", "_place", "_up")
            above = _per_leaf(whole, "witness", [])
        return whole


def _climb(runs: DataFrame, what: str) -> _Climbed:
    """Block roots are appended to further levels until every tree has one block: a job for each factor of BLOCK."""
    levels, roots = [runs], None
    totals = runs.groupBy("tree").agg(F.max(F.col("first") + F.col("leaf_count")).alias("total"))
    while True:
        blocks = levels[-1].where(F.col("first") % BLOCK == 0).select("tree", F.expr(f"first div {BLOCK}").alias("place"), F.col("block_root").alias("digest"))
        blocks = blocks.join(totals, "tree").withColumn("total", F.expr(f"(total + {BLOCK - 1}) div {BLOCK}"))
        done = blocks.where(F.col("total") == 1).select("tree", "digest")
        roots = done if roots is None else roots.unionByName(done)
        blocks = blocks.where(F.col("total") > 1)
        if blocks.isEmpty():
            return _Climbed(levels, C.materialise(roots, f"{what}-roots"))
        levels.append(_raised(blocks, [], f"{what}-level{len(levels)}"))
        totals = levels[-1].groupBy("tree").agg(F.max(F.col("first") + F.col("leaf_count")).alias("total"))


@dataclass
class Manifest:
    """Roots and witnesses of a dataset. `runs` (tree, first, leaf_count, leaves, hashed, steps, block_root and a list for
    each carried column) is all that has to be kept: blocks that are full never change."""

    runs: DataFrame
    carried: list[str]
    climbed: _Climbed
    top: _Climbed
    _root: list

    @classmethod
    def of(cls, runs: DataFrame, carried: list[str]) -> Manifest:
        climbed = _climb(runs, "merkle")
        names = C.numbered(climbed.roots, [], [F.col("tree")], "place", "merkle-trees", total="total").select(F.lit("").alias("tree"), "place", "digest", "total", F.col("tree").alias("name"))
        top = _climb(_raised(names, ["name"], "merkle-top"), "merkle-top")
        return cls(runs, carried, climbed, top, [bytes(r.digest) for r in top.roots.collect()])  # one row at most

    @property
    def root(self) -> bytes | None:
        """The digest of the whole dataset; None where it is empty."""
        return self._root[0] if self._root else None

    def witnesses(self) -> DataFrame:
        """A row for each leaf: tree, place, leaf, subroot, root, the carried columns and `witness`, its steps to the root.

        Witnesses of blocks meet those of their runs in a join of at most BLOCK / ARITY runs a block; leaves get theirs
        from their run where they lie, so no leaf's witness is shuffled.
        """
        up = _per_leaf(self.top.witnesses(), "witness", ["name"]).select(F.col("name").alias("_tree"), F.col("digest").alias("subroot"), F.col("witness").alias("_up"))
        runs = self.climbed.witnesses().join(up, F.col("tree") == F.col("_tree")).withColumn("witness", F.concat("witness", "_up"))
        runs = runs.withColumn("_subroot", F.array_repeat("subroot", F.col("leaf_count")))
        out = _per_leaf(runs, "witness", ["_subroot", *self.carried])
        tree = F.when(F.col("tree") != "", F.expr("substring(tree, 2)")).alias("tree")
        return out.select(tree, "place", F.col("digest").alias("leaf"), F.col("_subroot").alias("subroot"), F.lit(self.root).cast("binary").alias("root"), *self.carried, "witness")

    def append(self, docs: DataFrame, columns: list[str], tree: str, order: str, carry: dict[str, Column] | None = None) -> Manifest:
        """The manifest with docs as further leaves at the ends of their trees, in the order of `order`.

        Only the last block of a tree that isn't full is opened again: its leaves are appended once more, before the new
        ones. All other runs are taken as they are.
        """
        leaves = _leaves(docs, columns, tree, order, carry or {})
        if sorted(self.carried) != sorted(carry or {}):
            raise ValueError("the same columns have to be carried")
        before = C.materialise(self.runs.groupBy("tree").agg(F.max(F.col("first") + F.col("leaf_count")).alias("_before")), "merkle-before")
        new = leaves.join(before, "tree", "left").withColumn("_before", F.coalesce("_before", F.lit(0)))
        new = new.select("tree", (F.col("place") + F.col("_before")).alias("place"), "digest", (F.col("total") + F.col("_before")).alias("total"), *self.carried)
        grown = new.groupBy("tree").agg(F.max("total").alias("total")).join(before, "tree").where(F.col("_before") % BLOCK > 0)
        grown = C.materialise(grown.select(F.col("tree").alias("_tree"), F.expr(f"_before div {BLOCK}").alias("_block"), "total"), "merkle-grown")
        same = (F.col("tree") == F.col("_tree")) & (F.expr(f"first div {BLOCK}") == F.col("_block"))
        opened = _per_leaf(self.runs.join(grown, same).withColumn("_total", F.array_repeat("total", F.col("leaf_count"))), "steps", ["_total", *self.carried])
        opened = opened.select("tree", "place", "digest", F.col("_total").alias("total"), *self.carried)
        fresh = _raised(opened.unionByName(new), self.carried, "merkle-leaves")
        return Manifest.of(self.runs.join(grown, same, "left_anti").unionByName(fresh), self.carried)

    def save(self, path: str) -> None:
        self.runs.write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Manifest:
        C.prepare(spark)
        runs = spark.read.parquet(path)
        return cls.of(runs, runs.columns[7:])


def _leaves(docs: DataFrame, columns: list[str], tree: str, order: str, carry: dict[str, Column]) -> DataFrame:
    """(tree, place, digest, total, carried): the texts of trees keep their order, and null is the empty one."""
    C.prepare(docs.sparkSession)
    if {c.lower() for c in carry} & {"tree", "first", "leaf_count", "leaves", "hashed", "steps", "block_root", "place", "digest", "total", "witness", "leaf", "root", "subroot", "name"}:
        raise ValueError("carried columns need other names")
    key = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit(""))
    rows = docs.select(key.alias("tree"), F.col(order).alias("_order"), leaf_digest(*map(F.col, columns)).alias("digest"), *[c.alias(n) for n, c in carry.items()])
    return C.numbered(rows, ["tree"], [F.col("_order").asc_nulls_first(), F.col("digest")], "place", "merkle-order", total="total").drop("_order")


def build_manifest(docs: DataFrame, columns: list[str], tree: str = "lang", order: str = "doc_id", carry: dict[str, Column] | None = None) -> Manifest:
    """The Merkle manifest of docs, whose leaves are digests of `columns`.

    Leaves of each value of `tree` ascend by `order` and are gathered ARITY by ARITY until one node is left; the roots of
    the trees, ordered by their value (null first, by UTF-8 bytes), are gathered likewise. Witnesses grow while leaves
    are appended (Frontier): a task streams an aligned block of BLOCK leaves, and the blocks' roots are the leaves of the
    next level, dealt out again, so that a tree of any size is spread over tasks. `carry`: further small columns to have
    beside the witnesses, by name. Texts never move, only digests and carried columns do.

    Defined results: null columns have a mark of their own; null trees are one tree; null orders come first, ties are
    ordered by the leaves' digests, equal rows freely; an empty table has no rows and no root; other columns of docs are
    not read, and a carried name that clashes with a name of the result raises ValueError.
    """
    carry = carry or {}
    runs = _raised(_leaves(docs, columns, tree, order, carry), list(carry), "merkle-leaves")
    return Manifest.of(runs, list(carry))


def fold(rows: DataFrame, digest: str, keep: list[str]) -> DataFrame:
    """`keep` of rows with folded_root (binary), what `digest` and the row's `witness` lead to, and proof_sha256, the
    SHA-256 (hex) of the witness's siblings as hex."""
    C.prepare(rows.sparkSession)

    def run(batches):
        for b in batches:
            pairs = list(zip(b.column(digest).to_pylist(), b.column("witness").to_pylist(), strict=True))
            roots = pa.array([fold_witness(d, w) for d, w in pairs], pa.binary())
            proofs = pa.array([hashlib.sha256(witness_siblings(w).hex().encode()).hexdigest() for _, w in pairs], pa.string())
            yield pa.record_batch([*(b.column(c) for c in keep), roots, proofs], names=[*keep, "folded_root", "proof_sha256"])

    fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    return rows.mapInArrow(run, ", ".join([*fields, "folded_root binary, proof_sha256 string"]))
