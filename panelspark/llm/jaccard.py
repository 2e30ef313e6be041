"""Exact Jaccard join of word-shingle sets, and the groups of documents that its links connect."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm import _common as C
from panelspark.llm.components import connected_components
from panelspark.llm.tokens import sliced

_WORDS: dict[bytes, int] = {}


def forget() -> None:
    """A function of the module: tasks get what their closures name as copies, and would clear a copy of _WORDS."""
    _WORDS.clear()


#: Shingles of one unit: as many as these, or so many for each bucket if that is more, of at most UNIT_DOCS documents.
UNIT_SHINGLES = 400_000
BUCKET_SHINGLES = 48
UNIT_DOCS = 65_000
#: Heads of a token that one join task pairs with the others of the token.
HEADS = 2048


def _mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one text after another; and how many each text has."""
    import xxhash

    cut = [t.lower().split() for t in texts]  # of bytes: A-Z, and white space U+0009-000D and U+0020
    new = set().union(*cut).difference(_WORDS)
    if len(_WORDS) > 250_000:
        _WORDS.clear()
        new = set().union(*cut)
    _WORDS.update((w, xxhash.xxh64_intdigest(w)) for w in new)
    sizes = np.array([len(w) for w in cut], np.int64)
    words = np.fromiter(map(_WORDS.__getitem__, chain.from_iterable(cut)), np.uint64, int(sizes.sum()))
    base, whole = np.uint64(0x9E3779B97F4A7C15), np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        whole = whole * base + words[k : k + len(whole)]
    whole = _mix(whole)
    out, counts, at = [], [], 0
    for n in sizes.tolist():
        if n >= width:
            h = np.sort(whole[at : at + n - width + 1])
            h = h[np.append(True, h[1:] != h[:-1])]
        elif n:
            v = np.uint64(n)
            for w in words[at : at + n]:
                v = v * base + w
            h = _mix(np.array([v], np.uint64))
        else:
            h = np.zeros(0, np.uint64)
        out.append(h)
        counts.append(len(h))
        at += n
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.array(counts, np.int64)


def _squeezed(x: np.ndarray, ascending: bool = False) -> bytes:
    """An array as its length and its compressed bytes, those of one place of all numbers together; of ascending numbers
    the differences, whose high bytes are zeros."""
    x = np.diff(x, prepend=x.dtype.type(0)) if ascending else x
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()
    return np.array([len(x)], "<u4").tobytes() + pa.compress(planes, codec="zstd", asbytes=True)


def _restored(raw: bytes, dtype: str, ascending: bool = False) -> np.ndarray:
    n, kind = int(np.frombuffer(raw, "<u4", 1)[0]), np.dtype(dtype)
    planes = pa.decompress(raw[4:], decompressed_size=n * kind.itemsize, codec="zstd", asbytes=True)
    x = np.frombuffer(planes, np.uint8).reshape(kind.itemsize, n).T.copy().view(kind).reshape(n)
    return np.cumsum(x, dtype=kind) if ascending else x


_MESSAGE = "unit bigint, kind int, bucket int, tokens binary, counts binary, docs binary, df binary, doc_ids array<bigint>, text_hashes array<bigint>"


def _message(rows: list[tuple]) -> pa.RecordBatch:
    ids = pa.list_(pa.int64())
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), ids, ids]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _MESSAGE.split(", ")])


def _unit(unit: int, buckets: int, hashes: np.ndarray, sizes: np.ndarray, ids: list, texts: list):
    """Messages of a unit: for each bucket of hashes, those that its documents have, each once, with the documents of
    each; and one that tells the unit's documents, their set sizes and the digests of their sets."""
    import xxhash

    ends = np.cumsum(sizes)
    digests = b"".join(xxhash.xxh3_128_digest(hashes[e - s : e].tobytes()) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True))
    rows = [(unit, 0, unit % buckets, digests, sizes.astype("<u4").tobytes(), None, None, ids, texts)]
    order = np.argsort(hashes, kind="stable")
    hashes, doc = hashes[order], np.repeat(np.arange(len(sizes), dtype="<u2"), sizes)[order]
    starts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
    tokens, many = hashes[starts], np.diff(np.append(starts, len(hashes))).astype("<u2")
    bucket = ((tokens >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist() if len(tokens) else []
    starts = np.append(starts, len(hashes))
    for a, b in zip(cuts, [*cuts[1:], len(tokens)], strict=True):
        rows.append((unit, 1, int(bucket[a]), _squeezed(tokens[a:b], True), _squeezed(many[a:b]), _squeezed(doc[starts[a] : starts[b]]), None, None, None))
        if len(rows) >= 4096:
            yield _message(rows)
            rows = []
    if rows:
        yield _message(rows)


def _send(width: int, buckets: int):
    """Messages of units of documents (see _unit)."""
    full = max(UNIT_SHINGLES, BUCKET_SHINGLES * buckets)

    def run(batches):
        C.take_turn("shingles", forget)
        np.seterr(over="ignore")
        unit = TaskContext.get().partitionId() << 24
        held: list[tuple] = []
        total = docs = 0

        def flush():
            nonlocal unit, total, docs
            parts = list(zip(*held, strict=True))
            yield from _unit(unit, buckets, np.concatenate(parts[0]), np.concatenate(parts[1]), list(chain(*parts[2])), list(chain(*parts[3])))
            held.clear()
            unit, total, docs = unit + 1, 0, 0

        for batch in batches:
            for b in sliced(batch, 512):
                hashes, sizes = shingle_sets(b.column("_text").cast(pa.binary()).to_pylist(), width)
                held.append((hashes, sizes, b.column("_doc").to_pylist(), b.column("_text_hash").to_pylist()))
                total, docs = total + len(hashes), docs + len(sizes)
                if total >= full or docs > UNIT_DOCS - 512:
                    yield from flush()
        if held:
            yield from flush()

    return run


def _answer(batches):
    """For each bucket: in how many documents each hash is; back go those in two or more, with that number."""
    for t in C.runs_of(batches, "bucket"):
        kind = t.column("kind").to_numpy()
        if (kind == 0).any():
            yield from t.filter(pa.array(kind == 0)).combine_chunks().to_batches()
        rows = t.filter(pa.array(kind == 1)).select(["unit", "bucket", "tokens", "counts", "docs"]).to_pylist()
        if not rows:
            continue
        held = [_restored(r["tokens"], "<u8", True) for r in rows]
        tokens = np.concatenate(held)
        many = np.concatenate([_restored(r["counts"], "<u2") for r in rows])
        order = np.argsort(tokens)
        s = tokens[order]
        starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        found = np.empty(len(s), np.int64)
        found[order] = np.repeat(np.add.reduceat(many[order].astype(np.int64), starts), np.diff(np.append(starts, len(s))))
        at, out = 0, []
        for r, own in zip(rows, held, strict=True):
            m = len(own)
            n, f = many[at : at + m], found[at : at + m]
            shared = f > 1
            if shared.any():
                docs = _restored(r["docs"], "<u2")[np.repeat(shared, n)]
                out.append((r["unit"], 1, r["bucket"], _squeezed(own[shared], True), _squeezed(n[shared]), _squeezed(docs), _squeezed(np.minimum(f[shared], 2**32 - 1).astype("<u4")), None, None))
            at += m
            if len(out) >= 256:
                yield _message(out)
                out = []
        if out:
            yield _message(out)


def _assemble(percent: int):
    """For each unit: its documents with set size and digest; of those whose prefix reaches shared hashes also these, the
    rarest first, and how many of them the prefix covers."""

    def run(batches):
        for t in C.runs_of(batches, "unit"):
            rows = t.to_pylist()
            head = next(r for r in rows if r["kind"] == 0)
            n = np.frombuffer(head["counts"], "<u4").astype(np.int64)
            docs, tokens, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for r in rows:
                if r["kind"] == 1:
                    many = _restored(r["counts"], "<u2")
                    docs.append(_restored(r["docs"], "<u2").astype(np.int64))
                    tokens.append(np.repeat(_restored(r["tokens"], "<u8", True), many))
                    found.append(np.repeat(_restored(r["df"], "<u4"), many).astype(np.int64))
            doc, token, df = np.concatenate(docs), np.concatenate(tokens), np.concatenate(found)
            shared = np.bincount(doc, minlength=len(n))
            prefix = np.where(n > 0, n - (percent * n + 99) // 100 + 1 - (n - shared), 0)
            mine = prefix[doc] > 0
            doc, token, df = doc[mine], token[mine], df[mine]
            score = np.bincount(doc, np.log2(df), len(n)) / np.maximum(n, 1)
            order = np.lexsort((token, df, doc))
            doc, token = doc[order], token[order].view(np.int64)
            ends = np.cumsum(np.bincount(doc, minlength=len(n)))
            digests = head["tokens"]
            lists = [token[(ends[k - 1] if k else 0) : ends[k]] if prefix[k] > 0 else None for k in range(len(n))]
            yield pa.record_batch(
                [pa.array(head["doc_ids"], pa.int64()), pa.array(head["text_hashes"], pa.int64()), pa.array(n, pa.int64()), pa.array([digests[16 * k : 16 * k + 16] if n[k] else None for k in range(len(n))], pa.binary()), pa.array(np.maximum(prefix, 0).astype(np.int32)), pa.array(score), pa.array(lists, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n_shingles", "digest", "prefix", "score", "tokens"],
            )

    return run


def shared_shingles(docs: DataFrame, width: int, percent: int, text: str, id_col: str) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest (of the set; null if empty), prefix, score (the mean logarithm of how many
    documents have its shingles) and tokens of every document.

    A link needs a common shingle among the first n - ceil(percent/100 * n) + 1 of both sets in any one order of all
    shingles. Here the order is by the number of documents, so that a document's own shingles come first: one whose
    prefix holds nothing else has no link, and its shingles go no further. Shingles are counted in two steps: tasks send
    each 64-bit hash once for all documents of a unit, and its bucket adds up the units' counts; both travel as compressed
    arrays. Buckets are four for each shuffle partition (2**18 at most) and change no result, only how much a task holds.
    """
    spark = docs.sparkSession
    n = C.partitions(spark)
    buckets = min(4 * n, 1 << 18)
    texts = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("_doc"), F.xxhash64(texts).alias("_text_hash"), texts.alias("_text"))
    sent = rows.mapInArrow(_send(width, buckets), _MESSAGE)
    answered = sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_answer, _MESSAGE)
    back = answered.repartition(n, "unit").sortWithinPartitions("unit")
    return C.materialise(back.mapInArrow(_assemble(percent), "doc_id bigint, text_hash bigint, n_shingles bigint, digest binary, prefix int, score double, tokens array<bigint>"), "shingles")


def _enough(na: Column, nb: Column, inter: Column, percent: int) -> Column:
    """Whether an intersection reaches the similarity."""
    return inter * (100 + percent) >= (na + nb) * percent


def _may_link(percent: int, na: Column, pa_: Column, nb: Column, pb: Column) -> Column:
    """Size and place filter of two sets whose first common token is at these places (from 0) of their orders: no more
    is common than what follows there."""
    return _enough(na, nb, F.least(na - pa_, nb - pb), percent)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of nodes those that link, by their whole sets of shared shingles."""
    of_a = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    of_b = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = pairs.join(of_a, "a").join(of_b, "b")
    return both.where(_enough(F.col("na"), F.col("nb"), F.size(F.array_intersect("ta", "tb")), percent)).select("a", "b")


def shingle_links(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between distinct sets (node, n, prefix, score, tokens), enough to connect all that links connect, and the
    components they make.

    Sets of equal prefix and size form a group, which stands for its members wherever prefixes meet. A token's groups
    meet first with one set of the token, its pivot, that whose shingles most sets have (in a group of near copies the
    one that was changed least): what passes the size and place filters is expanded to members and
    verified, a number of pairs linear in the groups' tokens. Sets that links with pivots connect need no further pair.
    Then all pairs of groups, split by these components, that share a token and pass the filters, but lie in different
    components, are expanded and verified; a token of many groups is dealt to several tasks. Nothing is left out: a link
    between sets of one component adds nothing to it, and each link between two components is among these pairs.
    """
    sets = sets.withColumn("_prefix", F.slice("tokens", 1, F.col("prefix"))).withColumn("gid", C.key128("_prefix", "n"))
    sets = C.materialise(sets.select("node", "n", "score", "tokens", "_prefix", "gid"), "sets")
    own = F.col("n") - F.size("tokens")  # shingles of no other set come first
    groups = sets.groupBy("gid").agg(F.first("n").alias("n"), F.first(own).alias("own"), F.first("_prefix").alias("_prefix"), F.max(F.struct("score", "node")).alias("head"), F.count(F.lit(1)).alias("members"))
    heads = groups.select("gid", "n", "head", "members", "own", F.posexplode("_prefix").alias("_k", "token"))
    heads = C.materialise(heads.select("token", "gid", "n", "head", "members", (F.col("own") + F.col("_k")).alias("place")), "prefixes")
    # in a pair the set that is not the larger one has the token where it may link with one of its own size
    short = _may_link(percent, F.col("n"), F.col("place"), F.col("n"), F.col("place"))
    pivots = heads.groupBy("token").agg(F.max(F.when(short, F.struct("head", "n", "place"))).alias("p"), F.sum("members").alias("m")).where((F.col("m") > 1) & F.col("p").isNotNull())
    pivots = pivots.select("token", F.col("p.head.node").alias("b"), F.col("p.n").alias("nb"), F.col("p.place").alias("pb"))
    near = heads.join(pivots, "token").where(_may_link(percent, F.col("n"), F.col("place"), F.col("nb"), F.col("pb"))).select("gid", "b").distinct()
    pairs = near.join(sets.select("gid", F.col("node").alias("a")), "gid").where(F.col("a") != F.col("b")).select("a", "b")
    first = C.materialise(_verified(pairs, sets, percent), "links")
    parts = connected_components(first)

    placed = sets.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = C.materialise(placed.select("node", "gid", "component"), "placed")
    split = placed.select("gid", "component").distinct()
    heads = heads.select("token", "gid", "n", "place").join(split, "gid")
    mixed = heads.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("c")).where(F.col("x") != F.col("y"))
    heads = C.materialise(heads.join(mixed.select("token", F.ceil(F.col("c") / HEADS).cast("int").alias("tasks")), "token").withColumn("unit", F.struct("n", "gid", "component")), "mixed")
    x = heads.where(short).select("token", F.pmod(F.xxhash64("unit"), "tasks").cast("int").alias("task"), F.col("unit").alias("x"), F.col("place").alias("px"))
    y = heads.select("token", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.col("unit").alias("y"), F.col("place").alias("py"))
    met = x.join(y, ["token", "task"]).where((F.col("x") < F.col("y")) & (F.col("x.component") != F.col("y.component")) & _may_link(percent, F.col("x.n"), F.col("px"), F.col("y.n"), F.col("py")))
    met = met.select(*[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "xy" for c in ("gid", "component")]).distinct()
    member = lambda s, name: placed.select(F.col("gid").alias(f"{s}_gid"), F.col("component").alias(f"{s}_component"), F.col("node").alias(name))
    pairs = met.join(member("x", "a"), ["x_gid", "x_component"]).join(member("y", "b"), ["y_gid", "y_component"]).select("a", "b")
    second = C.materialise(_verified(pairs, sets, percent), "links")
    # what was connected stands for its sets in the last components
    name = lambda s: placed.select(F.col("node").alias(s), F.col("component").alias(f"{s}_component"))
    joined = second.join(name("a"), "a").join(name("b"), "b").select(F.col("a_component").alias("a"), F.col("b_component").alias("b"))
    whole = connected_components(joined).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    named = placed.select("node", "component").join(whole, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    return first.unionByName(second), named


def jaccard_groups(docs: DataFrame, percent: int = 75, width: int = 5, text: str = "text", id_col: str = "doc_id", with_text_hash: bool = False) -> DataFrame:
    """Per row of docs doc_id, n_shingles and component_id: the smallest doc_id that links reach, itself included; with
    with_text_hash also xxhash64 of the text, which tells rows of one id apart.

    Words are split at white space, A-Z in lower case; the set is that of shingles of `width` words, or the whole word
    sequence if shorter. Two documents link if 100 * intersection >= percent * union. Documents of equal sets are one
    class, represented once in the join. 64-bit hashes stand for shingles: two documents would have to hold different
    shingles of one hash, and be within one shingle of the limit, for a wrong link.

    Defined results: null, empty and blank texts have no shingles and no links; null ids never are the smallest, and
    stay as component only where no other id is reached; repeated rows are copies like others; an empty table gives no
    rows; other columns of docs are not read.
    """
    C.prepare(docs.sparkSession)
    sets = shared_shingles(docs, width, percent, text, id_col)
    classes = C.materialise(
        sets.where(F.col("prefix") > 0).groupBy("digest").agg(F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("n"), F.first("prefix").alias("prefix"), F.first("score").alias("score"), F.first("tokens").alias("tokens")).withColumnRenamed("digest", "node"),
        "classes",
    )
    _, found = shingle_links(classes.select("node", "n", "prefix", "score", "tokens"), percent)
    named = C.materialise(classes.select("node", "least_id").join(found, "node"), "named")
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_class = C.materialise(named.select("node", "component").join(least, "component").select(F.col("node").alias("digest"), "component_id"), "class-components")
    out = sets.join(by_class, "digest", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *(["text_hash"] if with_text_hash else []))
