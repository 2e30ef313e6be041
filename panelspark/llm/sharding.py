"""Shards cut from a Hilbert curve over document metadata, with statistics for file pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm._common import discard, materialise, partitions

#: Cells of one dimension: 2**BITS.
BITS = 5
DIMS = 3
#: Rows of one cell are ordered in 2**FINE parts by their texts' hashes, and those in as many by their ids', so that
#: neither a cell nor a text with very many rows is a single task.
FINE = 12


def hilbert_index(coords: list[Column], bits: int = BITS) -> Column:
    """Index along the Hilbert curve of a point with integer coordinates below 2**bits.

    Bit planes are taken from the highest; (entry corner, direction) of the current subcube turn each plane's corner
    into the next digit by Gray code.
    """
    n = len(coords)
    full = (1 << n) - 1
    gray = [i ^ (i >> 1) for i in range(full + 1)]
    inverse = F.array(*[F.lit(gray.index(i)) for i in range(full + 1)])
    entry = F.array(*[F.lit(0 if w == 0 else gray[2 * ((w - 1) // 2)]) for w in range(full + 1)])

    def trailing_ones(i: int) -> int:
        return (~i & (i + 1)).bit_length() - 1

    turn = F.array(*[F.lit(0 if w == 0 else trailing_ones(w - 1 if w % 2 == 0 else w) % n) for w in range(full + 1)])
    rotl = lambda x, k: (_shl(x, k).bitwiseOR(_shr(x, n - k))).bitwiseAND(F.lit(full))
    rotr = lambda x, k: (_shr(x, k).bitwiseOR(_shl(x, n - k))).bitwiseAND(F.lit(full))

    def step(acc: Column, plane: Column) -> Column:
        corner = F.lit(0)
        for j, c in enumerate(coords):
            corner = corner.bitwiseOR(_shl(_shr(c, plane).bitwiseAND(F.lit(1)), F.lit(j)))
        k = acc["d"] + 1
        w = F.get(inverse, rotr(corner.bitwiseXOR(acc["e"]), k))
        return F.transform(
            F.array(w),
            lambda w: F.struct(
                (acc["h"] * (full + 1) + w).cast("int").alias("h"),
                acc["e"].bitwiseXOR(rotl(F.get(entry, w), k)).cast("int").alias("e"),
                ((acc["d"] + F.get(turn, w) + 1) % n).cast("int").alias("d"),
            ),
        )[0]

    start = F.struct(F.lit(0).alias("h"), F.lit(0).alias("e"), F.lit(0).alias("d"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0)), start, step, lambda acc: acc["h"])


def _shl(x: Column, k: Column) -> Column:
    return F.call_function("shiftleft", x, k)


def _shr(x: Column, k: Column) -> Column:
    return F.call_function("shiftright", x, k)


def _value(c: str) -> Column:
    """A column as text; null comes before all others."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))


def cell_bounds(docs: DataFrame, column: str, bits: int = BITS) -> list[str]:
    """At most 2**bits - 1 values that cut the sorted values of a column into cells of about equally many rows.

    Values next to each other in a cell are so in order, so the range of a file's values tells what it has. A value with
    very many rows has a cell of its own. Rows are first counted by value; the values are range-partitioned, summed up
    within partitions and over them, and only the bounds come to the driver.
    """
    spark, side = docs.sparkSession, 1 << bits
    counts = docs.groupBy(_value(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    dealt = materialise(counts.repartitionByRange(partitions(spark), "v").select("v", "n", F.spark_partition_id().alias("p")), "values")
    parts = dealt.groupBy("p").agg(F.sum("n").alias("n"))  # a row for each partition
    every = Window.orderBy("p")
    offsets = parts.select("p", (F.sum("n").over(every) - F.col("n")).alias("before"), F.sum("n").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    upto = F.sum("n").over(Window.partitionBy("p").orderBy("v"))
    ranked = dealt.select("p", "v", (upto - F.col("n")).alias("local")).join(F.broadcast(offsets), "p")
    cell = F.expr(f"(before + local) * {side} div total")
    firsts = ranked.groupBy(cell.alias("cell")).agg(F.min("v").alias("v")).collect()  # a row for each cell
    discard(dealt)
    return sorted(r.v for r in firsts)[1:]


def hilbert_shards(docs: DataFrame, shards: int = 40, law: str = "rows", text: str = "text", id_col: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """Rows of docs with size, text_crc32, curve, shard and slot: equal runs of the Hilbert order of (language, source, size).

    Language and source are quantised to at most 2**BITS cells of their sorted values (see cell_bounds), size by its
    logarithm. All rows of a text take the least (language, source) cell that one of them has, and within a cell of the
    curve rows are ordered by hashes of the text and then the id: equal texts lie together, whatever their languages and
    sources, and only a cut of the law splits them. law `rows`: shard counts differ by one
    at most; `bytes`: runs are cut where the running size passes equal shares. Ranks come from nested sums, over cells
    (at most 2**(3*BITS) rows), over parts by text hash and by id hash, and over the rows of a part; no task sorts more
    than one part, so one source, or one text, with most rows is spread.

    Defined results: null text has size 16 and checksum 0; null language, source or id count as values of their own;
    rows equal in id and text are ordered freely among themselves; an empty table gives no rows; columns of docs with
    the names made here, or that begin with `_s_`, are replaced.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(law)
    made = {"size", "text_crc32", "curve", "shard", "slot"}
    keep = [c for c in docs.columns if c.lower() not in made | {text.lower()} and not c.lower().startswith("_s_")]
    back = [F.col(f"_s_{k}").alias(c) for k, c in enumerate(keep)]
    side = 1 << BITS

    def cell(column: str) -> Column:
        bounds = cell_bounds(docs, column)
        return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x <= _value(column))) if bounds else F.lit(0)

    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 16
    level = F.least(F.floor(F.log2(size) * 1.5), F.lit(side - 1)).cast("int")
    rows = docs.select(
        *[F.col(c).alias(f"_s_{k}") for k, c in enumerate(keep)],
        size.alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(5), F.coalesce(F.col(text), F.lit(""))).alias("_text"),
        F.xxhash64(F.lit(6), F.col(id_col)).alias("_id"),
        (cell(lang) * side + cell(source)).alias("_cell"),
        level.alias("_level"),
    )
    spread = rows.groupBy("_text").agg(F.min("_cell").alias("_least"), F.max("_cell").alias("_most")).where(F.col("_least") < F.col("_most"))
    spread = materialise(spread.select(F.col("_text").alias("_same"), "_least"), "spread-texts")  # a table, so that the join of a text's rows can be split
    rows = rows.join(spread, F.col("_text") == F.col("_same"), "left").withColumn("_cell", F.coalesce("_least", "_cell"))
    rows = rows.withColumn("curve", hilbert_index([F.expr(f"_cell div {side}").cast("int"), (F.col("_cell") % side).cast("int"), F.col("_level")]))
    rows = rows.drop("_same", "_least", "_cell", "_level")
    top = lambda c: F.call_function("shiftrightunsigned", F.col(c), F.lit(64 - FINE)).cast("int")
    rows = rows.withColumns({"_p": top("_text"), "_q": top("_id"), "_weight": F.col("size") if law == "bytes" else F.lit(1).cast("bigint")})
    fine = rows.groupBy("curve", "_p", "_q").agg(F.sum("_weight").alias("_w"), F.count(F.lit(1)).alias("_n"))
    parts = fine.groupBy("curve", "_p").agg(F.sum("_w").alias("_w"), F.sum("_n").alias("_n"))
    cells = parts.groupBy("curve").agg(F.sum("_w").alias("_w"), F.sum("_n").alias("_n"))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    everywhere = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = cells.select("curve", *[before(Window.orderBy("curve"), c).alias(f"_cell{c}") for c in ("_w", "_n")], F.sum("_w").over(everywhere).alias("_total"))
    parts = parts.select("curve", "_p", *[before(Window.partitionBy("curve").orderBy("_p"), c).alias(f"_part{c}") for c in ("_w", "_n")])
    fine = fine.select("curve", "_p", "_q", *[before(Window.partitionBy("curve", "_p").orderBy("_q"), c).alias(f"_fine{c}") for c in ("_w", "_n")])
    offsets = fine.join(parts, ["curve", "_p"]).join(F.broadcast(cells), "curve")  # at most 2**(3*BITS) cells
    offsets = offsets.select("curve", "_p", "_q", "_total", *[(F.col(f"_cell{c}") + F.col(f"_part{c}") + F.col(f"_fine{c}")).alias(f"_o{c}") for c in ("_w", "_n")])
    in_part = Window.partitionBy("curve", "_p", "_q").orderBy("_text", "_id", "text_crc32")
    ranked = rows.withColumn("_local", before(in_part, "_weight")).join(offsets, ["curve", "_p", "_q"])
    ranked = ranked.withColumn("_before", F.col("_o_w") + F.col("_local"))
    ranked = ranked.withColumn("shard", F.expr(f"_before * {int(shards)} div _total").cast("int"))
    if law == "rows":
        first = F.expr(f"(shard * _total + {int(shards) - 1}) div {int(shards)}")
        return ranked.select(*back, "size", "text_crc32", "curve", "shard", (F.col("_before") - first).alias("slot"))
    rank = ranked.withColumn("_rank", F.row_number().over(in_part) + F.col("_o_n"))
    firsts = rank.groupBy("shard").agg(F.min("_rank").alias("_first"))  # one row for each shard
    return rank.join(F.broadcast(firsts), "shard").select(*back, "size", "text_crc32", "curve", "shard", (F.col("_rank") - F.col("_first")).cast("bigint").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, rows in curve order: readers skip files by the ranges of `shard_manifest`."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_manifest(sharded: DataFrame, dims: list[str]) -> DataFrame:
    """Rows, bytes and the range of each dimension in each shard: what a reader prunes by."""
    ranges = [f(c).alias(f"{name}_{c}") for c in dims for name, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), *ranges)
