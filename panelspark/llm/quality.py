"""Quality rules over documents: word and line measures, and lines that many documents of a host share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm._common import SPACE

_EDGES = " \t\n\x0b\x0c\r"


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def _normal(line: Column) -> Column:
    """A line's key: edges stripped, lower case."""
    return F.lower(F.trim(line, F.lit(_EDGES)))


def _repeated_words(grams: Column, sorted_grams: Column) -> Column:
    """Words in windows of three whose hash occurs again: equal hashes are neighbours once (hash, place) pairs are sorted."""
    again = F.filter(sorted_grams, lambda x, i: ((i > 0) & (F.get(sorted_grams, i - 1)["h"] == x["h"])) | F.coalesce(F.get(sorted_grams, i + 1)["h"] == x["h"], F.lit(False)))
    return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))


def base_measures(rows: DataFrame, text: str) -> DataFrame:
    """rows with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the whole text."""
    rows = rows.withColumn("_words", word_array(F.coalesce(F.col(text), F.lit(""))))
    rows = rows.withColumn("_lines", F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.trim(x, F.lit(_EDGES)) != ""))
    hashes = F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))
    rows = rows.withColumn("_grams", F.when(F.size("_words") >= 3, hashes))
    pairs = F.array_sort(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_pairs", F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"), pairs))
    return rows.withColumns({
        "n_words": F.size("_words").cast("bigint"),
        "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
        "n_symbols": F.coalesce(F.regexp_count(F.col(text), F.lit("[#*$%&|<>]")), F.lit(0)).cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "n_repeat_words": F.when(F.col("_pairs").isNotNull(), _repeated_words(F.col("_grams"), F.col("_pairs"))).otherwise(0).cast("bigint"),
        "_line_chars": F.length(F.array_join(F.transform("_lines", _normal), "")).cast("bigint"),
    }).drop("_words", "_grams", "_pairs", "_lines")


def shared_lines(docs: DataFrame, min_docs: int, share: float) -> DataFrame:
    """Per document (_null, _doc, _hash) the places of lines that too many documents of its host have, and their characters.

    A line is too common in a host if at least min_docs documents of the host, and more than `share` of them, have it.
    A document is an id and a text; copies under other ids are documents of their own. Counts are pre-aggregated by
    (host, line, document), so that a line of very many documents is no single task; the common lines meet the others in
    a join whose large side can be split.
    """
    lines = docs.select("_host", "_null", "_doc", "_hash", F.posexplode(F.split("_text", "\n")).alias("_pos", "_line"))
    lines = lines.withColumn("_line", _normal(F.col("_line"))).where(F.col("_line") != "")
    lines = lines.select("_host", "_null", "_doc", "_hash", "_pos", F.xxhash64("_line").alias("_l1"), F.hash("_line").alias("_l2"), F.length("_line").alias("_chars"))
    one = F.xxhash64("_null", "_doc", "_hash")
    hosts = docs.groupBy("_host").agg(F.count_distinct(one).alias("_host_docs"))
    counts = lines.groupBy("_host", "_l1", "_l2").agg(F.count_distinct(one).alias("_line_docs")).where(F.col("_line_docs") >= min_docs)
    common = counts.join(hosts, "_host").where(F.col("_line_docs") > F.col("_host_docs") * share).select("_host", "_l1", "_l2")
    found = lines.join(common, ["_host", "_l1", "_l2"]).groupBy("_null", "_doc", "_hash").agg(F.collect_set(F.struct("_pos", "_chars")).alias("_found"))
    return found.select("_null", "_doc", "_hash", F.col("_found._pos").alias("_places"), F.aggregate("_found", F.lit(0).cast("bigint"), lambda a, x: a + x["_chars"]).alias("_removed"))


def _without(text: Column, places: Column) -> Column:
    lines = F.split(text, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places)
    return F.array_join(F.transform(left, lambda k: F.get(lines, k)), "\n")


def quality_rules(docs: DataFrame, min_words: int = 50, most_repeated: int = 50, min_docs: int = 10, share: float = 0.05, depleted: float = 0.3, text: str = "text", id_col: str = "doc_id", host: str = "source") -> DataFrame:
    """Rows of docs with the base measures, base_failed, removed_lines, removed_chars, line_chars, kept and cleaned_text.

    base_failed: fewer than min_words words, or more than most_repeated percent of them in repeated windows of three.
    cleaned_text: the text without the lines that too many documents of its host have (see shared_lines); the text only
    travels to that join if this column is asked for. kept: not base_failed, and what is left of the lines has at least
    the part `depleted` of their characters. Both line limits must be passed: in a host of many documents a line of up
    to `share` of them stays, however many that are.

    Defined results: null text has no words and fails, its cleaned text is empty; a null host is a host of its own; null
    ids are told apart by their texts, rows equal in id and text are one document and get one verdict each; an empty
    table gives no rows; columns of docs with names made here, or that begin with `_q_`, are replaced.
    """
    made = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_lines", "removed_chars", "line_chars", "kept", "cleaned_text"}
    keep = [c for c in docs.columns if c.lower() not in made and not c.lower().startswith("_q_")]
    carried = [F.col(c).alias(f"_q_{k}") for k, c in enumerate(keep)]
    rows = docs.select(
        *carried,
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
        F.col(id_col).isNull().alias("_null"),
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(0)).alias("_doc"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_hash"),
        F.coalesce(F.col(host).cast("string"), F.lit("\0")).alias("_host"),
    )
    removed = shared_lines(rows.select("_text", "_null", "_doc", "_hash", "_host"), min_docs, share)
    out = base_measures(rows, "_text").join(removed, ["_null", "_doc", "_hash"], "left")
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeated)
    gone = F.coalesce("_removed", F.lit(0).cast("bigint"))
    return out.select(
        *[F.col(f"_q_{k}").alias(c) for k, c in enumerate(keep)],
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        F.coalesce(F.size("_places"), F.lit(0)).cast("bigint").alias("removed_lines"),
        gone.alias("removed_chars"),
        F.col("_line_chars").alias("line_chars"),
        (~failed & (F.col("_line_chars") - gone >= F.col("_line_chars") * depleted)).alias("kept"),
        F.when(F.col("_places").isNull(), F.col("_text")).otherwise(_without(F.col("_text"), F.col("_places"))).alias("cleaned_text"),
    )
