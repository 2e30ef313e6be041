"""A corpus pipeline of five stages: language identification, line deduplication, near duplicates, benchmark
decontamination and packing. Each stage's rows are written as Parquet in the shared folder and read by the next.

Stages 1 to 4 return the columns of documents. They keep every row that they don't reject for the stated reason:

* language_id: texts without a letter, and texts in which no language has half of the words, go.
* line_dedup: of lines found in ten or more documents only the first stays; documents left without words go.
* near_duplicates: of documents that links of word-shingle similarity 0.75 connect, that of the least doc_id stays;
  documents without words have no links and stay, and of rows equal in id and text one stays, any of them where their
  other columns differ. Rows of one id with different texts count as one document: where it is the least of its group all
  of its texts stay, near copies of each other too. Rows with null ids take no part in links: they stay, and no other row
  goes because of them.
* decontamination: documents that have a benchmark item go.
* packing: token ids of what is left, in sequences of 1024.

Rows with null ids pass all stages; where a stage needs to tell documents apart, null ids are told apart by their texts.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import _common as C
from panelspark.llm import crf, decontaminate, jaccard, lines, packing
from panelspark.llm.queries import tokenizer_file


def _apart(docs: DataFrame, made: set[str]) -> tuple[DataFrame, list]:
    """docs with new names for columns that an operator's result would replace; and the columns that give docs' own names back."""
    name = {c: f"_in_{k}" if c.lower() in made else c for k, c in enumerate(docs.columns)}
    return docs.select(*[F.col(c).alias(n) for c, n in name.items()]), [F.col(n).alias(c) for c, n in name.items()]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    model = crf.fit(docs)
    if not model.labels:
        return docs.where(F.col("text").rlike(r"\p{L}"))  # nothing to learn from: only letters can be asked for
    rows, back = _apart(docs, {"lang_pred", "score"})
    labelled = crf.label_languages(rows, model, carry_text=True)
    return labelled.where((F.col("lang_pred") != crf.UNKNOWN) & (F.col("score") >= 0.5)).select(*back)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, back = _apart(docs, {"kept_text", "n_lines", "n_dropped"})
    out = lines.dedup_lines(rows, min_docs=10, shortest=1, keep_first=True)
    out = out.where((F.col("n_dropped") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("bigint")).select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named = docs.where(F.col("doc_id").isNotNull())
    groups = jaccard.jaccard_groups(named, percent=75, width=5, with_text_hash=True)
    first = C.materialise(groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_t")).distinct(), "first-of-group")
    text_hash = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    kept = named.join(first.hint("shuffle_hash"), (docs["doc_id"] == first["_id"]) & (text_hash == first["_t"]), "left_semi")
    kept = kept.unionByName(docs.where(F.col("doc_id").isNull()))
    return kept.withColumn("_in_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "_in_hash"]).drop("_in_hash")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, C.table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), window=1024)
    return out.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: Language identification, latent retrieval and tokens are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
