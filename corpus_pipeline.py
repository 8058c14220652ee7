"""The corpus pipeline: quality classifier, line dedup, near-duplicate groups, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with all their columns; the last returns packed pieces.
A stage's result is written as Parquet and read again as the next one's documents. Empty tables pass through
every stage; rows with a null text are judged by the classifier's bias and otherwise carried along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import line_dedup, mixing, ngram_join, packing, quality_classifier
from millrace.llm.common import folded, fresh, shared_folder, written
from millrace.llm.queries import table, tokenizer_path, word_count


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score of at least 0.5). It learns from the labels outside the held-out fold."""
    model = quality_classifier.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").where(~folded("doc_id")))
    (score,) = fresh(docs.columns, "score")
    return quality_classifier.scored(docs, model, name=score).where(F.col(score) >= 0.5).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines, short ones too; those that lose every non-blank line go. n_chars follows the text.

    Rows without a doc_id are carried along; rows of one doc_id are one document to this stage.
    """
    prefix = "lines_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    out = line_dedup.without_repeated_lines(docs, fewest=1, prefix=prefix).where(~F.col(f"{prefix}emptied"))
    return (out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one whose doc_id names the group.

    Of rows with one doc_id the first by the hash of the text, then of all columns, stays; rows without a doc_id link
    with nothing and stay.
    """
    key, several, number, met = fresh(docs.columns, "key", "several", "number", "met")
    kept = written(ngram_join.near_groups(docs).where("doc_id is not null").select(F.col("doc_id").alias(key), (F.col("doc_id") == F.col("component_id")).alias("kept")))
    numbered = docs.withColumn(number, F.col("doc_id").cast("long"))
    repeated = numbered.groupBy(number).agg(F.count("*").alias(several)).where(F.col(several) > 1).select(number)
    # texts of documents that stay as they are, and are told so by a bitmap, are not shuffled
    marked = line_dedup.told(numbered, kept.where("not kept").select(key).unionByName(repeated.select(F.col(number).alias(key))), number, met)
    rest = [c for c in docs.columns if c != "doc_id"]
    order = F.struct(F.xxhash64("text"), F.xxhash64(*rest))
    joined = marked.where(met).join(kept.where("kept"), F.col(number) == F.col(key), "left_semi")
    one = joined.groupBy("doc_id").agg(F.min_by(F.struct(*rest), order).alias(key))
    return one.select("doc_id", f"{key}.*").select(*docs.columns).unionByName(marked.where(~F.col(met)).select(*docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole copies of documents, up to two of each, so that the sources' words come near their targets.

    Rows that repeat a doc_id are taken as often as the first of them; rows without a doc_id are mixed as well, as one
    document for each source.
    """
    doc, src, copies, copy = fresh(docs.columns, "doc", "src", "copies", "copy")
    taken = mixing.mix(docs.select("doc_id", "source", word_count().alias("size")), rest="whole").where("taken > 0")
    often = taken.groupBy(F.col("doc_id").alias(doc), F.col("source").alias(src)).agg(F.max(F.expr("CAST(taken DIV size AS INT)")).alias(copies))
    out = docs.join(often, docs["doc_id"].eqNullSafe(often[doc]) & docs["source"].eqNullSafe(often[src]))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), copies))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents in sequences of at most 4096 tokens; each copy of a document is packed."""
    return packing.pack(packing.pieces(docs, tokenizer_path()))


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("ngram_join", near_duplicates), ("mixing", mixture), ("packing", packed)]
#: Training, rounding and packing can't be put in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
