"""From raw documents to packed training sequences: five stages, each written as Parquet and read again.

1. quality: the line field model rejects documents.
2. lines: of near-identical lines over all documents one occurrence stays; a document left without any goes.
3. copies: of every group of near copies one document stays.
4. secrets: secrets are masked.
5. packing: texts become token ids, laid into sequences of at most 4096.

All stages but the last return the columns of ``documents``.  Documents stand for listings: ``doc_id`` is ``id``,
``text`` is ``description``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm import bpe, linededup, linequality, ngramjoin, packing, queries, secrets
from lotwise.session import saved

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: No SQL can express the stages; tests hold them against brute force.
ORACLE_SQL = None


def _listings(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS).withColumnsRenamed({"doc_id": "id", "text": "description"})


def _documents(listings: DataFrame) -> DataFrame:
    """Back to the columns of documents, with the length of the text as it now is."""
    renamed = listings.withColumnsRenamed({"id": "doc_id", "description": "text"})
    length = F.length("text").cast("long")
    return renamed.withColumn("n_chars", F.coalesce(length, F.lit(0).cast("long"))).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, fitted on the labels that are not held out, does not reject."""
    queries.prepared(spark)
    given = _listings(docs)
    model = queries.quality_model(spark, given, sf_dir)
    return docs.select(*COLUMNS).filter(model.column("text") >= linequality.DIVIDE)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated and near-repeated lines; those that keep no line at all go."""
    queries.prepared(spark)
    cleaned = linededup.remove_near_lines(_listings(docs))
    emptied = (F.col("removed_lines") > 0) & ~F.col("description").rlike(r"\S")
    return _documents(cleaned.filter(~emptied))


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: that of the smallest id, a null id counting as the smallest.

    Rows are documents each for itself, also those that share an id or have none.
    """
    queries.prepared(spark)
    # Written once, so that a number means the same row in every job.
    rows = saved(docs.select(*COLUMNS).withColumn("number", F.monotonically_increasing_id()))
    numbered = rows.select(F.col("number").alias("id"), F.col("text").alias("description"))
    groups = ngramjoin.near_copies(numbered, percent=80, width=5).withColumnRenamed("id", "number")
    placed = groups.join(rows.select("number", "doc_id"), "number").select("component", F.struct("doc_id", "number").alias("place"))
    placed = saved(placed)
    kept = placed.groupBy("component").agg(F.min("place").alias("kept"), F.count("place").alias("n")).filter("n > 1")
    gone = placed.join(kept, "component").filter(F.col("place.number") != F.col("kept.number"))
    return rows.join(gone.select("place.number"), "number", "left_anti").select(*COLUMNS)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret masked."""
    queries.prepared(spark)
    return _documents(secrets.mask_secrets(_listings(docs)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, each document ended by id 2, laid into sequences."""
    queries.prepared(spark)
    encoded = bpe.encode_descriptions(_listings(docs), queries.word_vocabulary())
    ended = encoded.withColumn("token_ids", F.concat("token_ids", F.array(F.lit(2))))
    return packing.pack_listings(ended, queries.PACKING).withColumnsRenamed({"id": "doc_id", "total_tokens": "doc_tokens"})


STAGES = [("quality", quality), ("lines", lines), ("copies", copies), ("secrets", masked), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
