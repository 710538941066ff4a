"""Corpus pipeline: quality, exact copies, near copies, benchmark leaks, packing; each stage works on what the one before kept."""

from __future__ import annotations

import os
import sys
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from reelframe.llm import crf, exact, leaks, nearcopies, packing  # noqa: E402
from reelframe.llm.queries import table, vocabulary_path  # noqa: E402
from reelframe.session import shared_dir, ship  # noqa: E402


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores 0.5 or more; it is fitted on documents and labels of sf_dir. Every row is judged by its own text, null as empty; an empty
    table stays empty."""
    ship(spark)
    model = crf.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.filter(crf.scorer(model)(F.col("text").cast("string")) >= 0.5)


def with_digest(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_sha", exact.sha256(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def keep_named(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows whose id and text digest are in kept (doc_id, sha), one for each; null ids count as equal."""
    same = F.col("_sha").eqNullSafe(F.col("sha")) & F.col("d.doc_id").eqNullSafe(F.col("k.doc_id"))
    return with_digest(docs).alias("d").join(kept.distinct().alias("k"), same, "left_semi").dropDuplicates(["doc_id", "_sha"]).select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays, once; of documents without an id one of each text stays if no document with an id has it."""
    return keep_named(docs, exact.exact_groups(docs).filter("kept").select("doc_id", F.col("text_sha256").alias("sha")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more in 5-word shingles the one with the smallest id stays, once; null ids come last. Texts are named by id and digest, so
    another text under the same id is judged by itself."""
    ship(spark)
    found = nearcopies.near_copies(docs)
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_sha256") == F.col("keep_sha256"))
    return keep_named(docs, found.filter(stays).select("doc_id", F.col("text_sha256").alias("sha")))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text holds no benchmark item, whatever their id."""
    gone = leaks.leaking_texts(docs, table(spark, sf_dir, "benchmark")).select(F.col("sha").alias("_sha")).distinct()
    return with_digest(docs).join(gone, "_sha", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of every document, null text as empty, with its sequence and place; an empty table gives no pieces."""
    ship(spark)
    return packing.pack_documents(docs, vocabulary_path())


STAGES = [("quality", keep_good), ("exact copies", drop_copies), ("near copies", drop_near_copies), ("benchmark leaks", drop_leaks), ("packing", pack)]

#: the classifier, the fingerprints and the tokens have no SQL form; tests hold every stage against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each stage's rows written below the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    name, stage = STAGES[-1]
    path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
    stage(spark, docs, sf_dir).write.parquet(path)
    return spark.read.parquet(path)
