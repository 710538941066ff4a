"""The numbered queries: each operator over its whole table, with the parameters meant for production."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from reelframe.llm import crf, exact, leaks, lexical, licenses, mixing, packing, pll, simhash, spelling, sql, suffix, urls, warc
from reelframe.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return crf.quality(docs, crf.train(docs, table(spark, sf_dir, "labels")))


def op2_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(vocabulary_path(), encoding="utf-8") as f:
        return pll.pseudo_likelihood(table(spark, sf_dir, "documents"), f.read())


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op4_suffix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"), bodies=False).drop("kept", "spans")


def op5_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary_path())


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.record_table(warc.read_archive(spark, path))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"), drop=31)


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_quality_crf, op2_pseudo_likelihood, op3_simhash, op4_suffix_index, op5_leaks, op6_exact, op7_url_filter, op8_packing, op9_warc, op10_licenses, op11_spelling, op12_mixing, op13_lexical)}
SQL = {"op4_suffix_index": sql.REPEATS, "op5_leaks": sql.LEAKS, "op6_exact": sql.EXACT, "op9_warc": sql.WARC, "op12_mixing": sql.MIXING, "op13_lexical": sql.RANKS}
