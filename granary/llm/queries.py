"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, digests, html_text, line_dedup, packing, pretokens, quality, simhash, token_counts, token_files
from .common import fresh_path, python_tasks, table


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    python_tasks(spark)
    uri = fresh_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), uri, pretokens.path("word_bpe_49k.json"), end_id=2)
    return token_files.token_file_digests(spark, uri)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    python_tasks(spark)
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    python_tasks(spark)
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), pretokens.path("word_bpe_49k.json"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    python_tasks(spark)
    return packing.pack(table(spark, sf_dir, "documents"), pretokens.path("byte_bpe_50k.json"), end_id=1)


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    python_tasks(spark)
    return html_text.page_texts(table(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    python_tasks(spark)
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    python_tasks(spark)
    return token_counts.token_counts(table(spark, sf_dir, "documents"), pretokens.path("byte_bpe_50k.json"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    python_tasks(spark)
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op10_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    python_tasks(spark)
    return digests.edited_likeness(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_simhash, op3_bpe_codec, op4_packing, op5_main_text, op6_line_dedup, op7_quality, op8_token_counts, op9_nearest, op10_digests)}
ORACLE_SQL: dict[str, str] = {}
