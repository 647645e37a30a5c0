"""Clean a table of documents for training, in four stages over whole tables.

1. quality: documents that the compression classifier rejects go (fitted on the labels, see granary.llm.quality).
2. lines: a line that repeats an earlier one, exactly or within few edits (one for every twelve characters, two at
   most), goes from its document; the document stays, with the text that is left and its length (n_chars, where
   documents have that column).
3. near_duplicates: of each component of documents whose five-word shingles have Jaccard 0.8 or more, the document of
   the smallest doc_id stays (see granary.llm.near_texts).
4. packing: what is left, as sequences of power-of-two lengths.

Every stage but the last returns the columns of documents, with their names and values whatever they are (columns
called score, predicted, n_lines or n_removed too). Null texts count as empty, and empty documents pass through the
first two stages like any other (stage 3 keeps one of them). Repeated rows are near duplicates of each other, so one
stays; rows of one key with different texts are different documents; null keys are the smallest. Very long texts are
read whole, and an empty table gives no rows. Each stage's rows are written as Parquet to the folder that
spark.checkpoint.dir names, and read again, so a lost executor costs no more than one stage's tasks; what a stage
wrote for itself is deleted then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import line_dedup, near_texts, packing, pretokens, quality
from granary.llm.common import cleared, fresh_path, python_tasks, table


def fresh_names(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, each with as many underscores behind it as make it no column of docs."""
    taken = {c.lower() for c in docs.columns}
    return tuple(next(n + "_" * k for k in range(len(taken) + 1) if n + "_" * k not in taken) for n in names)


def quoted(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    python_tasks(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    names = fresh_names(docs, "score", "predicted")
    return quality.score(docs, model, names=names).where(F.col(names[1]) == 1).select(*quoted(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = line_dedup.without_repeated_lines(docs, counts=None)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*quoted(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    python_tasks(spark)
    return near_texts.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    python_tasks(spark)
    return packing.pack(docs, pretokens.path("byte_bpe_50k.json"), end_id=1)


STAGES = [("quality", keep_good), ("lines", drop_repeated_lines), ("near_duplicates", drop_near_duplicates), ("packing", pack)]

#: SQL cannot express the classifier, the shingles or the tokenizer; tests hold the stages to brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        with cleared(spark):
            done = stage(spark, docs, sf_dir)
            done.write.parquet(path)
        docs = spark.read.schema(done.schema).parquet(path)
    return docs
