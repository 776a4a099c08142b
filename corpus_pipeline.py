"""From raw documents to token ids: five stages, each over everything that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of ``documents``; columns beyond those travel along, whatever their names. An empty table stays empty in every
stage. There is no SQL for the whole, as SQL cannot express the merges of the last
stage; tests/llm/test_pipeline.py compares it with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.llm import bpe, decontaminate, jaccard, quality, secrets
from mensura.llm.batches import tokenizer_file
from mensura.llm.files import new_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy rejects go, those with null, empty or short texts among them. Rows are judged one by one: repeated rows alike,
    whatever their ids."""
    return quality.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked, directly or by others, the one with the smallest id stays; a null id counts as larger than any other.

    Rows that repeat an id and a text become one; texts without words, null ones included, are linked with nothing and all stay.
    """
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat the benchmark go. Null and empty texts have no words and stay; repeated rows are judged alike, whatever their ids."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, repeated rows and null ids included; secrets are replaced, and the length follows the text. A null text stays null."""
    return secrets.redact_documents(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What training reads: each document's tokens, checked by decoding them. Null and empty texts have no tokens; every row gives one row."""
    ranks = tokenizer_file("byte_bpe_50k.tiktoken")
    decoded = bpe.decode(bpe.encode(docs, ranks, keep=["doc_id", "lang", "source"]), ranks)
    return decoded.select(
        "row.*", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("token_ids", token_ids),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = new_folder(spark, name)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
