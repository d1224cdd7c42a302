"""From ``documents`` to packed training sequences in five stages; each is written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freightdocs.llm import line_chunks, minhash, packing, quality_rules, secrets
from freightdocs.llm.common import read_table, shared_dir, tokenizer_path

#: Words in one generation of a worker's cache: the workers stay, with all they hold, for the next steps.
CACHE = 100_000


def counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` after a stage has changed texts."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the quality rules; null and empty texts do not."""
    return quality_rules.passing(docs, quality_rules.trusted_rows(read_table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts all runs of two or more lines that occurred before; a document goes only if nothing but blanks is left of it by that."""
    found = line_chunks.deduplicated(docs)
    kept = found.filter((F.col("cut_lines") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return counted(kept.select(*docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near copies, once; a document without an id stays."""
    return minhash.representatives(docs)


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by the name of its kind; all documents stay."""
    return counted(secrets.redacted(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids and their places in sequences of 4096."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), keep_ids=True, cache=CACHE)


STAGES = [("quality rules", quality), ("line dedup", lines), ("MinHash near-dedup", near_copies), ("secret scan", secret_spans),
          ("best-fit packing", pack)]
ORACLE_SQL = None  # hashed n-grams, rolling hashes and the tokenizer have no counterpart in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
