"""Corpus pipeline: documents to token ids, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each result as Parquet in the shared folder and reads it again as the next
stage's docs. All stages but the last return the columns of documents.

1. language_id: documents without a language (no text, or no letter) go.
2. line_dedup: lines whose key is found in 10 documents or more go; the text
   and n_chars are replaced. A document that loses all its lines stays, empty.
3. near_dup: of each class of near duplicates the smallest doc_id stays.
4. decontaminate: documents that hold a benchmark passage go.
5. byte_bpe: encodes the texts, decodes the ids again, and returns the counts
   and digests of both.

Null doc_ids: such rows are in no class and hold no passage that could be
named, so they stay. Empty tables pass through. Extra columns go along up to
the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.llm import bpe, decontaminate, language, line_dedup, near_dup
from innsight.llm.columns import written
from innsight.llm.rows_by_id import split_by_ids

RANKS = "byte_bpe_multi_50k.tiktoken"

# near duplicates and benchmark items can't be stated in SQL at a fair cost;
# tests/llm/test_pipeline_brute.py compares the rows of run() with a plain version of all stages
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = language.identify(docs)
    return found.filter(F.col("lang_pred") != language.UND).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return line_dedup.dedup_lines(docs).select(*[
        new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = near_dup.near_duplicate_classes(docs)
    others = written(classes.filter("id != class_id").select(F.col("id").alias("doc_id")), "others")
    return split_by_ids(docs, others, ["doc_id"])[1].select(*docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hits = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = written(hits.filter("doc_id IS NOT NULL").select("doc_id").distinct(), "contaminated")
    return split_by_ids(docs, found, ["doc_id"])[1].select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path(RANKS))
    ids = bpe.encode(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN)
    # written in between, so that a task has one Python worker at a time
    return bpe.decode(written(ids.drop("text"), "ids"), ranks, after_encoding=True).select(
        "doc_id", "lang", "source", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup_stage), ("near_dup", near_dup_stage),
          ("decontaminate", decontaminate_stage), ("byte_bpe", byte_bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
