"""Corpus pipeline: quality rules, line dedup, near duplicates, benchmark decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each stage's rows as Parquet in the
shared folder and reads them again as the next one's docs.

Null and empty texts have no words and go with the first stage. Null ids are kept as they are; rows that repeat an id and a
text go to one, rows that repeat an id with another text are documents of their own, and each is a near duplicate or not by its own text. Empty tables: no documents give no pieces, no
labels leave the quality verdict to the fixed rules, no benchmark leaves nothing contaminated. Texts of any length are
worked on whole. Only the columns of `COLUMNS` are read and passed on, so other columns, whatever they are called, never clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from planquant.llm.common import compact, documents, parts_for, shared_table, table, tokenizer_file
from planquant.llm.decontamination import contamination
from planquant.llm.line_dedup import dedup_lines
from planquant.llm.near_duplicates import classes, row_key
from planquant.llm.packing import pack
from planquant.llm.quality_rules import quality_rules

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules(docs, table(spark, sf_dir, "labels"), keep_columns=COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that repeat an earlier one go; what a document keeps stays, documents left without a word go."""
    out = dedup_lines(docs, columns=COLUMNS).select(*COLUMNS[:-1], F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), "n_removed")
    return out.filter("n_removed = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates stays: that of the smallest id (null ids last), whatever ids its others have."""
    firsts = classes(docs, with_rows=True).filter("is_first").groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"))
    kept = docs.select(*COLUMNS, row_key("doc_id", "text").alias("own_key")).join(firsts.hint("shuffle_hash"), F.col("own_key") == F.col("key"))
    once, again = kept.filter("n_rows = 1"), kept.filter("n_rows > 1").dropDuplicates(["own_key"])
    return compact(once.select(*COLUMNS).unionByName(again.select(*COLUMNS)), parts_for(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contract's rule calls contaminated go."""
    return contamination(docs, table(spark, sf_dir, "benchmark"), keep_columns=COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences."""
    return pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_jaccard_join", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: The verdicts of fitted trees and of tokenizers are beyond SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
