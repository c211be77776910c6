"""Corpus pipeline: quality rules, line dedup, n-gram Jaccard join, suffix-array dedup,
best-fit packing over the documents table.

``run`` applies STAGES to ``documents``; each stage's rows are written as Parquet below the
shared checkpoint folder and read again as the next one's input. All but the last return the
columns of ``documents`` (``n_chars`` follows the text). NULL texts count as empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from washbay.llm import line_dedup, ngram_join, packing, quality, suffix_dedup
from washbay.llm.common import ship_package, staged
from washbay.llm.registry import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(rows: DataFrame, text: str) -> DataFrame:
    """The documents columns from doc_id, a new text and ``given`` (lang, source)."""
    return rows.select("doc_id", F.col(text).alias("text"), "given.lang", "given.source",
                       F.length(text).cast("bigint").alias("n_chars"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the risk-controlled quality rules keep."""
    ship_package(spark)
    return quality.keep_good(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines of five documents or more stay only in the largest doc_id; documents that
    lose every line stay with an empty text."""
    ship_package(spark)
    return _with_text(line_dedup.dedup_lines(docs, carry=("lang", "source")), "kept_text")


def ngram_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by Jaccard >= 0.8 of five-word shingles."""
    ship_package(spark)
    return ngram_join.one_per_group(docs.select(*COLUMNS), size=5, num=8, den=10)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that a smaller doc_id holds are removed; a character that
    a removed run splits goes with it."""
    ship_package(spark)
    return _with_text(suffix_dedup.remove_repeats(docs, carry=("lang", "source")), "kept_text")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place."""
    ship_package(spark)
    return packing.pack_documents(docs, tokenizer_path(), end_id=0)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("ngram jaccard join", ngram_stage),
    ("suffix array dedup", suffix_stage),
    ("best fit packing", packing_stage),
]

#: The quality cut, the components, the byte windows and the packing are not SQL; tests/llm
#: compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
