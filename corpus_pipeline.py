"""Corpus preparation: each stage takes documents and works on all that it kept.

Quality rules reject documents, near-duplicates leave one of each class, byte strings
that an earlier document has are cut, documents with benchmark passages go, and what is
left is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import bpe, decontaminate, near, quality, suffixes
from termloom.llm.catalog import WORD_BPE
from termloom.llm.common import materialize, ship_code, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, with their columns. A null or empty text is too short
    and goes; repeated rows are judged alike, so all stay or go; no rows give no rows."""
    ship_code(spark)
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id. Rows with a null
    id stay, rows that repeat an id and its words become one, texts without words stay."""
    ship_code(spark)
    return near.keep_first(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that a document with a smaller id has; every row
    stays, one that was cut has a new length. Null texts stay null with their length, a row
    with a null id is not cut, rows with one id do not cut each other."""
    ship_code(spark)
    cut = suffixes.remove_repeats(docs)
    kind = docs.schema["n_chars"].dataType
    length = F.coalesce(F.char_length("text").cast(kind), F.col("n_chars"))
    return cut.withColumn("n_chars", length)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the table ``benchmark``; null and empty texts hold
    none, items with null ids or texts are none."""
    ship_code(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, ids, decoded)`` of every row; a null text is empty."""
    ship_code(spark)
    return bpe.encode(docs, WORD_BPE)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("repeated strings", repeated_strings),
    ("benchmark passages", benchmark_passages),
    ("encoding", encoded),
]

#: Expectation-maximisation and sketches have no SQL; a test holds run() against plain
#: versions of the five stages on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the table ``documents``; what a stage keeps is written and
    read again for the next. An empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
