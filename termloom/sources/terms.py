"""Dictionaries, operation logs and requests out of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("tenant"), F.col("p_name").alias("term"), F.lit(1).cast("bigint").alias("weight")
    )


def document_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's words, its language as the tenant."""
    words = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("tenant"), F.explode(F.split("text", "\\s+")).alias("term"), F.lit(1).cast("bigint").alias("weight")
    )
    return words.where("term <> ''")


def event_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an operation log: errors delete, sign-ups set, the rest index."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("tenant"),
        F.col("props").alias("term"),
        F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "set").otherwise("index").alias("op"),
        F.floor("value").cast("bigint").alias("weight"),
    )


def benchmark_requests(spark: SparkSession, sf_dir: str, typo: int = 0, k: int = 10) -> DataFrame:
    """A request for the first word of each item, to the tenant ``en``."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.lit("en").alias("tenant"),
        F.element_at(F.split("text", "\\s+"), 1).alias("query"),
        F.lit(k).alias("k"),
        F.lit(typo).alias("typo"),
    )


def json_input(rows: DataFrame, column: str = "value") -> DataFrame:
    """Index calls as JSON texts ``{"tenant", "term", "weight"}``; weight 1 if absent."""
    parsed = rows.select(F.from_json(column, "tenant string, term string, weight bigint").alias("j"))
    return parsed.select("j.tenant", "j.term", F.coalesce("j.weight", F.lit(1).cast("bigint")).alias("weight"))
