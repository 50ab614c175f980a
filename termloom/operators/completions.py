"""A table with the best terms of every prefix, for lookups that need no search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bytestr import prefixes
from ..schema import MAX_K


def completions(dictionary: DataFrame, k: int = MAX_K) -> DataFrame:
    """``(tenant, prefix, rank, term, score)``: each prefix's top K.

    The limit on the rank cuts each task's candidates to K a prefix before the shuffle,
    so even the empty prefix moves K rows a task.
    """
    each = dictionary.select("tenant", F.explode(prefixes(F.col("term"))).alias("prefix"), "term", F.col("frequency").alias("score"))
    order = Window.partitionBy("tenant", "prefix").orderBy(F.desc("score"), F.asc("term"))
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("tenant", "prefix", "rank", "term", "score")


def write(dictionary: DataFrame, path: str, k: int = MAX_K) -> None:
    """Sorted by tenant and prefix, so a lookup's filter skips most row groups."""
    table = completions(dictionary, k)
    table.repartitionByRange("tenant", "prefix").sortWithinPartitions("tenant", "prefix", "rank").write.mode("overwrite").parquet(path)


def look_up(table: DataFrame, tenant: str, prefix: str, k: int) -> DataFrame:
    """As ``prefix_topk``, for any K up to that of the table."""
    found = table.where((F.col("tenant") == tenant) & (F.col("prefix") == prefix) & (F.col("rank") <= k))
    return found.orderBy("rank").select("term", "score")
