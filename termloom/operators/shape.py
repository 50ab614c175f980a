"""The shape a compressed prefix tree of each tenant's terms has, without the tree.

Of a tenant's terms in byte order, each but the first shares a longest prefix with the
one before. The tree has a node for each distinct term or such prefix (the empty one is
the root, which isn't counted), and its edges hold the terms' bytes less the shared ones.

Terms are ordered in groups by their first three bytes, so a large tenant is spread; the
first term of a group shares with the one before it what the groups' bytes share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bytestr import common_prefix_length, latin1, prefixes

GROUP_BYTES = 3


def tenant_stats(dictionary: DataFrame) -> DataFrame:
    """``(tenant, nodes, terms, bytes)`` of every tenant that has a term."""
    rows = dictionary.select("tenant", latin1(F.col("term")).alias("t")).withColumn("g", F.substring("t", 1, GROUP_BYTES))
    within = Window.partitionBy("tenant", "g").orderBy("t")
    rows = rows.withColumn("_before", F.lag("t").over(within))
    groups = rows.select("tenant", "g").distinct()
    across = F.lag("g").over(Window.partitionBy("tenant").orderBy("g"))
    groups = groups.withColumn("_shared", common_prefix_length(F.col("g"), across))
    rows = rows.join(groups, ["tenant", "g"]).withColumn(
        "l", F.when(F.col("_before").isNull(), F.col("_shared")).otherwise(common_prefix_length(F.col("t"), F.col("_before")))
    )
    sums = rows.groupBy("tenant").agg(
        F.count("*").alias("terms"), F.sum(F.length("t") - F.col("l")).cast("bigint").alias("bytes")
    )
    nodes = rows.select("tenant", F.explode(F.array("t", F.expr("substring(t, 1, l)"))).alias("s")).where("s <> ''")
    counted = nodes.distinct().groupBy("tenant").agg(F.count("*").alias("nodes"))
    return sums.join(counted, "tenant", "left").select("tenant", F.coalesce("nodes", F.lit(0)).alias("nodes"), "terms", "bytes")


def highest_below(dictionary: DataFrame) -> DataFrame:
    """``(tenant, prefix, max_frequency)`` for every prefix of every term."""
    each = dictionary.select("tenant", F.explode(prefixes(F.col("term"))).alias("prefix"), "frequency")
    return each.groupBy("tenant", "prefix").agg(F.max("frequency").alias("max_frequency"))
