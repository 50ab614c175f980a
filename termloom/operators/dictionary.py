"""Building and folding dictionaries: ``(tenant, term, frequency)``, a row per live term.

An operation log has rows ``(seq, tenant, term, op, weight)``, with ``op`` one of index
(adds the weight), set (replaces) and delete (removes), and ``seq`` unique. Sums stop at
the largest BIGINT. A missing weight counts as 1; weight 0 makes a live term of frequency 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FREQUENCY_CAP

KEY = ["tenant", "term"]
#: Operations of a key are ordered within blocks of so many sequence numbers, so a key
#: with most of a log is spread over many tasks.
SEQ_BLOCK = 65_536


def capped_sum(weight: Column) -> Column:
    """The sum of weights from 0 on, none null; one beyond BIGINT stops at the cap."""
    return F.coalesce(F.try_sum(weight), F.lit(FREQUENCY_CAP))


def weight_or_one(weight: Column) -> Column:
    return F.coalesce(weight, F.lit(1).cast("bigint"))


def from_terms(rows: DataFrame) -> DataFrame:
    """Dictionary of index calls ``(tenant, term, weight)``."""
    return rows.groupBy(*KEY).agg(capped_sum(weight_or_one(F.col("weight"))).alias("frequency"))


def set_terms(rows: DataFrame) -> DataFrame:
    """Dictionary of assignments ``(seq, tenant, term, weight)``: the last one holds."""
    return rows.groupBy(*KEY).agg(F.max_by(weight_or_one(F.col("weight")), "seq").alias("frequency"))


def fold_ops(log: DataFrame) -> DataFrame:
    """Dictionary after a log.

    A key's frequency is the sum of what follows its last delete or set, with that set.
    Both steps are aggregates with a map-side part and the join between them has one row
    a key on one side, so a hot key is summed on many tasks and its join can be split.
    """
    last = log.where("op in ('delete', 'set')").groupBy(*KEY).agg(F.max("seq").alias("_last"))
    live = log.join(last, KEY, "left").where("op <> 'delete' and (_last is null or seq >= _last)")
    return live.groupBy(*KEY).agg(capped_sum(weight_or_one(F.col("weight"))).alias("frequency"))


def fold_state(log: DataFrame) -> DataFrame:
    """``(tenant, term, frequency, reset)``: as ``fold_ops``, with the number of each key's
    last delete or set; a deleted key stays with a null frequency."""
    last = log.where("op in ('delete', 'set')").groupBy(*KEY).agg(F.max("seq").alias("reset"))
    return fold_ops(log).join(last, KEY, "full").select(*KEY, "frequency", "reset")


def last_write_wins(log: DataFrame) -> DataFrame:
    """``(tenant, term, op, weight)`` of each key's last operation: what a batch of writes
    leaves, a delete as a null weight."""
    last = log.groupBy(*KEY).agg(F.max_by(F.struct("op", "weight"), "seq").alias("w"))
    return last.select(*KEY, F.col("w.op").alias("op"), F.when(F.col("w.op") != "delete", F.col("w.weight")).alias("weight"))


def _blocks(log: DataFrame, block: int) -> DataFrame:
    return log.withColumn("_block", F.floor(F.col("seq") / block))


def rejected_deletes(log: DataFrame, block: int = SEQ_BLOCK) -> DataFrame:
    """Deletes of a term that is absent then: the key's first operation is one, or the
    operation before is a delete."""
    rows = _blocks(log, block)
    ends = rows.groupBy(*KEY, "_block").agg(F.max_by("op", "seq").alias("_end"))
    before = ends.withColumn("_before", F.lag("_end").over(Window.partitionBy(*KEY).orderBy("_block"))).drop("_end")
    previous = F.lag("op").over(Window.partitionBy(*KEY, "_block").orderBy("seq"))
    seen = rows.withColumn("_previous", previous).join(before, [*KEY, "_block"])
    return seen.where("op = 'delete' and coalesce(_previous, _before, 'delete') = 'delete'").select("seq", *KEY)


def running_totals(log: DataFrame, block: int = SEQ_BLOCK) -> DataFrame:
    """``(seq, tenant, term, op, total)``: a term's frequency after each operation, null
    after a delete.

    Each block of a key gives its sum since its last reset; a window over blocks carries
    sums into the next ones, and a window within a block adds the rest.
    """
    reset = F.col("op").isin("delete", "set").cast("int")
    added = F.when(F.col("op") == "delete", 0).otherwise(weight_or_one(F.col("weight"))).cast("decimal(38,0)")
    inner = Window.partitionBy(*KEY, "_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = _blocks(log, block).withColumn("_added", added).withColumn("_epoch", F.sum(reset).over(inner))
    by_epoch = rows.groupBy(*KEY, "_block", "_epoch").agg(F.sum("_added").alias("_sum"))
    tails = by_epoch.groupBy(*KEY, "_block").agg(F.max("_epoch").alias("_resets"), F.max_by("_sum", "_epoch").alias("_tail"))
    over = Window.partitionBy(*KEY).orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    tails = tails.withColumn("_run", F.sum((F.col("_resets") > 0).cast("int")).over(over))
    reach = Window.partitionBy(*KEY, "_run").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    tails = tails.withColumn("_reach", F.sum("_tail").over(reach))
    carried = tails.select(
        *KEY, "_block", F.coalesce(F.lag("_reach").over(Window.partitionBy(*KEY).orderBy("_block")), F.lit(0)).alias("_carry")
    )
    within = Window.partitionBy(*KEY, "_block", "_epoch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("_added").over(within) + F.when(F.col("_epoch") == 0, F.col("_carry")).otherwise(0)
    capped = F.least(total, F.lit(FREQUENCY_CAP).cast("decimal(38,0)")).cast("bigint")
    return rows.join(carried, [*KEY, "_block"]).select(
        "seq", *KEY, "op", F.when(F.col("op") != "delete", capped).alias("total")
    )


def term_counts(dictionary: DataFrame) -> DataFrame:
    return dictionary.groupBy("tenant").agg(F.count("*").alias("terms"))


def tenant_count(dictionary: DataFrame) -> DataFrame:
    return dictionary.agg(F.count_distinct("tenant").alias("tenants"))
