"""Continuous ingestion: a stream of operations into a store, and running totals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.validate import judged
from ..operators.dictionary import capped_sum, weight_or_one
from ..plans.store import Store, stream_batch
from ..schema import DICTIONARY, FREQUENCY_CAP, OP_LOG, Config
from ..sources.terms import json_input


def read_ops(spark, path: str, config: Config = Config(), source: str = "parquet") -> DataFrame:
    """A stream of the operation files that appear in a folder."""
    reader = spark.readStream.format(source).schema(OP_LOG).option("maxFilesPerTrigger", config.max_batch)
    return reader.load(path)


def write_ops(ops: DataFrame, store: Store, checkpoint: str, config: Config = Config(), available_now: bool = False) -> StreamingQuery:
    """Appends each micro-batch under the batch's own number; operations that fail
    validation are kept apart in it (``Store.rejected``).

    A batch that runs again after a failure replaces what it wrote, so nothing is
    counted twice; a failing write fails the query and is replayed, not dropped.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def append(batch: DataFrame, number: int) -> None:
        store.append(judged(batch), stream_batch(stream, number))

    writer = ops.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": f"{config.flush_interval_ms} milliseconds"}
    return writer.trigger(**trigger).start()


def read_json_ops(spark, path: str, config: Config = Config()) -> DataFrame:
    """A stream of index calls, a JSON object ``{"tenant", "term", "weight"}`` a line, as
    operations. They commute, so they all have the number 0."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", config.max_batch).load(path)
    return json_input(lines).select(F.lit(0).cast("bigint").alias("seq"), "tenant", "term", F.lit("index").alias("op"), "weight")


def running_frequencies(ops: DataFrame) -> DataFrame:
    """``(tenant, term, frequency)`` kept up to date over a stream of index operations
    alone, for the output mode ``update``; sums stop at the cap."""
    added = ops.where("op = 'index'").groupBy("tenant", "term")
    return added.agg(capped_sum(weight_or_one(F.col("weight"))).alias("frequency"))


_STATE = "frequency decimal(38,0), reset bigint"
_CHANGED = "tenant string, term string, frequency bigint"


def _fold_key(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    total, reset = state.get if state.exists else (None, None)
    rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
    for seq, op, weight in zip(rows["seq"], rows["op"], rows["weight"], strict=True):
        if reset is not None and seq < reset:
            continue  # came late: what reset the term came after it
        added = Decimal(1 if pd.isna(weight) else int(weight))
        if op == "index":
            total = added + (total or 0)
        else:
            total, reset = (None if op == "delete" else added), int(seq)
    state.update((total, reset))
    frequency = None if total is None else min(int(total), FREQUENCY_CAP)
    yield pd.DataFrame({"tenant": [key[0]], "term": [key[1]], "frequency": pd.array([frequency], dtype="Int64")})


def running_dictionary(ops: DataFrame) -> DataFrame:
    """``(tenant, term, frequency)`` of the terms that a micro-batch changes, over a stream
    of index, set and delete operations, for the output mode ``update``; a deleted term has
    a null frequency. Within a micro-batch operations are ordered by ``seq``; one that comes
    later than a reset with a higher number is left out.

    The state of a term is its sum and its last reset. Built-in aggregates cannot undo a
    sum at a delete, so this is a grouped map with state."""
    return ops.groupBy("tenant", "term").applyInPandasWithState(_fold_key, _CHANGED, _STATE, "update", GroupStateTimeout.NoTimeout)


def write_changes(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the rows that each micro-batch changes under the batch's number, over all
    that is there now; one that runs again replaces what it wrote."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/number={number}")

    writer = changes.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def latest(spark, path: str) -> DataFrame:
    """The dictionary that changes lead to: each term's last row, without deleted terms."""
    rows = spark.read.schema(DICTIONARY + ", number bigint").parquet(path)
    last = rows.groupBy("tenant", "term").agg(F.max_by(F.struct("frequency"), "number").alias("l"))
    return last.select("tenant", "term", "l.frequency").where("frequency is not null")
