"""Tables of a dictionary: an append-only operation log and compacted snapshots.

``log/batch=NAME`` holds a batch of operations with their sequence numbers, those that
failed validation apart (``rejected=true``); it counts once its ``_SUCCESS`` is there. Names
are random, so writers never take each other's; a stream's batches are named after its own
numbers, so writing one again replaces it.

``snapshot/NAME`` holds the dictionary that a compaction made. ``CURRENT-N``, written under
another name and renamed, tells which batches it has folded; the newest N counts, and a reader
folds all other batches over that snapshot. A snapshot keeps each key's last reset (set or
delete) with its number, so an operation that comes late is placed as if it had been in time,
but for one case: a reset older than additions already folded resets those too.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputOutputError, SerializationError, StorageError
from ..operators.dictionary import fold_ops, fold_state, last_write_wins
from ..schema import NO_RESET, OP_LOG, REJECTED_OPS, SNAPSHOT

_OP_COLUMNS = ["seq", "tenant", "term", "op", "weight"]


def stream_batch(stream: str, number: int) -> str:
    """The name of a stream's batch; the name of any other has no dash."""
    return f"{stream}-{number}"


def stream_number(name: str) -> tuple[str | None, int]:
    stream, dash, number = name.rpartition("-")
    return (stream, int(number)) if dash and number.isdigit() else (None, -1)


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        try:
            root = self._path(self.path)
            self._fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
            self._fs.mkdirs(root)
        except Py4JJavaError as e:
            raise InputOutputError(f"can't open {path}: {e.java_exception.getMessage()}") from e

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        if not self._fs.exists(at):
            return []
        return [str(s.getPath().getName()) for s in self._fs.listStatus(at)]

    # current snapshot

    def current(self) -> dict:
        """``version``, ``snapshot`` (its folder), the ``previous`` one, ``seq`` (the highest folded), ``batches``
        that are folded and still there, ``streams`` (the last folded number of each)."""
        versions = [int(n[8:]) for n in self._names("") if n.startswith("CURRENT-") and n[8:].isdigit()]
        if not versions:
            return {"version": 0, "snapshot": None, "previous": None, "seq": -1, "batches": [], "streams": {}}
        name = f"{self.path}/CURRENT-{max(versions)}"
        stream = self._fs.open(self._path(name))
        try:
            text = str(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        try:
            found = json.loads(text)
            return {"version": max(versions)} | {k: found[k] for k in ("snapshot", "previous", "seq", "batches", "streams")}
        except (ValueError, KeyError, TypeError) as e:
            raise SerializationError(f"{name} is unreadable: {text!r}") from e

    def _point(self, version: int, state: dict) -> None:
        side = self._path(f"{self.path}/.next-{uuid.uuid4().hex}")
        stream = self._fs.create(side, True)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        target = self._path(f"{self.path}/CURRENT-{version}")
        if self._fs.exists(target) or not self._fs.rename(side, target):
            self._fs.delete(side, False)
            raise StorageError(f"another compaction made version {version}")

    # log

    def _batches(self) -> list[str]:
        found = self._fs.globStatus(self._path(f"{self.path}/log/batch=*/_SUCCESS")) or []
        return sorted(str(s.getPath().getParent().getName())[6:] for s in found)

    def _pending_batches(self, state: dict, without: str | None = None) -> list[str]:
        """Names of batches that the current snapshot has not folded."""
        folded = set(state["batches"]) | {without}
        out = []
        for name in self._batches():
            stream, number = stream_number(name)
            if name not in folded and (stream is None or number > state["streams"].get(stream, -1)):
                out.append(name)
        return out

    def _read(self, batches: list[str]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], REJECTED_OPS + ", rejected boolean")
        reader = self.spark.read.schema(REJECTED_OPS + ", batch string, rejected boolean").option("basePath", f"{self.path}/log")
        return reader.parquet(*[f"{self.path}/log/batch={n}" for n in batches]).drop("batch")

    def log(self) -> DataFrame:
        """The valid operations of all batches that are still there."""
        return self._read(self._batches()).where("not rejected").select(*_OP_COLUMNS)

    def rejected(self) -> DataFrame:
        """Operations that failed validation, with the ``error``; kept as long as their batch."""
        return self._read(self._batches()).where("rejected").drop("rejected")

    def append(self, ops: DataFrame, batch: str | None = None) -> str | None:
        """Writes operations as one batch and returns its name; an empty batch writes
        nothing. ``ops`` is evaluated once. Rows with an ``error`` are kept apart."""
        name = batch or uuid.uuid4().hex
        rows = ops if "error" in ops.columns else ops.withColumn("error", F.lit(None).cast("string"))
        rows = rows.select(*_OP_COLUMNS, "error", F.col("error").isNotNull().alias("rejected"))
        target = f"{self.path}/log/batch={name}"
        try:
            rows.write.mode("overwrite").partitionBy("rejected").parquet(target)
            if not any(n.startswith("rejected=") for n in self._names(f"log/batch={name}")):
                self._fs.delete(self._path(target), True)
                return None
        except PySparkException as e:
            raise StorageError(str(e)) from e
        return name

    def batch(self, name: str | None) -> DataFrame:
        """The rows of a batch, with ``error`` and ``rejected``."""
        return self._read([name] if name else [])

    def next_seq(self) -> int:
        state = self.current()
        last = self._read(self._pending_batches(state)).agg(F.max("seq").alias("m")).first()["m"]
        return max(-1 if last is None else last, state["seq"]) + 1

    # state

    def ops(self, without: str | None = None) -> DataFrame:
        """The snapshot as operations, and the batches that it has not folded."""
        state = self.current()
        return self._ops(state, self._pending_batches(state, without))

    def _ops(self, state: dict, batches: list[str]) -> DataFrame:
        later = self._read(batches).where("not rejected").select(*_OP_COLUMNS)
        if not state["snapshot"]:
            return later
        base = self.spark.read.schema(SNAPSHOT).parquet(f"{self.path}/snapshot/{state['snapshot']}")
        op = F.when(F.col("frequency").isNull(), "delete").when(F.col("reset").isNotNull(), "set").otherwise("index")
        held = base.select(
            F.coalesce("reset", F.lit(NO_RESET)).alias("seq"), "tenant", "term", op.alias("op"), F.col("frequency").alias("weight")
        )
        return held.unionByName(later)

    def dictionary(self, pending: DataFrame | None = None, without: str | None = None) -> DataFrame:
        ops = self.ops(without)
        return fold_ops(ops if pending is None else ops.unionByName(pending))

    def get(self, tenant: str, term: str) -> DataFrame:
        """``(frequency)`` of one key: only its operations are read and folded."""
        key = (F.col("tenant") == tenant) & (F.col("term") == term)
        return fold_ops(self.ops().where(key)).select("frequency")

    def put(self, tenant: str, term: str, frequency: int) -> None:
        self.write_batch([(tenant, term, frequency)])

    def delete(self, tenant: str, term: str) -> None:
        self.write_batch([(tenant, term, None)])

    def write_batch(self, writes: list[tuple[str, str, int | None]]) -> None:
        """Assignments and, with None, deletes, in order, as one batch."""
        if not writes:
            return
        seq = self.next_seq()
        rows = [(seq + i, t, x, "delete" if f is None else "set", f) for i, (t, x, f) in enumerate(writes)]
        ops = self.spark.createDataFrame(rows, OP_LOG)
        self.append(last_write_wins(ops).join(ops.groupBy("tenant", "term").agg(F.max("seq").alias("seq")), ["tenant", "term"]))

    def compact(self) -> int:
        """Folds the batches that are there now into a new snapshot, sorted by tenant and
        term so that filters skip row groups, and points to it last; returns its version.

        A batch that is added meanwhile is not in the list and stays in the log. What the
        version before had folded is deleted only now, so its readers have had until then.
        """
        state = self.current()
        batches = self._pending_batches(state)
        folded = self._read(batches)
        last = folded.agg(F.max("seq").alias("m")).first()["m"]
        name = uuid.uuid4().hex
        table = fold_state(self._ops(state, batches)).repartitionByRange("tenant", "term").sortWithinPartitions("tenant", "term")
        table.write.parquet(f"{self.path}/snapshot/{name}")
        streams = dict(state["streams"])
        for b in batches:
            stream, number = stream_number(b)
            if stream is not None:
                streams[stream] = max(number, streams.get(stream, -1))
        version = state["version"] + 1
        seq = max(state["seq"], -1 if last is None else last)
        self._point(version, {"snapshot": name, "previous": state["snapshot"], "seq": seq, "batches": batches, "streams": streams})
        past = [f"log/batch={b}" for b in state["batches"]]
        past += [f"snapshot/{state['previous']}"] * bool(state["previous"]) + [f"CURRENT-{version - 2}"]
        for old in past:
            self._fs.delete(self._path(f"{self.path}/{old}"), True)
        return version
