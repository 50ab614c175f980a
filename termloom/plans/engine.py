"""The engine: multi-tenant writes and searches over a store.

A write is seen by the next read of the same engine: operations not yet flushed are folded
over what the store has. They are flushed when a batch is full and at the latest
``flush_interval_ms`` after the first of them; while a flush runs, up to ``channel_capacity``
more are taken, and then writers wait.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Backpressure, NotFound
from ..functions.validate import check_tenant, check_term, judged
from ..operators import search
from ..operators.dictionary import rejected_deletes
from ..operators.shape import tenant_stats
from ..schema import DEFAULT_K, DEFAULT_WEIGHT, OP_LOG, Config
from .store import Store


class Engine:
    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config = spark, config
        self.store = Store(spark, config.data_dir)
        self._room = threading.Condition(threading.RLock())
        self._flushing = threading.Lock()
        self._pending: list[tuple[int, str, str, str, int | None]] = []
        self._inflight: tuple[str, list] | None = None
        self._timer: threading.Timer | None = None
        self._seq = self.store.next_seq()
        # one row a tenant, however many terms
        self._seen = {r["tenant"] for r in self.store.dictionary().select("tenant").distinct().toLocalIterator()}
        self._open = True

    @staticmethod
    def open(spark: SparkSession, config: Config = Config()) -> Engine:
        return Engine(spark, config)

    def dictionary(self) -> DataFrame:
        with self._room:
            name, rows = self._inflight or (None, [])
            rows = rows + self._pending
            pending = self.spark.createDataFrame(rows, OP_LOG) if rows else None
            return self.store.dictionary(pending, without=name)

    def frequency(self, tenant: str, term: str) -> int | None:
        row = search.exact(self.dictionary(), tenant, term).first()
        return row["frequency"] if row else None

    def contains(self, tenant: str, term: str) -> bool:
        return self.frequency(tenant, term) is not None

    def submit(self, tenant: str, term: str, op: str, weight: int | None) -> None:
        """Queues an operation; waits while the queue is full."""
        with self._room:
            self._room.wait_for(lambda: not self._open or len(self._pending) < self.config.channel_capacity)
            self.try_submit(tenant, term, op, weight)

    def try_submit(self, tenant: str, term: str, op: str, weight: int | None) -> None:
        """Queues an operation; a full queue is an error."""
        with self._room:
            if not self._open:
                raise Backpressure("the engine is shut down")
            if len(self._pending) >= self.config.channel_capacity:
                raise Backpressure("the queue is full")
            self._pending.append((self._seq, tenant, term, op, weight))
            self._seq += 1
            if op != "delete":
                self._seen.add(tenant)
            full = len(self._pending) >= self.config.max_batch
            if not full and self._timer is None:
                self._timer = threading.Timer(self.config.flush_interval_ms / 1000, self.flush)
                self._timer.daemon = True
                self._timer.start()
        if full:
            self.flush(wait=False)

    def index(self, tenant: str, term: str, weight: int = DEFAULT_WEIGHT) -> int:
        """Adds weight to a term and returns its new frequency."""
        check_tenant(tenant)
        check_term(term)
        self.submit(tenant, term, "index", weight)
        return self.frequency(tenant, term)

    def _take(self, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Appends operations, evaluated once, and returns (accepted, rejected) as stored."""
        written = self.store.batch(self.store.append(judged(ops)))
        self._seq = max(self._seq, (written.agg(F.max("seq").alias("m")).first()["m"] or 0) + 1)
        good = written.where("not rejected").drop("rejected", "error")
        self._seen |= {r["tenant"] for r in good.where("op <> 'delete'").select("tenant").distinct().toLocalIterator()}
        return good, written.where("rejected").drop("rejected")

    def index_batch(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Indexes ``(tenant, term, weight)`` rows in one job; returns (accepted, rejected)."""
        self.flush()
        with self._room:
            seq = F.monotonically_increasing_id() + self._seq
            ops = rows.select(seq.alias("seq"), "tenant", "term", F.lit("index").alias("op"), F.col("weight").cast("bigint"))
            good, bad = self._take(ops)
        columns = ["tenant", "term", "weight"]
        return good.select(*columns), bad.select(*columns, "error", F.lit(400).alias("status"))

    def apply(self, ops: DataFrame) -> DataFrame:
        """Appends an operation log, ordered by its ``seq``; returns what it rejects as
        ``(seq, tenant, term, error)``: invalid tenants, terms and kinds, and deletes of
        terms that are absent then."""
        self.flush()
        with self._room:
            first, before = self._seq, self.store.ops()
            good, bad = self._take(ops.withColumn("seq", F.col("seq") + first))
            absent = rejected_deletes(before.unionByName(good)).where(F.col("seq") >= first)
        every = bad.select("seq", "tenant", "term", "error").unionByName(absent.withColumn("error", F.lit("no such term")))
        return every.withColumn("seq", F.col("seq") - first)

    def delete(self, tenant: str, term: str) -> None:
        check_tenant(tenant)
        check_term(term)
        with self._room:
            if not self.contains(tenant, term):
                raise NotFound(f"no such term: {term}")
            self.submit(tenant, term, "delete", None)

    def query(self, tenant: str, prefix: str, k: int = DEFAULT_K) -> DataFrame:
        return search.prefix_topk(self.dictionary(), tenant, prefix, k)

    def query_fuzzy(self, tenant: str, query: str, edits: int, k: int = DEFAULT_K) -> DataFrame:
        return search.fuzzy_topk(self.dictionary(), tenant, query, edits, k)

    def query_batch(self, requests: DataFrame) -> DataFrame:
        return search.prefix_topk_batch(self.dictionary(), requests)

    def query_fuzzy_batch(self, requests: DataFrame) -> DataFrame:
        return search.fuzzy_topk_batch(self.dictionary(), requests)

    def stats(self) -> DataFrame:
        """``(tenant, nodes, terms, bytes)`` by tenant; a tenant whose last term went
        stays with zeros until the engine is opened again."""
        live = tenant_stats(self.dictionary())
        seen = self.spark.createDataFrame([(t,) for t in sorted(self._seen)], "tenant string")
        every = live.join(seen, "tenant", "full").na.fill(0, ["nodes", "terms", "bytes"])
        return every.orderBy("tenant")

    def tenant_count(self) -> int:
        return len(self._seen)

    def flush(self, wait: bool = True) -> None:
        """Writes what is queued as one batch. If that fails, it is queued again. Without
        ``wait``, nothing is done while another flush runs."""
        if not self._flushing.acquire(blocking=wait):
            return
        try:
            with self._room:
                if self._timer is not None:
                    self._timer.cancel()
                    self._timer = None
                if not self._pending:
                    return
                name, rows = uuid.uuid4().hex, self._pending
                self._inflight, self._pending = (name, rows), []
                self._room.notify_all()
            done = False
            try:
                self.store.append(self.spark.createDataFrame(rows, OP_LOG), name)
                done = True
            finally:
                with self._room:
                    self._inflight = None
                    if not done:
                        self._pending = rows + self._pending
        finally:
            self._flushing.release()

    def compact(self) -> int:
        self.flush()
        with self._flushing:
            return self.store.compact()

    def shutdown(self) -> None:
        """Flushes what is queued; later writes are refused."""
        with self._room:
            self._open = False
            self._room.notify_all()
        self.flush()
