"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word and white-space classes of the query contracts, as Java regular expressions.
SPACE = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a local session gets a
    temporary one; on a cluster, whose executors share no local folder, it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that the executors share")
        path = tempfile.mkdtemp(prefix="termloom-")
        spark.conf.set("spark.checkpoint.dir", path)
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back.

    It cuts lineage: later stages that lose an executor reread the files. A void
    column is written as a string, since Parquet has no void type.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):  # the table stands for the shuffles that made it
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_writing = threading.Lock()
_writers: dict[str, list] = {}


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when the query that made them ends; threads that write at the same
    time share the setting, and the last one puts it back."""
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    with _writing:
        state = _writers.setdefault(spark.sparkContext.applicationId, [0, "false"])
        if not state[0]:
            state[1] = spark.conf.get(cleanup, "false")
            spark.conf.set(cleanup, "true")
        state[0] += 1
    try:
        yield
    finally:
        with _writing:
            state[0] -= 1
            if not state[0]:
                spark.conf.set(cleanup, state[1])


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a ``materialize`` table that no later step reads."""
    spark = df.sparkSession
    jvm = spark._jvm
    seen = {f.rpartition("/")[0] for f in df.inputFiles()}
    for folder in seen:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application, so Python workers need
    no copy of it on their path."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="termloom-code-")  # on the driver, which serves the file
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/{package.name}.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(f"{folder}/{package.name}.zip")
    _shipped.add(context.applicationId)


class Cache(dict):
    """A worker's cache, bounded in bytes by a rough count of what its entries take; a full
    one is emptied, and a key longer than a hundredth of the bound is not kept."""

    def __init__(self, bound: int, each: int):
        super().__init__()
        self.bound, self.each, self.left = bound, each, bound

    def keep(self, key, value, size: int) -> None:
        """Stores an entry whose key and value have ``size`` bytes."""
        if 100 * size > self.bound:
            return
        if self.left < size + self.each:
            self.clear()
            self.left = self.bound
        self.left -= size + self.each
        self[key] = value


_emptied: dict[str, Callable[[], None]] = {}
_served: list[str] = []


def on_leaving(operator: str, empty: Callable[[], None]) -> None:
    """States how to drop what an operator keeps in a worker process between tasks."""
    _emptied[operator] = empty


def enter(operator: str) -> None:
    """A task's first step. Worker processes serve one operator after the other; what the
    others cached is dropped, and freed memory goes back to the system."""
    if _served != [operator]:
        for name, empty in _emptied.items():
            if name != operator:
                empty()
        _served[:] = [operator]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of files that a block of documents may stand for.
BLOCK_BYTES = 64_000_000


def blocks(docs: DataFrame) -> int:
    """Into how many blocks, each a task's work, documents are dealt: as many as shuffle
    partitions, and more where these would outgrow a task by the size of the tables read
    (a table of unknown size does not count)."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return max(partitions(docs.sparkSession), sum(n for n in sizes if n < 2**60) // BLOCK_BYTES)


def whole_text(column: str = "text") -> F.Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
