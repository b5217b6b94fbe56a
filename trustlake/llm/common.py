"""Shared helpers of the training-data operators.

Nothing here is tied to one operator: fold columns, a place for intermediate
tables that every executor can reach, and bounded per-process caches.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import resource
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir



# Arrow takes its buffers from the allocator that ``trim`` empties.
pa.set_memory_pool(pa.system_memory_pool())

#: Temporary columns carry this prefix, so they cannot clash with a table's own.
TMP = "__tl_"


#: Rows and bytes of a batch between Spark and Python, at most. Texts are long: Spark's 10,000 rows are held several times over, on both sides.
BATCH_ROWS, BATCH_BYTES = 2000, 8_000_000


def bounded(spark: SparkSession) -> SparkSession:
    """The session with small Arrow batches (a smaller setting of its own stays)."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.fullmatch(r"(\d+)([kmg]?)b?", str(spark.conf.get(key)).lower())
        if not now or not 0 < int(now[1]) * {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}[now[2]] <= most:
            spark.conf.set(key, str(most))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, k: int) -> Column:
    """crc32 of the key as text, modulo ``k``; a null key counts as the text ''."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(k))


#: While a list stands here, stash() notes its folders in it (see ``release``).
NOTED: list[list[str]] = []


@contextlib.contextmanager
def noted() -> Iterator[list[str]]:
    """Folders that stash() writes meanwhile, for ``release`` once what is needed of them has been written elsewhere."""
    folders: list[str] = []
    NOTED.append(folders)
    try:
        yield folders
    finally:
        NOTED[:] = [x for x in NOTED if x is not folders]


def release(docs: DataFrame, folders: list[str]) -> None:
    """Delete noted folders that ``docs`` does not read: what was made from them has been written."""
    spark = docs.sparkSession
    read = docs.inputFiles() if folders else []
    for folder in folders:
        if not any(folder.rpartition("/")[2] in f for f in read):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    folders.clear()


def stash(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks at hand, not the
    steps before, and what two branches need is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for noted in NOTED:
        noted.append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete a stashed table that nothing will read again."""
    folders = list(dict.fromkeys(f.rpartition("/")[0] for f in df.inputFiles()))
    for folder in folders:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner find what finished steps no longer need: it deletes shuffle files once the driver has collected their garbage.

    What Python lets go of in one round the JVM can collect in the next, and what held it in the one after.
    """
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


_TASK: list = [None]
#: Resident memory of a worker's own from which what it has freed goes back in the middle of a task too.
LARGE = 180_000_000


def _resident() -> int:
    try:
        with open("/proc/self/statm") as f:
            _, resident, shared = f.read().split()[:3]
            return (int(resident) - int(shared)) * resource.getpagesize()
    except OSError:  # no such file here
        return 0


def trim() -> None:
    """Called by functions that run in Python workers. A worker serves one task after the other: with the first call of a new one, or when it has grown large, what was freed goes back to the system."""
    task = TaskContext.get()
    now = task and task.taskAttemptId()
    if now is None or now != _TASK[0] or _resident() > LARGE:
        _TASK[0] = now
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # not glibc
            ctypes.CDLL(None).malloc_trim(0)


def arrow_rows(batches: Iterable[pa.RecordBatch], step: int = 2000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``step``, which bounds what one step of Python holds."""
    for b in batches:
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def texts(column: pa.Array) -> list[str]:
    """Python strings; null becomes the empty text."""
    return [x or "" for x in column.to_pylist()]


class Cache(dict):
    """A dict that fills itself through ``make`` and is emptied when it holds ``most`` entries."""

    def __init__(self, make: Callable, most: int = 400_000) -> None:
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value
