"""Shared helpers: reading tables, cutting lineage in the shared folder, bounded slices
of texts, filters of fixed size, and giving memory back at the end of a task."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.
    Only where that is unset and the session is on one machine, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = got.get() if got.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = tempfile.mkdtemp(prefix="textloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Rows that go to a Python worker at once while a frame is stored. Texts of a few kB make
#: batches of a few MB, on both sides; Spark's 10,000 rows would take tens.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Shuffle files go when the query that made them ends, not when the driver's garbage does.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What stored() wrote within the innermost scratch().
_written: contextvars.ContextVar[list | None] = contextvars.ContextVar("written", default=None)


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: it cuts the
    lineage, so that a lost executor costs only the work behind the cut."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in (_BATCH, _CLEANUP)}
    if not 0 < int(before[_BATCH]) < BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    spark.conf.set(_CLEANUP, "true")
    try:
        with relieved(spark):
            df.write.parquet(at)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(at)
    if (made := _written.get()) is not None:
        made.append((out, at))
    return out


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end what stored() wrote within it, but for the frames given to the
    function that it yields, which the scratch() around it deletes, if there is one."""
    made, kept = [], []
    around = _written.get()
    token = _written.set(made)
    try:
        yield lambda df: kept.append(df) or df
    finally:
        _written.reset(token)
        for df, at in made:
            if not any(df is x for x in kept):
                _delete(spark, at)
            elif around is not None:
                around.append((df, at))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_stored(*frames: DataFrame) -> None:
    """Deletes the files of frames made by stored(), when nothing reads them any more."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, folder)


def forget(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished queries that nothing refers to, and
    the driver give their memory back."""
    trim()
    spark.sparkContext._jvm.System.gc()
    trim_jvm(spark)


def trim_jvm(spark: SparkSession) -> str | None:
    """trim() for the driver's JVM, whose compiler and plans leave freed memory in many
    arenas of the C library: what the JVM says of it, or None if it has no such command."""
    jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    args = new(jvm.java.lang.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    args[2], args[3] = new(jvm.java.lang.Object, 0), new(jvm.java.lang.String, 0)
    # the server's own class is not open, its interface is
    methods = jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods()
    try:
        return next(m for m in methods if m.getName() == "invoke").invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JJavaError:  # another JVM, or system
        return None


@contextlib.contextmanager
def relieved(spark: SparkSession) -> Iterator[None]:
    """Collects the driver's garbage first and whenever its heap has grown meanwhile: plans
    and tasks leave much, and memory that has grown is not given back otherwise."""
    jvm, over = spark.sparkContext._jvm, threading.Event()
    java = jvm.java.lang.Runtime.getRuntime()

    def watch():
        while not over.wait(0.7):
            if java.totalMemory() > 0.6 * java.maxMemory():
                jvm.System.gc()
            trim_jvm(spark)

    if java.totalMemory() > 0.45 * java.maxMemory():
        forget(spark)
    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()


def relieve_executors(spark: SparkSession) -> None:
    """The same on the executors, whose workers need the room that an earlier operator's
    heap keeps: tasks enough that each is likely to get one."""
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trim() -> None:
    """Gives freed memory back to the machine: workers are kept between tasks, and what
    one task left would otherwise count against all later ones."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


#: What the worker's last operator keeps between its tasks, to be dropped by another's.
_kept: list[Callable[[], None]] = []


def released(run: Callable, clear: Callable[[], None] | None = None, drop: Callable[[], None] | None = None) -> Callable:
    """A mapInArrow function that ends with clear() and trim(), whatever happens. What
    drop() frees stays for the next task of the operator, not for those of others."""

    def wrapped(batches):
        for other in _kept:
            if drop is None or (other.__module__, other.__qualname__) != (drop.__module__, drop.__qualname__):
                other()
        _kept[:] = [drop] if drop else []
        try:
            yield from run(batches)
        finally:
            if clear is not None:
                clear()
            trim()

    return wrapped


def text_slices(batch: pa.RecordBatch, at: int, most: int = 1 << 20) -> Iterator[tuple[int, list]]:
    """(first row, texts) of runs of rows with at most so many bytes of text, or one row."""
    column = batch.column(at)
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    low, held = 0, 0
    for k, size in enumerate(sizes):
        if k > low and (held + size > most or k - low == 4096):
            yield low, column.slice(low, k - low).to_pylist()
            low, held = k, 0
        held += size
    if low < len(sizes):
        yield low, column.slice(low).to_pylist()


def in_bitmap(docs: DataFrame, key: str, keys: DataFrame, bits: int = 23) -> DataFrame:
    """docs with __tl_near: false means that its key is surely not among keys. The bitmap
    has 2^bits bits (1 MB) whatever the number of keys, which bounds the broadcast."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    one = F.expr("1L")
    bitmap = keys.select(place(F.col(key)).alias("b")).groupBy(F.floor(F.col("b") / 64).alias("__tl_word")).agg(F.bit_or(F.call_function("shiftleft", one, (F.col("b") % 64).cast("int"))).alias("__tl_bits"))
    near = docs.withColumn("__tl_at", place(F.col(key))).join(F.broadcast(bitmap), F.floor(F.col("__tl_at") / 64) == F.col("__tl_word"), "left")
    hit = F.call_function("shiftrightunsigned", F.col("__tl_bits"), (F.col("__tl_at") % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
    return near.withColumn("__tl_near", F.coalesce(hit, F.lit(False))).drop("__tl_at", "__tl_word", "__tl_bits")


def most_frequent(df: DataFrame, count: str, most: int) -> Column:
    """A predicate that at most ``most`` rows fulfil, those of the largest counts: steps
    of a sixteenth of a power of two are taken from the top while they fit."""
    step = F.floor(F.log2(F.col(count).cast("double")) * 16)
    least, held = 1 << 20, 0
    for found, n in sorted(df.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), reverse=True):
        if held + n > most:
            break
        held, least = held + n, found
    return step >= least


_STEP = np.uint64(0xD6E8FEB86659FD93)
_BASE = 0x5851F42D4C957F2D


def hashes(code: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of words in an array of code points: polynomials modulo 2^64, mixed."""
    with np.errstate(over="ignore"):
        up, down = _powers(len(code))
        value = (code.astype(np.uint64) + np.uint64(1)) * _STEP
        value = (value ^ (value >> np.uint64(29))) * _STEP
        total = np.zeros(len(code) + 1, dtype=np.uint64)
        np.cumsum(value * up, out=total[1:])
        h = (total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)
        h = (h ^ (h >> np.uint64(32))) * _STEP
        return (h ^ (h >> np.uint64(29))).view(np.int64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers_kept
    if len(_powers_kept[0]) < n or len(_powers_kept[0]) > max(n, _FIT):
        size = max(n, _FIT)
        made = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            made.append(np.cumprod(x))
        _powers_kept = tuple(made)
    return _powers_kept[0][:n], _powers_kept[1][:n]


#: Powers kept: those for slices of ordinary size.
_FIT = 1 << 20
_powers_kept: tuple[np.ndarray, np.ndarray] = (np.ones(0, dtype=np.uint64), np.ones(0, dtype=np.uint64))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, where each is first, the place of each key among them)."""
    found = pa.array(keys).dictionary_encode()
    which = found.indices.to_numpy()
    first = np.empty(len(found.dictionary), dtype=np.int64)
    first[which[::-1]] = np.arange(len(which))[::-1]
    return found.dictionary.to_numpy(), first, which
