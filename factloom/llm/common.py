"""Shared plumbing of the text operators: reading tables, durable checkpoints
and byte-level views of Arrow string columns.

Texts travel in Arrow batches. A column's value buffer is one contiguous byte
array, so hashing and scanning run over all texts of a chunk at once and no
Python object is made per word.
"""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once inside an Arrow batch. It bounds the working
#: memory of the numpy kernels; results never depend on it.
CHUNK_BYTES = 1 << 20

#: Bytes of an Arrow batch at most, so that a batch of long texts stays small beside an executor's memory.
BATCH_BYTES = 8 << 20

#: ``[\x20\x09-\x0D]``: the white space of the word definition.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back from there.

    A cluster names the folder in ``spark.checkpoint.dir``; only where that is
    unset on a local master (tests, a laptop) a temporary one is made. Without
    it a cluster has no folder that all its machines see, so that is an error.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-"))
    out = df.checkpoint(eager=True)
    # Shuffle files that the written table replaces go when the driver's heap is collected, which a driver that
    # only plans does rarely: without a nudge a chain of stages keeps the files of all of them on the executors.
    spark.sparkContext._jvm.System.gc()
    trim_driver(spark)
    return out


def trim_driver(spark: SparkSession) -> bool:
    """Give native memory that is free in the driver back to the system; False where its JVM can't (before 17.0.9, or not on Linux).

    Compiled code, class loading and map statuses leave it some 200 MB over many plans, which collecting the heap keeps.
    """
    release()
    jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    try:
        args = new(jvm.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        args[2], args[3] = new(jvm.Object, 0), new(jvm.String, 0)
        # The server's class is not open to reflection, its interface is.
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke").invoke(server, args)
    except (Py4JError, TypeError):
        return False
    return True


#: A key that more than this share of all rows has is hot; there are at most as many hot keys.
HOT_SHARE = 1000


def join_hot(left: DataFrame, right: DataFrame, key: str, right_key: str, weight: str, total: int) -> DataFrame:
    """Left join of ``left`` with ``right`` on a key that a third of all rows of ``left`` may share.

    ``weight`` in ``right`` says how many rows of ``left`` have its key, of
    ``total``. Rows with one of the at most ``HOT_SHARE`` hot keys are joined by
    broadcast, where they stand; the others by Spark's choice; null keys join
    nothing and do not move. ``right`` has one row for a key.
    """
    right = checkpoint(right)
    on = F.col(key) == F.col(right_key)
    hot, cold = right.where(F.col(weight) * HOT_SHARE > total), right.where(F.col(weight) * HOT_SHARE <= total)
    if hot.isEmpty() and left.where(F.col(key).isNull()).isEmpty():
        return left.join(right, on, "left")
    names = hot.select(F.col(right_key).alias("hot_key")).distinct()
    marked = left.join(F.broadcast(names), F.col(key) == F.col("hot_key"), "left")
    here = marked.where(F.col("hot_key").isNotNull() | F.col(key).isNull()).drop("hot_key").join(F.broadcast(hot), on, "left")
    return here.unionByName(marked.where(F.col("hot_key").isNull() & F.col(key).isNotNull()).drop("hot_key").join(cold, on, "left"))


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores put in front until no column has it."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def string_array(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    """As one large_string array without nulls (null text counts as empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    return col.fill_null("").cast(pa.large_string())


def byte_view(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Value bytes of a large_string or large_binary array and its n+1 offsets, from 0."""
    _, off, val = arr.buffers()
    offsets = np.frombuffer(off, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(val, np.uint8)[offsets[0] : offsets[-1]] if val is not None and len(arr) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def spans(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def release() -> None:
    """Give memory that is free in this worker back to the system; idle workers live on beside others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over batches of at most ``BATCH_BYTES``; the task's memory is released at its end."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(conf.get(name).rstrip("bB")) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return df.mapInArrow(tidied, schema)


def map_texts(df: DataFrame, text: str, kernel: Callable[[pa.Array], list[pa.Array]], fields: str, keep: list[str]) -> DataFrame:
    """Append the columns that ``kernel`` computes from a chunk of texts to ``keep``.

    ``fields`` is their DDL; every name in it must differ from those of ``keep``.
    """
    spark = df.sparkSession
    inner = [f"c{i}" for i in range(len(keep))]
    src = df.select(*[df[k].alias(c) for k, c in zip(keep, inner)], df[text].alias("t"))
    schema = ", ".join([*(f"{c} {src.schema[c].dataType.simpleString()}" for c in inner), fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = string_array(b.column(len(inner)))
            for i, j in spans(byte_view(t)[1]):
                out = kernel(t.slice(i, j - i))
                cols = [b.column(k).slice(i, j - i) for k in range(len(inner))] + out
                yield pa.RecordBatch.from_arrays(cols, names=[*inner, *(f.split()[0] for f in fields.split(", "))])

    del spark
    out = map_arrow(src, run, schema)
    return out.select(*[out[c].alias(k) for k, c in zip(keep, inner)], *[f.split()[0] for f in fields.split(", ")])


# ---------------------------------------------------------------- hashing

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INV = _U(pow(int(_BASE), -1, 1 << 64))
_rng = np.random.default_rng(20240117)
#: A random 64-bit value for each byte.
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of them."""
    if len(_POW[0]) < n:
        size = max(n, 2 * len(_POW[0]))
        for k, b in ((0, _BASE), (1, _INV)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POW[k] = np.multiply.accumulate(p)
    return _POW[0][:n], _POW[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


#: Byte values of a second, independent hash.
_BYTE2 = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def prefix_hash(data: np.ndarray, second: bool = False) -> np.ndarray:
    """Polynomial prefix sums modulo 2**64; see ``range_hash``. ``second`` uses other byte values."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE2 if second else _BYTE)[data] * _powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of bytes [start, end): equal byte strings have equal hashes, wherever they stand."""
    return mix((prefix[end] - prefix[start]) * _powers(len(prefix))[1][start] + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the maximal runs of ``inside`` bytes; runs end with their document."""
    w = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    prev = np.zeros(len(data), bool)
    prev[1:] = w[:-1]
    start = np.flatnonzero(w & (~prev | edge[:-1]))
    nxt = np.zeros(len(data), bool)
    nxt[:-1] = w[1:]
    end = np.flatnonzero(w & (~nxt | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1
