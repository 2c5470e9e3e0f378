"""Arrays packed into binary cells, and cells gathered by part in the reducing tasks.

Millions of fixed-width records cross a shuffle as few rows: one for each chunk
of input and part. Bytes are laid out plane by plane, so that the high bytes of
small numbers compress to nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow

#: Parts for each shuffle partition at least: a part is what one reducing step holds in memory.
PARTS_PER_PARTITION = 6
#: Bytes of text for each part at most, so that a part does not grow with the data.
PART_BYTES = 32 << 20


def parts_of(df: DataFrame, text_bytes: int) -> int:
    """Number of parts that records of so many bytes of text are dealt to."""
    return max(PARTS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), text_bytes // PART_BYTES)


def pack(*columns: np.ndarray) -> bytes:
    n = len(columns[0])
    return n.to_bytes(8, "little") + b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(n, c.dtype.itemsize).T).tobytes() for c in columns if n)


def unpack(cell: bytes, dtypes: list[np.dtype]) -> list[np.ndarray]:
    n, at, out = int.from_bytes(cell[:8], "little"), 8, []
    for d in map(np.dtype, dtypes):
        size = n * d.itemsize
        out.append(np.ascontiguousarray(np.frombuffer(cell, np.uint8, size, at).reshape(d.itemsize, n).T).view(d).ravel())
        at += size
    return out


def deal(part: np.ndarray, parts: int, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Packed cells of the records of each part."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    part = part[order]
    columns = tuple(c[order] for c in columns)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(part[a]), pack(*[c[a:b] for c in columns])


def part_of(digit: np.ndarray, parts: int) -> np.ndarray:
    return ((digit >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


CELL_SCHEMA = "part int, kind int, cell binary"


def cells(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, kind, cell = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(cell, pa.binary())], names=["part", "kind", "cell"])


def by_part(df: DataFrame, parts: int, reduce: Callable[[dict[int, list[bytes]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Bring each part's cells together and reduce them: cells by kind go in, batches come out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for b in batches:
            for part, kind, cell in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if part != now:
                    if held:
                        yield from reduce(held)
                    now, held = part, {}
                held.setdefault(kind, []).append(cell.as_py())
        if held:
            yield from reduce(held)

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(df.repartition(n, "part").sortWithinPartitions("part"), run, schema)


def gather(held: list[bytes], dtypes: list) -> list[np.ndarray]:
    got = [unpack(c, dtypes) for c in held]
    return [np.concatenate(x) for x in zip(*got)] if got else [np.zeros(0, d) for d in dtypes]
