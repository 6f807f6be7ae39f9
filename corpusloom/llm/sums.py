"""Sums of large arrays over all tasks, in a tree of tasks."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slices that an array travels in, and how many of them a task of the tree adds.
SLICES, FAN_IN = 64, 32
SLICED = "task int, slice int, cells binary"


def packed(cells: np.ndarray) -> bytes:
    """Mostly small numbers: which are not 0, which of these are not 1, and those; each compressed by itself."""
    some = cells != 0
    values = cells[some]
    more = values != 1
    parts = [zlib.compress(x.tobytes(), 1) for x in (np.packbits(some), np.packbits(more), values[more])]
    return np.array([len(x) for x in parts[:2]], np.int32).tobytes() + b"".join(parts)


def unpacked(data: bytes, size: int, kind: type) -> np.ndarray:
    one, two = np.frombuffer(data[:8], np.int32).tolist()
    bits = lambda x, n: np.unpackbits(np.frombuffer(zlib.decompress(x), np.uint8), count=n).astype(bool)
    some = bits(data[8 : 8 + one], size)
    values = np.ones(int(some.sum()), kind)
    values[bits(data[8 + one : 8 + one + two], len(values))] = np.frombuffer(zlib.decompress(data[8 + one + two :]), kind)
    out = np.zeros(size, kind)
    out[some] = values
    return out


def tree_sum(parts: DataFrame, tasks: int, size: int, kind: type, add: Callable) -> np.ndarray:
    """SIZE numbers from slices (task, slice, cells) that TASKS tasks sent: no task adds more than FAN_IN of them at a level."""
    width = size // SLICES

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for t, i, blob in zip(*(c.to_pylist() for c in batch.columns)):
                part = unpacked(blob, width, kind)
                sums[t, i] = add(sums[t, i], part) if (t, i) in sums else part
        yield sliced(sums)

    while True:
        tasks = max(1, -(-tasks // FAN_IN))
        parts = parts.withColumn("task", (F.col("task") / FAN_IN).cast("int")).repartition(min(SLICES * tasks, 20_000), "task", "slice").mapInArrow(level, SLICED)
        if tasks == 1:
            break
    out = np.zeros(size, kind)
    for r in parts.collect():  # SLICES rows
        out[r["slice"] * width : (r["slice"] + 1) * width] = unpacked(r["cells"], width, kind)
    return out


def sliced(sums: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([t for t, _ in sums], pa.int32()), pa.array([i for _, i in sums], pa.int32()), pa.array([packed(v) for v in sums.values()], pa.binary())], names=["task", "slice", "cells"])


def by_slice(cells: np.ndarray) -> pa.RecordBatch:
    from pyspark import TaskContext

    task, width = TaskContext.get().partitionId(), len(cells) // SLICES
    return sliced({(task, i): cells[i * width : (i + 1) * width] for i in range(SLICES)})
