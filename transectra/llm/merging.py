"""Fixed-size tables of numbers that every task adds to."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Numbers of a table that travel as one row.
PIECE = 1 << 16


def pieces_of(table: np.ndarray) -> pa.RecordBatch:
    """A task's table as rows (block, data); blocks without any value are left out."""
    cut = table.reshape(-1, min(len(table), PIECE))
    used = [i for i in range(len(cut)) if cut[i].any()]
    return pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int32()), pa.array([cut[i].tobytes() for i in used], pa.binary())], names=["block", "data"])


def merge(parts: DataFrame, size: int, dtype: str, add, unpack=None, finish=None, finished: str | None = None) -> np.ndarray:
    """The tables of all tasks (block, data) combined by ``add``, block by block and streaming.

    ``unpack`` undoes a compression of the data; ``finish`` makes the combined blocks into what is
    wanted of them (of type ``finished``, zero for zero) before they travel. Only the combined table, ``size`` numbers whatever the input, reaches the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch["block"].to_pylist(), batch["data"]):
                x = np.frombuffer(unpack(data.as_py()) if unpack else data.as_buffer(), dtype)
                if block in total:
                    add(total[block], x, out=total[block])
                else:
                    total[block] = x.copy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(total.keys(), pa.int32()), pa.array([(finish(x) if finish else x).tobytes() for x in total.values()], pa.binary())], names=["block", "data"])

    finished = finished or dtype
    out = np.zeros(size, finished).reshape(-1, min(size, PIECE))
    for r in parts.repartition("block").mapInArrow(run, "block int, data binary").collect():
        out[r["block"]] = np.frombuffer(r["data"], finished)
    return out.reshape(-1)
