"""Arrays of a fixed number of small cells that every task fills for itself and Spark adds up block by block.

What leaves a task is at most the array; what reaches the driver is one array, whatever the size of the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a block.
BLOCK = 1 << 15
SCHEMA = "block int, cells binary"


def blocks_of(cells: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's bytes as rows of ``SCHEMA``, empty blocks left out."""
    for i in range(0, len(cells), BLOCK):
        part = cells[i : i + BLOCK]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([i // BLOCK], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["block", "cells"])


def merged(blocks: DataFrame, fold: Callable[[np.ndarray | None, np.ndarray], np.ndarray], finish: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The blocks of all tasks folded one after the other (``fold`` gets None first and must not depend on their order), then ``finish``ed; ``size`` bytes in all, whole blocks or less than one.

    ``finish`` turns a block into bytes of a fixed share of its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, None
        for batch in batches:
            for b, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
                if b != block and held is not None:
                    yield out(block, held)
                    held = None
                block, held = b, fold(held, np.frombuffer(cells.as_buffer(), np.uint8))
        if held is not None:
            yield out(block, held)

    def out(block: int, held: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([finish(held).tobytes()], pa.binary())], names=["block", "cells"])

    rows = blocks.repartition("block").sortWithinPartitions("block").mapInArrow(run, SCHEMA).toArrow()
    n_blocks = -(-size // BLOCK)
    whole = finish(np.zeros(min(size, n_blocks * BLOCK), np.uint8))
    each = len(whole) // n_blocks
    for block, cells in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
        whole[block * each : (block + 1) * each] = np.frombuffer(cells, whole.dtype)
    return whole


def bits_for(items: float, least: int, most: int) -> int:
    """The power of two that holds ``items``, between ``least`` and ``most`` bits of number."""
    return int(min(most, max(least, np.ceil(np.log2(max(1.0, items))))))


def total(df: DataFrame, number) -> int:
    """The sum of a column over all rows, 0 without any."""
    return int(df.agg(F.coalesce(F.sum(number), F.lit(0))).first()[0])
