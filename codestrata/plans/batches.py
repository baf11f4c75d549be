"""Many small groups in one Arrow table.

A group for each call costs a call for each group, which is dear where groups have a handful of rows. Here
rows are sorted by key, and what works on them gets tables of some thousand rows, each with all rows of its keys.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize


def parted(rows: DataFrame, key: str, size: Column, most: int) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` of keys whose sizes add up to at most ``most``, and those of the other keys, None without any."""
    large = materialize(rows.groupBy(key).agg(F.sum(size).alias("_n")).filter(F.col("_n") > most).select(key), "large-keys")
    if large.isEmpty():
        return rows, None
    return rows.join(large, key, "left_anti"), rows.join(large, key, "left_semi")


def by_key(rows: DataFrame, key: str, run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run`` over tables that hold all rows of each of their keys; these are not null and have few rows each."""
    def whole(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = pc.index(batch[key], batch[key][-1]).as_py()        # where the last key of the batch begins
            if held and (last or held[0][key][0] != batch[key][0]):
                yield from run(pa.Table.from_batches([*held, batch.slice(0, last)])).to_batches()
                held = []
            elif last:
                yield from run(pa.Table.from_batches([batch.slice(0, last)])).to_batches()
            held.append(batch.slice(last))
        if held:
            yield from run(pa.Table.from_batches(held)).to_batches()

    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(whole, schema)


def codes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number of each value, -1 for null, and the values by number."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    encoded = column.dictionary_encode()
    return encoded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary
