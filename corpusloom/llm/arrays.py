"""Arrays of fixed size that every task fills in part and that are merged in two steps."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

PARTIAL = "slice int, part int, data binary"


def merging_groups(df: DataFrame) -> int:
    """Groups of tasks whose arrays are merged first: as many as a group then has tasks, so that both steps stay small."""
    return max(1, math.isqrt(df.rdd.getNumPartitions()))


def partial_rows(array: np.ndarray, slices: int, groups: int) -> pd.DataFrame:
    """A task's array as rows of PARTIAL; slices that are all zero are left out."""
    from pyspark import TaskContext

    context = TaskContext.get()
    part = (context.partitionId() if context else 0) % groups
    pieces = [(i, p) for i, p in enumerate(np.array_split(array, slices)) if p.any()]
    return pd.DataFrame({"slice": [i for i, _ in pieces], "part": part, "data": [zlib.compress(p.tobytes(), 1) for _, p in pieces]})


def merged(parts: DataFrame, shape: tuple[int, ...], dtype: np.dtype, slices: int, combine: Callable = np.add) -> np.ndarray:
    """The whole array: parts combined by (slice, part), then by slice; the driver gets one array of `shape`."""

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        total = None
        for blob in group["data"]:
            array = np.frombuffer(zlib.decompress(blob), dtype)
            total = array.copy() if total is None else combine(total, array, out=total)
        return pd.DataFrame({"slice": group["slice"].iloc[:1], "part": np.zeros(1, np.int32), "data": [zlib.compress(total.tobytes(), 1)]})

    once = parts.groupBy("slice", "part").applyInPandas(merge, PARTIAL)
    out = np.zeros(shape, dtype)
    views = np.array_split(out, slices)
    for row in once.groupBy("slice").applyInPandas(merge, PARTIAL).collect():
        views[row["slice"]][...] = np.frombuffer(zlib.decompress(row["data"]), dtype).reshape(views[row["slice"]].shape)
    return out


def over_batches(df: DataFrame, column: str, add: Callable[[np.ndarray, pd.Series], None], shape: tuple[int, ...], dtype: np.dtype, slices: int) -> DataFrame:
    """Rows of PARTIAL from calling add(array, values) on every batch of a column."""
    groups = merging_groups(df)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        array = np.zeros(shape, dtype)
        seen = False
        for batch in batches:
            add(array, batch[column])
            seen = True
        if seen:
            yield partial_rows(array, slices, groups)

    return df.select(column).mapInPandas(run, PARTIAL)
