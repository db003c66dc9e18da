"""Cells: two bounded tiles of a group, compared in one place; shared by joins within groups of any size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutloom.llm.common import slices
from cutloom.llm.embdedup import forest

CELL = ["grp", "a", "b"]


def dealt(members: DataFrame) -> DataFrame:
    """Rows with grp, tiles and id, dealt to every cell of their tile and sorted within."""
    return (
        members.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .withColumns({"a": F.least("tile", "other"), "b": F.greatest("tile", "other")})
        .drop("other", "tiles")
        .repartition(*CELL)
        .sortWithinPartitions(*CELL, "tile", "id")
    )


def linked(ids: np.ndarray, weights: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple]:
    """(id, smallest id reached or None, weight linked, None) of a cell's links a-b, given as places; never the links."""
    if not a.size:
        return
    order = np.argsort(ids, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(order.size)
    low = order[forest(ids.size, place[a], place[b])][place]
    links = np.zeros(ids.size, "i8")
    np.add.at(links, a, weights[b])
    np.add.at(links, b, weights[a])
    for i in np.nonzero(links)[0].tolist():
        yield int(ids[i]), int(ids[low[i]]) if low[i] != i else None, int(links[i]), None


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of a batch; lists of numbers stay arrays."""
    columns = []
    for c in batch.columns:
        if pa.types.is_list(c.type) and pa.types.is_integer(c.type.value_type):
            ends = c.offsets.to_numpy()
            columns.append(np.split(c.values.to_numpy()[: ends[-1]], ends[1:-1]) if len(c) else [])
        else:
            columns.append(c.to_pylist())
    for row in zip(*columns, strict=True):
        yield dict(zip(batch.schema.names, row, strict=True))


def run_cells(batches: Iterator[pa.RecordBatch], compare: Callable[[list[dict], bool], Iterator[tuple]]) -> Iterator[pa.RecordBatch]:
    """Calls ``compare(rows, same_tile)`` for every cell; at most one cell is held."""
    at, rows = None, []

    def done() -> pa.RecordBatch:
        found = list(compare(rows, at[1] == at[2]))
        cols = list(zip(*found, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["id", "other", "links", "bin"])

    for batch in slices(batches):
        for row in _rows(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in batch.columns], names=batch.schema.names)):
            place = (row["grp"], row["a"], row["b"])
            if place != at:
                if len(rows) > 1:
                    yield done()
                at, rows = place, []
            rows.append(row)
    if len(rows) > 1:
        yield done()
