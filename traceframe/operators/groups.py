"""Many small groups in one go: a task reads whole groups in order and decides some ten thousand rows of them at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from traceframe.session import checkpointed

Part = tuple[np.ndarray, dict[str, pa.Array]]
#: Rows decided at once; a group is never cut, so a larger one stands alone.
ROWS_AT_ONCE = 1 << 16


def _whole(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the first row of each; `_k` numbers the rows of a group from 1."""
    held: list[pa.RecordBatch] = []
    size = cut = 0
    for batch in batches:
        for lo in range(0, batch.num_rows, at_once):
            piece = batch.slice(lo, at_once)
            first = np.flatnonzero(piece.column("_k").to_numpy() == 1)
            if len(first):
                cut = size + int(first[-1])
            held.append(piece)
            size += piece.num_rows
            if size >= at_once and cut:
                table = pa.Table.from_batches(held)
                yield _begun(table.slice(0, cut))
                held, size, cut = table.slice(cut).to_batches(), size - cut, 0
    if held:
        yield _begun(pa.Table.from_batches(held))


def _begun(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    return table, np.flatnonzero(table["_k"].to_numpy() == 1)


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Rows dealt by their keys, whole groups one after the other in a task, each in `order` with `_k` from 1."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def solved_groups(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    solve: Callable[[pa.Table, np.ndarray], Part | Iterator[Part]],
    extra: str,
    at_once: int = ROWS_AT_ONCE,
) -> DataFrame:
    """(keys, extra) of `solve`, which gets a table of whole groups, each in `order`, and the first row of each.

    It returns the columns of `extra` and, for each of their rows, any row of the group that it belongs to; or an iterator of such parts.
    """
    return solved_in_place(numbered(rows, keys, order), keys, solve, extra, at_once)


def solved_in_place(
    dealt: DataFrame, keys: Sequence[str], solve: Callable[[pa.Table, np.ndarray], Part | Iterator[Part]], extra: str, at_once: int = ROWS_AT_ONCE
) -> DataFrame:
    """The same for rows that are `numbered` already."""
    names = list(keys)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.select(*names).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in _whole(batches, at_once):
            found = solve(table, first)
            for at, columns in [found] if isinstance(found, tuple) else found:
                out = table.select(names).take(pa.array(at, pa.int64()))
                for name, column in columns.items():
                    out = out.append_column(name, column)
                yield from out.combine_chunks().to_batches()

    return dealt.mapInArrow(run, f"{ddl}, {extra}")


def by_rows(sides: Sequence[DataFrame], keys: Sequence[str], in_task: int) -> tuple[list[DataFrame], list[DataFrame] | None]:
    """The sides' rows of keys with at most `in_task` rows, and those of the larger keys, if any."""
    size = sides[0].select(*keys)
    for df in sides[1:]:
        size = size.unionByName(df.select(*keys))
    large = checkpointed(size.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > in_task).select(*keys))
    if large.isEmpty():
        return list(sides), None
    return [df.join(large, list(keys), "left_anti") for df in sides], [df.join(large, list(keys), "left_semi") for df in sides]
