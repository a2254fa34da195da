"""Alignment of long sequences by tiles of the cost matrix.

Every cell depends on the ones above and to the left, so tiles with the same sum of numbers are independent: a round works on one
anti-diagonal of tiles, each in a task of its own, and passes on nothing but the last row and column of each tile. For those
border cells it also notes where the cheapest way to them enters the tile, so the way back hops from border to border and the
tiles that it crosses are filled in at the end, all at once. Memory of a task follows the tile, never the sequences.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceframe.functions.ordered import dense_position
from traceframe.session import checkpointed

TILE = 4096
#: A way that begins in the tile; other marks are 0 for the corner, k > 0 for column k - 1 above, -k for row k - 1 to the left.
BEGIN = 1 << 30


class Tile:
    """A block of the cost matrix over points `a` (rows) and `b` (columns), with the costs of the cells around it."""

    def __init__(self, a: np.ndarray, b: np.ndarray, top: np.ndarray | None, left: np.ndarray | None, corner: float) -> None:
        self.a, self.b, self.corner = a, b, corner
        self.begins = top is None and left is None
        self.top = np.full(len(b), np.inf) if top is None else top
        self.left = np.full(len(a), np.inf) if left is None else left

    def diagonals(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(sum of indices, first row, costs, moves, before and last entries): cells of one anti-diagonal after the other.

        Moves: 0 from (i-1, j-1), 1 from (i-1, j), 2 from (i, j-1); the first of equal ones counts. Costs are kept over rows
        with the cell above the tile in front; cells outside are put in where the diagonal touches the border.
        """
        n, m = len(self.a), len(self.b)
        before, last = np.full(n + 1, np.inf), np.full(n + 1, np.inf)
        entry_before, entry_last = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
        for s in range(n + m - 1):
            lo, hi = max(0, s - m + 1), min(s, n - 1)
            if lo == 0:
                before[0], entry_before[0] = (self.top[s - 1], s) if s else (self.corner, 0)
                last[0], entry_last[0] = (self.top[s], s + 1) if s < m else (np.inf, 0)
            if hi == s:
                if s:
                    before[s], entry_before[s] = self.left[s - 1], -s
                last[s + 1], entry_last[s + 1] = self.left[s], -(s + 1)
            i = np.arange(lo, hi + 1)
            gap = np.hypot(self.a[i, 0] - self.b[s - i, 0], self.a[i, 1] - self.b[s - i, 1])
            ways = np.stack([before[i], last[i], last[i + 1]])
            move = ways.argmin(axis=0).astype(np.int8)
            cost, entry = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
            if s == 0 and self.begins:
                cost[1], entry[1] = gap[0], BEGIN
            else:
                at = np.arange(len(i))
                cost[i + 1] = ways[move, at] + gap
                entry[i + 1] = np.stack([entry_before[i], entry_last[i], entry_last[i + 1]])[move, at]
            yield s, lo, cost, move, entry, i
            before, last = last, cost
            entry_before, entry_last = entry_last, entry

    def borders(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Costs of the last row and column, and where the ways to them enter the tile."""
        n, m = len(self.a), len(self.b)
        bottom, right = np.empty(m), np.empty(n)
        bottom_entry, right_entry = np.empty(m, dtype=np.int64), np.empty(n, dtype=np.int64)
        for s, _, cost, _, entry, i in self.diagonals():
            if i[-1] == n - 1:
                bottom[s - n + 1], bottom_entry[s - n + 1] = cost[n], entry[n]
            if s - i[0] == m - 1:
                right[i[0]], right_entry[i[0]] = cost[i[0] + 1], entry[i[0] + 1]
        return bottom, right, bottom_entry, right_entry

    def way(self) -> list[tuple[int, int]]:
        """Cells of the cheapest way to the last cell, from where it enters the tile."""
        moves = [(lo, move) for _, lo, _, move, _, _ in self.diagonals()]
        i, j = len(self.a) - 1, len(self.b) - 1
        out = []
        while i >= 0 and j >= 0:
            out.append((i, j))
            if self.begins and i == j == 0:
                break
            lo, move = moves[i + j]
            step = move[i - lo]
            i, j = i - (step != 2), j - (step != 1)
        return out[::-1]


def _blocks(points: DataFrame, keys: Sequence[str], tile: int, name: str) -> DataFrame:
    """(keys, name, points, n): `tile` consecutive points as bytes."""
    p = dense_position(points.select(*keys, "i", "x", "y"), keys, ["i"], F.floor(F.col("i") / (1 << 16)), "_at")
    ddl = ", ".join(f"`{k}` {t}" for k, t in p.select(*keys).dtypes)

    def packed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        xy = pdf.sort_values("_at")[["x", "y"]].to_numpy(dtype="<f8")
        return pd.DataFrame([[*key, xy.tobytes(), len(xy)]], columns=[*keys, name, name + "_pts", name + "_n"])

    grouped = p.groupBy(*keys, F.floor(F.col("_at") / tile).cast("int").alias(name))
    return checkpointed(grouped.applyInPandas(packed, f"{ddl}, {name} int, {name}_pts binary, {name}_n int"))


def _xy(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype="<f8").reshape(-1, 2)


def _tile(row: dict) -> Tile:
    border = lambda c: None if row[c] is None else np.frombuffer(row[c], dtype="<f8")
    return Tile(_xy(row["row_pts"]), _xy(row["col_pts"]), border("top"), border("left"), row["corner"])


def tiled_pairs(ref: DataFrame, cand: DataFrame, keys: Sequence[str], tile: int = TILE) -> DataFrame:
    """Matched pairs of the alignment of long sequences: (keys, i, j, dist), as `compare.alignment_pairs` gives them.

    Both sides hold keys, i (in order), x, y. Rounds: one for each anti-diagonal of tiles, there and back.
    """
    rows, cols = _blocks(ref, keys, tile, "row"), _blocks(cand, keys, tile, "col")
    spark = ref.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = list(keys)
    place = [*names, "row", "col"]
    ddl = ", ".join(f"`{k}` {t}" for k, t in rows.select(*names).dtypes)
    size = rows.groupBy(*names).agg(F.max("row").alias("last_row")).join(cols.groupBy(*names).agg(F.max("col").alias("last_col")), names)
    size = checkpointed(size)
    longest = size.agg(F.max(F.col("last_row") + F.col("last_col"))).first()[0]
    none = F.lit(None).cast("binary")

    def with_points(df: DataFrame) -> DataFrame:
        """Each tile a row with its points, dealt over all tasks."""
        return df.join(rows, [*names, "row"]).join(cols, [*names, "col"]).repartition(tasks, *place)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                bottom, right, bottom_entry, right_entry = _tile(row).borders()
                corner = np.inf if row["left"] is None else float(np.frombuffer(row["left"], dtype="<f8")[-1])
                arrays = [x.astype(t).tobytes() for x, t in ((bottom, "<f8"), (right, "<f8"), (bottom_entry, "<i4"), (right_entry, "<i4"))]
                out.append([*[row[k] for k in place], *arrays, corner])
            yield pd.DataFrame(out, columns=[*place, "bottom", "right", "bottom_entry", "right_entry", "below"])

    fields = f"{ddl}, row int, col int, bottom binary, right binary, bottom_entry binary, right_entry binary, below double"
    start = size.select(*names, F.lit(0).alias("row"), F.lit(0).alias("col"), none.alias("top"), none.alias("left"), F.lit(float("inf")).alias("corner"))
    asked, done = [], []
    frontier = checkpointed(start)
    for _ in range((-1 if longest is None else longest) + 1):
        asked.append(frontier)
        found = checkpointed(with_points(frontier).mapInPandas(work, fields))
        done.append(found)
        down = found.select(*names, (F.col("row") + 1).alias("row"), "col", F.col("bottom").alias("top"), none.alias("left"), F.col("below").alias("corner"))
        over = found.select(*names, "row", (F.col("col") + 1).alias("col"), none.alias("top"), F.col("right").alias("left"), F.lit(float("inf")).alias("corner"))
        both = down.unionByName(over).join(size, names).where((F.col("row") <= F.col("last_row")) & (F.col("col") <= F.col("last_col")))
        frontier = checkpointed(both.groupBy(*place).agg(F.max("top").alias("top"), F.max("left").alias("left"), F.min("corner").alias("corner")))

    # the way back: in which cell of which border it leaves each tile
    ends = size.join(rows.withColumnRenamed("row", "last_row"), [*names, "last_row"]).join(cols.withColumnRenamed("col", "last_col"), [*names, "last_col"])
    at = checkpointed(ends.select(*names, F.col("last_row").alias("row"), F.col("last_col").alias("col"), (F.col("row_n") - 1).alias("i"), (F.col("col_n") - 1).alias("j")))
    crossed = []
    hop = _hop(F.col("entry"), tile)
    for k in range(len(done) - 1, -1, -1):
        here = at.where(F.col("row") + F.col("col") == k)
        crossed.append(here)
        told = here.join(done[k], place).join(rows.select(*names, "row", "row_n"), [*names, "row"])
        told = told.withColumn("entry", _entry())
        at = checkpointed(at.where(F.col("row") + F.col("col") < k).unionByName(told.where(F.col("entry") != BEGIN).select(*names, *hop)))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                t = _tile(row)
                t.a, t.b = t.a[: row["i"] + 1], t.b[: row["j"] + 1]
                way = np.array(t.way())
                gap = np.hypot(*(t.a[way[:, 0]] - t.b[way[:, 1]]).T)
                out = pd.DataFrame({"i": way[:, 0] + row["row"] * tile, "j": way[:, 1] + row["col"] * tile, "dist": gap})
                for n in names:
                    out[n] = row[n]
                yield out

    if not crossed:
        return spark.createDataFrame([], f"{ddl}, i bigint, j bigint, dist double")
    ways = [with_points(c.join(a, place)) for c, a in zip(crossed[::-1], asked)]
    every = ways[0]
    for w in ways[1:]:
        every = every.unionByName(w)
    return every.mapInPandas(fill, f"{ddl}, i bigint, j bigint, dist double")


def _entry() -> Column:
    """Mark of the cell (i, j) of a border: 32-bit number i of the last column or j of the last row."""
    blob = F.when(F.col("i") == F.col("row_n") - 1, F.col("bottom_entry")).otherwise(F.col("right_entry"))
    at = F.when(F.col("i") == F.col("row_n") - 1, F.col("j")).otherwise(F.col("i"))
    one = lambda k: F.conv(F.hex(F.substring(blob, 4 * at + 1 + k, F.lit(1))), 16, 10).cast("bigint")
    raw = one(0) + one(1) * 256 + one(2) * 65536 + one(3) * 16777216
    return F.when(raw >= 1 << 31, raw - (1 << 32)).otherwise(raw).cast("int")


def _hop(entry: Column, tile: int) -> list[Column]:
    """Tile and cell from which a way enters, in full tiles."""
    edge = F.lit(tile - 1)
    return [
        F.when(entry >= 0, F.col("row") - 1).otherwise(F.col("row")).alias("row"),
        F.when(entry <= 0, F.col("col") - 1).otherwise(F.col("col")).alias("col"),
        F.when(entry >= 0, edge).otherwise(-entry - 1).alias("i"),
        F.when(entry <= 0, edge).otherwise(entry - 1).alias("j"),
    ]
