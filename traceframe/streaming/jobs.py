"""Structured Streaming jobs: live tallies, protected upserts, item life cycles and a create-only run log."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from traceframe.session import ensure_checkpoint_dir
from traceframe.sources.writers import exists, last_per_key, protected_replace, swap_in, upsert_table


def file_stream(spark: SparkSession, folder: str, name: str, schema: StructType, per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder that match `name`, as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(folder)


def work_folder(spark: SparkSession) -> str:
    """A fresh folder beside the shared checkpoints for one run's state and output."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], state: str) -> None:
    """Process everything that is there and stop."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which keyed processors need; the session is left as it was."""
    name, kind = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, kind)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


# ----------------------------------------------------------------- session tallies

TALLY_STATE = "seen BIGINT, correct BIGINT, best BIGINT, streak BIGINT, late BIGINT, last_at BIGINT, last_id BIGINT, waiting BINARY"
TALLY_DDL = "{key}, seen BIGINT, correct BIGINT, streak BIGINT, best_streak BIGINT, late BIGINT"
_EVENT = np.dtype([("at", "<i8"), ("id", "<i8"), ("ok", "?")])


def folded(tally: tuple[int, int, int, int], ok: np.ndarray) -> tuple[int, int, int, int]:
    """(seen, correct, best run, run at the end) after more answers in order."""
    seen, correct, best, streak = tally
    if not len(ok):
        return tally
    wrong = np.flatnonzero(~ok)
    ends = np.append(wrong, len(ok))
    runs = np.diff(np.concatenate([[-1], ends])) - 1
    runs[0] += streak
    return seen + len(ok), correct + int(ok.sum()), max(best, int(runs.max())), int(runs[-1])


class SessionTally(StatefulProcessor):
    """Counts and runs of one session: what is older than its newest event by more than `delay` is folded into four numbers, the rest waits in order.

    An event that was seen before is nothing new; one that comes after its place has been folded is counted as late.
    """

    def __init__(self, keys: Sequence[str], at: str, event: str, ok: str, delay: float) -> None:
        self.keys, self.columns, self.delay = list(keys), [at, event, ok], round(delay * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tally", TALLY_STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        old = self.state.get() if self.state.exists() else (0, 0, 0, 0, 0, None, None, b"")
        tally, late, last = tuple(old[:4]), old[4], (old[5], old[6])
        parts = [np.frombuffer(bytes(old[7]), dtype=_EVENT)]
        for pdf in rows:
            new = np.empty(len(pdf), dtype=_EVENT)
            for name, column in zip(_EVENT.names, self.columns):
                values = pdf[column]
                new[name] = values.astype("datetime64[us]").astype("int64") if name == "at" else values
            if last[0] is not None:
                gone = (new["at"] < last[0]) | ((new["at"] == last[0]) & (new["id"] <= last[1]))
                late += int(gone.sum())
                new = new[~gone]
            parts.append(new)
        waiting = np.unique(np.concatenate(parts))  # in order, repeats once
        waiting = waiting[np.append(True, waiting[["at", "id"]][1:] != waiting[["at", "id"]][:-1])] if len(waiting) else waiting
        settled = waiting["at"] < waiting["at"].max(initial=-(1 << 62)) - self.delay
        tally = folded(tally, waiting["ok"][settled])
        if settled.any():
            last = (int(waiting["at"][settled][-1]), int(waiting["id"][settled][-1]))
        now = folded(tally, waiting["ok"][~settled])
        self.state.update((*tally, late, *last, waiting[~settled].tobytes()))
        yield pd.DataFrame([[*key, now[0], now[1], now[3], now[2], late]], columns=[*self.keys, "seen", "correct", "streak", "best_streak", "late"])

    def close(self) -> None:
        pass


def stream_tallies(events: DataFrame, keys: Sequence[str], at: str, event: str, ok: str, delay: float, folder: str) -> DataFrame:
    """Live tallies per session: (keys, seen, correct, streak, best_streak, late), the newest of each.

    Answers count in the order of (`at`, `event`) whatever file brings them, as long as it comes within `delay` seconds of the
    newest event of the session; repeated events count once, later ones only in `late`. State is Spark's own and holds a few
    numbers and the events of the last `delay` for a session; a watermark would drop late events unnamed. A batch adds the
    rows of the sessions that it changed; nothing is written anew.
    """
    spark = events.sparkSession
    key = ", ".join(f"`{k}` {t}" for k, t in events.select(*keys).dtypes)
    by_session = events.select(*keys, at, event, ok).groupBy(*keys)
    live = by_session.transformWithStateInPandas(SessionTally(keys, at, event, ok, delay), TALLY_DDL.format(key=key), "Update", "None")

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/tally/batch={batch_id}")  # a repeated batch replaces its own rows

    with keyed_state(spark):
        query = live.writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", f"{folder}/state")
        query.trigger(availableNow=True).start().awaitTermination()
    if not exists(spark, f"{folder}/tally"):
        return spark.createDataFrame([], TALLY_DDL.format(key=key))
    rows = spark.read.schema(TALLY_DDL.format(key=key) + ", batch BIGINT").parquet(f"{folder}/tally")
    values = ["seen", "correct", "streak", "best_streak", "late"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(*keys, *[f"_v.{v}" for v in values])


def stream_confusions(events: DataFrame, ts: str, delay: str, keys: Sequence[str]) -> DataFrame:
    """Counts per key and hour as a plain windowed stream; late events beyond the watermark are left out."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, "1 hour"), *keys).agg(F.count(F.lit(1)).alias("n"))


# ----------------------------------------------------------------- protected upsert


def stream_upserts(batches: DataFrame, keys: Sequence[str], seq: str, partition: str, path: str, state: str) -> None:
    """Keyed upsert of a change stream; repeating a batch gives the same table."""
    run_available(batches, lambda b, _: upsert_table(b.sparkSession, path, b, keys, seq, partition), state)


def stream_protected(batches: DataFrame, owner: str, keys: Sequence[str], seq: str, path: str, state: str) -> None:
    """Protected upsert of a change stream: authored rows are never displaced by traced ones."""

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if exists(spark, path):
            stored = spark.read.parquet(path)
        else:
            stored = batch.drop(seq).limit(0)
        table, _ = protected_replace(stored, batch, owner, keys, seq, False)
        swap_in(table, path)

    run_available(batches, each, state)


# ------------------------------------------------------------------- life cycle

FIELDS = ["kind", "status", "understanding", "reproduced", "stage", "resolution"]
STATE_DDL = ", ".join(f"{f} STRING" for f in FIELDS)
LIFE_DDL = "item_id BIGINT, change_id BIGINT, problem STRING, status STRING"


def _blank(v: object) -> bool:
    return v is None or not str(v).strip()


def change_problem(stored: dict, change: dict) -> str | None:
    """The transition rule for one stored item and one change; the same names as the batch predicate."""
    sent = {k: v for k, v in change.items() if v is not None}
    target = sent.get("status")
    closing = target in ("done", "returned")
    if target != "ack" and not closing:
        return "protocol_without_transition" if sent.keys() & set(FIELDS[2:]) else None
    after = {**stored, **sent}
    if closing and _blank(stored.get("understanding")):
        return "not_understood"
    if target == "ack":
        return "ack_missing" if _blank(after.get("understanding")) or _blank(after.get("reproduced")) else None
    needed = ["resolution"] if stored.get("kind") == "note" else ["stage", "resolution"]
    return "close_missing" if any(_blank(after.get(f)) for f in needed) else None


class ItemLife(StatefulProcessor):
    """State of one work item; its changes apply in the order of `change_id`.

    With a delay, changes wait until the watermark has passed them, so those that come in the wrong order are put right. A change
    below one that was applied already is refused as `late_change`; the same change once more is refused too.
    """

    def __init__(self, waits: bool) -> None:
        self.waits = waits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", STATE_DDL + ", last_id BIGINT")
        self.waiting = handle.getListState("waiting", "change_id BIGINT, at BIGINT, " + STATE_DDL)

    def _applied(self, key: tuple, changes: list[tuple]) -> Iterator[pd.DataFrame]:
        stored = self.item.get() if self.item.exists() else None
        item = dict(zip(FIELDS, stored[:-1])) if stored else {"kind": "glyph", "status": "open"}
        last = stored[-1] if stored else None
        out = []
        for change_id, *sent in sorted(changes, key=lambda c: c[0]):
            change = dict(zip(FIELDS, sent))
            late = last is not None and change_id <= last
            problem = "late_change" if late else change_problem(item, change)
            if problem is None:
                item.update({k: v for k, v in change.items() if v is not None})
            last = last if late else change_id
            out.append((key[0], change_id, problem, item["status"]))
        if out:
            self.item.update((*[item.get(f) for f in FIELDS], last))
            yield pd.DataFrame(out, columns=["item_id", "change_id", "problem", "status"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))
        fields = pdf[FIELDS].astype(object).where(pdf[FIELDS].notna(), None)
        sent = list(fields.itertuples(index=False, name=None))
        if not self.waits:
            yield from self._applied(key, [(int(c), *s) for c, s in zip(pdf["change_id"], sent)])
            return
        at = pdf["at"].astype("datetime64[us]").astype("int64") // 1000
        self.waiting.appendList([(int(c), int(t), *s) for c, t, s in zip(pdf["change_id"], at, sent)])
        for t in sorted(set(at)):
            self.handle.registerTimer(int(max(t, timerValues.getCurrentWatermarkInMs())) + 1)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        waiting = [tuple(r) for r in self.waiting.get()]
        due = [r for r in waiting if r[1] < timerValues.getCurrentWatermarkInMs()]
        rest = [r for r in waiting if r[1] >= timerValues.getCurrentWatermarkInMs()]
        if due:
            self.waiting.put(rest) if rest else self.waiting.clear()
            yield from self._applied(key, [(r[0], *r[2:]) for r in due])

    def close(self) -> None:
        pass


def life_cycle(changes: DataFrame, delay: str | None = None) -> DataFrame:
    """Every change of a stream with its problem (null when accepted) and the item's status afterwards.
    changes(item_id, change_id, kind, status, understanding, reproduced, stage, resolution), and `at` where a `delay` is given.

    Without a delay changes apply as their batch comes, in the order of `change_id` inside it, and an earlier one that comes later
    is refused by name. With a delay they wait for the watermark; those still waiting come out when newer ones move it on.
    Start the query inside `keyed_state`.
    """
    stream = changes if delay is None else changes.withWatermark("at", delay)
    mode = "None" if delay is None else "EventTime"
    return stream.groupBy("item_id").transformWithStateInPandas(ItemLife(delay is not None), LIFE_DDL, "Append", mode)


def stream_to_folder(stream: DataFrame, path: str, state: str) -> DataFrame:
    """Append a stream to Parquet, everything that is there, and read it back."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", state)
    with keyed_state(stream.sparkSession):
        q.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


# --------------------------------------------------------------------- run log


def create_only(runs: DataFrame, ts: str, delay: str) -> DataFrame:
    """First entry per (stamp, label); repeats within the watermark are dropped."""
    return runs.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["stamp", "label"])


__all__ = [
    "change_problem", "create_only", "file_stream", "folded", "keyed_state", "last_per_key", "life_cycle",
    "run_available", "stream_confusions", "stream_protected", "stream_tallies", "stream_to_folder", "stream_upserts",
    "work_folder",
]
