"""Vote smoothing of scan streams: votes keyed by crop and label, unsure streaks, ask on ambiguity, announce on change.

`step` is what one row does to a session; `smooth_batch` runs it per session over a table, `smooth_stream` over a stream with keyed state: the last votes are
a list, the streak and the last announcement are values, and all of them expire `ttl_ms` after their last change. Both give the same rows while nothing expires.
A session's rows are taken in the order of seq, one session at a time (a session is a camera's sitting; its rows pass one task).

Streams need the RocksDB state store: spark.sql.streaming.stateStore.providerClass = ROCKSDB.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = "session long, seq long, state string, label string, votes int, mean double, announced boolean"
KEEP, NEED, FORGET = 5, 3, 3


def step(recent: list, streak: int, spoken: str | None, key: str, p: float, control: str, low: float, sure: float) -> tuple[list, int, str | None, tuple]:
    """The state after a row, and (state, label, votes, mean, announced). control: "reset" (another crop is chosen or trusted) forgets the votes and what was
    announced, "ambiguous" asks for the crop, forgets votes and streak and counts for no vote, anything else is a scan."""
    if control == "reset":
        return [], streak, None, ("reset", None, 0, None, False)
    if control == "ambiguous":
        return [], 0, "ask", ("ask", None, 0, None, spoken != "ask")
    recent = [*recent, (key, p)][-KEEP:]
    same = [q for name, q in recent if name == key]
    mean = sum(same) / len(same)
    if p < low:
        streak += 1
        return recent, streak, None if streak >= FORGET else spoken, ("unsure" if streak >= 2 else "watch", key, len(same), mean, False)
    if len(same) >= NEED and mean >= sure:
        return recent, 0, key, ("sure", key, len(same), mean, spoken != key)
    return recent, 0, spoken, ("watch", key, len(same), mean, False)


def _rows(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf.sort_values("seq")
    blank = lambda c: pdf[c].fillna("").tolist()
    keys = [f"{c}::{name}" for c, name in zip(blank("crop"), blank("label"), strict=True)]
    return list(zip(pdf["session"].tolist(), pdf["seq"].tolist(), keys, pdf["p"].astype(float).fillna(0.0).tolist(), blank("control"), strict=True))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in COLUMNS.split(", ")])


def smooth_batch(scans: DataFrame, low: float = 0.35, sure: float = 0.55) -> DataFrame:
    """scans: session, seq, crop, label, p, control. A null label or crop is empty, a null p is 0."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        recent, streak, spoken, out = [], 0, None, []
        for session, seq, key, p, control in _rows(pdf):
            recent, streak, spoken, found = step(recent, streak, spoken, key, p, control, low, sure)
            out.append((session, seq, *found))
        return _frame(out)

    return scans.groupBy("session").applyInPandas(run, COLUMNS)


class Smoother(StatefulProcessor):
    def __init__(self, low: float, sure: float, ttl_ms: int):
        self.low, self.sure, self.ttl = low, sure, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "key string, p double", self.ttl)
        self.streak = handle.getValueState("streak", "streak int", self.ttl)
        self.spoken = handle.getValueState("spoken", "spoken string", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        recent = [(r[0], r[1]) for r in self.recent.get()] if self.recent.exists() else []
        streak = self.streak.get()[0] if self.streak.exists() else 0
        spoken = self.spoken.get()[0] if self.spoken.exists() else None
        out = []
        for session, seq, vote, p, control in _rows(pd.concat(list(rows))):
            recent, streak, spoken, found = step(recent, streak, spoken, vote, p, control, self.low, self.sure)
            out.append((session, seq, *found))
        self.recent.put(recent) if recent else self.recent.clear()
        self.streak.update((streak,))
        self.spoken.update((spoken,)) if spoken is not None else self.spoken.clear()
        yield _frame(out)

    def close(self) -> None:
        pass


def smooth_stream(scans: DataFrame, low: float = 0.35, sure: float = 0.55, ttl_ms: int = 30 * 60 * 1000) -> DataFrame:
    """The same over a stream; a session that rests for ttl_ms starts anew."""
    return scans.groupBy("session").transformWithStateInPandas(statefulProcessor=Smoother(low, sure, ttl_ms), outputStructType=StructType.fromDDL(COLUMNS), outputMode="append", timeMode="ProcessingTime")


def deduplicated(sends: DataFrame, key: str = "client_id", time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """A send queue made idempotent: one row per key within the watermark."""
    return sends.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
