"""Pacing of requests: the greedy gap throttle, and a send queue whose backoff is obeyed.

Both decide on a row by rows that were let through before it. `throttled` follows pointers to the next row that may pass, doubled in each round, so a key with n passing
rows takes about log2(n) rounds of joins. `queue_states` takes one round per attempt, of which there are at most `most`. `queue_stream` keeps the same queue as keyed state.

Defined results: rows with a null key or time pass nothing and are left out; rows of equal time are taken in the order of id, which must be unique; repeated sends of a client
that is done are told so and not sent; empty tables give empty results. A key's rows are sorted in one task (Spark spills the sort to disk).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from curata.operators.scratch import stored


def throttled(rows: DataFrame, key: str, time: str, id_: str, gap_us: int) -> DataFrame:
    """The rows (key, id) that pass: the first of a key, then always the next one at least gap_us microseconds after the one before."""
    at = rows.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("key"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"), F.col(id_).alias("id"))
    # each row once as itself and once as a probe `gap` later; going back in time, the last row seen before a probe is the next that may pass
    probes = at.select("key", (F.col("at") + gap_us).alias("at"), F.col("id").alias("probe"), F.lit(None).cast(at.schema["id"].dataType).alias("id"))
    line = at.select("key", "at", F.lit(None).cast(at.schema["id"].dataType).alias("probe"), "id").unionByName(probes)
    back = Window.partitionBy("key").orderBy(F.col("at").desc(), F.col("probe").asc_nulls_first(), F.col("id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    jumps = stored(line.withColumn("next", F.last("id", ignorenulls=True).over(back)).where("probe is not null and next is not null").select(F.col("probe").alias("id"), "next"))
    passed = stored(at.groupBy("key").agg(F.min(F.struct("at", "id")).alias("x")).select("key", "x.id"))
    before, n = -1, passed.count()
    while n > before:
        passed = stored(passed.union(passed.join(jumps, "id").select("key", F.col("next").alias("id"))).distinct())
        before, n = n, passed.count()
        far = jumps.select(F.col("id").alias("next"), F.col("next").alias("then"))
        jumps = stored(jumps.join(far, "next").select("id", F.col("then").alias("next")))
    return passed.select(F.col("key").alias(key), F.col("id").alias(id_))


def queue_states(sends: DataFrame, client: str, time: str, id_: str, ok: str, base_s: int = 30, most: int = 5) -> DataFrame:
    """What becomes of each row that asks to send: DONE, PENDING (an attempt that failed), FAILED (the last one), WAITING (before the attempt is due again),
    REPEATED (the client is done), REFUSED (it has failed): client, id, attempt (the last one made by then), state. After attempt k the next is due in base_s * 2^(k-1) seconds."""
    rows = sends.where(F.col(client).isNotNull() & F.col(time).isNotNull()).select(F.col(client).alias("client"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"), F.col(id_).alias("id"), F.coalesce(F.col(ok), F.lit(False)).alias("ok"))
    rows = stored(rows)
    first_of = lambda some: some.groupBy("client").agg(F.min(F.struct("at", "id", "ok")).alias("x")).select("client", "x.*")
    attempt = stored(first_of(rows).withColumn("attempt", F.lit(1)))
    made = attempt
    for k in range(1, most):
        due = attempt.where("not ok").select("client", (F.col("at") + base_s * 2 ** (k - 1) * 1_000_000).alias("due"))
        attempt = stored(first_of(rows.join(due, "client").where("at >= due").select("client", "at", "id", "ok")).withColumn("attempt", F.lit(k + 1)))
        made = made.unionByName(attempt)
    state = F.when(F.col("ok"), "DONE").when(F.col("attempt") == most, "FAILED").otherwise("PENDING")
    history = made.withColumn("state", state).groupBy("client").agg(F.sort_array(F.collect_list(F.struct("at", "id", "attempt", "state"))).alias("made"))  # at most `most` a client
    upto = F.filter("made", lambda x: (x["at"] < F.col("at")) | ((x["at"] == F.col("at")) & (x["id"] <= F.col("id"))))
    last = rows.join(history, "client").select("client", "id", F.element_at(upto, -1).alias("x"))
    now = F.when(F.col("x.id") == F.col("id"), F.col("x.state")).otherwise(F.element_at(F.create_map(F.lit("DONE"), F.lit("REPEATED"), F.lit("FAILED"), F.lit("REFUSED"), F.lit("PENDING"), F.lit("WAITING")), F.col("x.state")))
    return last.select(F.col("client").alias(client), F.col("id").alias(id_), F.col("x.attempt").alias("attempt"), now.alias("state"))


QUEUE = "client_id string, id long, attempt int, state string"


class Queue(StatefulProcessor):
    """One client's queue: attempts made, when the next is due, and how it ended. A timer tells when a failed attempt may be made again."""

    def __init__(self, base_s: int, most: int):
        self.base_s, self.most = base_s, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("queue", "attempt int, due_us long, state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        attempt, due, state = self.held.get() if self.held.exists() else (0, 0, "NEW")
        out, failed = [], False
        for at, i, ok in sorted((t.value // 1000, i, bool(ok)) for pdf in rows for t, i, ok in zip(pdf["ts"].astype("datetime64[ns]"), pdf["id"], pdf["ok"], strict=True)):
            if state in ("DONE", "FAILED"):
                out.append((key[0], i, attempt, {"DONE": "REPEATED", "FAILED": "REFUSED"}[state]))
            elif at < due:
                out.append((key[0], i, attempt, "WAITING"))
            else:
                attempt += 1
                state = "DONE" if ok else "FAILED" if attempt == self.most else "PENDING"
                due, failed = at + self.base_s * 2 ** (attempt - 1) * 1_000_000, state == "PENDING"
                out.append((key[0], i, attempt, state))
        self.held.update((attempt, due, state))
        if failed:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.base_s * 2 ** (attempt - 1) * 1000)
        yield pd.DataFrame(out, columns=["client_id", "id", "attempt", "state"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        attempt, _, state = self.held.get() if self.held.exists() else (0, 0, "NEW")
        rows = [(key[0], None, attempt, "DUE")] if state == "PENDING" else []
        yield pd.DataFrame(rows, columns=["client_id", "id", "attempt", "state"]).astype({"id": "Int64"})

    def close(self) -> None:
        pass


def queue_stream(sends: DataFrame, base_s: int = 30, most: int = 5) -> DataFrame:
    """sends: client_id, ts, id, ok, as a stream. The states of queue_states as they come, and a row DUE when a client's next attempt may be made."""
    return sends.groupBy("client_id").transformWithStateInPandas(statefulProcessor=Queue(base_s, most), outputStructType=StructType.fromDDL(QUEUE), outputMode="append", timeMode="ProcessingTime")
