"""Keyed state: the smoother, the throttle and the queue against independent plain loops, batch against stream, expiry and timers."""

import collections
import random
import time

import pandas as pd
import pytest

from curata.streaming import pace, votes

SCANS = "session long, seq long, crop string, label string, p double, control string"


@pytest.fixture
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", votes.ROCKSDB)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def _plain(rows, low=0.35, sure=0.55):
    """The smoother written anew, as a screen would do it."""
    out, screens = [], {}
    for session, seq, crop, label, p, control in sorted(rows, key=lambda r: (r[0], r[1])):
        s = screens.setdefault(session, {"window": collections.deque(maxlen=5), "low": 0, "said": None})
        key, kind, n, mean, said = f"{crop}::{label}", "watch", 0, None, False
        if control == "reset":
            s["window"].clear()
            s["said"], key, kind = None, None, "reset"
        elif control == "ambiguous":
            s["window"].clear()
            said, s["said"], s["low"], key, kind = s["said"] != "ask", "ask", 0, None, "ask"
        else:
            s["window"].append((key, p))
            agreeing = [q for k, q in s["window"] if k == key]
            n, mean = len(agreeing), sum(agreeing) / len(agreeing)
            if p < low:
                s["low"] += 1
                kind = "unsure" if s["low"] > 1 else "watch"
                if s["low"] > 2:
                    s["said"] = None
            else:
                s["low"] = 0
                if n > 2 and mean >= sure:
                    kind, said = "sure", s["said"] != key
                    s["said"] = key
        out.append((session, seq, kind, key, n, mean, said))
    return out


def _scans():
    rng = random.Random(4)
    return [(s, i, rng.choice("ab"), rng.choice(["rust", "spot"]) if s % 3 else "rust", rng.choice([0.2, 0.3, 0.6, 0.9]), rng.choice(["", "", "", "", "", "", "reset", "ambiguous"])) for s in range(12) for i in range(40)]


def _run(stream, path, rows, pause=0.0, feed=None):
    """The rows that the stream gives until it has read as many new rows as `rows` says, run once after each feed on the same checkpoint. Streams with processing-time
    state run batches for ever, so they are stopped once the rows are in."""
    for k, n in enumerate(rows):
        if feed:
            feed(k)
        q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}-out").option("checkpointLocation", str(path)).trigger(processingTime="1 second").start()
        try:
            until = time.time() + 60
            while sum(p["numInputRows"] for p in q.recentProgress) < n:
                assert time.time() < until and q.exception() is None
                time.sleep(0.2)
            time.sleep(pause)
        finally:
            q.stop()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}-out").collect()


def test_smoother_batch_stream_and_plain_loop_agree(spark, tmp_path, rocksdb):
    rows = _scans()
    wanted = sorted(map(str, _plain(rows)))
    assert sorted(str(tuple(r)) for r in votes.smooth_batch(spark.createDataFrame(rows, SCANS)).collect()) == wanted
    feed = lambda k: spark.createDataFrame([r for r in rows if r[1] // 14 == k], SCANS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    feed(0)
    stream = votes.smooth_stream(spark.readStream.schema(SCANS).parquet(str(tmp_path / "in")))
    found = _run(stream, tmp_path / "c", [12 * 14, 12 * 14, 12 * 12], feed=lambda k: k and feed(k))
    assert sorted(str(tuple(r)) for r in found) == wanted
    odd = spark.createDataFrame([(1, 0, None, None, None, None)], SCANS)
    assert [tuple(r) for r in votes.smooth_batch(odd).collect()] == [(1, 0, "watch", "::", 1, 0.0, False)] and votes.smooth_batch(odd.limit(0)).count() == 0


def test_idle_sessions_are_forgotten(spark, tmp_path, rocksdb):
    rows = [(1, i, "a", "rust", 0.9, "") for i in range(4)]
    feed = lambda some: spark.createDataFrame(some, SCANS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    feed(rows[:2])
    for ttl, name in ((600_000, "kept"), (1, "expired")):
        stream = votes.smooth_stream(spark.readStream.schema(SCANS).parquet(str(tmp_path / "in")), ttl_ms=ttl)
        found = {r.seq: r.votes for r in _run(stream, tmp_path / name, [2, 2] if name == "kept" else [4], 0.2, feed=(lambda k: k and feed(rows[2:])) if name == "kept" else None)}
        if name == "kept":
            assert found == {0: 1, 1: 2, 2: 3, 3: 4}
    feed([(1, 9, "a", "rust", 0.9, "")])
    again = votes.smooth_stream(spark.readStream.schema(SCANS).parquet(str(tmp_path / "in")), ttl_ms=1)
    assert {r.seq: r.votes for r in _run(again, tmp_path / "expired", [1])}[9] == 1  # the same checkpoint, but its votes are gone


def test_throttle_against_a_plain_loop(spark):
    rng = random.Random(1)
    rows = [(k, rng.randrange(0, 400) * 100, 100 * k + i) for k in range(5) for i in range(90)] + [(9, 1_000_000, 999), (9, 1_000_299, 1000), (9, 1_000_301, 1001)]
    wanted, last = set(), {}
    for key, at, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if key not in last or at >= last[key] + 300:
            wanted.add((key, i))
            last[key] = at
    df = spark.createDataFrame([*rows, (None, 5, 5000), (3, None, 5001)], "user long, ms long, id long").selectExpr("user", "timestamp_millis(ms) AS ts", "id", "1 AS key", "2 AS at")
    assert {(r.user, r.id) for r in pace.throttled(df, "user", "ts", "id", 300_000).collect()} == wanted
    assert (9, 999) in wanted and (9, 1000) not in wanted and (9, 1001) in wanted  # across a border of fixed slots
    assert pace.throttled(df.limit(0), "user", "ts", "id", 300_000).count() == 0


def _queue(rows, base=30, most=5):
    out, held = set(), {}
    for client, at, i, ok in sorted(rows, key=lambda r: (r[1], r[2])):
        n, due, end = held.get(client, (0, 0, None))
        if end:
            out.add((client, i, n, end))
            continue
        if at < due:
            out.add((client, i, n, "WAITING"))
            continue
        n += 1
        state = "DONE" if ok else "FAILED" if n == most else "PENDING"
        held[client] = (n, at + base * 2 ** (n - 1), {"DONE": "REPEATED", "FAILED": "REFUSED"}.get(state))
        out.add((client, i, n, state))
    return out


SENDS = "client_id string, s long, id long, ok boolean"


def test_queue_batch_and_stream_against_a_plain_loop(spark, tmp_path, rocksdb):
    rng = random.Random(2)
    rows = [(f"c{k}", rng.randrange(0, 1500), 1000 * k + i, rng.random() < 0.12) for k in range(8) for i in range(40)]
    df = spark.createDataFrame(rows, SENDS).selectExpr("client_id", "timestamp_seconds(s) AS ts", "id", "ok")
    wanted = _queue(rows)
    assert {tuple(r) for r in pace.queue_states(df, "client_id", "ts", "id", "ok").collect()} == wanted
    assert {s for *_, s in wanted} == {"DONE", "PENDING", "FAILED", "WAITING", "REPEATED", "REFUSED"}
    assert pace.queue_states(df.limit(0), "client_id", "ts", "id", "ok").count() == 0
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    found = _run(pace.queue_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), tmp_path / "c", [320])
    assert {tuple(r) for r in found if r.state != "DUE"} == wanted


def test_queue_timer_tells_when_an_attempt_is_due(spark, tmp_path, rocksdb):
    one = lambda i, s: spark.createDataFrame([("c", s, i, False)], SENDS).selectExpr("client_id", "timestamp_seconds(s) AS ts", "id", "ok").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    one(1, 100)
    stream = pace.queue_stream(spark.readStream.schema("client_id string, ts timestamp, id long, ok boolean").parquet(str(tmp_path / "in")), base_s=1)
    found = _run(stream, tmp_path / "c", [1, 1], 3, feed=lambda k: k and one(2, 100))
    states = [(r.id if r.id is None or pd.notna(r.id) else None, r.state) for r in found]
    assert (1, "PENDING") in states and (2, "WAITING") in states and (None, "DUE") in states
