"""Requests over streams with state: shuffled and late arrival, restart, and equality with the batch operators."""

from __future__ import annotations

import json
import random
import uuid

from pyspark.sql import functions as F

from quartzgate import session
from quartzgate.operators import online
from quartzgate.streaming import live

EVENTS = "event_id long, user_id long, ts timestamp, event_type string, value double, props string"
GAP = 600.0


def arrivals(spark, batches):
    """A folder with one file for each batch of events (id, user, second), the first the oldest."""
    place = f"{session.shared_folder(spark)}/arrivals-{uuid.uuid4().hex}".removeprefix("file://")
    return place, [add(spark, place, i, rows) for i, rows in enumerate(batches)]


def add(spark, place, number, rows):
    import os
    import shutil

    kinds = ["click", "purchase", "error", "signup"]
    df = spark.createDataFrame([(i, u, None, kinds[i % 4], 1.0, json.dumps({"k": 1}), float(t)) for i, u, t in rows], EVENTS + ", t double")
    df = df.withColumn("ts", F.timestamp_seconds("t")).drop("t").coalesce(1)
    df.write.parquet(f"file://{place}-{number}")
    os.makedirs(place, exist_ok=True)
    part = next(n for n in os.listdir(f"{place}-{number}") if n.endswith(".parquet"))
    shutil.move(f"{place}-{number}/{part}", f"{place}/events-{number:04d}.parquet")
    os.utime(f"{place}/events-{number:04d}.parquet", (1_000_000 + number, 1_000_000 + number))


def made(rnd, n, users=5):
    t, out = 1_700_000_000.0, []
    for i in range(n):
        t += rnd.choice([0, 1, 5, 30, 200, 700])
        out.append((i, rnd.randrange(users), t))
    return out


def plain(rows):
    """(decisions, sessions) by a loop over each user's requests in order."""
    decisions, sessions = {}, []
    for user in {r[1] for r in rows}:
        mine = sorted((t, i) for i, u, t in rows if u == user)
        asked = [(t, i) for t, i in mine if i % 4]
        answers = dict(zip([i for _, i in asked], online.admissions([t for t, _ in asked], 2, 30)))
        decisions.update({i: answers.get(i) for _, i in mine})
        start, last, n = None, None, 0
        for t, _ in mine:
            if n and t - last >= GAP:
                sessions.append((user, start, last + GAP, n))
                n = 0
            start, last, n = (start if n else t), t, n + 1
        sessions.append((user, start, last + GAP, n))
    return decisions, sorted(sessions)


def run(spark, place, out=None, per_batch=1):
    return live.stored(live.desk(live.raw(spark, place, per_batch=per_batch), 2, 30, GAP, "1 hour"), "desk", out)


END = (10**9, 99, 1_900_000_000.0)  # lets all others go


def results(rows):
    rows = [r for r in rows.collect() if r["user_id"] != 99]
    decisions = {r["request_id"]: r["decision"] for r in rows if r["kind"] == "request"}
    sessions = sorted((r["user_id"], r["start"], r["end"], r["requests"]) for r in rows if r["kind"] == "session")
    return decisions, sessions, sorted(r["request_id"] for r in rows if r["kind"] == "late")


def test_shuffled_arrival_equals_batch_and_restarts(spark):
    rnd = random.Random(4)
    rows = made(rnd, 120)
    shuffled = sorted(rows, key=lambda r: r[2] + rnd.random() * 3000)  # within the hour that the watermark waits
    batches = [shuffled[i : i + 30] for i in range(0, 120, 30)]
    batches[2] = batches[2] + batches[1][-2:]  # repeated requests
    place, _ = arrivals(spark, batches[:2])
    out = f"{session.shared_folder(spark)}/desk-{uuid.uuid4().hex}"
    first = results(run(spark, place, out))
    assert 0 < len(first[0]) < 60 and not first[2]  # some wait for the watermark
    for i, b in enumerate(batches[2:], 2):  # a new query goes on from the checkpoint
        add(spark, place, i, b)
    add(spark, place, 9, [END])
    decisions, sessions, late = results(run(spark, place, out))
    assert (decisions, sessions) == plain(rows) and set(late) <= {r[0] for r in batches[1][-2:]}


def test_late_requests_come_out_aside(spark):
    rows = made(random.Random(5), 40, users=2)
    behind = [(500 + i, u, t - 50_000) for i, u, t in rows[:5]]
    place, _ = arrivals(spark, [rows, [(1000, 0, rows[-1][2] + 10_000)], behind, [END]])
    decisions, sessions, late = results(run(spark, place))
    assert late == [500, 501, 502, 503, 504]
    assert (decisions, sessions) == plain(rows + [(1000, 0, rows[-1][2] + 10_000)])


def test_stream_queries_equal_batch(spark):
    from quartzgate.plans import registry

    small = "/root/testdata/sf0.001"
    got, want = (registry.QUERIES[n](spark, small).collect() for n in ("stream_desk", "desk_decisions"))
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr) and len(want) > 100
    rows = online.from_events(spark.read.parquet(f"{small}/events.parquet")).selectExpr("user_id", "request_id", "route", "cast(ts as double) t").collect()
    for user in {r["user_id"] for r in rows}:
        asked = sorted((r["t"], r["request_id"]) for r in rows if r["user_id"] == user and r["route"] != "local")
        answers = dict(zip([i for _, i in asked], online.admissions([t for t, _ in asked], 2, 3)))
        assert {r["request_id"]: r["decision"] for r in want if r["user_id"] == user and r["route"] != "local"} == answers


def test_desk_reads_and_writes_its_state_once_a_call():
    class Handle:
        calls, value = [], None

        def getValueState(self, name, schema):
            return self

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

        def clear(self):
            self.calls.append("clear")
            self.value = None

        def registerTimer(self, ms):
            pass

    class Mark:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    handle, desk = Handle(), live.Desk(2, 3, 100.0)
    desk.init(handle)
    rows = [{"t": float(i * 10), "request_id": i, "route": "escalated"} for i in range(1, 8)]
    assert list(desk.handleInputRows((1,), iter(rows), Mark(0))) == [] and handle.calls == ["get", "update"]
    out = list(desk.handleExpiredTimer((1,), Mark(10**9), None))
    assert handle.calls == ["get", "update", "get", "clear"] and handle.value is None
    assert [r["kind"] for r in out] == ["request"] * 7 + ["session"] and out[-1]["requests"] == 7 and out[-1]["end"] == 170.0
