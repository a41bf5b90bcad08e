"""The online queries over streams: the batch expressions of operators.online on readStream, and requests handled in
event-time order with state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import session
from ..operators import online

LATE = "1 hour"
#: The state store that timers and lists need.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: When a stream that has an end ends: later than any event.
END = "9999-01-01 00:00:00"


def raw(spark: SparkSession, folder: str, pattern: str = "events*.parquet", per_batch: int | None = None) -> DataFrame:
    """The event table as a stream of requests, as they come; `per_batch` files at a time, the oldest first."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(f"{folder}/events.parquet" if per_batch is None else folder).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if per_batch:
        stream = stream.option("maxFilesPerTrigger", per_batch)
    return online.from_events(stream.parquet(folder))


def ended(requests: DataFrame) -> DataFrame:
    """A stream that reads all its input in one batch, and an end of time after it: the watermark passes all events, so
    windows and sessions close and append mode gives everything. The row at the end itself is left out after the
    watermark by `until_end`."""
    spark = requests.sparkSession
    place = f"{session.shared_folder(spark)}/end-{uuid.uuid4().hex}"
    values = [(F.lit(END).cast("timestamp") if f.name == "ts" else F.lit(None).cast(f.dataType)).alias(f.name) for f in requests.schema.fields]
    spark.range(1).select(*values).write.parquet(place)
    return requests.unionByName(spark.readStream.schema(requests.schema).parquet(place))


def until_end(requests: DataFrame) -> DataFrame:
    return requests.where(F.col("ts") < F.lit(END).cast("timestamp"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The event table as a stream of requests that ends, each request once."""
    return until_end(ended(raw(spark, folder)).withWatermark("ts", LATE)).dropDuplicatesWithinWatermark(["request_id"])


def rates(requests: DataFrame) -> DataFrame:
    """Counters per task since the start, for update or complete mode."""
    return requests.groupBy("task").agg(*[f().alias(n) for n, f in online.RATES.items()])


def tumbling(requests: DataFrame, width: str = "1 day") -> DataFrame:
    """Requests and mean latency per task and window of event time. In append mode a window is given, and leaves the
    state, when the watermark passes its end."""
    w = requests.groupBy("task", F.window("ts", width).alias("w")).agg(F.count("*").alias("requests"), F.avg("latency_ms").alias("mean_ms"))
    return w.select("task", F.col("w.start").alias("start"), "requests", "mean_ms")


def budget(requests: DataFrame, per_minute: int, per_day: int) -> DataFrame:
    """Admissions by a budget for each user, its grants kept as state between batches, in order within each batch."""

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = online.Budget(per_minute, per_day, *(state.get if state.exists else ()))
        # a batch has to be sorted as a whole; what an account sends between two triggers
        rows = pd.concat(list(batches)).sort_values(["t", "request_id"])
        out = [held.ask(t) for t in rows["t"].tolist()]
        state.update((list(held.recent), held.day, held.used))
        yield rows.assign(decision=out)[["request_id", "user_id", "decision"]]

    narrow = requests.select("request_id", "user_id", F.col("ts").cast("double").alias("t"))
    return narrow.groupBy("user_id").applyInPandasWithState(
        run, "request_id long, user_id long, decision string", "recent array<double>, day double, used long", "append", "NoTimeout"
    )


class Desk(StatefulProcessor):
    """One user's requests in event-time order.

    A request waits until the watermark passes it, when a timer lets it and all earlier ones go in order of (time,
    request_id): so the outcome is that of the batch operators, however arrivals are shuffled within the watermark's delay.
    Each released request asks the user's budget unless it is local, and belongs to a session that ends when no other
    one follows within the gap; a timer closes it. Requests that the watermark has passed already come out as late.
    A repeated request is dropped while it waits, and late after that. State: what waits, the grants of a minute, and
    six numbers; it is cleared where nothing waits, no session is open and the day of the budget has lapsed.
    """

    OUT = "kind string, user_id long, request_id long, route string, decision string, served string, start double, end double, requests long"
    STATE = "t array<double>, request_id array<long>, route array<string>, recent array<double>, day double, used long, start double, last double, requests long"
    _NAMES = [c.split()[0] for c in OUT.split(", ")]

    def __init__(self, per_minute: int, per_day: int, gap: float) -> None:
        self.per_minute, self.per_day, self.gap = per_minute, per_day, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("desk", self.STATE)  # one value: each call reads it once and writes it once

    def _held(self) -> tuple[list[tuple], tuple]:
        """(what waits, the book: recent, day, used, start, last, requests)."""
        found = self.state.get()
        if found is None:
            return [], ([], None, 0, None, None, 0)
        t, request_id, route, *book = found
        return list(zip(t, request_id, route)), tuple(book)

    def _keep(self, waiting: list[tuple], book: tuple) -> None:
        t, request_id, route = (list(x) for x in zip(*waiting)) if waiting else ([], [], [])
        self.state.update((t, request_id, route, *book))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        held, book = self._held()
        known, fresh = {r[1] for r in held}, []
        for row in rows:
            t, request_id, route = row["t"], row["request_id"], row["route"]
            if t * 1000 <= mark:
                yield self._row(kind="late", user_id=key[0], request_id=request_id, route=route, start=t)
            elif request_id not in known:
                known.add(request_id)
                fresh.append((t, request_id, route))
        if fresh:
            self._keep(held + fresh, book)
            # one timer lets all go that wait by then
            self.handle.registerTimer(self._ms(min(r[0] for r in fresh)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        held, (recent, day, used, start, last, count) = self._held()
        held.sort()
        due = [r for r in held if self._ms(r[0]) <= mark]
        left = held[len(due) :]
        budget = online.Budget(self.per_minute, self.per_day, recent, day, used)
        out = []

        def close() -> None:
            out.append(self._row(kind="session", user_id=key[0], start=start, end=last + self.gap, requests=count))

        for t, request_id, route in due:
            if count and t - last >= self.gap:
                close()
                count = 0
            start, last, count = (start if count else t), t, count + 1
            decision = None if route == "local" else budget.ask(t)
            served = route if decision == "granted" else "local"
            out.append(self._row(kind="request", user_id=key[0], request_id=request_id, route=route, decision=decision, served=served, start=t))
        if count and self._ms(last + self.gap) <= mark and not (left and left[0][0] - last < self.gap):
            close()
            start, last, count = None, None, 0
        if left:
            self.handle.registerTimer(self._ms(left[0][0]))
        if count:
            self.handle.registerTimer(self._ms(last + self.gap))
        if count or left or (budget.day is not None and self._ms(budget.day + 86400) > mark):
            self._keep(left, (list(budget.recent), budget.day, budget.used, start, last, count))
            if not count and not left:
                self.handle.registerTimer(self._ms(budget.day + 86400))
        else:
            self.state.clear()
        yield from out

    @staticmethod
    def _ms(seconds: float) -> int:
        """The millisecond at or after a time."""
        return -int(-seconds * 1000 // 1)

    @classmethod
    def _row(cls, **values) -> Row:
        """A row of OUT; what isn't given is null."""
        return Row(**{n: values.get(n) for n in cls._NAMES})

    def close(self) -> None:
        pass


def desk(requests: DataFrame, per_minute: int, per_day: int, gap: float, late: str = LATE) -> DataFrame:
    """Requests of a stream, each once, in event-time order: rows of kind `request` (route, decision, served), `session`
    (start, end, requests) and `late` (start: its time), in append mode. Times are seconds. Rows without a time or a user
    are left out."""
    requests.sparkSession.conf.set(STORE, ROCKS)
    # one condition on the time, so that Spark keeps it behind the watermark
    timed = requests.withWatermark("ts", late).where(F.when(F.col("ts") < F.lit(END).cast("timestamp"), F.col("user_id")).isNotNull())
    # a plain number, so that Spark doesn't drop late rows before they are seen
    plain = timed.select("user_id", "request_id", "route", F.col("ts").cast("double").alias("t"))
    return plain.groupBy("user_id").transformWithState(Desk(per_minute, per_day, gap), Desk.OUT, "Append", "EventTime")


def stored(stream: DataFrame, name: str, place: str | None = None) -> DataFrame:
    """All rows that an appending stream has given once its input is read, from files in the folder that executors share.
    With the `place` of an earlier run it goes on from that one's checkpoint."""
    spark = stream.sparkSession
    place = place or f"{session.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.outputMode("append").format("parquet").option("path", f"{place}/rows")
        .option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")


def drained(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """What the stream has given once all its input is read, from an in-memory sink: for results of bounded size."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
