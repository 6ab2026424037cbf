"""The round log as keyed state: what the batch operators loop_guard(), failure_streak() and ewma() say of a topic, kept up to date by a stream.

Rounds are numbered, so the log's order needn't be the order of arrival: a round that comes early waits in the topic's state
until those before it are there, and one that comes again is dropped. Each round is folded once, in order.

Each look at the state is a call to the JVM, so a topic's state is one value, and the rounds that wait are kept in blocks: a batch
makes a few calls for a topic and for each block that it changes, not for each round.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

OUT = "topic string, round long, is_stuck boolean, last_progress long, streak long, ewma double"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a topic that are held at a time; more are folded, or put into the state, in parts.
HELD = 10_000
#: Numbers of a block of rounds that wait.
BLOCK = 128
FIELDS = "gap array<double>, coverage array<double>, failed array<boolean>"
STATE = Row("topic", "round", "is_stuck", "last_progress", "streak", "ewma")


class Rounds(StatefulProcessor):
    """State of a topic: where the fold has come to, with its last rounds (a value), rounds that wait (a map of blocks), and a timer while any do."""

    def __init__(self, first: int, last: int, alpha: float, patience_ms: int | None):
        self.first, self.last, self.alpha, self.patience_ms = first, last, alpha, patience_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", f"next long, done long, last_progress long, ewma double, broken boolean, waiting long, timer long, {FIELDS}")
        self.waiting = handle.getMapState("waiting", "block long", f"round array<long>, {FIELDS}, value array<double>")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self.open()
        held: dict[int, tuple] = {}
        latest = None
        for _, number, gap, coverage, failed, value, at in rows:
            if number is not None and number >= self.next and number not in held:
                held[number] = gap, coverage, failed, value
                latest = max(latest or at, at) if at is not None else latest
            if len(held) >= HELD:
                yield from self.fold(key, held)
                held = {}
        yield from self.fold(key, held)
        if self.patience_ms is not None and self.left and self.timer is None and latest is not None:
            self.timer = int(latest.timestamp() * 1000) + self.patience_ms
            self.handle.registerTimer(self.timer)
        self.save()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """The rounds that are missing are given up: the fold goes on with the first one that waits."""
        self.open()
        self.timer = None
        if self.left:
            self.next = min(self.block(min(k[0] for k in self.waiting.keys())))
            yield from self.fold(key, {})
            if self.left:
                self.timer = timerValues.getCurrentWatermarkInMs() + self.patience_ms
                self.handle.registerTimer(self.timer)
        self.save()

    def open(self) -> None:
        self.next, self.done, self.progress, self.ewma, self.broken, self.left, self.timer, *last = self.at.get() or (self.first, 0, 0, 0.0, False, 0, None, (), (), ())
        self.rounds = list(zip(*last))
        self.number, self.rows, self.changed = None, {}, False

    def save(self) -> None:
        self.put_back()
        last = [list(x) for x in zip(*self.rounds)] or [[], [], []]
        self.at.update((self.next, self.done, self.progress, self.ewma, self.broken, self.left, self.timer, *last))

    def block(self, number: int) -> dict[int, tuple]:
        """The rounds that wait in a block; one block is held at a time."""
        if number != self.number:
            self.put_back()
            found = self.waiting.getValue((number,)) if self.left else None
            rounds, *columns = found or [()] * 5
            self.number, self.there, self.rows = number, found is not None, dict(zip(rounds, zip(*columns)))
        return self.rows

    def put_back(self) -> None:
        if self.changed and self.rows:
            self.waiting.updateValue((self.number,), ([*self.rows], *(list(x) for x in zip(*self.rows.values()))))
        elif self.changed and self.there:
            self.waiting.removeKey((self.number,))
        self.number, self.rows, self.changed = None, {}, False

    def fold(self, key, held: dict[int, tuple]) -> Iterator[Row]:
        """Folds all rounds that are next, from those held and those that wait, and lets the others wait."""
        while True:
            row = held.pop(self.next, None)
            first = self.block(self.next // BLOCK).pop(self.next, None) if self.left else None
            if first is not None:  # the one that came first counts
                row, self.changed = first, True
                self.left -= 1
            if row is None:
                break
            yield self.step(key, *row)
        for number in sorted(held):
            rows = self.block(number // BLOCK)
            if number not in rows:
                rows[number] = held[number]
                self.changed = True
                self.left += 1

    def step(self, key, gap, coverage, failed, value) -> Row:
        self.done += 1
        before = self.rounds[-1][0] if self.rounds else None
        two = self.rounds[-2] if len(self.rounds) > 1 else (None, None, None)
        known = None not in (gap, coverage, *two[:2])
        stuck = known and two[0] - gap < 1 and coverage - two[1] < 0.05
        if before is not None and gap is not None and before - gap >= 1:
            self.progress = self.done
        self.broken = self.broken or value is None
        self.ewma = 0.0 if self.broken else self.alpha * value + (1 - self.alpha) * self.ewma
        self.rounds = [*self.rounds, (gap, coverage, bool(failed))][-max(2, self.last):]
        streak = 0
        for r in reversed(self.rounds[-self.last:]):
            if not r[2]:
                break
            streak += 1
        number, self.next = self.next, self.next + 1
        return STATE(key[0], number, bool(stuck), self.progress, streak, None if self.broken else self.ewma)


def round_state(log: DataFrame, first: int = 1, last: int = 5, alpha: float = 0.3, late: str | None = None, patience_seconds: int = 3600) -> DataFrame:
    """(topic, round, is_stuck, last_progress, streak, ewma) of a stream log(topic, round, gap, coverage, failed, value, at), one row for each round, in order within a topic.

    Rounds count from `first` without a hole. Without `late`, a round waits for those before it however long it takes, and
    any order of arrival gives the same rows. With it (a watermark's delay), rows later than the watermark are dropped, and
    rounds still missing `patience_seconds` of event time after a later one came are given up; they are dropped if they come.
    A round that was folded or waits already is dropped: the first arrival counts. Null numbers make no decision: a round
    without gap or coverage is neither stuck nor progress, one without a value leaves no average from then on; null failed is
    false. A null topic is a topic; a null round is dropped. Needs the RocksDB state store (see started()).
    """
    rows = log.select(F.col("topic").cast("string").alias("topic"), F.col("round").cast("long").alias("round"), *(F.col(c).cast("double").alias(c) for c in ("gap", "coverage")), F.coalesce("failed", F.lit(False)).alias("failed"), F.col("value").cast("double").alias("value"), F.col("at").cast("timestamp").alias("at"))
    if late is not None:
        rows = rows.withWatermark("at", late)
    processor = Rounds(first, last, alpha, patience_seconds * 1000 if late is not None else None)
    return rows.groupBy("topic").transformWithState(processor, OUT, "Append", "None" if late is None else "EventTime")


def started(states: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends the rows to a Parquet folder, exactly once; takes what is there and stops. The same checkpoint goes on where the last run ended."""
    states.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return states.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
