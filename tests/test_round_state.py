"""The round log as a stream with state: any order of arrival, repeats, restarts, rounds that never come."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row, Window
from pyspark.sql import functions as F

from sievewright.operators import planning
from sievewright.streaming import round_state as S

LOG = "topic string, round long, gap double, coverage double, failed boolean, value double, at timestamp"
START = datetime(2024, 1, 1)


def log_rows(seed, topics=6, most=14):
    r = random.Random(seed)
    rows = []
    for t in [*(f"t{k}" for k in range(topics)), None]:
        for n in range(1, r.randint(2, most)):
            rows.append((t, n, r.choice([None, *range(6)]) if r.random() < 0.9 else 9.0, r.random() / 10, r.choice([True, True, False, None]), r.choice([0.0, 1.5, 3.0]) if t != "t3" or n != 4 else None, START + timedelta(minutes=n)))
    return [tuple(float(x) if k in (2, 3, 5) and x is not None else x for k, x in enumerate(row)) for row in rows]


def streamed(spark, folder, **options):
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", "2")
    log = own.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{folder}/log")
    S.started(S.round_state(log, **options), f"{folder}/out", f"{folder}/checkpoint").awaitTermination(240)
    return spark.read.schema(S.OUT).parquet(f"{folder}/out")


def put(spark, folder, rows):
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{folder}/log")


def last_of_each(states):
    return states.withColumn("n", F.row_number().over(Window.partitionBy("topic").orderBy(F.col("round").desc()))).where("n = 1")


def same_as_batch(spark, states, rows):
    log = spark.createDataFrame(rows, LOG)
    guard = planning.loop_guard(log, "topic", "round", "gap", "coverage").select("topic", "round", "is_stuck", F.col("last_progress").cast("long"))
    key = lambda r: repr(tuple(r))
    assert sorted(states.select("topic", "round", "is_stuck", "last_progress").collect(), key=key) == sorted(guard.collect(), key=key)
    last = {r["topic"]: r for r in last_of_each(states).collect()}
    streaks = planning.failure_streak(log.withColumn("failed", F.coalesce("failed", F.lit(False))), "topic", "round", F.col("failed"))
    assert {r["topic"]: r["streak"] for r in streaks.collect()} == {t: r["streak"] for t, r in last.items()}
    for r in planning.ewma(log, "topic", "round", "value").collect():
        got = last[r["topic"]]["ewma"]
        assert got is None if r["ewma"] is None else abs(got - r["ewma"]) < 1e-9


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_arrival(spark, tmp_path, seed):
    rows = log_rows(seed)
    mixed = rows + rows[::3]  # a third comes twice
    random.Random(seed).shuffle(mixed)
    for k in range(3):
        put(spark, tmp_path, mixed[k::3])
    same_as_batch(spark, streamed(spark, tmp_path), rows)


def test_restart_from_the_checkpoint(spark, tmp_path):
    rows = log_rows(3)
    put(spark, tmp_path, rows[1::2])
    first = streamed(spark, tmp_path).count()
    put(spark, tmp_path, rows[0::2])
    states = streamed(spark, tmp_path)
    assert first < states.count() == len(rows)
    same_as_batch(spark, states, rows)
    put(spark, tmp_path, rows[:5])  # nothing new
    assert streamed(spark, tmp_path).count() == len(rows)


def test_rounds_that_never_come(spark, tmp_path):
    row = lambda n, minutes: ("t", n, 5.0, 0.0, True, 1.0, START + timedelta(minutes=minutes))
    put(spark, tmp_path, [row(1, 1), row(3, 3)])
    put(spark, tmp_path, [("other", 1, 1.0, 0.0, False, 1.0, START + timedelta(days=1))])
    put(spark, tmp_path, [row(4, 24 * 60 + 5)])
    put(spark, tmp_path, [("other", 2, 1.0, 0.0, False, 1.0, START + timedelta(days=3))])
    states = streamed(spark, tmp_path, late="10 minutes", patience_seconds=600)
    assert sorted(r["round"] for r in states.where("topic = 't'").collect()) == [1, 3, 4]


def test_an_empty_log(spark, tmp_path):
    put(spark, tmp_path, [])
    assert streamed(spark, tmp_path).count() == 0


class Held:
    """State of one topic in memory, with the number of calls that a stream would make."""

    def __init__(self):
        self.calls, self.value, self.values, self.list = 0, None, {}, []

    def getValueState(self, name, schema):
        return Kept(self, exists=lambda: self.value is not None, get=lambda: self.value, update=lambda x: setattr(self, "value", x))

    def getListState(self, name, schema):
        return Kept(self, get=lambda: iter(self.list), put=lambda x: setattr(self, "list", x))

    def getMapState(self, name, *schemas):
        v = self.values
        return Kept(self, containsKey=lambda k: k in v, getValue=v.get, updateValue=v.__setitem__, removeKey=lambda k: v.pop(k), keys=lambda: iter([*v]))


class Kept:
    def __init__(self, held, **methods):
        self.held, self.methods = held, methods

    def __getattr__(self, name):
        def call(*args):
            self.held.calls += 1
            return self.methods[name](*args)

        return call


def test_calls_to_the_state_do_not_grow_with_rounds():
    def folded(n, parts):
        held, rounds = Held(), S.Rounds(1, 5, 0.3, None)
        rounds.init(held)
        numbers = list(range(1, n + 1))
        random.Random(n).shuffle(numbers)
        entry = Row("topic", "round", "gap", "coverage", "failed", "value", "at")
        out = [r for k in range(parts) for r in rounds.handleInputRows(("t",), (entry("t", i, 1.0 * i, 0.1, i % 3 == 0, 2.0, START) for i in numbers[k::parts]), None)]
        assert [r["round"] for r in out] == list(range(1, n + 1))
        assert not held.values
        return held.calls

    assert folded(120, 3) <= 12
    assert folded(1000, 3) <= 3 * (2 + 2 * (1000 // S.BLOCK + 2))
