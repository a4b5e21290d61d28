"""Streams of order-dependent rules against the batch folds, across restarts."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from factloom.operators import jobs
from factloom.streaming import replay

LIMITS = {"calls": 40, "input_tokens": 300, "output_tokens": 10_000, "tool_calls": 1000}
LEDGER = "scope string, ord long, key string, kind string, calls long, input_tokens long, output_tokens long, tool_calls long"


def ledger_rows(rng, n):
    rows = []
    for k in range(1, n + 1):
        kind = rng.choice(["reserve", "reserve", "settle", "settle", None])
        rows.append((k, rng.choice(["k1", "k2", "k3", None]), kind, 1, rng.choice([5, 20, 40, None]), 10, 0))
    return rows


def fed(spark, folder, parts, schema, make, keep):
    """The stream's rows after each part of the input, restarted in between."""
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out = replay.drained(lambda: make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")), f"{folder}/s")
    return sorted(map(tuple, out.select(*keep).collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_ledger_stream(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(s, *r) for s in "ab" for r in ledger_rows(rng, 60)]
    want = jobs.ledger(spark.createDataFrame(rows, LEDGER), ["scope"], LIMITS)
    keep = ["scope", "ord", "accepted", "spent_tokens", "in_flight_tokens"]
    # Out of order across restarts, and every event twice.
    mixed = rows + rows[::3]
    rng.shuffle(mixed)
    parts = [mixed[:50], mixed[50:90], mixed[90:]]
    got = fed(spark, tmp_path, parts, LEDGER, lambda s: replay.ledger(s, ["scope"], LIMITS), keep)
    assert got == sorted(map(tuple, want.select(*keep).collect())) and len(got) == 120


def test_places_stream(spark, tmp_path):
    rng = random.Random(3)
    rows = [(s, k, f"j{rng.randint(0, 12)}", rng.choice(["o1", "o2", "o3", None]), rng.choice(["submit", "submit", "finish"])) for s in "ab" for k in range(1, 61)]
    schema = "scope string, ord long, job_id string, owner_hash string, kind string"
    want = jobs.admitted_jobs(spark.createDataFrame(rows, schema), running=1, queued=2)
    mixed = rows[::-1]
    got = fed(spark, tmp_path, [mixed[:70], mixed[60:]], schema, lambda s: replay.admitted_jobs(s, ["scope"], running=1, queued=2), ["scope", "ord", "outcome"])
    assert got == sorted(map(tuple, want.select("scope", "ord", "outcome").collect())) and len(got) == 120


class Store:
    """State variables in memory that count how often they are asked."""

    def __init__(self):
        self.data, self.calls = {}, 0

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def _at(self, key=None):
        self.calls += 1
        return key

    exists = containsKey = lambda self, key=None: self._at(key) in self.data
    get = getValue = lambda self, key=None: self.data[self._at(key)]

    def removeKey(self, key):
        del self.data[self._at(key)]

    def update(self, value):
        self.data[self._at()] = value

    def updateValue(self, key, value):
        self.data[self._at(key)] = value


def test_waiting_events_cost_few_calls(spark):
    """each event that waited was put, asked for and removed by itself, and a repeat of one that waited won over it."""
    import pandas as pd

    class Seen:
        def __init__(self, state):
            self.state = state or 0

        def __call__(self, value):
            self.state += value
            return (self.state,)

    n, rng = 50_000, random.Random(4)
    late, early = [], []
    for k in range(1, n + 1):
        (late if k < 100 or rng.random() < 0.5 else early).append((k, k % 7))
    rng.shuffle(late)
    repeats = [(k, 1000) for k, _ in early[::3]]
    store, got = Store(), []
    replay_ = replay.Replay(["k"], Seen, ("v",), ["total"])
    replay_.init(store)
    for part in (early, repeats + late):
        chunks = [pd.DataFrame(part[at : at + 7000], columns=["ord", "v"]) for at in range(0, len(part), 7000)]
        got += [tuple(r) for out in replay_.handleInputRows(("a",), iter(chunks), None) for r in out.itertuples(index=False)]
    want, total = [], 0
    for k in range(1, n + 1):
        total += k % 7
        want.append(("a", k, total))
    assert got == want and store.calls < 1000 and set(store.data) == {None}


def test_expiry_stream(spark, tmp_path):
    at = lambda minutes: datetime(2024, 1, 1) + timedelta(minutes=minutes)
    first = [("a", at(0), at(60)), ("b", at(1), at(500)), ("c", at(2), at(30)), ("d", at(3), None)]
    then = [("a", at(5), at(90)), ("x", at(200), at(9000))]
    last = [("c", at(201), at(40)), ("y", at(400), at(9000)), ("y", at(420), at(9000))]
    schema = "report_id string, ts timestamp, expires_at timestamp"
    got = fed(spark, tmp_path, [first, then, last], schema, lambda s: replay.expired(s, "report_id"), ["report_id"])
    assert got == [("a",), ("c",)]


class Timers(Store):
    """The handle too, with one key's timers."""

    def __init__(self):
        super().__init__()
        self.timers = set()

    def registerTimer(self, millis):
        self.timers.add(self._at(millis))

    def deleteTimer(self, millis):
        self.timers.remove(self._at(millis))

    def clear(self):
        self.data.pop(self._at(), None)

    def getCurrentWatermarkInMs(self):
        return self.now

    def getExpiryTimeInMs(self):
        return self.due


def test_events_of_records_cost_few_calls(spark):
    """each event asked the state, and moved a timer, by itself."""
    import pandas as pd

    rng, store, held, got, want = random.Random(5), Timers(), {}, [], []
    records = replay.Expiry("report_id")
    records.init(store)
    for batch in range(8):
        store.now = max(0, batch * 1000 - 200)
        rows = [(rng.choice("abcdefgh"), None if rng.random() < 0.1 else batch * 1000 + rng.randint(-500, 4000) * (batch < 2)) for _ in range(5000)]
        rows = rows if batch < 2 else rows[:3] + [("late", store.now), (None, 5000.0)]
        for name, millis in rows:
            if millis is not None and millis > store.now and millis > held.get(name, 0):
                held[name] = int(millis)
        chunks = [pd.DataFrame(rows[at : at + 1000], columns=["report_id", "until_millis"]) for at in range(0, len(rows), 1000)]
        assert not any(len(out) for out in records.handleInputRows((0,), iter(chunks), store))
        for store.due in sorted(t for t in store.timers if t < store.now):
            got += [(batch, r[0], r[1].value // 10**6) for out in records.handleExpiredTimer((0,), store, store) for r in out.itertuples(index=False)]
            store.timers.discard(store.due)
        want += [(batch, name, millis) for name, millis in held.items() if millis < store.now]
        held = {name: millis for name, millis in held.items() if millis >= store.now}
    assert store.calls < 60
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 4


@pytest.mark.parametrize("buckets", [1, 64])
def test_expiry_of_keys_of_any_type(spark, tmp_path, buckets):
    """Keys come back as they were, null ones and longs that a double does not hold, each at its own end."""
    from pyspark.sql import functions as F

    at = lambda minutes: datetime(2024, 1, 1) + timedelta(minutes=minutes)
    big = 2**53 + 1
    first = [(big, at(0), at(30)), (big + 1, at(1), at(40)), (None, at(2), at(50)), (7, at(3), None), (8, at(4), at(300))]
    schema = "k long, ts timestamp, expires_at timestamp"
    make = lambda s: replay.expired(s, "k", buckets=buckets).select(F.date_format("expired_at", "HH:mm").alias("end"), "k")
    got = fed(spark, tmp_path, [first, [(9, at(200), at(9000))], [(9, at(320), at(9000))]], schema, make, ["end", "k"])
    assert got == [("00:30", big), ("00:40", big + 1), ("00:50", None), ("05:00", 8)]


def test_folds_take_nulls(spark):
    from factloom.operators import select

    rows = spark.createDataFrame([("s", 1, 5), ("s", 2, None), ("s", 3, 4), ("s", 4, 2), (None, 1, None)], "k string, o long, n long")
    assert sorted((r.k or "", r.o, r.admitted) for r in jobs.admissions(rows, ["k"], "o", "n", budget=8).collect()) == [("", 1, False), ("s", 1, True), ("s", 2, False), ("s", 3, False), ("s", 4, True)]
    assert sorted((r.k, r.o, r.pos) for r in select.first_fit(rows, ["k"], [("o", False)], "n", 8, item="o").collect()) == [("s", 1, 0), ("s", 4, 1)]
    assert sorted((r.k or "", r.o, r.chunk) for r in select.chunks(rows, ["k"], "o", "n", limit=9, overhead=1).collect()) == [("", 1, 0), ("s", 1, 0), ("s", 2, 0), ("s", 3, 1), ("s", 4, 1)]
