"""Order-dependent rules as streams: the steps of the batch folds, with their state in a state store.

A scope's events carry a number, from 1 without gaps. Micro-batches may bring
them in any order, late or again: an event waits in state until those before it
have come, and one whose number is past is a repeat and changes nothing. So the
rows are those of the batch fold, however the input is cut, and after a restart
from the checkpoint. State is what the fold remembers and the events that wait.

Expiry uses event-time timers: a record's state goes when its time has come.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from factloom.operators import jobs

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which state variables need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


#: Numbers whose events wait in one entry of the state, and rows given at a time.
BLOCK, GIVEN = 1024, 10_000


class Replay(StatefulProcessor):
    """``steps(state)`` makes the fold's step object from its stored state. Events wait by blocks of numbers, so the
    state is asked once for many of them; what comes in order never goes there."""

    def __init__(self, keys: list[str], steps: Callable[[dict | None], Any], inputs: tuple[str, ...], outputs: list[str]):
        self.keys, self.steps, self.inputs, self.outputs = keys, steps, inputs, outputs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "next long, json string")
        self.waiting = handle.getMapState("waiting", "block long", "json string")

    def _held(self, block: int) -> dict[int, list]:
        return {n: values for n, *values in json.loads(self.waiting.getValue((block,))[0])} if self.waiting.containsKey((block,)) else {}

    def _hold(self, block: int, events: dict[int, list]) -> None:
        if events:
            self.waiting.updateValue((block,), (json.dumps([[n, *values] for n, values in events.items()]),))
        elif self.waiting.containsKey((block,)):
            self.waiting.removeKey((block,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        due, stored = self.state.get() if self.state.exists() else (1, None)
        step, new, out = self.steps(json.loads(stored) if stored else None), {}, []
        block = due // BLOCK
        held = self._held(block)
        for pdf in filter(len, rows):
            columns = [[None if v != v else v for v in pdf[c].tolist()] for c in self.inputs]
            for n, values in zip(pdf["ord"].tolist(), zip(*columns, strict=True), strict=True):
                if n >= due:
                    new.setdefault(n, values)  # the first of repeats counts
                while due in held or due in new:
                    later = new.pop(due, None)
                    out.append((*key, due, *step(*held.pop(due, later))))
                    due += 1
                    if due // BLOCK != block:
                        self._hold(block, {})
                        block = due // BLOCK
                        held = self._held(block)
            if len(out) >= GIVEN:
                yield pd.DataFrame(out, columns=[*self.keys, "ord", *self.outputs])
                out = []
        blocks: dict[int, dict] = {block: {}}
        for n, values in new.items():
            blocks.setdefault(n // BLOCK, {})[n] = values
        for own, events in blocks.items():
            self._hold(own, events | (held if own == block else self._held(own) if events else {}))
        self.state.update((due, json.dumps(step.state)))
        yield pd.DataFrame(out, columns=[*self.keys, "ord", *self.outputs])

    def close(self) -> None:
        pass


def replayed(events: DataFrame, keys: list[str], steps: Callable[[dict | None], Any], inputs: tuple[str, ...], outputs: str) -> DataFrame:
    added = T._parse_datatype_string(outputs)
    schema = T.StructType([*(events.schema[k] for k in keys), T.StructField("ord", T.LongType()), *added.fields])
    own = events.select(*keys, F.col("ord").cast("long").alias("ord"), *inputs)
    return own.groupBy(*keys).transformWithStateInPandas(Replay(keys, steps, inputs, added.names), schema, "append", "none")


def ledger(events: DataFrame, scope: list[str], limits: dict[str, int]) -> DataFrame:
    """``jobs.ledger`` as a stream: ``(scope, ord, accepted, spent_tokens, in_flight_tokens)``."""
    return replayed(events, scope, lambda state: jobs.LedgerSteps(limits, state), jobs.LEDGER_INPUTS, jobs.LEDGER_OUTPUTS)


def admitted_jobs(events: DataFrame, scope: list[str], *, running: int = 2, queued: int = 4, per_owner: int = 1) -> DataFrame:
    """``jobs.admitted_jobs`` as a stream: ``(scope, ord, outcome)``."""
    return replayed(events, scope, lambda state: jobs.PlaceSteps(running, queued, per_owner, state), jobs.PLACE_INPUTS, jobs.PLACE_OUTPUTS)


#: Parts that expiring records are dealt to. A part's records are one entry of the state, with one timer.
BUCKETS = 1024


class Expiry(StatefulProcessor):
    """Keeps the records of a bucket until their time; a timer tells when the first of them goes. So the state is asked a few
    times for a bucket, not for each record and event."""

    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getValueState("live", "first long, json string")

    def _held(self) -> tuple[int | None, dict[str | None, int]]:
        first, held = self.live.get() if self.live.exists() else (None, "[]")
        return first, dict(json.loads(held))

    def _hold(self, held: dict[str | None, int]) -> int | None:
        first = min(held.values(), default=None)
        if held:
            self.live.update((first, json.dumps(list(held.items()))))
        else:
            self.live.clear()
        return first

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        timer, held = self._held()
        for pdf in filter(len, rows):
            records = [None if v != v else v for v in pdf[self.key].tolist()]
            for record, millis in zip(records, pdf["until_millis"].tolist(), strict=True):
                if millis is not None and millis > now and millis > held.get(record, now):  # a later end of the same record wins
                    held[record] = int(millis)
        if held:
            first = self._hold(held)
            if first != timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(first)
        yield pd.DataFrame(columns=[self.key, "expired_at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        timer, held = self._held()
        if timer == expiredTimerInfo.getExpiryTimeInMs():
            gone = {record: millis for record, millis in held.items() if millis < now}
            first = self._hold({record: millis for record, millis in held.items() if millis >= now})
            if first is not None:
                self.handle.registerTimer(first)
            yield pd.DataFrame({self.key: list(gone), "expired_at": pd.to_datetime(list(gone.values()), unit="ms", utc=True)})

    def close(self) -> None:
        pass


def expired(records: DataFrame, key: str, *, ts: str = "ts", expires: str = "expires_at", late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """``(key, expired_at)`` of records whose end the watermark has passed, each once. Times count in milliseconds, rounded up.
    Keys are of a type that a cast to string and back keeps; ``buckets`` stays what it was when the checkpoint was begun."""
    millis = F.ceil(F.unix_micros(F.col(expires).cast("timestamp")) / 1000).alias("until_millis")
    name = F.col(key).cast("string")
    bucket = F.pmod(F.xxhash64(name), F.lit(buckets)).alias("key_bucket")
    own = records.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).select(bucket, name.alias(key), ts, millis)
    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField("expired_at", T.TimestampType())])
    out = own.groupBy("key_bucket").transformWithStateInPandas(Expiry(key), schema, "append", "EventTime")
    return out.select(F.col(key).cast(records.schema[key].dataType).alias(key), "expired_at")


def drained(stream: Callable[[], DataFrame], folder: str) -> DataFrame:
    """All that the stream gives for the input there is now, beside what it gave before from the same ``folder``."""
    own = stream()
    with state_store(own.sparkSession):
        query = own.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return own.sparkSession.read.schema(own.schema).parquet(f"{folder}/out")
