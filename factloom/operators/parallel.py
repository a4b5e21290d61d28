"""A bounded parallel map: a call a row, failures as values."""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Call:
    """One row's call: when it began, and what came of it."""

    __slots__ = ("began", "done", "error", "value")

    def __init__(self):
        self.began, self.done, self.value, self.error = None, threading.Event(), None, None


class Pool:
    """At most ``width`` calls under way. A call over its deadline is given up: its thread is left to end by itself, and
    another takes its place, at most ``lost`` times in a task."""

    def __init__(self, call: Callable, width: int, lost: int):
        self.call, self.lost, self.todo = call, lost, queue.SimpleQueue()
        for _ in range(width):
            self._worker()

    def _worker(self) -> None:
        threading.Thread(target=self._run, daemon=True).start()

    def _run(self) -> None:
        while (item := self.todo.get()) is not None:
            own, values = item
            own.began = time.monotonic()
            try:
                value, error = self.call(*values), None
            except Exception as failed:  # every exception of a row is its value
                value, error = None, f"{type(failed).__name__}: {failed}"
            if own.done.is_set():
                return  # given up meanwhile; another thread has this one's place
            own.value, own.error = value, error
            own.done.set()

    def wait(self, own: Call, deadline: float) -> None:
        while not own.done.wait(0.002 if own.began is None else max(0.0, own.began + deadline - time.monotonic())):
            if own.began is not None and time.monotonic() >= own.began + deadline:
                own.error = "timeout"
                own.done.set()
                self.lost -= 1
                if self.lost < 0:
                    raise RuntimeError("too many calls do not end")
                self._worker()


def parallel_map(rows: DataFrame, call: Callable, inputs: list[str], out: str, *, width: int = 4, deadline: float = 20.0, lost: int = 64) -> DataFrame:
    """``rows`` in their order with ``value``, what ``call`` gives for a row's ``inputs`` (of type ``out``, in DDL), and
    ``error``: its exception by class and message, ``timeout`` after ``deadline`` seconds of its own, or ``type`` if
    the value is not of the type. A task has at most ``width`` calls under way and holds one batch of rows. For calls that
    wait, on a disk or a service; what computes belongs in expressions."""
    kind = T._parse_datatype_string(out)
    kept = [f for f in rows.schema.fields if f.name not in ("value", "error")]
    schema = T.StructType([*kept, T.StructField("value", kind), T.StructField("error", T.StringType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        arrow, pool = to_arrow_type(kind), Pool(call, width, lost)
        for batch in batches:
            calls = [Call() for _ in range(len(batch))]
            for item in zip(calls, zip(*(batch.column(c).to_pylist() for c in inputs), strict=True), strict=True):
                pool.todo.put(item)
            values, errors = [], []
            for own in calls:
                pool.wait(own, deadline)
                value, error = (None, own.error) if own.error else (own.value, None)
                try:
                    values.append(pa.scalar(value, arrow))
                except (pa.ArrowInvalid, pa.ArrowTypeError, OverflowError):
                    values.append(pa.scalar(None, arrow))
                    error = "type"
                errors.append(error)
            columns = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([v.as_py() for v in values], arrow), pa.array(errors, pa.string())], names=schema.names)
        for _ in range(width):
            pool.todo.put(None)

    return rows.mapInArrow(run, schema)
