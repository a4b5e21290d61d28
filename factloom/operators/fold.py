"""Folds over ordered rows: what a row gets depends on all before it in its group.

Rows are dealt by group, sorted, and streamed as Arrow batches through one step
function for each group. Time is linear in the rows and memory is that of a
batch and the step's own state, so a group may be of any size.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T


def folded(rows: DataFrame, keys: list[str], order: list[Column], inputs: list[str], new: str, start: Callable[[], Callable]) -> DataFrame:
    """``rows`` with the columns ``new`` (a schema string). ``start()`` gives a group's step: called with a row's
    ``inputs`` it returns the new values, or None to drop the row."""
    added = T._parse_datatype_string(new)
    kept = [f for f in rows.schema.fields if f.name not in added.names]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    kinds = [_arrow(f.dataType) for f in added.fields]

    def run(batches):
        now, step = None, None
        for batch in batches:
            key_columns = [batch.column(k).to_pylist() for k in keys]
            columns = [batch.column(c).to_pylist() for c in inputs]
            take, out = [], []
            for at, (key, values) in enumerate(zip(zip(*key_columns, strict=True), zip(*columns, strict=True), strict=True)):
                if step is None or key != now:
                    now, step = key, start()
                got = step(*values)
                if got is not None:
                    take.append(at)
                    out.append(got)
            own = batch.take(pa.array(take, pa.int64())).select([f.name for f in kept])
            made = zip(*out, strict=True) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(c, k) for c, k in zip(made, kinds, strict=True))], names=[*own.schema.names, *added.names])

    return dealt.mapInArrow(run, T.StructType([*kept, *added.fields]))


def _arrow(kind: T.DataType) -> pa.DataType:
    return {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.BooleanType: pa.bool_(), T.StringType: pa.string()}[type(kind)]
