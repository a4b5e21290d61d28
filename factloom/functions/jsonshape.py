"""Strict JSON: closed shapes, no coercion, no repeated keys, bounded depth.

``from_json`` passes unknown keys and keeps the last of repeated ones, so the
gate is an Arrow function; what it lets through is then read by ``from_json``.
"""

from __future__ import annotations

import json
import math
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _unique(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("repeated key")
    return out


def _no_constant(name: str) -> None:
    raise ValueError(name)


def strict_loads(text: str) -> Any:
    return json.loads(text, object_pairs_hook=_unique, parse_constant=_no_constant)


def depth(value: Any) -> int:
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return 1 + max(map(depth, inner), default=0) if isinstance(value, dict | list) else 0


def fits(value: Any, kind: T.DataType, nullable: bool = True) -> bool:
    """Whether a parsed value has exactly this shape: all keys, no others, no type conversion."""
    if value is None:
        return nullable
    match kind:
        case T.StructType():
            return isinstance(value, dict) and value.keys() == set(kind.names) and all(fits(value[f.name], f.dataType, f.nullable) for f in kind)
        case T.ArrayType():
            return isinstance(value, list) and all(fits(x, kind.elementType, kind.containsNull) for x in value)
        case T.BooleanType():
            return isinstance(value, bool)
        case T.IntegerType() | T.LongType():
            return isinstance(value, int) and not isinstance(value, bool)
        case T.DoubleType():
            return isinstance(value, int | float) and not isinstance(value, bool) and math.isfinite(value)
        case T.StringType():
            return isinstance(value, str)
    return False


def json_shape(text: Column, schema: str, *, most: int = 64) -> Column:
    """Null if ``text`` is strict JSON of ``schema`` (DDL), else why not."""
    kind = T._parse_datatype_string(schema)

    @F.pandas_udf("string")
    def check(column: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            try:
                value = strict_loads(x or "")
            except (ValueError, RecursionError):
                return "invalid_json"
            if depth(value) > most:
                return "too_deep"
            return None if fits(value, kind) else "wrong_shape"

        return column.map(one)

    return check(text)


def strict_schema(kind: T.DataType, *, properties: int = 5000, levels: int = 10) -> dict[str, Any]:
    """A closed JSON schema of a Spark type: all properties required; an error beyond the limits."""
    seen = 0

    def node(t: T.DataType, nullable: bool, level: int) -> dict[str, Any]:
        nonlocal seen
        if level > levels:
            raise ValueError("the schema is too deep")
        match t:
            case T.StructType():
                seen += len(t)
                if seen > properties:
                    raise ValueError("the schema has too many properties")
                out: dict[str, Any] = {"type": "object", "properties": {f.name: node(f.dataType, f.nullable, level + 1) for f in t}, "required": t.names, "additionalProperties": False}
            case T.ArrayType():
                out = {"type": "array", "items": node(t.elementType, t.containsNull, level + 1)}
            case T.BooleanType():
                out = {"type": "boolean"}
            case T.IntegerType() | T.LongType():
                out = {"type": "integer"}
            case T.DoubleType():
                out = {"type": "number"}
            case _:
                out = {"type": "string"}
        return {"anyOf": [out, {"type": "null"}]} if nullable else out

    return node(kind, False, 0)


def error_list(errors: Column, *, most: int = 8) -> Column:
    """Distinct ``path: kind`` lines of an array of structs (loc array<string>, kind), the first few."""
    return F.slice(F.array_distinct(F.transform(errors, lambda e: F.concat(F.array_join(e["loc"], "."), F.lit(": "), e["kind"]))), 1, most)
