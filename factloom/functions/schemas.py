"""Strict JSON schemas by row: a table function over a table of schemas."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: Properties in all, and levels, of a schema that a provider takes; keywords that it takes, those that go, those that make a node.
MAX_PROPERTIES, MAX_LEVELS = 5000, 10
TAKEN = frozenset("type properties required additionalProperties $defs $ref anyOf items enum const title description".split())
DROPPED = frozenset("default examples minLength maxLength pattern format minimum maximum exclusiveMinimum exclusiveMaximum multipleOf minItems maxItems uniqueItems".split())
MAKING = frozenset("type $ref anyOf enum".split())
#: How a keyword holds further schemas: by name, one, or several.
NAMED, SINGLE, SEVERAL = frozenset({"properties", "$defs"}), "items", "anyOf"


class Refused(ValueError):
    """The code of what is wrong."""


def check(ok: Any, code: str) -> None:
    if not ok:
        raise Refused(code)


class Strict:
    """One schema rewritten: objects are closed and ask for all their properties, a constant is an enumeration of one."""

    def __init__(self, schema: Any, properties: int, levels: int):
        self.left = properties
        self.schema = self.node(schema)
        self.within: list[str] = []
        check(self.levels(self.schema) <= levels, "too_deep")

    def node(self, schema: Any) -> dict:
        check(isinstance(schema, dict) and schema.keys() <= TAKEN | DROPPED, "unsupported")
        out: dict[str, Any] = {}
        for key, value in schema.items():
            if key in NAMED:
                check(isinstance(value, dict), "unsupported")
                out[key] = {name: self.node(own) for name, own in value.items()}
            elif key == SINGLE:
                out[key] = self.node(value)
            elif key == SEVERAL:
                check(isinstance(value, list), "unsupported")
                out[key] = [self.node(own) for own in value]
            elif key == "const":
                out["enum"] = [value]
            elif key not in DROPPED:
                out[key] = value
        if out.get("type") == "object" or "properties" in out:
            check(out.get("additionalProperties", False) is False, "open_object")
            names = list(out.setdefault("properties", {}))
            self.left -= len(names)
            check(self.left >= 0, "too_many_properties")
            out.update(type="object", required=names, additionalProperties=False)
        check(not MAKING.isdisjoint(out), "unsupported")
        return out

    def levels(self, node: dict) -> int:
        """Objects and arrays from here to the deepest; a definition inside itself adds none."""
        name = node.get("$ref")
        if name is not None:
            target = self.schema if name == "#" else self.schema.get("$defs", {}).get(str(name).removeprefix("#/$defs/")) if str(name).startswith("#/$defs/") else None
            check(target is not None, "unknown_reference")
            if name in self.within:
                return 0
            self.within.append(name)
            deep = self.levels(target)
            self.within.pop()
            return deep
        below = [*node.get("properties", {}).values(), *node.get(SEVERAL, []), *([node[SINGLE]] if SINGLE in node else [])]
        return (node.get("type") in ("object", "array")) + max(map(self.levels, below), default=0)


def rewritten(text: str | None, properties: int = MAX_PROPERTIES, levels: int = MAX_LEVELS) -> tuple[str | None, str | None]:
    """``(schema, code)``: the strict schema as JSON, or why there is none."""
    try:
        return json.dumps(Strict(json.loads(text or ""), properties, levels).schema, separators=(",", ":")), None
    except Refused as refused:
        return None, str(refused)
    except (ValueError, RecursionError):
        return None, "invalid_json"


class StrictSchemas:
    """``strict_schemas(table(t), column => 'schema', properties => 5000, levels => 10)``: every row of ``t`` with ``strict`` and ``code``."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, column: AnalyzeArgument, properties: AnalyzeArgument | None = None, levels: AnalyzeArgument | None = None) -> AnalyzeResult:
        if column.value not in rows.dataType.names:
            raise ValueError(f"the table has no column {column.value}")
        kept = [f for f in rows.dataType.fields if f.name not in ("strict", "code")]
        return AnalyzeResult(T.StructType([*kept, T.StructField("strict", T.StringType()), T.StructField("code", T.StringType())]))

    def eval(self, row: T.Row, column: str, properties: int = MAX_PROPERTIES, levels: int = MAX_LEVELS):
        own = row.asDict()
        yield (*(v for k, v in own.items() if k not in ("strict", "code")), *rewritten(own[column], properties, levels))


def register(spark) -> None:
    """Makes ``strict_schemas`` a table function of the session."""
    spark.udtf.register("strict_schemas", F.udtf(StrictSchemas))
