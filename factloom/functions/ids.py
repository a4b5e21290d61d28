"""Canonical JSON, stable ids, fingerprints and sizes."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """Sorted keys, no spaces, ASCII escapes in lower-case hex; null for what is not JSON."""

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=True)
        except ValueError:
            return None

    return text.map(one)


def ascii_json(**fields: Column) -> Column:
    """Canonical JSON of ASCII fields, by built-in functions: names in order, nulls kept."""
    return F.to_json(F.struct(*[fields[n].alias(n) for n in sorted(fields)]), {"ignoreNullFields": "false"})


def fingerprint(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def stable_id(prefix: str, canonical: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.left(fingerprint(canonical), F.lit(16)))


def source_identity(url: Column, content_hash: Column) -> Column:
    return F.left(F.sha2(F.concat(url, F.char(F.lit(0)), content_hash), 256), F.lit(24))


def span_id(identity: Column, ordinal: Column) -> Column:
    """Ordinals from 1; over 9999 they keep all their digits."""
    number = F.when(ordinal <= 9999, F.lpad(ordinal.cast("string"), 4, "0")).otherwise(ordinal.cast("string"))
    return F.concat(F.lit("sp_"), identity, F.lit("_"), number)


def namespace(email: Column) -> Column:
    return F.sha2(email, 256)


def json_size(value: Column) -> Column:
    return F.octet_length(F.to_json(value, {"ignoreNullFields": "false"}))


def identifier(value: Column, kind: str) -> Column:
    """Whether a string is an id of this kind, as a whole."""
    shape = {"report": r"[a-f0-9]{32}", "submission": r"[A-Za-z0-9_-]{16,80}", "hash": r"[a-f0-9]{64}"}[kind]
    return F.regexp_like(value, F.lit(rf"\A{shape}\z"))
