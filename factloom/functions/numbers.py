"""Numbers as text: canonical tokens and the checks that compare them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = r"(?U)\b\d+(?:[.,]\d+)*%?"


def canonical_number(token: Column) -> Column:
    """Thousands commas, leading zeros and trailing fraction zeros out; ``%`` stays."""
    percent = F.when(F.endswith(token, F.lit("%")), "%").otherwise("")
    n = F.regexp_replace(token, "%", "")
    n = F.when(F.regexp_like(n, F.lit(r"\A\d{1,3}(?:,\d{3})+(?:\.\d+)?\z")), F.replace(n, F.lit(","), F.lit(""))).otherwise(n)
    whole = F.coalesce(F.nullif(F.regexp_replace(F.substring_index(n, ".", 1), r"\A0+", ""), F.lit("")), F.lit("0"))
    part = F.regexp_replace(F.regexp_extract(n, r"\.(\d+)\z", 1), r"0+\z", "")
    plain = F.concat(whole, F.when(part != "", F.concat(F.lit("."), part)).otherwise(""))
    return F.concat(F.when(F.regexp_like(n, F.lit(r"\A\d+(?:\.\d+)?\z")), plain).otherwise(n), percent)


def numeric_tokens(text: Column) -> Column:
    """The distinct numbers of a text, in order of first appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), canonical_number))


def numbers_within(claim: Column, source: Column) -> Column:
    """Whether every number of ``claim`` is one of ``source``."""
    return F.size(F.array_except(numeric_tokens(claim), numeric_tokens(source))) == 0


def quantity_quoted(numeric_text: Column, quotes: Column) -> Column:
    """Whether a quote has exactly this number (or number word), not as part of a longer one."""
    q = F.concat(F.lit(r"\Q"), numeric_text, F.lit(r"\E"))
    pattern = F.when(F.regexp_like(numeric_text, F.lit(r"\d")), F.concat(F.lit(r"(?U)(?<![\d.,])"), q, F.lit(r"(?![\d.,])"))).otherwise(F.concat(F.lit(r"(?U)(?<!\w)"), q, F.lit(r"(?!\w)")))
    return F.exists(quotes, lambda x: F.regexp_like(x, pattern))


def token_estimate(chars: Column, *, multiplier: float = 1.25, framing: int = 256) -> Column:
    """Budgeted tokens of a request: four characters a token, 64 of overhead, a safety factor and framing."""
    return (F.ceil((F.ceil(chars / 4) + 64) * multiplier) + framing).cast("long")


def retry_delay(retry_after: Column, attempt: Column, jitter: Column | float = 0.0) -> Column:
    wait = F.least(F.pow(F.lit(2.0), attempt), F.lit(8.0))
    return F.coalesce(retry_after.cast("double"), wait + (jitter if isinstance(jitter, Column) else F.lit(jitter)))
