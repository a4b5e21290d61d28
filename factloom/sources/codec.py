"""Signed, compressed report blobs, and JSON sinks.

Blob: JSON, gzip at level 6 with no time, URL-safe base64, HMAC-SHA256. The
key is a parameter; Spark has no HMAC, so both ways are Arrow functions.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import hmac
import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_REPORT, MAX_BLOB = 2 << 20, 512 << 10
TTL_DAYS = 7


def seal(text: str, key: bytes) -> tuple[str | None, str | None, str | None]:
    """``(blob, signature, error)``."""
    data = text.encode()
    if len(data) > MAX_REPORT:
        return None, None, "report_too_large"
    blob = base64.urlsafe_b64encode(gzip.compress(data, 6, mtime=0))
    if len(blob) > MAX_BLOB:
        return None, None, "report_too_large"
    return blob.decode(), hmac.new(key, blob, hashlib.sha256).hexdigest(), None


def unseal(blob: str | None, signature: str | None, key: bytes) -> tuple[str | None, str | None]:
    """``(json, error)``; the signature is compared in constant time before anything is decoded."""
    shaped = blob and signature and len(blob) <= MAX_BLOB and re.fullmatch(r"[A-Za-z0-9_-]+={0,2}", blob) and re.fullmatch("[a-f0-9]{64}", signature)
    if not shaped:
        return None, "invalid_blob"
    if not hmac.compare_digest(signature, hmac.new(key, blob.encode(), hashlib.sha256).hexdigest()):
        return None, "bad_signature"
    try:
        worker = zlib.decompressobj(31)
        data = worker.decompress(base64.b64decode(blob, altchars=b"-_", validate=True), MAX_REPORT + 1)
        if len(data) > MAX_REPORT or not worker.eof or worker.unused_data:
            return None, "invalid_blob"
        return data.decode(), None
    except (ValueError, zlib.error):
        return None, "invalid_blob"


def encoded(text: Column, key: bytes) -> Column:
    @F.pandas_udf("struct<blob:string,signature:string,error:string>")
    def run(t: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None, None) if x is None else seal(x, key) for x in t], columns=["blob", "signature", "error"])

    return run(text)


def decoded(blob: Column, signature: Column, key: bytes) -> Column:
    @F.pandas_udf("struct<json:string,error:string>")
    def run(b: pd.Series, s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([unseal(x, y, key) for x, y in zip(b, s, strict=True)], columns=["json", "error"])

    return run(blob, signature)


def opened(cached: DataFrame, key: bytes, *, owner: Column, now: Column) -> DataFrame:
    """``cached(report_id, owner_hash, generated_at, expires_at, blob, signature)`` with ``json`` and why it stays shut, if so."""
    out = cached.withColumn("_d", decoded(F.col("blob"), F.col("signature"), key))
    due = F.col("generated_at") + F.make_dt_interval(F.lit(TTL_DAYS))
    error = (
        F.when(F.col("_d.error").isNotNull(), F.col("_d.error"))
        .when(F.col("owner_hash") != owner, "wrong_owner")
        .when(F.col("expires_at") != due, "invalid_expiry")
        .when(F.col("generated_at") > now + F.expr("interval 1 minute"), "clock")
        .when(F.col("expires_at") <= now, "expired")
    )
    return out.withColumn("error", error).withColumn("json", F.when(F.col("error").isNull(), F.col("_d.json"))).drop("_d")


def header(reports: DataFrame) -> DataFrame:
    """The list entry of a saved report."""
    return reports.select("report_id", F.left("name", F.lit(240)).alias("name"), "generated_at", (F.col("generated_at") + F.make_dt_interval(F.lit(TTL_DAYS))).alias("expires_at"), "input_fingerprint", "blob")


def pretty_json(row: Column) -> Column:
    return F.to_json(row, {"pretty": "true", "ignoreNullFields": "false"})


def write_json_lines(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)
