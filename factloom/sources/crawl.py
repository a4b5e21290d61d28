"""When requests may go out: policy versions as of a time, and queues of hosts with a delay.

A policy is good for ``ttl`` seconds from when it was read. So a request needs
only the versions of its own slot of ``ttl`` seconds and of the one before, and a
host is cut into slots whatever its number of requests. Queued times are a
max-plus prefix: a request starts at the latest of its own time and the start
before plus the delay, which is the sum of delays so far plus the running
maximum of (time - sum of delays). Both are taken within a slot first and then
over the slots of a host, of which there are few.

Times are microseconds, so sums are exact.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W

from factloom.operators.fold import folded

#: Seconds for which a policy is good, and the longest delay that a crawl waits for.
POLICY_SECONDS, MAX_DELAY = 3600, 20.0
_MICROS = 1_000_000


def _slot(at: Column, ttl: int) -> Column:
    return F.floor(at / F.lit(ttl * _MICROS)).cast("long")


def policies_at(requests: DataFrame, versions: DataFrame, *, ttl: int = POLICY_SECONDS) -> DataFrame:
    """``requests(host, at, …)`` with the latest of ``versions(host, read_at, …)`` that was read by then and less than
    ``ttl`` seconds before, as a struct ``policy``; null where none is, so that it must be asked for (again).

    Of versions read at once the greatest row is taken. Requests are dealt by host and slot; a version goes to its own
    slot and the next, where it can still be good."""
    own = [c for c in requests.columns]
    version = F.struct("read_at", *[c for c in versions.columns if c not in ("host", "read_at")])
    slots = F.explode(F.array(_slot(F.col("read_at"), ttl), _slot(F.col("read_at"), ttl) + 1))
    known = versions.where("read_at is not null").select("host", slots.alias("_slot"), F.col("read_at").alias("_at"), version.alias("_version"))
    # One row for each time, so that repeated reads do not multiply.
    known = known.groupBy("host", "_slot", "_at").agg(F.max("_version").alias("_version")).withColumn("_request", F.lit(None).cast(requests.select(F.struct(*own)).schema[0].dataType))
    asked = requests.select("host", _slot(F.col("at"), ttl).alias("_slot"), F.col("at").alias("_at"), F.lit(None).cast(known.schema["_version"].dataType).alias("_version"), F.struct(*own).alias("_request"))
    order = W.partitionBy("host", "_slot").orderBy(F.col("_at"), F.col("_version").isNull()).rowsBetween(W.unboundedPreceding, 0)
    last = F.last("_version", ignorenulls=True).over(order)
    out = known.unionByName(asked).withColumn("policy", last).where("_request is not null")
    good = F.col("policy.read_at") > F.col("_at") - ttl * _MICROS
    return out.select("_request.*", F.when(good, F.col("policy")).alias("policy"))


def policy_asks(requests: DataFrame, *, ttl: int = POLICY_SECONDS) -> DataFrame:
    """``(host, at)``: when the policies for ``requests(host, at)`` have to be read, each read being good for ``ttl`` seconds.

    A request asks if no earlier one did within ``ttl``. Requests of one second and host are one row before the fold; a
    request later in a second than its first asks only where the first could not have."""
    first = requests.where("at is not null").groupBy("host", F.floor(F.col("at") / _MICROS).alias("second")).agg(F.min("at").alias("at"), F.array_sort(F.collect_set("at")).alias("times"))

    def start():
        until = None

        def step(times):
            nonlocal until
            out = None
            for t in times:
                if until is None or t >= until:
                    until, out = t + ttl * _MICROS, t
            return None if out is None else (out,)

        return step

    return folded(first, ["host"], [F.col("at")], ["times"], "asked long", start).select("host", F.col("asked").alias("at"))


def queued(requests: DataFrame, *, slot: int = POLICY_SECONDS) -> DataFrame:
    """``requests(host, at, request_id, delay, …)`` with ``starts_at``: a request waits until ``delay`` seconds (its
    policy's; null is none) after the start of the one before it on the same host, by time and id."""
    wait = F.round(F.coalesce("delay", F.lit(0.0)) * _MICROS).cast("long")
    rows = requests.withColumn("_wait", wait).withColumn("_slot", _slot(F.col("at"), slot))
    inside = W.partitionBy("host", "_slot").orderBy("at", "request_id")
    so_far = inside.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.sum("_wait").over(so_far)).withColumn("_most", F.max(F.col("at") - F.col("_sum")).over(so_far))
    # Over slots: sums add up, and a slot's maximum is less what was waited for before it.
    totals = rows.groupBy("host", "_slot").agg(F.sum("_wait").alias("_total"), F.max("_most").alias("_peak"))
    before = W.partitionBy("host").orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("_past", F.coalesce(F.sum("_total").over(before), F.lit(0))).withColumn("_high", F.max(F.col("_peak") - F.col("_past")).over(before))
    out = rows.join(totals.select("host", "_slot", "_past", "_high"), ["host", "_slot"])
    start = F.col("_sum") + F.col("_past") + F.greatest(F.col("_most") - F.col("_past"), F.coalesce("_high", F.col("_most") - F.col("_past")))
    return out.select(*requests.columns, start.alias("starts_at"))
