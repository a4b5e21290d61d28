"""Policies as of a time and queues of hosts, against step-by-step versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.sources import crawl

S = 1_000_000


def as_of(requests, versions, ttl):
    out = []
    for host, at, n in requests:
        known = [(t, d) for h, t, d in versions if h == host and t <= at and t > at - ttl * S]
        out.append((host, n, max(known) if known else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed, ttl", [(0, 3600), (1, 60), (2, 5)])
def test_policies_as_of(spark, seed, ttl):
    rng = random.Random(seed)
    requests = [(rng.choice("ab"), rng.randint(0, 9000) * S // 10, n) for n in range(300)] + [("c", 5, 1), (None, 7, 2)]
    versions = [(rng.choice("ab"), rng.randint(0, 9000) * S // 10, rng.randint(0, 9)) for _ in range(60)] + [("a", 0, 3), ("a", 0, 4), ("b", None, 5)]
    # Exactly as old as a policy may get, and one microsecond less.
    requests += [("a", ttl * S, 901), ("a", ttl * S - 1, 902), ("a", 0, 903)]
    df = spark.createDataFrame([(*r, "x") for r in requests], "host string, at long, n long, delay string")
    got = crawl.policies_at(df, spark.createDataFrame(versions, "host string, read_at long, delay long"), ttl=ttl)
    assert got.columns == ["host", "at", "n", "delay", "policy"]
    known = [v for v in versions if v[1] is not None]
    assert sorted(((r.host, r.n, r.policy and tuple(r.policy)) for r in got.collect()), key=repr) == as_of(requests, known, ttl)


def test_policies_of_nothing(spark):
    requests = spark.createDataFrame([("a", 1)], "host string, at long")
    versions = spark.createDataFrame([], "host string, read_at long, delay long")
    assert [r.policy for r in crawl.policies_at(requests, versions).collect()] == [None]
    assert crawl.policies_at(requests.limit(0), versions).collect() == []


def queue(rows):
    """One after the other, host by host."""
    out, last = {}, {}
    for host, at, n, delay in sorted(rows, key=lambda r: (r[1], r[2])):
        start = at if host not in last else max(at, last[host] + round((delay or 0) * S))
        last[host] = out[host, n] = start
    return out


@pytest.mark.parametrize("seed, slot", [(0, 3600), (1, 10), (2, 1)])
def test_queues(spark, seed, slot):
    rng = random.Random(seed)
    rows = [(rng.choice("aab"), rng.randint(0, 200) * S // 2, n, rng.choice([None, 0.0, 0.25, 1.5, 20.0])) for n in range(500)]
    got = crawl.queued(spark.createDataFrame(rows, "host string, at long, request_id long, delay double"), slot=slot)
    assert {(r.host, r.request_id): r.starts_at for r in got.collect()} == queue(rows)


def test_a_host_of_a_million_requests(spark):
    """The prefix over one host, against the same in numpy."""
    n = 1_000_000
    rows = spark.range(n).select(F.lit("h").alias("host"), (F.col("id") * 7_919_000 % (n * 5_000)).alias("at"), F.col("id").alias("request_id"), (F.col("id") % 5 / 400).alias("delay"))
    got = crawl.queued(rows, slot=60).agg(F.sum("starts_at").alias("s"), F.max("starts_at").alias("m"), F.count("*").alias("n")).first()
    k = np.arange(n)
    at, wait = k * 7_919_000 % (n * 5_000), np.round(k % 5 / 400 * S).astype(np.int64)
    order = np.lexsort((k, at))
    total = np.cumsum(wait[order])
    start = total + np.maximum.accumulate(at[order] - total)
    assert (got.s, got.m, got.n) == (int(start.sum()), int(start.max()), n)


@pytest.mark.parametrize("ttl", [1, 7, 3600])
def test_asks(spark, ttl):
    rng = random.Random(ttl)
    rows = [(rng.choice("ab"), rng.randint(0, 40_000) * S // 16) for _ in range(800)] + [("c", None)]
    want = []
    for host in "ab":
        until = None
        for t in sorted(t for h, t in rows if h == host):
            if until is None or t >= until:
                want.append((host, t))
                until = t + ttl * S
    got = crawl.policy_asks(spark.createDataFrame(rows, "host string, at long"), ttl=ttl)
    assert sorted(map(tuple, got.collect())) == sorted(want)
