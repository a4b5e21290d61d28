"""Saved records: compare-and-set, caps, and the fold against a step-by-step version."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from factloom.sources import store

DAY = datetime(2024, 1, 1)
SAVES = "scope string, ord long, key string, value string, generated_at timestamp, expires_at timestamp, expected long"
NOW = datetime(2024, 1, 2)


def save(spark, *rows):
    """(scope, ord, key, value, expected), all with the same dates."""
    return spark.createDataFrame([(s, o, k, v, DAY, DAY + timedelta(days=7), e) for s, o, k, v, e in rows], SAVES)


def held(own):
    return sorted((r.scope, r.key, r.value, r.revision) for r in own.records().collect())


def outcomes(df):
    return [(r.scope, r.ord, r.outcome, r.revision) for r in df.orderBy("scope", "ord").collect()]


def test_two_writers_one_wins(spark, tmp_path):
    own = store.Store(spark, f"file://{tmp_path}/s")
    assert outcomes(own.save(save(spark, ("u", 1, "a", "one", 0), ("u", 2, "b", "x", None)), NOW)) == [("u", 1, "saved", 1), ("u", 2, "saved", 1)]
    # Both decide on version 1; the second finds version 2 there and decides again.
    first = save(spark, ("u", 1, "a", "two", 1), ("v", 1, "c", "y", 0))
    late = store.Store(spark, f"file://{tmp_path}/s")
    attempts = late.attempts(save(spark, ("u", 1, "a", "three", 1), ("u", 2, "d", "z", 0)), NOW)
    version, _, after = next(attempts)
    assert version == 1
    assert outcomes(own.save(first, NOW)) == [("u", 1, "saved", 2), ("v", 1, "saved", 1)]
    assert not late.publish(after, version)
    version, decided, after = next(attempts)
    assert version == 2 and outcomes(decided) == [("u", 1, "changed", 2), ("u", 2, "saved", 1)]
    assert late.publish(after, version)
    assert held(own) == [("u", "a", "two", 2), ("u", "b", "x", 1), ("u", "d", "z", 1), ("v", "c", "y", 1)]
    assert sorted(r.key for r in own.listed("u").collect()) == ["a", "b", "d"]


def test_many_writers_at_once(spark, tmp_path):
    """Every save of every writer is in the end there, once."""
    from concurrent.futures import ThreadPoolExecutor

    def write(n):
        own = store.Store(spark, f"file://{tmp_path}/s")
        return outcomes(own.save(save(spark, (f"u{n}", 1, "k", str(n), 0), ("all", n, f"k{n}", "x", 0)), NOW, tries=40))

    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(write, range(6)))
    assert all(o[2] == "saved" for out in done for o in out)
    own = store.Store(spark, f"file://{tmp_path}/s")
    assert own.version() == 6 and held(own) == sorted([(f"u{n}", "k", str(n), 1) for n in range(6)] + [("all", f"k{n}", "x", 1) for n in range(6)])


def test_caps_and_dates(spark, tmp_path):
    own = store.Store(spark, f"file://{tmp_path}/s", most_bytes=400, most_records=3)
    got = outcomes(own.save(save(spark, ("u", 1, "a", "x" * 50, 0), ("u", 2, "b", "x", 0), ("u", 3, "a", "y" * 150, 1), ("u", 4, "c", "z" * 198, 0), ("u", 5, "c", "z", 0), ("u", 6, "d", "z", 0), ("u", 7, None, "z", 0), ("u", 8, "a", "q", 1)), NOW))
    assert [(o, r) for _, _, o, r in got] == [("saved", 1), ("saved", 1), ("saved", 2), ("full", 0), ("saved", 1), ("full", 0), ("changed", 0), ("changed", 2)]
    # Other dates are another copy; expired records make room.
    other = save(spark, ("u", 1, "b", "n", 1)).withColumn("generated_at", F.lit("2023-12-31").cast("timestamp"))
    assert outcomes(own.save(other, NOW)) == [("u", 1, "changed", 1)]
    late = datetime(2024, 2, 1)
    assert outcomes(own.save(save(spark, ("u", 1, "e", "n", 0)), late)) == [("u", 1, "saved", 1)]
    assert [k for _, k, _, _ in held(own)] == ["e"]
    assert own.save(save(spark).limit(0), NOW).count() == 0


def test_sizes_are_of_utf16(spark):
    df = spark.createDataFrame([("a", "b"), ("é", "😀x"), ("", "")], "k string, v string")
    assert [r[0] for r in df.select(store.utf16_bytes(F.col("k"), F.col("v"))).collect()] == [len((k + v).encode("utf-16-le")) for k, v in (("a", "b"), ("é", "😀x"), ("", ""))]


@pytest.mark.parametrize("seed", range(3))
def test_decisions_in_order(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("uv"), n, rng.choice("abcdefg"), "x" * rng.randint(0, 40), rng.randint(0, 2)) for n in range(200)]
    state, want = {}, []
    for s, o, k, v, e in rows:
        mine = {key: x for (scope, key), x in state.items() if scope == s}
        revision = mine.get(k, (0, 0))[0]
        total = sum(x[1] for key, x in mine.items() if key != k) + 2 * (len(k) + len(v))
        out = "changed" if e != revision else "full" if (k not in mine and len(mine) >= 5) or total > 250 else "saved"
        if out == "saved":
            revision += 1
            state[s, k] = (revision, 2 * (len(k) + len(v)))
        want.append((s, o, out, revision))
    got = store.decided(spark.createDataFrame([], store.RECORDS), save(spark, *rows), most_bytes=250, most_records=5)
    assert outcomes(got) == sorted(want)
