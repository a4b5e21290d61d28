"""Kept documents by rounds against the fold: random graphs, chains, stars, and a scope of a million."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import dedup

SCHEMA = "scope string, ord long, url string, content_hash string"


def same(spark, rows, tmp_path, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(((r.scope or "", r.ord, r.kept_ord) for r in dedup.kept_documents(df, ["scope"]).collect()))
    got = sorted(((r.scope or "", r.ord, r.kept_ord) for r in dedup.kept_in_rounds(df, ["scope"], f"file://{tmp_path}", **more).collect()))
    assert got == want and len(got) == len(rows)


@pytest.mark.parametrize("seed, rounds", [(0, 12), (1, 2), (2, 1)])
def test_random_documents(spark, tmp_path, seed, rounds):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", None]), n, rng.choice([None, *map(str, range(60))]), rng.choice([None, *map(str, range(90))])) for n in rng.sample(range(1000), 400)]
    same(spark, rows, tmp_path, rounds=rounds)


def test_chains_and_stars(spark, tmp_path):
    chain = [("c", n, f"u{n // 2}", f"d{(n + 1) // 2}") for n in range(40)]
    star = [("s", n, "u", f"d{n}") for n in range(30)] + [("s", 100 + n, f"v{n}", f"d{n}") for n in range(30)]
    same(spark, chain + star, tmp_path, rounds=4)
    same(spark, chain[:1], tmp_path)


def test_a_scope_of_a_million(spark, tmp_path):
    """One scope, one URL with a third of the rows: every document gets the first kept one of its URL or content."""
    n = 1_000_000
    mixed = F.col("id") * 7919 % 1_000_003
    docs = spark.range(n).select(F.lit("s").alias("scope"), F.col("id").alias("ord"), F.when(mixed % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), mixed % 150_000)).alias("url"), F.concat(F.lit("d"), F.xxhash64("id") % 200_000).alias("content_hash"))
    got = dedup.kept_in_rounds(docs, ["scope"], f"file://{tmp_path}").cache()
    kept = got.where("kept_ord = ord")
    assert got.count() == n and got.where("kept_ord is null or kept_ord > ord").isEmpty()
    assert kept.groupBy("url").count().where("count > 1").isEmpty() and kept.groupBy("content_hash").count().where("count > 1").isEmpty()
    by = kept.select(F.col("ord").alias("kept_ord"), F.col("url").alias("_u"), F.col("content_hash").alias("_d"))
    assert got.join(by, "kept_ord").where("url = _u or content_hash = _d").count() == n
    got.unpersist()
