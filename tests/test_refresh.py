"""Incremental refresh: nothing twice, only the closure of a change, and all at once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factloom.operators import refresh

TASKS = "task_key string, stage string, source_hash string, text string"
EDGES = [("x1", "d1"), ("x2", "d1"), ("x3", "d2"), ("d1", "s"), ("d2", "s")]


def rows(*texts):
    return [(f"x{k + 1}", "extract", t, t) for k, t in enumerate(texts)] + [("d1", "dossier", None, None), ("d2", "dossier", None, None), ("s", "strategy", None, None)]


@pytest.fixture
def run(spark, tmp_path):
    store = refresh.artifacts(spark, f"file://{tmp_path}/a")
    joined = lambda df: df.select("task_key", F.array_join(F.array_sort(F.map_values("inputs")), "+").alias("value"))
    stages = {"extract": lambda df: df.select("task_key", F.upper(F.split_part("text", F.lit("#"), F.lit(1))).alias("value")), "dossier": joined, "strategy": joined}

    def go(*texts, edges=EDGES, **more):
        out = refresh.refresh(store, spark.createDataFrame(rows(*texts), TASKS), spark.createDataFrame(edges, "src string, dst string"), stages | more)
        return sorted(r.task_key for r in out.collect() if not r.reused), {r.task_key: r.value for r in store.records().collect()}

    go.store = store
    return go


def test_refresh(run):
    assert run("a", "b", "c") == (["d1", "d2", "s", "x1", "x2", "x3"], {"x1": "A", "x2": "B", "x3": "C", "d1": "A+B", "d2": "C", "s": "A+B+C"})
    assert run("a", "b", "c")[0] == [] and run.store.version() == 1
    computed, values = run("a", "z", "c")
    assert computed == ["d1", "s", "x2"] and values["s"] == "A+Z+C" and run.store.version() == 2
    # A source that changed without changing its artifact stops there.
    assert run("a", "z#note", "c")[0] == ["x2"]
    # A task that is gone takes its artifact along.
    computed, values = run("a", "z#note")
    assert computed == ["d2", "s"] and "x3" not in values and values["d2"] == ""


def test_a_failed_refresh_changes_nothing(run):
    run("a", "b", "c")
    with pytest.raises(Exception, match="no artifact for d1"):
        run("q", "b", "c", dossier=lambda df: df.where("task_key <> 'd1'").select("task_key", F.lit("v").alias("value")))
    assert run.store.version() == 1
    assert run("q", "b", "c")[0] == ["d1", "s", "x1"]
