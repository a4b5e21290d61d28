"""Incremental refresh of artifacts: what changed inputs reach is computed again, all else is reused.

Artifacts are a versioned table. A task's input is the fingerprint of its own
source and of the artifacts that it builds on; a task whose input is as it was
keeps its artifact. Stages run in order, so an artifact that comes out as before
stops the change there. New artifacts are seen by readers only when all stages
are done, all at once, as the next version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.sources.store import Changed, Versions

ARTIFACTS = "task_key string, stage string, input_hash string, value string, output_hash string"


def artifacts(spark, folder: str) -> Versions:
    return Versions(spark, folder, ARTIFACTS)


def refresh(store: Versions, tasks: DataFrame, edges: DataFrame, stages: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Brings the artifacts of ``tasks(task_key, stage, source_hash, …)`` up to date; gives ``(task_key, stage, reused)``.

    ``edges(src, dst)``: the artifact of ``dst`` is built on that of ``src``, a task of an earlier stage. ``stages``, in
    order: what computes a stage's tasks, from ``tasks``' columns and ``inputs``, the values built on by key, to
    ``(task_key, value)``, one row each. Null source hashes are a source like any other. Tasks that are gone lose their
    artifact; one without a value is an error. The state of the stages so far is a written table."""
    spark = tasks.sparkSession
    version = store.version()
    before = store.records(version).select("task_key", "input_hash", F.col("value").alias("_value"), F.col("output_hash").alias("_hash"))
    ready = store.records(0).withColumn("reused", F.lit(True))
    for turn, (stage, compute) in enumerate(stages.items()):
        built_on = edges.select(F.col("src").alias("task_key"), "dst").join(ready, "task_key").groupBy(F.col("dst").alias("task_key")).agg(F.array_sort(F.collect_list(F.struct("task_key", "output_hash"))).alias("_on"), F.map_from_entries(F.collect_list(F.struct("task_key", "value"))).alias("inputs"))
        own = tasks.where(F.col("stage") == stage).join(built_on, "task_key", "left").withColumn("inputs", F.coalesce("inputs", F.create_map().cast("map<string,string>")))
        own = own.withColumn("input_hash", F.sha2(F.to_json(F.struct("source_hash", "_on")), 256))
        known = own.join(before, ["task_key", "input_hash"], "left")
        made = compute(known.where("_hash is null").drop("_on", "_value", "_hash")).select("task_key", "value")
        new = known.where("_hash is null").select("task_key", "stage", "input_hash").join(made, "task_key", "left")
        lost = F.raise_error(F.concat(F.lit("no artifact for "), F.col("task_key"))).cast("string")
        new = new.withColumn("value", F.when(F.col("value").isNull(), lost).otherwise(F.col("value"))).withColumn("output_hash", F.sha2("value", 256))
        kept = known.where("_hash is not null").select("task_key", "stage", "input_hash", F.col("_value").alias("value"), F.col("_hash").alias("output_hash"))
        done = kept.withColumn("reused", F.lit(True)).unionByName(new.withColumn("reused", F.lit(False)))
        at = f"{store.folder}/stages/{version}-{turn}"
        ready.unionByName(done).write.mode("overwrite").parquet(at)
        ready = spark.read.schema(ready.schema).parquet(at)
    if ready.where("not reused").isEmpty() and ready.count() == before.count():
        return ready.select("task_key", "stage", "reused")
    if not store.publish(ready, version):
        raise Changed("another refresh came first")
    return ready.select("task_key", "stage", "reused")
