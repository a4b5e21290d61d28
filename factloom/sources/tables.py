"""Tables in and out: Parquet, JSON artifacts, candidate lists, binary pages."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.jsonshape import json_shape
from factloom.functions.urls import url_host


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    """Files as raw pages ``(url, status, headers, body)``."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("url"), F.lit(200).alias("status"), F.create_map().cast("map<string,string>").alias("headers"), F.col("content").alias("body"))


def artifacts(rows: DataFrame, schema: str, *, json: str = "json") -> DataFrame:
    """Model artifacts ``(job_id, task_key, task_id, json)`` read strictly: ``value`` or ``error``."""
    out = rows.withColumn("error", json_shape(F.col(json), schema))
    return out.withColumn("value", F.when(F.col("error").isNull(), F.from_json(json, schema)))


def requests(rows: DataFrame, *, json: str = "json") -> DataFrame:
    """Requests with a closed schema and the rules on seeds and audiences."""
    schema = "seeds array<struct<url:string,purpose:string>>, audiences array<string>, seller_context string"
    own = artifacts(rows, schema, json=json)
    homes = F.size(F.filter("value.seeds", lambda s: s["purpose"] == "homepage"))
    rule = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(~F.size("value.seeds").between(1, 6), "seed_count")
        .when(homes != 1, "one_homepage")
        .when(F.size(F.array_distinct("value.seeds.url")) != F.size("value.seeds"), "repeated_seed")
        .when(F.size(F.array_distinct("value.audiences")) != F.size("value.audiences"), "repeated_audience")
    )
    return own.withColumn("error", rule)


def scoped_candidates(candidates: DataFrame, hosts: DataFrame, *, group: str = "group_id") -> DataFrame:
    """Search results of which every host is approved; one outside drops its whole result."""
    known = hosts.select(F.col("host").alias("_h"), F.lit(True).alias("_known")).distinct()
    marked = candidates.withColumn("_h", url_host(F.col("url"))).join(known, "_h", "left")
    bad = marked.where("_known is null").select(group).distinct()
    return candidates.join(bad, group, "left_anti")


def scratch(spark: SparkSession) -> str:
    """The folder for streams' outputs and checkpoints: ``spark.checkpoint.dir``, which all executors share.
    Only a local session may have it unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="factloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root
