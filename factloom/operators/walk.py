"""Artifacts of unknown shape: every node of a VARIANT, and the references that it makes."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels that an artifact may have, and names of what holds references to facts.
MAX_DEPTH, REFERENCES = 64, ("fact_ids", "baseline_fact_ids")


def nodes(artifacts: DataFrame, keys: list[str], value: str, folder: str, *, most: int = MAX_DEPTH) -> DataFrame:
    """``(keys, path, name, depth, kind, node)``: every node of the VARIANT ``value``, the root at depth 0.

    ``name`` is the nearest field's, ``path`` as in ``$.a[0].b`` (quoted names are not escaped), ``kind`` the type. One
    explode a level, of objects and arrays only; a level is a table under ``folder``, which all executors share, so work
    is that of the nodes, whatever the shape. A null value has no node; a document deeper than ``most`` is an error, as
    its references would be lost."""
    spark, at = artifacts.sparkSession, f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    kind = F.regexp_extract(F.schema_of_variant("node"), r"\A(\w+)", 1).alias("kind")
    level = artifacts.where(F.col(value).isNotNull()).select(*keys, F.lit("$").alias("path"), F.lit(None).cast("string").alias("name"), F.col(value).alias("node"))
    levels = []
    for depth in range(most + 2):
        own = level.select(*keys, "path", "name", F.lit(depth).alias("depth"), kind, "node")
        own.write.parquet(f"{at}/{depth}")
        own = spark.read.schema(own.schema).parquet(f"{at}/{depth}")
        if own.isEmpty():
            break
        if depth > most:
            raise ValueError(f"an artifact has more than {most} levels")
        levels.append(own)
        names = ", ".join(f"n.`{k}`" for k in keys)
        level = spark.sql(
            f"select {names}, concat(n.path, coalesce(concat('.', e.key), concat('[', e.pos, ']'))) as path, coalesce(e.key, n.name) as name, e.value as node from {{own}} n, lateral variant_explode(n.node) e",
            own=own.where(F.col("kind").isin("OBJECT", "ARRAY")),
        )
    return reduce(DataFrame.unionByName, levels) if levels else own


def references(found: DataFrame, keys: list[str], *, names: tuple[str, ...] = REFERENCES) -> DataFrame:
    """``(keys, fact_id)``: strings in arrays under one of ``names``, at any depth, each once."""
    return found.where(F.col("name").isin(*names) & (F.col("kind") == "STRING")).select(*keys, F.variant_get("node", "$", "string").alias("fact_id")).distinct()


def unknown_references(found: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """References that no fact of the same keys answers."""
    return references(found, keys).join(facts.select(*keys, "fact_id"), [*keys, "fact_id"], "left_anti")
