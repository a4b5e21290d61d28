"""Report assembly: sections, projections, reference walks, sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.text import excerpt

#: Sections that every report has.
FIXED_SECTIONS = ("section_company", "section_summary", "section_evidence", "section_sources", "section_limitations", "section_announcements")


def sections(spark: SparkSession, opportunities: DataFrame, requested: DataFrame, produced: DataFrame, *, contradictions: DataFrame | None = None) -> DataFrame:
    """``(section_id, kind)``: the fixed ones, contradictions if there are any, one per opportunity, per requested
    and per produced audience."""
    parts = [spark.createDataFrame([(s, "fixed") for s in FIXED_SECTIONS], "section_id string, kind string")]
    if contradictions is not None:
        parts.append(contradictions.limit(1).select(F.lit("section_contradictions").alias("section_id"), F.lit("contradictions").alias("kind")))
    named = lambda df, prefix, c, kind: df.select(F.concat(F.lit(prefix), F.col(c).cast("string")).alias("section_id"), F.lit(kind).alias("kind"))
    parts += [named(opportunities, "section_", "opportunity_id", "opportunity"), named(requested, "section_coverage_", "audience", "coverage"), named(produced, "section_audience_", "audience", "audience")]
    return reduce(DataFrame.unionByName, parts)


def span_rows(spans: DataFrame) -> DataFrame:
    return spans.select("source_id", F.struct("span_id", "text", "page", "section").alias("span"), "ord")


def nested(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Sources with their spans as an ordered list, and the document's text: spans by blank lines."""
    own = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "span_id", "text", "section"))).alias("spans"))
    return own.withColumn("text", F.array_join(F.transform("spans", lambda s: s["text"]), "\n\n"))


def chunk_payload(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    return chunks.join(sources, "source_id").groupBy("source_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("ord", "span_id", "text"))).alias("spans"), F.first("url").alias("url"), F.first("title").alias("title"))


def citations(facts: DataFrame, spans: DataFrame) -> DataFrame:
    """Facts' quotes with page, section and surroundings, each place once."""
    each = facts.select("fact_id", F.posexplode("evidence").alias("ord", "e")).select("fact_id", "ord", "e.span_id", "e.quote")
    own = each.join(spans.select("span_id", "source_id", "page", "section", F.col("text").alias("_t")), "span_id")
    return own.withColumn("excerpt", excerpt(F.col("_t"), F.col("quote"))).drop("_t").dropDuplicates(["source_id", "span_id", "excerpt"])


def reference_paths(kind: T.DataType, names: tuple[str, ...] = ("fact_ids", "baseline_fact_ids")) -> list[list[str]]:
    """Where a nested type holds reference lists: field names, ``*`` for each array level above them."""
    if isinstance(kind, T.ArrayType):
        return [["*", *path] for path in reference_paths(kind.elementType, names)]
    if not isinstance(kind, T.StructType):
        return []
    return [[f.name, *path] for f in kind for path in ([["*"]] if f.name in names else reference_paths(f.dataType, names))]


def references(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Every fact id that a nested artifact refers to: one explode per path of its schema."""
    parts = []
    for first, *path in reference_paths(rows.schema):
        own = rows.select(*keys, F.col(first).alias("x"))
        for step in path:
            own = own.select(*keys, (F.explode("x") if step == "*" else F.col(f"x.{step}")).alias("x"))
        parts.append(own.select(*keys, F.col("x").alias("fact_id")))
    if not parts:
        return rows.select(*keys, F.lit(None).cast("string").alias("fact_id")).limit(0)
    return reduce(DataFrame.unionByName, parts).distinct()


def source_markers(used: DataFrame) -> DataFrame:
    """Numbers of sources, from 1, in order of the report: an ordered list's positions."""
    own = used.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("ord", "source_id"))).alias("l"))
    return own.select("report_id", F.posexplode("l").alias("p", "s")).select("report_id", (F.col("p") + 1).alias("marker"), "s.source_id")


def messages(errors: Column, *, most: int = 12) -> Column:
    """``Source n: text`` lines of an array of structs (number, text), the first few."""
    return F.slice(F.transform(errors, lambda e: F.when(e["number"].isNotNull(), F.concat(F.lit("Source "), e["number"].cast("string"), F.lit(": "), e["text"])).otherwise(e["text"])), 1, most)


def checkpoint_size(spans: DataFrame, links: DataFrame, artifacts: DataFrame, keys: list[str]) -> DataFrame:
    """Bytes that a job's state holds, over its child tables."""
    own = spans.select(*keys, (F.octet_length("text") + F.octet_length("span_id") + 400).cast("long").alias("n"))
    own = own.unionByName(links.select(*keys, F.octet_length("url").cast("long").alias("n"))).unionByName(artifacts.select(*keys, F.octet_length("json").cast("long").alias("n")))
    return own.groupBy(*keys).agg(F.sum("n").alias("bytes"))


def status(audiences: DataFrame, keys: list[str]) -> DataFrame:
    return audiences.groupBy(*keys).agg(F.when(F.bool_and(F.col("coverage") == "complete"), "completed").otherwise("partial").alias("status"))


def job_view(jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """State by job, that of its report first."""
    return jobs.join(reports.select("job_id", F.col("status").alias("_s")), "job_id", "full").withColumn("status", F.coalesce("_s", "state")).drop("_s")
