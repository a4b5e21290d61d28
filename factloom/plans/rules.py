"""Queries of the smaller rules: projections, settings, lifecycles, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from factloom.functions import arrays, ids, numbers, text, urls
from factloom.operators import dedup, jobs, joins, report, select
from factloom.plans.evidence import values
from factloom.sources import codec, crawl, pages
from factloom.sources.tables import artifacts, scratch, table
from factloom.streaming import jobs as streams


def coverage_notes(spark, sf_dir):
    """Notes on labelled documents: toxic, poor, both or none."""
    rows = table(spark, sf_dir, "labels")
    note = text.note(F.when(F.col("toxic") == 1, "Toxic."), F.when(F.col("quality") == 0, "Poor."))
    return rows.select("doc_id", note.alias("note"))


COVERAGE_NOTES = "select doc_id, nullif(concat_ws(' ', case when toxic = 1 then 'Toxic.' end, case when quality = 0 then 'Poor.' end), '') as note from labels"


def search_queries(spark, sf_dir):
    """One query for each host of the pages, in order, limited to a date."""
    own = table(spark, sf_dir, "pages").select(urls.url_host(F.col("url")).alias("host")).where("host is not null").distinct()
    return own.select(F.explode(urls.search_query(F.array("host"), F.lit("Contoso"), F.lit("2024-01-01").cast("date"))).alias("query"))


SEARCH_QUERIES = """select distinct 'site:' || regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) || ' "Contoso" after:2024-01-01' as query from pages"""


def source_markers(spark, sf_dir):
    """Numbers of the sources of each language's report, by id."""
    own = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("report_id"), F.col("source").alias("source_id")).agg(F.min("doc_id").alias("ord"))
    return report.source_markers(own).select("report_id", "source_id", F.col("marker").cast("long").alias("marker"))


SOURCE_MARKERS = "select lang as report_id, source as source_id, row_number() over (partition by lang order by min(doc_id)) as marker from documents group by lang, source"


def evidence_join(spark, sf_dir):
    """Citations of all documents' facts with their sources, lost ones too."""
    from factloom.plans.reports import facts

    sources = table(spark, sf_dir, "documents").where("source <> 'src3'").groupBy(F.col("source").alias("source_id")).agg(F.min("doc_id").alias("first_id"))
    return joins.evidence_sources(facts(spark, sf_dir), sources).select("fact_id", F.col("ord").cast("long").alias("ord"), "source_id", "first_id")


EVIDENCE_JOIN = "select 'f' || doc_id as fact_id, 0::bigint as ord, source as source_id, case when source <> 'src3' then min(doc_id) over (partition by source) end as first_id from documents"


def pdf_coverage(spark, sf_dir):
    """Coverage of page texts: users are documents, their events pages, props their texts."""
    own = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), (F.col("event_id") % 300).alias("page"), F.when(F.col("event_id") % 5 != 0, F.col("props")).alias("text"))
    out = pages.pdf_coverage(own)
    return out.select("doc", "pages_total", "pages_processed", "pages_with_text", F.size("pages_without_text").cast("long").alias("pages_without_text"), "pages_omitted")


PDF_COVERAGE = """
with own as (select user_id as doc, event_id % 300 as page, event_id % 5 <> 0 as has from events)
select doc, count(*) as pages_total, count(*) filter (page <= 200) as pages_processed, count(*) filter (page <= 200 and has) as pages_with_text,
       count(*) filter (page <= 200 and not has) as pages_without_text, count(*) filter (page > 200) as pages_omitted from own group by doc"""


def merged_facts(spark, sf_dir):
    """Documents overridden by their labels where there are some."""
    base = table(spark, sf_dir, "documents").select("doc_id", F.lit("document").alias("origin"))
    more = table(spark, sf_dir, "labels").select("doc_id", F.lit("label").alias("origin"))
    return dedup.merged(base, more, ["doc_id"])


MERGED_FACTS = "select doc_id, case when l.doc_id is null then 'document' else 'label' end as origin from documents left join labels l using (doc_id)"


def planned_tasks(spark, sf_dir):
    """Documents as tasks against the caps of their languages."""
    tasks = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("task_id"), numbers.token_estimate(F.col("n_chars")).alias("estimate"))
    limits = values(spark, (("en", 1000), ("de", 600), ("fr", 2000)), "task_id string, input_cap long")
    return jobs.planned(tasks, limits, "estimate").select("doc_id", "code")


PLANNED_TASKS = """
select doc_id, case when (ceil((ceil(n_chars / 4) + 64) * 1.25) + 256) > input_cap then 'input_too_large' end as code
from documents join (values ('en', 1000), ('de', 600), ('fr', 2000)) t(task_id, input_cap) on lang = task_id"""


def purged_rows(spark, sf_dir):
    """Reports and jobs that retention keeps: events of ten days, and of a week."""
    own = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("finished_at"), (F.col("ts") + F.expr("interval 10 days")).alias("expires_at"))
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    reports, done = jobs.purged(own, own, now, F.expr("interval 7 days"))
    return reports.select(F.lit("report").alias("kind"), "event_id").unionByName(done.select(F.lit("job").alias("kind"), "event_id"))


PURGED_ROWS = """
select 'report' as kind, event_id from events where ts + interval 10 days > timestamp '2024-01-20'
union all select 'job', event_id from events where ts + interval 7 days > timestamp '2024-01-20'"""


#: Users are hosts, sign-ups readings of their policy, other events requests; a day passes in half an hour.
CRAWL = "select event_id as request_id, user_id as host, {micros} as t, event_type = 'signup' as reading, case when event_type = 'signup' then event_id % 7 * 90.5 end as delay from {events}"
_MICROS_SPARK, _MICROS_SQL = "cast(floor(unix_micros(cast(ts as timestamp)) / 50) as bigint)", "epoch_us(ts) // 50"


def _crawl(spark, sf_dir):
    rows = spark.sql(CRAWL.replace("{micros}", _MICROS_SPARK), events=table(spark, sf_dir, "events")).withColumn("delay", F.col("delay").cast("double"))
    return rows.where("not reading").select("host", "request_id", F.col("t").alias("at")), rows.where("reading").select("host", F.col("t").alias("read_at"), "delay")


def crawl_times(spark, sf_dir):
    """When each request goes out: the policy that holds for it, or that one must be read, and its place in the host's queue."""
    requests, versions = _crawl(spark, sf_dir)
    own = crawl.policies_at(requests, versions)
    out = crawl.queued(own.select("host", "request_id", "at", F.col("policy.read_at").alias("read_at"), F.col("policy.delay").alias("delay")))
    return out.select("request_id", "host", "read_at", "delay", "starts_at")


_CRAWLED = f"own as ({CRAWL.replace('{micros}', _MICROS_SQL).replace('{events}', 'events')})"
CRAWL_TIMES = f"""
with recursive {_CRAWLED},
version as (select host, t as read_at, max(delay::double) as delay from own where reading group by all),
known as (select r.request_id, r.host, r.t, case when v.read_at > r.t - 3600000000 then v.read_at end as read_at, case when v.read_at > r.t - 3600000000 then v.delay end as delay
  from (select * from own where not reading) r asof left join version v on r.host = v.host and r.t >= v.read_at),
ordered as (select *, row_number() over (partition by host order by t, request_id) as n, round(coalesce(delay, 0) * 1000000)::bigint as wait from known),
queue as (
  select request_id, host, read_at, delay, n, t as starts_at from ordered where n = 1
  union all
  select o.request_id, o.host, o.read_at, o.delay, o.n, greatest(o.t, q.starts_at + o.wait) from queue q join ordered o on o.host = q.host and o.n = q.n + 1)
select request_id, host, read_at, delay, starts_at from queue"""


def policy_asks(spark, sf_dir):
    """When policies are read for the requests that no known version covers: again only once the last reading is an hour old."""
    requests, versions = _crawl(spark, sf_dir)
    return crawl.policy_asks(crawl.policies_at(requests, versions).where("policy is null").select("host", "at")).withColumnRenamed("at", "asked_at")


POLICY_ASKS = f"""
with recursive {_CRAWLED},
open as (select distinct r.host, r.t from (select * from own where not reading) r asof left join (select host, t as read_at from own where reading) v on r.host = v.host and r.t >= v.read_at where v.read_at is null or v.read_at <= r.t - 3600000000),
ask as (
  select host, min(t) as t from open group by host
  union all
  select * from (select a.host, min(o.t) as t from ask a join open o on o.host = a.host and o.t >= a.t + 3600000000 group by a.host))
select host, t as asked_at from ask"""


def report_status(spark, sf_dir):
    """Completed where every part of a source is."""
    own = table(spark, sf_dir, "documents").select("source", F.when(F.col("n_chars") > 20, "complete").otherwise("partial").alias("coverage"))
    return report.status(own, ["source"])


REPORT_STATUS = "select source, case when bool_and(n_chars > 20) then 'completed' else 'partial' end as status from documents group by source"


def typed_artifacts(spark, sf_dir):
    """Conversations as JSON artifacts, read back by their strict schema."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct("role", "turn")).alias("json"))
    return artifacts(own, "role string, turn bigint").select("conv_id", "turn", "value.role", "error")


TYPED_ARTIFACTS = "select conv_id, turn, role, null::varchar as error from conversations"


def report_json(spark, sf_dir):
    """Headers of reports, and their JSON with nulls kept."""
    own = table(spark, sf_dir, "labels").select("doc_id", F.struct("doc_id", F.lit(None).cast("string").alias("note")).alias("r"))
    return own.select("doc_id", F.regexp_replace(codec.pretty_json(F.col("r")), r"\s", "").alias("json"))


REPORT_JSON = """select doc_id, '{"doc_id":' || doc_id || ',"note":null}' as json from labels"""


def document_sections(spark, sf_dir):
    """Turns of conversations under the last system or user text."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") != "assistant", F.length("text").cast("long")).alias("heading"))
    return select.labelled_sections(own, ["conv_id"], "turn", "heading").select("conv_id", "turn", "section")


DOCUMENT_SECTIONS = """
select conv_id, turn, last_value(case when role <> 'assistant' then length(text) end ignore nulls) over (partition by conv_id order by turn rows unbounded preceding) as section from conversations"""


def identifier_filter(spark, sf_dir):
    """Documents whose digests, cut in turn, are ids of reports, hashes or submissions."""
    own = table(spark, sf_dir, "documents").select("doc_id", F.left(F.sha2("text", 256), F.element_at(F.array(F.lit(32), F.lit(64), F.lit(12)), (F.col("doc_id") % 3 + 1).cast("int"))).alias("v"))
    return own.select("doc_id", *[ids.identifier(F.col("v"), k).alias(k) for k in ("report", "hash", "submission")])


IDENTIFIER_FILTER = """
with own as (select doc_id, left(sha256(text), [32, 64, 12][doc_id % 3 + 1]) as v from documents)
select doc_id, regexp_full_match(v, '[0-9a-f]{32}') as report, regexp_full_match(v, '[0-9a-f]{64}') as hash, regexp_full_match(v, '[A-Za-z0-9_-]{16,80}') as submission from own"""


def request_memo(spark, sf_dir):
    """The first request of each host, and the first four distinct event types of each user."""
    pages_ = table(spark, sf_dir, "pages").select("page_id", urls.url_host(F.col("url")).alias("host"))
    first = dedup.keep_first(pages_, ["host"], [F.asc("page_id")]).select(F.lit("host").alias("kind"), F.col("page_id").alias("item"), F.col("host").alias("value"))
    own = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("e"))
    types = F.array_join(arrays.ordered_distinct(F.transform("e", lambda x: x["event_type"]), 4), ",")
    return first.unionByName(own.select(F.lit("user").alias("kind"), F.col("user_id").alias("item"), types.alias("value")))


REQUEST_MEMO = """
select 'host' as kind, min(page_id) as item, host as value from (select page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) as host from pages) group by host
union all
select 'user', user_id, string_agg(event_type, ',' order by first) from (
  select *, row_number() over (partition by user_id order by first) as n from (select user_id, event_type, min(event_id) as first from events group by all)) where n <= 4 group by user_id"""


def stream_submissions(spark, sf_dir):
    """First event of each user and type, as a stream over the event table with bounded state."""
    own = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(own.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out = streams.first_submissions(stream, ["user_id", "event_type"], within="60 days").select("user_id", "event_type")
    return streams.drained(out, f"{scratch(spark)}/{uuid.uuid4().hex}")


STREAM_SUBMISSIONS = "select distinct user_id, event_type from events"

QUERIES = (
    coverage_notes, search_queries, source_markers, evidence_join, 
    pdf_coverage, merged_facts, 
    planned_tasks, purged_rows, crawl_times, policy_asks, report_status,
    typed_artifacts, report_json, document_sections, identifier_filter, request_memo, stream_submissions,
)
