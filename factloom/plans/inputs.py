"""Queries of the smaller rules over whole test tables: dates, headers, settings, jobs, retention, requests.

As in ``reports``, a derived table is one SELECT that Spark and DuckDB both read.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib

import pandas as pd
from pyspark.sql import functions as F

from factloom.functions import dates, ids, jsonshape, numbers, quotes, text, urls
from factloom.operators import dedup, evidence, gates, jobs, joins, report
from factloom.plans.reports import derived, twin
from factloom.sources import codec, pages
from factloom.sources.tables import raw_files, requests, scratch, table
from factloom.streaming import jobs as streams

NOW = "2024-01-20 00:00:00"


def dates_in_text(spark, sf_dir):
    """Dates in prose: each event's day as a name, as an ISO date, and an impossible one."""
    day = F.date_format("ts", "MMMM d, yyyy")
    other = F.concat(F.date_format("ts", "d"), F.lit("th "), F.date_format("ts", "MMM yyyy"))
    prose = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("On "), day)).when(F.col("event_id") % 3 == 1, F.concat(F.lit("the "), other, F.lit(", not 31 June 2024"))).otherwise(F.concat(F.lit("At "), F.date_format("ts", "yyyy-MM-dd"), F.lit("T10:00 or 2024-02-31")))
    out = table(spark, sf_dir, "events").select("event_id", F.explode(dates.dates_in_text(prose)).alias("d"))
    return out.select("event_id", F.col("d").cast("string").alias("d"))


DATES_IN_TEXT = "select event_id, cast(ts::date as varchar) as d from events"


def strict_dates(spark, sf_dir):
    """Dates of publication as pages write them: plain, with a time and offset, impossible, and in other forms."""
    own = derived(spark, sf_dir, STAMPS)
    return own.select("event_id", dates.strict_date(F.col("v")).cast("string").alias("d"))


STAMPS = """
select event_id, d, case event_id % 6 when 0 then d when 1 then d || 'T23:30:00-05:00' when 2 then substring(d, 1, 8) || '32' when 3 then substring(d, 9, 2) || '.' || substring(d, 6, 2) || '.2024'
  when 4 then ' ' || d || ' ' else d || 'T25:00:00Z' end as v from (select event_id, substring(cast(ts as string), 1, 10) as d from {events}) t"""
STRICT_DATES = f"""
select event_id, case when regexp_full_match(trim(v), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then cast(try_cast(trim(v) as date) as varchar)
  when regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T([01][0-9]|2[0-3]):.*') then left(v, 10) end as d from ({twin(STAMPS)})"""


def publication_resolution(spark, sf_dir):
    """Which date a page, its verdict and its quotes agree on: users are pages, their events what is said of them."""
    own = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("event_type") == "error", F.col("ts").cast("date").cast("string")))).alias("visible"),
        F.min(F.when(F.col("event_type") == "signup", F.col("ts").cast("date"))).alias("meta"),
        F.min(F.when(F.col("event_type").isin("signup", "view"), F.col("ts").cast("date"))).alias("proposed"),
    )
    word = F.element_at(F.array(F.lit("Published "), F.lit("Updated "), F.lit("Posted and updated ")), (F.col("user_id") % 3 + 1).cast("int"))
    found = dates.publication_date(F.col("user_id") % 7 == 0, F.col("visible"), F.col("meta"), F.col("user_id") % 5 == 0, F.col("proposed"), F.array(F.concat(word, F.coalesce(F.col("proposed").cast("string"), F.lit("x")))))
    return own.select("user_id", found.cast("string").alias("d"))


PUBLICATION_RESOLUTION = """
with own as (select user_id, count(distinct case when event_type = 'error' then ts::date end) as visible, min(case when event_type = 'signup' then ts::date end) as meta,
  min(case when event_type in ('signup', 'view') then ts::date end) as proposed from events group by user_id),
page as (select *, case when user_id % 5 <> 0 then meta end as own_date from own)
select user_id, cast(case when user_id % 7 = 0 or visible > 1 then null when own_date is not null then case when proposed is null or proposed = own_date then own_date end
  when proposed is not null and user_id % 3 <> 1 then proposed end as varchar) as d from page"""


def news_support(spark, sf_dir):
    """Evidence that stands for a news item: conversations are items, their turns its quotes."""
    rows = derived(spark, sf_dir, NEWS)
    own = F.struct(F.col("span_id"), F.col("quote"))
    part = lambda k: F.array_sort(F.collect_list(F.when(F.col("turn") % 4 == k, F.struct("turn", own.alias("e")))))
    lists = rows.groupBy("source_id").agg(*[part(k).alias(f"p{k}") for k in range(3)])
    field = lambda c: F.transform(c, lambda x: x["e"])
    verdicts = lists.select("source_id", field("p0").alias("evidence"), field("p1").alias("executive_evidence"), F.lit("2024-01-05").alias("published_date"), field("p2").alias("date_evidence"))
    spans = rows.where("turn % 4 = 3").select("source_id", "span_id", F.col("quote").alias("text"), (F.col("turn") % 8 == 3).alias("is_publication"))
    return evidence.news_support(verdicts, spans).select("source_id", "span_id", F.sha2("quote", 256).alias("quote"), F.col("kind").cast("long").alias("kind"))


NEWS = "select 'c' || cast(conv_id as string) as source_id, turn, 's' || cast(turn % 4 as string) as span_id, coalesce(text, '') || case when turn % 8 = 2 then ' on January 5, 2024' else '' end as quote from {conversations}"
NEWS_SUPPORT = f"""
with own as ({twin(NEWS)}),
kept as (
  select source_id, span_id, quote, 0 as kind from (select *, row_number() over (partition by source_id order by turn) as n from own where turn % 4 = 0) where n = 1
  union all select source_id, span_id, quote, 1 from own where turn % 4 = 1
  union all select source_id, span_id, quote, 2 from own where turn % 8 = 2
  union all select source_id, span_id, quote, 3 from own where turn % 8 = 3)
select source_id, span_id, sha256(quote) as quote, min(kind)::bigint as kind from kept group by source_id, span_id, kept.quote"""


def first_texts(spark, sf_dir):
    """The first that is not blank of three fields of a claim."""
    rows = derived(spark, sf_dir, FIELDS)
    return rows.select("conv_id", "turn", F.sha2(text.first_text(F.col("a"), F.col("b"), F.col("c")), 256).alias("claim"))


FIELDS = "select conv_id, turn, case when turn % 3 = 0 then ' ' when turn % 3 = 1 then null else ' ' || role || ' ' end as a, case when conv_id % 2 = 0 then '' else text end as b, case when conv_id % 5 = 0 then null else role end as c from {conversations}"
FIRST_TEXTS = f"select conv_id, turn, sha256(coalesce(nullif(trim(a), ''), nullif(trim(b), ''), nullif(trim(c), ''))) as claim from ({twin(FIELDS)})"


def names_and_placeholders(spark, sf_dir):
    """Customers' names as vendor keys, segments as stage names, stand-ins for secrets, talk lines."""
    rows = derived(spark, sf_dir, NAMED)
    return rows.select("c_custkey", text.vendor_key(F.col("v")).alias("vendor"), text.stage_name(F.col("s")).alias("stage"), text.placeholder(F.col("p")).alias("stand_in"), text.talk_line(F.col("v")).alias("line"))


NAMED = """
select c_custkey, ' ' || c_name || '_' || c_mktsegment || '  - x' as v, case when c_custkey % 2 = 0 then lower(c_mktsegment) else c_mktsegment end as s,
  case c_custkey % 5 when 0 then ' ChangeMe' when 1 then 'your-key' when 2 then '<secret>' when 3 then 'todo later' else c_name end as p from {customer}"""
NAMES_AND_PLACEHOLDERS = f"""
select c_custkey, lower(regexp_replace(trim(v), '[\\s_-]+', '', 'g')) as vendor, case when regexp_full_match(s, '[a-z][a-z0-9_]{{0,63}}') then s else 'unknown' end as stage,
  c_custkey % 5 in (0, 1, 2) as stand_in, lower(trim(regexp_replace(v, '\\s+', ' ', 'g'))) as line from ({twin(NAMED)})"""


def retry_waits(spark, sf_dir):
    """Seconds to wait from each event's headers, and between attempts."""
    header = F.when(F.col("event_id") % 4 == 1, F.col("user_id").cast("string")).when(F.col("event_id") % 4 == 2, F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).when(F.col("event_id") % 4 == 3, "soon")
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, (F.col("user_id") * 10).cast("string")).alias("ms"), header.alias("v"), (F.col("event_id") % 6).alias("n"))
    wait = dates.retry_after(F.col("ms"), F.col("v"), F.lit(NOW).cast("timestamp"))
    return rows.select("event_id", wait.alias("wait"), numbers.retry_delay(F.col("v").try_cast("double"), F.col("n")).alias("delay"))


RETRY_WAITS = f"""
select event_id, greatest(coalesce(case event_id % 4 when 0 then user_id * 10 / 1000.0 when 1 then user_id when 2 then (epoch_us(date_trunc('second', ts)) - epoch_us(timestamp '{NOW}')) / 1e6 end, 0.0), 0.0)::double as wait,
  (case when event_id % 4 = 1 then user_id else least(pow(2.0, event_id % 6), 8.0) end)::double as delay from events"""


def message_lines(spark, sf_dir):
    """The first lines of a conversation's errors with their sources, and of its distinct error paths."""
    own = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("l"))
    said = F.transform("l", lambda x: F.struct(F.when(x["turn"] % 3 != 0, x["turn"].cast("int")).alias("number"), x["role"].alias("text")))
    paths = F.transform("l", lambda x: F.struct(F.array(F.lit("t"), (x["turn"] % 2).cast("string")).alias("loc"), x["role"].alias("kind")))
    return own.select("conv_id", F.array_join(report.messages(said), "|").alias("messages"), F.array_join(jsonshape.error_list(paths), "|").alias("errors"))


MESSAGE_LINES = """
with own as (select conv_id, role, turn, row_number() over (partition by conv_id order by turn, role) as n from conversations),
path as (select conv_id, 't.' || turn % 2 || ': ' || role as e, min(n) as n from own group by all),
ranked as (select *, row_number() over (partition by conv_id order by n) as k from path)
select conv_id, string_agg(case when turn % 3 <> 0 then 'Source ' || turn || ': ' else '' end || role, '|' order by n) filter (n <= 12) as messages,
  (select string_agg(e, '|' order by r.n) from ranked r where r.conv_id = own.conv_id and k <= 8) as errors from own group by conv_id"""


def audience_jobs(spark, sf_dir):
    """One job for each audience (segment) and nation, less those that have customers of that nation in debt."""
    rows = table(spark, sf_dir, "customer")
    audiences = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    payload = rows.select(F.col("c_nationkey").alias("job")).distinct()
    done = rows.where("c_custkey % 50 = 0").select(F.col("c_mktsegment").alias("audience")).where("audience in ('BUILDING', 'MACHINERY')").distinct()
    return joins.jobs_by_audience(payload, audiences, done).select("job", "audience")


AUDIENCE_JOBS = """
select job, audience from (select distinct c_nationkey as job from customer), (values ('AUTOMOBILE'), ('BUILDING'), ('FURNITURE'), ('HOUSEHOLD'), ('MACHINERY')) a(audience)
where audience not in (select c_mktsegment from customer where c_custkey % 50 = 0 and c_mktsegment in ('BUILDING', 'MACHINERY'))"""


def resolved_gaps(spark, sf_dir):
    """Gaps (customers' notes) that are still open once their names' owners have succeeded."""
    gaps = derived(spark, sf_dir, "select case when c_custkey % 4 = 0 then 'facts' else 'audience' end as area, c_name || ': ' || c_mktsegment as detail, c_custkey from {customer}")
    done = derived(spark, sf_dir, "select case when c_custkey % 2 = 0 then c_name else substring(c_name, 1, 17) end as name from {customer} where c_custkey % 30 in (3, 10)")
    return dedup.without_resolved(gaps, done, "audience").select("c_custkey")


RESOLVED_GAPS = """
with done as (select case when c_custkey % 2 = 0 then c_name else substring(c_name, 1, 17) end as name from customer where c_custkey % 30 in (3, 10))
select c_custkey from customer c where c_custkey % 4 = 0 or not exists (select 1 from done where starts_with(c_name || ': ' || c_mktsegment, name))"""


def remaining_budget(spark, sf_dir):
    """What the tasks (events) of each job (user) that are still to come need."""
    plan = derived(spark, sf_dir, "select user_id as job_id, cast(event_id as string) as task_key, event_type as task_id from {events}")
    done = derived(spark, sf_dir, "select cast(event_id as string) as task_key from {events} where event_id % 3 = 0")
    allowance = derived(spark, sf_dir, ALLOWANCE)
    return jobs.remaining(plan, done, allowance)


ALLOWANCE = "select event_type as task_id, cast(1 as bigint) as calls, cast(length(event_type) * 100 as bigint) as input_tokens, cast(ascii(event_type) as bigint) as output_tokens, cast(count(*) % 5 as bigint) as tool_calls from {events} group by event_type"
REMAINING_BUDGET = f"""
select user_id as job_id, sum(calls)::bigint as calls, sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens, sum(tool_calls)::bigint as tool_calls
from events join ({twin(ALLOWANCE)}) a on a.task_id = event_type where event_id % 3 <> 0 group by user_id"""


def promoted_attempts(spark, sf_dir):
    """The attempt that counts for each user and type: the last valid one, else the last."""
    rows = derived(spark, sf_dir, "select user_id, event_type, event_id as attempt, event_id % 4 = 1 as valid, props as value from {events}")
    return jobs.promoted(rows, ["user_id", "event_type"]).select("user_id", "event_type", "attempt")


PROMOTED_ATTEMPTS = "select user_id, event_type, arg_max(event_id, ((event_id % 4 = 1)::int, event_id)) as attempt from events group by all"


def retryable_jobs(spark, sf_dir):
    """Failed jobs (users whose last event is no purchase) worth another try."""
    last = jobs.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_type", [F.col("event_id")])
    own = last.select(F.col("user_id").alias("job_id"), F.when(F.col("event_type") == "purchase", "completed").otherwise("failed").alias("state"))
    failures = derived(spark, sf_dir, "select user_id as job_id, event_id % 50 <> 7 as transient from {events}")
    spent = derived(spark, sf_dir, "select user_id as job_id, count(*) as calls from {events} group by user_id")
    return jobs.retryable(own, failures, spent, calls=90).select("job_id")


RETRYABLE_JOBS = "select user_id as job_id from events group by user_id having arg_max(event_type, event_id) <> 'purchase' and bool_and(event_id % 50 <> 7) and count(*) < 90"


def restored_reports(spark, sf_dir):
    """Cached reports (events) that come back, never for longer than they had."""
    cached = table(spark, sf_dir, "events").select(F.col("event_id").alias("report_id"), (F.col("ts") + F.expr("interval 10 days")).cast("timestamp").alias("expires_at"))
    present = cached.where("report_id % 5 = 0").select("report_id")
    out = jobs.restored(cached, present, F.lit(NOW).cast("timestamp"), F.expr("interval 100 hours"))
    return out.select("report_id", F.unix_micros("expires_at").alias("expires"))


RESTORED_REPORTS = f"select event_id as report_id, least(epoch_us(timestamp '{NOW}' + interval 100 hours), epoch_us(ts + interval 10 days)) as expires from events where event_id % 5 <> 0"


def swept_store(spark, sf_dir):
    """A store (events by user) after one account's broken records have gone."""
    rows = derived(spark, sf_dir, STORE)
    return jobs.swept(rows, "u13").select("event_id")


STORE = "select event_id, 'u' || cast(user_id as string) as namespace, case event_id % 4 when 0 then 'ok' when 1 then 'expired' when 2 then 'invalid' else 'clock' end as status from {events}"
SWEPT_STORE = f"select event_id from ({twin(STORE)}) where namespace <> 'u13' or status in ('ok', 'clock')"


def usage_gate(spark, sf_dir):
    """Usage records that cannot be."""
    rows = derived(spark, sf_dir, USAGE)
    return gates.usage(rows, ["event_id"])


USAGE = "select event_id, case when event_id % 11 = 0 then -1 else 1 end as calls, case when event_id % 7 = 3 then null else event_id end as input_tokens, user_id - 2 as output_tokens, 0 as tool_calls from {events}"
USAGE_GATE = f"""
with own as ({twin(USAGE)}) select event_id, 'calls:negative' as code from own where calls < 0 union all select event_id, 'input_tokens:negative' from own where input_tokens is null
union all select event_id, 'output_tokens:negative' from own where output_tokens < 0"""


def resource_fit(spark, sf_dir):
    """Which reservations (events) are within their users' allowances, in all four components."""
    rows = derived(spark, sf_dir, FIT)
    four = lambda p: F.struct(*[F.col(f"{p}{k}").alias(r) for k, r in enumerate(jobs.RESOURCES)]).alias(p)
    return rows.select("event_id", four("a"), four("b")).select("event_id", jobs.fits("a", "b").alias("fits"))


FIT = "select event_id, 1 as a0, event_id % 100 as a1, event_id % 7 as a2, event_id % 3 as a3, 1 as b0, user_id * 4 as b1, 5 as b2, user_id % 4 as b3 from {events}"
RESOURCE_FIT = f"select event_id, a0 <= b0 and a1 <= b1 and a2 <= b2 and a3 <= b3 as fits from ({twin(FIT)})"


def ledger_replay(spark, sf_dir):
    """Reservations and settlements of users replayed; a refusal closes the ledger."""
    rows = derived(spark, sf_dir, LEDGER)
    out = jobs.ledger(rows, ["user_id"], {"calls": 1000, "input_tokens": 900, "output_tokens": 10_000, "tool_calls": 1000})
    return out.select("user_id", "ord", "accepted", "spent_tokens", "in_flight_tokens")


LEDGER = """
select user_id, ord, case when ord % 3 = 0 then 'settle' else 'reserve' end as kind, cast(case when ord % 3 = 0 then ord - 1 else ord end as string) as key,
  cast(1 as bigint) as calls, cast(floor(coalesce(value, 0)) as bigint) % 100 as input_tokens, cast(10 as bigint) as output_tokens, cast(0 as bigint) as tool_calls
from (select user_id, value, row_number() over (partition by user_id order by event_id) as ord from {events}) t"""
LEDGER_REPLAY = f"""
with recursive own as ({twin(LEDGER)}),
fold as (
  select user_id, 0::bigint as ord, false as shut, 0::bigint as spent, 0::bigint as flight, map {{}}::map(varchar, bigint) as held, false as ok from (select distinct user_id from events)
  union all
  select user_id, ord, shut, spent, flight, held, ok from (
    select o.user_id, o.ord,
      case when o.kind = 'reserve' then not f.shut and f.spent + f.flight + o.input_tokens <= 900 and 10 * (map_entries(f.held).len() + 1) <= 10000 else map_contains(f.held, o.key) end as ok,
      f.shut or (o.kind = 'reserve' and not (not f.shut and f.spent + f.flight + o.input_tokens <= 900)) as shut,
      case when o.kind = 'settle' and map_contains(f.held, o.key) then f.spent + o.input_tokens else f.spent end as spent,
      case when o.kind = 'reserve' and not f.shut and f.spent + f.flight + o.input_tokens <= 900 then f.flight + o.input_tokens
           when o.kind = 'settle' and map_contains(f.held, o.key) then f.flight - map_extract_value(f.held, o.key) else f.flight end as flight,
      case when o.kind = 'reserve' and not f.shut and f.spent + f.flight + o.input_tokens <= 900 then map_concat(f.held, map([o.key], [o.input_tokens]))
           when o.kind = 'settle' then map_from_entries(list_filter(map_entries(f.held), lambda e: e.key <> o.key)) else f.held end as held
    from fold f join own o on o.user_id = f.user_id and o.ord = f.ord + 1))
select user_id, ord, ok as accepted, spent as spent_tokens, flight as in_flight_tokens from fold where ord > 0"""


def invalidate_closure(spark, sf_dir):
    """What changes downstream of some nations: a nation feeds the two nations of twice its key, up to 24."""
    edges = derived(spark, sf_dir, EDGES)
    changed = derived(spark, sf_dir, "select distinct cast(c_nationkey as bigint) as node from {customer} where c_nationkey in (1, 5)")
    return jobs.invalidated(changed, edges).select("node", F.col("depth").cast("long").alias("depth"))


EDGES = "select distinct cast(c_nationkey as bigint) as src, c_nationkey * 2 + c_custkey % 2 as dst from {customer} where c_nationkey > 0 and c_nationkey * 2 + 1 < 25"
INVALIDATE_CLOSURE = f"""
with recursive edge as ({twin(EDGES)}), reach(node, depth) as (
  select distinct c_nationkey, 0::bigint from customer where c_nationkey in (1, 5) union all select dst, depth + 1 from reach join edge on src = node)
select node, min(depth) as depth from reach group by node"""


def job_lifecycle(spark, sf_dir):
    """Job states (users) after all their events."""
    rows = derived(spark, sf_dir, LIFE).withColumn("ts", F.col("ord"))
    return jobs.lifecycle(rows)


LIFE = """
select user_id as job_id, event_id as ord, case event_type when 'click' then 'queued' when 'view' then 'completed' when 'error' then 'failed' when 'signup' then 'retry' else 'delete' end as kind,
  case when event_type = 'error' then 'timeout' end as error, case when event_type = 'view' then 'r' || cast(event_id as string) end as report_id from {events}"""
JOB_LIFECYCLE = f"""
with last as (select job_id, arg_max(kind, ord) as kind, max(ord) as ord from ({twin(LIFE)}) group by job_id)
select l.job_id, case when l.kind = 'retry' then 'queued' else l.kind end as state, case when l.kind <> 'retry' then e.error end as error, case when l.kind <> 'retry' then e.report_id end as report_id
from last l join ({twin(LIFE)}) e on e.job_id = l.job_id and e.ord = l.ord where l.kind <> 'delete'"""


def provider_failures(spark, sf_dir):
    """What the status of each event (an HTTP status made of its id) means."""
    rows = derived(spark, sf_dir, "select event_id, cast(200 + event_id % 400 as int) as status from {events}").withColumn("f", jobs.failure(F.col("status")))
    return rows.select("event_id", "f.code", "f.retryable")


PROVIDER_FAILURES = """
select event_id, case when s in (401, 403) then 'auth' when s = 429 then 'rate_limited' when s = 408 then 'timeout' when s >= 500 then 'unavailable' when s >= 400 then 'rejected' end as code, s in (408, 429) or s >= 500 as retryable
from (select event_id, 200 + event_id % 400 as s from events)"""


def reply_status(spark, sf_dir):
    """What a status says, with the capped wait."""
    rows = derived(spark, sf_dir, REPLIES).withColumn("e", pages.status_error(F.col("status"), F.col("retry")))
    return rows.select("event_id", "e.code", F.col("e.retry_after").cast("long").alias("retry_after"))


REPLIES = "select event_id, cast(case event_id % 6 when 0 then 200 when 1 then 429 when 2 then 401 when 3 then 403 when 4 then 500 else 301 end as int) as status, case when event_id % 12 = 1 then 'soon' else cast(event_id * 7 as string) end as retry from {events}"
REPLY_STATUS = f"""
select event_id, case status when 200 then null when 429 then 'source_rate_limited' when 401 then 'source_forbidden' when 403 then 'source_forbidden' else 'source_unavailable' end as code,
  case when status = 429 and regexp_full_match(retry, '[0-9]{{1,6}}') then least(retry::bigint, 3600) end as retry_after from ({twin(REPLIES)})"""


def stored_records(spark, sf_dir):
    """Records of a browser's store (events) that open, or why not."""
    rows = derived(spark, sf_dir, RECORDS)
    return rows.select("event_id", gates.stored_record(F.lit(NOW).cast("timestamp")).alias("status"))


RECORDS = """
select event_id, case event_id % 8 when 0 then 'yesterday' when 1 then d || 'T24:00:00Z' else d || 'T' || t || case when event_id % 8 = 2 then '.123Z' else 'Z' end end as created,
  case event_id % 8 when 3 then '2024-02-30T00:00:00Z' when 4 then d || 'T00:00:00Z' when 5 then '2024-03-30T00:00:00Z' else '2024-01-' || case when substring(d, 9, 2) < '24' then cast(cast(substring(d, 9, 2) as int) + 6 + 10 as string) else '31' end || 'T00:00:00Z' end as expires
from (select event_id, substring(cast(ts as string), 1, 10) as d, substring(cast(ts as string), 12, 8) as t from {events}) x"""
STORED_RECORDS = f"""
with own as (select event_id, created, expires, case when regexp_full_match(created, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}(\\.[0-9]{{3}})?Z') then try_cast(replace(replace(created, 'T24:', 'T99:'), 'Z', '') as timestamp) end as made,
  case when regexp_full_match(expires, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}(\\.[0-9]{{3}})?Z') then try_cast(replace(expires, 'Z', '') as timestamp) end as ends from ({twin(RECORDS)}))
select event_id, case when made is null or ends is null or ends <= made or ends > made + interval 7 days then 'invalid' when made > timestamp '{NOW}' + interval 1 minute then 'clock' when ends <= timestamp '{NOW}' then 'expired' else 'ok' end as status from own"""


def local_paths(spark, sf_dir):
    """Redirect targets (from pages' addresses) that stay on the site."""
    rows = derived(spark, sf_dir, TARGETS)
    return rows.select("page_id", urls.local_path(F.col("path"), "/home").alias("path"))


TARGETS = """
select page_id, case page_id % 5 when 0 then url when 1 then substring(url, 7, 300) when 2 then substring(url, 8, 300) when 3 then '/a' || chr(92) || url else null end as path from {pages}"""
LOCAL_PATHS = f"""
select page_id, case when starts_with(path, '/') and not starts_with(path, '//') and not contains(path, chr(92)) and not regexp_matches(path, '[\\x00-\\x1f\\x7f]') then path else '/home' end as path from ({twin(TARGETS)})"""


def redirect_chain(spark, sf_dir):
    """Where replies lead over at most three approved hops: a page leads to that of a fifth of its number, some to themselves."""
    rows = derived(spark, sf_dir, REDIRECTS)
    hosts = derived(spark, sf_dir, "select distinct 'h' || cast(page_id % 20 as string) || '.com' as host from {pages} where page_id % 20 <> 7")
    return pages.final_urls(rows, hosts).select("url", "final", F.col("hops").cast("long").alias("hops"), "error")


REDIRECTS = """
select 'https://h' || cast(page_id % 20 as string) || '.com/' || cast(page_id as string) as url,
  case when page_id % 6 = 5 then 'https://h' || cast(page_id % 20 as string) || '.com/' || cast(page_id as string)
       when page_id >= 5 then 'https://h' || cast(cast(floor(page_id / 3) as bigint) % 20 as string) || '.com/' || cast(cast(floor(page_id / 3) as bigint) as string) end as location from {pages}"""
REDIRECT_CHAIN = f"""
with recursive edge as ({twin(REDIRECTS)}),
walk as (
  select url, url as here, [url] as seen, 0::bigint as hops, null::varchar as error, 0 as turn from edge
  union all
  select w.url, case when moved then w.location else here end, case when moved then list_append(seen, w.location) else seen end, hops + moved::bigint, coalesce(error, why), turn + 1
  from (select w.*, e.location, case when w.error is null and e.location is not null then case when list_contains(seen, e.location) then 'redirect_loop' when contains(e.location, '//h7.com/') then 'host_not_approved' when hops >= 3 then 'too_many_redirects' end end as why,
          w.error is null and e.location is not null and not list_contains(seen, e.location) and not contains(e.location, '//h7.com/') and hops < 3 as moved
        from walk w left join edge e on e.url = w.here where turn < 4) w)
select url, case when error is null then here end as final, hops, error from walk where turn = 4"""


def request_gate(spark, sf_dir):
    """Requests with a closed schema and rules on seeds, made of conversations."""
    rows = derived(spark, sf_dir, REQUESTS)
    return requests(rows).select("conv_id", "error")


REQUESTS = """
select conv_id, '[[OPEN]]"seeds": [' || case conv_id % 6 when 3 then '' when 1 then [[A]] || ', ' || [[B]] when 2 then [[A]] || ', ' || [[C]] else [[A]] || ', ' || [[D]] end
  || '], "audiences": [' || case conv_id % 6 when 4 then '"x", "x"' else '"x", "y"' end || '], "seller_context": null' || case conv_id % 6 when 5 then ', "more": 1' else '' end || '[[CLOSE]]' as json
from {conversations} group by conv_id"""
_PART = lambda n, p: f"""'[[OPEN]]"url": "https://a.com/{n}", "purpose": "{p}"[[CLOSE]]'"""
for _mark, _text in (("[[A]]", _PART(1, "homepage")), ("[[B]]", _PART(2, "homepage")), ("[[C]]", _PART(1, "news")), ("[[D]]", _PART(2, "news"))):
    REQUESTS = REQUESTS.replace(_mark, _text)
REQUESTS = REQUESTS.replace("[[OPEN]]", "' || chr(123) || '").replace("[[CLOSE]]", "' || chr(125) || '")
REQUEST_GATE = f"""
with own as (select conv_id, list_sort(json_keys(json)) as keys, json_extract_string(json, '$.seeds[*].url') as urls, json_extract_string(json, '$.seeds[*].purpose') as purposes, json_extract_string(json, '$.audiences[*]') as audiences from ({twin(REQUESTS)}))
select conv_id, case when keys <> ['audiences', 'seeds', 'seller_context'] then 'wrong_shape' when len(urls) not between 1 and 6 then 'seed_count' when len(list_filter(purposes, lambda p: p = 'homepage')) <> 1 then 'one_homepage'
  when len(list_distinct(urls)) <> len(urls) then 'repeated_seed' when len(list_distinct(audiences)) <> len(audiences) then 'repeated_audience' end as error from own"""


def json_shape_gate(spark, sf_dir):
    """Events' properties as artifacts, some of them altered, that are not exactly of their schema."""
    rows = derived(spark, sf_dir, ARTIFACTS)
    return rows.select("event_id", jsonshape.json_shape(F.col("j"), "k bigint").alias("code"))


ARTIFACTS = """
select event_id, case event_id % 6 when 0 then replace(props, chr(125), ', "more": 1' || chr(125)) when 1 then replace(props, chr(123), chr(123) || '"k": 1, ') when 2 then replace(props, ': ', ': "x') || '"'
  when 3 then '[' || props || ']' when 4 then replace(props, '"k": ', '"k": NaN, "l": ') else props end as j from {events}"""
JSON_SHAPE_GATE = f"""
with own as (select event_id, j, j is not null and json_valid(j) and not contains(j, 'NaN') and len(regexp_extract_all(j, '"k": ')) <= 1 as readable from ({twin(ARTIFACTS)}))
select event_id, case when not readable then 'invalid_json' when json_type(j) <> 'OBJECT' or json_keys(j) <> ['k'] or json_type(j, '$.k') not in ('UBIGINT', 'BIGINT') then 'wrong_shape' end as code from own"""


def artifact_references(spark, sf_dir):
    """Fact ids anywhere in nested artifacts, one for each conversation."""
    own = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.col("turn").cast("string"))).alias("t"))
    rows = own.select("conv_id", F.struct(F.slice("t", 1, 1).alias("fact_ids")).alias("summary"), F.transform("t", lambda x: F.struct(x.alias("id"), F.struct(F.array(F.concat(F.lit("s"), x)).alias("fact_ids")).alias("signal"), F.array(F.struct(F.array(F.concat(F.lit("b"), x), F.lit("b0")).alias("baseline_fact_ids"))).alias("success_criteria"))).alias("opportunities"))
    return report.references(rows, ["conv_id"])


ARTIFACT_REFERENCES = """
select conv_id, min(turn::varchar) as fact_id from conversations group by conv_id union select conv_id, 's' || turn from conversations union select conv_id, 'b' || turn from conversations union select conv_id, 'b0' from conversations"""


def bounded_bodies(spark, sf_dir):
    """Pages' bodies as sent, packed in turn or broken, read back within a bound of bytes: size and digest, or null."""

    @F.pandas_udf("binary")
    def packed(body: pd.Series, kind: pd.Series) -> pd.Series:
        how = (lambda b: b, lambda b: gzip.compress(b, mtime=0), zlib.compress, lambda b: gzip.compress(b, mtime=0)[:-5])
        return pd.Series([how[k](b) for b, k in zip(body, kind, strict=True)], dtype=object)

    rows = table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("body"), (F.col("page_id") % 4).cast("int").alias("k"))
    coding = F.element_at(F.array(F.lit("identity"), F.lit("gzip"), F.lit("deflate"), F.lit("gzip")), F.col("k") + 1)
    back = pages.inflated(packed("body", "k"), coding, most=2048)
    return rows.select("page_id", F.octet_length(back).cast("long").alias("bytes"), F.sha2(back, 256).alias("digest"))


BOUNDED_BODIES = "select page_id, case when page_id % 4 <> 3 and strlen(html) <= 2048 then strlen(html)::bigint end as bytes, case when page_id % 4 <> 3 and strlen(html) <= 2048 then sha256(html) end as digest from pages"


def settings_gate(spark, sf_dir):
    """Settings (events, their numbers in turn) that are out of bounds or do not fit each other."""
    rows = derived(spark, sf_dir, SETTINGS)
    limits = {"pages": ("range", 1, 20), "seconds": ("range", 0.5, 90.0)}
    cross = {"one_search_task": F.col("search_tasks") > 1, "task_cap": F.col("task_tokens") > F.col("job_tokens"), "pages_for_seeds": F.col("pages") < F.col("seeds")}
    return gates.bounds(rows, ["event_id"], limits).unionByName(gates.violations(rows, ["event_id"], cross))


SETTINGS = "select event_id, event_id % 24 as pages, coalesce(value, 0) as seconds, event_id % 3 as search_tasks, user_id * 1000 as task_tokens, 12000 as job_tokens, event_id % 7 as seeds from {events}"
SETTINGS_GATE = f"""
with own as ({twin(SETTINGS)}) select event_id, 'pages:range' as code from own where pages not between 1 and 20 union all select event_id, 'seconds:range' from own where seconds not between 0.5 and 90.0
union all select event_id, 'one_search_task' from own where search_tasks > 1 union all select event_id, 'task_cap' from own where task_tokens > job_tokens union all select event_id, 'pages_for_seeds' from own where pages < seeds"""


def quote_token_rows(spark, sf_dir):
    """Tokens of the benchmark's texts with their places."""
    own = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(quotes.quote_tokens(F.concat("text", F.lit(" 1,000.50 can’t")))).alias("n", "t"))
    return own.select("item_id", F.col("n").cast("long").alias("n"), "t.value", F.col("t.start").cast("long").alias("start"), F.col("t.end").cast("long").alias("stop"))


_TOKEN = "[0-9]+(?:[.,][0-9]+)*%?|\\pL+(?:[''’]\\pL+)?"
QUOTE_TOKEN_ROWS = f"""
with own as (select item_id, text || ' 1,000.50 can’t' as x from benchmark),
cut as (select item_id, regexp_extract_all(x, '{_TOKEN}') as hit, string_split_regex(x, '{_TOKEN}') as gap, unnest(range(1, len(regexp_extract_all(x, '{_TOKEN}')) + 1)) as k from own),
placed as (select item_id, k, hit[k] as t, (list_sum(list_transform(gap[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(hit[1:k - 1], lambda g: length(g))), 0))::bigint as start from cut)
select item_id, k - 1 as n, case when t = '1,000.50' then '1000.5' else replace(replace(lower(t), '’', chr(39)), 'ß', 'ss') end as value, start, start + length(t) as stop from placed"""


def marker_rows(spark, sf_dir):
    """What tells sign, currency and comparison in each event's amount, written in turn in several ways."""
    rows = derived(spark, sf_dir, AMOUNTS)
    return rows.select("event_id", F.array_join(quotes.meaning_markers(F.col("said")), " ").alias("markers"))


AMOUNTS = """
select event_id, case event_id % 8 when 0 then '$' || n || ' and €5' when 1 then '(' || n || ')' when 2 then '-' || n when 3 then 'a-' || n when 4 then '- £' || n || '>=' when 5 then '($ ' || n || ',00 )' when 6 then '-' || n || ' < -3 = ($4)' else n end as said
from (select event_id, cast(user_id as string) as n from {events}) e"""
_AMOUNT = f"([{quotes.CURRENCIES}]\\s*)?\\d"
MARKER_ROWS = f"""
with own as (select event_id, regexp_extract_all(said, '[{quotes.SYMBOLS}]') || case when regexp_matches(said, '(^|[^\\pL\\pN_])-\\s*{_AMOUNT}') then ['negative_number'] else [] end
  || case when regexp_matches(said, '\\(\\s*{_AMOUNT}[\\d.,]*\\s*\\)') then ['accounting_negative'] else [] end as found from ({twin(AMOUNTS)}))
select event_id, array_to_string(list_sort(found), ' ') as markers from own"""


def host_forms(spark, sf_dir):
    """Hosts of pages as they may be written, in normal form or refused."""
    return derived(spark, sf_dir, HOSTS).select("page_id", urls.normalize_host("form").alias("host"))


HOSTS = """
select page_id, case page_id % 9 when 0 then upper(h) when 1 then h || '.' when 2 then h || '.internal' when 3 then '10.0.0.' || cast(page_id % 250 as string) when 4 then '-' || h when 5 then h || '.42' when 6 then repeat('a', cast(60 + page_id % 8 as int)) || '.' || h
  when 7 then repeat('abcdefghi.', cast(20 + page_id % 9 as int)) || h else 'localhost' end as form
from (select page_id, split_part(split_part(url, '/', 3), ':', 1) as h from {pages}) p"""
_LABEL = "[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?"
HOST_FORMS = f"""
with own as (select page_id, regexp_replace(lower(form), '[.]$', '') as h from ({twin(HOSTS)}))
select page_id, case when regexp_matches(h, '^({_LABEL}[.])+{_LABEL}$') and not regexp_matches(h, '[.][0-9]+$') and length(h) <= 253
  and not regexp_matches('.' || h, '[.]({"|".join(x.replace(".", "[.]") for x in urls.LOCAL_SUFFIXES)})$') then h end as host from own"""


def owned_rows(spark, sf_dir):
    """The rows of one owner."""
    own = table(spark, sf_dir, "events").select("event_id", F.sha2(F.concat(F.lit("user"), F.col("user_id").cast("string")), 256).alias("owner_hash"))
    return jobs.owned(own, hashlib.sha256(b"user3").hexdigest()).select("event_id")


OWNED_ROWS = "select event_id from events where sha256('user' || user_id) = sha256('user3')"


def chunk_payloads(spark, sf_dir):
    """Chunks of a source's spans (documents, fifty to a chunk) with its header."""
    docs = table(spark, sf_dir, "documents").where("source is not null")
    chunks = docs.select(F.col("source").alias("source_id"), F.floor(F.col("doc_id") / 50).alias("chunk"), F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("span_id"), "text", F.lit(1).alias("page"), F.col("lang").alias("section"))
    sources = docs.select(F.col("source").alias("source_id")).distinct().select("source_id", F.concat(F.lit("https://a.com/"), "source_id").alias("url"), F.upper("source_id").alias("title"))
    spans = report.span_rows(chunks).select("source_id", "span.*", "ord").join(chunks.select("ord", "chunk"), "ord")
    out = report.chunk_payload(spans, sources)
    return out.select("source_id", "chunk", "url", "title", F.array_join(F.transform("spans", lambda s: s["span_id"]), ",").alias("spans"), F.sha2(F.array_join(F.transform("spans", lambda s: s["text"]), "|"), 256).alias("digest"))


CHUNK_PAYLOADS = """
select source as source_id, doc_id // 50 as chunk, 'https://a.com/' || source as url, upper(source) as title, string_agg(doc_id::varchar, ',' order by doc_id) as spans, sha256(string_agg(text, '|' order by doc_id)) as digest
from documents where source is not null group by all"""


def decoded_pages(spark, sf_dir):
    """Pages' bytes in one of four codings, told by header, mark or meta element, or by none and wrong."""

    @F.pandas_udf("string")
    def text_of(body: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([pages.html_text(b, k) for b, k in zip(body, kind, strict=True)], dtype=object)

    html, k = F.col("html"), F.col("page_id") % 5
    body = F.when(k == 0, F.encode(html, "UTF-16BE")).when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(html, "UTF-8"))).when(k == 3, F.concat(F.encode(html, "UTF-8"), F.unhex(F.lit("FF")))).otherwise(F.encode(html, "UTF-8"))
    kind = F.when(k == 0, "text/html; charset=utf-16-be").when(k == 4, "text/html; charset=shift_jis").otherwise("text/html")
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(text_of(body, kind), 256).alias("digest"))


DECODED_PAGES = "select page_id, case when page_id % 5 < 3 then sha256(html) end as digest from pages"


def json_forms(spark, sf_dir):
    """Canonical JSON of events' properties, written with other order and spaces, and the size of a record."""
    own = table(spark, sf_dir, "events")
    loose = F.concat(F.lit('{ "user" : '), F.col("user_id").cast("string"), F.lit(',\n"props":'), "props", F.lit(', "e":"\u00e9"}'))
    return own.select("event_id", ids.canonical_json(loose).alias("json"), ids.json_size(F.struct("event_id", "event_type")).cast("long").alias("bytes"))


JSON_FORMS = r"""
select event_id, '{"e":"\u00e9","props":' || replace(props, ' ', '') || ',"user":' || user_id || '}' as json, strlen('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}')::bigint as bytes from events"""


def stored_lines(spark, sf_dir):
    """Reports (labels) written as lines of JSON and read as raw files and as text again."""
    folder = f"{scratch(spark)}/{uuid.uuid4().hex}"
    codec.write_json_lines(table(spark, sf_dir, "labels").select("doc_id", "quality"), folder)
    raw = raw_files(spark, f"{folder}/*.txt").select(F.explode(F.split(F.decode("body", "UTF-8"), "\n")).alias("line")).where("line <> ''")
    return raw.select(F.from_json("line", "doc_id long, quality int").alias("r")).select("r.doc_id", "r.quality")


STORED_LINES = "select doc_id, quality from labels"


def stream_usage_windows(spark, sf_dir):
    """Totals of event types by hour, as a stream: windows that the watermark has passed."""
    stream = _stream(spark, sf_dir)
    out = streams.usage_windows(stream, "event_type", "event_id").select(F.unix_micros("start").alias("start"), "event_type", "n", "total")
    return streams.drained(out, f"{scratch(spark)}/{uuid.uuid4().hex}")


STREAM_USAGE_WINDOWS = """
select epoch_us(date_trunc('hour', ts)) as start, event_type, count(*) as n, sum(event_id)::bigint as total from events
where date_trunc('hour', ts) + interval 1 hour <= (select max(ts) from events) - interval 10 minutes group by all"""


def stream_live_reports(spark, sf_dir):
    """Sessions of users' activity, as a stream: those that the watermark has passed."""
    stream = _stream(spark, sf_dir).withColumn("report_id", F.col("user_id"))
    out = streams.live_reports(stream, ttl="3 hours").select("report_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("stop"), "events")
    return streams.drained(out, f"{scratch(spark)}/{uuid.uuid4().hex}")


STREAM_LIVE_REPORTS = """
with marked as (select user_id, ts, sum(new) over (partition by user_id order by ts, event_id) as s from (
  select *, (ts >= coalesce(lag(ts) over (partition by user_id order by ts, event_id) + interval 3 hours, timestamp '1900-01-01'))::int as new from events)),
own as (select user_id as report_id, min(ts) as a, max(ts) + interval 3 hours as b, count(*) as events from marked group by user_id, s)
select report_id, epoch_us(a) as start, epoch_us(b) as stop, events from own where b <= (select max(ts) from events) - interval 10 minutes"""


def _stream(spark, sf_dir):
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


QUERIES = (
    dates_in_text, strict_dates, publication_resolution, news_support, first_texts, names_and_placeholders, retry_waits, message_lines, audience_jobs, resolved_gaps,
    remaining_budget, promoted_attempts, retryable_jobs, restored_reports, swept_store, usage_gate, resource_fit, ledger_replay, invalidate_closure, job_lifecycle,
    provider_failures, reply_status, stored_records, local_paths, redirect_chain, request_gate, json_shape_gate, artifact_references, bounded_bodies, settings_gate,
    quote_token_rows, marker_rows, host_forms, owned_rows, chunk_payloads, decoded_pages, json_forms, stored_lines,
    stream_usage_windows, stream_live_reports,
)
