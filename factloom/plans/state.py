"""Queries over jobs, ledgers and retention. ``events`` are job events: users own them, types are states."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from factloom.functions import dates, ids, text
from factloom.operators import dedup, jobs, report, select
from factloom.sources import codec, store
from factloom.sources.tables import scoped_candidates, scratch, table

NOW = "2024-01-20 00:00:00"


def events(spark, sf_dir, *columns):
    return table(spark, sf_dir, "events").select(*columns)


def date_window_filter(spark, sf_dir):
    """Events by whether their day is within ten days before the last one but five."""
    own = events(spark, sf_dir, "event_id", F.col("ts").cast("date").alias("day"))
    last = own.agg(F.date_sub(F.max("day"), 5).alias("as_of"))
    out = own.crossJoin(F.broadcast(last))  # one row
    return out.select(dates.news_reason(F.when(F.col("event_id") % 50 != 0, F.col("day")), F.col("as_of"), days=10).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


DATE_WINDOW_FILTER = """
with own as (select event_id, ts::date as day, case when event_id % 50 <> 0 then ts::date end as d from events), last as (select max(day) - 5 as as_of from own)
select case when d is null then 'undated' when d > as_of then 'future' when d < as_of - 10 then 'too_old' else 'accepted' end as reason, count(*) as n from own, last group by 1"""


def announcement_order(spark, sf_dir):
    """Purchases first, then the latest: three of each user are taken, the rest skipped."""
    own = events(spark, sf_dir, "user_id", "event_id", "ts", (F.col("event_type") == "purchase").alias("executive"))
    out = select.top_k(own, ["user_id"], [F.desc("executive"), F.desc("ts"), F.asc("event_id")], 1 << 30)
    return out.select("user_id", "event_id", F.when(F.col("rn") <= 3, "accepted").otherwise("skipped").alias("outcome"))


ANNOUNCEMENT_ORDER = """
select user_id, event_id, case when row_number() over (partition by user_id order by (event_type = 'purchase') desc, ts desc, event_id) <= 3 then 'accepted' else 'skipped' end as outcome from events"""


def idempotent_submission(spark, sf_dir):
    """First event of each user and type is the job; later ones reuse it or conflict with its value."""
    own = events(spark, sf_dir, "event_id", "user_id", "event_type", "ts", F.floor("value").cast("long").alias("fp"))
    return jobs.submissions(own, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], "fp").select("event_id", "outcome")


IDEMPOTENT_SUBMISSION = """
with own as (select event_id, floor(value)::bigint as fp, row_number() over w as rn, first_value(floor(value)::bigint) over w as first from events window w as (partition by user_id, event_type order by ts, event_id))
select event_id, case when rn = 1 then 'created' when fp is not distinct from first then 'reused' else 'conflict' end as outcome from own"""


def ttl_active(spark, sf_dir):
    """Events that are live three days before the last, with a week to live."""
    own = events(spark, sf_dir, "event_id", F.col("ts").alias("created"), (F.col("ts") + F.expr("interval 7 days")).alias("expires"))
    now = own.agg((F.max("created") - F.expr("interval 3 days")).alias("now"))
    return jobs.active(own.crossJoin(F.broadcast(now)), F.col("now"), expires="expires", created="created").select("event_id")


TTL_ACTIVE = "select event_id from events, (select max(ts) - interval 3 days as now from events) where ts + interval 7 days > now and ts <= now"


def latest_state(spark, sf_dir):
    """The last event type of each user."""
    return jobs.latest(events(spark, sf_dir, "user_id", "event_type", "ts", "event_id"), ["user_id"], "event_type", [F.col("ts"), F.col("event_id")])


LATEST_STATE = "select user_id, arg_max(event_type, (ts, event_id)) as event_type from events group by user_id"


def best_attempt(spark, sf_dir):
    """Of each user's events the type of greatest value, the later one on ties."""
    own = events(spark, sf_dir, "user_id", "event_type", F.floor("value").cast("long").alias("points"), "event_id")
    return select.best_attempt(own, ["user_id"], "event_type", [F.col("points"), F.col("event_id")])


BEST_ATTEMPT = "select user_id, arg_max(event_type, (coalesce(floor(value)::bigint, -9223372036854775807), event_id)) as event_type from events group by user_id"


def stage_durations(spark, sf_dir):
    """Microseconds from each event of a user to the next."""
    own = events(spark, sf_dir, "user_id", "event_id", "ts")
    return jobs.durations(own, ["user_id"], [F.col("ts"), F.col("event_id")], F.unix_micros(F.col("ts").cast("timestamp"))).select("event_id", "micros")


STAGE_DURATIONS = """
with own as (select event_id, epoch_us(lead(ts) over (partition by user_id order by ts, event_id)) - epoch_us(ts) as gap from events)
select event_id, case when gap is not null then greatest(gap, 0) end as micros from own"""


def ledger_totals(spark, sf_dir):
    """Resources of users: spent, in flight and protected, without refunds."""
    own = events(spark, sf_dir, "user_id", "event_type", F.lit(1).cast("long").alias("calls"), F.floor("value").cast("long").alias("input_tokens"), F.length("props").cast("long").alias("output_tokens"), (F.col("event_id") % 3).alias("tool_calls"))
    parts = [own.where(F.col("event_type") == t) for t in ("click", "purchase", "view")]
    return jobs.total(*parts, keys=["user_id"], excluding=F.col("tool_calls") == 2)


LEDGER_TOTALS = """
select user_id, count(*)::bigint as calls, sum(floor(value)::bigint)::bigint as input_tokens, sum(length(props))::bigint as output_tokens, sum(event_id % 3)::bigint as tool_calls
from events where event_type in ('click', 'purchase', 'view') and event_id % 3 <> 2 group by user_id"""


def ledger_admission(spark, sf_dir):
    """Reservations of users in order, within 200."""
    own = events(spark, sf_dir, "user_id", F.col("event_id").alias("ord"), F.coalesce(F.ceil("value"), F.lit(0)).cast("long").alias("amount"))
    return jobs.admissions(own, ["user_id"], "ord", "amount", budget=200)


LEDGER_ADMISSION = """
with recursive queue as (select user_id, event_id as ord, coalesce(ceil(value), 0)::bigint as amount, row_number() over (partition by user_id order by event_id) as rn from events),
fold as (
  select user_id, 0::bigint as rn, 0::bigint as ord, 0::bigint as used, false as admitted from (select distinct user_id from events)
  union all
  select q.user_id, q.rn, q.ord, case when f.used + q.amount <= 200 then f.used + q.amount else f.used end, f.used + q.amount <= 200
  from fold f join queue q on q.user_id = f.user_id and q.rn = f.rn + 1)
select user_id, ord, admitted from fold where rn > 0"""


def job_admission(spark, sf_dir):
    """Submissions against places to run and wait, one a user."""
    own = events(spark, sf_dir, F.col("event_type").alias("scope"), F.col("event_id").alias("ord"), (F.floor(F.col("event_id") / 3)).cast("string").alias("job_id"), F.col("user_id").cast("string").alias("owner_hash"), F.when(F.col("event_id") % 3 == 2, "finish").otherwise("submit").alias("kind"))
    return jobs.admitted_jobs(own).groupBy("scope", "outcome").agg(F.count("*").alias("n"))


JOB_ADMISSION = """
with recursive queue as (select event_type as scope, event_id // 3 as job, user_id as owner, event_id % 3 = 2 as finish, row_number() over (partition by event_type order by event_id) as rn from events),
fold as (
  select scope, 0::bigint as rn, '' as outcome, map {}::map(bigint, bigint) as jobs from (select distinct scope from queue)
  union all
  select scope, rn, outcome, case when outcome = 'finished' then map_from_entries(list_filter(map_entries(jobs), lambda e: e.key <> job)) when outcome = 'in' then map_concat(jobs, map([job], [owner])) else jobs end from (
    select q.scope, q.rn, q.job, q.owner, f.jobs, case when finish then case when map_contains(f.jobs, q.job) then 'finished' else 'ignored' end
      when list_contains(map_values(f.jobs), q.owner) then 'owner_busy' when cardinality(f.jobs) >= 6 then 'full' else 'in' end as outcome
    from fold f join queue q on q.scope = f.scope and q.rn = f.rn + 1)),
named as (select scope, case when outcome = 'in' then case when cardinality(jobs) <= 2 then 'running' else 'queued' end else outcome end as outcome from fold where rn > 0)
select scope, outcome, count(*) as n from named group by all"""


def capacity_check(spark, sf_dir):
    """Users over 12 distinct types and days, or 400 of value."""
    own = events(spark, sf_dir, "user_id", F.concat("event_type", F.col("ts").cast("date").cast("string")).alias("item"), F.floor("value").cast("long").alias("size"))
    return jobs.capacity(own, ["user_id"], size="size", item="item", most_items=12, most_size=400)


CAPACITY_CHECK = """
with own as (select user_id, event_type || ts::date::varchar as item, max(floor(value)::bigint) as s from events group by all)
select user_id, count(*) as items, sum(s)::bigint as size from own group by user_id having count(*) > 12 or sum(s) > 400"""


def active_jobs(spark, sf_dir):
    """Users whose last state is open, in all and by type."""
    own = jobs.latest(events(spark, sf_dir, "user_id", "event_type", "ts", "event_id"), ["user_id"], "event_type", [F.col("ts"), F.col("event_id")])
    return own.where(~F.col("event_type").isin("purchase", "error")).groupBy("event_type").agg(F.count("*").alias("active"))


ACTIVE_JOBS = "select event_type, count(*) as active from (select user_id, arg_max(event_type, (ts, event_id)) as event_type from events group by user_id) where event_type not in ('purchase', 'error') group by 1"


def latest_50(spark, sf_dir):
    """The fifty latest events."""
    return events(spark, sf_dir, "event_id", "ts").orderBy(F.desc("ts"), F.asc("event_id")).limit(50).select("event_id")


LATEST_50 = "select event_id from events order by ts desc, event_id limit 50"


SAVES = """
select user_id, event_id, event_type || cast(event_id % 2 as string) as key, coalesce(props, '') || repeat('é', cast(event_id % 60 as int)) as value, case when event_id % 9 = 0 then null else event_id % 3 end as expected from {events}"""


def store_saves(spark, sf_dir):
    """Events as saves of their user's records: what a store with revisions and caps says to each, and what it then holds."""
    rows = spark.sql(SAVES, events=table(spark, sf_dir, "events"))
    day = lambda d: F.lit(d).cast("timestamp")
    saves = rows.select(F.col("user_id").cast("string").alias("scope"), F.col("event_id").alias("ord"), "key", "value", day("2024-01-01").alias("generated_at"), day("2024-02-01").alias("expires_at"), "expected")
    own = store.Store(spark, f"{scratch(spark)}/{uuid.uuid4().hex}", most_bytes=600, most_records=6)
    said = own.save(saves, day(NOW))
    held = own.records().select("scope", "key", F.lit(True).alias("held"), "revision")
    return said.join(held, ["scope", "key", "revision"], "left").select("scope", "ord", "outcome", "revision", (F.coalesce("held", F.lit(False)) & (F.col("outcome") == "saved")).alias("held"))


STORE_SAVES = f"""
with recursive save as (select user_id, event_id, key, coalesce(expected, 0) as expected, (2 * (length(key) + length(value)))::bigint as size, row_number() over (partition by user_id order by event_id) as n from ({SAVES.replace('{events}', 'events').replace("event_id % 60 as int", "event_id % 60 as int")})),
replay as (
  select distinct user_id, 0::bigint as n, null::bigint as ord, null::varchar as key, null::varchar as outcome, null::bigint as revision, map([]::varchar[], []::struct(rev bigint, size bigint)[]) as held from save
  union all
  select user_id, n, event_id, key, outcome, case when outcome = 'saved' then rev + 1 else rev end, case when outcome = 'saved' then map_concat(held, map([key], [{{'rev': (rev + 1)::bigint, 'size': size}}])) else held end
  from (select *, case when expected <> rev then 'changed' when (rev = 0 and cardinality(held) >= 6) or total - old + size > 600 then 'full' else 'saved' end as outcome
    from (select s.*, r.held, coalesce(r.held[s.key].rev, 0) as rev, coalesce(r.held[s.key].size, 0) as old, coalesce(list_sum(list_transform(map_values(r.held), lambda x: x.size)), 0) as total from replay r join save s on s.user_id = r.user_id and s.n = r.n + 1))),
final as (select user_id, arg_max(held, n) as held from replay group by user_id)
select user_id::varchar as scope, ord, outcome, revision::bigint as revision, outcome = 'saved' and coalesce(f.held[key].rev = revision, false) as held from replay join final f using (user_id) where n > 0"""


def upsert_latest(spark, sf_dir):
    """The last event of each user, for the forty users of each type that came first."""
    own = events(spark, sf_dir, "event_type", "user_id", "event_id")
    return dedup.upsert(own, ["event_type", "user_id"], "event_id", scope=["event_type"], most=40).select("event_type", "user_id", "event_id")


UPSERT_LATEST = """
with own as (select event_type, user_id, max(event_id) as event_id, min(event_id) as first from events group by all),
ranked as (select *, row_number() over (partition by event_type order by first) as r from own)
select event_type, user_id, event_id from ranked where r <= 40"""


def task_reuse(spark, sf_dir):
    """Documents as tasks: those whose content another source already has can be reused."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("extract").alias("task_key"), F.sha2("text", 256).alias("input_hash"), "source")
    return jobs.reusable(docs.select("doc_id", "task_key", "input_hash"), docs.where("source = 'src1'")).where("reuse").select("doc_id")


TASK_REUSE = "select doc_id from documents where sha256(text) in (select sha256(text) from documents where source = 'src1')"


def checkpoint_sizes(spark, sf_dir):
    """Bytes of state by source: texts as spans, sources as links, languages as artifacts."""
    docs = table(spark, sf_dir, "documents")
    spans = docs.select("source", "text", F.col("doc_id").cast("string").alias("span_id"))
    return report.checkpoint_size(spans, docs.select("source", F.col("source").alias("url")), docs.select("source", F.col("lang").alias("json")), ["source"])


CHECKPOINT_SIZES = "select source, sum(strlen(text) + strlen(doc_id::varchar) + 400 + strlen(source) + strlen(lang))::bigint as bytes from documents group by source"


def usage_by_task(spark, sf_dir):
    """Attempts and tokens by task."""
    own = events(spark, sf_dir, F.col("event_type").alias("task_id"), F.lit(1).alias("input_tokens"), F.length("props").cast("long").alias("output_tokens"), F.when(F.col("event_id") % 7 == 0, "failed").otherwise("ok").alias("status"))
    return jobs.usage_by_task(own).select("task_id", "attempts", "output_tokens", "succeeded")


USAGE_BY_TASK = "select event_type as task_id, count(*) as attempts, sum(length(props))::bigint as output_tokens, count(*) filter (event_id % 7 <> 0) as succeeded from events group by 1"


def blob_round_trip(spark, sf_dir):
    """Documents sealed and opened again: own, altered, and of another owner."""
    key = b"a key of the caller"
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit('{"t":"'), F.sha2("text", 256), F.lit('"}')).alias("j"))
    sealed = docs.withColumn("e", codec.encoded(F.col("j"), key)).select("doc_id", "j", "e.blob", "e.signature")
    flip = F.translate(F.left("signature", F.lit(1)), "0123456789abcdef", "123456789abcdef0")
    cached = sealed.select(
        F.col("doc_id").alias("report_id"), "j", "blob",
        F.when(F.col("doc_id") % 3 == 1, F.concat(flip, F.substring("signature", 2, 63))).otherwise(F.col("signature")).alias("signature"),
        F.when(F.col("doc_id") % 3 == 2, "other").otherwise("me").alias("owner_hash"),
        F.lit("2024-01-15").cast("timestamp").alias("generated_at"), F.lit("2024-01-22").cast("timestamp").alias("expires_at"),
    )
    out = codec.opened(cached, key, owner=F.lit("me"), now=F.lit(NOW).cast("timestamp"))
    return out.select(F.col("report_id").alias("doc_id"), "error", F.coalesce(F.col("json") == F.col("j"), F.lit(False)).alias("same"))


BLOB_ROUND_TRIP = "select doc_id, case doc_id % 3 when 1 then 'bad_signature' when 2 then 'wrong_owner' end as error, doc_id % 3 = 0 as same from documents"


def candidate_scope(spark, sf_dir):
    """Search results (pages by tens) all of whose hosts are approved: those that are not under .org."""
    own = table(spark, sf_dir, "pages").select("page_id", "url", F.floor(F.col("page_id") / 2).alias("group_id"))
    hosts = own.select(F.try_parse_url("url", F.lit("HOST")).alias("host")).where(~F.endswith("host", F.lit(".org")))
    return scoped_candidates(own, hosts).select("page_id")


CANDIDATE_SCOPE = r"""
with own as (select page_id, page_id // 2 as g, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) as host from pages)
select page_id from own where g not in (select g from own where ends_with(host, '.org'))"""


def namespaces(spark, sf_dir):
    """Owners as hashes, and storage in UTF-16."""
    return table(spark, sf_dir, "customer").select("c_custkey", ids.namespace(F.col("c_name")).alias("owner"), text.utf16_bytes(F.col("c_name")).cast("long").alias("bytes"))


NAMESPACES = "select c_custkey, sha256(c_name) as owner, 2 * length(c_name)::bigint as bytes from customer"


def job_view(spark, sf_dir):
    """State of users' jobs, that of a report (their purchases) first."""
    last = jobs.latest(events(spark, sf_dir, "user_id", "event_type", "ts", "event_id"), ["user_id"], "event_type", [F.col("ts"), F.col("event_id")]).select(F.col("user_id").alias("job_id"), F.col("event_type").alias("state"))
    reports = events(spark, sf_dir, F.col("user_id").alias("job_id"), "event_type").where("event_type = 'purchase'").groupBy("job_id").agg(F.lit("completed").alias("status"))
    return report.job_view(last, reports).select("job_id", "status")


JOB_VIEW = """
select user_id as job_id, case when bool_or(event_type = 'purchase') then 'completed' else arg_max(event_type, (ts, event_id)) end as status from events group by user_id"""

QUERIES = (
    date_window_filter, announcement_order, idempotent_submission, ttl_active, latest_state, best_attempt, stage_durations, ledger_totals, ledger_admission, 
    job_admission, capacity_check, active_jobs, latest_50, upsert_latest, store_saves, task_reuse, checkpoint_sizes, usage_by_task, 
    blob_round_trip, candidate_scope, namespaces, job_view,
)
