"""Queries of walks, parallel maps, table functions, blob files, refreshes and stateful streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import schemas
from factloom.functions.urls import normal_url
from factloom.operators import dedup, parallel, refresh, walk
from factloom.plans.inputs import LEDGER, LEDGER_REPLAY
from factloom.plans.reports import derived, twin
from factloom.sources import blobs
from factloom.sources.tables import scratch, table
from factloom.streaming import replay


def _folder(spark) -> str:
    return f"{scratch(spark)}/{uuid.uuid4().hex}"


#: A turn of a conversation as an artifact, of a shape that turns with its number. Braces are written as angle brackets.
SHAPES = """
select conv_id, turn, translate(case (conv_id + turn) % 6
  when 0 then '<"fact_ids": ["f' || cast(conv_id as string) || '", "f' || cast(turn as string) || '"], "claims": <"outcome": <"baseline_fact_ids": ["f' || cast(conv_id + turn as string) || '"]>>>'
  when 1 then '[[<"points": [<"fact_ids": ["f' || cast(turn as string) || '", null, 3, ["f7"]]>]>], "f8"]'
  when 2 then '<"fact_id": "f1", "facts": ["f2"], "fact_ids": <"inner": ["f3"]>, "baseline_fact_ids": "f' || cast(conv_id as string) || '">'
  when 3 then repeat('<"a": [', cast(turn as int)) || '<"fact_ids": ["f5"]>' || repeat(']>', cast(turn as int)) when 4 then 'not json' else '<>' end, '<>', chr(123) || chr(125)) as artifact
from {conversations}"""


def artifact_walk(spark, sf_dir):
    """References to facts at any depth of artifacts of unknown shape."""
    rows = derived(spark, sf_dir, SHAPES).select("conv_id", "turn", F.try_parse_json("artifact").alias("v"))
    return walk.references(walk.nodes(rows, ["conv_id", "turn"], "v", _folder(spark)), ["conv_id", "turn"])


ARTIFACT_WALK = f"""
with own as (select * from ({twin(SHAPES)}) where json_valid(artifact)),
node as (select conv_id, turn, t.fullkey, t.type, t.atom from own, json_tree(own.artifact::json) t)
select distinct conv_id, turn, json_extract_string(atom, '$') as fact_id from node where type = 'VARCHAR' and regexp_matches(fullkey, '[.](fact_ids|baseline_fact_ids)(\\[\\d+\\])*$')"""


def _address(url: str | None) -> str:
    found = normal_url(url)
    if found is None:
        raise ValueError("no public address")
    return found


def parallel_values(spark, sf_dir):
    """A call for every page, four at a time: its address in normal form, or the exception that it ended in."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url")
    return parallel.parallel_map(rows, _address, ["url"], "string").select("page_id", "value", "error")


PARALLEL_VALUES = r"""
select page_id, case when url like 'https://%' then 'https://' || lower(regexp_extract(url, '^https://([^/?#]+)', 1)) || coalesce(nullif(regexp_extract(url, '^https://[^/?#]+([^?#]*)', 1), ''), '/') || regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) end as value,
  case when url not like 'https://%' then 'ValueError: no public address' end as error from pages"""

#: A schema a document: nested objects around a leaf. Braces are written as angle brackets.
SCHEMAS = """
select doc_id, cast(doc_id % 13 as int) as deep, doc_id % 8 as leaf, translate(repeat('<"type":"object","properties":<"a":', cast(doc_id % 13 as int)) || case doc_id % 8
  when 0 then '<"type":"string","minLength":3,"title":"T">' when 1 then '<"const":7>' when 2 then '<"oneOf":[]>' when 3 then '<"type":"object","additionalProperties":true>' when 4 then '<"$ref":"#/$defs/x">'
  when 5 then '<"type":"array","items":<"type":"integer","minimum":0>>' when 6 then '<"anyOf":[<"type":"null">,<"type":"number","default":1>]>' else '<broken' end || repeat('>>', cast(doc_id % 13 as int)), '<>', chr(123) || chr(125)) as given
from {documents}"""


def strict_schemas(spark, sf_dir):
    """Schemas rewritten to the strict subset, or why not, row by row."""
    schemas.register(spark)
    rows = derived(spark, sf_dir, SCHEMAS).select("doc_id", "given")
    return spark.sql("select doc_id, strict, code from strict_schemas(table(select * from {rows}), column => 'given')", rows=rows)


STRICT_SCHEMAS = f"""
with own as (select *, case when leaf = 7 then 'invalid_json' when leaf = 2 then 'unsupported' when leaf = 3 then 'open_object' when leaf = 4 then 'unknown_reference' when deep + (leaf = 5)::int > {schemas.MAX_LEVELS} then 'too_deep' end as code,
  case leaf when 0 then '{{"type":"string","title":"T"}}' when 1 then '{{"enum":[7]}}' when 5 then '{{"type":"array","items":{{"type":"integer"}}}}' when 6 then '{{"anyOf":[{{"type":"null"}},{{"type":"number"}}]}}' end as inner_schema from ({twin(SCHEMAS)}))
select doc_id, case when code is null then repeat('{{"type":"object","properties":{{"a":', deep) || inner_schema || repeat('}},"required":["a"],"additionalProperties":false}}', deep) end as strict, code from own"""


def blob_files(spark, sf_dir):
    """Documents as signed blobs in files, and back; those of one language were signed with another key."""
    spark.dataSource.register(blobs.Blobs)
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), F.coalesce("text", F.lit("")).alias("json"), "lang")
    folder = _folder(spark)
    for other in (False, True):
        own = rows.where((F.col("lang") == "de").eqNullSafe(other)).select("name", "json")
        own.write.format("factloom_blobs").option("key", "other" if other else "own").mode("append").save(folder)
    return spark.read.format("factloom_blobs").option("key", "own").load(folder).select("name", F.sha2("json", 256).alias("digest"), "error")


BLOB_FILES = """
select doc_id::varchar as name, case when lang is distinct from 'de' then sha256(coalesce(text, '')) end as digest, case when lang = 'de' then 'bad_signature' end as error from documents"""

#: Documents are read one by one, summed up by source, and those by language.
STEPS = """
select 'x' || cast(doc_id as string) as task_key, 'extract' as stage, cast(n_chars + {late} * case when doc_id % 97 = 5 then 1 else 0 end as string) as source_hash, cast(n_chars + {late} * case when doc_id % 194 = 5 then 1 else 0 end as string) as said from {documents}
union all select distinct 's' || source, 'source', null, null from {documents} union all select distinct 'l' || lang, 'language', null, null from {documents}"""


def artifact_refresh(spark, sf_dir):
    """What a second refresh computes again after some documents changed, half of them without effect."""
    docs = table(spark, sf_dir, "documents")
    edges = docs.select(F.concat(F.lit("x"), F.col("doc_id").cast("string")).alias("src"), F.concat(F.lit("s"), "source").alias("dst"))
    edges = edges.unionByName(docs.select(F.concat(F.lit("s"), "source").alias("src"), F.concat(F.lit("l"), "lang").alias("dst")).distinct())
    total = lambda df: df.select("task_key", F.aggregate(F.map_values("inputs"), F.lit(0).cast("long"), lambda a, x: a + x.cast("long")).cast("string").alias("value"))
    stages = {"extract": lambda df: df.select("task_key", F.col("said").alias("value")), "source": total, "language": total}
    store = refresh.artifacts(spark, _folder(spark))
    for late in (0, 1):
        out = refresh.refresh(store, derived(spark, sf_dir, STEPS.replace("{late}", str(late))), edges, stages)
    return out.where("not reused").select("task_key", "stage").join(store.records().select("task_key", "value"), "task_key")


ARTIFACT_REFRESH = """
with own as (select *, doc_id % 97 = 5 as touched, doc_id % 194 = 5 as changed, n_chars + (doc_id % 194 = 5)::int as said from documents),
by_source as (select source, sum(said)::bigint as said, bool_or(changed) as changed from own group by source)
select 'x' || doc_id as task_key, 'extract' as stage, said::varchar as value from own where touched
union all select 's' || source, 'source', said::varchar from by_source where changed
union all select 'l' || lang, 'language', sum(said)::bigint::varchar from (select distinct lang, source from own) join by_source using (source) group by lang having bool_or(changed)"""


def _fed(spark, rows: DataFrame, name: str, files: int = 2):
    """A table as the input of a stream, so many files at a time."""
    at = f"{_folder(spark)}/{name}"
    rows.write.parquet(at)
    return lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(at)


#: Events of one file of a stream's input; two files are one micro-batch.
EVENTS = 500_000


#: All files in one micro-batch: of a report that ends, comes again and ends later, the SQL knows the last end only.
ALL = 2**31 - 1


def _in_order(spark, sf_dir, events: DataFrame) -> DataFrame:
    """Numbered events in files of a bounded size, early numbers in early files: few of them wait in state."""
    return events.repartitionByRange(max(4, -(-table(spark, sf_dir, "events").count() // EVENTS)), "ord")


def stream_ledger(spark, sf_dir):
    """Reservations and settlements of users as a stream, with those in flight in state: the rows of the batch fold."""
    source = _fed(spark, derived(spark, sf_dir, LEDGER).repartition(4, "ord"), "ledger")
    limits = {"calls": 1000, "input_tokens": 900, "output_tokens": 10_000, "tool_calls": 1000}
    return replay.drained(lambda: replay.ledger(source(), ["user_id"], limits), _folder(spark))


STREAM_LEDGER = LEDGER_REPLAY

PLACES = """
select event_type as scope, cast(floor(event_id / 3) as string) as job_id, cast(user_id as string) as owner_hash, case when event_id % 3 = 2 then 'finish' else 'submit' end as kind,
  row_number() over (partition by event_type order by event_id) as ord from {events}"""


def stream_places(spark, sf_dir):
    """Submissions against places to run and wait as a stream."""
    source = _fed(spark, _in_order(spark, sf_dir, derived(spark, sf_dir, PLACES)), "places")
    return replay.drained(lambda: replay.admitted_jobs(source(), ["scope"]), _folder(spark))


STREAM_PLACES = f"""
with recursive queue as ({twin(PLACES)}),
fold as (
  select distinct scope, 0::bigint as ord, '' as outcome, map {{}}::map(varchar, varchar) as jobs from queue
  union all
  select scope, ord, outcome, case when outcome = 'finished' then map_from_entries(list_filter(map_entries(jobs), lambda e: e.key <> job_id)) when outcome = 'in' then map_concat(jobs, map([job_id], [owner_hash])) else jobs end from (
    select q.*, f.jobs, case when kind = 'finish' then case when map_contains(f.jobs, q.job_id) then 'finished' else 'ignored' end
      when list_contains(map_values(f.jobs), q.owner_hash) then 'owner_busy' when cardinality(f.jobs) >= 6 then 'full' else 'in' end as outcome
    from fold f join queue q on q.scope = f.scope and q.ord = f.ord + 1))
select scope, ord, case when outcome = 'in' then case when cardinality(jobs) <= 2 then 'running' else 'queued' end else outcome end as outcome from fold where ord > 0"""


def stream_expiry(spark, sf_dir):
    """Reports of users by kind, good for three hours after each event, as a stream with timers: those whose end the watermark has passed."""
    ts = F.col("ts").cast("timestamp")
    own = table(spark, sf_dir, "events").select(F.concat(F.col("user_id").cast("string"), F.lit("-"), "event_type").alias("report_id"), ts.alias("ts"), (ts + F.expr("interval 3 hours")).alias("expires_at"))
    source = _fed(spark, own, "reports", files=ALL)
    return replay.drained(lambda: replay.expired(source(), "report_id"), _folder(spark)).select("report_id", F.unix_millis("expired_at").alias("expired_at"))


STREAM_EXPIRY = """
with own as (select user_id || '-' || event_type as report_id, ceil(epoch_us(max(ts) + interval 3 hours) / 1000)::bigint as expired_at from events group by all)
select * from own where expired_at < epoch_ms((select max(ts) from events)) - 600000"""


ONE_SCOPE = "select 1 as scope, doc_id as ord, 'https://a.com/' || cast(doc_id * 7919 % 701 as string) as url, cast(length(coalesce(text, '')) % 499 as string) as content_hash from {documents}"


def kept_documents_by_rounds(spark, sf_dir):
    """All documents as one scope: those that share content, or a made-up URL, with a kept one give way to it."""
    rows = derived(spark, sf_dir, ONE_SCOPE)
    return dedup.kept_in_rounds(rows, ["scope"], _folder(spark)).select(F.col("ord").alias("doc_id"), "kept_ord")


KEPT_DOCUMENTS_BY_ROUNDS = f"""
with recursive queue as (select ord, 'u' || url as u, 'd' || content_hash as d, row_number() over (order by ord) as n from ({twin(ONE_SCOPE)})),
fold as (
  select 0::bigint as n, null::bigint as doc_id, null::bigint as kept_ord, map {{}}::map(varchar, bigint) as seen
  union all
  select q.n, q.ord, coalesce(f.seen[q.u], f.seen[q.d], q.ord), case when coalesce(f.seen[q.u], f.seen[q.d]) is null then map_concat(f.seen, map([q.u, q.d], [q.ord, q.ord])) else f.seen end
  from fold f join queue q on q.n = f.n + 1)
select doc_id, kept_ord from fold where n > 0"""

QUERIES = (artifact_walk, parallel_values, strict_schemas, blob_files, artifact_refresh, stream_ledger, stream_places, stream_expiry, kept_documents_by_rounds)
