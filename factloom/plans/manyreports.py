"""Gates over many reports in one plan: every rule is a join or a division by report.

Ten documents make a report, with the labels of these documents as opportunities
and issues and two conversations as its audiences. Each derived table is one
SELECT that Spark and DuckDB both read. What is wrong with a report turns with
its number; the SQL of a query states the rule over these tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import LEGAL_SUFFIXES
from factloom.operators import evidence, gates, joins
from factloom.plans import reports as one
from factloom.plans.evidence import _sql_numbers
from factloom.plans.reports import AUDIENCES, FACTS, OPPORTUNITIES, VERDICTS, derived, twin
from factloom.sources.tables import scratch

KEYS = ["report_id"]
_REPORT = "cast(floor(doc_id / 10) as bigint) as report_id"
_PAIR = "cast(floor(conv_id / 2) as bigint) as report_id"

#: One row a report.
HEADERS = f"""
select report_id, case when report_id % 3 = 0 then 'completed' else 'partial' end as status,
  case when report_id % 11 = 5 then '' when report_id % 11 = 6 then 'Fabrikam' when report_id % 11 = 7 then null else 'Contoso Ltd' end as company_text,
  case when report_id % 13 = 6 then 'analysis' else 'source_backed' end as company_basis,
  case when report_id % 7 = 3 then null else 'd' end as description_text, case when report_id % 17 = 2 then 'hypothesis' else 'source_backed' end as description_basis,
  report_id % 5 as n_summary, case when report_id % 2 = 0 then 'found' else 'none_found' end as news_status, cast(100 + report_id % 30 as int) as as_of_day,
  case when report_id % 9 = 4 then 'Contoso Inc.' when report_id % 9 = 5 then 'Fabrikam' else 'Contoso' end as named,
  case when report_id % 8 = 1 then null when report_id % 8 = 2 then 'Fabrikam' else 'CONTOSO Ltd' end as company,
  'd' || cast(report_id * 10 + report_id % 4 + case when report_id % 10 = 7 then 1000000000 else 0 end as string) as homepage,
  'd' || cast(report_id * 10 + case when report_id % 6 = 5 then 9 else report_id % 4 end + case when report_id % 10 = 7 then 1000000000 else 0 end as string) as found,
  case when report_id % 4 = 0 then 'accept' else 'repair' end as decision, report_id % 5 = 2 as contradictions
from (select distinct {_REPORT} from {{documents}}) t"""
#: The sections of every report: those that all have, contradictions, one an opportunity, two an audience.
SECTIONS = f"""
select report_id, section_id from ({HEADERS}) h, (values ('section_company'), ('section_summary'), ('section_evidence'), ('section_sources'), ('section_limitations'), ('section_announcements')) as t(section_id)
union all select report_id, 'section_contradictions' from ({HEADERS}) h where contradictions
union all select {_REPORT}, 'section_opp_' || cast(doc_id as string) from {{labels}}
union all select {_PAIR}, 'section_audience_aud' || cast(conv_id as string) from {{conversations}} group by conv_id
union all select {_PAIR}, 'section_coverage_aud' || cast(conv_id as string) from {{conversations}} group by conv_id"""
#: Reviews of nearly all sections, some of them twice.
REVIEWS = f"""
select report_id, section_id, case when (report_id * 3 + length(section_id) * 5 + ascii(substring(section_id, length(section_id), 1))) % 6 = 0 then 'repair' when (report_id + length(section_id)) % 19 = 0 then 'reject' else 'accept' end as decision
from ({SECTIONS}) s where (report_id * 7 + length(section_id)) % 23 <> 0
union all select report_id, 'section_company', 'accept' from ({HEADERS}) h where report_id % 10 = 3
union all select report_id, 'section_nowhere', 'repair' from ({HEADERS}) h where report_id % 10 = 4"""
#: Labels as issues on sections of all kinds, with a fact of the same report, of the next one, or none.
ISSUES = f"""
select doc_id as issue_id, {_REPORT}, case when toxic = 1 then 'insufficient_evidence' when doc_id % 3 = 0 then 'wrong_point_count' else 'unsupported_claim' end as code,
  case when doc_id % 5 <> 0 then 'f' || cast(doc_id + case when doc_id % 7 = 0 then 10 else 0 end as string) end as fact_id,
  case doc_id % 11 when 0 then 'section_company' when 1 then 'section_contradictions' when 2 then 'section_opp_' || cast(doc_id as string)
    when 3 then 'section_audience_aud' || cast(cast(floor(doc_id / 10) as bigint) * 2 + doc_id % 3 as string) when 4 then 'section_coverage_aud' || cast(cast(floor(doc_id / 10) as bigint) * 2 as string)
    when 5 then 'section_evidence' when 6 then 'section_announcements' when 7 then 'section_sources' when 8 then 'section_summary' when 9 then 'section_lost' else 'section_limitations' end as section_id
from {{labels}}"""
OWNERS = f"select {_REPORT}, 'f' || cast(doc_id as string) as fact_id, 'extract_' || source as owner_key from {{documents}} where doc_id % 10 <> 4"
ARTIFACTS = f"""
select {_PAIR}, 'audience_aud' || cast(conv_id as string) as owner_key, case when conv_id % 3 = 0 then 'complete' else 'limited' end as coverage, conv_id % 5 % 2 as n_gaps from {{conversations}} group by conv_id
union all select report_id, 'dossier', null, report_id % 3 from ({HEADERS}) h"""
#: Claims: turns of a report's conversations on facts of the report, or of the next one.
CLAIMS = f"""
select {_PAIR}, 'c' || cast(conv_id as string) || '_' || cast(turn as string) as claim_id, coalesce(text, '') || case when turn % 3 = 1 then ' 7,777' else '' end as text,
  case when turn % 5 = 4 then 'analysis' else 'source_backed' end as basis, 'f' || cast(conv_id * 5 + turn % 7 as string) as fact_id from {{conversations}}"""
#: Documents are sources with a day, as numbers from the first of 2024; so are the publishers that facts cite.
SOURCES = f"""
select {_REPORT}, 'd' || cast(doc_id as string) as source_id, cast(doc_id % 140 as int) as day, doc_id % 4 <> 0 as is_news from {{documents}} where doc_id % 31 <> 7
union all select distinct {_REPORT}, source, cast(null as int), false from {{documents}} where source <> 'src2'
union all select {_REPORT}, source, cast(null as int), false from {{documents}} where doc_id % 97 = 5 and source <> 'src2'"""
COVERAGE = f"select {_PAIR}, audience, case when conv_id % 7 = 1 then 'unavailable' else coverage end as status from ({AUDIENCES}) a where conv_id % 9 <> 8"
REQUESTED = f"select {_PAIR}, audience from ({AUDIENCES}) a where conv_id % 10 <> 6"
NEWS = f"""
select {_REPORT}, 'd' || cast(doc_id as string) as source_id, cast(doc_id % 140 + toxic as int) as day, case when doc_id % 3 = 1 then 'Qwx' when doc_id % 3 = 2 then 'gadget' end as executive_name,
  case when doc_id % 4 = 3 then 'CEO' end as executive_role from {{labels}} where quality = 0
union all select {_REPORT}, 'd' || cast(doc_id as string), cast(doc_id % 140 as int), null, null from {{labels}} where quality = 0 and doc_id % 29 = 3"""
GAPS = f"select {_REPORT}, 'facts' as area, 'd' || cast(doc_id as string) as detail from {{labels}} where quality = 0"
SERVER_GAPS = f"select distinct {_REPORT}, 'server' as area, lang as detail from {{documents}}"
#: Quotes of announcements besides the facts of documents.
CITED = f"select {_REPORT}, 'n' || cast(doc_id as string) as fact_id, 'd' || cast(doc_id as string) as source_id, case when doc_id % 2 = 0 then 'A gadget, said the CEO' else 'the gadgets' end as quote from {{labels}} where quality = 0"


def stored(df: DataFrame) -> DataFrame:
    """A derived table that many rules read, written once under the shared folder."""
    at = f"{scratch(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _news_facts(spark, sf_dir) -> DataFrame:
    rows = derived(spark, sf_dir, CITED)
    none = F.array().cast("array<struct<numeric_text:string,unit:string,currency:string,period:string,kind:string,span_id:string>>")
    return rows.select("report_id", "fact_id", F.lit("Contoso").alias("entity"), F.array(F.struct("source_id", F.col("source_id").alias("span_id"), "quote")).alias("evidence"), none.alias("quantities"))


def facts(spark, sf_dir) -> DataFrame:
    own = one.facts(spark, sf_dir)
    return own.withColumn("report_id", F.floor(F.substring("fact_id", 2, 30).cast("long") / 10))


def headers(spark, sf_dir) -> DataFrame:
    rows = derived(spark, sf_dir, HEADERS)
    summary = F.when(F.col("n_summary") > 0, F.array(F.lit("s"))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("summary", summary).withColumn("as_of", _day("as_of_day"))


def _day(column: str):
    return F.date_add(F.lit("2024-01-01").cast("date"), F.col(column))


def _issues(spark, sf_dir) -> DataFrame:
    cited = F.when(F.col("fact_id").isNull(), F.array().cast("array<string>")).otherwise(F.array("fact_id"))
    return derived(spark, sf_dir, ISSUES).select("report_id", "issue_id", "code", "section_id", cited.alias("fact_ids"))


def _audiences(spark, sf_dir) -> DataFrame:
    return one.outputs(spark, sf_dir).withColumn("report_id", F.floor(F.substring("audience", 4, 30).cast("long") / 2))


_KEY = "regexp_replace(regexp_replace(lower(coalesce({}, '')), '[^a-z ]', '', 'g'), '( (" + "|".join(LEGAL_SUFFIXES) + "))+$', '')"
_IN = "regexp_matches(lower({}), '(^|[^\\pL\\pN_])' || {} || '($|[^\\pL\\pN_])')"


def omission_notices(spark, sf_dir):
    """What extraction left out, for every report."""
    rows = evidence.accept_facts(facts(spark, sf_dir), one.spans(spark, sf_dir), F.lit("Contoso"))
    return evidence.omission_notices(rows, KEYS)


OMISSION_NOTICES = f"""
with fact as ({twin(FACTS)}), {one._JUDGED}
select doc_id // 10 as report_id, 'facts' as area, count(*) || ' facts were left out for a number or period.' as detail from judged where code = 'numeric_or_period_mismatch' group by 1"""


def verification_gate(spark, sf_dir):
    """Verdicts on documents as sources that do not cover, name or quote as they must, by report."""
    sources = derived(spark, sf_dir, f"select {_REPORT}, 'd' || cast(doc_id as string) as source_id, case when doc_id % 3 = 0 then 'Contoso news' else lang end as title, text from {{documents}}")
    rows = derived(spark, sf_dir, VERDICTS)
    none = F.array().cast("array<struct<span_id:string,quote:string>>")
    given = lambda q: F.when(F.col(q).isNotNull(), F.array(F.struct(F.col("source_id").alias("span_id"), F.col(q).alias("quote")))).otherwise(none)
    report = F.floor(F.substring("source_id", 2, 30).cast("long") / 10).alias("report_id")
    verdicts = rows.select(report, "source_id", "relation", "executive_name", "executive_role", given("quote").alias("evidence"), none.alias("date_evidence"), given("said").alias("executive_evidence"))
    own = sources.select("report_id", "source_id", F.col("source_id").alias("span_id"), "text")
    return gates.source_verification(verdicts, sources, own, headers(spark, sf_dir).select("report_id", "named", "found", "company", "homepage"), KEYS)


VERIFICATION_GATE = f"""
with header as (select *, {_KEY.format('named')} as name, {_KEY.format('company')} as asked from ({twin(HEADERS)})), verdict as ({twin(VERDICTS)}),
source as (select doc_id // 10 as report_id, 'd' || doc_id as source_id, case when doc_id % 3 = 0 then 'Contoso news' else lang end as title, text from documents),
own as (select v.*, s.report_id, title || ' ' || text as whole, text, name, homepage from verdict v join source s using (source_id) join header using (report_id))
select report_id, source_id, 'coverage' as code from source where source_id not in (select source_id from verdict)
union all select report_id, homepage, 'unknown_homepage' from header where (report_id, homepage) not in (select report_id, source_id from source)
union all select report_id, homepage, 'homepage_changed' from header where found <> homepage
union all select report_id, homepage, 'company_changed' from header where asked <> '' and asked <> name
union all select report_id, source_id, 'quote_mismatch' from own where quote is not null and not contains(text, quote)
union all select report_id, source_id, 'homepage_unnamed' from own where source_id = homepage and not {_IN.format('whole', 'name')}
union all select report_id, source_id, 'related_without_evidence' from own where relation = 'related' and quote is null
union all select report_id, source_id, 'related_unnamed' from own where relation = 'related' and not {_IN.format('whole', 'name')}
union all select report_id, source_id, 'role_without_name' from own where executive_role is not null and coalesce(executive_name, '') = ''
union all select report_id, source_id, 'executive_unquoted' from own where coalesce(executive_name, '') <> '' and (said is null or not {_IN.format('said', 'lower(executive_name)')})
union all select report_id, source_id, 'role_unquoted' from own where executive_role is not null and not {_IN.format("coalesce(said, '')", 'lower(executive_role)')}"""


def review_gate(spark, sf_dir):
    """Reviews that miss sections, and decisions that do not fit their issues, by report."""
    decisions = headers(spark, sf_dir).select("report_id", "decision")
    sections, reviews, issues = (stored(d) for d in (derived(spark, sf_dir, SECTIONS), derived(spark, sf_dir, REVIEWS), _issues(spark, sf_dir)))
    return gates.review(sections, reviews, issues, facts(spark, sf_dir), decision=decisions, keys=KEYS)


_CORE = "section_id in ('section_company', 'section_summary', 'section_evidence', 'section_contradictions')"
_REVIEWED = f"""header as ({twin(HEADERS)}), section as ({twin(SECTIONS)}), review as ({twin(REVIEWS)}), issue as ({twin(ISSUES)}),
own as (select * from review semi join section using (report_id, section_id)), known as (select * from issue semi join section using (report_id, section_id)),
refused as (select * from own where decision <> 'accept')"""
REVIEW_GATE = f"""
with {_REVIEWED}
select report_id, section_id, 'coverage' as code from section full join (select report_id, section_id, count(*) as n from review group by all) r using (report_id, section_id)
  where coalesce(n, 0) <> 1 or (report_id, section_id) not in (select report_id, section_id from section)
union all select distinct report_id, section_id, 'unknown_section' from issue anti join section using (report_id, section_id)
union all select distinct report_id, section_id, 'unknown_reference' from issue where fact_id is not null and (report_id, fact_id) not in (select doc_id // 10, 'f' || doc_id from documents)
union all select distinct report_id, section_id, 'server_section_rejected' from refused where section_id = 'section_sources'
union all select distinct report_id, section_id, 'server_section_issue' from known where section_id = 'section_sources'
union all select distinct report_id, section_id, 'vague_core_issue' from known where {_CORE} and code = 'insufficient_evidence'
union all select distinct report_id, section_id, 'core_without_facts' from refused anti join (select * from issue where fact_id is not null) i using (report_id, section_id) where {_CORE}
union all select distinct report_id, section_id, 'rejection_without_issue' from refused anti join issue using (report_id, section_id)
union all select distinct report_id, section_id, 'issue_without_rejection' from own semi join issue using (report_id, section_id) where decision = 'accept'
union all select distinct report_id, section_id, 'accepted_with_issues' from (select report_id, section_id from refused union all select report_id, section_id from issue)
  semi join (select * from header where decision = 'accept') h using (report_id)"""


def review_targets(spark, sf_dir):
    """Which artifacts of its report an issue sends back."""
    owners = derived(spark, sf_dir, OWNERS)
    announced = headers(spark, sf_dir).select("report_id", (F.col("news_status") == "found").alias("announced"))
    return joins.issue_targets(_issues(spark, sf_dir), owners, owners.select("report_id", "owner_key"), derived(spark, sf_dir, ARTIFACTS), announced, KEYS)


REVIEW_TARGETS = f"""
with issue as (select * from ({twin(ISSUES)}) where code <> 'insufficient_evidence'), artifact as ({twin(ARTIFACTS)}), owner as ({twin(OWNERS)}), header as ({twin(HEADERS)}),
evidence as (select report_id, issue_id, owner_key from issue left join owner using (report_id, fact_id) where section_id = 'section_evidence')
select report_id, issue_id, 'dossier' as target from issue where section_id in ('section_company', 'section_summary', 'section_contradictions')
union all select report_id, issue_id, 'strategy' from issue where starts_with(section_id, 'section_opp_')
union all select report_id, issue_id, 'verify_news' from issue join header using (report_id) where section_id = 'section_announcements' and news_status = 'found'
union all select report_id, issue_id, owner_key from issue join artifact a using (report_id) where owner_key = 'audience_' || split_part(section_id, '_', 3)
  and regexp_matches(section_id, '^section_(audience|coverage)_') and not (coverage <> 'complete' and code in ('wrong_point_count', 'missing_audience'))
union all select report_id, issue_id, owner_key from issue join artifact using (report_id) where section_id = 'section_limitations' and n_gaps > 0
union all select report_id, issue_id, owner_key from evidence where owner_key is not null
union all select report_id, issue_id, c.owner_key from evidence e join (select distinct report_id, owner_key from owner) c using (report_id) where e.owner_key is null"""


def report_gate_violations(spark, sf_dir):
    """Reports made of all tables, with everything that does not hold in them."""
    none = F.array().cast("array<struct<quantity_index:int,span_id:string,numeric_text:string>>")
    kept = F.array(F.struct(F.lit(0).alias("quantity_index"), "span_id", "numeric_text"))
    warned = derived(spark, sf_dir, FACTS).select("fact_id", F.when(F.col("numeric_text").isNotNull() & (F.col("doc_id") % 3 == 0), kept).otherwise(none).alias("warnings"))
    own = facts(spark, sf_dir).select("report_id", "fact_id", "entity", "evidence", "quantities").join(warned, "fact_id")
    audiences = _audiences(spark, sf_dir)
    parts = {
        "header": stored(headers(spark, sf_dir)),
        "facts": own.unionByName(_news_facts(spark, sf_dir).withColumn("warnings", none)),
        "claims": derived(spark, sf_dir, CLAIMS).withColumn("fact_ids", F.array("fact_id")).drop("fact_id"),
        "sources": derived(spark, sf_dir, SOURCES).select("report_id", "source_id", _day("day").alias("published_at"), "is_news"),
        "opportunities": derived(spark, sf_dir, OPPORTUNITIES).select(F.floor(F.col("doc_id") / 10).alias("report_id"), "opportunity_id"),
        "requested": derived(spark, sf_dir, REQUESTED),
        "coverage": derived(spark, sf_dir, COVERAGE),
        "audiences": stored(audiences),
        "announcements": derived(spark, sf_dir, NEWS).select("report_id", "source_id", _day("day").alias("published_at"), "executive_name", "executive_role"),
    }
    return gates.report(parts, keys=KEYS)


_POINTS = """
point as (select conv_id, conv_id // 2 as report_id, 'opp_' || (conv_id * 5 + turn - 1) as opportunity_id from conversations where role = 'assistant'),
counted as (select aud.*, aud.conv_id // 2 as report_id, coalesce(n, 0) as n from aud left join (select conv_id, count(*) as n from point group by conv_id) using (conv_id))"""
REPORT_GATE_VIOLATIONS = f"""
with header as ({twin(HEADERS)}),
doc_fact as (select *, doc_id // 10 as report_id from ({twin(FACTS)})),
cited as (select report_id, fact_id, source_id, quote from doc_fact union all select report_id, fact_id, source_id, quote from ({twin(CITED)})),
source as (select * from ({twin(SOURCES)}) semi join header using (report_id)),
opp as (select *, doc_id // 10 as report_id from ({twin(OPPORTUNITIES)})),
aud as (select * from ({twin(AUDIENCES)}) semi join header on header.report_id = conv_id // 2), {_POINTS},
requested as (select * from ({twin(REQUESTED)}) semi join header using (report_id)), covered as (select * from ({twin(COVERAGE)}) semi join header using (report_id)),
claim as (select c.*, {_sql_numbers('c.text')} as said, f.fact_id is null as lost, {_sql_numbers("coalesce(quote, '')")} as quoted from ({twin(CLAIMS)}) c semi join header using (report_id) left join cited f on f.report_id = c.report_id and f.fact_id = c.fact_id),
news as (select * from ({twin(NEWS)}) semi join header using (report_id)),
both_sides as (select c.report_id, c.audience, c.status, a.coverage, a.n, a.n_gaps, a.audience is not null as kept from covered c left join counted a on a.report_id = c.report_id and a.audience = c.audience),
said as (select report_id, source_id, string_agg(quote, ' ') as said from cited group by all),
dated as (select n.*, s.day as published, is_news, as_of_day, coalesce(said, '') as said from news n join source s using (report_id, source_id) join header using (report_id) left join said using (report_id, source_id)),
warned as (select report_id, fact_id, numeric_text is not null and currency is null and not {one._QUOTED} as again, numeric_text is not null and doc_id % 3 = 0 as kept from doc_fact),
found as (
  select report_id, source_id as item, 'repeated_id' as code from source group by all having count(*) > 1
  union all select report_id, claim_id, case when lost then 'unknown_reference' else 'numeric_or_period_mismatch' end from claim where lost or (basis = 'source_backed' and not list_has_all(quoted, said))
  union all select report_id, audience, 'audience_unaccounted' from requested full join (select report_id, audience, status from covered) c using (report_id, audience) where status is null or (report_id, audience) not in (select report_id, audience from requested)
  union all select report_id, audience, 'audience_not_requested' from counted anti join requested using (report_id, audience)
  union all select report_id, audience, 'coverage_mismatch' from both_sides where case when kept then coverage <> status else status <> 'unavailable' end
  union all select report_id, audience, 'audience_inconsistent' from both_sides where (coverage in ('complete', 'limited') and n = 0) or (coverage = 'insufficient_evidence' and n > 0) or (coverage <> 'complete' and n_gaps = 0)
  union all select report_id, audience, 'completed_without' from covered join header using (report_id) where header.status = 'completed' and covered.status <> 'complete'
  union all select report_id, 'report', 'no_core' from header where company_basis <> 'source_backed' or coalesce(company_text, '') = '' or description_basis <> 'source_backed' or coalesce(description_text, '') = '' or n_summary = 0
    or report_id not in (select report_id from cited)
  union all select report_id, 'report', 'news_status' from header where (news_status = 'found') <> (report_id in (select report_id from news))
  union all select report_id, fact_id, 'unknown_source' from cited anti join source using (report_id, source_id)
  union all select report_id, fact_id, 'other_entity' from (select report_id, fact_id, entity from doc_fact union all select report_id, fact_id, 'Contoso' from ({twin(CITED)})) f join header using (report_id) where {_KEY.format('entity')} <> {_KEY.format('company_text')}
  union all select report_id, fact_id, 'warnings_changed' from warned where again <> kept
  union all select distinct report_id, audience, 'unknown_opportunity' from counted join point using (conv_id, report_id) anti join opp using (report_id, opportunity_id)
  union all select distinct report_id, source_id, 'unknown_source' from news anti join source using (report_id, source_id)
  union all select report_id, source_id, 'repeated_announcement' from news group by all having count(*) > 1
  union all select report_id, source_id, 'date_out_of_window' from dated where day not between as_of_day - 90 and as_of_day
  union all select report_id, source_id, 'date_mismatch' from dated where day is distinct from published
  union all select report_id, source_id, 'not_news' from dated where not is_news
  union all select report_id, source_id, 'executive_uncited' from dated where (executive_name is not null and not {_IN.format('said', 'lower(executive_name)')}) or (executive_role is not null and not {_IN.format('said', 'lower(executive_role)')})
  union all select report_id, source_id, 'role_without_name' from dated where executive_role is not null and executive_name is null)
select report_id, item, code from found"""


def publish_gate(spark, sf_dir):
    """What of reviewed reports goes out, and what holds the others back."""
    audiences, reviews, heads = stored(_audiences(spark, sf_dir)), stored(derived(spark, sf_dir, DECISIONS)), stored(headers(spark, sf_dir).select("report_id", "contradictions"))
    opportunities = stored(derived(spark, sf_dir, OPPORTUNITIES).select(F.floor(F.col("doc_id") / 10).alias("report_id"), "opportunity_id"))
    out = gates.published(opportunities, audiences, derived(spark, sf_dir, NEWS), derived(spark, sf_dir, GAPS), derived(spark, sf_dir, SERVER_GAPS), audiences.select("report_id", "audience"), reviews, heads, KEYS, stored=stored)
    row = lambda rows, kind, item: rows.select("report_id", F.lit(kind).alias("kind"), item.cast("string").alias("item"))
    detail = F.when(F.col("area").isin("facts", "server"), F.col("detail")).when(F.col("area") == "audience_coverage", F.split_part("detail", F.lit(" "), F.lit(1)))
    return gates.union(
        row(out["opportunities"], "opportunity", F.col("opportunity_id")),
        row(out["audiences"], "audience", F.col("audience")),
        row(out["coverage"], "coverage", F.concat_ws(":", "audience", "status")),
        row(out["announcements"].select("report_id", "source_id").distinct(), "news", F.col("source_id")),
        row(out["gaps"], "gap", F.concat_ws(":", "area", detail)),
        row(out["status"], "status", F.col("status")),
        row(gates.publishable(reviews, reports=heads, keys=KEYS), "held", F.col("section_id")),
    )


#: Decisions on all sections; core ones fail in some reports.
DECISIONS = f"""
select report_id, section_id, case when section_id in ('section_company', 'section_summary', 'section_evidence', 'section_sources', 'section_contradictions') then case when (report_id * 7 + length(section_id)) % 13 = 0 then 'repair' else 'accept' end
  when section_id = 'section_limitations' then case when report_id % 3 = 1 then 'repair' else 'accept' end
  when section_id = 'section_announcements' then case when report_id % 4 = 1 then 'reject' else 'accept' end
  when report_id % 5 = 0 then 'accept' when (report_id + length(section_id) * 3 + ascii(substring(section_id, length(section_id), 1))) % 5 = 0 then 'repair' else 'accept' end as decision
from ({SECTIONS}) s"""
PUBLISH_GATE = f"""
with header as ({twin(HEADERS)}), decision as ({twin(DECISIONS)}), accepted as (select report_id, section_id from decision where decision = 'accept'),
needed as (select report_id, unnest(['section_company', 'section_summary', 'section_evidence', 'section_sources'] || case when contradictions then ['section_contradictions'] else [] end) as section_id from header),
held as (select * from needed anti join accepted using (report_id, section_id)),
free as (select report_id from header where report_id not in (select report_id from held)),
aud as ({twin(AUDIENCES)}), {_POINTS},
opp as (select *, 'section_' || opportunity_id as section_id from (select *, doc_id // 10 as report_id from ({twin(OPPORTUNITIES)})) semi join free using (report_id)),
kept as (select report_id, opportunity_id from opp semi join accepted using (report_id, section_id)),
mine as (select * from counted semi join free using (report_id)),
loose as (select conv_id from point anti join kept using (report_id, opportunity_id)),
said as (select * from mine where conv_id not in (select conv_id from loose) and (report_id, 'section_audience_' || audience) in (select report_id, section_id from accepted) and (report_id, 'section_coverage_' || audience) in (select report_id, section_id from accepted)),
covered as (select m.report_id, m.audience, coalesce(s.coverage, 'unavailable') as status from mine m left join said s using (report_id, audience)),
news as (select distinct report_id, source_id from ({twin(NEWS)}) semi join free using (report_id)),
ok as (select report_id, list(section_id) as sections from accepted group by report_id),
state as (select report_id, list_contains(sections, 'section_limitations') as limits, list_contains(sections, 'section_announcements') as announced from free join ok using (report_id))
select report_id, 'opportunity' as kind, opportunity_id as item from kept
union all select report_id, 'audience', audience from said
union all select report_id, 'coverage', audience || ':' || status from covered
union all select report_id, 'news', source_id from news join state using (report_id) where announced
union all select distinct report_id, 'gap', area || ':' || detail from (select g.*, false as own from ({twin(GAPS)}) g union all select g.*, true from ({twin(SERVER_GAPS)}) g) join state using (report_id) where own <> limits
union all select report_id, 'gap', 'audience_coverage:' || upper(audience) from mine anti join said using (report_id, audience)
union all select report_id, 'gap', 'quality_review' from state where not limits
union all select report_id, 'gap', 'opportunities' from state where (select count(*) from opp where opp.report_id = state.report_id) <> (select count(*) from kept where kept.report_id = state.report_id)
union all select report_id, 'gap', 'official_news' from state where not announced and report_id in (select report_id from news)
union all select report_id, 'status', case when report_id in (select report_id from covered where status <> 'complete') or report_id in (select report_id from decision where decision <> 'accept') then 'partial' else 'completed' end from free
union all select report_id, 'held', section_id from held"""

QUERIES = (omission_notices, verification_gate, review_gate, review_targets, report_gate_violations, publish_gate)
