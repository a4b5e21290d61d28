"""Queries of evidence, gates and reports over tables derived from the test tables.

Each derived table is one SELECT that Spark and DuckDB both read, so a query
and its SQL start from the same rows and apply the rule each in its own way.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import evidence, gates, joins, report
from factloom.functions.quotes import canonical_quote
from factloom.plans.evidence import _sql_numbers
from factloom.sources.tables import table

#: One candidate fact per document; what is wrong with it turns with doc_id.
FACTS = """
select 'f' || cast(doc_id as string) as fact_id, source as source_id, lang, doc_id, text,
  case doc_id % 10 when 6 then 'd-' || cast(doc_id as string) else 'd' || cast(doc_id as string) end as span_id,
  case doc_id % 10 when 5 then 'qqq zzz xxx qqq' else substring(text, 11, 80) end as quote,
  case doc_id % 10 when 3 then 'Fabrikam' when 4 then 'CONTOSO, Inc.' else 'Contoso' end as entity,
  case doc_id % 10 when 2 then 'It grew by 7,777.' else 'It grew.' end as statement,
  case doc_id % 10 when 7 then '2031' end as time_context,
  case doc_id % 10 when 8 then '7' when 9 then '7' end as numeric_text,
  case doc_id % 10 when 9 then 'zloty' end as currency
from {documents}"""
#: One opportunity per labelled document.
OPPORTUNITIES = """
select 'opp_' || cast(doc_id as string) as opportunity_id, doc_id, doc_id % 400 as priority,
  case when doc_id % 6 = 1 then 'analysis' else 'source_backed' end as signal,
  case when doc_id % 6 = 2 then 'source_backed' else 'hypothesis' end as hypothesis,
  case when doc_id % 6 = 3 then 'unknown' else 'analysis' end as outcome,
  case when doc_id % 6 = 4 then '10 %' end as target,
  'f' || cast(doc_id + toxic as string) as baseline, quality as prerequisites
from {labels}"""
#: One audience output per conversation: its assistant turns are the talk points.
AUDIENCES = """
select c.conv_id, 'aud' || cast(c.conv_id as string) as audience, 'aud' || cast(c.conv_id + case when c.conv_id % 11 = 0 then 1 else 0 end as string) as asked,
  case when c.conv_id % 4 = 0 then 'complete' when c.conv_id % 4 = 1 then 'limited' when c.conv_id % 4 = 2 then 'insufficient_evidence' else 'complete' end as coverage,
  case when c.conv_id % 3 = 0 then 0 else 1 end as n_gaps
from {conversations} c group by c.conv_id"""


def derived(spark, sf_dir, sql: str):
    names = [n for n in ("documents", "labels", "conversations", "events", "pages", "benchmark", "customer") if "{" + n + "}" in sql]
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def twin(sql: str) -> str:
    for n in ("documents", "labels", "conversations", "events", "pages", "benchmark", "customer"):
        sql = sql.replace("{" + n + "}", n)
    return sql


def facts(spark, sf_dir):
    rows = derived(spark, sf_dir, FACTS)
    quantity = F.struct("numeric_text", F.lit(None).cast("string").alias("unit"), "currency", F.lit(None).cast("string").alias("period"), F.lit("actual").alias("kind"), "span_id")
    cited = F.array(F.struct("source_id", "span_id", "quote"))
    none = F.array().cast("array<struct<numeric_text:string,unit:string,currency:string,period:string,kind:string,span_id:string>>")
    return rows.select("fact_id", "source_id", "entity", "statement", "time_context", F.col("lang").alias("category"), cited.alias("evidence"), F.when(F.col("numeric_text").isNotNull(), F.array(quantity)).otherwise(none).alias("quantities"))


def spans(spark, sf_dir):
    return derived(spark, sf_dir, "select 'd' || cast(doc_id as string) as span_id, text, source as source_id, lang as section, doc_id % 7 as page from {documents}")


_QUOTED = "regexp_matches(quote, '(^|[^0-9.,])' || numeric_text || '($|[^0-9.,])')"
_JUDGED = f"""
judged as (select *, case
  when regexp_replace(regexp_replace(lower(entity), '[^a-z]', '', 'g'), 'inc$', '') <> 'contoso' then 'entity_mismatch'
  when span_id like 'd-%' then 'unknown_reference'
  when not contains(text, quote) then 'quote_mismatch'
  when not list_has_all({_sql_numbers('quote')}, {_sql_numbers('statement')}) then 'numeric_or_period_mismatch'
  when time_context is not null and not list_has_all({_sql_numbers('quote')}, {_sql_numbers('time_context')}) then 'numeric_or_period_mismatch'
  when currency is not null and not contains(lower(quote), currency) then 'numeric_or_period_mismatch' end as code,
  (numeric_text is not null and currency is null and not {_QUOTED})::bigint as warnings
from fact)"""


def fact_acceptance(spark, sf_dir):
    """Candidate facts of all documents against their spans: accepted, left out, or why the batch fails."""
    out = evidence.accept_facts(facts(spark, sf_dir), spans(spark, sf_dir), F.lit("Contoso"))
    return out.select("fact_id", "code", F.col("warnings").cast("long").alias("warnings"))


FACT_ACCEPTANCE = f"with fact as ({twin(FACTS)}), {_JUDGED} select fact_id, code, warnings from judged"


def quantity_gate(spark, sf_dir):
    """Quantities by ordinal that their quotes do not bear out."""
    out = evidence.quantity_warnings(facts(spark, sf_dir))
    return out.select("fact_id", F.col("quantity_index").cast("long").alias("quantity_index"), "numeric_text", "code")


QUANTITY_GATE = f"""
with fact as ({twin(FACTS)})
select fact_id, 0::bigint as quantity_index, numeric_text, case when currency is not null and not contains(lower(quote), currency) then 'numeric_or_period_mismatch' else 'quantity_warning' end as code
from fact where numeric_text is not null and ((currency is not null and not contains(lower(quote), currency)) or not {_QUOTED})"""


def quote_gate(spark, sf_dir):
    """Quotes that are not in their spans, by what is wrong."""
    rows = derived(spark, sf_dir, FACTS).select("fact_id", "span_id", "quote")
    return evidence.check_quotes(rows, spans(spark, sf_dir)).groupBy("code").agg(F.count("*").alias("n"))


QUOTE_GATE = f"with fact as ({twin(FACTS)}) select case when span_id like 'd-%' then 'unknown_reference' when not contains(text, quote) then 'quote_mismatch' end as code, count(*) as n from fact group by 1"


def quote_fuzzy_match(spark, sf_dir):
    """Benchmark texts with one word's ending changed, given the source's wording."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", "text", F.regexp_replace("text", r"(?U)\A(\p{L}+ \p{L}{10,})(?=\s)", "$1s").alias("quote"))
    return rows.select("item_id", canonical_quote(F.col("quote"), F.col("text")).alias("canonical"))


QUOTE_FUZZY_MATCH = r"""select item_id, case when regexp_matches(text, '^\pL+ \pL{10,}\s') then regexp_extract(text, '(?s)[\pL\pN].*[\pL\pN%]') else text end as canonical from benchmark"""


def grounding_gate(spark, sf_dir):
    """Claims (turns of conversations) on facts that are not there, or with numbers that the facts' quotes lack."""
    claims = derived(spark, sf_dir, CLAIMS).withColumn("fact_ids", F.array("fact_id")).drop("fact_id")
    return evidence.ungrounded(claims, facts(spark, sf_dir))


CLAIMS = """
select 'c' || cast(conv_id as string) || '_' || cast(turn as string) as claim_id, coalesce(text, '') || case when turn % 3 = 1 then ' 7,777' else '' end as text,
  case when turn % 5 = 4 then 'analysis' else 'source_backed' end as basis, 'f' || cast(conv_id + turn * 13 as string) as fact_id from {conversations}"""
GROUNDING_GATE = f"""
with fact as ({twin(FACTS)}), claim as ({twin(CLAIMS)}),
own as (select claim_id, basis, {_sql_numbers('claim.text')} as said, fact.fact_id is null as lost, {_sql_numbers("coalesce(quote, '')")} as quoted from claim left join fact using (fact_id))
select claim_id, case when lost then 'unknown_reference' else 'numeric_or_period_mismatch' end as code from own where lost or (basis = 'source_backed' and not list_has_all(quoted, said))"""


def grounded_text_gate(spark, sf_dir):
    """Turns as claims: unknown ones say nothing, others have text and references."""
    rows = derived(spark, sf_dir, GROUNDED)
    ids = F.when(F.col("refs") == 0, F.array().cast("array<string>")).when(F.col("refs") == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("a")))
    return gates.grounded_text(rows.select("claim_id", "text", "basis", ids.alias("fact_ids")), ["claim_id"])


GROUNDED = """
select cast(conv_id as string) || '_' || cast(turn as string) as claim_id, case when turn % 4 = 3 then null when turn % 4 = 2 then '  ' else text end as text,
  case when conv_id % 3 = 0 then 'unknown' else 'analysis' end as basis, conv_id % 5 % 3 as refs from {conversations}"""
GROUNDED_TEXT_GATE = f"""
with claim as ({twin(GROUNDED)})
select claim_id, 'unknown_with_content' as code from claim where basis = 'unknown' and (text is not null or refs > 0)
union all select claim_id, 'known_without_content' from claim where basis <> 'unknown' and (trim(coalesce(text, '')) = '' or refs = 0)
union all select claim_id, 'repeated_reference' from claim where refs = 2"""


def citation_excerpts(spark, sf_dir):
    """Each cited place once, with its surroundings."""
    out = report.citations(facts(spark, sf_dir), spans(spark, sf_dir))
    return out.where("excerpt is not null").select("source_id", "span_id", F.sha2("excerpt", 256).alias("digest"))


CITATION_EXCERPTS = f"""
with fact as ({twin(FACTS)}), place as (select *, strpos(text, quote) as p, greatest(strpos(text, quote) - 120, 1) as b from fact where span_id not like 'd-%' and contains(text, quote) and quote <> '')
select source_id, span_id, sha256(substring(text, b, p + length(quote) + 120 - b)) as digest from place
union all select source_id, span_id, sha256(substring(text, 1, 120)) from fact where span_id not like 'd-%' and quote = ''"""


def strategy_gate(spark, sf_dir):
    """Opportunities that break the rules of a strategy."""
    rows = derived(spark, sf_dir, OPPORTUNITIES)
    needs = F.when(F.col("prerequisites") == 1, F.array(F.lit("p"))).otherwise(F.array().cast("array<string>"))
    own = rows.select("opportunity_id", "priority", F.col("signal").alias("signal_basis"), F.col("hypothesis").alias("hypothesis_basis"), F.col("outcome").alias("outcome_basis"), F.array(F.struct("target", F.array("baseline").alias("baseline_fact_ids"))).alias("success_criteria"), needs.alias("prerequisites"))
    return gates.strategy(own, facts(spark, sf_dir), [])


STRATEGY_GATE = f"""
with opp as ({twin(OPPORTUNITIES)}), fact as ({twin(FACTS)})
select min(opportunity_id) as opportunity_id, 'repeated_priority' as code from opp group by priority having count(*) > 1
union all select opportunity_id, 'signal_unsupported' from opp where signal <> 'source_backed'
union all select opportunity_id, 'hypothesis_as_fact' from opp where hypothesis not in ('hypothesis', 'analysis')
union all select opportunity_id, 'outcome_as_fact' from opp where outcome not in ('hypothesis', 'analysis')
union all select opportunity_id, 'target_set' from opp where target is not null
union all select opportunity_id, 'no_prerequisite' from opp where prerequisites <> 1
union all select distinct opportunity_id, 'baseline_without_figure' from opp where baseline not in (select fact_id from fact where numeric_text is not null)"""


def outputs(spark, sf_dir):
    rows = derived(spark, sf_dir, AUDIENCES)
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("opp_"), (F.col("conv_id") * 5 + F.col("turn") - 1).cast("string")).alias("opportunity_id"), F.substring("text", 1, 3).alias("seller_line")))).alias("l"))
    points = F.transform(F.coalesce("l", F.array().cast("array<struct<turn:bigint,opportunity_id:string,seller_line:string>>")), lambda x: F.struct(x["opportunity_id"].alias("opportunity_id"), x["seller_line"].alias("seller_line")))
    gaps = F.when(F.col("n_gaps") == 1, F.array(F.lit("g"))).otherwise(F.array().cast("array<string>"))
    return rows.join(turns, "conv_id", "left").select("audience", "asked", "coverage", points.alias("talk_points"), gaps.alias("evidence_gaps"))


def audience_gate(spark, sf_dir):
    """Audience outputs that break the rules of counts, lines and references."""
    return gates.audience(outputs(spark, sf_dir), derived(spark, sf_dir, OPPORTUNITIES).select("opportunity_id"), ["audience"])


_POINTS = """
point as (select conv_id, 'opp_' || (conv_id * 5 + turn - 1) as opportunity_id, trim(regexp_replace(lower(substring(text, 1, 3)), '\\s+', ' ', 'g')) as line from conversations where role = 'assistant'),
counted as (select aud.*, coalesce(n, 0) as n, coalesce(lines, 0) as lines from aud left join (select conv_id, count(*) as n, count(distinct replace(coalesce(line, ''), 'ß', 'ss')) as lines from point group by conv_id) using (conv_id))"""
AUDIENCE_GATE = f"""
with aud as ({twin(AUDIENCES)}), opp as ({twin(OPPORTUNITIES)}), {_POINTS}
select audience, 'other_audience' as code from counted where audience <> asked
union all select audience, 'complete_count' from counted where coverage = 'complete' and n <> 3
union all select audience, 'limited_count' from counted where coverage = 'limited' and n not between 1 and 2
union all select audience, 'insufficient_count' from counted where coverage = 'insufficient_evidence' and n <> 0
union all select audience, 'too_many' from counted where n > 3
union all select audience, 'no_gap' from counted where coverage <> 'complete' and n_gaps = 0
union all select audience, 'repeated_line' from counted where n <> lines
union all select distinct audience, 'unknown_opportunity' from aud join point using (conv_id) where opportunity_id not in (select opportunity_id from opp)"""


def dossier_gate(spark, sf_dir):
    """Dossiers, one for each language, against sources and facts."""
    rows = derived(spark, sf_dir, DOSSIERS)
    own = table(spark, sf_dir, "documents").groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("known"))
    built = rows.join(own, "lang").select(
        "lang", "status", F.lit("Contoso").alias("company"), "company_text", "company_basis",
        F.when(F.col("k") == 1, F.concat(F.slice("known", 1, 1), F.lit(["nowhere"]))).when(F.col("k") == 2, F.concat(F.slice("known", 1, 1), F.slice("known", 1, 1))).otherwise(F.slice("known", 1, 2)).alias("included"),
        F.when(F.col("k") == 2, F.slice("known", 1, 1)).otherwise(F.slice("known", 3, 1)).alias("excluded"), "known",
        "description_text", "description_basis", F.when(F.col("k") == 3, F.array().cast("array<string>")).otherwise(F.array(F.lit("s"))).alias("summary"),
    )
    own_facts = facts(spark, sf_dir).withColumnRenamed("category", "lang")
    used = own_facts.groupBy("lang").agg(F.collect_list("fact_id").alias("fact_ids"))
    return gates.dossier(built.join(used, "lang"), own_facts, ["lang"])


DOSSIERS = """
select lang, k, case when k = 0 then 'ambiguous' else 'matched' end as status, case when k = 1 then 'Fabrikam' when k = 2 then null else 'Contoso Ltd' end as company_text,
  'source_backed' as company_basis, case when k = 2 then null else 'd' end as description_text, case when k = 0 then 'analysis' else 'source_backed' end as description_basis
from (select lang, ascii(lang) % 4 as k from {documents} group by lang) t"""
DOSSIER_GATE = f"""
with own as (select lang, list_sort(list(distinct source)) as known from documents group by lang),
dossier as (select d.*, known, case k when 1 then [known[1], 'nowhere'] when 2 then [known[1], known[1]] else known[1:2] end as included, case when k = 2 then known[1:1] else known[3:3] end as excluded
  from ({twin(DOSSIERS)}) d join own using (lang))
select lang, 'ambiguous' as code from dossier where status <> 'matched'
union all select lang, 'unknown_source' from dossier where not list_has_all(known, included || excluded)
union all select lang, 'repeated_source' from dossier where len(included) <> len(list_distinct(included)) or len(excluded) <> len(list_distinct(excluded))
union all select lang, 'overlap' from dossier where list_has_any(included, excluded)
union all select lang, 'identity_changed' from dossier where company_text is null or not starts_with(company_text, 'Contoso')
union all select lang, 'no_profile' from dossier where description_text is null or description_basis <> 'source_backed' or k = 3
union all select distinct d.lang, 'cites_outside' from dossier d join documents s on s.lang = d.lang where not list_contains(included, s.source)"""


def identity_facts(spark, sf_dir):
    """The fact that names each source's company, from included sources whose quote names it."""
    rows = derived(spark, sf_dir, NAMING)
    own = rows.select("lang", "category", "fact_id", F.array(F.struct("source_id", "quote")).alias("evidence"))
    kept = rows.groupBy("lang").agg(F.collect_set(F.when(F.col("source_id") != "src1", F.col("source_id"))).alias("included")).withColumn("company", F.lit("Contoso Inc"))
    return gates.identity_fact(own, kept, ["lang"])


NAMING = """
select lang, 'f' || cast(doc_id as string) as fact_id, source as source_id,
  case doc_id % 4 when 0 then 'financial' when 1 then 'product_workflow' when 2 then 'customers' else case when doc_id % 9 = 0 then 'company' else 'offering' end end as category,
  case when doc_id % 5 = 0 then 'The contoso plant' when doc_id % 5 = 1 then 'contosos' else substring(text, 1, 30) end as quote from {documents}"""
IDENTITY_FACTS = f"""
select lang, arg_min(fact_id, ((category <> 'company')::int, (category not in ('company', 'offering', 'product_workflow'))::int, fact_id)) as identity_fact_id
from ({twin(NAMING)}) where source_id <> 'src1' and regexp_matches(lower(quote), '(^|[^\\pL\\pN_])contoso($|[^\\pL\\pN_])') group by lang"""


#: A dossier for ten documents each: its name rests on one of them, and one source is left out.
BOUND = """
select report_id, lang_fact, source_id, category, case when doc_id % 3 = 0 then 'The contoso plant' when doc_id % 3 = 1 then 'contosos' else 'no name here' end as quote, doc_id from (
  select cast(floor(doc_id / 4) as bigint) as report_id, 'f' || cast(doc_id as string) as lang_fact, source as source_id, doc_id,
    case doc_id % 4 when 0 then 'financial' when 1 then 'product_workflow' when 2 then 'customers' else 'company' end as category from {documents}) d"""


def identity_rebinding(spark, sf_dir):
    """What each dossier's name rests on: the facts that it cites, another one, or nothing."""
    rows = derived(spark, sf_dir, BOUND)
    own = rows.select("report_id", "category", F.col("lang_fact").alias("fact_id"), F.array(F.struct("source_id", "quote")).alias("evidence"))
    kept = rows.groupBy("report_id").agg(F.collect_set(F.when(F.col("doc_id") % 5 != 2, F.col("source_id"))).alias("included"), F.array(F.min_by("lang_fact", "doc_id")).alias("company_fact_ids"))
    out = gates.rebound(kept.withColumn("company", F.lit("Contoso Inc")), own, ["report_id"])
    return out.select("report_id", F.array_join("fact_ids", ",").alias("fact_ids"), "rebound", "code")


IDENTITY_REBINDING = f"""
with own as (select *, regexp_matches(lower(quote), '(^|[^\\pL\\pN_])contoso($|[^\\pL\\pN_])') as names from ({twin(BOUND)})),
included as (select distinct report_id, source_id from own where doc_id % 5 <> 2),
cited as (select report_id, arg_min(lang_fact, doc_id) as fact_id, arg_min(names, doc_id) as names from own group by report_id),
best as (select report_id, arg_min(lang_fact, ((category <> 'company')::int, (category not in ('company', 'offering', 'product_workflow'))::int, lang_fact)) as fact_id from own semi join included using (report_id, source_id) where names group by report_id)
select report_id, case when names then c.fact_id else b.fact_id end as fact_ids, not names and b.fact_id is not null as rebound, case when not names and b.fact_id is null then 'identity_unsupported' end as code from cited c left join best b using (report_id)"""


VERDICTS = """
select 'd' || cast(doc_id as string) as source_id, case when doc_id % 4 = 0 then 'unrelated' else 'related' end as relation,
  case when doc_id % 5 = 0 then null when doc_id % 5 = 1 then 'qqq zzz xxx' else substring(text, 3, 30) end as quote,
  case when doc_id % 6 = 1 then 'Qwx' when doc_id % 6 = 2 then regexp_extract(text, '[A-Za-z][A-Za-z][A-Za-z]+', 0) end as executive_name, case when doc_id % 12 = 3 then 'CEO' end as executive_role,
  case when doc_id % 6 in (1, 2, 3) then text end as said from {documents} where doc_id % 17 <> 5"""
def relation_warnings(spark, sf_dir):
    """Related sources none of whose quotes names the company."""
    rows = derived(spark, sf_dir, NAMING)
    verdicts = rows.select(F.col("fact_id").alias("source_id"), F.when(F.col("category") == "financial", "unrelated").otherwise("related").alias("relation"), F.array(F.struct("quote")).alias("evidence"))
    return evidence.relation_warnings(verdicts, F.lit("Contoso"))


RELATION_WARNINGS = f"select fact_id as source_id from ({twin(NAMING)}) where category <> 'financial' and not regexp_matches(lower(quote), '(^|[^\\pL\\pN_])contoso($|[^\\pL\\pN_])')"


def announcement_gate(spark, sf_dir):
    """Announcements (labels) whose source is missing, has another date, or is not cited."""
    cited = derived(spark, sf_dir, NEWS_CITED).select(F.array(F.struct("source_id", "quote")).alias("evidence"))
    return joins.announcement_violations(derived(spark, sf_dir, NEWS), derived(spark, sf_dir, NEWS_SOURCES), cited)


NEWS = "select cast(doc_id + toxic * 100000000 as string) as source_id, cast('2024-01-01' as date) as published_at from {labels}"
NEWS_SOURCES = "select cast(doc_id as string) as source_id, case when doc_id % 5 = 0 then cast('2024-01-02' as date) else cast('2024-01-01' as date) end as published_at from {documents}"
NEWS_CITED = "select cast(doc_id as string) as source_id, text as quote from {documents} where doc_id % 3 = 0"
ANNOUNCEMENT_GATE = f"""
with own as (select n.source_id, case when s.published_at is null then 'unknown_source' when s.published_at <> n.published_at then 'date_mismatch' when n.source_id not in (select source_id from ({twin(NEWS_CITED)})) then 'no_evidence' end as code
  from ({twin(NEWS)}) n left join ({twin(NEWS_SOURCES)}) s using (source_id))
select * from own where code is not null"""

QUERIES = (
    fact_acceptance, quantity_gate, quote_gate, quote_fuzzy_match, grounding_gate, grounded_text_gate, citation_excerpts, strategy_gate, audience_gate,
    dossier_gate, identity_facts, identity_rebinding, relation_warnings, announcement_gate,
)
