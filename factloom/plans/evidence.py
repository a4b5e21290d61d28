"""Queries over quotes, numbers, dates and references. ``benchmark`` texts are quotes, ``documents`` spans,
``labels`` references."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import arrays, numbers, text
from factloom.operators import gates, joins, report
from factloom.operators import dedup as sets
from factloom.sources.tables import table


def values(spark, rows, schema):
    return spark.createDataFrame(list(rows), schema)


def entity_normalize(spark, sf_dir):
    """Customer names with legal suffixes, as keys."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(", Ltd. Inc")).alias("name"))
    return rows.select("c_custkey", text.entity_key(F.col("name")).alias("entity_key"))


ENTITY_NORMALIZE = "select c_custkey, array_to_string(regexp_extract_all(lower(c_name), '[\\pL\\pN_]+'), '') as entity_key from customer"


def entity_in_text_filter(spark, sf_dir):
    """Documents that name an entity of two words, whatever stands between them."""
    return table(spark, sf_dir, "documents").where(text.entity_in_text(F.lit("MIT License Inc."), F.col("text"))).select("doc_id")


ENTITY_IN_TEXT_FILTER = r"select doc_id from documents where regexp_matches(text, '(?i)(^|[^\pL\pN_])mit[^\pL\pN_]+license($|[^\pL\pN_])')"

_NUMBERS = r"""list_distinct(list_transform(regexp_extract_all({x}, '(^|[^\pL\pN_])([0-9]+(?:[.,][0-9]+)*%?)', 2), lambda t:
  case when regexp_full_match(n(t), '[0-9]+(\.[0-9]+)?') then
    coalesce(nullif(regexp_replace(split_part(n(t), '.', 1), '^0+', ''), ''), '0') || coalesce('.' || nullif(regexp_replace(split_part(n(t), '.', 2), '0+$', ''), ''), '')
  else n(t) end || case when t like '%\%' escape '\' then '%' else '' end))"""


def _sql_numbers(x):
    plain = "replace(t, '%', '')"
    own = f"(case when regexp_full_match({plain}, '[0-9]{{1,3}}(,[0-9]{{3}})+(\\.[0-9]+)?') then replace({plain}, ',', '') else {plain} end)"
    return _NUMBERS.replace("{x}", x).replace("n(t)", own)


def numeric_tokens(spark, sf_dir):
    """The numbers of documents that have any, in order."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array_sort(numbers.numeric_tokens(F.col("text"))).alias("n"))
    return rows.where(F.size("n") > 0).select("doc_id", F.array_join("n", " ").alias("numbers"))


NUMERIC_TOKENS = f"select doc_id, array_to_string(list_sort(n), ' ') as numbers from (select doc_id, {_sql_numbers('text')} as n from documents) where len(n) > 0"

def numeric_forms(spark, sf_dir):
    """Forms of numbers, made of each event's: thousands, leading and trailing zeros, percent, and one that is none."""
    n = F.col("event_id") * 1237
    said = F.concat(F.lit("v"), F.col("user_id").cast("string"), F.lit(" "), F.format_number(n, 0), F.lit(" and 00"), F.col("user_id").cast("string"), F.lit(".50%, 12,34"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.array_sort(numbers.numeric_tokens(said)), " ").alias("numbers"))


NUMERIC_FORMS = "select event_id, array_to_string(list_sort(list_distinct([(event_id * 1237)::varchar, case when user_id = 0 then '0' else user_id::varchar end || '.5%', '12,34'])), ' ') as numbers from events"


def numeric_subset_gate(spark, sf_dir):
    """Conversations (as claims) that say a number which the document of the same id lacks."""
    claims = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit(" "), F.col("turn").cast("string"), F.lit(" "), F.coalesce("text", F.lit(""))))), "").alias("claim"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), "text")
    return claims.join(docs, "conv_id").where(~numbers.numbers_within(F.col("claim"), F.col("text"))).select("conv_id")


NUMERIC_SUBSET_GATE = f"""
with claim as (select conv_id, list_distinct(flatten(list({_sql_numbers("(turn || ' ' || coalesce(text, ''))")}))) as n from conversations group by conv_id),
doc as (select doc_id as conv_id, {_sql_numbers('text')} as m from documents)
select conv_id from claim join doc using (conv_id) where not list_has_all(m, n)"""


def quote_containment(spark, sf_dir):
    """Documents that hold a whole benchmark text."""
    quotes = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    return joins.quotes_in_texts(quotes, table(spark, sf_dir, "documents").select("doc_id", "text"), quote="quote", text="text").select("item_id", "doc_id")


QUOTE_CONTAINMENT = "select item_id, doc_id from benchmark b join documents d on contains(d.text, b.text)"


def quote_context_window(spark, sf_dir):
    """Quotes with 120 characters on either side."""
    quotes = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    own = joins.quotes_in_texts(quotes, table(spark, sf_dir, "documents").select("doc_id", "text"), quote="quote", text="text")
    return own.select("item_id", "doc_id", text.excerpt(F.col("text"), F.col("quote")).alias("excerpt"))


QUOTE_CONTEXT_WINDOW = """
select item_id, doc_id, substring(d.text, greatest(strpos(d.text, b.text) - 120, 1), strpos(d.text, b.text) + length(b.text) + 120 - greatest(strpos(d.text, b.text) - 120, 1)) as excerpt
from benchmark b join documents d on contains(d.text, b.text)"""


def unsupported_refs(spark, sf_dir):
    """References (labels, ids moved up by 30) to documents that are not there."""
    refs = table(spark, sf_dir, "labels").select((F.col("doc_id") + 30).alias("ref"))
    return joins.missing_references(refs, "ref", table(spark, sf_dir, "documents"), "doc_id")


UNSUPPORTED_REFS = "select doc_id + 30 as ref from labels where doc_id + 30 not in (select doc_id from documents)"


def referenced_pruning(spark, sf_dir):
    """Documents that a label refers to, with their sources' sizes."""
    kept = joins.referenced(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id", table(spark, sf_dir, "labels"), "doc_id")
    return kept.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


REFERENCED_PRUNING = "select source, count(*) as documents, sum(n_chars)::bigint as chars from documents where doc_id in (select doc_id from labels) group by source"


def audience_coverage_default(spark, sf_dir):
    """Every document with its label's quality, or that it is unavailable."""
    made = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("coverage"))
    return joins.with_default(table(spark, sf_dir, "documents").select("doc_id"), made, ["doc_id"], "coverage", "unavailable")


AUDIENCE_COVERAGE_DEFAULT = "select doc_id, coalesce(quality::varchar, 'unavailable') as coverage from documents left join labels using (doc_id)"


def relational_division(spark, sf_dir):
    """Orders all of whose lines have a quantity of at most 45."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    return joins.all_match(orders, "o_orderkey", lines, F.col("l_quantity") <= 45)


RELATIONAL_DIVISION = "select o_orderkey from orders o where not exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and not coalesce(l.l_quantity <= 45, false))"


def set_equality_gate(spark, sf_dir):
    """Document ids and label ids that are not exactly once on both sides."""
    return sets.set_mismatch(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


SET_EQUALITY_GATE = """
with a as (select doc_id, count(*) as n_left from documents group by 1), b as (select doc_id, count(*) as n_right from labels group by 1)
select * from (select doc_id, coalesce(n_left, 0) as n_left, coalesce(n_right, 0) as n_right from a full join b using (doc_id)) where n_left <> 1 or n_right <> 1"""


def array_set_rules(spark, sf_dir):
    """Sources of each language against those of English: within, disjoint, same."""
    own = table(spark, sf_dir, "documents").groupBy("lang").agg(F.collect_set(F.when(F.col("n_chars") > 3000, F.col("source"))).alias("s"))
    base = own.where("lang = 'en'").select(F.col("s").alias("e"))
    return own.crossJoin(F.broadcast(base)).select("lang", arrays.within(F.col("s"), F.col("e")).alias("within"), arrays.disjoint(F.col("s"), F.col("e")).alias("disjoint"), arrays.same_set(F.col("s"), F.col("e")).alias("same"))


ARRAY_SET_RULES = """
with own as (select lang, coalesce(list(distinct source) filter (n_chars > 3000), []) as s from documents group by lang), e as (select s as e from own where lang = 'en')
select lang, list_has_all(e, s) as within, not list_has_any(s, e) as disjoint, list_has_all(e, s) and list_has_all(s, e) as same from own, e"""


def bounds_gate(spark, sf_dir):
    """Documents and parts outside declared bounds."""
    docs = table(spark, sf_dir, "documents")
    return gates.bounds(docs, ["doc_id"], {"text": ("length", 40, 20_000), "lang": ("enum", ["en", "de", "fr"], None), "source": ("pattern", "src[0-9]", None), "n_chars": ("range", 1, 10_000)})


BOUNDS_GATE = """
select doc_id, 'text:length' as code from documents where not length(text) between 40 and 20000
union all select doc_id, 'lang:enum' from documents where lang not in ('en', 'de', 'fr')
union all select doc_id, 'source:pattern' from documents where not regexp_full_match(source, 'src[0-9]')
union all select doc_id, 'n_chars:range' from documents where not n_chars between 1 and 10000"""


def section_enumeration(spark, sf_dir):
    """Sections of a report on labelled documents: opportunities are toxic ones, audiences languages."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    opportunities = labels.where("toxic = 1").select(F.col("doc_id").alias("opportunity_id"))
    requested = docs.select(F.col("lang").alias("audience")).distinct()
    produced = docs.where("n_chars > 5000").select(F.col("lang").alias("audience")).distinct()
    return report.sections(spark, opportunities, requested, produced, contradictions=labels.where("quality = 0"))


SECTION_ENUMERATION = f"""
select * from (values {', '.join(f"('{s}', 'fixed')" for s in report.FIXED_SECTIONS)}) t(section_id, kind)
union all select 'section_contradictions', 'contradictions' where exists (select 1 from labels where quality = 0)
union all select 'section_' || doc_id, 'opportunity' from labels where toxic = 1
union all select distinct 'section_coverage_' || lang, 'coverage' from documents
union all select distinct 'section_audience_' || lang, 'audience' from documents where n_chars > 5000"""


QUERIES = (
    entity_normalize, entity_in_text_filter, numeric_tokens, numeric_forms, numeric_subset_gate, quote_containment,
    quote_context_window, unsupported_refs, referenced_pruning, audience_coverage_default, relational_division, set_equality_gate, array_set_rules,
    bounds_gate, section_enumeration, 
)
