"""Quotes, numbers, dates and entities of facts held against their spans.

Facts are rows ``(fact_id, entity, statement, time_context, evidence
array<struct<span_id,quote>>, quantities array<struct<numeric_text,unit,
currency,period,span_id>>)``; spans are ``(span_id, source_id, text, ...)``.
Gates give violations as rows with a ``code``; no rows is a pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.numbers import numbers_within, numeric_tokens, quantity_quoted
from factloom.functions.quotes import canonical_quote
from factloom.functions.text import entity_in_text, entity_key, fold


def check_quotes(quotes: DataFrame, spans: DataFrame) -> DataFrame:
    """``quotes(…, span_id, quote)`` with the source's wording (``canonical``) and ``code``
    (``unknown_reference``, ``quote_mismatch`` or null)."""
    own = quotes.join(spans.select("span_id", F.col("text").alias("_text")), "span_id", "left")
    own = own.withColumn("canonical", canonical_quote(F.col("quote"), F.col("_text")))
    return own.withColumn("code", F.when(F.col("_text").isNull(), "unknown_reference").when(F.col("canonical").isNull(), "quote_mismatch")).drop("_text")


def recovered(checked: DataFrame) -> DataFrame:
    """How many quotes were not literal."""
    return checked.agg(F.count_if(F.col("canonical") != F.col("quote")).alias("recovered"))


def _absent(value: Column, quotes: Column) -> Column:
    return F.coalesce(value != "", F.lit(False)) & ~F.exists(quotes, lambda x: F.contains(fold(x), fold(value)))


def quantity_warnings(facts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Quantities by ordinal: ``unknown_reference`` without a quote of the span, ``numeric_or_period_mismatch``
    for a unit, currency or period that is not quoted, ``quantity_warning`` for a figure that is not."""
    each = facts.select(*keys, "fact_id", "evidence", F.posexplode("quantities").alias("quantity_index", "q"))
    quotes = F.transform(F.filter("evidence", lambda e: e["span_id"] == F.col("q.span_id")), lambda e: e["quote"])
    each = each.withColumn("_quotes", quotes)
    hit = quantity_quoted(F.col("q.numeric_text"), F.col("_quotes"))
    near = F.filter("_quotes", lambda x: quantity_quoted(F.col("q.numeric_text"), F.array(x)))
    where = F.when(F.size(near) > 0, near).otherwise(F.col("_quotes"))
    absent = F.lit(False)
    for part in ("unit", "currency", "period"):
        absent = absent | _absent(F.col(f"q.{part}"), where)
    code = F.when(F.size("_quotes") == 0, "unknown_reference").when(absent, "numeric_or_period_mismatch").when(~hit, "quantity_warning")
    return each.withColumn("code", code).where("code is not null").select(*keys, "fact_id", "quantity_index", "q.span_id", "q.numeric_text", "code")


def accept_facts(facts: DataFrame, spans: DataFrame, company: Column) -> DataFrame:
    """``facts`` with ``code``: null accepts; ``numeric_or_period_mismatch`` drops a fact and is counted; others fail the batch.

    Evidence comes back in the source's wording."""
    quotes = facts.select("fact_id", F.posexplode("evidence").alias("_o", "e")).select("fact_id", "_o", "e.span_id", "e.quote")
    checked = check_quotes(quotes, spans)
    own = checked.groupBy("fact_id").agg(
        F.array_sort(F.collect_list(F.struct("_o", "span_id", F.coalesce("canonical", "quote").alias("quote")))).alias("_ev"),
        F.min("code").alias("_quote_code"),
        F.count_if(F.col("canonical") != F.col("quote")).alias("recovered"),
    )
    bad = quantity_warnings(facts).groupBy("fact_id").agg(F.min(F.when(F.col("code") != "quantity_warning", F.col("code"))).alias("_quantity_code"), F.count_if(F.col("code") == "quantity_warning").alias("warnings"))
    out = facts.drop("evidence").join(own, "fact_id", "left").join(bad, "fact_id", "left")
    text = F.array_join(F.transform("_ev", lambda e: e["quote"]), " ")
    code = (
        F.when(entity_key(F.col("entity")) != entity_key(company), "entity_mismatch")
        .when(F.col("_quote_code").isNotNull(), F.col("_quote_code"))
        .when(~numbers_within(F.col("statement"), text), "numeric_or_period_mismatch")
        .when(F.coalesce(F.col("time_context") != "", F.lit(False)) & ~numbers_within(F.col("time_context"), text), "numeric_or_period_mismatch")
        .otherwise(F.col("_quantity_code"))
    )
    evidence = F.transform("_ev", lambda e: F.struct(e["span_id"].alias("span_id"), e["quote"].alias("quote")))
    return out.withColumn("code", code).withColumn("evidence", evidence).fillna(0, ["warnings", "recovered"]).drop("_ev", "_quote_code", "_quantity_code")


def ungrounded(claims: DataFrame, facts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Claims ``(keys, claim_id, text, basis, fact_ids)`` that refer to no fact of their report, or say a number that their facts' quotes lack."""
    own = [*keys, "claim_id"]
    known = facts.select(*keys, "fact_id", F.transform("evidence", lambda e: e["quote"]).alias("_q"))
    cited = claims.select(*own, F.explode_outer("fact_ids").alias("fact_id")).join(known, [*keys, "fact_id"], "left")
    seen = cited.groupBy(*own).agg(F.count_if(F.col("fact_id").isNotNull() & F.col("_q").isNull()).alias("unknown"), F.array_join(F.flatten(F.collect_list("_q")), " ").alias("_text"))
    out = claims.join(seen, own, "left")
    loose = (F.col("basis") == "source_backed") & (F.size(F.array_except(numeric_tokens(F.col("text")), numeric_tokens(F.coalesce("_text", F.lit(""))))) > 0)
    return out.withColumn("code", F.when(F.col("unknown") > 0, "unknown_reference").when(loose, "numeric_or_period_mismatch")).where("code is not null").select(*own, "code")


def relation_warnings(verdicts: DataFrame, company: Column) -> DataFrame:
    """Related sources none of whose quotes names the company."""
    return verdicts.where((F.col("relation") == "related") & ~F.exists("evidence", lambda e: entity_in_text(company, e["quote"]))).select("source_id")


def news_support(verdicts: DataFrame, spans: DataFrame) -> DataFrame:
    """Evidence rows of a news item: first relation quote, executive quotes, date quotes of the date, publication spans; no repeats."""
    part = lambda name, kept: verdicts.select("source_id", F.lit(kept).alias("kind"), F.explode(name).alias("e")).select("source_id", "kind", "e.span_id", "e.quote")
    first = verdicts.select("source_id", F.lit(0).alias("kind"), F.get("evidence", F.lit(0)).alias("e")).select("source_id", "kind", "e.span_id", "e.quote")
    from factloom.functions.dates import dates_in_text

    dated = verdicts.where("published_date is not null").select("source_id", "published_date", F.explode("date_evidence").alias("e"))
    dated = dated.where(F.array_contains(dates_in_text(F.col("e.quote")), F.col("published_date").try_cast("date"))).select("source_id", F.lit(2).alias("kind"), "e.span_id", "e.quote")
    own = spans.where("is_publication").select("source_id", F.lit(3).alias("kind"), "span_id", F.col("text").alias("quote"))
    every = first.unionByName(part("executive_evidence", 1)).unionByName(dated).unionByName(own.join(verdicts.select("source_id"), "source_id", "left_semi"))
    return every.where("span_id is not null").groupBy("source_id", "span_id", "quote").agg(F.min("kind").alias("kind"))


def omission_notices(accepted: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One gap row ``(keys, area, detail)`` for each kind of omission that happened in a report, with its count."""
    n = accepted.groupBy(*keys).agg(F.count_if(F.col("code") == "numeric_or_period_mismatch").alias("omitted"), F.sum("recovered").alias("recovered"))
    row = lambda area, col, what: n.where(F.col(col) > 0).select(*keys, F.lit(area).alias("area"), F.concat(F.col(col).cast("string"), F.lit(what)).alias("detail"))
    return row("facts", "omitted", " facts were left out for a number or period.").unionByName(row("quotes", "recovered", " quotations were given the source's wording."))
