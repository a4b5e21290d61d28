"""Joins with a rule: defaults, division, references, containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_default(wanted: DataFrame, made: DataFrame, keys: list[str], value: str, default: str) -> DataFrame:
    """Every wanted row with its value or the default."""
    return wanted.join(made.select(*keys, value), keys, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def missing_references(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    return rows.join(known.select(F.col(known_key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_anti")


def referenced(rows: DataFrame, key: str, uses: DataFrame, use_key: str) -> DataFrame:
    """Rows that something refers to."""
    return rows.join(uses.select(F.col(use_key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_semi")


def all_match(owners: DataFrame, owner: str, parts: DataFrame, good: Column) -> DataFrame:
    """Owners none of whose parts is bad (those without parts too)."""
    bad = parts.where(~F.coalesce(good, F.lit(False))).select(owner).distinct()
    return owners.join(bad, owner, "left_anti")


#: Characters by which quotes of few words are looked up.
GRAM = 3


def quotes_in_texts(quotes: DataFrame, texts: DataFrame, *, quote: str, text: str) -> DataFrame:
    """Pairs of a quote and a text that has it, as equi-joins; an empty quote is in no text.

    A word inside a quote, with something before and after it, is a whole word
    of any text that has the quote: such a quote is looked up by its longest
    inner word. Quotes without one (two words or fewer) are looked up by their
    first characters among all runs of as many characters. Texts go into these
    lookups as 128 bits of hash and their words or runs; the text itself is
    fetched for the pairs found, and confirms."""
    own = quotes.where(F.length(quote) > 0)
    inner = lambda c: F.regexp_extract_all(c, F.lit(r"(?U)\w+"), F.lit(0))
    runs = lambda c, n: F.regexp_extract_all(c, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1))
    longest = F.array_max(F.transform(F.slice(inner(F.col(quote)), 2, F.greatest(F.size(inner(F.col(quote))) - 2, F.lit(0))), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    own = own.withColumn("_word", longest).withColumn("_size", F.when(F.col("_word").isNull(), F.least(F.length(quote), F.lit(GRAM))).otherwise(0))
    own = own.withColumn("_anchor", F.coalesce("_word", F.left(quote, F.col("_size")))).drop("_word")
    keyed = texts.withColumn("_h", F.xxhash64(text)).withColumn("_g", F.xxhash64(F.lit("text"), text))
    sizes = sorted(r["_size"] for r in own.select("_size").distinct().collect())  # at most GRAM + 1
    found = None
    for size in sizes:
        parts = inner(F.col(text)) if size == 0 else runs(F.col(text), size)
        held = keyed.select("_h", "_g", F.explode(F.array_distinct(parts)).alias("_anchor"))
        hit = own.where(F.col("_size") == size).drop("_size").join(held, "_anchor").drop("_anchor")
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        return own.drop("_size", "_anchor").join(texts, F.lit(False))
    return found.distinct().join(keyed, ["_h", "_g"]).where(F.contains(F.col(text), F.col(quote))).drop("_h", "_g")


def evidence_sources(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per citation of a fact, with its source if there is one."""
    cited = facts.select("fact_id", F.posexplode("evidence").alias("ord", "e")).select("fact_id", "ord", "e.source_id", "e.quote")
    return cited.join(sources, "source_id", "left")


def jobs_by_audience(payload: DataFrame, audiences: list[str], finished: DataFrame) -> DataFrame:
    """One job per requested audience and payload row, less finished ones."""
    rows = payload.withColumn("audience", F.explode(F.array(*[F.lit(a) for a in audiences])))
    return rows.join(finished, "audience", "left_anti")


def announcement_violations(announcements: DataFrame, sources: DataFrame, facts: DataFrame) -> DataFrame:
    """Announcements whose source is missing, dated otherwise, or not backed by a fact's evidence."""
    cited = facts.select(F.explode("evidence").alias("e")).select("e.source_id", "e.quote").groupBy("source_id").agg(F.array_join(F.sort_array(F.collect_list("quote")), " ").alias("quoted"))
    own = announcements.join(sources.select("source_id", F.col("published_at").alias("source_date")), "source_id", "left").join(cited, "source_id", "left")
    code = F.when(F.col("source_date").isNull(), "unknown_source").when(F.col("source_date") != F.col("published_at"), "date_mismatch").when(F.col("quoted").isNull(), "no_evidence")
    return own.withColumn("code", code).where("code is not null").select("source_id", "code")


def issue_targets(issues: DataFrame, owners: DataFrame, chunks: DataFrame, artifacts: DataFrame, reports: DataFrame, keys: list[str]) -> DataFrame:
    """Which artifacts issues send back, each within its own job: ``(keys, issue_id, target)``.

    ``issues(keys, issue_id, code, section_id, fact_ids)``, ``owners(keys, fact_id, owner_key)``, ``chunks(keys, owner_key)``,
    ``artifacts(keys, owner_key, coverage, n_gaps)``, ``reports(keys, announced)``. Evidence goes to the owners of its facts,
    to all chunks of the job if there are none; an audience that said it is incomplete is not asked for its count again;
    limitations go to all of the job's artifacts that have gaps; announcements to the news check if there were any;
    insufficient evidence is nobody's to mend. Joined by job, so nothing is gathered and no job meets another's artifacts."""
    one = [*keys, "issue_id"]
    own = issues.where("code <> 'insufficient_evidence'")
    section = F.col("section_id")
    plain = F.when(section.isin("section_company", "section_summary", "section_contradictions"), "dossier").when(F.startswith(section, F.lit("section_opp_")), "strategy")
    direct = own.select(*one, plain.alias("target")).where("target is not null")
    news = own.where(section == "section_announcements").join(reports.where("announced").select(*keys), keys, "left_semi").select(*one, F.lit("verify_news").alias("target"))
    said = own.where(section.rlike(r"\Asection_(?:audience|coverage)_")).withColumn("owner_key", F.concat(F.lit("audience_"), F.element_at(F.split(section, "_"), -1)))
    known = (F.col("coverage") != "complete") & F.col("code").isin("wrong_point_count", "missing_audience")
    said = said.join(artifacts, [*keys, "owner_key"]).where(~known).select(*one, F.col("owner_key").alias("target"))
    limits = own.where(section == "section_limitations").join(artifacts.where("n_gaps > 0").select(*keys, "owner_key"), keys).select(*one, F.col("owner_key").alias("target"))
    evidence = own.where(section == "section_evidence").select(*one, F.explode_outer("fact_ids").alias("fact_id")).join(owners, [*keys, "fact_id"], "left")
    named = evidence.where("owner_key is not null").select(*one, F.col("owner_key").alias("target")).distinct()
    rest = evidence.select(*one).distinct().join(named.select(*one), one, "left_anti")
    fallback = rest.join(chunks.select(*keys, "owner_key").distinct(), keys).select(*one, F.col("owner_key").alias("target"))
    return direct.unionByName(news).unionByName(said).unionByName(limits).unionByName(named).unionByName(fallback)
