"""Gates: queries that return violating rows with a code. No rows is a pass."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.arrays import all_different, disjoint, within
from factloom.functions.text import entity_in_text, entity_key, talk_line
from factloom.operators.dedup import set_mismatch
from factloom.operators.evidence import check_quotes, quantity_warnings, ungrounded


def violations(rows: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule; a rule is a condition that must not be true."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in rules.items()]))
    return rows.select(*keys, F.explode(broken).alias("code"))


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def bounds(rows: DataFrame, keys: list[str], limits: dict[str, tuple[str, object, object]]) -> DataFrame:
    """Declared bounds. ``limits``: column to ``("length" | "size" | "range", low, high)``, ``("enum", values, _)`` or ``("pattern", regex, _)``."""
    rules = {}
    for name, (kind, low, high) in limits.items():
        c = F.col(name)
        if kind == "enum":
            bad = ~c.isin(*low)
        elif kind == "pattern":
            bad = ~F.regexp_like(c, F.lit(rf"\A(?:{low})\z"))
        else:
            measure = {"length": F.length, "size": F.size, "range": lambda x: x}[kind](c)
            bad = ~measure.between(low, high)
        rules[f"{name}:{kind}"] = bad
    return violations(rows, keys, rules)


def grounded_text(claims: DataFrame, keys: list[str]) -> DataFrame:
    """Unknown claims have no text and no references; others have both, references once each."""
    blank, n = F.trim(F.coalesce("text", F.lit(""))) == "", F.size(F.coalesce("fact_ids", F.array().cast("array<string>")))
    unknown = F.col("basis") == "unknown"
    return violations(claims, keys, {"unknown_with_content": unknown & (F.col("text").isNotNull() | (n > 0)), "known_without_content": ~unknown & (blank | (n == 0)), "repeated_reference": ~all_different(F.col("fact_ids"))})


def by_report(rows: DataFrame, reports: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the columns of their report. Without keys there is one report, of one row."""
    return rows.join(reports, [*keys]) if keys else rows.crossJoin(F.broadcast(reports.limit(1)))


def of(rows: DataFrame, keys: Sequence[str], item: str, code: str) -> DataFrame:
    """``(keys, item, code)``, each once."""
    return rows.select(*keys, item, F.lit(code).alias("code")).distinct()


def _sections_of(reviews: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return reviews.select(*keys, "section_id", (F.col("decision") == "accept").alias("accepted"))


def _quote_codes(rows: DataFrame, part: str, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Codes of the quotes in array ``part``, each against the span of its own report and source."""
    place = lambda span: F.concat_ws("\x00", *[F.col(k).cast("string") for k in keys], "source_id", span).alias("span_id")
    quotes = rows.select(*keys, "source_id", F.explode(part).alias("e")).select(*keys, "source_id", place("e.span_id"), "e.quote")
    return check_quotes(quotes, spans.select(place("span_id"), "text")).where("code is not null").select(*keys, "source_id", "code")


def source_verification(verdicts: DataFrame, sources: DataFrame, spans: DataFrame, reports: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Verifications of ``sources(keys, source_id, title, text)``, one for each row of ``reports(keys, named, found, company, homepage)``:
    it found the company ``named`` on the page ``found``, and was asked for ``company`` (or null) on ``homepage``.

    Verdicts cover the sources once each; the homepage is one of them and the page found; it names the company, which is the
    one asked for; quotes are of the verdict's own source; related sources have evidence and name the company in title or
    text; an executive is named in the quotes given for it, as is the role, which needs a name. ``(keys, source_id, code)``."""
    own = [*keys, "source_id"]
    cover = set_mismatch(verdicts, sources, own).select(*own, F.lit("coverage").alias("code"))
    pages = by_report(sources.select(*own), reports.select(*keys, "homepage"), keys).where("source_id = homepage")
    lost = reports.withColumn("source_id", F.col("homepage")).join(pages.groupBy(*own).agg(F.count("*").alias("_n")), own, "left")
    whole = sources.select(*own, F.concat_ws(" ", "title", "text").alias("_whole"))
    named = by_report(verdicts.join(whole, own), reports.select(*keys, "named", "homepage"), keys)
    asked = F.coalesce(F.col("company"), F.lit(""))
    per_report = {
        "unknown_homepage": F.coalesce("_n", F.lit(0)) != 1,
        "homepage_changed": ~F.col("found").eqNullSafe(F.col("homepage")),
        "company_changed": (asked != "") & (entity_key(F.col("named")) != entity_key(asked)),
    }
    quotes = union(*(_quote_codes(verdicts, part, spans, keys) for part in ("evidence", "date_evidence", "executive_evidence")))
    said = F.array_join(F.transform("executive_evidence", lambda e: e["quote"]), " ")
    given = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    related, names = F.col("relation") == "related", entity_in_text(F.col("named"), F.col("_whole"))
    rules = {
        "homepage_unnamed": (F.col("source_id") == F.col("homepage")) & ~names,
        "related_without_evidence": related & (F.size("evidence") == 0),
        "related_unnamed": related & ~names,
        "role_without_name": given("executive_role") & ~given("executive_name"),
        "executive_unquoted": given("executive_name") & ((F.size("executive_evidence") == 0) | ~entity_in_text(F.col("executive_name"), said)),
        "role_unquoted": given("executive_role") & ~entity_in_text(F.col("executive_role"), said),
    }
    return union(cover, violations(lost, own, per_report), quotes, violations(named, own, rules))


def dossier(dossiers: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Dossiers ``(keys, status, company, company_text, company_basis, included, excluded, known, fact_ids, description_text,
    description_basis, summary)`` against their ``facts(keys, fact_id, evidence)``.

    The company is matched and unchanged; included and excluded sources are known, different, and listed once; cited
    facts come from included sources only; there is a source-backed profile and a summary."""
    inc, exc, known = F.col("included"), F.col("excluded"), F.col("known")
    rules = {
        "ambiguous": F.col("status") != "matched",
        "unknown_source": ~within(F.concat(inc, exc), known),
        "repeated_source": ~all_different(inc) | ~all_different(exc),
        "overlap": ~disjoint(inc, exc),
        "identity_changed": F.col("company_text").isNull() | (F.col("company_basis") != "source_backed") | (entity_key(F.col("company_text")) != entity_key(F.col("company"))),
        "no_profile": F.col("description_text").isNull() | (F.col("description_basis") != "source_backed") | (F.size("summary") == 0),
    }
    cited = dossiers.select(*keys, "included", F.explode(F.array_distinct("fact_ids")).alias("fact_id")).join(facts.select(*keys, "fact_id", "evidence"), [*keys, "fact_id"])
    outside = cited.where(F.exists("evidence", lambda e: ~F.array_contains(F.col("included"), e["source_id"]))).select(*keys, F.lit("cites_outside").alias("code")).distinct()
    return union(violations(dossiers, keys, rules), outside)


#: Categories that say what a company is, the first before the others.
CORE_CATEGORIES = ("company", "offering", "product_workflow")


def identity_fact(facts: DataFrame, dossiers: DataFrame, keys: list[str]) -> DataFrame:
    """The fact that names the company of ``dossiers(keys, company, included)``: with evidence, from included sources only,
    one of whose quotes names it; of these by category (company first, then the core ones), then by id. Dossiers without one are left out."""
    own = facts.join(dossiers.select(*keys, "company", "included"), keys)
    names = F.exists("evidence", lambda e: entity_in_text(F.col("company"), e["quote"]))
    own = own.where((F.size("evidence") > 0) & F.forall("evidence", lambda e: F.array_contains(F.col("included"), e["source_id"])) & names)
    order = F.struct((F.col("category") != CORE_CATEGORIES[0]).alias("a"), (~F.col("category").isin(*CORE_CATEGORIES)).alias("b"), F.col("fact_id").alias("c"))
    return own.groupBy(*keys).agg(F.min_by("fact_id", order).alias("identity_fact_id"))


def rebound(dossiers: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """``dossiers(keys, company, included, company_fact_ids)`` with what their company's name rests on: ``(keys, fact_ids,
    rebound, code)``. The facts cited, if a quote of theirs names the company; else the fact of ``identity_fact``; and if
    there is none either, null and ``identity_unsupported``."""
    cited = dossiers.select(*keys, "company", F.explode("company_fact_ids").alias("fact_id")).join(facts.select(*keys, "fact_id", "evidence"), [*keys, "fact_id"])
    said = cited.groupBy(*keys, "company").agg(F.array_join(F.flatten(F.collect_list(F.transform("evidence", lambda e: e["quote"]))), " ").alias("_said"))
    named = said.where(entity_in_text(F.col("company"), F.col("_said"))).select(*keys, F.lit(True).alias("_named"))
    out = dossiers.join(named, keys, "left").join(identity_fact(facts, dossiers, keys), keys, "left")
    keeps = F.col("_named").isNotNull()
    ids = F.when(keeps, F.col("company_fact_ids")).when(F.col("identity_fact_id").isNotNull(), F.array("identity_fact_id"))
    return out.select(*keys, ids.alias("fact_ids"), (~keeps & ids.isNotNull()).alias("rebound"), F.when(ids.isNull(), "identity_unsupported").alias("code"))


def strategy(opportunities: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """``opportunities(keys, opportunity_id, priority, signal_basis, hypothesis_basis, outcome_basis, success_criteria, prerequisites)``:
    priorities once each, a source-backed signal, hypothesis and outcome that claim no more than that, targets open,
    at least one prerequisite, baselines with an actual figure. ``(keys, opportunity_id, code)``."""
    own = [*keys, "opportunity_id"]
    claimed = ("hypothesis", "analysis")
    twice = opportunities.groupBy(*keys, "priority").agg(F.count("*").alias("n"), F.min("opportunity_id").alias("opportunity_id")).where("n > 1").select(*own, F.lit("repeated_priority").alias("code"))
    rules = {
        "signal_unsupported": F.col("signal_basis") != "source_backed",
        "hypothesis_as_fact": ~F.col("hypothesis_basis").isin(*claimed),
        "outcome_as_fact": ~F.col("outcome_basis").isin(*claimed),
        "target_set": F.exists("success_criteria", lambda c: c["target"].isNotNull()),
        "no_prerequisite": F.size("prerequisites") == 0,
    }
    actual = facts.where(F.exists("quantities", lambda q: q["kind"] == "actual")).select("fact_id")
    base = opportunities.select(*own, F.explode("success_criteria").alias("c")).select(*own, F.explode("c.baseline_fact_ids").alias("fact_id"))
    return union(twice, violations(opportunities, own, rules), base.join(actual, "fact_id", "left_anti").select(*own, F.lit("baseline_without_figure").alias("code")).distinct())


def audience(outputs: DataFrame, opportunities: DataFrame, keys: list[str], *, points: int = 3) -> DataFrame:
    """``outputs(keys, audience, asked, coverage, talk_points, evidence_gaps)``: for the audience asked; complete ones have all
    points, limited ones some, insufficient ones none; others than complete say why; lines differ; points name a known opportunity."""
    n, coverage = F.size("talk_points"), F.col("coverage")
    lines = F.transform("talk_points", lambda p: talk_line(F.coalesce(p["seller_line"], F.lit(""))))
    rules = {
        "other_audience": F.col("audience") != F.col("asked"),
        "complete_count": (coverage == "complete") & (n != points),
        "limited_count": (coverage == "limited") & ~n.between(1, points - 1),
        "insufficient_count": (coverage == "insufficient_evidence") & (n != 0),
        "too_many": n > points,
        "no_gap": (coverage != "complete") & (F.size("evidence_gaps") == 0),
        "repeated_line": ~all_different(lines),
    }
    used = outputs.select(*keys, F.explode("talk_points.opportunity_id").alias("opportunity_id"))
    lost = used.join(opportunities.select("opportunity_id"), "opportunity_id", "left_anti").select(*keys, F.lit("unknown_opportunity").alias("code")).distinct()
    return union(violations(outputs, keys, rules), lost)


SERVER_SECTIONS = ("section_sources",)
EVIDENCE_SECTIONS = ("section_company", "section_summary", "section_evidence", "section_contradictions")


def review(sections: DataFrame, reviews: DataFrame, issues: DataFrame, facts: DataFrame, *, decision: Column | DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """``reviews(keys, section_id, decision)`` and ``issues(keys, section_id, code, fact_ids)`` of reviews that decided ``decision``
    in all: a column of reviews and issues, or a table ``(keys, decision)``.

    Every section of a report reviewed once; issues on sections and facts of the same report; what the server owns is accepted
    and has no issue; core evidence is not called insufficient, and is rejected with the facts concerned; rejections have an
    issue and accepted sections none; a review that accepts has neither. ``(keys, section_id, code)``."""
    own = [*keys, "section_id"]
    code = lambda rows, name: of(rows, keys, "section_id", name)
    ids = sections.select(*own)
    known, reviewed = issues.join(ids, own, "left_semi"), reviews.join(ids, own, "left_semi")
    rejected, accepted = reviewed.where("decision <> 'accept'"), reviewed.where("decision = 'accept'")
    core, server = F.col("section_id").isin(*EVIDENCE_SECTIONS), F.col("section_id").isin(*SERVER_SECTIONS)
    named = issues.where(F.size("fact_ids") > 0)
    parts = [
        code(set_mismatch(reviews, sections, own), "coverage"),
        code(issues.join(ids, own, "left_anti"), "unknown_section"),
        code(issues.select(*own, F.explode("fact_ids").alias("fact_id")).join(facts.select(*keys, "fact_id"), [*keys, "fact_id"], "left_anti"), "unknown_reference"),
        code(rejected.where(server), "server_section_rejected"),
        code(known.where(server), "server_section_issue"),
        code(known.where(core & (F.col("code") == "insufficient_evidence")), "vague_core_issue"),
        code(rejected.where(core).join(named.select(*own), own, "left_anti"), "core_without_facts"),
        code(rejected.join(issues.select(*own), own, "left_anti"), "rejection_without_issue"),
        code(accepted.join(issues.select(*own), own, "left_semi"), "issue_without_rejection"),
    ]
    if decision is not None:
        blocking = rejected.select(*own).union(issues.select(*own))
        if isinstance(decision, DataFrame):
            blocking = by_report(blocking, decision.where("decision = 'accept'").select(*keys), keys) if keys else blocking.crossJoin(F.broadcast(decision.where("decision = 'accept'").select(F.lit(1).alias("_one")).limit(1)))
        else:
            blocking = blocking.where(decision == "accept")
        parts.append(code(blocking, "accepted_with_issues"))
    return union(*parts)


def report(parts: dict[str, DataFrame], *, days: int = 90, keys: Sequence[str] = ()) -> DataFrame:
    """Reports as tables: ``(keys, item, code)`` of everything in them that does not hold.

    ``header`` (a row a report: keys, status, company_text, company_basis, description_text, description_basis, summary,
    news_status, as_of), ``facts(fact_id, entity, evidence, quantities, warnings)``, ``claims(claim_id, text, basis, fact_ids)``,
    ``sources(source_id, published_at, is_news)``, ``opportunities(opportunity_id)``, ``requested(audience)``,
    ``coverage(audience, status)``, ``audiences(audience, coverage, talk_points, evidence_gaps)`` and
    ``announcements(source_id, published_at, executive_name, executive_role)``, each with the keys. References are
    looked up within a report; rows of a key without a header belong to no report and are left out."""
    header = parts["header"]
    names = ("facts", "claims", "sources", "opportunities", "requested", "coverage", "audiences", "announcements")
    facts, claims, sources, opportunities, requested, coverage, audiences, news = (parts[n].join(header.select(*keys), [*keys], "left_semi") if keys else parts[n] for n in names)
    on = lambda *more: [*keys, *more]
    code = lambda rows, item, name: rows.select(*keys, F.col(item).cast("string").alias("item"), F.lit(name).alias("code")).distinct()
    twice = lambda rows, key: rows.groupBy(*on(key)).count().where("count > 1")
    missing = lambda rows, key, known: rows.join(known.select(*on(key)), on(key), "left_anti")
    found = [code(twice(rows, key), key, "repeated_id") for rows, key in ((facts, "fact_id"), (sources, "source_id"), (opportunities, "opportunity_id"))]
    found.append(ungrounded(claims, facts.dropDuplicates(on("fact_id")), keys).select(*keys, F.col("claim_id").cast("string").alias("item"), "code"))
    # Audiences: each requested one is accounted for, what is retained agrees with its coverage.
    found.append(code(set_mismatch(requested, coverage, on("audience")), "audience", "audience_unaccounted"))
    found.append(code(twice(audiences, "audience"), "audience", "repeated_audience"))
    found.append(code(missing(audiences, "audience", requested), "audience", "audience_not_requested"))
    n, own = F.size("talk_points"), F.col("coverage")
    rules = {
        "coverage_mismatch": F.when(own.isNull(), F.col("status") != "unavailable").otherwise(own != F.col("status")),
        "audience_inconsistent": (own.isin("complete", "limited") & (n == 0)) | ((own == "insufficient_evidence") & (n > 0)) | ((own != "complete") & (F.size("evidence_gaps") == 0)),
    }
    found.append(violations(coverage.join(audiences, on("audience"), "left").withColumn("item", F.col("audience")), on("item"), rules))
    completed = header.where("status = 'completed'").select(*(keys or [F.lit(1).alias("_one")]))
    found.append(code(by_report(coverage.where("status <> 'complete'"), completed, keys), "audience", "completed_without"))
    # The core: facts, a source-backed name and description, a summary; news as its status says.
    some = lambda rows, name: rows.groupBy(*keys).agg((F.count("*") > 0).alias(name)) if keys else rows.agg((F.count("*") > 0).alias(name))
    whole = header
    for rows, name in ((facts, "_facts"), (news, "_news")):
        whole = whole.join(some(rows, name), [*keys], "left") if keys else whole.crossJoin(F.broadcast(some(rows, name)))
    lacking = ~F.coalesce("_facts", F.lit(False)) | (F.size("summary") == 0)
    for part in ("company", "description"):
        lacking = lacking | (F.col(f"{part}_basis") != "source_backed") | (F.coalesce(F.col(f"{part}_text"), F.lit("")) == "")
    rules = {"no_core": lacking, "news_status": (F.col("news_status") == "found") != F.coalesce("_news", F.lit(False))}
    found.append(violations(whole.withColumn("item", F.lit("report")), on("item"), rules))
    # Facts: citations, entity, warnings as they are recomputed.
    found.append(code(missing(facts.select(*on("fact_id"), F.explode("evidence.source_id").alias("source_id")), "source_id", sources), "fact_id", "unknown_source"))
    found.append(code(by_report(facts, header.select(*on("company_text")), keys).where(entity_key(F.col("entity")) != entity_key(F.coalesce("company_text", F.lit("")))), "fact_id", "other_entity"))
    warned = F.array_sort(F.collect_list(F.struct("quantity_index", "span_id", "numeric_text")))
    again = quantity_warnings(facts, keys).where("code = 'quantity_warning'").groupBy(*on("fact_id")).agg(warned.alias("_again"))
    kept = facts.select(*on("fact_id"), F.array_sort(F.transform("warnings", lambda w: F.struct(w["quantity_index"].cast("int").alias("quantity_index"), w["span_id"].alias("span_id"), w["numeric_text"].alias("numeric_text")))).alias("_kept"))
    none = F.array().cast("array<struct<quantity_index:int,span_id:string,numeric_text:string>>")
    found.append(code(kept.join(again, on("fact_id"), "left").where(F.coalesce("_again", none) != F.coalesce("_kept", none)), "fact_id", "warnings_changed"))
    found.append(code(missing(audiences.select(*on("audience"), F.explode("talk_points.opportunity_id").alias("opportunity_id")), "opportunity_id", opportunities), "audience", "unknown_opportunity"))
    # Announcements: from a news source of that day, in the window, with executives that its quotes name.
    found.append(code(missing(news, "source_id", sources), "source_id", "unknown_source"))
    found.append(code(twice(news, "source_id"), "source_id", "repeated_announcement"))
    quoted = facts.select(*keys, F.explode("evidence").alias("e")).groupBy(*keys, F.col("e.source_id").alias("source_id")).agg(F.array_join(F.array_sort(F.collect_list("e.quote")), " ").alias("_said"))
    dated = news.join(sources.select(*on("source_id"), F.col("published_at").alias("_day"), "is_news"), on("source_id")).join(quoted, on("source_id"), "left")
    dated = by_report(dated, header.select(*on("as_of")), keys)
    said = F.coalesce("_said", F.lit(""))
    given = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    day = F.col("published_at")
    rules = {
        "date_out_of_window": ~day.between(F.date_sub("as_of", days), F.col("as_of")),
        "date_mismatch": ~day.eqNullSafe(F.col("_day")),
        "not_news": ~F.coalesce("is_news", F.lit(False)),
        "executive_uncited": (given("executive_name") & ~entity_in_text(F.col("executive_name"), said)) | (given("executive_role") & ~entity_in_text(F.col("executive_role"), said)),
        "role_without_name": given("executive_role") & ~given("executive_name"),
    }
    found.append(violations(dated.withColumn("item", F.col("source_id").cast("string")), on("item"), rules))
    return union(*found)


#: Sections without which no report goes out.
CORE_SECTIONS = ("section_company", "section_summary", "section_evidence", "section_sources")


def publishable(reviews: DataFrame, *, contradictions: bool = False, reports: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Core sections that were not accepted, ``(keys, section_id, code)``: reports without a row go out. A relational division
    of reviews by the sections that each of ``reports(keys, contradictions)`` needs; without reports, of one job."""
    own = [*keys, "section_id"]
    if reports is None:
        reports = reviews.sparkSession.range(1).select(F.lit(contradictions).alias("contradictions"))
    core, more = F.array(*map(F.lit, CORE_SECTIONS)), F.array(F.lit("section_contradictions"))
    needed = reports.select(*keys, F.explode(F.when(F.col("contradictions"), F.concat(core, more)).otherwise(core)).alias("section_id"))
    return needed.join(_sections_of(reviews, keys).where("accepted").select(*own), own, "left_anti").withColumn("code", F.lit("core_not_accepted"))


def published(opportunities: DataFrame, audiences: DataFrame, announcements: DataFrame, gaps: DataFrame, own_gaps: DataFrame, requested: DataFrame, reviews: DataFrame, reports: DataFrame, keys: Sequence[str], *, stored: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """What of reviewed candidates goes out, as tables with the keys of ``reports(keys, contradictions)``.

    Only reports whose core was accepted (``publishable``) are there. Accepted ``opportunities``; ``audiences`` whose content
    and coverage were accepted and all of whose points name an accepted opportunity; ``coverage`` of every requested audience;
    ``announcements`` if their section was accepted; ``gaps(area, detail)``: the candidate's, or the server's ``own_gaps`` if
    the limitations were not accepted, and what was left out; ``status``, partial if anything is missing or not accepted.
    ``stored`` may write a table that several outputs read, so that their plans stay small."""
    keys = [*keys]
    held = publishable(reviews, reports=reports, keys=keys).select(*keys).distinct()
    out = stored(reports.select(*keys).join(held, keys, "left_anti"))
    opportunities, audiences, announcements, gaps, own_gaps, requested, reviews = (d.join(out, keys, "left_semi") for d in (opportunities, audiences, announcements, gaps, own_gaps, requested, reviews))
    decided = _sections_of(reviews, keys)
    accepted = stored(decided.where("accepted").select(*keys, "section_id"))
    passes = lambda rows, section: rows.withColumn("section_id", section).join(accepted, [*keys, "section_id"], "left_semi").drop("section_id")
    kept = stored(passes(opportunities, F.concat(F.lit("section_"), F.col("opportunity_id").cast("string"))))
    said = passes(passes(audiences, F.concat(F.lit("section_audience_"), F.col("audience"))), F.concat(F.lit("section_coverage_"), F.col("audience")))
    points = audiences.select(*keys, "audience", F.explode("talk_points.opportunity_id").alias("opportunity_id"))
    loose = points.join(kept.select(*keys, "opportunity_id"), [*keys, "opportunity_id"], "left_anti").select(*keys, "audience").distinct()
    said = stored(said.join(loose, [*keys, "audience"], "left_anti"))
    coverage = requested.select(*keys, "audience").join(said.select(*keys, "audience", F.col("coverage").alias("status")), [*keys, "audience"], "left").withColumn("status", F.coalesce("status", F.lit("unavailable")))
    news = passes(announcements, F.lit("section_announcements"))
    counted = {
        "limits": decided.where("section_id = 'section_limitations' and accepted"), "before": opportunities, "after": kept, "news_before": announcements,
        "news_after": news, "short": coverage.where("status <> 'complete'"), "refused": decided.where("not accepted"), "report": out,
    }
    marks = union(*(rows.select(*keys, F.lit(name).alias("_mark")) for name, rows in counted.items()))
    state = marks.groupBy(*keys).agg(*[F.count_if(F.col("_mark") == name).alias(name) for name in counted])
    gap = lambda rows, area, detail: rows.select(*keys, F.lit(area).alias("area"), detail.alias("detail"))
    limited = state.where("limits > 0").select(*keys)
    removed = audiences.select(*keys, "audience").distinct().join(said.select(*keys, "audience"), [*keys, "audience"], "left_anti")
    made = [
        gaps.join(limited, keys, "left_semi").select(*keys, "area", "detail"),
        own_gaps.join(limited, keys, "left_anti").select(*keys, "area", "detail"),
        gap(removed, "audience_coverage", F.concat(F.upper("audience"), F.lit(" was left out: its content or something it shares was not accepted."))),
        gap(state.where("news_before > 0 and news_after = 0"), "official_news", F.lit("Announcements were not accepted and are not published.")),
        gap(state.where("limits = 0"), "quality_review", F.lit("Limitations that were not accepted were left out; those the server saw remain.")),
        gap(state.where("before <> after"), "opportunities", F.lit("Some opportunities were not accepted and were left out.")),
    ]
    status = state.select(*keys, F.when((F.col("short") > 0) | (F.col("refused") > 0), "partial").otherwise("completed").alias("status"))
    return {"opportunities": kept, "audiences": said, "coverage": coverage, "announcements": news, "gaps": union(*made).distinct(), "status": status}


def usage(rows: DataFrame, keys: list[str]) -> DataFrame:
    fields = ("calls", "input_tokens", "output_tokens", "tool_calls")
    return violations(rows, keys, {f"{f}:negative": F.coalesce(F.col(f), F.lit(-1)) < 0 for f in fields})


def stored_record(now: Column) -> Column:
    """``ok``, ``invalid``, ``clock`` or ``expired`` for a stored ``(created, expires)`` pair of strings."""
    shape = F.lit(r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{3})?Z\z")
    made, ends = F.try_to_timestamp("created"), F.try_to_timestamp("expires")
    fine = F.regexp_like("created", shape) & F.regexp_like("expires", shape) & made.isNotNull() & ends.isNotNull() & (ends > made) & (ends <= made + F.expr("interval 7 days"))
    return F.when(~F.coalesce(fine, F.lit(False)), "invalid").when(made > now + F.expr("interval 1 minute"), "clock").when(ends <= now, "expired").otherwise("ok")


def check_limits(**limits: tuple[float, float, float]) -> None:
    """Driver-side settings ``name=(value, low, high)``; an error names the first that is out of bounds."""
    for name, (value, low, high) in limits.items():
        if isinstance(value, bool) or value != value or not low <= value <= high:
            raise ValueError(f"{name} must be between {low} and {high}")


def check_settings(tasks: dict[str, int], *, job_tokens: int, pages: int, seeds: int, search_tasks: int) -> None:
    """Settings that depend on each other: one search task, task caps within the job's, room for the seeds."""
    if search_tasks > 1:
        raise ValueError("only one task may search")
    over = [name for name, cap in tasks.items() if cap > job_tokens]
    if over:
        raise ValueError(f"task caps over the job's: {', '.join(sorted(over))}")
    if pages < seeds:
        raise ValueError("fewer pages than seeds")
