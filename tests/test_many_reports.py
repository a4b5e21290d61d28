"""Gates by report: each report as if it were alone, whatever the others hold."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factloom.operators import gates, joins
from factloom.plans import manyreports as many
from factloom.plans import reports as one

SF = "/root/testdata/sf0.001"
NUMBERS = (0, 4, 13)


def rows(df, *drop):
    return sorted(map(tuple, df.drop(*drop).collect()), key=repr)


def of(df, k):
    return df.where(F.col("report_id") == k)


def test_reviews_alone_and_together(spark):
    heads = many.headers(spark, SF).select("report_id", "decision")
    parts = [many.derived(spark, SF, many.SECTIONS), many.derived(spark, SF, many.REVIEWS), many._issues(spark, SF), many.facts(spark, SF)]
    every = gates.review(*parts, decision=heads, keys=many.KEYS).cache()
    for k in NUMBERS:
        alone = gates.review(*[of(p, k) for p in parts], decision=of(heads, k))
        assert rows(alone) == rows(of(every, k), "report_id")
    assert {r.code for r in every.select("code").distinct().collect()} == {
        "coverage", "unknown_section", "unknown_reference", "server_section_rejected", "server_section_issue", "vague_core_issue", "core_without_facts",
        "rejection_without_issue", "issue_without_rejection", "accepted_with_issues",
    }


def test_same_ids_in_two_reports(spark):
    """Nothing of one report is found from another that uses the same ids."""
    header = spark.createDataFrame(
        [(k, "completed", "Acme", "source_backed", "d", "source_backed", ["s"], "none_found", None) for k in (1, 2)],
        "job long, status string, company_text string, company_basis string, description_text string, description_basis string, summary array<string>, news_status string, as_of date",
    )
    quote = "array<struct<source_id:string,span_id:string,quote:string>>"
    facts = spark.createDataFrame([(1, "f1", "Acme", [("s1", "x", "It has 5 plants.")], [], []), (2, "f2", "Acme", [("s1", "x", "It has 6 plants.")], [], [])], f"job long, fact_id string, entity string, evidence {quote}, quantities array<struct<numeric_text:string,unit:string,currency:string,period:string,kind:string,span_id:string>>, warnings array<struct<quantity_index:int,span_id:string,numeric_text:string>>")
    parts = {
        "header": header,
        "facts": facts,
        "claims": spark.createDataFrame([(1, "c", "5", "source_backed", ["f1"]), (2, "c", "5", "source_backed", ["f2"]), (2, "e", "5", "source_backed", ["f1"]), (3, "c", "9", "source_backed", ["f9"])], "job long, claim_id string, text string, basis string, fact_ids array<string>"),
        "sources": spark.createDataFrame([(1, "s1", None, False)], "job long, source_id string, published_at date, is_news boolean"),
        "opportunities": spark.createDataFrame([(1, "o")], "job long, opportunity_id string"),
        "requested": spark.createDataFrame([(1, "ceo"), (2, "ceo")], "job long, audience string"),
        "coverage": spark.createDataFrame([(1, "ceo", "complete"), (2, "ceo", "complete")], "job long, audience string, status string"),
        "audiences": spark.createDataFrame([(k, "ceo", "complete", [("o", "l")], []) for k in (1, 2)], "job long, audience string, coverage string, talk_points array<struct<opportunity_id:string,seller_line:string>>, evidence_gaps array<string>"),
        "announcements": spark.createDataFrame([], "job long, source_id string, published_at date, executive_name string, executive_role string"),
    }
    got = gates.report(parts, keys=["job"])
    assert rows(got) == [(2, "c", "numeric_or_period_mismatch"), (2, "ceo", "unknown_opportunity"), (2, "e", "unknown_reference"), (2, "f2", "unknown_source")]
    two = {n: p.withColumn("job", F.struct("job", F.lit("a").alias("b"))) for n, p in parts.items()}
    assert gates.report(two, keys=["job"]).count() == 4  # keys of any type, one or several
    split = {n: p.withColumn("kind", F.lit("x")) for n, p in parts.items()}
    assert rows(gates.report(split, keys=["kind", "job"]), "kind") == rows(got)


def test_reports_alone_and_together(spark):
    every = many.report_gate_violations(spark, SF).cache()
    assert every.select("report_id").distinct().count() > 15
    assert every.select("code").distinct().count() >= 16


def test_verifications_alone_and_together(spark):
    sources = spark.createDataFrame([(k, f"s{i}", "Acme", "Acme makes things") for k in range(3) for i in range(3)], "job long, source_id string, title string, text string")
    spans = sources.withColumn("span_id", F.lit("p"))
    evidence = "array<struct<span_id:string,quote:string>>"
    verdicts = [(k, f"s{i}", "related", None, None, [("p", "Acme makes things" if k < 2 else "Acme makes nothing")], [], []) for k in range(3) for i in range(3) if (k, i) != (1, 2)]
    verdicts = spark.createDataFrame(verdicts, f"job long, source_id string, relation string, executive_name string, executive_role string, evidence {evidence}, date_evidence {evidence}, executive_evidence {evidence}")
    reports = spark.createDataFrame([(0, "Acme", "s0", "ACME Inc", "s0"), (1, "Acme", "s0", None, "s9"), (2, "Other", "s1", "Acme", "s1")], "job long, named string, found string, company string, homepage string")
    got = gates.source_verification(verdicts, sources, spans, reports, ["job"]).cache()
    assert not rows(got.where("job = 0"))
    assert rows(got.where("job = 1")) == [(1, "s2", "coverage"), (1, "s9", "homepage_changed"), (1, "s9", "unknown_homepage")]
    assert {(r.source_id, r.code) for r in got.where("job = 2").collect()} >= {("s1", "company_changed"), ("s1", "homepage_unnamed"), ("s0", "quote_mismatch"), ("s2", "related_unnamed")}
    for k in range(3):
        only = [d.where(F.col("job") == k).drop("job") for d in (verdicts, sources, spans, reports)]
        assert rows(gates.source_verification(*only)) == rows(got.where(F.col("job") == k), "job")


def test_targets_stay_in_their_job(spark):
    issues = spark.createDataFrame([(k, 1, c, s, f) for k in (1, 2) for c, s, f in (("unsupported_claim", "section_evidence", ["lost"]), ("unsupported_claim", "section_limitations", []), ("insufficient_evidence", "section_company", []), ("unsupported_claim", "section_announcements", []))], "job long, issue_id long, code string, section_id string, fact_ids array<string>")
    owners = spark.createDataFrame([(1, "lost", "extract_a"), (2, "g", "extract_b")], "job long, fact_id string, owner_key string")
    artifacts = spark.createDataFrame([(1, "dossier", None, 1), (2, "strategy", None, 2), (2, "dossier", None, 0)], "job long, owner_key string, coverage string, n_gaps long")
    reports = spark.createDataFrame([(1, True), (2, False)], "job long, announced boolean")
    got = joins.issue_targets(issues, owners, spark.createDataFrame([(1, "extract_a"), (1, "extract_c"), (2, "extract_b"), (2, "extract_b")], "job long, owner_key string"), artifacts, reports, ["job"])
    assert rows(got) == [(1, 1, "dossier"), (1, 1, "extract_a"), (1, 1, "verify_news"), (2, 1, "extract_b"), (2, 1, "strategy")]


@pytest.mark.parametrize("contradictions, held", [(False, {"section_summary"}), (True, {"section_summary", "section_contradictions"})])
def test_core_sections_divide_reports(spark, contradictions, held):
    reviews = spark.createDataFrame([(1, s, "accept") for s in gates.CORE_SECTIONS if s != "section_summary"] + [(1, "section_summary", "repair"), (2, "section_x", "accept")], "job long, section_id string, decision string")
    reports = spark.createDataFrame([(1, contradictions), (2, False), (3, False)], "job long, contradictions boolean")
    got = gates.publishable(reviews, reports=reports, keys=["job"])
    assert {r.section_id for r in got.where("job = 1").collect()} == held
    assert got.where("job = 2").count() == got.where("job = 3").count() == len(gates.CORE_SECTIONS)
    assert one.QUERIES
