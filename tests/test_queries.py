"""Every query against its SQL, and under another partitioning where it has none."""

from __future__ import annotations

import os

import pytest

duckdb = pytest.importorskip("duckdb")

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _registry():
    from factloom.plans import registry

    return registry


def pytest_generate_tests(metafunc):
    if "name" in metafunc.fixturenames:
        # Names only: column functions need a session to be built, modules do not.
        metafunc.parametrize("name", sorted(_registry().QUERIES))


@pytest.fixture(scope="session")
def lake():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_query(spark, lake, name):
    registry = _registry()
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    if name in registry.ORACLE_SQL:
        sql = registry.ORACLE_SQL[name]
        want = sorted(map(repr, lake.execute(f"select {', '.join(columns)} from ({sql})").fetchall()))
        assert got == want
    else:
        assert got
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        try:
            again = sorted(repr(tuple(r)) for r in registry.QUERIES[name](spark, SF).select(*columns).collect())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert got == again


def test_entry_works(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["page_id", "ord", "text", "section"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_content_hash_of_null_texts(spark, tmp_path):
    rows = [(4, None), (2, "a"), (3, "a"), (1, None), (5, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    registry = _registry()
    got = [tuple(r) for r in registry.QUERIES["content_hash_dedup"](spark, str(tmp_path)).select("doc_id", "content_hash", "kept_id").collect()]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(got) == sorted(con.execute(f"select doc_id, content_hash, kept_id from ({registry.ORACLE_SQL['content_hash_dedup']})").fetchall()) and len(got) == 5


@pytest.mark.parametrize("query", ["page_span_topk", "page_spans", "page_text_blocks", "page_title"])
def test_references_without_semicolon(spark, tmp_path, query):
    """F2 to F5: references that were cut off, as in pages of sf0.1."""
    page = "<html><head><title>a&amp;b {x}</title></head><body><article><h1>the {x}</h1><p>und &lt;{x} &amp;{x} {x}</p><p>{x}<br>z</p></article></body></html>"
    forms = ("&amp", "&am", "&", "& amp", "&lt", "&ltx", "&#x27", "&#39", "&amp;amp", "&&amp", "&amp&amp")
    rows = [(n, "https://a.com/", page.replace("{x}", x)) for n, x in enumerate(forms)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    df = _registry().QUERIES[query](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(f"select {', '.join(df.columns)} from ({_registry().ORACLE_SQL[query]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want)) and len(want) >= len(forms)


@pytest.mark.parametrize("query", ["page_spans", "page_span_topk", "page_text_blocks", "page_title", "page_links", "page_complexity", "page_publication_dates"])
def test_large_pages(spark, tmp_path, query):
    """pages past the reader's limits, by elements left open, nodes, spans, characters and links."""
    page = "<html><head><title>a</title></head><body><article><h1>b</h1>{x}</article></body></html>"
    forms = ("<p><b>c d<br>" * 200, "<p>" + "e<br>" * 60_000 + "</p>", "<p>f</p>" * 900, "<p>" + "some words " * 20_000 + "</p>", "".join(f'<a href="/{n}">g</a>' for n in range(150)), "")
    rows = [(n, "https://a.com/", page.replace("{x}", x)) for n, x in enumerate(forms)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    df = _registry().QUERIES[query](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(f"select {', '.join(df.columns)} from ({_registry().ORACLE_SQL[query]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want)) and want
