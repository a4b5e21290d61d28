"""Table-driven cases of text, quotes, URLs, robots, JSON and HTML."""

from __future__ import annotations

import random
import time

import pytest

from factloom.functions import jsonshape, quotes, urls
from factloom.sources import codec, pages, robots


#: What a page of one's own site may be called, and its one name.
SAME = {
    "https://shop.site.org/": ["HTTPS://Shop.Site.ORG", "https://shop.site.org:443", "https://shop.site.org./#top", "https://shop.site.org/./x/.."],
    "https://site.org/b/c?z=1&y=%2f": ["https://site.org/a/../b/c?z=1&y=%2f", "https://SITE.org:0443/b/./c?z=1&y=%2f#q?r"],
    "https://site.org/%C3%A9t%C3%A9": ["https://site.org/été"],
    "https://xn--mller-kva.site.org/": ["https://müller.site.org/"],
    "https://site.org/q?": ["https://site.org/q?#"],
    "https://site.org//two": ["https://site.org//two"],
    "https://9.9.9.9/": ["https://9.9.9.9"],
    "https://[2620:fe::fe]/d": ["https://[2620:00fe:0:0:0:0:0:00fe]/d"],
}


@pytest.mark.parametrize(("want", "url"), [(w, u) for w, us in SAME.items() for u in us])
def test_normal_url(want, url):
    assert urls.normal_url(url) == want
    assert urls.normal_url(want) == want


@pytest.mark.parametrize(
    "url",
    [
        None, "", "ftp://site.org/", "//site.org/", "https:site.org", "https://site.org:8443/", "https://site.org:/", "https://me@site.org/", "https://@site.org/", "https://site.org/a b",
        "https://site.org/\\", "https://site.org/%5C", "https://site.org/%0d", "https://site.org/%4", "https://site.org/\u200b", "https://printer.lan/", "https://localhost/", "https://site/",
        "https://192.168.7.7/", "https://[fe80::1]/", "https://[2002:808:808::]/", "https://[64:ff9b::808:808]/", "https://239.1.2.3/", "https://168.63.129.16/", "https://9.9.9.999/",
        "https://[9.9.9.9]/", "https://site-.org/", "https://s_te.org/", "https://site.123/", "https://" + "a" * 64 + ".org/", "https://site.org/" + "p" * 2040,
    ],
)
def test_no_normal_url(url):
    assert urls.normal_url(url) is None


def glob(pattern, target):
    """The same by trying every place for every wildcard."""
    if not pattern:
        return True
    if pattern == "$":
        return not target
    if pattern[0] == "*":
        return any(glob(pattern[1:], target[k:]) for k in range(len(target) + 1))
    return target[:1] == pattern[0] and glob(pattern[1:], target[1:])


def test_robots_patterns():
    rng = random.Random(4)
    for _ in range(3000):
        pattern = "/" + "".join(rng.choice("ab*") for _ in range(rng.randrange(6))) + rng.choice(["", "$"])
        target = "/" + "".join(rng.choice("ab") for _ in range(rng.randrange(8)))
        assert robots.path_matches(pattern, target) is glob(pattern, target), (pattern, target)
    assert robots.path_matches("/" + "a*" * 2000 + "b", "/" + "a" * 3000) is False


def test_robots_path():
    assert robots.canonical_path("/%61%2f%e9 ü~%7e%") == "/a%2F%E9%20%C3%BC~~%"


@pytest.mark.parametrize(
    ("quote", "source", "want"),
    [
        ("b c", "a b c d", "b c"),
        ("The 1000 people", "x the  1,000 people y", "the  1,000 people"),
        ("the company employs many peoples in offices", "So the company employs many people in offices.", "the company employs many people in offices"),
        ("the company employs many employees in offices", "So the company employs many employes in offices.", "the company employs many employes in offices"),
        ("sales of goods increased in this year", "sales of goods decreased in this year", None),
        ("paid $500 for all of it", "paid €500 for all of it", None),
        ("", "x", ""),
        ("none of these", "x", None),
    ],
)
def test_near_quote(quote, source, want):
    assert quotes.near_quote(quote, source) == want


def test_numbers():
    assert quotes.numbers("1,000 007 3.50 500.0% 12,34") == {"1000", "7", "3.5", "500%", "12,34"}


def test_html_blocks():
    html = (
        "<html><head><title>A  title</title><meta property='article:published_time' content='2026-01-02'></head><body><nav><a href='/in'>x</a></nav>"
        "<h1>Head</h1><p>One <b>bold</b><br>line<p hidden>no</p><div style='display: none'>no</div><script>no</script><p class='sr-only'>no</p>"
        "<a href='http://b.com/'>h</a><a href='/in'>again</a><time datetime='2026-01-03' pubdate>t</time><table><tr><td>a<td>b</table></body></html>"
    )
    title, blocks, links, coverage, error = pages.parse_page(html, "https://a.com/x")
    assert (title, links, coverage["complete"], coverage["omissions"], error) == ("A title", ["https://a.com/in"], True, [], None)
    texts = [(b["text"], b["section"]) for b in blocks if not b["publication"]]
    assert texts == [("A title", "Title"), ("Head", "Head"), ("One bold line", "Head"), ("hagaint", "Head"), ("a b", "Head")]
    assert [b["published"] for b in blocks if b["publication"]] == ["2026-01-02", "2026-01-03"]


def test_html_coverage():
    page = lambda html: pages.parse_page(html, "https://a.com/")[3]
    long = page("<p>" + "x" * 200_000)
    assert (long["complete"], long["omissions"], long["text_truncated"], long["links_truncated"]) == (False, ["text_limit"], True, False)
    many = page("".join(f"<a href='/{k}'>x</a>" for k in range(150)))
    assert (many["complete"], many["links_truncated"]) == (True, True)
    dates = page("<meta name=pubdate content=2026-01-01>" * 17)
    assert (dates["complete"], dates["omissions"], dates["publication_metadata_truncated"]) == (False, ["publication_metadata_limit"], True)


def test_html_visibility():
    texts = lambda html: [b["text"] for b in pages.parse_page(html, "https://a.com/")[1]]
    assert texts("<div><aside>a<p>b</p></aside>c</div>") == ["c"]
    assert texts("<p>a<span aria-hidden=true>b<i>c</i></span>d") == ["a", "d"]
    assert texts("<p>a</div></p>b<br/>c") == ["a", "b c"]
    assert texts("<ul><li>one<li>two</ul>three") == ["one", "two", "three"]
    assert texts("<h2>H<br>2</h2><p>x &amp; y") == ["H 2", "x & y"]
    assert pages.parse_page("<template><a href='/t'>t</a></template><nav><a href='/n'>n</a></nav>", "https://a.com/")[2] == ["https://a.com/n"]


def test_html_limits():
    assert pages.parse_page("<div>" * 300, "https://a.com/")[4] == "html_complexity"
    assert pages.parse_page("<br>" * 100_001, "https://a.com/")[4] == "html_complexity"
    assert pages.parse_page(None, None)[:2] == ("", [])


def test_cut_words():
    assert pages.cut_words("aaa bbb ccc", 7, 100, 9) == (["aaa bbb", "ccc"], False)
    assert pages.cut_words("aaaaaaaa bb", 4, 100, 9) == (["aaaa", "aaaa", "bb"], False)
    assert pages.cut_words("a b c d", 1, 100, 2) == (["a", "b"], True)
    assert pages.cut_words("abcdef", 3, 5, 9) == (["abc"], True)
    began = time.process_time()
    pieces, cut = pages.cut_words("word and word " * 300_000, 2000, 1 << 62, 1 << 62)
    assert not cut and len(pieces) > 2000 and time.process_time() - began < 0.5


def test_charset():
    assert pages.charset("text/html; charset=ISO-8859-1", b"") == "iso8859-1"
    assert pages.charset("", b"\xff\xfea\x00") == "utf-16"
    assert pages.charset("", b"<meta charset='utf-8'>") == "utf-8"
    assert pages.charset("text/html; charset=shift_jis", b"") is None


def test_inflate():
    import gzip
    import zlib

    assert pages.inflate(gzip.compress(b"x" * 100), "gzip", 100) == b"x" * 100
    assert pages.inflate(gzip.compress(b"x" * 101), "gzip", 100) is None
    assert pages.inflate(zlib.compress(b"abc"), "deflate", 100) == b"abc"
    assert pages.inflate(b"abc", "br", 100) is None


def test_blob():
    key = b"k"
    blob, signature, error = codec.seal('{"a":1}', key)
    assert error is None and codec.unseal(blob, signature, key) == ('{"a":1}', None)
    assert codec.unseal(blob, signature, b"other") == (None, "bad_signature")
    assert codec.unseal(blob[:-4] + "BBBB", signature, key) == (None, "bad_signature")
    assert codec.unseal("*", signature, key) == (None, "invalid_blob")
    assert codec.seal("x" * 3_000_000, key)[2] == "report_too_large"


def test_strict_json():
    with pytest.raises(ValueError):
        jsonshape.strict_loads('{"a":1,"a":2}')
    assert jsonshape.depth(jsonshape.strict_loads("[[{}]]")) == 3


def test_strict_schema(spark):
    from pyspark.sql import types as T

    kind = T.StructType([T.StructField("a", T.LongType(), False), T.StructField("b", T.ArrayType(T.StringType(), False))])
    out = jsonshape.strict_schema(kind)["anyOf"][0] if "anyOf" in jsonshape.strict_schema(kind) else jsonshape.strict_schema(kind)
    assert out["required"] == ["a", "b"] and out["additionalProperties"] is False
    with pytest.raises(ValueError):
        jsonshape.strict_schema(kind, properties=1)


def test_settings():
    from factloom.operators import gates

    gates.check_limits(pages=(12, 1, 20))
    with pytest.raises(ValueError):
        gates.check_limits(pages=(0, 1, 20))
    gates.check_settings({"a": 5}, job_tokens=10, pages=6, seeds=6, search_tasks=1)
    with pytest.raises(ValueError):
        gates.check_settings({"a": 50}, job_tokens=10, pages=6, seeds=6, search_tasks=1)
