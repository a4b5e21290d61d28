"""HTML extraction, ranked search and vector codes against brute force, and their edge cases."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import codes, common, maintext, search

# 11 HTML extraction

WEIGHTS = maintext.Weights({}, {})
ARTICLE = "<article><h1>A title</h1><p>One two three.<p>Four <b>fi</b>ve &amp; six&nbsp;seven<br>eight.</p></article>"
TEXT = "A title\nOne two three.\nFour five & six seven eight."


@pytest.mark.parametrize(
    "html, want",
    [
        (None, ""),
        ("", ""),
        ("<p></p><div>", ""),
        (" plain  text\n here ", "plain text here"),
        (ARTICLE, TEXT),
        (f"<head><title>T</title><style>p{{}}</style></head><nav><a href=/>Home</a></nav>{ARTICLE}<footer>foot</footer>", TEXT),
        (f"<body class='has-sidebar'><div id=page class=with-ads><header><h1>Site</h1></header>{ARTICLE}<div class='sideBar'>side</div></div>", TEXT),
        (f"<form id=form1><div class=cookie-notice>We use cookies</div>{ARTICLE}<input value=x><button>Go</button></form>", TEXT),
        (f"<nav><ul><li>never closed{ARTICLE}", TEXT),
        (ARTICLE.replace("<p>One", "<aside>no</aside><div class='ad banner'>buy this now or never ever again</div><script>var a='<p>x</p>'</script><p>One"), TEXT),
        (ARTICLE.replace("</article>", "<section id=comments><article class=comment><p>I like it</p></article></section></article>"), TEXT),
        (ARTICLE.replace("</article>", "<form>Sign up <label>now</label></form><div role=alert>!</div><p hidden>h</p><p style='display: none'>h</p><p aria-hidden=true>h</p></article>"), TEXT),
        (ARTICLE.replace("<h1>", "<header><h1>").replace("</h1>", "</h1><p>By me</p></header>"), TEXT),
        (ARTICLE.replace("article", "div"), TEXT),
        (f"<div class=menu><a href=a>Home</a> <a href=b>About</a></div>{ARTICLE.replace('article', 'div')}<div id=sidebar>side words</div><div class=comments>said</div>", TEXT),
        (f"<p><a href=a>Home</a> <a href=b>About us</a></p>{ARTICLE.replace('article', 'main')}", TEXT),
        (f"<aside><article>a teaser</article></aside>{ARTICLE}", TEXT),
        ("<article>a<!-- never closed <p>b</article>", "a"),
        ("<article>a<b title='never closed <p>b</article>", "ab"),
        ("<article>a<p class=", "a"),
        ("<article>1 < 2 <3 & &copy; &#65; &amp;lt;</article>", "1 < 2 <3 & © A &lt;"),
        ("<ARTICLE>a<SCRIPT>b</SCRIPT ><TextArea><p>c</textarea>d</ARTICLE>", "ad"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table></article>", "a\nb\nc\nd\ne"),
        ("<div class=sidebar>all that there is</div>", "all that there is"),
        ("<article>a</article><div>many words that stand outside of it</div><article>b c d</article>", "b c d"),
    ],
)
def test_main_text(html, want):
    assert maintext.main_text(html, WEIGHTS) == want


def brute_region(blocks):
    """The best of all contiguous runs of (gap, score), from the definition."""
    best = 0.0
    for i in range(len(blocks)):
        for j in range(i, len(blocks)):
            best = max(best, sum(s for _, s in blocks[i : j + 1]) + sum(g for g, _ in blocks[i + 1 : j + 1]))
    return best


@pytest.mark.parametrize("seed", range(30))
def test_region_is_the_best_of_all(seed):
    rng = random.Random(seed)
    page, blocks = [], []
    for k in range(rng.randint(1, 14)):
        n, kind = rng.randint(1, 6), rng.choice("cclb")
        words = " ".join(f"w{k}x{i}" for i in range(n))
        page.append({"c": f"<p>{words}</p>", "l": f"<p><a href=x>{words}</a></p>", "b": f"<div class=ad>{words}</div>"}[kind])
        tags = 2 + (2 if kind == "l" else 0)
        blocks.append((-maintext.Weights.TAG * tags, {"c": n, "l": -n, "b": maintext.Weights.ASIDE * n}[kind]))
    text = maintext.main_text("".join(page), WEIGHTS)
    own, taken = set(re.findall(r"w(\d+)x", text)), []
    if not any(s > 0 for _, s in blocks):
        return
    first, last = min(map(int, own)), max(map(int, own))
    taken = blocks[first : last + 1]
    # Tags inside a link stand before its words too, so sums agree up to the cost of a few tags.
    assert abs(sum(s for _, s in taken) - brute_region(blocks)) <= 4 * maintext.Weights.TAG * len(blocks)


def test_words_of_a_name_are_learned(spark):
    html = "<div class='zz'>{0} a b</div><article><p class='yy'>{0} c d e</p><div class=share>s</div></article>"
    pages = spark.createDataFrame([(html.format(i),) for i in range(40)] + [(None,), ("",), ("<div class=yy>no main</div>",)], "html string")
    weights = maintext.train(pages)
    assert "zz" in weights.bad and "yy" not in weights.bad and "share" in weights.bad
    assert maintext.main_text("<div class=zz>x y z</div><div>a b</div>", weights) == "a b"
    few = maintext.train(pages.limit(5))
    assert "zz" not in few.bad


def test_extraction_of_odd_pages(spark):
    rows = [(1, "u", ARTICLE, "a", 5), (1, "u", ARTICLE, "a", 5), (None, None, None, "b", 6), (3, None, "", None, None), (4, "v", "<article>" + "<p>long text " * 100_000, "c", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, TEXT string, n_chars int")
    out = maintext.extract(pages, maintext.train(pages))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in out.collect()]
    long = "\n".join(["long text"] * 100_000)
    assert sorted(got, key=repr) == sorted([(1, "u", TEXT, len(TEXT))] * 2 + [(None, None, "", 0), (3, None, "", 0), (4, "v", long, len(long))], key=repr)
    assert maintext.extract(pages.limit(0), maintext.train(pages.limit(0))).count() == 0


def test_extraction_query(spark):
    from factloom.llm.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    import html as h

    got = QUERIES["op11_maximum_subsequence"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(h.unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split("</?(?:p|h1|br)>", body)]
        assert r.text == "\n".join(filter(None, blocks)) and r.n_chars == len(r.text)


# 12 ranked search


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, queries, k):
    """Every document scored for every query."""
    bags = [(d, Counter(terms_of(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n, total = len(bags), sum(x[2] for x in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in queries:
        scored = []
        for d, b, size in bags:
            m, score = 75 + 25 * size * n // total, 0
            for t in terms_of(text):
                if t in b:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 12 * m))
            if score > 0:
                scored.append((-score, d is not None, d or 0))
        out += [(item, i + 1, d if known else None, -s) for i, (s, known, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def frame(spark, docs, queries):
    return spark.createDataFrame([(t, d, 1, 2) for d, t in docs], "text string, doc_id long, rank int, score int"), spark.createDataFrame([(i, t, "x") for i, t in queries], "item_id long, text string, term string")


@pytest.mark.parametrize("seed, shard, part", [(0, 1 << 22, 1 << 20), (1, 300, 1 << 20), (2, 50, 20), (3, 2000, 100)])
def test_search_against_all_scores(spark, monkeypatch, seed, shard, part):
    monkeypatch.setattr(search, "SHARD_TERMS", shard)
    monkeypatch.setattr(search, "STEP", 40)
    rng = random.Random(seed)
    words = [f"w{int(60 * rng.random() ** 3)}" for _ in range(4000)] + ["É", "a_b", "X1", "的", "-", "of"]
    docs = [(rng.randint(0, 300), " ".join(rng.choices(words, k=rng.randint(0, 60)))) for _ in range(250)]
    docs += docs[:30] + [(None, docs[3][1]), (None, docs[3][1]), (7, None), (8, ""), (9, "-- ?"), (-5, docs[3][1]), (10, "solo " * 500)]
    queries = [(i, " ".join(rng.choices(words, k=rng.randint(0, 25)))) for i in range(12)] + [(3, "w1 w1 W2"), (None, "w0 w30"), (20, None), (21, "unknown"), (22, "solo"), (23, "w0")]
    got = search.search(*frame(spark, docs, queries), part_terms=part, k=7)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_search(docs, queries, 7)


def test_search_of_nothing(spark):
    docs, queries = frame(spark, [(1, "a b"), (2, "b c")], [(1, "b c")])
    assert search.search(docs.limit(0), queries).count() == 0
    assert search.search(docs, queries.limit(0)).count() == 0
    assert search.search(docs.where("doc_id = 9"), queries.where("item_id = 9")).count() == 0


def test_search_skips_what_cannot_win(spark):
    """Lists of frequent terms leave the merge, and the answer stays that of all scores."""
    rng = random.Random(5)
    docs = [(i, "the of and " * rng.randint(1, 5) + (f"rare{i % 9} " if i % 11 == 0 else "") + f"w{i % 50}") for i in range(3000)]
    queries = [(k, f"the of and rare{k} w{k}") for k in range(9)]
    got = search.search(*frame(spark, docs, queries))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_search(docs, queries, search.TOP)


def test_postings_bytes():
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.integers(0, 2**b, 50) for b in range(1, 62, 4)] + [[0, 127, 128, 16383, 16384]])
    data, begin = search.packed(values)
    assert (search.unpacked(data.tobytes()) == values).all() and begin[-1] == len(data)
    assert len(search.unpacked(search.packed(np.empty(0, np.int64))[0].tobytes())) == 0


# 13 vector codes


def brute_codes(rows, parts=4, entries=256, rounds=4):
    """Every vector against every entry, in Python integers."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ints = [[math.floor(1024 * x) for x in v] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is not None, kept[k][0] or 0, ints[k]))
    size = len(ints[0]) // parts
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for v in ints]
    books = [[cut[k][p] for k in order[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in cut:
                groups.setdefault(near(v[p], books[p])[1], []).append(v[p])
            for k, own in groups.items():
                books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [[near(v[p], books[p]) for p in range(parts)] for v in cut]
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for (i, _, _), f in zip(kept, found, strict=True)), key=repr), books


def random_vectors(rng, kind, n):
    x = rng.normal(size=(n, 12))
    if kind == "grid":  # many ties and repeated vectors
        x = rng.integers(-2, 3, size=(n, 12)) / 2
    if kind == "clusters":
        x = rng.normal(size=(20, 12))[rng.integers(0, 20, n)] + rng.normal(size=(n, 12)) / 50
    return [(int(i), list(map(float, v)), int(k)) for i, v, k in zip(rng.permutation(n), x.astype(np.float32), rng.integers(0, 3, n), strict=True)]


@pytest.mark.parametrize("kind, n", [("normal", 700), ("grid", 600), ("clusters", 700), ("normal", 40), ("grid", 1)])
def test_codes_against_all_entries(spark, kind, n):
    rng = np.random.default_rng(n)
    rows = random_vectors(rng, kind, n)
    rows += [(None, rows[0][1], None), (None, rows[-1][1], None), (3, rows[0][1], 1), (n + 1, None, 1), (n + 2, [*rows[0][1][:-1], None], 1), (n + 3, [float("nan")] * 12, 1), (n + 4, [*rows[0][1][:-1], float("-inf")], 1)]
    df = spark.createDataFrame([(a, b, c, "x", 1) for a, b, c in rows], "vec_id long, embedding array<float>, label int, code string, v int")
    got, books = codes.compress(df)
    want, entries = brute_codes(rows)
    assert sorted(((r.vec_id, r.code, r.error) for r in got.collect()), key=repr) == want
    assert [t.entries.tolist() for t in books.trees] == entries


def test_codes_of_odd_vectors(spark):
    kind = "vec_id long, embedding array<double>, label string"
    empty, books = codes.compress(spark.createDataFrame([], kind))
    assert empty.count() == 0 and books is None
    # Other lengths than the first's, lengths that cannot be cut, empty vectors.
    got, _ = codes.compress(spark.createDataFrame([(1, [1.0] * 4, "a"), (2, [1.0] * 8, "a"), (3, [], None)], kind))
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, "a", "00000000", 0), (2, "a", None, None), (3, None, None, None)]
    assert [r.code for r in codes.compress(spark.createDataFrame([(1, [1.0] * 5, "a")], kind))[0].collect()] == [None]
    assert [r.code for r in codes.compress(spark.createDataFrame([(1, [], "a"), (2, [], "a")], kind))[0].collect()] == ["00000000"] * 2
    with pytest.raises(Exception, match="beyond"):
        codes.compress(spark.createDataFrame([(1, [1e30] * 4, "a")], kind))


def test_tree_compares_less_and_finds_all():
    """Radii and gaps are safe: also of entries that lie exactly on a border, and of equal ones."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-(2**20), 2**20, (32, 8))
    entries = np.concatenate([centres[rng.integers(0, 32, 200)] + rng.integers(-999, 999, (200, 8)), centres[:56]])
    x = np.concatenate([centres[rng.integers(0, 32, 3000)] + rng.integers(-2000, 2000, (3000, 8)), entries, (entries[:100] + entries[100:200]) // 2])
    tree = codes.Tree(entries)
    code, d2 = tree.nearest(x)
    every = ((x[:, None, :] - entries) ** 2).sum(2)
    assert (code == every.argmin(1)).all() and (d2 == every.min(1)).all()
    assert tree.compared < every.size / 3
    same = codes.Tree(np.ones((256, 3), np.int64))
    assert (same.nearest(np.ones((5, 3), np.int64))[0] == 0).all()


def test_label_errors_count_nulls_together(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(i, v, None if k == 2 else k) for i, v, k in random_vectors(rng, "normal", 300)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    with common.scope():
        got = codes.op13_vantage_codes(spark, str(tmp_path)).collect()
    labels, sums = {i: k for i, _, k in rows}, Counter()
    for r in got:
        sums[labels[r.vec_id]] += r.error
    assert len(got) == 300 and all(r.label_error == sums[labels[r.vec_id]] for r in got) and {len(r.codebooks_sha256) for r in got} == {64}
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert codes.op13_vantage_codes(spark, f"{tmp_path}/none").agg(F.count("*")).first()[0] == 0
