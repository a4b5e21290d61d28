"""HTML extraction by maximum-scoring subsequence.

A page is a sequence of words and tags. A word scores what the element that it
is in has learned, positive in content and negative in boilerplate; tags score
negative. One linear scan finds the contiguous region of greatest sum. Its text
is the words of the region less those of boilerplate elements inside it.

Weights come from labelled pages. A page labels itself if it marks its main text
by one ``article``, ``main`` or ``role=main`` element: words in it are content,
unless an element inside has a name known for boilerplate, and all others are
not. Spark counts, over a bounded sample of such pages (``PAGES`` by hash), on how
many pages words of either kind stand in elements of each name (a structural tag,
a role, or a word of class and id), and how often each tag stands inside and
outside. To the counts of names come those of ``PRIOR`` pages, so that a corpus
without sidebars still knows what a sidebar is. A name's weight is the logarithm
of the two counts' ratio, and at ``BAR`` or below the name is boilerplate; a tag's
is a small negative number that grows with its share outside. Weights are a
dictionary of at most ``NAMES`` names.

Rules of the region. A page's main elements are those that do not stand in
boilerplate, or all if each does (a form or a menu that is never closed may hold
the page); names on elements around them say nothing. In a page with a main
element, words outside all of them cost as much as words inside gain, and
boilerplate inside is left out at no cost. Without one, boilerplate costs a
quarter of a word, a block in which links have most of the words scores negative,
and names of class and id give way if no word would be left. A header inside
the main element is boilerplate less its headings.

Text. Scripts, styles, templates, heads, forms' fields, comments and hidden
elements have no words. Character references are decoded once. White space inside
a block is one space (a line break too), blocks are joined by one line feed, empty
blocks are left out. Nothing else of the region is dropped or cut.

Work is linear in the page: every character is read once, end tags look at
most ``DEPTH`` open elements back, and the scan adds as it goes. A page is
held in memory as its words' blocks, about its own size.

Defined cases: null, empty and wordless pages, and pages whose words all score
negative, give an empty text; a page without markup is one block of content;
unclosed tags, quotes and comments are read as browsers do; repeated rows each
give a row; null page_id and url pass; columns that clash with the added ones
give way; an empty table gives no row and learns the prior alone.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import extended, table, without

PAGES = 2000
NAMES = 10_000
#: Pages that must have a name before it is learned.
LEAST = 20
PRIOR = 20
DEPTH = 256

# Names that pages commonly give to what is not main text, and to what is.
BOILERPLATE = (
    "nav navigation navbar menu menus breadcrumb breadcrumbs pagination pager toolbar tabs skip aside sidebar complementary widget widgets header masthead banner topbar search logo brand branding "
    "footer contentinfo copyright colophon ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted adsbygoogle "
    "notice notices cookie cookies cookiebar consent gdpr privacy disclaimer alert alertdialog dialog modal popup overlay paywall "
    "form login signup signin subscribe subscription newsletter share sharing social follow related recommended recommendations trending popular "
    "comment comments commentlist disqus reply replies respond discussion feedback reactions"
).split()
KNOWN = frozenset(BOILERPLATE)
CONTENT = "article main content post entry story body text".split()
#: Tags whose own name counts as a name of the element.
STRUCTURAL = frozenset("nav header footer aside form dialog menu search article main".split())
#: What stays boilerplate where names of class and id give way.
FRAME = frozenset("nav header footer aside".split())
#: Elements without words.
SILENT = frozenset("head script style template noscript iframe object embed svg math canvas audio video select option optgroup datalist button textarea input label title".split())
#: Elements whose inside is not markup.
OPAQUE = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr frame keygen".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend "
    "li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag closes, if it is open, up to the nearest of the bounds.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
ENDS_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "head", "body", "html", "title", "legend", "summary"}

_ATTRIBUTE = r"""[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+"""
_MARKUP = re.compile(rf"<(?:(/?)([a-zA-Z][^\s/>]*+)((?:{_ATTRIBUTE})*+)>|!--|[!?/])")
_OPENED = re.compile(r"<(?:!--|/?[a-zA-Z])")
_CLOSING = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in OPAQUE}
_NAMED = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?![^\s=>/])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PIECES = re.compile(r"[^a-z]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_STATES = frozenset("has with no without is not js".split())


def names_of(tag: str, attributes: str) -> tuple[frozenset[str], bool, bool]:
    """Names of an element, whether it is marked as main, and whether it is hidden."""
    names, main, hidden = ({tag} if tag in STRUCTURAL else set()), tag in ("article", "main"), False
    if attributes and tag not in ("a", "html", "body"):
        for key, a, b, c in _NAMED.findall(attributes):
            key, value = key.lower(), entities.unescape(a or b or c)
            if key == "hidden":
                hidden = True
            elif key == "aria-hidden":
                hidden |= value.strip().lower() == "true"
            elif key == "style":
                hidden |= bool(_UNSEEN.search(value))
            else:
                for word in value.split():
                    pieces = [p for p in _PIECES.split(_CAMEL.sub(" ", word).lower()) if p]
                    if pieces and pieces[0] not in _STATES:  # "has-sidebar" is no sidebar
                        names.update(pieces)
                main |= key == "role" and value.strip().lower() == "main"
    return frozenset(names), main, hidden


class Element:
    __slots__ = ("above", "blamed", "holds_main", "in_main", "main", "names", "silent", "tag")

    def __init__(self, tag: str, names: frozenset[str], main: bool, silent: bool, above: Element | None):
        self.tag, self.names, self.main, self.above = tag, names, main, above
        self.silent = silent or (above is not None and above.silent)
        #: In an element of a name that is known for boilerplate, or one itself.
        self.blamed = (above is not None and above.blamed) or not KNOWN.isdisjoint(names)
        self.in_main = self.holds_main = False


class Page:
    """``blocks``: runs of text with the element that each stands in, ``None`` for a block's end, and ``str`` for a tag."""

    def __init__(self, html: str):
        self.root = Element("", frozenset(), False, False, None)
        self.elements, self.tokens = [self.root], []
        self._read(html)
        found = [e for e in self.elements if e.main and not e.silent]
        found = [e for e in found if not e.blamed] or found
        self.has_main = bool(found)
        chosen = set(map(id, found))
        for e in self.elements:  # parents come first
            e.in_main = id(e) in chosen or (e.above is not None and e.above.in_main)
        for e in found:
            up = e.above
            while up is not None and not up.holds_main:
                up.holds_main, up = True, up.above
        self.mains = sum(not e.above.in_main for e in found)

    def _text(self, raw: str, element: Element) -> None:
        if raw and not element.silent:
            self.tokens.append((entities.unescape(raw) if "&" in raw else raw, element))

    def _read(self, html: str) -> None:
        stack, at, last, n = [self.root], 0, html.rfind(">"), len(html)
        open_tags: Counter[str] = Counter()
        tokens = self.tokens

        def close(depth: int) -> None:
            for e in stack[depth:]:
                open_tags[e.tag] -= 1
            del stack[depth:]

        def nearest(tags: tuple[str, ...], bounds=()) -> int:
            """Depth of the innermost open element of these tags, 0 if there is none."""
            if any(open_tags[t] for t in tags):
                for depth in range(len(stack) - 1, max(0, len(stack) - 1 - DEPTH), -1):
                    if stack[depth].tag in tags:
                        return depth
                    if stack[depth].tag in bounds:
                        break
            return 0

        while at < n:
            here = html.find("<", at)
            while 0 <= here <= last:
                found = _MARKUP.match(html, here)
                if found or _OPENED.match(html, here):
                    break
                here = html.find("<", here + 1)
            if not 0 <= here <= last or not found:
                # A comment or a tag that is never closed hides the rest; other text is text.
                cut = _OPENED.search(html, at)
                self._text(html[at : cut.start() if cut else n], stack[-1])
                return
            self._text(html[at:here], stack[-1])
            end, name, attributes = found.group(1, 2, 3)
            at = found.end()
            if name is None:
                if found.group() == "<!--":
                    stop = html.find("-->", here + 2)
                    at = stop + 3 if stop >= 0 else n
                else:
                    at = html.find(">", here) + 1
                continue
            tag = name.lower()
            if tag == "br":
                self._text(" ", stack[-1])
                continue
            block = tag in BLOCKS
            if block:
                tokens.append((None, stack[-1]))
            tokens.append((tag, None))
            if end:
                depth = nearest((tag,), () if block else BLOCKS)
                if depth:
                    close(depth)
                continue
            if tag in ENDS_P and open_tags["p"]:
                depth = nearest(("p",), ("td", "th", "table", "button"))
                if depth:
                    close(depth)
            if tag in CLOSES:
                depth = nearest(*CLOSES[tag])
                if depth:
                    close(depth)
            if tag in VOID:
                continue
            names, main, hidden = names_of(tag, attributes)
            element = Element(tag, names, main, hidden or tag in SILENT, stack[-1])
            self.elements.append(element)
            if tag in OPAQUE:
                stop = _CLOSING[tag].search(html, at)
                at = stop.start() if stop else n
                if stop:
                    at = html.find(">", at) + 1 or n
                continue
            if attributes.rstrip().endswith("/") and tag in ("svg", "math", "path"):
                continue
            stack.append(element)
            open_tags[tag] += 1


class Weights:
    """Learned weights. ``names``: logarithm of content to boilerplate; ``tags``: what a tag costs."""

    WORD = 1.0
    OUTSIDE = -1.0
    #: A word of boilerplate in a page without a main element.
    ASIDE = -0.25
    TAG = 0.02
    #: At this weight and below a name is boilerplate.
    BAR = -1.0

    def __init__(self, names: dict[str, tuple[int, int]], tags: dict[str, tuple[int, int]]):
        prior = dict.fromkeys(CONTENT, (PRIOR, 0)) | dict.fromkeys(BOILERPLATE, (0, PRIOR))
        every = {n: tuple(map(sum, zip(names.get(n, (0, 0)), prior.get(n, (0, 0)), strict=True))) for n in names.keys() | prior.keys()}
        self.names = {n: math.log((c + 1) / (b + 1)) for n, (c, b) in every.items()}
        self.bad = frozenset(n for n, w in self.names.items() if w <= self.BAR)
        #: Inside the main text a tag must cost less than a word, however short its block: at most a tenth for one that is never there.
        self.tags = {t: -self.TAG * (1 + 4 * b / (c + b)) for t, (c, b) in tags.items()}

    def tag(self, tag: str) -> float:
        return self.tags.get(tag, -self.TAG)

    def boilerplate(self, page: Page, hints: bool = True) -> dict[int, int]:
        """By an element's id: 0 for content, 1 for a header, 2 for other boilerplate."""
        out: dict[int, int] = {}
        for e in page.elements:  # parents come first
            state = out[id(e.above)] if e.above is not None else 0
            bad = () if e.holds_main else e.names & (self.bad if hints else FRAME)
            if bad:
                state = max(state, 1 if bad == {"header"} else 2)
            elif state == 1 and e.in_main and e.tag in HEADINGS:
                state = 0
            out[id(e)] = state
        return out


def main_text(html: str | None, weights: Weights) -> str:
    """The text of the best contiguous region of a page."""
    page = Page(html or "")
    text = _region(page, weights, True)
    return text or _region(page, weights, False) if not page.has_main else text


def _region(page: Page, weights: Weights, hints: bool) -> str:
    boiler = weights.boilerplate(page, hints)
    #: Blocks of the page in order: text, cost of the tags before it, score of its words.
    blocks: list[tuple[str, float, float]] = []
    gap, parts, good, bad, linked = 0.0, [], 0, 0.0, 0

    def flush() -> None:
        nonlocal gap, parts, good, bad, linked
        text = " ".join("".join(parts).split()) if parts else ""
        if text or bad:
            links = not page.has_main and good and linked * 2 > good
            score = good * (weights.OUTSIDE if links else weights.WORD) + bad
            blocks.append((text, gap, score))
            gap = 0.0
        parts, good, bad, linked = [], 0, 0.0, 0

    anchors: dict[int, bool] = {}
    for token, element in page.tokens:
        if token is None:
            flush()
        elif element is None:
            gap += weights.tag(token)
        else:
            n = len(token.split())
            if page.has_main and not element.in_main:
                bad += n * weights.OUTSIDE
                continue
            if boiler[id(element)]:
                bad += 0 if page.has_main else n * weights.ASIDE
                continue
            parts.append(token)
            good += n
            if n and not page.has_main:
                known = anchors.get(id(element))
                if known is None:
                    up = element
                    while up is not None and up.tag != "a" and up.tag not in BLOCKS:
                        up = up.above
                    known = anchors[id(element)] = up is not None and up.tag == "a"
                linked += n if known else 0
    flush()
    # The linear scan: the best sum that ends at each block, and the best of all.
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for k, (_, before, score) in enumerate(blocks):
        total += before
        if total <= 0:
            total, start = 0.0, k
        total += score
        if total > best:
            best, span = total, (start, k + 1)
    return "\n".join(text for text, _, _ in blocks[slice(*span)] if text)


def counted(html: str | None) -> tuple[Counter, Counter] | None:
    """Words by name and kind, and tags by kind, of a page that labels itself; None for others."""
    page = Page(html or "")
    if page.mains != 1:
        return None
    names: Counter[tuple[str, bool]] = Counter()
    tags: Counter[tuple[str, bool]] = Counter()
    inside = False
    for token, element in page.tokens:
        if element is not None and token is not None:
            inside = element.in_main and not element.blamed
            if token.split():
                up = element
                while up is not None:
                    for name in up.names:
                        if not up.holds_main:
                            names[name, inside] = 1
                    up = up.above
        elif token is not None:
            tags[token, inside] += 1
    return names, tags


def train(pages: DataFrame, *, html: str = "html", sample: int = PAGES) -> Weights:
    """Weights from pages that label themselves, among at most about ``sample`` chosen by hash of their whole text.

    Names are counted once a page, so a page says of a name that it is inside, outside, or both.
    """
    own = pages.select(F.col(f"`{html}`").alias("h")).where("h is not null")
    total = own.count()
    if total > sample:
        own = own.where(F.pmod(F.xxhash64("h"), F.lit(total)) < sample)

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column("h").to_pylist():
                found = counted(text)
                if found:
                    rows += [(kind, name, inside, n) for kind, own in zip(("name", "tag"), found, strict=True) for (name, inside), n in own.items()]
            kind, name, inside, n = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(name, pa.string()), pa.array(inside, pa.bool_()), pa.array(n, pa.int64())], names=["kind", "name", "inside", "n"])

    sums = [F.sum(F.when(F.col("inside") == side, F.col("n")).otherwise(0)).alias(c) for side, c in ((True, "c"), (False, "b"))]
    counts = own.mapInArrow(run, "kind string, name string, inside boolean, n long").groupBy("kind", "name").agg(*sums)
    counts = counts.where((F.col("kind") == "tag") | (F.col("c") + F.col("b") >= LEAST)).orderBy((F.col("c") + F.col("b")).desc(), "kind", "name").limit(NAMES).collect()
    split = {kind: {r["name"]: (r.c, r.b) for r in counts if r.kind == kind} for kind in ("name", "tag")}
    return Weights(split["name"], split["tag"])


def extract(pages: DataFrame, weights: Weights, *, html: str = "html", keep_html: bool = False) -> DataFrame:
    """``pages`` with the main text and its number of characters."""
    pages = without(pages, "text", "n_chars")
    kept = [f for f in pages.schema.fields if keep_html or f.name != html]
    sent = pages.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            texts = [main_text(h, sent.value) for h in batch.column(html).to_pylist()]
            yield extended(batch, () if keep_html else (html,), text=pa.array(texts, pa.string()), n_chars=pa.array(map(len, texts), pa.int64()))

    return pages.mapInArrow(run, T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))


def op11_maximum_subsequence(spark, sf_dir):
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, train(pages))
