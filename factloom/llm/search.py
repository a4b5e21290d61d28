"""Ranked lexical search: document-at-a-time over compressed postings in shards.

Index. A task cuts its documents into shards of about ``SHARD_TERMS`` terms. In
a shard documents are numbered by doc_id, and each term has a row: its number
of documents and its postings, gaps between document numbers and then term
counts, both as variable-length bytes. One more row (term ``""``) has the ids
and lengths of the shard's documents. No text and no posting is shuffled to
build it; the index is a table under the shared folder.

Search. Rows of the terms that are asked for are dealt by shard. For each item
a heap of list heads merges the postings of its terms in document order; a
bounded heap keeps the best documents by score and then doc_id. Lists whose
summed bounds cannot lift a document to the score that is needed leave the
merge and are looked up for its candidates only. Documents that would tie are
never left out. The score to beat starts at the k-th best of a few documents
that are scored beforehand, and stays from shard to shard within a task. Each
task gives at most ``k`` documents an item, and a last merge ranks them.

Memory. A task holds one shard: four million terms, or one longer document.
Items are sent to the tasks in parts of at most ``PART_TERMS`` terms (an item
of more is a part of its own); each part is a pass over its terms' rows.

Defined cases: null and empty texts have no terms and are neither counted nor
found; each row of ``queries`` is a query of its own, so repeated items are
answered twice, and items without terms get no row; repeated documents are
documents of their own and may both be listed; a null doc_id counts as the
smallest and comes back as null; other columns are not read; without documents
or items there is no row.
"""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.common import Workspace, raw, table

TOP = 20
SHARD_TERMS = 1 << 22
PART_TERMS = 1 << 20
#: Characters of a text whose terms are numbered at a time.
STEP = 1 << 20
#: Up to so many different terms are sent to every task as a table; more are joined by exchange.
SENT_TERMS = 200_000
#: Shards searched in a task, one after another, if there are enough for all.
SHARDS_A_TASK = 8
#: Lists whose best documents are scored beforehand.
PROBED = 8

_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
INDEX = "shard long, term string, n long, total long, postings binary, ids array<long>, lengths array<long>"


def term_lists(text: bytes | None):
    """Terms of a text in UTF-8, a list for every ``STEP`` bytes or so."""
    flat, at = (text or b"").translate(_TERMS), 0
    while at < len(flat):
        end = flat.find(b" ", at + STEP)
        end = len(flat) if end < 0 else end
        yield flat[at:end].split()
        at = end


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes of seven bits, the high bit set on all but the last byte; and where each number begins."""
    v = values.astype(np.uint64)
    n = np.ones(len(v), np.int64)
    for k in range(1, 10):
        n += v >= np.uint64(1) << np.uint64(7 * k)
    begin = np.concatenate(([0], np.cumsum(n)))
    out = np.empty(begin[-1], np.uint8)
    for k in range(int(n.max(initial=0))):
        own = n > k
        out[begin[:-1][own] + k] = (v[own] >> np.uint64(7 * k)).astype(np.uint8) & 127 | (n[own] > k + 1).astype(np.uint8) << 7
    return out, begin


def unpacked(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    begin = np.concatenate(([0], np.flatnonzero(b < 128) + 1))
    if len(b) == len(begin) - 1:
        return b.astype(np.int64)
    place = np.arange(len(b)) - np.repeat(begin[:-1], np.diff(begin))
    return np.add.reduceat((b & 127).astype(np.int64) << 7 * place, begin[:-1])


class _Numbers(dict):
    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


class Shard:
    """Documents gathered until there are enough for a shard."""

    def __init__(self):
        self.numbers, self.ids, self.lengths, self.parts, self.size = _Numbers(), [], [], [], 0

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        parts = [np.array(list(map(self.numbers.__getitem__, terms)), np.int32) for terms in term_lists(text) if terms]
        if parts:
            self.ids.append(doc_id)
            self.lengths.append(sum(map(len, parts)))
            self.parts += parts
            self.size += self.lengths[-1]

    def rows(self, shard: int) -> pa.RecordBatch:
        order = sorted(range(len(self.ids)), key=lambda d: (self.ids[d] is not None, self.ids[d] or 0))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        key = np.concatenate(self.parts).astype(np.int64) << 32 | np.repeat(place, self.lengths)
        key, tf = np.unique(key, return_counts=True)
        doc = key & 0xFFFFFFFF
        first = np.flatnonzero(np.diff(key >> 32, prepend=-1))
        n = np.diff(np.append(first, len(key)))
        gap = np.diff(doc, prepend=0)
        gap[first] = doc[first]
        # Each term's gaps, then its counts.
        at = np.arange(len(key)) - np.repeat(first, n) + 2 * np.repeat(first, n)
        both = np.empty(2 * len(key), np.int64)
        both[at], both[at + np.repeat(n, n)] = gap, tf
        data, begin = packed(both)
        cut = begin[2 * np.append(first, len(key))]
        data = data.tobytes()
        terms = list(self.numbers)
        rows = len(first)
        columns = [
            pa.array([shard] * (rows + 1), pa.int64()),
            pa.array([b"", *terms], pa.binary()).cast(pa.string()),
            pa.array([len(order), *n.tolist()], pa.int64()),
            pa.array([self.size, *np.add.reduceat(tf, first).tolist()], pa.int64()),
            pa.array([None, *(data[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))], pa.binary()),
            pa.array([[self.ids[d] for d in order], *[None] * rows], pa.list_(pa.int64())),
            pa.array([[self.lengths[d] for d in order], *[None] * rows], pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "term", "n", "total", "postings", "ids", "lengths"])


def index(ws: Workspace, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The postings of all terms of ``docs`` as a written table (``INDEX``)."""
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("d"), F.col(f"`{text}`").alias("t"))

    def run(batches):
        from pyspark import TaskContext

        number, shard = TaskContext.get().partitionId() << 32, Shard()
        for batch in batches:
            for d, t in zip(batch.column("d").to_pylist(), raw(batch, "t"), strict=True):
                shard.add(d, t)
                if shard.size >= SHARD_TERMS:
                    yield shard.rows(number)
                    number, shard = number + 1, Shard()
        if shard.ids:
            yield shard.rows(number)

    return ws.write(own.mapInArrow(run, INDEX))


class Postings:
    """One term in one shard: document numbers, and the part of the score that does not depend on the query."""

    def __init__(self, data: bytes, norm: np.ndarray):
        v = unpacked(data)
        docs, tf = np.cumsum(v[: len(v) // 2]), v[len(v) // 2 :]
        parts = 1_000_000_000 * tf // (1000 * tf + norm[docs])
        self.most, self.docs, self.parts = int(parts.max()), docs, parts
        self.doc, self.part = array("i", docs.astype(np.int32).tobytes()), array("q", parts.tobytes())

    def best(self, k: int) -> np.ndarray:
        return self.docs if len(self.docs) <= k else self.docs[np.argpartition(self.parts, -k)[-k:]]

    def scores(self, docs: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.docs, docs)
        at[at == len(self.docs)] = 0
        return np.where(self.docs[at] == docs, self.parts[at], 0)


class Best:
    """The k best documents of an item so far; of equal scores the smaller ids are better."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    @property
    def least(self) -> int:
        """A document that scores less cannot get in."""
        return self.heap[0][0] if len(self.heap) == self.k else 1

    def add(self, score: int, key: int) -> None:
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, (score, -key))
        elif (score, -key) > self.heap[0]:
            heapq.heapreplace(self.heap, (score, -key))


def merge(terms: list[tuple[int, Postings]], keys: list[int], best: Best) -> None:
    """Documents of one shard into ``best``, document at a time. ``terms`` have a weight each, ``keys`` the ids by document number."""
    terms = sorted(terms, key=lambda x: x[0] * x[1].most)
    if not terms:
        return
    weights, lists = zip(*terms, strict=True)
    #: What the first lists can give at most, all together.
    bound = [0, *accumulate(w * x.most for w, x in terms)]
    need = best.least
    some = np.unique(np.concatenate([x.best(best.k) for x in lists[-PROBED:]]))
    if len(some) >= best.k:
        known = sum(w * x.scores(some) for w, x in terms)
        need = max(need, int(np.partition(known, -best.k)[-best.k]))
    idle = 0  # lists that have left the merge
    while idle < len(lists) and bound[idle + 1] < need:
        idle += 1
    docs, parts, at = [x.doc for x in lists], [x.part for x in lists], [0] * len(lists)
    heads = [(docs[j][0], j) for j in range(idle, len(lists))]
    heapq.heapify(heads)
    while heads:
        doc, score = heads[0][0], 0
        while heads and heads[0][0] == doc:
            j = heads[0][1]
            i = at[j]
            score += weights[j] * parts[j][i]
            at[j] = i = i + 1
            if i < len(docs[j]):
                heapq.heapreplace(heads, (docs[j][i], j))
            else:
                heapq.heappop(heads)
        for j in range(idle - 1, -1, -1):
            if score + bound[j + 1] < need:
                break
            at[j] = i = bisect_left(docs[j], doc, at[j])
            if i < len(docs[j]) and docs[j][i] == doc:
                score += weights[j] * parts[j][i]
        if score < need:
            continue
        best.add(score, keys[doc])
        if best.least > need:
            need, before = best.least, idle
            while idle < len(lists) and bound[idle + 1] < need:
                idle += 1
            if idle > before:
                heads = [h for h in heads if h[1] >= idle]
                heapq.heapify(heads)


def _searched(sent, k: int):
    null = -(1 << 64)

    def run(batches):
        queries = sent.value
        bests: dict[int, Best] = {}

        def answer(ids, norm, rows):
            keys = [null if i is None else i for i in ids]
            lists = {t: Postings(p, norm) for t, p in rows.items()}
            for q, terms in queries.items():
                own = [(w, lists[t]) for t, w in terms if t in lists]
                if own:
                    merge(own, keys, bests.setdefault(q, Best(k)))

        shard, ids, norm, rows = None, [], None, {}
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("shard", "term", "postings", "ids", "norm")]
            for own, term, postings, docs, m in zip(*columns, strict=True):
                if own != shard:
                    if rows:
                        answer(ids, norm, rows)
                    shard, rows = own, {}
                if term == "":  # sorts first
                    ids, norm = docs, np.array(m, np.int64)
                else:
                    rows[term] = postings
        if rows:
            answer(ids, norm, rows)
        out = [(q, None if -key == null else -key, score) for q, best in bests.items() for score, key in best.heap]
        q, d, s = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(d, pa.int64()), pa.array(s, pa.int64())], names=["q", "doc_id", "score"])

    return run


def _query_terms(batches):
    for batch in batches:
        out = []
        for q, text in zip(batch.column("q").to_pylist(), raw(batch, "t"), strict=True):
            own: Counter[bytes] = Counter()
            for terms in term_lists(text):
                own.update(terms)
            out += [(q, t, n) for t, n in own.items()]
        q, t, n = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(t, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["q", "term", "n"])


def search(
    docs: DataFrame,
    queries: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    k: int = TOP,
    part_terms: int = PART_TERMS,
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of every item."""
    spark = docs.sparkSession
    ws = Workspace(spark)
    postings = index(ws, docs, doc_id=doc_id, text=text)
    head = F.col("term") == ""
    total = postings.where(head).agg(F.count("*").alias("shards"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).first()
    tasks = max(1, min(total["shards"], max(2 * spark.sparkContext.defaultParallelism, total["shards"] // SHARDS_A_TASK)))
    items = ws.write(queries.select(F.monotonically_increasing_id().alias("q"), F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("t")))
    asked = ws.write(items.select("q", "t").mapInArrow(_query_terms, "q long, term string, n long"))
    some = lambda terms: F.broadcast(terms) if count <= SENT_TERMS else terms
    count = asked.count()
    df = postings.join(some(asked.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * total["n"] + 2) / (2.0 * F.col("df") + 1)))
    weighed = ws.write(asked.join(df, "term").select("q", "term", (F.col("n") * weight).alias("w")))
    parts = -(-count // part_terms) or 1
    part = F.pmod(F.xxhash64("q"), F.lit(parts))
    m = F.expr(f"transform(lengths, n -> 12 * (75 + (25 * n * {int(total['n'])}L) div {max(1, int(total['total']))}L))")
    found = None
    for p in range(parts):
        own = weighed if parts == 1 else weighed.where(part == p)
        sent: dict[int, list[tuple[str, int]]] = {}
        for q, t, w in own.toLocalIterator():
            sent.setdefault(q, []).append((t, w))
        names = own.select("term").distinct().unionByName(spark.createDataFrame([("",)], "term string"))
        dealt = postings.join(some(names), "term", "left_semi").select("shard", "term", "postings", "ids", m.alias("norm")).repartition(tasks, "shard").sortWithinPartitions("shard", "term")
        hits = dealt.mapInArrow(_searched(spark.sparkContext.broadcast(sent), k), "q long, doc_id long, score long")
        found = hits if found is None else found.unionByName(hits)
    order = W.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(items.select("q", "item_id"), "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op12_ranked_search(spark, sf_dir):
    """The 20 best documents of every benchmark item, over all documents."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SPLIT = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP12_SQL = f"""
with doc as (select row_number() over () as d, doc_id, {_SPLIT} as terms from documents where text is not null),
item as (select row_number() over () as q, item_id, {_SPLIT} as terms from benchmark where text is not null),
total as (select count(*)::bigint as n, sum(len(terms))::bigint as l from doc where len(terms) > 0),
asked as (select q, term, count(*)::bigint as reps from (select q, unnest(terms) as term from item) group by all),
tf as (select d, term, count(*)::bigint as tf from (select d, unnest(terms) as term from doc) where term in (select term from asked) group by all),
w as (select term, floor(1000 * ln((2 * any_value(total.n) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, total group by term),
m as (select d, doc_id, 75 + (25 * len(terms)::bigint * total.n) // total.l as m from doc, total where len(terms) > 0),
scored as (select q, d, doc_id, sum(reps * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score from asked join w using (term) join tf using (term) join m using (d) group by all),
ranked as (select q, doc_id, score, row_number() over (partition by q order by score desc, doc_id nulls first) as rank from scored where score > 0)
select item_id, rank::integer as rank, doc_id, score from ranked join item using (q) where rank <= {TOP}
"""
