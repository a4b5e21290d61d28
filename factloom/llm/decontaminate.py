"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Texts are lower-cased in A-Z and cut into words of digits, letters and
non-ASCII characters. Each benchmark item gives every run of ``window``
consecutive words as a pattern (an item of fewer words is one pattern).
Patterns of one length share a block shift table, addressed by a hash of the
last ``BLOCK`` words at a position: it says how far the search may jump. Where
it says 0 the suffix may be that of a pattern; the pattern's bucket is found by
its hash, and a direct comparison of all words confirms.

Memory. The tables are flat arrays, about 6 bytes for a byte of benchmark text,
and vocabulary. The benchmark is cut into segments and dealt into parts of at
most ``part_bytes``; one part is in memory at a time, on the driver and in a
task. With one part a single pass gives the verdicts. With more, documents are
written once with a row number; each part's pass writes the hits that it finds,
and hits are joined by row number at the end. The result is the same.

Defined cases: a null or wordless text has no words and no hits; an item
without words has no pattern; repeated items count once by ``item_id``; an
item with a null id marks words but is not listed; an empty benchmark leaves
every document clean; rows are never merged, so repeated documents each get
their row. Input columns that clash with the added ones give way.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import Workspace, extended, raw, table, without

WINDOW = 13
BLOCK = 2
#: Benchmark text in memory at a time.
PART_BYTES = 32 << 20
#: Words of a segment; longer items are cut, with overlaps of ``window - 1`` words.
SEGMENT = 1 << 16
#: Positions that are confirmed at a time.
STEP = 1 << 15

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
ADDED = ("n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes | None) -> list[bytes]:
    """Of a text in UTF-8, where all bytes of a non-ASCII character are over 127."""
    return text.translate(_WORDS).split() if text else []


class Table:
    """All patterns of one length: shifts by block hash, and patterns by their hash with the items that have them."""

    def __init__(self, tokens: np.ndarray, starts: np.ndarray, items: np.ndarray, m: int):
        self.m, self.size = m, min(BLOCK, m)
        self.steps, self.powers = np.arange(m), np.cumprod(np.full(m, _MIX))
        self.bits = max(10, int(4 * len(starts)).bit_length())
        self.shift = np.full(1 << self.bits, m - self.size + 1, np.uint8 if m < 256 else np.uint32)
        for end in range(self.size, m + 1):  # later ends say less, so the last word stands
            self.shift[self.block(tokens, starts + end - 1)] = m - end
        h = self.whole(tokens, starts)
        order = np.lexsort((items, h))
        h, starts, items = h[order], starts[order], items[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        for k in range(m):
            new[1:] |= tokens[starts[1:] + k] != tokens[starts[:-1] + k]
        first = np.flatnonzero(new)
        #: A pattern's hash, one of its places, and where its items begin.
        self.hash, self.place, self.items, self.begin = h[first], starts[first], items, np.append(first, len(h))

    def block(self, tokens: np.ndarray, end: np.ndarray) -> np.ndarray:
        key = tokens[end].astype(np.uint64)
        if self.size > 1:
            key += tokens[end - 1].astype(np.uint64) * _MIX
        return ((key * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def whole(self, tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = [(tokens[starts[a : a + STEP, None] + self.steps].astype(np.uint64) * self.powers).sum(1, dtype=np.uint64) for a in range(0, len(starts), STEP)]
        return np.concatenate([np.empty(0, np.uint64), *out])

    def candidates(self, at: np.ndarray) -> list[int]:
        """Ends of the positions that the shifts do not rule out."""
        n, m = len(at), self.m
        ends = np.arange(m - 1, n)
        step, i, out = self.shift[self.block(at, ends)].tolist(), 0, []
        while i < len(step):
            far = step[i]
            if far:
                i += far
            else:
                out.append(i)
                i += 1
        return out

    def search(self, tokens: np.ndarray, at: np.ndarray):
        """Pairs of a start in ``at`` and the pattern that is there."""
        if len(at) < self.m:
            return
        found = np.array(self.candidates(at), np.int64)  # an end less m - 1 is the start
        for a in range(0, len(found), STEP):
            start = found[a : a + STEP]
            h = self.whole(at, start)
            low, high = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
            if not (high > low).any():
                continue
            start, low, n = start[high > low], low[high > low], (high - low)[high > low]
            pattern = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            start = np.repeat(start, n)
            same = (at[start[:, None] + self.steps] == tokens[self.place[pattern][:, None] + self.steps]).all(axis=1)
            if same.any():
                yield start[same], pattern[same]


class Patterns:
    """Shift and bucket tables, one pair per pattern length."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        names: dict[str | None, int] = {}
        flat, spans, size = [], [], 0
        for item_id, text in items:
            seq = words(text.encode() if isinstance(text, str) else text)
            if seq:
                flat.append(np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in seq], np.int32))
                spans.append((size, len(seq), names.setdefault(item_id, len(names))))
                size += len(seq)
        self.names = list(names)
        self.tokens = np.concatenate(flat) if flat else np.empty(0, np.int32)
        by_length: dict[int, list] = {}
        for start, n, item in spans:
            m = min(window, n)
            by_length.setdefault(m, []).append((np.arange(start, start + n - m + 1), np.full(n - m + 1, item, np.int32)))
        self.tables = [Table(self.tokens, *map(np.concatenate, zip(*own, strict=True)), m) for m, own in sorted(by_length.items())]

    def find(self, seq: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The hit words of ``seq`` as disjoint spans (end exclusive), and the ids of the items found."""
        at = np.array(list(map(self.ids.get, seq, repeat(0))), np.int32)
        edge, items = None, set()
        for table_of in self.tables:
            for start, pattern in table_of.search(self.tokens, at):
                if edge is None:
                    edge = np.zeros(len(seq) + 1, np.int64)
                edge += np.bincount(start, minlength=len(edge)) - np.bincount(start + table_of.m, minlength=len(edge))
                for p in np.unique(pattern):
                    items.update(np.unique(table_of.items[table_of.begin[p] : table_of.begin[p + 1]]).tolist())
        if edge is None:
            return [], set()
        hit = np.diff(np.concatenate(([0], (np.cumsum(edge) > 0).view(np.int8))))
        return list(zip(np.flatnonzero(hit == 1).tolist(), np.flatnonzero(hit == -1).tolist(), strict=True)), {self.names[k] for k in items} - {None}


def segments(items: DataFrame, *, item_id: str = "item_id", text: str = "text", window: int = WINDOW, size: int = SEGMENT) -> DataFrame:
    """``(i, t)``: the items' words, joined by spaces, in segments of bounded size that have every window."""
    own = items.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).where("t is not null")

    def run(batches):
        for batch in batches:
            for name, body in zip(batch.column("i").to_pylist(), raw(batch, "t"), strict=True):
                seq = words(body)
                for k in range(0, max(1, len(seq) - window + 1) if seq else 0, size):
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([b" ".join(seq[k : k + size + window - 1])], pa.binary())], names=["i", "t"])

    return own.mapInArrow(run, "i string, t binary").distinct()


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    least: int = 20,
    part_bytes: int = PART_BYTES,
    keep_text: bool = True,
) -> DataFrame:
    """``docs`` with hit counts, hit items and the verdict.

    ``contaminated``: any word hit and ``least * n_hit >= n_words``.
    """
    docs = without(docs, *ADDED, "_row", "_spans")
    ws = Workspace(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    items = ws.write(segments(benchmark, item_id=item_id, text=item_text, window=window))
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first()["n"]
    parts = -(-size // part_bytes) or 1
    part = F.pmod(F.xxhash64("i", "t"), F.lit(parts))

    def send(k: int):
        return sc.broadcast(Patterns([(r.i, bytes(r.t)) for r in items.where(part == k).collect()], window))

    kept = [f for f in docs.schema.fields if keep_text or f.name != text]
    kinds = {"n_words": T.LongType(), "n_hit": T.LongType(), "n_items": T.LongType(), "items": T.ArrayType(T.StringType()), "items_sha256": T.StringType(), "contaminated": T.BooleanType()}
    if parts == 1:
        return docs.mapInArrow(_verdicts(send(0), text, least, keep_text), T.StructType([*kept, *(T.StructField(n, k) for n, k in kinds.items())]))
    stored = ws.write(docs.withColumn("_row", F.monotonically_increasing_id()))
    found = None
    for k in range(parts):
        sent = send(k)
        hits = ws.write(stored.select("_row", text).mapInArrow(_hits(sent, text, every=k == 0), "_row long, n_words long, spans array<struct<start:int,end:int>>, items array<string>"))
        sent.unpersist()
        found = hits if found is None else found.unionByName(hits)
    own = found.groupBy("_row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # Spans of several parts may overlap: words beyond the furthest end so far are new.
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda s, x: F.struct(F.greatest(s["end"], x["end"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], s["end"]))).cast("long").alias("n"))
    own = own.withColumn("n_hit", F.aggregate("_spans", start, step, lambda s: s["n"])).withColumn("n_items", F.size("items").cast("long"))
    own = own.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * least >= F.col("n_words")))
    return stored.select("_row", *[f.name for f in kept]).join(own, "_row").select(*[f.name for f in kept], *kinds)


def _verdicts(sent, text: str, least: int, keep_text: bool):
    def run(batches):
        patterns = sent.value
        for batch in batches:
            rows = []
            for doc in raw(batch, text):
                seq = words(doc)
                spans, items = patterns.find(seq)
                hit, items = sum(b - a for a, b in spans), sorted(items)
                rows.append((len(seq), hit, len(items), items, hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0 and least * hit >= len(seq)))
            columns = dict(zip(ADDED, zip(*rows, strict=True), strict=True)) if rows else dict.fromkeys(ADDED, ())
            kinds = dict(zip(ADDED, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.bool_()), strict=True))
            yield extended(batch, () if keep_text else (text,), **{n: pa.array(columns[n], kinds[n]) for n in ADDED})

    return run


def _hits(sent, text: str, *, every: bool):
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        patterns = sent.value
        for batch in batches:
            rows = []
            for row, doc in zip(batch.column("_row").to_pylist(), raw(batch, text), strict=True):
                seq = words(doc)
                spans, items = patterns.find(seq)
                if every or spans:
                    rows.append((row, len(seq), [{"start": a, "end": b} for a, b in spans], sorted(items)))
            columns = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), span, pa.list_(pa.string())), strict=True)], names=["_row", "n_words", "spans", "items"])

    return run


def op9_benchmark_decontamination(spark, sf_dir):
    """One row per document: words, hit words, hit items and whether it is contaminated."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), keep_text=False).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


#: Windows of both sides as lists of words, joined.
OP9_SQL = f"""
with low as (select doc_id, row_number() over () as r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
doc as (select doc_id, r, string_split(trim(regexp_replace(t, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g')), ' ') as w from low),
item as (select item_id, string_split(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g')), ' ') as w from benchmark),
pattern as (
  select item_id, least(len(w), {WINDOW}) as m, array_to_string(w[k + 1:k + least(len(w), {WINDOW})], ' ') as x
  from (select item_id, w, unnest(range(greatest(len(w) - {WINDOW}, 0) + 1)) as k from item where w <> [''])),
sizes as (select distinct m from pattern),
place as (select r, m, k, array_to_string(w[k + 1:k + m], ' ') as x from (select r, w, m, unnest(range(len(w) - m + 1)) as k from doc, sizes where w <> [''] and len(w) >= m)),
found as (select r, k, m, item_id from place join (select distinct item_id, m, x from pattern) p using (m, x)),
hit as (select r, count(*) as n from (select distinct r, unnest(range(k, k + m)) from found) group by r),
named as (select r, list_sort(list(distinct item_id::varchar)) as items from found where item_id is not null group by r)
select doc_id, n_words, n_hit, n_items, items_sha256, n_hit > 0 and 20 * n_hit >= n_words as contaminated from (
  select doc_id, case when w = [''] then 0 else len(w) end::bigint as n_words, coalesce(n, 0)::bigint as n_hit, coalesce(len(items), 0)::bigint as n_items, sha256(coalesce(array_to_string(items, ','), '')) as items_sha256
  from doc left join hit using (r) left join named using (r))
"""
