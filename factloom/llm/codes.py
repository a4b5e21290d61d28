"""Vector code compression: product codes found by trees over codebook entries.

Components become integers, so that every distance is exact. Vectors are cut
into equal parts; each part position has a codebook, refined by rounds of
nearest entry and mean. The entries of a position stand in a vantage-point tree:
a node keeps one entry and splits the others by their distance to it, and knows
for each side the least and the greatest of these distances. A search skips a
side only if the triangle inequality, with radii rounded away from it, shows
that all its entries are further than the best one so far; sides that might
tie are visited. Whatever is visited is compared by integer squared distance,
ties to the lower index.

Spark assigns batches of vectors in tasks. A task gives a sum and a count for
each entry and component, so what is shuffled and collected a round depends on
the codebooks alone. The trees that are broadcast have at most 256 entries a
position. Vectors are written once as integers.

Defined cases: rows whose vector is null or holds null or non-finite components
are dropped; the dimension is that of the smallest kept vec_id, and vectors of
another length, or all if it cannot be cut into equal parts, come back with null
code and error; components beyond 2^15 in size raise an error, as squares would
leave 64 bits; with fewer than 256 vectors the codebooks have as many entries;
equal vec_ids are ordered by their vectors; a null vec_id is the smallest and
comes back as null; null labels form one group, whose sum counts coded vectors
only; an empty table gives no row; columns besides the three are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import Workspace, table

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
LIMIT = 1 << 15
#: Entries of a leaf, and vectors searched at a time.
LEAF = 16
STEP = 4096
#: Relative slack of radii; far over the rounding of square roots and sums.
SLACK = 1e-12


def squared(x: np.ndarray, entry: np.ndarray) -> np.ndarray:
    apart = x - entry
    return np.einsum("ij,ij->i", apart, apart)


class Node:
    def __init__(self, entries: np.ndarray, own: np.ndarray):
        self.leaf = len(own) <= LEAF
        self.own = own
        if self.leaf:
            return
        # The vantage point is the entry furthest from the mean: its distances spread most.
        centre = entries[own].mean(0)
        far = int(((entries[own] - centre) ** 2).sum(1).argmax())
        self.point, rest = int(own[far]), np.delete(own, far)
        d = np.sqrt(squared(entries[rest], entries[self.point]).astype(np.float64))
        order = d.argsort(kind="stable")
        half = len(rest) // 2
        self.border = d[order[half]]
        self.sides = [(Node(entries, np.sort(rest[o])), d[o].min() * (1 - SLACK), d[o].max() * (1 + SLACK)) for o in (order[:half], order[half:])]


class Tree:
    """Entries of one part position."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.root = entries, Node(entries, np.arange(len(entries)))
        #: Pairs of a vector and an entry that were compared, of all searches.
        self.compared = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry for every row of ``x``."""
        best, code = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(self.entries))
        for a in range(0, len(x), STEP):
            self._visit(self.root, x, np.arange(a, min(a + STEP, len(x))), best, code)
        return code, best

    def _offer(self, rows: np.ndarray, d2: np.ndarray, entry: np.ndarray | int, best: np.ndarray, code: np.ndarray) -> None:
        better = (d2 < best[rows]) | ((d2 == best[rows]) & (entry < code[rows]))
        at = rows[better]
        best[at] = d2[better]
        code[at] = entry[better] if isinstance(entry, np.ndarray) else entry

    def _visit(self, node: Node, x: np.ndarray, rows: np.ndarray, best: np.ndarray, code: np.ndarray) -> None:
        if not len(rows):
            return
        if node.leaf:
            apart = x[rows][:, None, :] - self.entries[node.own]
            d2 = np.einsum("ijk,ijk->ij", apart, apart)
            least = d2.argmin(1)  # the first of equal ones: the lower index
            self.compared += d2.size
            self._offer(rows, d2[np.arange(len(rows)), least], node.own[least], best, code)
            return
        d2 = squared(x[rows], self.entries[node.point])
        self.compared += len(rows)
        self._offer(rows, d2, node.point, best, code)
        d = np.sqrt(d2.astype(np.float64))
        inner = d < node.border
        for first in (0, 1):  # the side that a vector is on, and after it the other one
            near = inner if first == 0 else ~inner
            for side in (first, 1 - first):
                below, low, high = node.sides[side]
                # Nothing of the side is nearer than this.
                gap = np.maximum(d[near] * (1 - SLACK) - high, low - d[near] * (1 + SLACK))
                self._visit(below, x, rows[near][gap <= np.sqrt(best[rows[near]].astype(np.float64)) * (1 + SLACK)], best, code)


class Codebooks:
    """A tree for every part position."""

    def __init__(self, books: list[np.ndarray]):
        self.trees = [Tree(b) for b in books]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (a column for each part) and summed squared distances."""
        found = [t.nearest(part) for t, part in zip(self.trees, np.split(x, len(self.trees), axis=1), strict=True)]
        return np.stack([c for c, _ in found], axis=1), sum(d for _, d in found)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for t in self.trees for v in t.entries.ravel().tolist()).encode()).hexdigest()


def integers(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``(vec_id, label, v)``: kept rows, components as floor(1024 * x)."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    floor = lambda x: F.when(F.abs(x) <= LIMIT, F.floor(SCALE * x).cast("int")).otherwise(F.raise_error(F.lit(f"a component is beyond {LIMIT}")).cast("int"))
    own = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{embedding}`").cast("array<double>").alias("x"))
    return own.where(F.col("x").isNotNull() & F.forall("x", finite)).select("vec_id", "label", F.transform("x", floor).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def _sums(sent, dim: int):
    def run(batches):
        books: Codebooks = sent.value
        size = dim // len(books.trees)
        sums = [np.zeros((len(t.entries), size), np.int64) for t in books.trees]
        counts = [np.zeros(len(t.entries), np.int64) for t in books.trees]
        for batch in batches:
            x = _matrix(batch.column("v"), dim)
            codes, _ = books.assign(x)
            for p in range(len(books.trees)):
                order = codes[:, p].argsort(kind="stable")
                entry, first = np.unique(codes[order, p], return_index=True)
                if len(entry):
                    if size:
                        sums[p][entry] += np.add.reduceat(x[order, p * size : (p + 1) * size], first, axis=0)
                    counts[p][entry] += np.diff(np.append(first, len(order)))
        for p, (s, n) in enumerate(zip(sums, counts, strict=True)):
            used = np.flatnonzero(n)
            columns = [np.full(len(used) * size, p), used.repeat(size), np.tile(np.arange(size), len(used)), s[used].ravel(), n[used].repeat(size)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "at", "s", "n"])

    return run


def _codes(sent, dim: int):
    def run(batches):
        books: Codebooks = sent.value
        for batch in batches:
            codes, error = books.assign(_matrix(batch.column("v"), dim))
            text = [bytes(row).hex() for row in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def compress(
    vectors: DataFrame,
    *,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, Codebooks | None]:
    """``(vec_id, label, code, error)`` of every kept vector, and the final codebooks (None without any that can be cut)."""
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hex digits: 1 to 256 entries")
    spark = vectors.sparkSession
    ws = Workspace(spark)
    stored = ws.write(integers(vectors, vec_id=vec_id, embedding=embedding, label=label))
    order = F.col("vec_id").asc_nulls_first(), F.col("v").asc()
    first = stored.orderBy(*order).limit(1).collect()
    dim = len(first[0].v) if first else 0
    fits = stored.where(F.size("v") == dim)
    blank = stored.where(F.size("v") != dim) if dim % parts == 0 else stored
    blank = blank.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if not first or dim % parts:
        return blank, None
    chosen = fits.orderBy(*order).limit(entries).collect()
    start = np.array([r.v for r in chosen], np.int64).reshape(len(chosen), dim)
    size = dim // parts
    books = [start[:, p * size : (p + 1) * size].copy() for p in range(parts)]
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(Codebooks(books))
        found = fits.select("v").mapInArrow(_sums(sent, dim), "part long, entry long, at long, s long, n long")
        for r in found.groupBy("part", "entry", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect():
            books[r.part][r.entry, r["at"]] = int(r.s) // r.n
        sent.destroy()
    final = Codebooks(books)
    schema = fits.select("vec_id", "label").withColumns({"code": F.lit("").cast("string"), "error": F.lit(0).cast("long")}).schema
    coded = fits.mapInArrow(_codes(spark.sparkContext.broadcast(final), dim), schema)
    return ws.write(coded.unionByName(blank)), final


def op13_vantage_codes(spark, sf_dir):
    """One row per kept vector: its code, its error, the error of its label, and the codebooks' digest."""
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    by_label = coded.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    digest = F.lit(books.sha256() if books else None).cast("string")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("l"))).select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def _round_sql(k: int) -> str:
    return f"""
near{k} as materialized (
  select r, p, any_value(x) as x, arg_min(e, d * 256 + e) as e, min(d) as d
  from (select a.r, a.p, a.x, b.e, (list_inner_product(a.x, a.x) - 2 * list_inner_product(a.x, b.x) + list_inner_product(b.x, b.x))::bigint as d from part a join book{k} b using (p))
  group by r, p),
mean{k} as (select p, e, list(m order by i) as x from (
  select p, e, i, floor(sum(c) / count(*)) as m from (select p, e, unnest(x) as c, unnest(range(len(x))) as i from near{k}) group by p, e, i) group by p, e),
book{k + 1} as materialized (select p, e, coalesce(m.x, b.x) as x from book{k} b left join mean{k} m using (p, e))"""


#: The rounds one by one; distances by inner products, which are exact in doubles at these sizes.
OP13_SQL = f"""
with kept as (select row_number() over (order by vec_id nulls first, v) as r, vec_id, label, v from (
  select vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0)),
part as materialized (select r, p, v[p * (len(v) // {PARTS}) + 1:(p + 1) * (len(v) // {PARTS})] as x from kept, range({PARTS}) as t(p)),
book0 as materialized (select p, r - 1 as e, x from part where r <= {ENTRIES}),
{",".join(_round_sql(k) for k in range(ROUNDS + 1))},
coded as (select r, string_agg(printf('%02x', e::integer), '' order by p) as code, sum(d)::bigint as error from near{ROUNDS} group by r),
digest as (select sha256(string_agg(array_to_string(list_transform(x, lambda c: c::bigint::varchar), ','), ',' order by p, e)) as h from book{ROUNDS})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, h as codebooks_sha256 from coded join kept using (r), digest
"""
