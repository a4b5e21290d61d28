"""Embedding near-dedup by an inverted multi-index.

Vectors are scaled to length 1 and cut into halves. A codebook for each half,
fitted on a bounded sample, makes a product grid of cells; every vector is in
the index of its cell. The traversal takes cells by growing sum of the two
half distances (the multi-sequence order) and stops after as many cells as the
target recall needs. That is measured on the sample, on pairs at exactly the
linking cosine in random directions and on the pairs that the sample itself
has: the cell of one must be among those visited from the other, either way.
Visited cells are joined with the index, and every candidate is verified by
its cosine in double precision.

Vectors are compared only within one label and one dimension. Equal vectors
of a label are one node with a count, known by 128 bits of hash. Cells are
packed into bins of about ``BIN`` vectors; a vector goes once to each bin that
has a cell it visits, and one product of matrices compares a cell with all that
visit it. A cell over ``BIN`` is cut into blocks by hash, to all of which its
visitors go. Tasks hold one bin and stream the visitors. They give counts and a
spanning forest, never all pairs; a pair that both sides find is counted once,
because every vector carries its visited cells.

Size. Codebooks have the square root of (vectors / ``PER_CELL``) centroids, at
most ``MAX_CENTROIDS`` and an eighth of the sample. Up to 2 * 10^9 vectors a
cell has about ``PER_CELL``; beyond, cells grow with the table, and so does the
work for each vector (a raised ``sample`` and ``MAX_CENTROIDS`` move that bound).

Defined cases: vectors that are null, empty or zero, or hold null or
non-finite components, and those with a null label, link with nothing; labels
are compared as they are, whatever their type; ties at the threshold link;
repeated rows are vectors of their own; a null vec_id counts as the smallest
and comes back as null; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import Workspace, components, extended, long_key, table

COSINE = 0.93
RECALL = 0.99
SAMPLE = 1 << 15
SAMPLE_BYTES = 32 << 20
MAX_CENTROIDS = 4096
PER_CELL = 128
BIN = 4096
ROUNDS = 12
#: Visitors compared at a time, and sample vectors whose pairs set the stopping rank.
STEP = 1024
PROBED = 4000


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one dimension, scaled to length 1; by their largest component first, so that no square overflows or vanishes."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    x = flat.astype(np.float64).reshape(len(column), -1)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids, in the order of their main direction, so that near ones tend to have near numbers."""
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        near = np.concatenate([distances(x[a : a + 4096], centres).argmin(1) for a in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    spread = centres - centres.mean(0)
    return centres[(spread @ np.linalg.svd(spread, full_matrices=False)[2][0]).argsort()] if k > 1 and centres.shape[1] else centres


class MultiIndex:
    """Two codebooks, and the number of cells that the target recall needs."""

    def __init__(self, sample: np.ndarray, total: int, cosine: float = COSINE, recall: float = RECALL):
        rng = np.random.default_rng(7)
        self.half = sample.shape[1] // 2
        k = 2 ** max(0, round(np.log2(max(1, total / PER_CELL)) / 2))
        self.k = max(1, min(k, MAX_CENTROIDS, len(sample) // 8))
        self.books = [kmeans(part, self.k, rng) for part in (sample[:, : self.half], sample[:, self.half :])]
        x = sample[:PROBED]
        side = rng.normal(size=x.shape)
        side -= (side * x).sum(1)[:, None] * x
        norm = np.linalg.norm(side, axis=1)[:, None]
        made = cosine * x + np.sqrt(1 - cosine**2) * side / np.where(norm > 1e-9, norm, 1)
        ranks = [self.ranks(x, made)]
        own = self._pairs(x, sample, cosine)
        if len(own):
            ranks.append(self.ranks(sample[own[:, 0]], sample[own[:, 1]]))
        self.visits = max(int(np.quantile(r, recall, method="higher")) for r in ranks) + 1

    @staticmethod
    def _pairs(x: np.ndarray, sample: np.ndarray, cosine: float) -> np.ndarray:
        """Linked pairs within the sample, at most one for each of its first vectors: the least similar, which is the hardest."""
        out = []
        for a in range(0, len(x), 100):
            c = x[a : a + 100] @ sample.T
            c[np.arange(len(c)), a + np.arange(len(c))] = 0
            c[c < cosine] = 2
            j = c.argmin(1)
            i = np.flatnonzero(c[np.arange(len(c)), j] < 2)
            out.append(np.stack([a + i, j[i]], axis=1))
        return np.concatenate(out) if out else np.empty((0, 2), int)

    def _halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(x[:, : self.half], self.books[0]), distances(x[:, self.half :], self.books[1])

    def ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many cells a traversal visits before that of the other vector of each pair, from the better side."""

        def one(x, y):
            out = []
            for k in range(0, len(x), 500):
                a, b = self._halves(x[k : k + 500])
                i, j = (d.argmin(1) for d in self._halves(y[k : k + 500]))
                own = a[np.arange(len(a)), i] + b[np.arange(len(a)), j]
                out += [int(np.searchsorted(np.sort(q), o - p, "left").sum()) for p, q, o in zip(a, b, own, strict=True)]
            return np.array(out)

        return np.minimum(one(x, y), one(y, x))

    def visited(self, x: np.ndarray) -> np.ndarray:
        """The first ``visits`` cells of the traversal, nearest first. The t-th cell is the pair of the
        i-th and j-th nearest centroids with (i + 1) (j + 1) <= t, so only such pairs are looked at."""
        t = min(self.visits, self.k * self.k)
        a, b = self._halves(x)
        near_a, near_b = a.argsort(1)[:, :t], b.argsort(1)[:, :t]
        pairs = np.array([(i, j) for i in range(near_a.shape[1]) for j in range(min(near_b.shape[1], t // (i + 1)))])
        at_a, at_b = near_a[:, pairs[:, 0]], near_b[:, pairs[:, 1]]
        total = np.take_along_axis(a, at_a, 1) + np.take_along_axis(b, at_b, 1)
        first = total.argsort(1, kind="stable")[:, :t]
        return np.take_along_axis(at_a * self.k + at_b, first, 1).astype(np.int32)


def usable(embedding: str, label: str):
    e = F.col(embedding)
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(e.isNotNull() & F.col(label).isNotNull() & fine & F.exists(e, lambda x: x != 0), F.lit(False))


def _placed(nodes: DataFrame, index: MultiIndex) -> DataFrame:
    """``(node, label, cells)``: the visited cells of every node, its own first."""
    sent = nodes.sparkSession.sparkContext.broadcast(index)  # 2 x MAX_CENTROIDS half vectors at most

    def run(batches):
        for batch in batches:
            for k in range(0, len(batch), STEP):
                part = batch.slice(k, STEP)
                cells = sent.value.visited(matrix(part.column("embedding")))
                each = pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, cells.shape[1]), pa.int32()), pa.array(cells.ravel()))
                yield extended(part, ("embedding",), cells=each)

    kept = nodes.select("node", "label", "embedding")
    return kept.mapInArrow(run, T.StructType([kept.schema["node"], kept.schema["label"], T.StructField("cells", T.ArrayType(T.IntegerType()))]))


def _bins(placed: DataFrame, k: int) -> DataFrame:
    """``(label, cell, bin, block, blocks)``: small cells share a bin, a cell over BIN has a bin for each block."""
    sizes = placed.groupBy("label", F.col("cells")[0].alias("cell")).agg(F.count("*").alias("size"))
    per = sizes.agg(F.sum("size").alias("n"), F.count_distinct("label").alias("labels")).first()
    rows = max(1, min(k, round(BIN * k * per["labels"] / max(1, per["n"] or 0))))  # rows of the grid that fill a bin
    small = sizes.where(F.col("size") <= BIN).withColumn("strip", F.floor(F.col("cell") / (k * rows)))
    before = F.sum("size").over(W.partitionBy("label", "strip").orderBy("cell").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    shared = small.withColumn("at", F.floor(before / BIN)).groupBy("label", "strip", "at").agg(F.collect_list("cell").alias("cell"))
    shared = shared.select("label", "cell", F.lit(0).cast("long").alias("block"), F.lit(1).cast("long").alias("blocks"))
    large = sizes.where(F.col("size") > BIN).withColumn("blocks", F.ceil(F.col("size") / BIN).cast("long"))
    large = large.select("label", F.array("cell").alias("cell"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "blocks")
    return shared.unionByName(large).withColumn("bin", F.monotonically_increasing_id())


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position that each of ``n`` reaches over the edges."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            return root


class _Bin:
    """The vectors of one bin by cell, and the comparison of visitors with them."""

    def __init__(self, rows: dict[str, np.ndarray], cosine: float):
        order = rows["cells"][:, 0].argsort(kind="stable")
        self.rows, self.cosine = {f: v[order] for f, v in rows.items()}, cosine
        self.cells, first = np.unique(self.rows["cells"][:, 0], return_index=True)
        self.ends = np.append(first, len(order))

    def compared(self, probes: dict[str, np.ndarray]):
        """Counts of links (the node twice) and edges of a spanning forest."""
        for c, low, high in zip(self.cells, self.ends, self.ends[1:], strict=False):
            who = np.flatnonzero((probes["cells"] == c).any(axis=1))
            if not len(who):
                continue
            own = {f: v[low:high] for f, v in self.rows.items()}
            hit = probes["x"][who] @ own["x"].T >= self.cosine
            hit &= probes["node"][who][:, None] != own["node"]
            i, j = np.nonzero(hit)
            i = who[i]
            # Found from both sides: the smaller node's visit counts it.
            back = (own["cells"][j] == probes["cells"][i, :1]).any(axis=1)
            keep = (probes["node"][i] < own["node"][j]) | ~back
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            links = np.concatenate([own["n"][j], probes["n"][i]])
            each, at = np.unique(np.concatenate([probes["node"][i], own["node"][j]]), return_inverse=True)
            yield each, each, np.bincount(at, links).astype(np.int64)
            root = _forest(len(each), at[: len(i)], at[len(i) :])
            k = np.flatnonzero(root != np.arange(len(each)))
            yield each[k], each[root[k]], np.zeros(len(k), np.int64)


def _match(rows: DataFrame, cosine: float) -> DataFrame:
    """``(node, other, links)``: counts of links (``other`` is the node itself), and edges of a spanning forest."""
    dealt = rows.repartition("bin").sortWithinPartitions("bin", F.desc("member"))

    def run(batches):
        now, held, index = None, [], None

        def close():
            """All vectors of the bin are here: they visit each other."""
            nonlocal index
            if held and index is None:
                own = {f: np.concatenate([h[f] for h in held]) for f in held[0]}
                index = _Bin(own, cosine)
                for k in range(0, len(own["node"]), STEP):
                    yield from index.compared({f: v[k : k + STEP] for f, v in own.items()})

        def table_of(parts):
            columns = map(np.concatenate, zip((np.empty(0, np.int64),) * 3, *parts, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["node", "other", "links"])

        for batch in batches:
            bins, member = batch.column("bin").to_numpy(), batch.column("member").to_numpy(zero_copy_only=False)
            flat = batch.column("cells").flatten().to_numpy()
            rows = {"node": batch.column("node").to_numpy(), "n": batch.column("n").to_numpy(), "x": matrix(batch.column("embedding")), "cells": flat.reshape(len(batch), -1)}
            cuts = np.flatnonzero((bins[1:] != bins[:-1]) | (member[1:] != member[:-1])) + 1
            out = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
                if bins[a] != now:
                    out += close()
                    now, held, index = bins[a], [], None
                part = {f: v[a:b] for f, v in rows.items()}
                if member[a]:
                    held.append(part)
                else:
                    out += close()
                    if index is not None:
                        for k in range(0, b - a, STEP):
                            out += index.compared({f: v[k : k + STEP] for f, v in part.items()})
            yield table_of(out)
        yield table_of(list(close()))

    return dealt.mapInArrow(run, "node long, other long, links long")


def near_vectors(
    vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE, recall: float = RECALL, sample: int = SAMPLE
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per input row. ``sample`` vectors, and SAMPLE_BYTES, at most fit the index."""
    ws = Workspace(vectors.sparkSession)
    rows = vectors.select(long_key(F.col(vec_id)).alias("key"), F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("embedding"))
    rows = rows.withColumn("ok", usable("embedding", "label")).withColumn("h", F.xxhash64("label", "embedding")).withColumn("g", F.xxhash64(F.lit("same"), "label", "embedding"))
    good = rows.where("ok")
    nodes = good.groupBy("h", "g").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.min("key").alias("least"), F.count("*").alias("n"))
    nodes = ws.write(nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")))
    sizes = {r["dim"]: r["count"] for r in nodes.groupBy("dim").count().collect()}
    found = None
    for dim, total in sorted(sizes.items()):
        own = nodes.where(F.col("dim") == dim)
        most = max(1, min(sample, SAMPLE_BYTES // (8 * dim)))
        some = own.where(F.pmod(F.xxhash64(F.lit("fit"), "h"), F.lit(1 << 30)) < min(1.0, most / total) * (1 << 30)) if total > most else own
        fitted = matrix(some.select("embedding").limit(2 * most).toArrow().column(0)) if total else None
        index = MultiIndex(fitted, total, cosine, recall) if len(fitted) else MultiIndex(matrix(own.select("embedding").limit(most).toArrow().column(0)), total, cosine, recall)
        placed = ws.write(_placed(own, index))
        bins = ws.write(_bins(placed, index.k))
        where = bins.select("label", F.explode("cell").alias("cell"), "bin", "block", "blocks")
        visits = placed.select("node", "label", F.posexplode("cells").alias("rank", "cell")).join(where, ["label", "cell"])
        mine = (F.col("rank") == 0) & (F.pmod(F.xxhash64("node"), F.col("blocks")) == F.col("block"))
        visits = visits.groupBy("node", "bin").agg(F.bool_or(mine).alias("member"))
        hits = _match(visits.join(placed.select("node", "cells"), "node").join(own.select("node", "n", "embedding"), "node"), cosine)
        hits = ws.write(hits)
        found = hits if found is None else found.unionByName(hits)
    alone = F.when(F.col("key") != F.lit(-(2**63)), F.col("key"))
    lone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), alone.alias("component_id"), F.lit(True).alias("kept"))
    if found is None:
        return lone
    links = found.where("node = other").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(ws, found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b"))).toDF("node", "root")
    small = nodes.select("node", "h", "g", "least", "n")
    tree = ws.write(small.join(roots, "node", "left").join(links, "node", "left").select("h", "g", "least", "n", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links")))
    lowest = tree.groupBy("root").agg(F.min("least").alias("component"))
    named = tree.join(lowest, "root").select("h", "g", "component", (F.col("links") + F.col("n") - 1).alias("n_links"))
    out = good.select("vec_id", "key", "h", "g").join(named, ["h", "g"])
    shown = F.when(F.col("component") != F.lit(-(2**63)), F.col("component"))
    return out.select("vec_id", "n_links", shown.alias("component_id"), (F.col("key") == F.col("component")).alias("kept")).unionByName(lone)


def op3_multi_index(spark, sf_dir):
    """One row per vector: its links, the smallest vec_id that links reach, and whether it stays."""
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
