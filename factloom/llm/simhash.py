"""SimHash near-dedup: bit-majority fingerprints, pivot distance tables, components.

Fingerprints. Words are split at ASCII white space after lower-casing A-Z;
every shingle of ``SHINGLE`` words (all words if fewer) is hashed by XXH64
with seed 42; a bit is 1 if set in over half of the hashes, repeats included.
A text without words has fingerprint zero.

Links join fingerprints that differ in at most ``RADIUS`` bits.

1. Documents with one fingerprint are one node, so exact copies never meet.
2. Each node gets a pivot table: its Hamming distances to ``PIVOTS``
   reference fingerprints.
3. Candidates. Two fingerprints within ``RADIUS`` bits agree on at least
   ``BANDS - RADIUS`` of ``BANDS`` disjoint bit ranges, so nodes meet in the
   buckets of each choice of that many ranges. No link can be missed. (Pivot
   distances alone cannot propose candidates without comparing all pairs: the
   distance of a random fingerprint to a pivot spreads by 4 bits, so +-3
   passes nearly half of all pairs.)
4. In a bucket, a pair is discarded if any coordinate of the two pivot tables
   differs by more than ``RADIUS`` (triangle inequality); survivors are
   verified by their exact Hamming distance.
5. A bucket gives at most one link per member, a spanning forest of its
   verified pairs, which keeps every connection. A bucket of over ``SPLIT``
   members is cut into blocks by hash, and pairs of blocks are tasks of their
   own, so no task holds an unbounded bucket.

Defined cases: null and blank texts have fingerprint zero and link with each
other; a null doc_id counts as the smallest; repeated rows each get a row;
null or repeated ids do not join unrelated texts.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import Workspace, components, extended, long_key, raw, table, without

SHINGLE = 3
SEED = 42
RADIUS = 3
BANDS = 5
PIVOTS = 16
SPLIT = 4096
#: Shingles of a text hashed at a time.
STEP = 1 << 15


def fingerprint(text: bytes | None) -> int:
    """The 64 bits of one text in UTF-8, as an unsigned integer."""
    words = text.lower().split() if text else []  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    size = min(SHINGLE, len(words))
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_digest
    ones, n = np.zeros(64, np.int64), len(words) - size + 1
    for k in range(0, n, STEP):
        own = zip(starts[k : min(n, k + STEP)].tolist(), ends[k + size - 1 : k + size - 1 + STEP].tolist(), strict=False)
        block = np.frombuffer(b"".join([digest(flat[a:b], SEED) for a, b in own]), np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``fp`` (the 64 bits as a signed long)."""
    docs = without(docs, "fp")
    fields = [f for f in docs.schema.fields if f.name != text]

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t) for t in raw(batch, text)], np.uint64).view(np.int64)
            yield extended(batch, (text,), fp=pa.array(fps))

    return docs.mapInArrow(run, T.StructType([*fields, T.StructField("fp", T.LongType())]))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivots(count: int = PIVOTS) -> list[int]:
    """Reference fingerprints: hashes of the counting numbers, the same in every run."""
    return [xxhash.xxh64_intdigest(str(k), SEED) for k in range(count)]


def band_masks(bands: int = BANDS, radius: int = RADIUS) -> list[int]:
    """One mask per choice of ``bands - radius`` of the bit ranges."""
    edges = [64 * k // bands for k in range(bands + 1)]
    ranges = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(own) for own in combinations(ranges, bands - radius)]


def links(ws: Workspace, nodes: DataFrame, *, radius: int = RADIUS, bands: int = BANDS, count: int = PIVOTS, split: int = SPLIT) -> DataFrame:
    """``(a, b)``: edges that connect the same of the distinct fingerprints ``nodes(fp)`` as all
    pairs within ``radius`` bits do. A large bucket gives a star for each of its components."""
    masks = band_masks(bands, radius)
    # A byte for each pivot; the packed table is made once for each fingerprint.
    near = F.concat(*[F.unhex(F.lpad(F.hex(F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(p))))), 2, "0")) for p in pivots(count)])
    keyed = (
        nodes.select("fp", near.alias("near"))
        .select("fp", "near", F.explode(F.array(*[F.struct(F.lit(k).cast("int").alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)])).alias("at"))
        .select(F.col("at.mask").alias("mask"), F.col("at.key").alias("key"), "fp", "near")
    )
    big = ws.write(keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > split))
    blocks = F.ceil(F.col("n") / split).cast("int")
    mine = F.pmod(F.xxhash64(F.lit("block"), "fp"), F.col("blocks")).cast("int")
    if big.isEmpty():
        dealt = keyed.select("mask", "key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("own"), "fp", "near")
    else:
        dealt = (
            keyed.join(big, ["mask", "key"], "left")
            .withColumn("blocks", F.coalesce(blocks, F.lit(1)))
            .withColumn("own", mine)
            .select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
            .select("mask", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp", "near")
        )
    group = ["mask", "key", "i", "j"]
    return dealt.repartition(*group).sortWithinPartitions(*group).mapInPandas(_forest(group, radius, count), "a long, b long")


def _forest(group: list[str], radius: int, count: int):
    def pairs(left, right, lnear, rnear):
        """Positions of the pairs that the pivot tables let through and the fingerprints confirm."""
        keep = np.ones((len(left), len(right)), bool)
        for p in range(count):
            keep &= np.abs(lnear[:, p, None] - rnear[None, :, p]) <= radius
        i, j = np.nonzero(keep)
        good = np.bitwise_count(left[i] ^ right[j]) <= radius
        return i[good], j[good]

    def forest(fp, near):
        root = np.arange(len(fp))
        for k in range(0, len(fp), 256):
            i, j = pairs(fp[k : k + 256], fp, near[k : k + 256], near)
            i = i + k
            while True:
                low = np.minimum(root[i], root[j])
                before = root.copy()
                np.minimum.at(root, root[i], low)
                np.minimum.at(root, root[j], low)
                root = root[root]
                if (root == before).all():
                    break
        return root

    def run(batches):
        held = []
        for pdf in batches:
            held.append(pdf)
            key = pdf[group].to_numpy(np.int64)
            if (key[0] == key[-1]).all() and sum(map(len, held)) <= 16 * SPLIT:
                continue  # the whole batch may be one group that goes on
            own = pd.concat(held, ignore_index=True)
            key = own[group].to_numpy(np.int64)
            cut = int(np.flatnonzero((key != key[-1]).any(axis=1)).max(initial=-1)) + 1
            if cut:
                yield solve(own.iloc[:cut])
            held = [own.iloc[cut:]]
        if held:
            yield solve(pd.concat(held, ignore_index=True))

    def solve(own):
        key = own[group].to_numpy(np.int64)
        fp = own["fp"].to_numpy(np.int64).view(np.uint64)
        near = np.frombuffer(b"".join(own["near"]), np.uint8).reshape(-1, count).astype(np.int16)
        first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1))))
        sizes = np.diff(np.append(first, len(own)))
        a, b = [], []
        small = sizes <= 32
        # All small buckets at once: each member against the one d places on.
        rest = np.repeat(np.where(small, sizes, 0), sizes) - (np.arange(len(own)) - np.repeat(first, sizes))
        for d in range(1, int(sizes[small].max(initial=1))):
            i = np.flatnonzero(rest > d)
            i = i[(np.abs(near[i] - near[i + d]) <= radius).all(axis=1)]
            i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= radius]
            a.append(fp[i])
            b.append(fp[i + d])
        for k, n in zip(first[~small], sizes[~small], strict=True):
            root = forest(fp[k : k + n], near[k : k + n])
            i = np.flatnonzero(root != np.arange(n))
            a.append(fp[k + i])
            b.append(fp[k + root[i]])
        a, b = (np.concatenate([np.empty(0, np.uint64), *x]).view(np.int64) for x in (a, b))
        return pd.DataFrame({"a": a, "b": b})

    return run


def _text_tag(text: str) -> Column:
    """Tells rows of one doc_id apart by their texts."""
    return F.xxhash64(F.lit("text"), F.col(text))


def _groups(docs: DataFrame, doc_id: str, text: str, radius: int, bands: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(doc_id, text_tag, fp)`` of every row; ``(fp, root)`` of every fingerprint; and of every
    component its ``root``, its smallest fingerprint ``component_fp`` and the ``first`` of its rows, by id and tag.

    Ids may be null or repeat in unrelated texts, so only fingerprints tell components apart.
    """
    ws = Workspace(docs.sparkSession)
    marked = ws.write(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), _text_tag(text).alias("text_tag"))))
    nodes = ws.write(marked.groupBy("fp").agg(F.min(F.struct("doc_id", "text_tag")).alias("first")))
    edges = ws.write(links(ws, nodes.select("fp"), radius=radius, bands=bands))
    roots = components(ws, edges).toDF("fp", "root")
    tree = ws.write(nodes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    lowest = tree.groupBy("root").agg(F.min("first").alias("first"), F.min("fp").alias("component_fp"))
    return marked, tree.select("fp", "root"), lowest


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, bands: int = BANDS) -> DataFrame:
    """``(doc_id, text_tag, fp, component_id, component_fp)``, one row per input row.

    ``component_id`` is the smallest doc_id of the component; where ids are null or repeat,
    components can share it. ``component_fp``, its smallest fingerprint, is its own.
    Texts are read once; all else runs on ids and fingerprints.
    """
    marked, tree, lowest = _groups(docs, doc_id, text, radius, bands)
    named = tree.join(lowest, "root").select("fp", F.col("first.doc_id").alias("component_id"), "component_fp")
    return marked.join(named, "fp").select("doc_id", "text_tag", "fp", "component_id", "component_fp")


def kept(docs: DataFrame) -> DataFrame:
    """``docs`` less all but one document of each group: that with the smallest id
    (of rows that share this id and its text, the first by their other columns, in the table's order; rows that
    agree in these too are equal). Its columns are left as they are.

    Rows of one id and text are merged where they are read, so that none of them is a
    hot key, and texts are shuffled once: the merge and the join have the same key."""
    _, _, lowest = _groups(docs, "doc_id", "text", RADIUS, BANDS)
    key, null = long_key(F.col("doc_id")), F.lit(-(2**63))
    rest = [F.to_json(f"`{f.name}`") if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    order = F.struct(*[c.alias(f"c{k}") for k, c in enumerate(rest)], F.lit(0).alias("_"))
    own = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"), order.alias("_order"), key.alias("_key"), F.coalesce(_text_tag("text"), null).alias("_tag"))
    once = own.groupBy("_key", "_tag").agg(F.min_by("_row", "_order").alias("_row"))
    first = lowest.select(long_key(F.col("first.doc_id")).alias("_key"), F.coalesce("first.text_tag", null).alias("_tag"))
    return once.join(first, ["_key", "_tag"], "left_semi").select("_row.*")


def op10_simhash_pivots(spark, sf_dir):
    """One row per document: its fingerprint, the smallest doc_id that links reach, and the component's own fingerprint."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    own = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return found.select("doc_id", own("fp").alias("fingerprint"), "component_id", own("component_fp").alias("component_fingerprint"))
