"""Mixture-controlled packing: deficit round-robin over source queues, in closed form.

Each source is a queue of tokens with a weight. In deficit round-robin every
round credits each queue with its weight and serves a block of ``QUANTUM``
tokens from those whose credit has reached a block; what is left of the credit
is carried on. Started with half a block of credit, queue q of weight w has the
credit for its block j after (j + 1/2) QUANTUM / w rounds: so the order of
service is known without playing the rounds (a test plays them, with deficit
counters, and compares window by window). Ties go in order of the queues' names.
At any time every queue has had its share to within one block, so windows get
the target proportions, and what a window lacks is made up in the next ones. An
empty queue's share goes to the others. The served stream is cut into windows
of ``WINDOW`` tokens; ``window_mixtures`` reports what each got.

Targets are ``weights`` by source, or the sources' sizes to the power
``temper``: 1 is the corpus as it is, 0 the same for all. A target other than
the corpus' own lasts until its queues run out, as every token is packed once.

How many tokens come before a block is a sum over queues of closed terms, so
every document finds its own windows from its offset in its queue. With more
than ``QUEUES`` queues the blocks are sorted by due time as a table instead,
and prefix sums over it give the same numbers. No task waits for another, and a
partition starts with the deficits its predecessors left. Offsets are prefix sums: each task counts its tokens by queue as it
writes them, and a table of (task, queue) totals gives the bases.

Every token is in exactly one piece; all windows are full but the last.

Defined cases: a null text is empty (its one token is the end id); a null
source is a queue of its own; an empty table has no pieces; repeated rows are
packed once each; input columns other than id, text and source are not used.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from array import array
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import Workspace, raw, table, without

WINDOW = 2048
QUANTUM = 256
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: With more sources than this, blocks are ranked in a table: the state that every task holds stays bounded.
QUEUES = 1024
#: A step of a weight is then under a block for corpora of up to 2^34 tokens; due times stay exact in a double and 64 bits.
WEIGHT_BITS = 26
#: Blocks of a queue that one row stands for until they are dealt out.
STRIDE = 1 << 12
#: Bytes that the remembered words of a Python worker may take, and what an entry takes beside its word and ids.
CACHE_BYTES = 96 << 20
_SLOT = 104
#: Characters tokenized at a time; longer texts are cut at a space, over which no token reaches.
PIECE_CHARS = 1 << 16

# Characters that normalise and split alike here and in the tokenizer: ASCII, Latin-1 letters and marks, Latin Extended-A.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-įı-ſ]*")
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-ſ]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\\sa-z\xaa\xb5\xba\xdf-\xf6\xf8-ſ0-9\xb2\xb3\xb9\xbc-\xbe]+")
#: Bytes that the vocabulary writes as other characters than their Latin-1 ones.
_HIDDEN = {b: chr(256 + k) for k, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}
#: Words of all kinds, on which a vocabulary shows whether its model can be asked directly.
_PROBES = ("'s", "the", "łódź", "ÿ­", "¡¿!?", "7", "¾", "2024", "qzxj" * 9)
_loaded: dict[str, WordCache] = {}


def entry_bytes(word: str, ids: bytes) -> int:
    return sys.getsizeof(word) + sys.getsizeof(ids) + _SLOT


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class WordCache(dict):
    """Ids of single words, as packed little-endian 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        #: The entries before, of which those that come again stay.
        self.old: dict[str, bytes] = {}
        self.size = self.old_size = 0
        self.ask = self.word if all(self.word(x) == self.slow(x) for w in _PROBES for x in _SPLIT.findall(w)) else self.slow

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word) or self.ask(word)
        own = entry_bytes(word, out)
        if self.size + own > CACHE_BYTES // 2:
            self.old, self.old_size = dict(self), self.size
            self.clear()
            self.size = 0
        self.size += own
        self[word] = out
        return out

    def slow(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def word(self, word: str) -> bytes:
        """The ids of one match of ``_SPLIT``, without the tokenizer's own normalising and splitting. Each digit is a token's whole word."""
        if len(word) > 1 and word[0].isnumeric():
            return b"".join(map(self.word, word))
        plain = word if word.isascii() else word.encode().decode("latin-1").translate(_HIDDEN)
        return _packed([t.id for t in self.model.tokenize(plain)])

    def encode(self, text: str) -> bytes:
        """The ids of ``text``. Words do not act on each other, so plain texts go word by word, long ones in pieces."""
        out, at = [], 0
        while at < len(text):
            end = len(text)
            if end - at > PIECE_CHARS:
                end = text.rfind(" ", at, at + PIECE_CHARS)
                end = end if end > at else text.find(" ", at + PIECE_CHARS)
                end = end if end > 0 else len(text)
            out.append(self._piece(text[at:end]))
            at = end
        return b"".join(out)

    def _piece(self, text: str) -> bytes:
        if "<|" in text or not _PLAIN.fullmatch(text) or not unicodedata.is_normalized("NFC", text):
            return self.slow(text)
        return b"".join(map(self.__getitem__, _SPLIT.findall(text.lower())))


def word_cache(path: str) -> WordCache:
    if path not in _loaded:
        _loaded[path] = WordCache(path)
    return _loaded[path]


def tokenize(docs: DataFrame, path: str, *, text: str = "text", end_id: int | None = END_ID) -> DataFrame:
    """``docs`` (with ``queue``) without text; ``ids`` as packed 32-bit integers, their number
    ``n``, the task's number ``chunk`` and the queue's tokens before in this task, ``ahead``."""
    docs = without(docs, "ids", "n", "chunk", "ahead")
    fields = [f for f in docs.schema.fields if f.name != text]
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches):
        cache, so_far, chunk = word_cache(path), {}, TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                ids = [cache.encode((t or b"").decode("utf-8", "replace")) + end for t in raw(part, text)]
                counts, ahead = [len(x) // 4 for x in ids], []
                for queue, n in zip(part.column("queue").to_pylist(), counts, strict=True):
                    ahead.append(so_far.get(queue, 0))
                    so_far[queue] = ahead[-1] + n
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f.name) for f in fields), pa.array(ids, pa.binary()), pa.array(counts, pa.int64()), pa.array([chunk] * len(part), pa.int32()), pa.array(ahead, pa.int64())],
                    names=[*(f.name for f in fields), "ids", "n", "chunk", "ahead"],
                )

    more = [T.StructField("ids", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("chunk", T.IntegerType()), T.StructField("ahead", T.LongType())]
    return docs.mapInArrow(run, T.StructType([*fields, *more]))


def _weight(share: Fraction, whole: Fraction) -> int:
    """A queue without a target is served last but still in full."""
    return max(1, round(share / whole * (1 << WEIGHT_BITS)))


class Mixture:
    """The service order of the queues: ``totals`` tokens each, served by whole ``weights``."""

    def __init__(self, totals: dict[str, int], weights: dict[str, int], quantum: int = QUANTUM):
        self.names = sorted(totals)
        self.number = {n: k for k, n in enumerate(self.names)}
        self.quantum = quantum
        self.total = np.array([totals[n] for n in self.names], np.int64)
        self.weight = np.array([weights[n] for n in self.names], np.int64)

    def before(self, queue: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Tokens of all queues that are served before each (queue, block)."""
        out = np.zeros(len(block), np.int64)
        own = self.weight[queue]
        for k, (w, total) in enumerate(zip(self.weight.tolist(), self.total.tolist(), strict=True)):
            # Blocks i of queue k with (2i + 1) / w < (2 block + 1) / own; equal ones too if k comes first.
            top = (2 * block + 1) * w - own
            less = np.where(k < queue, top // (2 * own) + 1, -(-top // (2 * own)))
            less = np.where(k == queue, block, np.maximum(less, 0))
            out += np.minimum(less * self.quantum, total)
        return out

    def cut(self, queue: np.ndarray, start: np.ndarray, n: np.ndarray, window: int):
        """Pieces of documents at ``start`` in their queues, as of ``_cut``."""
        return _cut(start, n, window, self.quantum, lambda doc, block: self.before(queue[doc], block))


def _cut(start: np.ndarray, n: np.ndarray, window: int, quantum: int, before):
    """Pieces of documents at ``start`` in their queues: (document, start in it, length, rank in the stream).
    ``before`` gives the tokens served before each (document, block of its queue), in order."""
    q = quantum
    first, last = start // q, (start + n - 1) // q
    each = np.where(n > 0, last - first + 1, 0)
    doc = np.repeat(np.arange(len(n)), each)
    block = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
    low = np.maximum(start[doc], block * q)
    high = np.minimum((start + n)[doc], (block + 1) * q)
    rank = before(doc, block) + low - block * q
    # A block in two windows or more is cut there.
    parts = (rank + high - low - 1) // window - rank // window + 1
    over = np.repeat(np.arange(len(doc)), parts)
    k = np.arange(len(over)) - np.repeat(np.cumsum(parts) - parts, parts)
    edge = (rank // window)[over] + k
    at = np.maximum(rank[over], edge * window)
    end = np.minimum((rank + high - low)[over], (edge + 1) * window)
    doc, begin = doc[over], low[over] - start[doc[over]] + at - rank[over]
    # Neighbours in the document that are neighbours in one window are one piece.
    if len(doc):
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != end[:-1]) | (at[1:] % window == 0)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(doc)) - 1
        return doc[head], begin[head], end[tail] - at[head], at[head]
    return doc, begin, end - at, at


def _weighted(totals: DataFrame, weights: dict[str, float] | None, temper: float) -> DataFrame:
    """``totals(queue, total)`` with the ``weight`` of each queue, a whole multiple of 2^-WEIGHT_BITS of all."""
    if not weights and temper == 1:
        whole = totals.agg(F.sum("total")).first()[0] or 1
        scaled = totals.withColumn("_s", F.expr(f"cast(total as decimal(20, 0)) * {1 << WEIGHT_BITS}")).withColumn("_q", F.expr(f"_s div {whole}"))
        left = F.expr(f"2 * (_s - cast(_q as decimal(20, 0)) * {whole})")
        up = (left > whole) | ((left == whole) & (F.col("_q") % 2 == 1))  # to the even one of two, as round() does
        return scaled.select("queue", "total", F.greatest(F.lit(1), F.col("_q") + up.cast("long")).alias("weight"))
    if not weights:
        power = F.pow(F.col("total").cast("double"), F.lit(float(temper)))
        whole = totals.agg(F.sum(power)).first()[0] or 1.0
        return totals.select("queue", "total", F.greatest(F.lit(1), F.round(power / whole * (1 << WEIGHT_BITS)).cast("long")).alias("weight"))
    spark = totals.sparkSession
    names = F.broadcast(spark.createDataFrame([(n,) for n in weights], "queue string"))
    share = {r["queue"]: Fraction(weights[r["queue"]]) for r in totals.join(names, "queue", "left_semi").collect()}
    whole = sum(share.values()) or 1
    own = spark.createDataFrame([(n, _weight(s, whole)) for n, s in share.items()], "queue string, weight long")
    return totals.join(F.broadcast(own), "queue", "left").select("queue", "total", F.coalesce("weight", F.lit(1).cast("long")).alias("weight"))


def _ranked(ws: Workspace, queues: DataFrame, quantum: int) -> DataFrame:
    """``(queue, block, before)``: the tokens served before each block of ``queues(queue, total, weight)``."""
    runs = queues.where("total > 0").withColumn("last", F.expr(f"(total - 1) div {quantum}")).withColumn("low", F.explode(F.expr(f"sequence(0L, last, {STRIDE}L)")))
    blocks = runs.repartition("queue", "low").withColumn("block", F.explode(F.expr(f"sequence(low, least(low + {STRIDE - 1}, last))")))
    # Due at (2 block + 1) / weight: whole part, and a rest that a double tells from all others.
    due = blocks.select(
        F.expr("(2 * block + 1) div weight").alias("whole"),
        F.expr("((2 * block + 1) % weight) / weight").alias("rest"),
        "queue",
        "block",
        F.expr(f"least({quantum}L, total - block * {quantum})").alias("size"),
    )
    order = ["whole", "rest", "queue"]

    def run(batches):
        task, served = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = batch.column("size").to_numpy(zero_copy_only=False)
            ahead = served + np.cumsum(size) - size
            served += int(size.sum())
            yield pa.RecordBatch.from_arrays([batch.column("queue"), batch.column("block"), batch.column("size"), pa.array([task] * len(batch), pa.int32()), pa.array(ahead, pa.int64())], names=["queue", "block", "size", "task", "ahead"])

    sums = ws.write(due.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "queue string, block long, size long, task int, ahead long"))
    base = F.coalesce(F.sum("size").over(W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a task
    bases = sums.groupBy("task").agg(F.sum("size").alias("size")).select("task", base.alias("base"))
    return sums.join(F.broadcast(bases), "task").select("queue", "block", (F.col("base") + F.col("ahead")).alias("before"))


PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, *, text: str = "text", source: str = "source", weights: dict[str, float] | None = None, temper: float = 1.0, window: int = WINDOW, quantum: int = QUANTUM, end_id: int | None = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents: their columns but text, and ``PIECE`` (and ``ids``).

    ``weights`` are target token proportions by source; if None, the sources' sizes to the power ``temper``.
    """
    spark = docs.sparkSession
    ws = Workspace(spark)
    docs = without(docs, *[c.split()[0] for c in PIECE.split(", ")], "ids", "queue", "n", "chunk", "ahead", "base", "_ranks")
    name = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    tokens = ws.write(tokenize(docs.withColumn("queue", name), path, text=text, end_id=end_id))
    sizes = ws.write(tokens.groupBy("queue", "chunk").agg(F.max(F.col("ahead") + F.col("n")).alias("size")))
    totals = ws.write(sizes.groupBy("queue").agg(F.sum("size").alias("total")))
    order = W.partitionBy("queue").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    bases = sizes.select("queue", "chunk", F.coalesce(F.sum("size").over(order), F.lit(0)).alias("base"))
    targets = {f"={k}": v for k, v in weights.items()} if weights else None
    fields = [f for f in docs.schema.fields if f.name != text]
    at = (F.col("base") + F.col("ahead")).alias("_at")
    queues = ws.write(_weighted(totals, targets, temper))
    few = queues.limit(QUEUES + 1).collect()
    mixture = Mixture({r["queue"]: r["total"] for r in few}, {r["queue"]: r["weight"] for r in few}, quantum) if len(few) <= QUEUES else None
    if mixture:
        placed = tokens.join(bases, ["queue", "chunk"]).select(*[f.name for f in fields], "queue", "n", "ids", at)
    else:
        # Where documents are is found without their ids; (queue, chunk, ahead) is a key of all that have tokens.
        key = ["queue", "chunk", "ahead"]
        spans = tokens.where("n > 0").select(*key, "n").join(bases, ["queue", "chunk"]).select(*key, "n", at)
        spans = spans.select(*key, "_at", F.explode(F.expr(f"sequence(_at div {quantum}, (_at + n - 1) div {quantum})")).alias("block"))
        found = spans.join(_ranked(ws, queues, quantum), ["queue", "block"])
        ranks = found.groupBy(*key, "_at").agg(F.array_sort(F.collect_list(F.struct("block", "before")))["before"].alias("_ranks"))
        placed = tokens.where("n > 0").join(ranks, key).select(*[f.name for f in fields], "n", "ids", "_at", "_ranks")

    def cut(batch, n):
        start = batch.column("_at").to_numpy(zero_copy_only=False)
        if mixture:
            return mixture.cut(np.array([mixture.number[x] for x in batch.column("queue").to_pylist()], np.int64), start, n, window)
        ranks = batch.column("_ranks").flatten().to_numpy(zero_copy_only=False)
        return _cut(start, n, window, quantum, lambda doc, block: ranks)

    def run(batches):
        for batch in batches:
            n = batch.column("n").to_numpy(zero_copy_only=False)
            doc, begin, length, rank = cut(batch, n)
            ids = [memoryview(x) for x in batch.column("ids").to_pylist()]
            pieces = [ids[d][4 * a : 4 * b] for d, a, b in zip(doc.tolist(), begin.tolist(), (begin + length).tolist(), strict=True)]
            crc = pa.array([zlib.crc32(x) for x in pieces], pa.int64())
            take = pa.array(doc)
            columns = [batch.column(f.name).take(take) for f in fields] + [pa.array(begin), pa.array(length), crc, pa.array(n[doc]), pa.array(rank // window), pa.array(rank % window)]
            names = [*(f.name for f in fields), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array([x.tobytes() for x in pieces], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = T.StructType([*fields, *T._parse_datatype_string(PIECE).fields, *([T.StructField("ids", T.BinaryType())] if with_ids else [])])
    return placed.mapInArrow(run, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """``(sequence_id, ids, length)``: the windows themselves, from ``pack(..., with_ids=True)``.
    A group holds one window, so at most ``WINDOW`` ids."""
    own = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.array_join(F.transform(own, lambda x: F.hex(x["ids"])), "").alias("h"), F.sum("length").alias("length")).select("sequence_id", F.unhex("h").alias("ids"), "length")


def window_mixtures(pieces: DataFrame, *, source: str = "source") -> DataFrame:
    """``(sequence_id, source, tokens, share, so_far)``: what each window has of each source, its share of the
    window, and the source's share of all windows up to this one, which follows the target."""
    own = pieces.groupBy("sequence_id", F.col(source).alias("source")).agg(F.sum("length").alias("tokens"))
    whole = own.groupBy("sequence_id").agg(F.sum("tokens").alias("size"))
    full = pieces.agg(F.max(F.col("offset") + F.col("length")).alias("window"))
    order = W.partitionBy("source").orderBy("sequence_id").rowsBetween(W.unboundedPreceding, 0)
    rows = own.join(whole, "sequence_id").crossJoin(F.broadcast(full)).withColumn("sum", F.sum("tokens").over(order))  # one row
    return rows.select("sequence_id", "source", "tokens", (F.col("tokens") / F.col("size")).alias("share"), (F.col("sum") / (F.col("sequence_id") * F.col("window") + F.col("size"))).alias("so_far"))


#: Targets of the registered query: small sources count for more than they have.
TEMPER = 0.7


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op7_mixture_packing(spark, sf_dir):
    """One row per piece of a document in a training window."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return pack(docs, vocabulary(), temper=TEMPER).select("doc_id", "source", *[c.split()[0] for c in PIECE.split(", ")])
