"""Language ID by language-bitmask n-gram filters.

One bit-sliced Bloom filter serves all languages: each of its slots is a
bitmask, bit l for language l, and an n-gram of language l sets bit l in
``HASHES`` slots. The AND of an n-gram's slots are all languages that have it.
A text is put to the filter n-gram by n-gram; popcounts by language, less the
false positives that the language's fill makes likely, decide. The number of
slots follows from the largest language's number of n-grams, so that its fill
stays under a half.

An n-gram is taken for a language if it occurs in at least ``LEAST`` of the
language's training texts (one, if under ``FEW`` were sampled) and in at least
``SHARE`` of the share of texts that its most frequent language has it in, so
common names and stray quotes do not enter. Training reads a sample of about
``texts`` texts and ``chars`` characters a language (parameters of ``train``),
chosen by hash of the text and its row number, so that copies of a text are
drawn one by one; a language with fewer is read whole. Counts are summed by
Spark. Texts too long for ``FEW`` of them to fit the sample enter only where a
language has under ``FEW`` others, so that a few giants do not crowd out the
rest. Labels are a set of the caller's: their names, and a mask of 64 of them
for each slot, are held by the driver and sent to tasks.

Letters are those of any script with their combining marks.

Defined cases: a null text, or one without a letter, is ``und`` with score 0,
as is any text when there is nothing to learn from; ties go to the language
first in the alphabet; texts without a known n-gram go to the most frequent
language with score 0; only ``text`` is an input of a prediction; training
rows with null text or language are passed over; a null doc_id is not held
out; clashing columns give way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import Workspace, extended, raw, table, without

SAMPLE = 2000
SAMPLE_CHARS = 8_000_000
SIZES = (2, 3, 4)
LEAST_BITS = 16
HASHES = 3
WORD = 64
LEAST = 3
FEW = 30
SHARE = 0.25
PIECE = 1 << 18  # code points at a time, of texts of any length
UND = "und"

_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_ASCII = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(256))
_LOW = np.uint64((1 << 31) - 1)


def _pieces(text: bytes | None):
    """Code points of a lower-cased text with one space for each run of non-letters, in pieces of bounded size."""
    if not text:
        return
    if text.isascii():
        parts = (b" ".join(text[max(0, k - 8) : k + PIECE].translate(_ASCII).split()) for k in range(0, len(text), PIECE))
        yield from (np.frombuffer(b" %b " % part, np.uint8).astype(np.uint64) for part in parts if part)
        return
    whole = text.decode("utf-8", "replace")
    for k in range(0, len(whole), PIECE):
        part = _OTHER.sub(" ", whole[max(0, k - 8) : k + PIECE].lower()).strip(" ")
        if any(map(str.isalpha, part)):
            yield np.frombuffer(f" {part} ".encode("utf-32-le"), np.uint32).astype(np.uint64)


def grams(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of all n-grams of SIZES."""
    out = []
    state = codes + np.uint64(0x9E3779B97F4A7C15)
    rolled = state.copy()
    for n in range(2, max(SIZES) + 1):
        if len(codes) < n:
            break
        rolled = (rolled[: len(codes) - n + 1] * np.uint64(0x100000001B3)) ^ state[n - 1 :]
        if n in SIZES:
            h = rolled ^ (rolled >> np.uint64(29))
            h = h * np.uint64(0xBF58476D1CE4E5B9)
            out.append(h ^ (h >> np.uint64(32)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


class Filter:
    """The bit-sliced filter: 64 languages a row of ``masks``, a slot a column; ``fill`` is a share for each language."""

    def __init__(self, languages: list[str], default: int = 0, bits: int = LEAST_BITS):
        self.languages = languages
        self.default = default
        self.bits = bits
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if min(len(languages), WORD) <= 8 * np.dtype(k).itemsize)
        self.masks = np.zeros((-(-len(languages) // WORD) or 1, 1 << bits), kind)
        self.fill = np.zeros(len(languages))

    def close(self) -> None:
        self.fill = np.array([(self.masks[k // WORD] & self._bit(k) != 0).mean() for k in range(len(self.languages))])

    def _bit(self, language: int):
        return self.masks.dtype.type(1 << language % WORD)

    def counts(self, h: np.ndarray) -> np.ndarray:
        """N-grams found, by language."""
        out = np.zeros(len(self.languages))
        low, high, mask = h & _LOW, (h >> np.uint64(33)) | np.uint64(1), np.uint64((1 << self.bits) - 1)
        slots = [((low + np.uint64(k) * high) & mask).astype(np.int64) for k in range(HASHES)]
        for word, masks in enumerate(self.masks):
            found = masks[slots[0]]
            for at in slots[1:]:
                found &= masks[at]
            for k in range(WORD * word, min(WORD * (word + 1), len(out))):
                out[k] = np.count_nonzero(found & self._bit(k))
        return out

    def predict(self, text: bytes | None) -> tuple[str, float]:
        total, asked, letters = np.zeros(len(self.languages)), 0, False
        for codes in _pieces(text):
            letters = True
            h = grams(codes)
            total += self.counts(h)
            asked += len(h)
        if not letters or not self.languages:
            return UND, 0.0
        false = self.fill**HASHES
        real = np.maximum((total - asked * false) / np.maximum(1 - false, 1e-9), 0)
        if not real.any():
            return self.languages[self.default], 0.0
        best = int(real.argmax())
        return self.languages[best], float(min(1.0, real[best] / max(1, asked)))


def _small(spark, rows: list, schema: str) -> DataFrame:
    """A table of a row a label, which the driver holds anyway; sent to all tasks, so that texts stay where they are."""
    return F.broadcast(spark.createDataFrame([tuple(r) for r in rows], schema))


def _sampled(train: DataFrame, texts: int, chars: int) -> DataFrame:
    """Of ``train(lang, text, tag)`` about ``texts`` texts and ``chars`` characters of each language, the least by tag; all of FEW texts or under."""
    whole, spark = 1 << 30, train.sparkSession
    rows = train.withColumn("long", F.length("text") > chars // FEW)
    size = rows.groupBy("lang").agg(F.count_if(~F.col("long")).alias("n"), F.sum(F.when(~F.col("long"), F.length("text")).otherwise(0)).alias("chars"))
    share = F.least(F.lit(1.0), texts / F.col("n"), chars / F.greatest(F.lit(1), F.col("chars")))
    size = size.select("lang", F.when(F.col("n") > 0, F.ceil(share * whole)).otherwise(F.lit(0)).alias("limit"), F.greatest(F.lit(0), FEW - F.col("n")).alias("lacking")).collect()
    lacking = [(r.lang, r.lacking) for r in size if r.lacking]
    extra = {}
    if lacking:  # of long texts, as many of the least tags as the language lacks
        rank = F.row_number().over(W.partitionBy("lang").orderBy("tag"))
        least = rows.where("long").join(_small(spark, lacking, "lang string, lacking long"), "lang").select("lang", "lacking", "tag", rank.alias("k")).where(F.col("k") <= FEW)
        extra = {r.lang: r.tag + 1 for r in least.where("k <= lacking").groupBy("lang").agg(F.max("tag").alias("tag")).collect()}
    limits = _small(spark, [(r.lang, r.limit, extra.get(r.lang, 0)) for r in size], "lang string, limit long, long_limit long")
    return rows.join(limits, "lang").where(F.col("tag") < F.when(F.col("long"), F.col("long_limit")).otherwise(F.col("limit"))).select("lang", "text")


def train(labelled: DataFrame, *, text: str = "text", lang: str = "lang", texts: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Filter:
    """The filter of all languages in ``labelled``, from a sample of about ``texts`` texts and ``chars`` characters of each."""
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.withColumn("tag", F.pmod(F.xxhash64(F.lit("sample"), "text", F.monotonically_increasing_id()), F.lit(1 << 30)))
    ws = Workspace(labelled.sparkSession)
    sample = ws.write(_sampled(rows, texts, chars))
    numbers = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    if not numbers:
        return Filter([])
    languages = sorted(numbers)

    def own_grams(batches):
        for batch in batches:
            for body, name in zip(raw(batch, "text"), batch.column("lang").to_pylist(), strict=True):
                own = np.empty(0, np.uint64)
                for codes in _pieces(body):
                    own = np.union1d(own, grams(codes))
                for k in range(0, len(own), 1 << 16):
                    h = own[k : k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([name] * len(h))], names=["h", "lang"])

    totals = _small(labelled.sparkSession, [(n, k, numbers[n]) for k, n in enumerate(languages)], "lang string, number int, total long")
    counts = sample.mapInArrow(own_grams, "h long, lang string").groupBy("h", "lang").agg(F.count("*").alias("n")).join(totals, "lang")
    share = counts.where(F.col("n") >= F.when(F.col("total") < FEW, F.lit(1)).otherwise(F.lit(LEAST))).select("h", "number", (F.col("n") / F.col("total")).alias("share"))
    most = share.groupBy("h").agg(F.max("share").alias("most"), F.collect_list(F.struct("number", "share")).alias("each"))
    held = ws.write(most.select("h", F.explode("each").alias("e"), "most").where(F.col("e.share") >= SHARE * F.col("most")).select("h", F.col("e.number").alias("number")))
    largest = held.groupBy("number").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("n")).first()["n"]
    # A fill of 1 - exp(-HASHES n / slots) under a half.
    bits = max(LEAST_BITS, int(HASHES * largest / np.log(2)).bit_length())
    out = Filter(languages, max(range(len(languages)), key=lambda k: numbers[languages[k]]), bits)
    # The slots are OR-ed by Spark: at most 2^bits rows for each 64 languages come to the driver.
    low, high = F.col("h").bitwiseAND(F.lit(int(_LOW))), F.shiftrightunsigned("h", 33).bitwiseOR(F.lit(1))
    slot = F.explode(F.array(*[(low + k * high).bitwiseAND(F.lit((1 << bits) - 1)) for k in range(HASHES)]))
    rows = held.select(F.floor(F.col("number") / WORD).cast("int").alias("word"), slot.alias("slot"), F.expr(f"shiftleft(1L, number % {WORD})").alias("bit"))
    found = rows.groupBy("word", "slot").agg(F.bit_or("bit").alias("mask")).toArrow()
    out.masks[found["word"].to_numpy(), found["slot"].to_numpy()] = found["mask"].to_numpy().view(np.uint64).astype(out.masks.dtype)
    out.close()
    return out


def identify(docs: DataFrame, model: Filter, *, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (share of the text's n-grams that the language has)."""
    docs = without(docs, "lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2^bits masks for each 64 languages; the sample bounds the bits

    def run(batches):
        own = sent.value
        for batch in batches:
            found = [own.predict(t) for t in raw(batch, text)]
            yield extended(batch, () if keep_text else (text,), lang_pred=pa.array([x for x, _ in found], pa.string()), score=pa.array([x for _, x in found], pa.float64()))

    fields = [f for f in docs.schema.fields if keep_text or f.name != text]
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op6_language_filters(spark, sf_dir):
    """One row per document: its language, told from the text by what the documents not held out teach."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    found = identify(docs.select("doc_id", "text", held_out().alias("held_out")), model, keep_text=False)
    return found.select("doc_id", "held_out", "lang_pred", "score")
