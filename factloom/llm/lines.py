"""Line dedup by a suffix array over line ids, in DataFrame functions only.

A document is a sequence of line ids (128 bits of hash), the corpus the
sequence of all documents. Prefix doubling ranks the suffixes: the rank of a
suffix by its first 2h lines comes from the pair (rank by h lines, rank by h
lines of the suffix h further on). Ranks follow the order of the pairs, by a
range-partitioned sort of the distinct pairs, so each level is the suffix
array's order by 2^k lines. Suffixes alone in their group leave, so levels end
when no run of 2^k lines repeats.

Longest common prefixes. A group of equal ranks by 2^k lines is an interval of
the suffix array whose suffixes share at least 2^k lines. Its suffixes that
share 2^(k+1) lines with an earlier one are settled at a deeper level; the
others, and the group's first, go into a set, which is halved like a number is
read bit by bit: those of a set that also share the next 2^j lines (their rank
at level j, that far on, is equal) become a set of their own, and of these only
the first stays behind. After the last bit the members of a set share exactly
its ``length`` lines and no two share one more: sets are the intervals of
longest common prefixes, with one member for each child. All members but the
first in corpus order repeat exactly ``length`` lines of an earlier place, the
most that any earlier place shares with them. A set of n members settles n - 1
suffixes and halving keeps that sum, so tables never grow.

The first copy of a run in corpus order (doc_id, then text hash, then line)
stays. A maximal repeated run is judged whole: it counts if it has
``MIN_LINES`` lines with words, or ``MIN_WORDS`` words. Later copies of runs
that count are deleted, line by line.

Defined cases: a null text has no lines and stays null; blank lines are lines
of no words, so runs of them alone do not count; a text whose lines are all
deleted becomes empty; rows that share doc_id and text are one document and
share its result; a null doc_id comes first; clashing input columns give way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.common import Workspace, long_key, table, without

MIN_LINES = 4
MIN_WORDS = 20
#: 2^30 lines: more than a row can hold.
LEVELS = 30
PLACE = ["d", "v", "p"]


def _key(doc_id: str, text: str) -> list[Column]:
    return [long_key(F.col(doc_id)).alias("d"), F.xxhash64(F.lit("text"), F.col(text)).alias("v")]


def line_table(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(d, v, p, a, b, w, cw, cl)``, once for each document: line number from 0, 128 bits of line id, words; and up to
    this line the document's words and its lines with words."""
    each = docs.where(F.col(text).isNotNull()).select(*_key(doc_id, text), F.posexplode(F.split(text, "\n", -1)).alias("p", "line"))
    line = F.trim("line")
    words = F.when(line == "", 0).otherwise(F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1)
    rows = each.select(*PLACE, F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"), words.alias("w"))
    once = rows.groupBy(*PLACE).agg(F.first("a").alias("a"), F.first("b").alias("b"), F.first("w").alias("w"))
    order = W.partitionBy("d", "v").orderBy("p").rowsBetween(W.unboundedPreceding, 0)
    return once.select("*", F.sum("w").over(order).alias("cw"), F.count_if(F.col("w") > 0).over(order).cast("int").alias("cl"))


def _ranked(ws: Workspace, suffixes: DataFrame, first: str, second: str) -> DataFrame | None:
    """``(d, v, p, r, later, n)`` of the suffixes whose pair repeats: the pair's rank, whether an earlier suffix has it, and how many do."""
    place = F.struct(*PLACE)
    pairs = suffixes.groupBy(first, second).agg(F.count("*").alias("n"), F.min(place).alias("least")).where("n > 1")
    order = ws.write(pairs.orderBy(first, second).withColumn("r", F.monotonically_increasing_id()))
    if order.isEmpty():
        return None
    return suffixes.join(order, [first, second]).select(*PLACE, "r", (place > F.col("least")).alias("later"), "n")


def suffix_levels(ws: Workspace, lines: DataFrame) -> list[DataFrame]:
    """The repeated suffixes ranked by their first 1, 2, 4... lines."""
    levels: list[DataFrame] = []
    level = _ranked(ws, lines.select(*PLACE, "a", "b"), "a", "b")
    while level is not None and len(levels) < LEVELS:
        levels.append(ws.write(level))
        size = 1 << (len(levels) - 1)
        ahead = F.first("r").over(W.partitionBy("d", "v").orderBy("p").rangeBetween(size, size))
        deeper = levels[-1].select(*PLACE, F.col("r").alias("r1"), ahead.alias("r2")).where("r2 is not null")
        level = _ranked(ws, deeper, "r1", "r2")
    return levels


def _opened(level: DataFrame, deeper: DataFrame | None, k: int) -> tuple[DataFrame, DataFrame]:
    """Of level k: the suffixes that share 2^k lines, but not 2^(k+1), with an earlier one; and sets of them with their group's first."""
    later = level.where("later")
    open_ = later if deeper is None else later.join(deeper.where("later").select(*PLACE), PLACE, "left_anti")
    heads = level.where("not later").join(open_.select("r").distinct(), "r", "left_semi")
    rows = open_.unionByName(heads)
    return open_, rows.select(F.col("r").alias("s"), F.lit(k).cast("long").alias("t"), *PLACE, F.lit(1 << k).alias("length"), "n")


def _halved(ws: Workspace, sets: DataFrame, level: DataFrame, j: int) -> DataFrame:
    """``sets`` after the bit of 2^j lines: members that share them form a set, of which only the first also stays."""
    size = 1 << j
    there = level.select("d", "v", F.col("p").alias("at"), "r")
    ranked = ws.write(sets.withColumn("at", F.col("p") + F.col("length")).join(there, ["d", "v", "at"], "left").drop("at"))
    place = F.struct(*PLACE)
    shared = ranked.where("r is not null").groupBy("s", "t", "r").agg(F.count("*").alias("m"), F.min(place).alias("least")).where("m > 1")
    both = ranked.join(shared, ["s", "t", "r"], "left")
    moves = F.col("m").isNotNull()
    new = F.struct(F.xxhash64("s", "t", "r", F.lit(j)).alias("s"), F.xxhash64(F.lit("set"), "s", "t", "r", F.lit(j)).alias("t"), (F.col("length") + size).alias("length"), F.col("m").alias("n"))
    # Where all members go on together, the first would stay alone: it settles nothing there.
    stays = ~moves | ((place == F.col("least")) & (F.col("m") < F.col("n")))
    old = F.struct("s", "t", F.col("length").alias("length"), F.col("n").alias("n"))
    out = both.select(*PLACE, F.explode(F.array_compact(F.array(F.when(moves, new), F.when(stays, old)))).alias("x"))
    return out.select("x.s", "x.t", *PLACE, "x.length", "x.n")


def longest_repeats(ws: Workspace, lines: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """``(d, v, p)`` of the suffixes that share one line, and no more, with an earlier one; and
    ``(d, v, p, length)`` of those that share more, with the longest prefix that an earlier one has."""
    levels = suffix_levels(ws, lines)
    if not levels:
        return None
    single, sets = None, None
    for k in reversed(range(len(levels))):
        if sets is not None:
            sets = _halved(ws, sets, levels[k], k)
        open_, own = _opened(levels[k], levels[k + 1] if k + 1 < len(levels) else None, k)
        if k == 0:
            single = open_.select(*PLACE)
        else:
            sets = ws.write(own if sets is None else sets.unionByName(own))
    if sets is None:
        return single, lines.select(*PLACE, F.lit(1).alias("length")).limit(0)
    sets = ws.write(sets)
    first = sets.groupBy("s", "t").agg(F.min(F.struct(*PLACE)).alias("least"))
    longer = sets.join(first, ["s", "t"]).where(F.struct(*PLACE) > F.col("least")).select(*PLACE, "length")
    return single, longer


def repeated(ws: Workspace, lines: DataFrame, *, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``(d, v, start, end)``: the maximal runs of lines in later copies of the repeated runs that count."""
    counts = lambda n_lines, n_words: (n_words > 0) & ((n_lines >= min_lines) | (n_words >= min_words))
    found = longest_repeats(ws, lines)
    if found is None:
        return lines.select("d", "v", F.col("p").alias("start"), F.col("p").alias("end")).limit(0)
    single, longer = found
    one = lines.where(counts((F.col("w") > 0).cast("int"), F.col("w"))).select(*PLACE)
    short = one.join(single, PLACE, "left_semi").select(*PLACE, F.lit(1).alias("length"))
    # Of the others, sums up to the line before the run and up to its last line.
    begin = longer.join(lines.select(*PLACE, (F.col("cw") - F.col("w")).alias("cw0"), (F.col("cl") - (F.col("w") > 0).cast("int")).alias("cl0")), PLACE)
    last = lines.select("d", "v", F.col("p").alias("last"), "cw", "cl")
    judged = begin.withColumn("last", F.col("p") + F.col("length") - 1).join(last, ["d", "v", "last"])
    runs = judged.where(counts(F.col("cl") - F.col("cl0"), F.col("cw") - F.col("cw0"))).select(*PLACE, "length").unionByName(short)
    # Runs that touch or overlap are one cut.
    order = W.partitionBy("d", "v").orderBy("p")
    so_far = F.max(F.col("p") + F.col("length")).over(order.rowsBetween(W.unboundedPreceding, -1))
    islands = (
        runs.withColumn("new", F.coalesce(F.col("p") > so_far, F.lit(True)).cast("int"))
        .withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("d", "v", "island")
        .agg(F.min("p").alias("start"), F.max(F.col("p") + F.col("length")).alias("end"))
    )
    return islands.select("d", "v", "start", "end")


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated runs cut from the text, ``n_lines`` and ``n_deleted``."""
    ws = Workspace(docs.sparkSession)
    docs = without(docs, "n_lines", "n_deleted", "_cuts", "_line_d", "_line_v")
    lines = ws.write(line_table(docs, doc_id=doc_id, text=text))
    runs = ws.write(repeated(ws, lines, min_lines=min_lines, min_words=min_words))
    cuts = runs.groupBy(F.col("d").alias("_line_d"), F.col("v").alias("_line_v")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_cuts"))
    # A text must meet its cuts somewhere; cuts grow with the corpus and have no size bound, so they are not sent to all tasks.
    own = [k.alias(n) for k, n in zip(_key(doc_id, text), ("_line_d", "_line_v"), strict=True)]
    out = docs.select("*", *own).join(cuts.hint("merge"), ["_line_d", "_line_v"], "left")
    every = F.split(text, "\n", -1)
    # Between two cuts: from the end of one to the start of the next.
    ends = F.concat(F.array(F.lit(0)), F.transform("_cuts", lambda c: c["end"]))
    begins = F.concat(F.transform("_cuts", lambda c: c["start"]), F.array(F.size(every)))
    left = F.flatten(F.transform(F.arrays_zip(ends.alias("e"), begins.alias("b")), lambda x: F.slice(every, x["e"] + 1, x["b"] - x["e"])))
    gone = F.aggregate("_cuts", F.lit(0), lambda s, c: s + (c["end"] - c["start"]))
    return out.select(
        *[F.when(F.col("_cuts").isNull(), F.col(text)).otherwise(F.array_join(left, "\n")).alias(text) if c == text else F.col(c) for c in docs.columns],
        F.coalesce(F.size(F.when(F.col(text).isNotNull(), every)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(gone, F.lit(0)).cast("long").alias("n_deleted"),
    )


def op4_line_dedup(spark, sf_dir):
    """One row per document: its lines, those deleted, and the text that is left."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_deleted", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("text_sha256"))


#: The same deletions said otherwise: every run that counts is the union of its shortest windows that count, forwards
#: from each of its lines and backwards from each; a window is deleted where an earlier one has the same content.
OP4_SQL = f"""
with line as (
  select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as p
  from documents),
word as (
  select *, case when trim(line) = '' then 0 else length(trim(line)) - length(replace(trim(line), ' ', '')) + 1 end as w from line),
summed as (select *, sum(w) over o as cw, count(*) filter (w > 0) over o as cl from word window o as (partition by doc_id order by p)),
pair as (
  select a.doc_id, a.p as s, b.p as e from summed a join summed b on a.doc_id = b.doc_id and a.p <= b.p
  where b.cw - a.cw + a.w > 0 and (b.cw - a.cw + a.w >= {MIN_WORDS} or b.cl - a.cl + (a.w > 0)::int >= {MIN_LINES})),
win as (select doc_id, s, min(e) as e from pair group by all union select doc_id, max(s), e from pair group by doc_id, e),
content as (
  select win.doc_id, s, e, string_agg(line, chr(10) order by p) as content
  from win join line on win.doc_id = line.doc_id and p between s and e group by win.doc_id, s, e),
later as (select doc_id, s, e from (select *, row_number() over (partition by content order by doc_id, s) as n from content) where n > 1),
gone as (select distinct doc_id, unnest(range(s, e + 1)) as p from later),
kept as (
  select w.doc_id, count(*) as n_lines, count(g.p) as n_deleted,
         coalesce(string_agg(w.line, chr(10) order by w.p) filter (g.p is null), '') as text
  from word w left join gone g on w.doc_id = g.doc_id and w.p = g.p group by w.doc_id)
select d.doc_id, coalesce(k.n_lines, 0)::bigint as n_lines, coalesce(k.n_deleted, 0)::bigint as n_deleted,
       length(k.text)::bigint as kept_chars, sha256(k.text) as text_sha256
from documents d left join kept k on d.doc_id = k.doc_id
"""
