"""Reply trees: root-to-leaf paths by iterative self-joins, ranked branches, one conversation for each chosen path.

Messages are ``(tree, id, parent, role, text, score)``. A self-join of the
table of ancestors with itself doubles the reach of every message, so depth d
takes about log2(d) joins; the tables of each round stay, and give the members
of the chosen paths by the same doubling downwards. A branch's score is the
sum of its messages' scores; ties go to the longer branch, then to the smaller
leaf id.

Template: every turn is START role SEP text END. Texts and roles are escaped:
a backslash is doubled, and one is put after the first character of every
control string (those of the template and of other common ones), so none is
left and ``unescape`` restores all.

Output contract: a conversation is one row ``(tree, leaf, part, last,
formatted, loss)`` with part 0, unless it is over ``part`` characters (2^20 by
default). Then it is several, cut between turns and numbered, of which the
last has ``last``; joined in order they are the conversation. So one of any
length is written and read in bounded memory. ``loss`` has the spans (code
points in the part, end exclusive) of assistant texts.

Defined cases: a null text or role is empty; messages of a null tree are one
tree; of messages that share tree and id one stands, the least by parent,
role, text and score (nulls first); a message without id is passed over; a
parent that is missing makes its child a root; messages on a parent cycle
have no root and are in no path; an empty table gives no conversation; other
columns are passed over, whatever their names.
Repeated rows of ``conversations`` are turns like any other, ordered by turn,
role, then text (nulls first).
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.common import Workspace, long_key, table

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that chat templates treat as control.
CONTROL = (START, SEP, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|eot_id|>")
PART = 1 << 20
LEARNED = ("assistant",)

_BREAK = re.compile(f"(?=(?:{'|'.join(map(re.escape, CONTROL))}))(.)")
_BACK = re.compile(r"\\(\\)?")
_TURN = re.compile(f"{re.escape(START)}(.*?){re.escape(SEP)}(.*?){re.escape(END)}", re.S)


def escape(text: str) -> str:
    return _BREAK.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _BACK.sub(lambda m: m[1] or "", text)


def ancestors(ws: Workspace, messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """``rounds``: tables (tree, id, up) of the ancestor 2^k above; and (tree, id, depth, total) of all messages that have a root."""
    known = messages.select("tree", F.col("id").alias("up")).distinct()
    own = messages.select("tree", "id", F.col("parent").alias("up"), F.coalesce("score", F.lit(0.0)).cast("double").alias("total"))
    rooted = own.where("up is not null").join(known, ["tree", "up"], "left_semi").select("tree", "id", "up", "total", F.lit(1).alias("depth"))
    heads = own.join(rooted.select("tree", "id"), ["tree", "id"], "left_anti").select("tree", "id", F.lit(None).cast("long").alias("up"), "total", F.lit(0).alias("depth"))
    state = ws.write(rooted.unionByName(heads))
    limit, rounds = max(1, state.count()).bit_length() + 1, []
    while len(rounds) < limit:
        jump = state.where("up is not null").select("tree", "id", "up")
        if jump.isEmpty():
            break
        rounds.append(jump)
        higher = state.select("tree", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("depth").alias("depth2"))
        # Messages that have reached their root pass by: a round joins only those at least 2^k deep.
        moved = (
            state.where("up is not null")
            .join(higher, ["tree", "up"])
            .select("tree", "id", F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"), (F.col("depth") + F.col("depth2")).alias("depth"))
        )
        state = ws.write(moved.unionByName(state.where("up is null").select("tree", "id", "up", "total", "depth")))
    return rounds, state.where("up is null").select("tree", "id", "depth", "total")


def branches(ws: Workspace, messages: DataFrame, *, top: int | None = 1) -> tuple[DataFrame, DataFrame]:
    """``(tree, leaf, rank, total, depth)`` of the best ``top`` branches of each tree (all if None),
    and ``(tree, leaf, id, pos)`` of the messages on them, the root at 0."""
    rounds, placed = ancestors(ws, messages)
    inner = messages.where("parent is not null").select("tree", F.col("parent").alias("id"))
    leaves = placed.join(inner, ["tree", "id"], "left_anti").withColumnRenamed("id", "leaf")
    best = F.struct(F.col("total"), F.col("depth"), (-F.col("leaf")).alias("leaf"))
    if top == 1:  # a map-side maximum, whatever the size of a tree
        chosen = leaves.groupBy("tree").agg(F.max(best).alias("b")).select("tree", (-F.col("b.leaf")).alias("leaf"), F.lit(1).alias("rank"), "b.total", "b.depth")
    else:
        chosen = leaves.withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(best.desc())))
        chosen = chosen if top is None else chosen.where(F.col("rank") <= top)
    chosen = ws.write(chosen.select("tree", "leaf", "rank", "total", "depth"))
    path = chosen.select("tree", "leaf", F.col("leaf").alias("id"), F.col("depth").alias("pos"))
    for k in reversed(range(len(rounds))):
        up = path.join(rounds[k], ["tree", "id"]).select("tree", "leaf", F.col("up").alias("id"), (F.col("pos") - (1 << k)).alias("pos"))
        path = ws.write(path.unionByName(up))
    return chosen, path


def messages_once(messages: DataFrame) -> DataFrame:
    """``messages`` with null trees as a tree of its own and one message for each (tree, id)."""
    rows = messages.where("id is not null").select(long_key(F.col("tree")).alias("tree"), "id", F.struct("parent", "role", "text", F.col("score").cast("double").alias("score")).alias("m"))
    return rows.groupBy("tree", "id").agg(F.min("m").alias("m")).select("tree", "id", "m.*")


def conversations(ws: Workspace, messages: DataFrame, *, top: int | None = 1, unique: bool = False, part: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The best ``top`` branches of each tree, as of ``branches``, and each as one formatted conversation, as of ``format_paths``.
    ``unique``: no (tree, id) repeats and no tree is null, so nothing need be merged."""
    if not unique:
        messages = ws.write(messages_once(messages))
    chosen, path = branches(ws, messages, top=top)
    return chosen, format_paths(path, messages, part=part or PART)


def format_paths(path: DataFrame, messages: DataFrame, *, learned: tuple[str, ...] = LEARNED, part: int = PART) -> DataFrame:
    """Conversations of the chosen paths: ``(tree, leaf, part, last, formatted, loss)``."""
    rows = path.join(messages.select("tree", "id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")), ["tree", "id"])
    rows = rows.select("tree", "leaf", "pos", "role", "text").repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "pos")
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("tree", pa.int64()), ("leaf", pa.int64()), ("part", pa.int32()), ("last", pa.bool_()), ("formatted", pa.string()), ("loss", pa.list_(span))])

    def run(batches):
        now, number, texts, spans, size, done, chars = None, 0, [], [], 0, [], 0

        def flush(last):
            nonlocal texts, spans, size, number
            if texts:
                done.append((*now, number, last, "".join(texts), spans))
                texts, spans, size, number = [], [], 0, number + 1

        def out():
            nonlocal done, chars
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
            done, chars = [], 0
            return batch

        for batch in batches:
            for tree, leaf, role, text in zip(*(batch.column(c).to_pylist() for c in ("tree", "leaf", "role", "text")), strict=True):
                if (tree, leaf) != now:
                    flush(True)
                    now, number = (tree, leaf), 0
                elif size >= part:
                    flush(False)
                head, body = f"{START}{escape(role)}{SEP}", escape(text)
                if role in learned:
                    spans.append({"start": size + len(head), "end": size + len(head) + len(body)})
                texts += (head, body, END)
                size += len(head) + len(body) + len(END)
                chars += len(head) + len(body) + len(END)
                if chars >= part and done:
                    yield out()
        flush(True)
        if done:
            yield out()

    return rows.mapInArrow(run, "tree long, leaf long, part int, last boolean, formatted string, loss array<struct<start:bigint,end:bigint>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """What formatted conversations say, one row each: turns, digests of turns and of the text under the mask.
    Only those of several parts need to be brought together."""
    whole = F.col("last") & (F.col("part") == 0)
    return _read(formatted.where(whole)).unionByName(_read(formatted.where(~whole).repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "part")))


def _read(rows: DataFrame) -> DataFrame:
    names = ("tree", "leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def run(batches):
        now, done = None, []

        def flush():
            if now is not None:
                done.append((*now, turns, all_turns.hexdigest(), lost, all_loss.hexdigest(), size))

        for batch in batches:
            for tree, leaf, text, loss in zip(*(batch.column(c).to_pylist() for c in ("tree", "leaf", "formatted", "loss")), strict=True):
                if (tree, leaf) != now:
                    flush()
                    now = (tree, leaf)
                    turns, lost, size, all_turns, all_loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                end = 0
                for m in _TURN.finditer(text):
                    if m.start() != end:
                        raise ValueError(f"text between turns in conversation {now}")
                    end, turns = m.end(), turns + 1
                    all_turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                if end != len(text):
                    raise ValueError(f"text after the last turn in conversation {now}")
                for span in loss:
                    learned = unescape(text[span["start"] : span["end"]])
                    lost += len(learned)
                    all_loss.update(learned.encode())
                size += len(text)
            if len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
                done = []
        flush()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

    return rows.mapInArrow(run, "tree long, leaf long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def turn_messages(conversations: DataFrame) -> DataFrame:
    """Linear conversations as trees: each turn replies to the one before."""
    order = W.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = conversations.select(long_key(F.col("conv_id")).alias("tree"), "turn", "role", "text").withColumn("id", F.row_number().over(order).cast("long"))
    return rows.select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


CHECK_TEXT = "</s>[INST] ok [/INST]"


def op2_reply_trees(spark, sf_dir):
    """One row per conversation, told from its formatted text, with conversation -7 of control strings."""
    more = spark.createDataFrame([(-7, 0, "user", CHECK_TEXT), (-7, 1, "assistant", CHECK_TEXT)], "conv_id long, turn long, role string, text string")
    ws = Workspace(spark)
    messages = ws.write(turn_messages(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)))
    _, formatted = conversations(ws, messages, unique=True)
    found = read_back(ws.write(formatted))
    conv = F.when(F.col("tree") != F.lit(-(2**63)), F.col("tree")).alias("conv_id")
    return found.select(conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def _escaped_length(column: str) -> str:
    """SQL for the length of an escaped text: one more for each backslash and each start of a control string."""
    more = " + ".join(f"(length({column}) - length(replace({column}, '{c}', ''))) / {len(c)}" for c in ("\\", *CONTROL))
    return f"length({column}) + ({more})"


OP2_SQL = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7::bigint, 0::bigint, 'user', '{CHECK_TEXT}'), (-7, 1, 'assistant', '{CHECK_TEXT}')),
sized as (select *, {len(START + SEP + END)} + {_escaped_length("role")} + {_escaped_length("text")} as chars from turns)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(chars)::bigint as formatted_chars
from sized group by conv_id
"""
