"""Ranked, budgeted and interleaved selection.

Order-dependent choices are folds that stream a group's ordered rows, linear in
their number; everything else is a window. ``halved`` sees a whole group at once:
it is one chunk of a document, which ``MAX_GROUP`` rows bound; a larger one is an
error. ``shrunk`` takes batches of any size.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.operators.fold import folded

#: Rows of a chunk that is looked at as a whole.
MAX_GROUP = 100_000


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` of each group, numbered from 1 in ``rn``."""
    return rows.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rn") <= k)


def interleaved(rows: DataFrame, keys: list[str], order: list[Column], groups: list[Column]) -> DataFrame:
    """Round-robin over groups: first of each, then second of each. ``turn`` is the round from 1;
    sort by ``turn`` and ``groups`` for the sequence."""
    return rows.withColumn("turn", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def bucket_round_robin(rows: DataFrame, scope: list[str], bucket: list[str], order: list[Column]) -> DataFrame:
    """Round-robin over buckets that come in the order in which their first row does.

    ``turn`` and ``bucket_order`` give the sequence within ``scope``."""
    if not scope:
        raise ValueError("buckets of the whole table cannot be ranked without a scope")
    ranked = rows.withColumn("_rank", F.row_number().over(W.partitionBy(*scope).orderBy(*order)))
    own = W.partitionBy(*scope, *bucket)
    return ranked.withColumn("turn", F.row_number().over(own.orderBy("_rank"))).withColumn("bucket_order", F.min("_rank").over(own)).drop("_rank")


def running_prefix(rows: DataFrame, keys: list[str], order: list[Column], cost: str, budget: int) -> DataFrame:
    """Whole rows while the running cost stays within the budget."""
    over = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(cost).over(over)).where(F.col("used") <= budget)


def first_fit(rows: DataFrame, keys: list[str], order: list[tuple[str, bool]], cost: str, budget: int, *, item: str, most: int | None = None) -> DataFrame:
    """Rows that still fit when their turn comes; those that don't are passed over, not the end.

    ``order``: (column, descending) of numbers. Gives ``(keys, item, cost, pos)``. Rows that cost more than the whole
    budget, or of unknown cost (null), never fit and are left out before any exchange."""
    own = rows.select(*keys, *dict.fromkeys([*(c for c, _ in order), item]), F.col(cost).cast("long").alias("_cost")).where(F.col("_cost") <= budget)
    sort = [F.desc(c) if down else F.asc(c) for c, down in order] + [F.asc(item), F.asc("_cost")]

    def start():
        used, pos = 0, -1

        def step(n):
            nonlocal used, pos
            if used + n > budget or most is not None and pos + 1 >= most:
                return None
            used, pos = used + n, pos + 1
            return (pos,)

        return step

    return folded(own, keys, sort, ["_cost"], "pos int", start).select(*keys, item, F.col("_cost").alias(cost), "pos")


def chunks(rows: DataFrame, keys: list[str], order: str, chars: str, *, limit: int, overhead: int = 150) -> DataFrame:
    """Consecutive rows in chunks: one closes when the next row and its overhead would pass the limit. Adds ``chunk`` from 0.
    A row of unknown size (null) counts as empty."""

    def start():
        size, chunk = 0, 0

        def step(n):
            nonlocal size, chunk
            n = (n or 0) + overhead
            new = 0 < size and size + n > limit
            size, chunk = n if new else size + n, chunk + new
            return (chunk,)

        return step

    return folded(rows, keys, [F.asc(order)], [chars], "chunk int", start)


def halved(rows: DataFrame, keys: list[str], order: str, chars: str, *, limit: int, overhead: int = 150) -> DataFrame:
    """Chunks cut in two until each fits the limit or is a single row; ``part`` numbers them within a chunk."""

    def split(sizes: list[int]) -> list[list[int]]:
        todo, out = [list(range(len(sizes)))], []
        while todo:
            own = todo.pop()
            if len(own) > 1 and sum(sizes[k] + overhead for k in own) > limit:
                todo += [own[len(own) // 2 :], own[: len(own) // 2]]
            else:
                out.append(own)
        return out

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _bounded(pdf)
        pdf = pdf.sort_values(order).reset_index(drop=True)
        part = {k: p for p, own in enumerate(split(pdf[chars].tolist())) for k in own}
        return pdf.assign(part=[part[k] for k in range(len(pdf))])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.groupBy(*keys).applyInPandas(run, f"{schema}, part int")


def _bounded(pdf: pd.DataFrame) -> None:
    if len(pdf) > MAX_GROUP:
        raise ValueError(f"a group of {len(pdf)} rows is over {MAX_GROUP}")


def byte_budget(rows: DataFrame, keys: list[str], order: list[str], text: str, position: str, *, budget: int) -> DataFrame:
    """Texts in ``order`` until the bytes run out; the last one is cut at a whole character, blank cuts cost nothing.
    ``position`` tells the kept rows' order."""

    def start():
        left = budget

        def step(value):
            nonlocal left
            if left <= 0:
                return None
            cut = (value or "").encode()[:left].decode(errors="ignore")
            if not cut.strip():
                return None
            left -= len(cut.encode())
            return (cut,)

        return step

    return folded(rows, keys, [F.asc(c) for c in [*order, position]], [text], f"`{text}` string", start).select(*rows.columns)


def shrunk(rows: DataFrame, keys: list[str], source: str, order: str, text: str, *, limit: int, overhead: int = 0, least: int = 120) -> DataFrame:
    """A batch made to fit: the last span of the source with the most text goes, single spans are halved, never under ``least`` characters.

    A source's size before each drop, and a span's before each halving, only falls: the steps of a batch are all of
    them by size (equal ones by ascending source) until it fits, which a running sum tells. Drops from sources of over
    ``limit`` characters are sure, and a sum tells whether halving can help, so ``limit`` bounds what is ranked, not the batch."""
    if least < 1:
        raise ValueError("texts cannot be halved for ever")
    of_source = W.partitionBy(*keys, source).orderBy(order, "_n", text)
    sized = rows.withColumn("_n", F.coalesce(F.length(text), F.lit(0)).cast("long")).withColumn("_at", F.row_number().over(of_source))
    sized = sized.withColumn("_size", F.sum("_n").over(of_source.rowsBetween(W.unboundedPreceding, 0)))
    sized = sized.withColumn("_halvings", F.expr(f"size(filter(sequence(1, 31), j -> shiftright(_n, j) >= {least}))"))
    single, cost = F.col("_at") == 1, F.col("_n") + overhead
    totals = sized.groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]).agg(
        F.sum(cost).alias("_total"),
        F.sum(F.when(single, cost)).alias("_singles"),
        F.sum(F.when(single, F.expr("shiftright(_n, _halvings)") + overhead)).alias("_halved"),
        F.sum(F.when(~single & (F.col("_size") > limit), cost).otherwise(0)).alias("_sure"),
    )
    own = sized.join(totals, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)])
    halving = F.col("_singles") > limit
    own = own.where(F.when(halving, single & (F.col("_halved") <= limit)).otherwise(single | (F.col("_size") <= limit)))
    # A row for each halving that a span may get and one for what it ends as; dropping is one step.
    steps = own.withColumn(text, F.left(text, F.lit(limit))).withColumn("_j", F.explode(F.sequence(F.lit(0), F.when(halving, F.col("_halvings")).otherwise(0))))
    size = F.when(halving, F.expr("shiftright(_n, _j)")).otherwise(F.col("_size"))
    gives = F.when(halving, F.when(F.col("_j") < F.col("_halvings"), F.expr("shiftright(_n, _j) - shiftright(_n, _j + 1)"))).when(~single, cost)
    ranked = W.partitionBy(*keys).orderBy(F.desc(size), F.asc(source), F.desc("_at"), F.asc("_j")).rowsBetween(W.unboundedPreceding, -1)
    left = F.when(halving, F.col("_singles")).otherwise(F.col("_total") - F.col("_sure")) - F.coalesce(F.sum(gives).over(ranked), F.lit(0))
    done = steps.withColumn("_done", gives.isNotNull() & (left > limit)).groupBy(*keys, source, "_at").agg(
        F.first(F.struct(*rows.columns)).alias("_row"), F.first(halving).alias("_halving"), F.first("_n").alias("_n"), F.count_if("_done").cast("int").alias("_done")
    )
    kept = done.where("_halving or _done = 0").select("_row.*", F.expr("shiftright(_n, _done)").cast("int").alias("_chars"), "_halving")
    return kept.withColumn(text, F.when(F.col("_halving"), F.left(text, F.col("_chars"))).otherwise(F.col(text))).select(*rows.columns)


def coverage(rows: DataFrame, keys: list[str], chosen: Column) -> DataFrame:
    """Chosen against all rows of each group, where they differ."""
    out = rows.groupBy(*keys).agg(F.count_if(chosen).alias("chosen"), F.count("*").alias("total"))
    return out.where("chosen <> total")


def best_attempt(rows: DataFrame, keys: list[str], value: str, order: list[Column]) -> DataFrame:
    """The value of the row with the largest order; later ones win ties if the attempt is its last part."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def labelled_sections(blocks: DataFrame, keys: list[str], order: str, heading: str) -> DataFrame:
    """The last heading so far of every block."""
    return blocks.withColumn("section", F.last(heading, ignorenulls=True).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def capped_gaps(gaps: DataFrame, keys: list[str], most: int = 80) -> DataFrame:
    """Distinct ``(area, detail)`` in order of first appearance; beyond ``most``, the last row says how many more there are."""
    own = gaps.groupBy(*keys, "area", "detail").agg(F.min("ord").alias("ord"))
    rank = W.partitionBy(*keys)
    own = own.withColumn("rn", F.row_number().over(rank.orderBy("ord", "area", "detail"))).withColumn("n", F.count("*").over(rank))
    over = (F.col("n") > most) & (F.col("rn") == most)
    fields = [F.when(over, F.lit("limits")).otherwise(F.col("area")).alias("area"), F.when(over, F.concat((F.col("n") - most + 1).cast("string"), F.lit(" more gaps"))).otherwise(F.col("detail")).alias("detail")]
    return own.where(F.col("rn") <= most).select(*keys, *fields, "rn")
