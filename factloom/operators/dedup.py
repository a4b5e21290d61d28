"""Keep-first, upsert and set operators that respect order."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.operators.fold import folded
from factloom.operators.select import top_k


def keep_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def first_of(rows: DataFrame, key: str, item: str) -> DataFrame:
    """Every row with the smallest ``item`` of its key as ``kept_id``: a map-side minimum, then a join, so a key may be of any size. Null keys are one key."""
    first = rows.groupBy(F.col(key).alias("_key")).agg(F.min(item).alias("kept_id"))
    return rows.join(first, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def kept_documents(docs: DataFrame, scope: list[str], *, order: str = "ord", url: str = "url", digest: str = "content_hash") -> DataFrame:
    """In order, a document whose URL or content equals that of a *kept* one gives way to it: ``kept_ord`` names it.
    Exact, so a fold over each scope, whose state is the kept documents' URLs and digests (a job has few)."""

    def start():
        seen: dict[tuple[str, str], int] = {}

        def step(o, u, d):
            kept = seen.get(("u", u), seen.get(("d", d)))
            if kept is None:
                seen[("u", u)] = seen[("d", d)] = kept = o
            return (kept,)

        return step

    return folded(docs, scope, [F.asc(order)], [order, url, digest], "kept_ord long", start)


#: Rounds after which what is left, chains in the order of their rows, goes to the fold.
ROUNDS = 12


def kept_in_rounds(docs: DataFrame, scope: list[str], folder: str, *, order: str = "ord", url: str = "url", digest: str = "content_hash", rounds: int = ROUNDS) -> DataFrame:
    """As ``kept_documents``, for a scope of any size; ``order`` has no repeats within a scope.

    In each round a document that is the first undecided one of its URL and of its content is kept, for no earlier one
    can be; those that share either with it give way. A round is two map-side minima and joins, so a URL or content of any
    number of documents is no hot task. In random order few rounds decide all; a chain in which each document shares one
    thing with the one before takes a round for every two, so what is left after ``rounds`` is folded by scope: it shares
    nothing with what was kept. Tables of the rounds are written under ``folder``, which all executors share."""
    spark, at = docs.sparkSession, f"{folder.rstrip('/')}/{uuid.uuid4().hex}"

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{at}/{name}")
        return spark.read.schema(df.schema).parquet(f"{at}/{name}")

    same = lambda a, b, names: reduce(Column.__and__, [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names])
    own = written(docs.select(*scope, F.col(order).alias("_o"), F.col(url).alias("_u"), F.col(digest).alias("_d")), "rows")
    left, kept = own, []
    for turn in range(rounds):
        firsts = {c: left.groupBy(*scope, c).agg(F.min("_o").alias("_first")) for c in ("_u", "_d")}
        marked = left.alias("l")
        for c, first in firsts.items():
            marked = marked.join(first.alias("f"), same("l", "f", [*scope, c])).select("l.*", F.col("f._first").alias(f"_first{c}")).alias("l")
        marked = written(marked.select("*", ((F.col("_o") == F.col("_first_u")) & (F.col("_o") == F.col("_first_d"))).alias("_kept")), f"marked{turn}")
        chosen = marked.where("_kept").select(*own.columns)
        kept.append(chosen)
        rest = marked.where("not _kept").select(*own.columns)
        for c in ("_u", "_d"):
            rest = rest.alias("l").join(chosen.select(*scope, c).alias("k"), same("l", "k", [*scope, c]), "left_anti")
        left = written(rest.select(*own.columns), f"left{turn}")
        if left.isEmpty():
            break
    else:
        tail = kept_documents(left, scope, order="_o", url="_u", digest="_d")
        kept.append(written(tail.where("kept_ord = _o").select(*own.columns), "tail"))
    chosen = reduce(DataFrame.unionByName, kept).withColumnRenamed("_o", "_by")
    # One kept document for each URL and each content; it counts for those after it.
    out = docs.alias("l")
    for c, name in (("_u", url), ("_d", digest)):
        on = reduce(Column.__and__, [F.col(f"l.{k}").eqNullSafe(F.col(f"k.{k}")) for k in scope], F.col(f"l.{name}").eqNullSafe(F.col(f"k.{c}"))) & (F.col("k._by") <= F.col(f"l.{order}"))
        out = out.join(chosen.select(*scope, c, "_by").alias("k"), on, "left").select("l.*", F.col("k._by").alias(f"_by{c}")).alias("l")
    return out.withColumn("kept_ord", F.coalesce("_by_u", "_by_d")).select(*docs.columns, "kept_ord")


def upsert(rows: DataFrame, keys: list[str], order: str, *, scope: list[str] | None = None, most: int | None = None) -> DataFrame:
    """The last row of each key; with ``most``, only the keys first seen among that many, in each ``scope`` or in all."""
    own = rows.groupBy(*keys).agg(F.max(order).alias("_last"), F.min(order).alias("_first"))
    if most is not None:
        own = top_k(own, scope, [F.asc("_first")], most) if scope else own.orderBy("_first").limit(most)
    last = own.select(*[F.col(k).alias(f"_{n}") for n, k in enumerate(keys)], "_last")
    same = F.col(order) == F.col("_last")
    for n, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_{n}"))
    return rows.join(last, same, "left_semi")


def merged(base: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; ``more`` wins equal keys."""
    return base.join(more.select(*keys), keys, "left_anti").unionByName(more)


def set_mismatch(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, or repeated on one: empty if both are the same set without repeats."""
    a, b = (d.groupBy(*keys).agg(F.count("*").alias(n)) for d, n in ((left, "n_left"), (right, "n_right")))
    out = a.join(b, keys, "full").fillna(0, ["n_left", "n_right"])
    return out.where("n_left <> 1 or n_right <> 1")


def without_resolved(gaps: DataFrame, resolved: DataFrame, area: str) -> DataFrame:
    """Gaps of ``area`` whose detail starts with the name of something now resolved go.
    A detail is looked up by its beginnings of the lengths that names have, so names may begin alike."""
    names = resolved.where("name is not null").select(F.col("name").alias("_name")).distinct()
    lengths = names.agg(F.collect_set(F.length("_name")).alias("_lengths"))
    details = gaps.where(F.col("area") == area).select("detail").distinct().crossJoin(F.broadcast(lengths))
    begun = details.select("detail", F.explode(F.filter("_lengths", lambda n: n <= F.length("detail"))).alias("_length"))
    hit = begun.withColumn("_name", F.left("detail", F.col("_length"))).join(names, "_name", "left_semi").select(F.lit(area).alias("area"), "detail").distinct()
    return gaps.join(hit, ["area", "detail"], "left_anti").select(*gaps.columns)
