"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of a text is a blob named by its SHA-256. The ledger holds one
row per (blob, rule) that was scanned, with the spans found; a rule is named
with its version, so a changed pattern is a new pair. A run scans only pairs
that the ledger lacks, each blob once however many paths have it, and joins
the findings back to all paths.

The ledger is a table in a folder of the caller's (``Ledger``). ``update`` scans
what is new and appends it; a second run over the same versions scans nothing.
Texts in which no rule's hint occurs send only their hash to the exchange that
finds the distinct blobs. Two runs at once may both scan a pair; readers take
one of such rows, as a pair's spans are always the same.

Match offsets come from built-in functions: ``split`` gives the text between
matches and ``regexp_extract_all`` the matches, so an offset is a running sum
of code point counts. Only lengths leave the row that holds the text.

Defined cases: a null text is the empty blob; repeated rows each get their
row; an empty table or ledger is fine; clashing input columns give way.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.common import Workspace, table, without


@dataclass(frozen=True)
class Rule:
    """A leftmost, non-overlapping pattern. A match counts if group ``group`` has ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    hint: str  # matches wherever the pattern does, at less cost

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    Rule("hex", 1, r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
)
LEDGER = "blob string, rule string, spans array<struct<start:bigint,end:bigint>>"


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _scan(blobs: DataFrame, rule: Rule) -> DataFrame:
    """``(blob, rule, start, end)`` of the matches in ``blobs(blob, text, seen)``."""
    # Runs of hex digits are as long as they can be: asking for the least length finds the same ones.
    pattern = rule.pattern.removesuffix("+") + f"{{{rule.least},}}" if rule.kind == "hex" else rule.pattern
    lengths = lambda c: F.transform(c, F.length)
    match = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    value = match if rule.group == 0 else F.regexp_extract_all("text", F.lit(pattern), F.lit(rule.group))
    order = W.partitionBy("blob").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return (
        blobs.where(~F.array_contains("seen", rule.name))
        .where(F.contains("text", F.lit(rule.hint)) if rule.kind == "access" else F.col("text").rlike(rule.hint))
        .where(F.col("text").rlike(pattern))
        .select("blob", lengths(F.split("text", pattern, -1)).alias("gap"), lengths(match).alias("len"), lengths(value).alias("value"))
        .select("blob", F.posexplode(F.arrays_zip(F.slice("gap", 1, F.size("len")).alias("gap"), "len", "value")).alias("pos", "m"))
        .select("blob", "pos", F.col("m.gap").cast("long").alias("gap"), F.col("m.len").cast("long").alias("len"), F.col("m.value").alias("value"))
        .withColumn("end", F.sum(F.col("gap") + F.col("len")).over(order))
        .where(F.col("value") >= rule.least)
        .select("blob", F.lit(rule.name).alias("rule"), (F.col("end") - F.col("len")).alias("start"), "end")
    )


def scan(versions: DataFrame, *, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The ledger rows that ``versions`` adds: every unseen (blob, rule) pair, scanned."""
    ws = Workspace(versions.sparkSession)
    names = F.array(*[F.lit(r.name) for r in rules])
    body = F.coalesce(F.col(text), F.lit(""))
    hints = [F.contains(body, F.lit(r.hint)) if r.kind == "access" else body.rlike(r.hint) for r in rules]
    likely = hints[0]
    for hint in hints[1:]:
        likely = likely | hint
    # Equal blobs have equal hints. Texts without one are done once their hash is known to be new.
    blobs = versions.select(blob_id(F.col(text)).alias("blob"), F.when(likely, body).alias("text")).dropDuplicates(["blob"])
    if ledger is None:
        blobs = blobs.withColumn("seen", F.array().cast("array<string>"))
    else:
        seen = ledger.where(F.col("rule").isin([r.name for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    staged = ws.write(blobs.where(F.size("seen") < len(rules)).select("blob", "seen", "text"))
    found = None
    for rule in rules:
        own = _scan(staged.where("text is not null"), rule)
        found = own if found is None else found.unionByName(own)
    spans = found.groupBy("blob", "rule").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    pairs = staged.select("blob", F.explode(F.array_except(names, "seen")).alias("rule"))
    return pairs.join(spans, ["blob", "rule"], "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")))


class Ledger:
    """The ledger as a Parquet table under ``path``, which all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        """One row a pair; none before the first update."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.spark.range(0).select(*[F.lit(None).cast(x.split(' ', 1)[1]).alias(x.split(' ', 1)[0]) for x in LEDGER.split(', ')])
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def update(self, versions: DataFrame, *, rules: tuple[Rule, ...] = RULES, text: str = "text") -> int:
        """Scans the unseen pairs of ``versions`` and appends them; how many there were."""
        ws = Workspace(self.spark)
        new = ws.write(scan(versions, ledger=self.rows(), rules=rules, text=text))
        n = new.count()
        if n:
            new.write.mode("append").parquet(self.path)
        return n


def findings(paths: DataFrame, ledger: DataFrame, *, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``paths`` less the text, each with ``blob``, ``n_<kind>`` and ``spans`` (kind:start:end, by start, then kind)."""
    paths = without(paths, "blob", "spans", *[f"n_{r.kind}" for r in rules])
    rank = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.name, k)])
    each = (
        ledger.where(F.col("rule").isin([r.name for r in rules]) & (F.size("spans") > 0))
        .dropDuplicates(["blob", "rule"])
        .select("blob", F.explode("spans").alias("s"), rank[F.col("rule")].alias("rank"))
        .groupBy("blob")
        .agg(
            F.array_sort(F.collect_list(F.struct(F.col("s.start").alias("start"), "rank", F.col("s.end").alias("end")))).alias("found"),
            *[F.count_if(F.col("rank") == k).alias(f"n_{r.kind}") for k, r in enumerate(rules)],
        )
    )
    label = lambda x: F.concat_ws(":", F.element_at(F.array(*[F.lit(r.kind) for r in rules]), x["rank"] + 1), x["start"], x["end"])
    each = each.select("blob", *[f"n_{r.kind}" for r in rules], F.concat_ws(",", F.transform("found", label)).alias("spans"))
    named = paths.select(*[c for c in paths.columns if c != text], blob_id(F.col(text)).alias("blob"))
    zero = [F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in rules]
    return named.join(each, "blob", "left").select(*named.columns, *zero, F.coalesce("spans", F.lit("")).alias("spans"))


def base_spans(spans: Column) -> Column:
    """Of a list of spans, those of the kinds in RULES."""
    kinds = F.array(*[F.lit(r.kind) for r in RULES])
    return F.array_join(F.filter(F.split(spans, ","), lambda x: F.array_contains(kinds, F.substring_index(x, ":", 1))), ",")


def op8_secret_ledger(spark, sf_dir):
    """One row per document: counts, digest and list of its secrets' spans. Every run starts a ledger of its own."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = Ledger(spark, f"{Workspace(spark).root}/ledger")
    ledger.update(docs)
    return findings(docs, ledger.rows()).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(base_spans(F.col("spans")), 256).alias("base_sha256"), "spans")


def _sql_matches(rule: Rule, rank: int) -> str:
    """Matches of one rule by what lies between them."""
    pattern = (rule.pattern.removesuffix("+") + f"{{{rule.least},}}" if rule.kind == "hex" else rule.pattern).replace("'", "''")
    return f"""
select r, {rank} as rank, '{rule.kind}' as kind, list_sum(list_transform(gap[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hit[1:k - 1], lambda x: length(x))), 0) as start, length(hit[k]) as size
from (select r, string_split_regex(text, '{pattern}') as gap, regexp_extract_all(text, '{pattern}') as hit, regexp_extract_all(text, '{pattern}', {rule.group}) as value, unnest(range(1, len(regexp_extract_all(text, '{pattern}')) + 1)) as k from doc)
where length(value[k]) >= {rule.least}"""


OP8_SQL = f"""
with doc as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
found as ({' union all '.join(_sql_matches(rule, k) for k, rule in enumerate(RULES))}),
own as (
  select r, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    string_agg(kind || ':' || start::bigint || ':' || (start + size)::bigint, ',' order by start, rank) as spans from found group by r)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from doc left join own using (r)
"""
