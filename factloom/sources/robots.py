"""Robots policies as tables: lines to groups, the best group, allow or not."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.sources.crawl import MAX_DELAY

#: Characters that a path in a policy keeps as they are, and those that are never escaped.
SAFE = "/?:@!$&'()*+,;=%"
UNRESERVED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~"
_UNIT = re.compile(rf"%[0-9A-Fa-f]{{2}}|[^{re.escape(SAFE + UNRESERVED)}]", re.S)


def _escaped(unit: re.Match) -> str:
    if len(unit[0]) == 1:
        return "".join(f"%{b:02X}" for b in unit[0].encode())
    plain = chr(int(unit[0][1:], 16))
    return plain if plain in UNRESERVED else unit[0].upper()


def canonical_path(value: str) -> str:
    """Percent escapes of plain characters undone, others in upper case; what is not plain is escaped."""
    return _UNIT.sub(_escaped, value)


@F.pandas_udf(T.StringType())
def robots_path(value: pd.Series) -> pd.Series:
    return value.map(lambda v: None if v is None else canonical_path(v))


def path_matches(pattern: str, target: str) -> bool:
    """``*`` is anything, a last ``$`` is the end.

    An automaton with a state for each plain character of the pattern, all states in the bits of one
    integer: a character moves states on, a wildcard keeps its state. One step a character, no way back."""
    plain = pattern.removesuffix("$").replace("*", "")
    stay = 0 if pattern.endswith("$") else 1 << len(plain)
    moves: dict[str, int] = {}
    k = 0
    for c in pattern.removesuffix("$"):
        if c == "*":
            stay |= 1 << k
        else:
            moves[c] = moves.get(c, 0) | 1 << k
            k += 1
    state = 1
    for c in target:
        state = (state & moves.get(c, 0)) << 1 | state & stay
        if not state:
            return False
    return bool(state >> len(plain) & 1)


@F.pandas_udf(T.BooleanType())
def robots_match(pattern: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([path_matches(p, t) for p, t in zip(pattern, target, strict=True)])


def specificity(pattern: Column) -> Column:
    """Characters of a pattern: an escape counts one, wildcards and the end mark none."""
    return F.length(F.regexp_replace(F.replace(F.regexp_replace(pattern, r"\$+\z", ""), F.lit("*"), F.lit("")), "%[A-F0-9]{2}", "x"))


def target_path(url: Column) -> Column:
    """Path and query of a URL as rules see them, before ``robots_path``."""
    raw = F.coalesce(F.nullif(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))
    return F.concat(raw, F.when(F.contains(url, F.lit("?")), F.concat(F.lit("?"), F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")))).otherwise(""))


def allowed(targets: DataFrame, rules: DataFrame, unread: DataFrame | None = None) -> DataFrame:
    """``targets(host, target, ...)`` with ``allowed``: the longest matching rule of ``rules(host, pattern, allow)``
    wins, ties allow, no match allows; hosts of ``unread(host)``, as of ``refused``, allow nothing. Rules meet targets by host only."""
    best = F.max(F.struct(specificity(F.col("pattern")).alias("n"), F.col("allow").alias("allow")))
    hit = targets.select("host", "target").distinct().join(rules, "host").where(robots_match("pattern", "target")).groupBy("host", "target").agg(best.alias("b"))
    out = targets.join(hit, ["host", "target"], "left").withColumn("allowed", F.coalesce("b.allow", F.lit(True))).drop("b")
    if unread is None:
        return out
    closed = unread.select("host", F.lit(True).alias("_closed")).distinct()
    return out.join(closed, "host", "left").withColumn("allowed", F.col("allowed") & F.col("_closed").isNull()).drop("_closed")


#: Keys of a policy, bounds of its parts, media types it may come as.
RULE_KEYS, DELAY_KEYS, OTHER_KEYS = ("allow", "disallow"), ("crawl-delay", "request-rate"), ("sitemap", "host")
MAX_LINES, MAX_AGENT, MAX_PATTERN = 10_000, 100, 2048
POLICY_TYPES = ("", "text/plain", "application/octet-stream", "binary/octet-stream", "text/x-robots")


def _keyed(lines: DataFrame) -> DataFrame:
    """``(host, line_no, t, key, value)`` of the lines that say something."""
    own = lines.withColumn("t", F.trim(F.split_part("text", F.lit("#"), F.lit(1)))).where(F.col("t") != "")
    return own.select("host", "line_no", "t", F.lower(F.trim(F.substring_index("t", ":", 1))).alias("key"), F.trim(F.regexp_replace("t", r"\A[^:]*:", "")).alias("value"))


def _seconds(key: Column, value: Column) -> Column:
    per = F.try_divide(F.split_part(value, F.lit("/"), F.lit(2)).try_cast("double"), F.split_part(value, F.lit("/"), F.lit(1)).try_cast("double"))
    return F.when(key == "crawl-delay", value.try_cast("double")).when(key == "request-rate", per)


def refused(lines: DataFrame, types: DataFrame | None = None, *, token: str | None = None, longest: float = MAX_DELAY) -> DataFrame:
    """``(host, code)``: policies that are broken anywhere, so that nothing on the host may be read.

    ``lines(host, line_no, text)``; ``types(host, content_type)`` of the replies, if known. With a ``token``, also hosts
    whose groups for it ask for a delay of over ``longest`` seconds."""
    own = _keyed(lines)
    key, value = F.col("key"), F.col("value")
    first = W.partitionBy("host").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    marked = own.withColumn("agents", F.count_if(key == "user-agent").over(first)).withColumn("wait", _seconds(key, value))
    readable = F.contains("t", F.lit(":")) & ~F.col("t").rlike(r"\A[<{]")
    ruled = key.isin(*RULE_KEYS)
    codes = {
        "unreadable_line": ~readable,
        "rule_without_agent": readable & (ruled | key.isin(*DELAY_KEYS)) & (F.col("agents") == 0),
        "bad_agent": readable & (key == "user-agent") & ~F.length(value).between(1, MAX_AGENT),
        "bad_pattern": readable & ruled & (value != "") & ((F.length(value) > MAX_PATTERN) | ~value.rlike(r"\A[/*]")),
        "bad_delay": readable & key.isin(*DELAY_KEYS) & ~F.coalesce((F.col("wait") >= 0) & (F.col("wait") < float("inf")), F.lit(False)),
    }
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(code)) for code, bad in codes.items()]))
    found = marked.select("host", F.explode(broken).alias("code")).distinct()
    silent = own.groupBy("host").agg(F.count_if(readable & key.isin("user-agent", *OTHER_KEYS)).alias("n")).where("n = 0").select("host", F.lit("unrecognised").alias("code"))
    large = lines.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > MAX_LINES).select("host", F.lit("too_large").alias("code"))
    out = found.unionByName(silent).unionByName(large)
    if types is not None:
        out = out.unionByName(types.where(~F.lower(F.trim(F.split_part("content_type", F.lit(";"), F.lit(1)))).isin(*POLICY_TYPES)).select("host", F.lit("media_type").alias("code")))
    if token is not None:
        out = out.unionByName(policy(lines, token).where(F.col("delay") > longest).select("host", F.lit("delay_too_long").alias("code")))
    return out.distinct()


def directives(lines: DataFrame) -> DataFrame:
    """``lines(host, line_no, text)`` to ``(host, line_no, key, value, grp)``: a group opens at a user agent
    that follows a directive, so its number is a running sum."""
    own = _keyed(lines).where(F.contains("t", F.lit(":"))).drop("t").where(F.col("key").isin("user-agent", *RULE_KEYS, *DELAY_KEYS))
    order = W.partitionBy("host").orderBy("line_no")
    opens = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(order), F.lit("")) != "user-agent")
    return own.withColumn("grp", F.sum(opens.cast("int")).over(order)).where("grp > 0")


def policy(lines: DataFrame, token: str) -> DataFrame:
    """``(host, line_no, pattern, allow, delay)`` of the groups that best fit ``token``: rules in line order, the largest delay.

    An agent fits if it is ``*`` (score 0) or a part of the token (its length)."""
    own = directives(lines)
    agent = F.lower("value")
    score = F.when(agent == "*", 0).when(F.contains(F.lit(token.lower()), agent), F.length(agent))
    fits = own.where(F.col("key") == "user-agent").withColumn("score", score).groupBy("host", "grp").agg(F.max("score").alias("score")).where("score is not null")
    best = fits.withColumn("r", F.rank().over(W.partitionBy("host").orderBy(F.desc("score")))).where("r = 1").select("host", "grp")
    chosen = own.join(best, ["host", "grp"])
    wait = _seconds(F.col("key"), F.col("value"))
    delays = chosen.groupBy("host").agg(F.coalesce(F.max(wait), F.lit(0.0)).alias("delay"))
    rules = chosen.where(F.col("key").isin(*RULE_KEYS) & (F.col("value") != "")).select("host", "line_no", F.col("value").alias("pattern"), (F.col("key") == "allow").alias("allow"))
    return delays.join(rules, "host", "left").select("host", "line_no", "pattern", "allow", "delay")
