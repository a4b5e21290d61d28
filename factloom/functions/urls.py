"""URLs and hosts: normal form, approval, purpose, addresses.

``normalize_url`` and ``is_public_address`` are Arrow functions; all policy on
top of them is built-in expressions and joins.
"""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from urllib.parse import quote, urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_URL = 2048
#: Names that never lead to the public internet.
LOCAL_SUFFIXES = ("localhost", "local", "localdomain", "internal", "intranet", "lan", "corp", "home", "arpa", "onion", "test", "invalid", "example")
#: Fixed value: a cloud's metadata service.
METADATA_ADDRESS = "168.63.129.16"
#: Hosts of personal profiles.
SOCIAL_HOSTS = ("linkedin.com", "facebook.com", "instagram.com", "twitter.com", "x.com", "tiktok.com")
#: Path segments of account pages.
PRIVATE_PATH = r"(?i)(?:^|/)(?:log-?in|sign-?in|sign-?up|oauth|auth|account|accounts|profile|profiles|personal)(?:/|\z)"
#: Purposes in the order in which they are tried.
PURPOSES = (
    ("investors", r"(?i)(?:investor|annual[-_ ]?report|financial[-_ ]?report)"),
    ("about", r"(?i)(?:about|who-we-are|our-company|company/overview)"),
    ("products", r"(?i)(?:products?|services?|solutions?)"),
    ("trust", r"(?i)(?:trust|security|compliance|responsible-ai)"),
)
#: A small public-suffix table ``(rule, private)`` with wildcards and exceptions; replace it by a full one where there is one.
SUFFIXES = [(s, False) for s in "com net org info biz io co de fr es uk co.uk org.uk ac.uk jp co.jp com.au com.br eu ch at nl it se *.ck !www.ck *.kawasaki.jp !city.kawasaki.jp".split()] + [(s, True) for s in ("github.io", "blogspot.com", "herokuapp.com", "appspot.com", "*.compute.amazonaws.com")]

#: Characters that a path and a query keep as they are.
PATH_SAFE, QUERY_SAFE = "/:@!$&'()*+,;=-._~%", "/?:@!$&'()*+,;=-._~%"
#: Address blocks that are global by register, but not hosts of the public web.
REFUSED_BLOCKS = tuple(map(ipaddress.ip_network, ("224.0.0.0/4", f"{METADATA_ADDRESS}/32", "2001::/32", "2002::/16")))
#: Fixed value: where IPv6 addresses of hosts are.
UNICAST = ipaddress.ip_network("2000::/3")

_URL = re.compile(r"(?P<scheme>[A-Za-z][A-Za-z0-9+.-]*)://(?P<host>\[[^\[\]]*\]|[^\[\]:/?#@]*)(?::(?P<port>[0-9]+))?(?P<path>/[^?#]*)?(?P<query>\?[^#]*)?(?:#.*)?")
_LABEL = r"(?!-)[a-z0-9-]{1,63}(?<!-)"
#: What no URL may hold: blanks and control characters, a backslash plain or escaped, a broken escape, an escaped control character.
_REFUSED = (re.compile(r"[\s\\]"), re.compile(r"%(?![0-9A-Fa-f]{2})"), re.compile(r"(?i)%(?:[01][0-9A-F]|5C|7F)"))


def _address(value: str):
    try:
        return ipaddress.ip_address(value)
    except ValueError:
        return None


def public_address(value: str) -> bool:
    """A global unicast address, without zone, that no tunnel or mapping hides another in."""
    own = _address(value)
    if own is None or "%" in value or not own.is_global or own.version == 6 and own not in UNICAST:
        return False
    return not any(own in block for block in REFUSED_BLOCKS if block.version == own.version)


#: Two labels or more, the last not a number, 253 characters in all.
_NAME = re.compile(rf"(?=.{{1,253}}\Z)(?:{_LABEL}\.)+(?![0-9]+\Z){_LABEL}")
_LOCAL = tuple(f".{s}" for s in LOCAL_SUFFIXES)


def ascii_name(name: str) -> str:
    """A host name as it is on the wire; empty if it has no such form."""
    try:
        return name if name.isascii() else name.encode("idna").decode("ascii").lower()
    except UnicodeError:
        return ""


def host_name(host: str) -> str | None:
    """The normal form of a public host name or address, or null."""
    name = host.lower().removesuffix(".")
    address = _address(name)
    if address is None:
        wire = ascii_name(name)
        return wire if _NAME.fullmatch(wire) and not f".{wire}".endswith(_LOCAL) else None
    return address.compressed if public_address(name) else None


def remove_dots(path: str) -> str:
    """Without ``.`` and ``..`` segments, as RFC 3986 says."""
    kept: list[str] = []
    *inner, last = path.split("/")[1:]
    for part in [*inner, last]:
        if part == "..":
            kept = kept[:-1]
        elif part != ".":
            kept.append(part)
    return "/" + "/".join([*kept, ""] if last in (".", "..") and kept else kept)


def normal_url(value: str | None) -> str | None:
    """The normal form of a public HTTPS URL, or null. Twice is as once."""
    if not value or len(value) > MAX_URL or any(p.search(value) for p in _REFUSED) or any(unicodedata.category(c).startswith("C") for c in value):
        return None
    m = _URL.fullmatch(value)
    if m is None or m["scheme"].lower() != "https" or int(m["port"] or 443) != 443:
        return None
    bracketed = m["host"].startswith("[")
    host = host_name(m["host"].strip("[]") if bracketed else m["host"])
    if host is None or bracketed != (":" in host):
        return None
    out = f"https://[{host}]" if bracketed else f"https://{host}"
    out += remove_dots(quote(m["path"] or "/", safe=PATH_SAFE)) + quote(m["query"] or "", safe=QUERY_SAFE)
    return out if len(out) <= MAX_URL else None


def resolved(base: str, link: str) -> str | None:
    try:
        return normal_url(urljoin(base, link))
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def normalize_url(url: pd.Series) -> pd.Series:
    return url.map(normal_url)


@F.pandas_udf(T.StringType())
def normalize_host(host: pd.Series) -> pd.Series:
    return host.map(lambda h: h and host_name(h))


@F.pandas_udf(T.BooleanType())
def is_public_address(address: pd.Series) -> pd.Series:
    return address.map(lambda a: bool(a) and public_address(a))


def url_host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def url_path(url: Column) -> Column:
    """The path, percent-decoded; ``+`` is no space in a path."""
    return F.try_url_decode(F.replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("+"), F.lit("%2B")))


def host_is(host: Column, names: tuple[str, ...]) -> Column:
    """One of these hosts or under one."""
    hit = F.lit(False)
    for name in names:
        hit = hit | (host == name) | F.endswith(host, F.lit(f".{name}"))
    return hit


def link_allowed(url: Column) -> Column:
    """No social host, no account page; ``url`` in normal form, on an approved host."""
    return ~host_is(url_host(url), SOCIAL_HOSTS) & ~F.regexp_like(F.coalesce(url_path(url), F.lit("")), F.lit(PRIVATE_PATH))


def link_purpose(url: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PURPOSES):
        out = F.when(F.regexp_like(F.coalesce(url_path(url), F.lit("")), F.lit(pattern)), name).otherwise(out)
    return out


def approved(links: DataFrame, hosts: DataFrame, *, url: str = "url") -> DataFrame:
    """``links`` whose host is exactly one of ``hosts(host)``."""
    return links.join(hosts.select(F.col("host").alias("_host")).distinct(), url_host(F.col(url)) == F.col("_host"), "left_semi")


def www_pairs(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """``(host, counterpart)``: apex and www of exactly a registrable domain under a public suffix that is not private.

    ``suffixes(suffix, private)`` are rules: a name, ``*.name`` for any label before it, ``!name`` for an exception.
    Each rule is looked up by its name among the tails of the host; an exception wins, else the longest suffix."""
    rule = F.col("suffix")
    shift = F.when(F.startswith(rule, F.lit("*.")), -1).when(F.startswith(rule, F.lit("!")), 1).otherwise(0)
    rules = suffixes.select(F.regexp_replace(rule, r"\A(?:\*\.|!)", "").alias("tail"), shift.alias("shift"), "private")
    tails = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda k: F.struct(k.alias("k"), F.array_join(F.slice("labels", k, F.lit(256)), ".").alias("tail")))
    each = hosts.select("host").distinct().withColumn("labels", F.split("host", r"\.")).where(F.size("labels") >= 2).select("host", "labels", F.explode(tails).alias("t"))
    own = each.select("host", "labels", "t.k", "t.tail").join(rules, "tail").withColumn("k", F.col("k") + F.col("shift")).where("k >= 1")
    best = own.groupBy("host", "labels").agg(F.min_by(F.struct("private", "k"), F.struct((F.col("shift") != 1).alias("a"), "k")).alias("b")).where(~F.col("b.private") & (F.col("b.k") >= 2))
    out = best.withColumn("domain", F.array_join(F.slice("labels", F.col("b.k") - 1, F.lit(256)), ".")).where(~F.startswith("domain", F.lit("www.")))
    other = F.when(F.col("host") == F.col("domain"), F.concat(F.lit("www."), F.col("domain"))).when(F.col("host") == F.concat(F.lit("www."), F.col("domain")), F.col("domain"))
    return out.select("host", other.alias("counterpart")).where("counterpart is not null")


def local_path(candidate: Column, default: str = "/") -> Column:
    """A redirect target on this site, else the default."""
    fine = F.startswith(candidate, F.lit("/")) & ~F.startswith(candidate, F.lit("//")) & ~F.contains(candidate, F.lit("\\")) & ~F.regexp_like(candidate, F.lit(r"[\x00-\x1f\x7f]"))
    return F.when(F.coalesce(fine, F.lit(False)), candidate).otherwise(default)


def search_query(hosts: Column, company: Column, since: Column) -> Column:
    """One query for each approved host, hosts in order."""
    return F.transform(F.array_sort(hosts), lambda h: F.format_string('site:%s "%s" after:%s', h, company, since.cast("string")))
