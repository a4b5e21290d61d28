"""Text functions: white space, entities, readability, ranking, excerpts.

Java's ``\\w`` and ``\\s`` are ASCII unless ``(?U)`` asks for Unicode, so the
patterns here do. All are built-in expressions but ``casefold``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Legal suffixes that do not tell companies apart.
LEGAL_SUFFIXES = ("inc", "incorporated", "ltd", "limited", "llc", "corp", "corporation", "plc")
#: Phrases of pages that want a browser or an account.
BARRIERS = (
    "enable javascript",
    "javascript is required",
    "checking your browser",
    "verify you are human",
    "access denied",
    "sign in to continue",
    "log in to continue",
    "just a moment",
)
#: Words of substance in a company's pages.
SUBSTANCE = (
    "provide provides product products service services solution solutions customer customers workflow review strategy "
    "investment revenue financial security governance chief ceo cto cio cfo ciso announced said published"
).split()


def clean_text(text: Column) -> Column:
    """White space runs to one space, NUL characters out, ends trimmed."""
    return F.trim(F.regexp_replace(F.replace(text, F.char(F.lit(0)), F.lit("")), r"(?U)\s+", " "))


@F.pandas_udf(T.StringType())
def casefold(text: pd.Series) -> pd.Series:
    return text.str.casefold()


#: Characters whose full case folding is not their lower case: to one character, and to several.
_ONE, _MANY = ({c: f for c in map(chr, range(0x1F000)) if (f := c.lower().casefold()) != c.lower() and (len(f) > 1) is more} for more in (False, True))


def fold(text: Column) -> Column:
    """Full case folding in built-in expressions. Only texts with a character that folds to several take the longer way."""
    plain = F.translate(F.lower(text), "".join(c.lower() for c in _ONE), "".join(_ONE.values()))
    whole = plain
    for c in sorted({c.lower() for c in _MANY}):
        whole = F.replace(whole, F.lit(c), F.lit(c.casefold()))
    return F.when(F.regexp_like(F.lower(text), F.lit(f"[{''.join(sorted({c.lower() for c in _MANY if len(c.lower()) == 1}))}]")), whole).otherwise(plain)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)(\w+)"), F.lit(1))


def entity_words(name: Column) -> Column:
    """Folded words of a name less trailing legal suffixes, joined by spaces."""
    suffix = "|".join(LEGAL_SUFFIXES)
    return F.trim(F.regexp_replace(F.array_join(words(fold(name)), " "), rf"(?:(?:^|\s)(?:{suffix}))+\z", ""))


def entity_key(name: Column) -> Column:
    return F.replace(entity_words(name), F.lit(" "), F.lit(""))


def entity_in_text(name: Column, text: Column) -> Column:
    """Whether the words of ``name`` stand in ``text`` in order, with anything but words between; false for no words."""
    own = entity_words(name)
    pattern = F.concat(F.lit(r"(?iU)\b\Q"), F.replace(own, F.lit(" "), F.lit(r"\E\W+\Q")), F.lit(r"\E\b"))
    return F.coalesce((own != "") & F.regexp_like(text, pattern), F.lit(False))


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]", ""))


def readable(text: Column, *, least: int = 40, short: int = 500, barriers: tuple[str, ...] = BARRIERS) -> Column:
    """Enough characters and letters, and no short page behind a barrier."""
    low = F.lower(text)
    barred = F.lit(False)
    for phrase in barriers:
        barred = barred | F.contains(low, F.lit(phrase))
    return F.coalesce((F.length(text) >= least) & (letters(text) >= least // 2) & ~((F.length(text) < short) & barred), F.lit(False))


def substance(text: Column, lexicon: list[str] | tuple[str, ...] = SUBSTANCE, *, most: int = 12) -> Column:
    # ``least`` passes over nulls, so a text that is not there must count 0 before.
    return F.least(F.lit(most), F.coalesce(F.regexp_count(text, F.lit(rf"(?iU)\b(?:{'|'.join(lexicon)})\b")), F.lit(0)))


def span_rank(text: Column, section: Column | None = None, *, company: Column | None = None, lexicon: list[str] | tuple[str, ...] = SUBSTANCE) -> Column:
    """Substance of a span, more if it names the company or its section has substance."""
    score = substance(text, lexicon)
    if company is not None:
        score = score + F.when(entity_in_text(company, text), 12).otherwise(0)
    if section is not None:
        score = score + F.when(F.coalesce(substance(section, lexicon), F.lit(0)) > 0, 3).otherwise(0)
    return score


def excerpt(text: Column, quote: Column, *, around: int = 120) -> Column:
    """The first place of ``quote`` with its surroundings, null if it is not there."""
    at = F.instr(text, quote)
    start = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at + F.length(quote) + around - start))


def first_text(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def note(*sentences: Column, most: int = 600) -> Column:
    """Sentences that are not null in one note, null if there are none."""
    return F.nullif(F.left(F.array_join(F.array_compact(F.array(*sentences)), " "), F.lit(most)), F.lit(""))


def stage_name(name: Column) -> Column:
    return F.when(F.regexp_like(name, F.lit(r"\A[a-z][a-z0-9_]{0,63}\z")), name).otherwise("unknown")


def vendor_key(name: Column) -> Column:
    return fold(F.regexp_replace(F.trim(name), r"[\s_-]+", ""))


def talk_line(text: Column) -> Column:
    return fold(clean_text(text))


def placeholder(value: Column) -> Column:
    """Whether a secret is only a stand-in for one."""
    v = F.lower(F.trim(value))
    return v.isin("", "changeme", "change-me", "example", "placeholder", "secret", "todo", "xxx") | F.regexp_like(v, F.lit(r"\A(?:your|<|\$\{|replace)[\s\S]*"))


def email_allowed(email: Column, rules: list[str]) -> Column:
    """Whole-address match with ``*`` for anything, in any case; no rules let all pass."""
    if not rules:
        return F.lit(True)
    hit = F.lit(False)
    for rule in rules:
        pattern = r"(?is)\A" + r"[\s\S]*".join(rf"\Q{part}\E" if part else "" for part in rule.strip().split("*")) + r"\z"
        hit = hit | F.regexp_like(F.trim(email), F.lit(pattern))
    return F.coalesce(hit, F.lit(False))


def utf16_bytes(*columns: Column) -> Column:
    """Bytes that a browser's store counts for these strings."""
    return sum((F.octet_length(F.encode(c, "UTF-16BE")) for c in columns), F.lit(0))
