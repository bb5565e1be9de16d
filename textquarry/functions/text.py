"""Text predicates and normalisers as Column expressions.

White space is Python's notion of it (``str.isspace``), spelled out as one class, because Spark's ``trim`` knows only the space and
Java's ``\\s`` only ASCII. Null texts count as empty unless a function says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WS_CHARS = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS, NOT_WS = f"[{WS_CHARS}]", f"[^{WS_CHARS}]"

# They must be these for results to agree with existing data sets.
EMPTY_LITERALS = ("nan", "<na>", "none", "nat")
TECHNICAL_STOPWORDS = ("br", "nbsp", "amp", "quot", "lt", "gt", "ndash", "mdash", "hellip", "laquo", "raquo", "apos")
META_PREFIXES = (
    "вот вариант",
    "вот безопасная версия",
    "переписанный запрос",
    "безопасная версия",
    "возможный вариант",
    "итоговый запрос",
    "русский borderline",
    "вариант 1",
    "вариант 2",
    "вариант 3",
)
QUERY_HINTS = (
    "как",
    "что",
    "почему",
    "зачем",
    "можно",
    "нужно",
    "стоит",
    "подскажи",
    "объясни",
    "расскажи",
    "покажи",
    "помоги",
    "переведи",
    "сравни",
    "разбери",
    "приведи",
    "хочу",
    "нужен",
    "интересует",
)
DICTIONARY_HINTS = ("значение слова", "значение выражения", "словарная статья", "словарное значение", "термин", "определение", "идиома", "фразеологизм")
BULLET = r"(?m)^\s*(?:[-*]|\d+[.)])\s+"
NUMBERED_ANSWER = r"(?i)(?:вариант\s*\d+|option\s*\d+)"
WIKI_NAMESPACES = ("category", "категория", "file", "файл", "image", "приложение", "special", "участник", "media")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(df, **columns: Column):
    """Adds columns that later expressions read many times. They are made in a generator (of one row), through which the optimizer neither pushes a
    filter nor copies an expression into each of its uses."""
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.explode(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))).alias("_once")).select(*kept, "_once.*")


def text_of(c: Column | str) -> Column:
    return F.coalesce(_c(c).cast("string"), F.lit(""))


def strip(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), rf"\A{WS}+|{WS}+\z", "")


def is_blank(c: Column | str) -> Column:
    """Null, or nothing but white space."""
    return strip(text_of(c)) == ""


def char_length(c: Column | str) -> Column:
    return F.length(text_of(c)).cast("bigint")


def word_count(c: Column | str) -> Column:
    return F.regexp_count(text_of(c), F.lit(f"{NOT_WS}+")).cast("bigint")


def collapse(c: Column | str, limit: int | None = None) -> Column:
    """Words joined by single spaces, optionally the first ``limit`` characters."""
    out = strip(F.regexp_replace(text_of(c), f"{WS}+", " "))
    return out if limit is None else F.substring(out, 1, limit)


def uid(*parts: Column | str) -> Column:
    """First 16 hex digits of the SHA-256 of the parts joined by ``|``; nulls count as empty."""
    return F.substring(F.sha2(F.concat_ws("|", *(text_of(p) for p in parts)), 256), 1, 16)


def dedup_key(c: Column | str) -> Column:
    """What two outputs are compared by: stripped, lower case, runs of white space as one space, 8,000 characters."""
    return F.substring(F.regexp_replace(F.lower(strip(text_of(c))), f"{WS}+", " "), 1, 8000)


def contains_any(c: Column, terms) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(t) for t in terms), F.lit(False))


def count_terms(c: Column, terms) -> Column:
    """How many of the terms occur (each once)."""
    return reduce(lambda a, b: a + b, (c.contains(t).cast("int") for t in terms), F.lit(0))


def without_literal_null(c: Column | str) -> Column:
    t = text_of(c)
    return F.when(F.lower(t).isin(*EMPTY_LITERALS), "").otherwise(t)


#: Entities that text statistics meet; a JVM-side replacement in this order (``&amp;`` last).
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&laquo;", "«"), ("&raquo;", "»"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def cleaned_for_words(c: Column | str) -> Column:
    """Lower case; entities decoded; tags, links and digits removed; single spaces."""
    t = F.lower(without_literal_null(c))
    for entity, char in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(char))
    for pattern in (r"<[^>]+>", rf"(?:https?://|www\.){NOT_WS}+", r"\p{Nd}+"):
        t = F.regexp_replace(t, pattern, " ")
    return collapse(t)


def letter_runs(c: Column | str) -> Column:
    return F.regexp_extract_all(cleaned_for_words(c), F.lit("([A-Za-zА-Яа-яЁё]+)"), F.lit(1))


def without_artifacts(c: Column | str) -> Column:
    """Strips one pair of quotes and leading announcements ("вот вариант: ...") off a generated text."""
    t = strip(text_of(c))
    quoted = (F.length(t) >= 2) & ((t.startswith('"') & t.endswith('"')) | (t.startswith("«") & t.endswith("»")))
    t = F.when(quoted, strip(F.substring(t, F.lit(2), F.length(t) - 2))).otherwise(t)
    separator = r"^(?::| - |\n)"

    def cut(acc: Column, prefix: Column) -> Column:
        rest = F.substring(acc, F.length(prefix) + 1, F.length(acc))
        return F.when(F.startswith(F.lower(acc), prefix) & rest.rlike(separator), strip(F.regexp_replace(rest, separator, ""))).otherwise(acc)

    return F.aggregate(F.array(*[F.lit(p) for p in META_PREFIXES]), t, cut)


def first_word(c: Column) -> Column:
    return F.regexp_extract(c, f"({NOT_WS}+)", 1)


def looks_like_query(c: Column | str) -> Column:
    low = F.lower(strip(text_of(c)))
    padded = F.concat(F.lit(" "), low, F.lit(" "))
    return (low != "") & (low.contains("?") | first_word(low).isin(*QUERY_HINTS) | contains_any(padded, [f" {h} " for h in QUERY_HINTS]))


def looks_like_dictionary(c: Column | str) -> Column:
    low = F.lower(strip(text_of(c)))
    hinted = reduce(lambda a, b: a | b, (low.startswith(h) for h in DICTIONARY_HINTS))
    defines = (low.contains("— это") | low.startswith("это ")) & ~low.contains("?") & ~looks_like_query(c)
    return (low != "") & (hinted | defines)


def looks_like_several(c: Column | str, separator: str = "---") -> Column:
    t = text_of(c)
    split = t.contains(separator) if separator else F.lit(False)
    return split | t.rlike(BULLET) | (t.rlike(NUMBERED_ANSWER) & t.contains("\n"))


def without_wiki_markup(c: Column | str) -> Column:
    t = text_of(c)
    for pattern, to in ((r"\[\[([^|\]]+)\|([^\]]+)\]\]", "$2"), (r"\[\[([^\]]+)\]\]", "$1"), (r"\{\{[^\}]+\}\}", ""), (r"<[^>]+>", ""), (r"''+", "")):
        t = F.regexp_replace(t, pattern, to)
    return strip(t)


def default_source_name(url: Column | str, fallback: str) -> Column:
    """``host:port::last path segment`` of a URL, else the fallback."""
    u = text_of(url)
    host = F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/?([^?#]*)", 1)
    last = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    return F.when(host == "", F.lit(fallback)).when(last == "", host).otherwise(F.concat_ws("::", host, last))
