"""Text functions as columns; all are built-in expressions, so they stay in the JVM.

Lower-casing is ASCII only. Arguments are columns (or column names).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tokens of this many characters or more aren't indexed.
LONG_TOKEN = 80

# Irregular plurals, words that are the same in the plural, and
# the ordered rules (ending, characters cut, added) for the rest.
IRREGULAR = {
    "analyses": "analysis", "axes": "axis", "children": "child", "feet": "foot", "geese": "goose", "indices": "index", "matrices": "matrix",
    "men": "man", "mice": "mouse", "people": "person", "teeth": "tooth", "vertices": "vertex", "women": "woman",
}
UNCOUNTABLE = ("data", "news", "series", "species")
UNCHANGED_ENDING = "(ss|us|is)$"
PLURAL_RULES = (("ies$", 3, "y"), ("(x|ch|sh|ss|z)es$", 2, ""), ("s$", 1, ""))

# Synonyms of the hash embedding.
EMBEDDING_ALIASES = {"calc": "calculate", "taxes": "tax", "compute": "calculate", "sum": "total", "klass": "class", "func": "function"}

REASON_LENGTH = 120


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c: Column | str) -> Column:
    return F.translate(col(c), UPPER, LOWER)


def lines(c: Column | str) -> Column:
    """Lines without their ends; a final line end begins no further line."""
    every = F.transform(F.split(col(c), "\n", -1), lambda x: F.regexp_replace(x, "\r$", ""))
    return F.when(F.element_at(every, -1) == "", F.slice(every, 1, F.size(every) - 1)).otherwise(every)


def runs_of(c: Column, pattern: str) -> Column:
    """All matches in order. Splitting at the complement is equal but takes 25 times as long: Java matches negated classes slowly."""
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def segments(c: Column | str) -> Column:
    """Lower-cased parts of identifiers: cut at other characters, at case changes and between letters and digits."""
    spaced = col(c)
    for pattern in ("([a-z])([A-Z])", "([A-Za-z])([0-9])", "([0-9])([A-Za-z])"):
        spaced = F.regexp_replace(spaced, pattern, "$1 $2")
    return runs_of(ascii_lower(spaced), "[a-z0-9]+")


def tokens(c: Column | str) -> Column:
    """Index tokens in order; a token's position is its place in the array."""
    return F.filter(segments(c), lambda x: F.length(x) < LONG_TOKEN)


def singular(c: Column | str) -> Column:
    """Singular of a lower-case English word by rule; short and mixed tokens are unchanged.

    Most words are settled by the first test, which needs no regular expression.
    """
    t = col(c)
    table = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])
    out = F.when(~F.endswith(t, F.lit("s")) & ~t.isin(*IRREGULAR), t).when((F.length(t) <= 3) | t.rlike("[^a-z]") | t.isin(*UNCOUNTABLE), t)
    out = out.when(t.isin(*IRREGULAR), F.element_at(table, t)).when(t.rlike(UNCHANGED_ENDING), t)
    for ending, cut, added in PLURAL_RULES:
        out = out.when(t.rlike(ending), F.concat(t.substr(F.lit(1), F.length(t) - cut), F.lit(added)))
    return out.otherwise(t)


def compact(c: Column | str) -> Column:
    """ASCII letters and digits only, lower-cased."""
    return ascii_lower(F.array_join(raw_words(c), ""))


def variants(token: Column) -> Column:
    """A raw word's forms for embedding: the whole in lower case and its parts, sorted."""
    parts = F.array_sort(F.array_distinct(F.concat(F.array(ascii_lower(token)), segments(token))))
    # capitals, then small letters, or digits alone: there is nothing to cut
    return F.when(token.rlike("^([A-Z]*[a-z]*|[0-9]+)$"), F.array(ascii_lower(token))).otherwise(parts)


def embedding_alias(one: Column) -> Column:
    """The synonym of a form, or the form itself."""
    table = F.create_map(*[F.lit(x) for pair in EMBEDDING_ALIASES.items() for x in pair])
    return F.when(one.isin(*EMBEDDING_ALIASES), F.element_at(table, one)).otherwise(one)


def raw_words(c: Column | str) -> Column:
    """Runs of ASCII letters and digits."""
    return runs_of(col(c), "[A-Za-z0-9]+")


def preview_line(c: Column | str) -> Column:
    """First line that is neither blank nor a // comment, trimmed; empty if there is none."""
    kept = F.filter(lines(c), lambda x: (F.trim(x) != "") & ~F.startswith(F.trim(x), F.lit("//")))
    return F.coalesce(F.trim(F.get(kept, F.lit(0))), F.lit(""))


def signature_line(c: Column | str) -> Column:
    """First line that is neither blank nor a // or # comment; empty if there is none."""
    kept = F.filter(lines(c), lambda x: (F.trim(x) != "") & ~F.trim(x).rlike("^(//|#)"))
    return F.coalesce(F.get(kept, F.lit(0)), F.lit(""))


def truncated(c: Column) -> Column:
    """At most REASON_LENGTH characters, then three dots."""
    return F.when(F.length(c) > REASON_LENGTH, F.concat(F.substring(c, 1, REASON_LENGTH), F.lit("..."))).otherwise(c)


def md5_number(c: Column) -> Column:
    """The first eight hex digits of a string's MD5 as a number."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint")
