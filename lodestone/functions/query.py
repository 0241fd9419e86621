"""What is made of a query string: tokens, synonyms, variants and intent, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_lower, col, compact, runs_of, segments, singular

# Words that a query's tokens leave out, after they are made singular.
STOPWORDS = (
    "a an and are as at be been being by can could did do does done file files find for from how i in into is it locate located me of on "
    "please show the their there these this those to was were what where which who why with within code"
).split()
# Further tokens for a token.
TOKEN_ALIASES = {
    "implemented": ("implement",), "implementing": ("implement",), "implementation": ("implement",), "implements": ("implement",),
    "defined": ("define",), "defining": ("define",), "definition": ("define",), "definitions": ("define",), "declared": ("define",), "declaration": ("define",),
    "ranked": ("rank",), "ranking": ("rank",), "results": ("result",), "chunking": ("chunk",), "flags": ("cli", "arg", "option"), "flag": ("cli", "arg", "option"),
    "arguments": ("cli", "flag", "option"), "argument": ("cli", "flag", "option"), "args": ("cli", "flag", "option"), "arg": ("cli", "flag", "option"),
    "command": ("cli",), "parsing": ("parse", "parser"), "matching": ("match", "matcher"), "detection": ("detect", "detector"),
    "detected": ("detect", "detector"), "detecting": ("detect", "detector"), "counting": ("count", "counter"), "counts": ("count", "counter"),
    "output": ("print", "printer"), "colored": ("color",), "coloring": ("color",), "walker": ("walk",),
}
# Further tokens for two tokens that occur together.
PHRASE_ALIASES = (("command", "line", "cli"), ("output", "format", "printer"), ("result", "output", "printer"), ("line", "number", "line_number"))
# Words that ask for a place.
LOCATION_WORDS = "where find locate located implemented implementation defined definition done".split()


def _words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def tokens(query: Column | str) -> Column:
    """Singular parts of the words, two characters at least, without stop words, each once, in order."""
    # by word first: a letter and a digit on either side of a blank aren't one identifier
    parts = F.transform(segments(query), singular)
    return F.array_distinct(F.filter(parts, lambda t: (F.length(t) >= 2) & ~t.isin(*STOPWORDS)))


def expanded(primary: Column) -> Column:
    """The tokens, then the further ones of each, then those of pairs; each once."""
    table = F.create_map(*[x for k, v in TOKEN_ALIASES.items() for x in (F.lit(k), _words(v))])
    none = F.array().cast("array<string>")
    more = F.flatten(F.transform(primary, lambda t: F.coalesce(F.get(F.array(table[t]), F.lit(0)), none)))
    pairs = [F.when(F.array_contains(primary, a) & F.array_contains(primary, b), F.array(F.lit(c))).otherwise(none) for a, b, c in PHRASE_ALIASES]
    return F.array_distinct(F.concat(primary, more, *pairs))


def variants(query: Column | str, primary: Column, expanded_tokens: Column) -> Column:
    """Strings that are searched for: the query itself, its tokens joined by blanks, nothing, _ and camel case, and the further tokens; sorted."""
    q = F.trim(col(query))
    none = F.array().cast("array<string>")
    low, n = ascii_lower(q), F.size(primary)
    spaced, joined = F.array_join(primary, " "), F.array_join(primary, "")
    camel = F.concat(F.get(primary, F.lit(0)), F.array_join(F.transform(F.slice(primary, 2, F.greatest(n, F.lit(1))), lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1000000))), ""))
    one = lambda test, value: F.when(test, F.array(value)).otherwise(none)
    every = F.concat(
        F.array(q), one((n > 0) & (spaced != low), spaced), one((n > 0) & (F.length(joined) >= 4) & (joined != low), joined),
        one(n >= 2, F.array_join(primary, "_")), one(n >= 2, camel), F.array_except(expanded_tokens, primary),
    )
    return F.when(q == "", none).otherwise(F.array_sort(F.array_distinct(every)))


def location_intent(query: Column | str) -> Column:
    """Whether a word of the query asks for a place."""
    return F.arrays_overlap(runs_of(ascii_lower(query), "[a-z0-9]+"), _words(LOCATION_WORDS))


def prepared(queries, query: str = "query"):
    """Add tokens, expanded, variants, intent, low (the lower-cased query) and compact to a table of queries."""
    out = queries.withColumn("tokens", tokens(query))
    out = out.withColumn("expanded", expanded(F.col("tokens")))
    return (
        out.withColumn("variants", variants(query, F.col("tokens"), F.col("expanded")))
        .withColumn("intent", location_intent(query))
        .withColumn("low", ascii_lower(F.trim(F.col(query))))
        .withColumn("compact", compact(F.trim(F.col(query))))
    )
