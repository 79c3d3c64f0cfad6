"""Text functions as column expressions: all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that queries don't search for. Fixed values. (Forms that a term can't take, such
#: as those with an apostrophe, are left out.)
STOPWORDS = """
a an and are as at be been being but by can code could did do does
doing done for from get gets given handle handles has have having
how in into is it its like make makes of on or over per put return
returns should so some such take takes than that the their them then
there these they this those to use used uses using was were what
when where which while who why will with would
find locate search identify show wheres helper helpers
function functions method methods class classes reusable existing
logic implementation implementations piece part area thing
""".split()

TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
TERM = r"[A-Za-z][A-Za-z0-9_]{2,}"


def stripped(text: Column) -> Column:
    """Without surrounding white space of any script."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores, or single other characters; empty for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def token_hashes(tok: Column) -> Column:
    return F.transform(tok, lambda t: F.xxhash64(t))


def windows(hashes: Column, width: int = 5) -> Column:
    """All windows of ``width`` successive tokens as 64-bit hashes, of the tokens' own
    (``token_hashes``, as a column of its own: it is read for every window); empty below
    ``width``."""
    sequence = F.sequence(F.lit(0), F.size(hashes) - width)
    hashed = F.transform(sequence, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))
    return F.when(F.size(hashes) >= width, hashed).otherwise(F.array().cast("array<bigint>"))


def query_terms(text: Column) -> Column:
    """Distinct lower-case terms of three characters or more without stopwords, in order."""
    found = F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower)
    return F.array_distinct(F.filter(found, lambda t: ~F.array_contains(F.array(*[F.lit(w) for w in STOPWORDS]), t)))


def body_terms(text: Column) -> Column:
    """Distinct lower-case terms in order, joined by blanks."""
    return F.array_join(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower)), " ")


def term_coverage(terms: Column, hay: Column) -> Column:
    """Percent of terms that are substrings of ``hay``; 0 without terms."""
    n = F.size(terms)
    hit = F.size(F.filter(terms, lambda t: F.contains(hay, t)))
    return F.when(n > 0, F.lit(100.0) * hit / n).otherwise(F.lit(0.0))


def route_pattern(url: Column) -> Column:
    """A route's shape: cut at ? or #, ${...} and {...} become {}, an open brace cuts the
    rest, no trailing slash but for the root."""
    bare = F.regexp_replace(F.regexp_replace(url, r"(?s)[?#].*$", ""), r"\$?\{[^}]*\}", "{}")
    cut = F.regexp_replace(bare, r"(?s)\$?\{[^}]*$", "")
    return F.when(F.length(cut) > 1, F.regexp_replace(cut, r"/+$", "")).otherwise(cut)


def join_route(prefix: Column, route: Column) -> Column:
    """Prefix and route with one slash between and none at the end; the root is a slash."""
    joined = F.concat(F.regexp_replace(F.coalesce(prefix, F.lit("")), r"/+$", ""), F.lit("/"), F.regexp_replace(F.coalesce(route, F.lit("")), r"^/+", ""))
    bare = F.regexp_replace(joined, r"/+$", "")
    return F.when(bare == "", "/").otherwise(bare)


def unit_module_key(path: Column) -> Column:
    """Module of a path as unit ids have it: source roots and __init__ stay."""
    return F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), "/", ".")


def edge_module_key(path: Column) -> Column:
    """Module of a path as imports see it: without a leading src/ and a trailing __init__."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"^src/", ""), r"\.py$", ""), r"/__init__$", ""), "/", ".")


def is_test_path(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return name.rlike(r"^test_.*\.py$") | name.rlike(r"_test\.py$")


def short_hash(text: Column, digits: int = 12) -> Column:
    return F.left(F.sha2(text, 256), F.lit(digits))


def purpose_of(doc: Column, name: Column) -> Column:
    """First line of the documentation, at most 240 characters, else the spaced name."""
    first = F.substring(stripped(F.substring_index(stripped(doc), "\n", 1)), 1, 240)
    return F.when(F.coalesce(first, F.lit("")) != "", first).otherwise(F.replace(name, F.lit("_"), F.lit(" ")))


def collapsed(text: Column, most: int = 4000) -> Column:
    return F.substring(stripped(F.regexp_replace(text, r"\s+", " ")), 1, most)
