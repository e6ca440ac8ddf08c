"""Text matching: folding, LIKE patterns, ordered tokens, paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The letters that folding replaces, and what by.
ACCENTED = "áàäâãåéèëêíìïîóòöôõúùüûñç"
PLAIN = "aaaaaaeeeeiiiiooooouuuunc"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Unicode white space for Java's regular expressions.
SPACE = r"\p{IsWhite_Space}"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def folded(c: Column) -> Column:
    """Trimmed, in lower case, without the accents of a fixed list."""
    return F.translate(F.lower(trimmed(c)), ACCENTED, PLAIN)


def ascii_lower(c: Column) -> Column:
    """Lower case of A-Z alone, as in a collation that ignores ASCII case."""
    return F.translate(c, UPPER, LOWER)


def fold(s: str) -> str:
    """folded() of a parameter."""
    return s.strip().lower().translate(str.maketrans(ACCENTED, PLAIN))


def like_pattern(query: str) -> str | None:
    """A LIKE pattern, escaped by a backslash, whose spaces match anything; None for a blank query."""
    q = fold(query)
    return "%" + re.sub(r"([\\%_])", r"\\\1", q).replace(" ", "%") + "%" if q else None


def like_pattern_column(c: Column) -> Column:
    q = folded(c)
    return F.when(q != "", F.concat(F.lit("%"), F.replace(F.regexp_replace(q, r"([\\%_])", r"\\$1"), F.lit(" "), F.lit("%")), F.lit("%")))


def like(c: Column, pattern: str) -> Column:
    return F.like(c, F.lit(pattern), F.lit("\\"))


def has_tokens(c: Column, query: str) -> Column:
    """Whether a folded column has the query's words in order as parts; wildcards have no meaning."""
    parts = fold(query).split()
    return F.lit(False) if not parts else folded(c).rlike("(?s)" + ".*".join(rf"\Q{p}\E" for p in parts))


def contains_ignoring_case(c: Column, query: str) -> Column:
    return F.contains(F.lower(c), F.lit(query.strip().lower()))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def is_image(path: Column) -> Column:
    return extension(path).isin("jpg", "jpeg", "png")


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def same_name(a: Column, b: Column) -> Column:
    x, y = F.lower(trimmed(F.coalesce(a, F.lit("")))), F.lower(trimmed(F.coalesce(b, F.lit(""))))
    return (x != "") & (x == y)


def cache_key(query: Column) -> Column:
    """SHA-256 of a query as it is, untrimmed."""
    return F.sha2(query, 256)


def content_hash(content: Column) -> Column:
    """A digest for equality of contents. Spark has no BLAKE3; SHA-256 stands in."""
    return F.sha2(content, 256)
