"""Column functions on text. White space and word borders are Unicode's, as (?U) asks for."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, where c is computed once however often f names it: it is the one element of an array."""
    return F.element_at(F.transform(F.array(c), f), 1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, ends stripped."""
    # a single space is no match, so that plain text has few; no other white space is left to strip then
    return F.trim(F.regexp_replace(c, r"(?U)\s(?:\s+|(?<! ))", " "))


def clean(c: Column) -> Column:
    """Leaders of dots (... or . . .) become a space, then white space is squeezed."""
    # one pattern for both kinds, as no dot of a run of three begins or ends a leader with spaces; most texts have neither
    plain = lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, r"\.(?:\.{2,}|(?: \.){2,} )", " "), " {2,}", " "))
    return once(squeeze(c), lambda t: F.when(t.contains("...") | t.contains(". . . "), plain(t)).otherwise(t))


def words(c: Column) -> Column:
    return F.array_remove(F.split(c, r"(?U)\s+"), "")


def n_words_squeezed(c: Column) -> Column:
    """The number of words of a text whose only white space is single spaces."""
    t = F.trim(c)
    return F.octet_length(t) - F.octet_length(F.replace(t, F.lit(" "))) + (t != "").cast("int")


def title_case(c: Column) -> Column:
    """Every run of letters begins with a capital, also after a mark (O'Neil, X-Ray)."""
    return F.array_join(F.transform(F.split(squeeze(c), r"(?<=\P{L})"), F.initcap), "")


def hash16(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def chunk_key(source: Column, text: Column) -> Column:
    """A key that is the same whenever source and text are."""
    return hash16(F.concat(source, F.lit(":"), text))


def any_match(c: Column, patterns, flags: str = "") -> Column:
    """Whether a pattern matches at the text's very begin."""
    return reduce(lambda a, b: a | b, (c.rlike(rf"(?{flags}U)\A(?:{p})") for p in patterns))


def first_match(c: Column, patterns, flags: str = "i") -> Column:
    """What the first of the patterns that is found anywhere matches; null if none is."""
    return F.coalesce(*(F.when(c.rlike(f"(?{flags}U){p}"), F.regexp_extract(c, f"(?{flags}U){p}", 0)) for p in patterns))


def chunk_scope(c: Column, patterns, longest: int = 100) -> Column:
    found = first_match(c, patterns)
    return F.when((F.length(c) <= longest) & found.isNotNull(), squeeze(F.upper(found)))


def low_signal(c: Column, min_words: int = 20, share: float = 0.3, squeezed: bool = False) -> Column:
    """Few words, or few of them of letters only. Words of squeezed text are counted by its spaces."""
    # a match is what is left of a word from its first character that is no letter: one for each word that has one
    other = F.regexp_count(c, F.lit(r"(?U)[^\s\p{L}]\S*+"))
    return once(n_words_squeezed(c) if squeezed else F.size(words(c)), lambda n: (n < min_words) | ((n - other) / F.greatest(n, F.lit(1)) < share))


def basename(c: Column) -> Column:
    """The last part of a path."""
    return F.element_at(F.split(F.regexp_replace(c, "/+$", ""), "/"), -1)


def preview(c: Column, n: int = 50) -> Column:
    """The first n characters, with ... where more follow."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)
