"""Quad patterns and their conjunctions.

A position is a variable (``?name``), a term, or None for "any".  Solutions are DataFrames with
one column per variable, unbound being null; they are bags.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import triples
from . import solutions

Pattern = Sequence[str | None]
PLACES = ("s", "p", "o", "g")


def variables(pattern: Pattern) -> list[str]:
    return list(dict.fromkeys(x[1:] for x in pattern if x and x[0] == "?"))


def match(quads: DataFrame, s: str | None, p: str | None, o: str | None, g: str | None = None) -> DataFrame:
    """Solutions of one pattern: terms become filters that reach the scan, a repeated variable an equality."""
    first: dict[str, str] = {}
    for place, x in zip(PLACES, (s, p, o, g)):
        if not x:
            continue
        if x[0] != "?":
            quads = quads.where(F.col(place) == x)
        elif x[1:] in first:
            quads = quads.where(F.col(place) == F.col(first[x[1:]]))
        else:
            first[x[1:]] = place
    if g and g[0] == "?":
        quads = quads.where("g IS NOT NULL")
    return quads.select(*[F.col(place).alias(v) for v, place in first.items()])


def triple_term(found: DataFrame, term: str, s: str | None, p: str | None, o: str | None) -> DataFrame:
    """The pattern ``<<( s p o )>>`` on the triple terms that a variable has: a variable that is bound before must be the part, a new one becomes it."""
    name = term.removeprefix("?")
    found = found.where(triples.is_triple(F.col(name)))
    for x, part in zip((s, p, o), (triples.subject, triples.predicate, triples.object_)):
        if x and x[0] == "?" and x[1:] not in found.columns:
            found = found.withColumn(x[1:], part(F.col(name)))
        elif x:
            found = found.where(part(F.col(name)) == (F.col(x[1:]) if x[0] == "?" else F.lit(x)))
    return found


def ordered(patterns: Sequence[Pattern]) -> list[Pattern]:
    """Patterns with more terms first, each next one connected to those before where any is."""
    left, out, seen = list(patterns), [], set()
    while left:
        connected = [x for x in left if seen & set(variables(x))] or left
        best = min(connected, key=lambda x: (sum(1 for y in x if y and y[0] == "?"), left.index(x)))
        left.remove(best)
        out.append(best)
        seen |= set(variables(best))
    return out


def bgp(quads: DataFrame, *patterns: Pattern) -> DataFrame:
    """Solutions of all patterns together: equi-joins on shared variables."""
    found = None
    for pattern in ordered(patterns):
        one = match(quads, *pattern)
        found = one if found is None else solutions.join(found, one)
    return found


def star(quads: DataFrame, subject: str, single: dict[str, str]) -> DataFrame:
    """Patterns of one subject with predicates that have one value per subject: one grouping, no join.

    ``single`` maps variables to predicates.  Where a predicate may have several values, use ``bgp``.
    """
    rows = quads.where(F.col("p").isin(*single.values()))
    picked = rows.groupBy(F.col("s").alias(subject)).agg(*[F.max(F.when(F.col("p") == p, F.col("o"))).alias(v) for v, p in single.items()])
    return picked.dropna(subset=list(single))
