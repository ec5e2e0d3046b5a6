"""Triple terms (RDF 1.2) as text ``<<( s p o )>>``, and literals with a direction.

Only the object of a triple term may be one itself, so the text of a nested term is a row of ``<<( s p`` before its innermost object and as many
``)>>`` after it: a level is taken off by one pattern, the depth is the length of the end, and equal terms are equal text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import terms as T

#: Levels that a triple term may have.
DEPTH = 64
_PARTS = r"(?s)^<<\( (\S+) (\S+) (.*) \)>>$"


def is_triple(t: Column) -> Column:
    """isTRIPLE."""
    return t.startswith("<<(")


def depth(t: Column) -> Column:
    """Levels of a triple term, 0 for any other term."""
    return F.when(is_triple(t), F.floor(F.length(F.regexp_extract(t, r"((?: \)>>)+)$", 1)) / 4)).when(t.isNotNull(), 0).cast("int")


def triple(s: Column, p: Column, o: Column) -> Column:
    """TRIPLE: null where the parts make no triple; more than DEPTH levels are refused."""
    fit = (T.is_iri(s) | T.is_blank(s)) & T.is_iri(p) & o.isNotNull()
    deep = F.raise_error(F.lit(f"refused: a triple term has more than {DEPTH} levels")).cast("string")
    return F.when(fit, F.when(is_triple(o) & (depth(o) >= DEPTH), deep).otherwise(F.concat(F.lit("<<( "), s, F.lit(" "), p, F.lit(" "), o, F.lit(" )>>"))))


def _part(t: Column, i: int) -> Column:
    return F.when(is_triple(t), F.regexp_extract(t, _PARTS, i))


def subject(t: Column) -> Column:
    """SUBJECT: null for a term that is no triple term, as for PREDICATE and OBJECT."""
    return _part(t, 1)


def predicate(t: Column) -> Column:
    return _part(t, 2)


def object_(t: Column) -> Column:
    return _part(t, 3)


# ---------------------------------------------------------------- directions
def langdir(t: Column) -> Column:
    """LANGDIR as a plain column: empty for a literal without a direction, null for other terms."""
    return F.when(T.is_literal(t), F.regexp_extract(t, r'"@[A-Za-z0-9-]+?--(ltr|rtl)$', 1))


def has_lang(t: Column) -> Column:
    return F.when(t.isNotNull(), F.coalesce(T.lang(t) != "", F.lit(False)))


def has_langdir(t: Column) -> Column:
    return F.when(t.isNotNull(), F.coalesce(langdir(t) != "", F.lit(False)))


def strlangdir(text: Column, tag: Column, direction: Column) -> Column:
    """STRLANGDIR: null where the tag is no language tag, or the direction neither ltr nor rtl."""
    return F.when(direction.isin("ltr", "rtl"), F.concat(T.strlang(text, tag), F.lit("--"), direction))
