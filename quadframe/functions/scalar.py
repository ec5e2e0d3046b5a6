"""SPARQL's string, number, time and hash functions on terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import exact
from .terms import RDF, XSD, datatype, date_time, decimal, double, integer, is_literal, kept, lang, lexical, number, str_, string, strlang, time


def text_of(t: Column) -> Column:
    """The text of a string literal, with or without a language; null for other terms."""
    return F.when(datatype(t).isin(XSD + "string", RDF + "langString"), lexical(t))


def _like(t: Column, text: Column) -> Column:
    """A literal with ``text`` and the language of ``t``."""
    return F.when(lang(t) != "", strlang(text, lang(t))).otherwise(string(text))


def compatible(a: Column, b: Column) -> Column:
    """Whether two string arguments may meet: the second is simple or has the language of the first."""
    return text_of(a).isNotNull() & text_of(b).isNotNull() & ((lang(b) == "") | (lang(a) == lang(b)))


def strlen(t: Column) -> Column:
    return integer(F.length(text_of(t)))


def substr(t: Column, start: Column, length: Column | None = None) -> Column:
    """SUBSTR by XPath: places from 1, a start before the text uses up length."""
    first, size = F.round(start).cast("int"), F.length(text_of(t))
    end = size + 1 if length is None else F.least(size + 1, first + F.round(length).cast("int"))
    begin = F.greatest(first, F.lit(1))
    return _like(t, F.substring(text_of(t), begin, F.greatest(end - begin, F.lit(0))))


def ucase(t: Column) -> Column:
    return _like(t, F.upper(text_of(t)))


def lcase(t: Column) -> Column:
    return _like(t, F.lower(text_of(t)))


def strstarts(a: Column, b: Column) -> Column:
    return F.when(compatible(a, b), text_of(a).startswith(text_of(b)))


def strends(a: Column, b: Column) -> Column:
    return F.when(compatible(a, b), text_of(a).endswith(text_of(b)))


def contains(a: Column, b: Column) -> Column:
    return F.when(compatible(a, b), F.contains(text_of(a), text_of(b)))


def strbefore(a: Column, b: Column) -> Column:
    at = F.instr(text_of(a), text_of(b))
    return F.when(compatible(a, b), F.when(at > 0, _like(a, F.substring(text_of(a), F.lit(1), at - 1))).otherwise(F.lit('""')))


def strafter(a: Column, b: Column) -> Column:
    at = F.instr(text_of(a), text_of(b))
    rest = F.substring(text_of(a), at + F.length(text_of(b)), F.length(text_of(a)))
    return F.when(compatible(a, b), F.when(at > 0, _like(a, rest)).otherwise(F.lit('""')))


def concat(*terms: Column) -> Column:
    """CONCAT: the language stays where all arguments have the same."""
    text = F.concat(*[text_of(t) for t in terms])
    same = F.lit(True)
    for t in terms[1:]:
        same = same & (lang(t) == lang(terms[0]))
    return F.when(same, _like(terms[0], text)).otherwise(string(text))


def encode_for_uri(t: Column) -> Column:
    text = F.url_encode(text_of(t))
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return string(text)


def _pattern(pattern: str | Column, flags: str | Column) -> Column:
    """The full pattern of text or of a term, with its flags in front; null for flags that are none and for terms that are no strings."""
    if isinstance(flags, str) and set(flags) - set("imsxq"):
        raise ValueError("unknown regular expression flag")
    body, flags = (F.lit(x) if isinstance(x, str) else text_of(x) for x in (pattern, flags))
    kept = F.replace(flags, F.lit("q"), F.lit(""))
    body = F.when(flags.contains("q"), F.concat(F.lit("\\Q"), body, F.lit("\\E"))).otherwise(body)
    return F.when(~flags.rlike("[^imsxq]"), F.when(kept == "", body).otherwise(F.concat(F.lit("(?"), kept, F.lit(")"), body)))


def regex(t: Column, pattern: str | Column, flags: str | Column = "") -> Column:
    """REGEX; pattern and flags are Python text, or terms that may differ from row to row."""
    return F.rlike(text_of(t), _pattern(pattern, flags))


def replace(t: Column, pattern: str | Column, by: str | Column, flags: str | Column = "") -> Column:
    """REPLACE: an error where the pattern matches the empty text."""
    full = _pattern(pattern, flags)
    return F.when(~F.rlike(F.lit(""), full), _like(t, F.regexp_replace(text_of(t), full, F.lit(by) if isinstance(by, str) else text_of(by))))


def lang_matches(tag: Column, range_: str | Column) -> Column:
    """LANGMATCHES of a tag's text with a range: Python text, or a term that may differ from row to row."""
    of = F.lower(F.lit(range_) if isinstance(range_, str) else text_of(range_))
    return F.when(of == "*", tag != "").otherwise((F.lower(tag) == of) | F.startswith(F.lower(tag), F.concat(of, F.lit("-"))))


# ---------------------------------------------------------------- numbers
def abs_(t: Column) -> Column:
    return kept(t, exact.absolute, F.abs)


def ceil(t: Column) -> Column:
    return kept(t, exact.ceil, F.ceil)


def floor(t: Column) -> Column:
    return kept(t, exact.floor, F.floor)


def round_(t: Column) -> Column:
    """ROUND: halves go up, also below zero."""
    return kept(t, exact.round_, lambda x: F.floor(x + 0.5))


# ---------------------------------------------------------------- times
def _part(t: Column, pattern: str) -> Column:
    found = F.regexp_extract(lexical(t), pattern, 1)
    return F.when(time(t).isNotNull() & (found != ""), found)


#: The parts of the time as written, in its own zone.
PARTS = {
    "year": r"^(-?\d{4,})-",
    "month": r"^-?\d{4,}-(\d\d)",
    "day": r"^-?\d{4,}-\d\d-(\d\d)",
    "hours": r"T(\d\d):",
    "minutes": r"T\d\d:(\d\d)",
    "seconds": r"T\d\d:\d\d:(\d\d(?:\.\d+)?)",
}


def time_part(t: Column, part: str) -> Column:
    """YEAR, MONTH, DAY, HOURS and MINUTES as integers, SECONDS as a decimal."""
    text = _part(t, PARTS[part])
    return decimal(text.try_cast("decimal(20,9)")) if part == "seconds" else integer(text.try_cast("int"))


def tz(t: Column) -> Column:
    """TZ: the zone as written, empty without one."""
    return F.when(time(t).isNotNull(), string(F.regexp_extract(lexical(t), r"(Z|[+-]\d\d:\d\d)$", 1)))


def timezone(t: Column) -> Column:
    """TIMEZONE: the zone as a dayTimeDuration, an error without one."""
    zone = F.regexp_extract(lexical(t), r"(Z|[+-]\d\d:\d\d)$", 1)
    hours, minutes = F.substring(zone, 2, 2).try_cast("int"), F.substring(zone, 5, 2).try_cast("int")
    parts = F.concat(F.when(zone.startswith("-"), "-").otherwise(""), F.lit("PT"), F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""))
    text = F.when(zone.isin("Z", "+00:00", "-00:00"), "PT0S").when(zone != "", parts)
    return F.when(time(t).isNotNull() & text.isNotNull(), F.concat(F.lit('"'), text, F.lit(f'"^^<{XSD}dayTimeDuration>')))


def hash_(t: Column, kind: str) -> Column:
    """MD5, SHA1, SHA256, SHA384 and SHA512 of a string literal, in hex."""
    data = text_of(t)
    made = {"md5": F.md5, "sha1": F.sha1}.get(kind)
    return string(made(data) if made else F.sha2(data, int(kind.removeprefix("sha"))))


def is_numeric(t: Column) -> Column:
    return F.when(t.isNotNull(), number(t).isNotNull())


# ---------------------------------------------------------------- fresh values
def uuid_() -> Column:
    return F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))


def struuid() -> Column:
    return string(F.uuid())


def rand_() -> Column:
    return double(F.rand())


def now() -> Column:
    """NOW: one instant for a whole query, as Spark folds it into the plan once."""
    return date_time(F.current_timestamp())


def bnode(label: Column | None = None, *solution: Column) -> Column:
    """BNODE: a fresh node for each solution; with a label the same node for the same label and solution."""
    made = F.uuid() if label is None else F.concat_ws("-", F.lit("b"), F.sha1(F.concat_ws("\0", label, *solution)))
    return F.concat(F.lit("_:u"), F.replace(made, F.lit("-"), F.lit("")))


def str_term(t: Column) -> Column:
    return string(str_(t))


def lang_term(t: Column) -> Column:
    return F.when(is_literal(t), string(lang(t)))
