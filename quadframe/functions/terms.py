"""RDF terms as N-Triples text, and SPARQL functions on them.

A term is one string column: ``<iri>``, ``_:label``, ``"text"``, ``"text"@lang``, ``"text"@lang--dir``,
``"text"^^<datatype>`` or ``<<( s p o )>>`` (see ``triples``), canonical, so that equal terms are equal strings and joins, grouping
and DISTINCT need nothing else.  Values are taken out where an expression needs them.  An error
is null, which is SPARQL's unbound.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import exact

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
#: The numeric datatypes of XML Schema that SPARQL computes with, in order of promotion.
NUMERIC = ("integer", "decimal", "float", "double")
#: Datatypes derived from integer.
INTEGERS = ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedInt", "unsignedLong", "unsignedShort", "unsignedByte")

_LITERAL = r'(?s)^"((?:[^"\\]|\\.)*)"'


def _escaped(text: Column) -> Column:
    for raw, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def _unescaped(text: Column) -> Column:
    # the double backslash first becomes a mark that no canonical text holds
    text = F.replace(text, F.lit("\\\\"), F.lit("\x00"))
    for raw, code in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return F.replace(text, F.lit("\x00"), F.lit("\\"))


# ---------------------------------------------------------------- constructors
def iri(text: Column) -> Column:
    """IRI: null where the text has characters that no IRI may have."""
    return F.when(~text.rlike(r'[\x00-\x20<>"{}|\\^`]'), F.concat(F.lit("<"), text, F.lit(">")))


def string(text: Column) -> Column:
    return F.concat(F.lit('"'), _escaped(text), F.lit('"'))


def typed(text: Column, datatype: str) -> Column:
    """A literal of an XSD local name or a full datatype IRI."""
    full = datatype if ":" in datatype else XSD + datatype
    return string(text) if full == XSD + "string" else F.concat(string(text), F.lit(f"^^<{full}>"))


def strdt(text: Column, datatype: Column) -> Column:
    """STRDT: datatype is an IRI term; xsd:string gives a simple literal."""
    return F.when(is_iri(datatype), F.when(datatype == f"<{XSD}string>", string(text)).otherwise(F.concat(string(text), F.lit("^^"), datatype)))


def strlang(text: Column, tag: Column) -> Column:
    """STRLANG: null where the tag is no language tag."""
    return F.when(tag.rlike(r"^[A-Za-z]{1,8}(-[A-Za-z0-9]{1,8})*$"), F.concat(string(text), F.lit("@"), F.lower(tag)))


def integer(value: Column) -> Column:
    return integer_text(value.cast("decimal(38,0)").cast("string"))


def integer_text(text: Column) -> Column:
    """An integer of canonical text."""
    return F.concat(F.lit('"'), text, F.lit(f'"^^<{XSD}integer>'))


def boolean(value: Column) -> Column:
    return F.concat(F.lit('"'), value.cast("string"), F.lit(f'"^^<{XSD}boolean>'))


def decimal(value: Column) -> Column:
    return decimal_text(exact.plain(value.cast("string")))


def decimal_text(text: Column) -> Column:
    """A decimal of canonical text: at least one digit on each side of the point."""
    return F.concat(F.lit('"'), F.when(text.contains("."), text).otherwise(F.concat(text, F.lit(".0"))), F.lit(f'"^^<{XSD}decimal>'))


def double(value: Column) -> Column:
    return F.concat(F.lit('"'), value.cast("double").cast("string"), F.lit(f'"^^<{XSD}double>'))


def date_time(value: Column) -> Column:
    """A timestamp in UTC, canonical: no fraction of zeros."""
    text = F.regexp_replace(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.?0+$", "")
    text = F.when(text.rlike(r"T\d\d:\d\d:\d\d"), text).otherwise(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss"))
    return F.concat(F.lit('"'), text, F.lit(f'Z"^^<{XSD}dateTime>'))


# ---------------------------------------------------------------- inspection
def is_iri(t: Column) -> Column:
    return t.startswith("<") & ~t.startswith("<<")


def is_blank(t: Column) -> Column:
    return t.startswith("_:")


def is_literal(t: Column) -> Column:
    return t.startswith('"')


def lexical(t: Column) -> Column:
    """The lexical form of a literal, null for others."""
    return F.when(is_literal(t), _unescaped(F.regexp_extract(t, _LITERAL, 1)))


def str_(t: Column) -> Column:
    """STR as a plain column: the IRI's text or the lexical form; null for a blank node."""
    return F.when(is_iri(t), F.regexp_extract(t, r"(?s)^<(.*)>$", 1)).otherwise(lexical(t))


def lang(t: Column) -> Column:
    return F.when(is_literal(t), F.regexp_extract(t, r'"@([A-Za-z0-9-]+?)(?:--(?:ltr|rtl))?$', 1))


def datatype(t: Column) -> Column:
    """DATATYPE as an IRI's text."""
    own = F.regexp_extract(t, r'"\^\^<([^>]*)>$', 1)
    return F.when(is_literal(t), F.when(own != "", own).when(t.rlike(r'"@[A-Za-z0-9-]+--(ltr|rtl)$'), RDF + "dirLangString").when(lang(t) != "", RDF + "langString").otherwise(XSD + "string"))


_WHOLE, _POINT, _REAL = r"^[+-]?\d+$", r"^[+-]?(\d+\.?\d*|\.\d+)$", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?INF$|^NaN$"


def numeric_rank(t: Column) -> Column:
    """Place of a numeric literal's type in the order of promotion, 0 to 3; null for others and for ill-typed ones."""
    local, text = F.regexp_extract(t, rf'"\^\^<{XSD}(\w+)>$', 1), F.trim(lexical(t))
    rank = F.when(local.isin(*INTEGERS), F.when(text.rlike(_WHOLE), 0)).when(local == "decimal", F.when(text.rlike(_POINT), 1))
    for i, name in enumerate(NUMERIC[2:], 2):
        rank = rank.when(local == name, F.when(text.rlike(_REAL), i))
    return rank


def number(t: Column) -> Column:
    """The value of a numeric literal as a double, null for anything else or an ill-typed one."""
    text = F.trim(lexical(t))
    value = F.when(text.isin("INF", "+INF"), F.lit(float("inf"))).when(text == "-INF", F.lit(float("-inf"))).otherwise(text.try_cast("double"))
    return F.when(numeric_rank(t).isNotNull(), value)


def exact_text(t: Column) -> Column:
    """The text of an integer or decimal literal, of any length."""
    return F.when(numeric_rank(t) <= 1, F.trim(lexical(t)))


def _numeric(t: Column) -> Column:
    """rank, text and double of a numeric literal: what the functions on numbers need, computed once."""

    def made(x: Column) -> Column:
        text = F.when(x["rank"].isNotNull(), x["text"])
        real = F.when(text.isin("INF", "+INF"), F.lit(float("inf"))).when(text == "-INF", F.lit(float("-inf"))).otherwise(text.try_cast("double"))
        return F.struct(x["rank"].alias("rank"), text.alias("text"), real.alias("real"))

    return exact.once(lambda x: exact.once(made)(F.struct(numeric_rank(x).alias("rank"), F.trim(lexical(x)).alias("text"))))(t)


def time(t: Column) -> Column:
    """The instant of a dateTime literal; one without a zone counts as UTC."""
    return F.when(datatype(t) == XSD + "dateTime", lexical(t).try_cast("timestamp"))


def truth(t: Column) -> Column:
    """Effective boolean value: null is an error."""
    kind, text = datatype(t), lexical(t)
    return F.when(kind == XSD + "boolean", F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False)).when(kind == XSD + "string", text != "").when(number(t).isNotNull(), (number(t) != 0) & ~F.isnan(number(t)))


# ---------------------------------------------------------------- comparison and arithmetic
def same_term(a: Column, b: Column) -> Column:
    return a == b


def _parsed(t: Column) -> Column:
    """What comparisons need of a term, computed once."""
    made = lambda x, kind, n: F.struct(x.alias("term"), kind.alias("kind"), lexical(x).alias("text"), n["rank"].alias("rank"), n["text"].alias("digits"), n["real"].alias("real"), F.when(kind == XSD + "dateTime", time(x)).alias("time"))
    return exact.once(lambda x: exact.once(made)(x, datatype(x), _numeric(x)))(t)


def _compared(x: Column, y: Column, test: Callable[[Column, Column], Column]) -> Column:
    """``test`` on two numbers: exact ones by keys of all their digits, others as doubles; NaN fails it."""
    real = test(x["real"], y["real"]) & ~F.isnan(x["real"]) & ~F.isnan(y["real"])
    return F.when((x["rank"] <= 1) & (y["rank"] <= 1), test(exact.order_key(x["digits"]), exact.order_key(y["digits"]))).otherwise(real)


def _equal(x: Column, y: Column) -> Column:
    known = lambda t: t["kind"].isin(XSD + "string", RDF + "langString", XSD + "boolean") | t["rank"].isNotNull() | t["time"].isNotNull()
    literals = x["kind"].isNotNull() & y["kind"].isNotNull()
    terms = F.when(x["term"] == y["term"], True).when(literals & ~(known(x) & known(y)), F.lit(None).cast("boolean")).otherwise(False)
    both = lambda name: x[name].isNotNull() & y[name].isNotNull()
    return F.when(both("rank"), _compared(x, y, lambda m, k: m == k)).when(both("time"), x["time"] == y["time"]).when(both("term"), terms)


def equal(a: Column, b: Column) -> Column:
    """``=``: numbers and times by value, NaN equal to nothing; other terms as terms, and two
    literals of unlike unknown datatypes are an error."""
    return exact.once(_equal)(_parsed(a), _parsed(b))


def in_(t: Column, *options: Column) -> Column:
    """IN: true where one option is equal, else an error where one comparison is, else false."""

    def made(tests: Column) -> Column:
        hit, error = F.exists(tests, lambda x: F.coalesce(x, F.lit(False))), F.exists(tests, lambda x: x.isNull())
        return F.when(hit, True).when(~error, False)

    tests = lambda x: F.transform(F.array(*[_parsed(o) for o in options]), lambda y: _equal(x, y))
    return exact.once(lambda x: exact.once(made)(tests(x)))(_parsed(t))


def less(a: Column, b: Column) -> Column:
    """``<``: two numbers, times, simple literals or booleans; anything else is an error."""

    def made(x: Column, y: Column) -> Column:
        both = lambda name: (x["kind"] == XSD + name) & (y["kind"] == XSD + name)
        true = lambda t: t["text"].isin("true", "1")
        flag = lambda t: t["text"].isin("true", "1", "false", "0")
        return (
            F.when(x["rank"].isNotNull() & y["rank"].isNotNull(), _compared(x, y, lambda m, k: m < k))
            .when(x["time"].isNotNull() & y["time"].isNotNull(), x["time"] < y["time"])
            .when(both("string"), x["text"] < y["text"])
            .when(both("boolean") & flag(x) & flag(y), ~true(x) & true(y))
        )

    return exact.once(made)(_parsed(a), _parsed(b))


def arithmetic(op: str, a: Column, b: Column) -> Column:
    """``+ - * /`` with promotion: exact for integers and decimals, which divide to a decimal of 18 places; division by an exact zero is an error."""

    def made(x: Column, y: Column) -> Column:
        rank = F.greatest(x["rank"], y["rank"])
        text = {"+": exact.add, "-": exact.subtract, "*": exact.multiply, "/": exact.divide}[op](x["text"], y["text"])
        apply = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[op]
        real = (x["real"] / F.when(y["real"] != 0, y["real"])) if op == "/" else apply(x["real"], y["real"])
        exactly = exact.once(lambda made, rank: F.when(rank == 0, (decimal_text if op == "/" else integer_text)(made)).otherwise(decimal_text(made)))
        return F.when(x["rank"].isNotNull() & y["rank"].isNotNull(), F.when(rank <= 1, exactly(text, rank)).otherwise(double(real)))

    return exact.once(made)(_numeric(a), _numeric(b))


def minus(t: Column) -> Column:
    """Unary ``-``."""
    return kept(t, exact.negate, lambda x: -x)


def kept(t: Column, of_text: Callable[[Column], Column], of_double: Callable[[Column], Column]) -> Column:
    """A function of a number in its own type: exact for integers and decimals of any length."""

    def made(x: Column) -> Column:
        exactly = exact.once(lambda text, rank: F.when(rank == 0, integer_text(text)).otherwise(decimal_text(text)))
        return F.when(x["rank"] <= 1, exactly(of_text(x["text"]), x["rank"])).when(x["rank"].isNotNull(), double(of_double(x["real"])))

    return exact.once(made)(_numeric(t))


def order_key(t: Column) -> Column:
    """ORDER BY: unbound, blank nodes, IRIs, literals, triple terms; numbers by value, then times, then text.

    The doubles next to two exact numbers never order them the wrong way, and where these are equal all their digits decide.
    """
    kind = F.when(t.isNull(), 0).when(is_blank(t), 1).when(is_iri(t), 2).when(is_literal(t), 3).otherwise(4)
    group = F.when(number(t).isNotNull(), 0).when(time(t).isNotNull(), 1).otherwise(2)
    return F.struct(kind.alias("kind"), group.alias("group"), number(t).alias("number"), exact.order_key(exact_text(t)).alias("digits"), time(t).alias("time"), str_(t).alias("text"), t.alias("term"))


def cast(t: Column, kind: str) -> Column:
    """``xsd:boolean integer decimal float double string dateTime`` constructor functions."""
    text, value = F.trim(str_(t)), number(t)
    if kind == "string":
        return string(str_(t))
    source = datatype(t)
    ok = source.isin(XSD + "string", XSD + "boolean", XSD + "dateTime") | value.isNotNull()
    if kind == "boolean":
        return F.when(value.isNotNull(), boolean((value != 0) & ~F.isnan(value))).when(text.isin("true", "1"), boolean(F.lit(True))).when(text.isin("false", "0"), boolean(F.lit(False)))
    if kind == "dateTime":
        return F.when(ok, date_time(text.try_cast("timestamp")))
    flag = F.when(source == XSD + "boolean", F.when(text == "true", 1).otherwise(0))
    real = value.isNotNull() & source.isin(XSD + "float", XSD + "double")
    written = F.when(real, F.when(text.rlike(r"[eE]"), F.coalesce(text.try_cast("decimal(38,18)").cast("string"), text.try_cast("decimal(38,0)").cast("string"))).when(text.rlike(_POINT), text))
    if kind == "integer":
        return F.when(ok, F.coalesce(integer(flag), integer_text(exact.truncate(F.coalesce(written, F.when(text.rlike(_WHOLE) | (value.isNotNull() & text.rlike(_POINT)), text))))))
    if kind == "decimal":
        return F.when(ok, F.coalesce(decimal(flag), decimal_text(exact.plain(F.coalesce(written, F.when(text.rlike(_POINT), text))))))
    shape = text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?INF$|^NaN$")
    real = F.coalesce(flag, value, F.when(shape, F.regexp_replace(text, "INF", "Infinity").try_cast("double")))
    return F.when(ok, F.concat(F.lit('"'), real.cast("double").cast("string"), F.lit(f'"^^<{XSD}{kind}>')))
