"""N-Triples and N-Quads text as quads and back, line by line on the executors."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..errors import OverBudget
from ..functions import exact
from ..functions import terms as T
from ..functions import triples

_IRI = r"<[^\x00-\x20<>\"{}|^`\\]*>"
_BLANK = r"_:[\p{L}\p{N}_](?:[\p{L}\p{N}_.-]*[\p{L}\p{N}_-])?"
_LITERAL = rf'"(?:[^"\\\n\r]|\\[tbnrf"\'\\]|\\u[0-9A-Fa-f]{{4}}|\\U[0-9A-Fa-f]{{8}})*"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*(?:--(?:ltr|rtl))?|\^\^{_IRI})?'
# an object is the heads of triple terms around it, a plain term, and their ends; one level more than allowed is still read, and then refused
_HEAD = rf"<<\(\s*({_IRI}|{_BLANK})\s*({_IRI})\s*"
_OBJECT = rf"((?:<<\(\s*(?:{_IRI}|{_BLANK})\s*{_IRI}\s*){{0,{triples.DEPTH + 1}}})({_IRI}|{_BLANK}|{_LITERAL})((?:\s*\)>>){{0,{triples.DEPTH + 1}}})"
_LINE = rf"^\s*({_IRI}|{_BLANK})\s*({_IRI})\s*({_OBJECT})\s*({_IRI}|{_BLANK})?\s*\.\s*(?:#.*)?$"


@F.pandas_udf(StringType())
def _unicode(lines: pd.Series) -> pd.Series:
    """Numeric escapes as the characters they name."""
    return lines.map(lambda x: None if x is None else re.sub(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})", lambda m: chr(int(m[1] or m[2], 16)), x))


def canonical(t: Column) -> Column:
    """Literals of well-known types in canonical form, language tags in lower case; ill-typed ones as they are.

    Numbers are made canonical as text, so that no digit is lost.
    """
    kind, text = T.datatype(t), T.lexical(t)
    whole = F.when(text.rlike(r"^[+-]?\d+$"), T.integer_text(exact.plain(text)))
    point = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), T.decimal_text(exact.plain(text)))
    truth = F.when(text.isin("1", "true"), T.boolean(F.lit(True))).when(text.isin("0", "false"), T.boolean(F.lit(False)))
    moment = F.when(text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.0+(Z|[+-]\d\d:\d\d)?$"), T.typed(F.regexp_replace(text, r"\.0+", ""), "dateTime"))
    known = F.when(kind == T.XSD + "integer", whole).when(kind == T.XSD + "decimal", point).when(kind == T.XSD + "boolean", truth).when(kind == T.XSD + "dateTime", moment)
    known = known.when(kind == T.XSD + "string", T.string(text)).when(kind == T.RDF + "langString", T.strlang(text, T.lang(t))).when(kind == T.RDF + "dirLangString", triples.strlangdir(text, T.lang(t), triples.langdir(t)))
    # plain text without an escape is canonical already: most literals need one look
    return F.when(t.rlike(r'^(<|_:|"[^"\\]*"$)'), t).otherwise(F.coalesce(F.when(T.is_literal(t), known), t))


def parse_lines(lines: DataFrame, *, line: str = "value", graph: str | None = None, document: str = "") -> DataFrame:
    """g, s, p, o of a column of N-Quads lines.

    Blank lines and comments give nothing; any other line that is no quad raises.  ``graph`` takes the quads
    that name no graph.  Blank node labels become ``document`` and the label, so that two documents never share a node.
    """
    text = F.col(line)
    kept = lines.select(F.regexp_replace(text, "\r$", "").alias("t")).where(~F.col("t").rlike(r"^\s*(#.*)?$"))
    escaped = F.col("t").contains("\\u") | F.col("t").contains("\\U")
    kept = kept.where(~escaped).unionByName(kept.where(escaped).select(_unicode("t").alias("t")))
    bad = F.raise_error(F.lit("a line is no N-Quads statement")).cast("string")
    parts = [F.regexp_extract("t", _LINE, i) for i in (1, 2, 3, 7)]
    node = lambda c: F.when(c.startswith("_:"), F.concat(F.lit(f"_:{document}_" if document else "_:"), F.substring(c, F.lit(3), F.length(c)))).otherwise(c)
    default = F.lit(graph).cast("string")
    found = kept.select(*[p.alias(n) for p, n in zip(parts, "spog")]).withColumn("s", F.when(F.col("s") == "", bad).otherwise(node(F.col("s"))))
    return found.select(F.when(F.col("g") == "", default).otherwise(node(F.col("g"))).alias("g"), "s", "p", F.when(triples.is_triple(F.col("o")) | F.col("o").endswith(")>>"), _nested(F.col("o"), node)).otherwise(canonical(node(F.col("o")))).alias("o"))


def _nested(t: Column, node: Callable[[Column], Column]) -> Column:
    """A triple term as one text: single spaces, its innermost object canonical, its blank nodes those of the document."""
    heads, inner, ends = (F.regexp_extract(t, f"^{_OBJECT}$", i) for i in (1, 2, 3))
    levels = F.regexp_count(heads, F.lit(r"<<\("))
    one = F.regexp_replace(heads, _HEAD, "<<( $1 $2 ")
    made = F.concat(F.replace(one, F.lit("<<( _:"), F.concat(F.lit("<<( "), node(F.lit("_:")))), canonical(node(inner)), F.repeat(F.lit(" )>>"), levels))
    uneven = F.raise_error(F.lit("a line is no N-Quads statement")).cast("string")
    deep = F.raise_error(F.lit(f"refused: a triple term has more than {triples.DEPTH} levels")).cast("string")
    return F.when(levels != F.regexp_count(ends, F.lit(r"\)>>")), uneven).when(levels > triples.DEPTH, deep).otherwise(made)


def text_bytes(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes of the files of a path, and of the lines that they expand to."""
    stored = spark.read.format("binaryFile").load(path).select("length")  # the contents are not read
    lines = spark.read.text(path).select(F.octet_length("value").cast("long") + 1)
    return tuple(df.toDF("n").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for df in (stored, lines))


def read_nquads(spark: SparkSession, path: str, *, graph: str | None = None, document: str = "", max_bytes: int | None = None, max_ratio: int | None = None) -> DataFrame:
    """Distinct quads of an N-Triples or N-Quads file or folder.

    ``max_bytes`` bounds the text as read, that is unpacked, and ``max_ratio`` how many times the stored bytes it may
    be; more is refused before a quad is made.  Either costs one more scan of the text.
    """
    if max_bytes is not None or max_ratio is not None:
        stored, size = text_bytes(spark, path)
        if max_bytes is not None and size > max_bytes:
            raise OverBudget(f"refused: the text has more than {max_bytes} bytes")
        if max_ratio is not None and size > max_ratio * max(stored, 1) + 1:
            raise OverBudget(f"refused: the text is more than {max_ratio} times its files")
    return parse_lines(spark.read.text(path), graph=graph, document=document).distinct()


def lines_of(quads: DataFrame) -> DataFrame:
    """line: each quad as a statement."""
    graph = F.when(F.col("g").isNull(), "").otherwise(F.concat(F.lit(" "), F.col("g")))
    return quads.select(F.concat("s", F.lit(" "), "p", F.lit(" "), "o", graph, F.lit(" .")).alias("line"))


def dump(quads: DataFrame, path: str) -> None:
    """All quads in one order: default graph first, then by graph, subject, predicate and object.
    Ranges of quads become files, whose names have the same order."""
    order = [F.col("g").asc_nulls_first(), F.col("s"), F.col("p"), F.col("o")]
    lines_of(quads.repartitionByRange(*order).sortWithinPartitions(*order)).write.text(path)
