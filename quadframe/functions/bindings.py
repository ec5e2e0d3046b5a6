"""Values from outside as terms: they are never part of a query's text, so they cannot change it."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from .terms import XSD

_TAG = re.compile(r"[A-Za-z]{1,8}(-[A-Za-z0-9]{1,8})*\Z")
_NAME = re.compile(r"[A-Za-z0-9_]+\Z")
_TERM = re.compile(r'<(?P<iri>[^>]*)>\Z|"(?P<text>(?:[^"\\]|\\.)*)"(?:@(?P<lang>[A-Za-z0-9-]+)|\^\^<(?P<kind>[^>]*)>)?\Z', re.S)
_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\(.)", re.S)
_BAD_IRI = re.compile(r'[\x00-\x20<>"{}|\\^`]')


def _quoted(text: str) -> str:
    for raw, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = text.replace(raw, code)
    return f'"{text}"'


def _unescape(m: re.Match) -> str:
    return {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}.get(m[3], m[3]) if m[3] else chr(int(m[1] or m[2], 16))


def iri(text: str) -> str:
    if _BAD_IRI.search(text) or ":" not in text:
        raise InvalidArgument("bindings", "a value is no absolute IRI")
    return f"<{text}>"


def literal(text: str, datatype: str | None = None, lang: str | None = None) -> str:
    if lang is not None:
        if datatype is not None or not _TAG.match(lang):
            raise InvalidArgument("bindings", "a language tag is ill-formed, or comes with a datatype")
        return f"{_quoted(text)}@{lang.lower()}"
    return _quoted(text) if datatype in (None, XSD + "string") else f"{_quoted(text)}^^{iri(datatype)}"


def term(value: object) -> str:
    """A JSON value as a term; null, arrays and blank nodes are refused."""
    if isinstance(value, bool):
        return literal(str(value).lower(), XSD + "boolean")
    if isinstance(value, int):
        return literal(str(value), XSD + "integer")
    if isinstance(value, float):
        return literal(repr(value), XSD + "double")
    if isinstance(value, str):
        return literal(value)
    if isinstance(value, Mapping) and isinstance(value.get("value"), str):
        if value.get("type") == "uri" and set(value) == {"type", "value"}:
            return iri(value["value"])
        if value.get("type") == "literal" and set(value) <= {"type", "value", "datatype", "xml:lang"}:
            return literal(value["value"], value.get("datatype"), value.get("xml:lang"))
    raise InvalidArgument("bindings", "a value is neither a string, number or boolean nor a uri or literal object")


def parse_bindings(text: str) -> dict[str, str]:
    try:
        found = json.loads(text)
    except ValueError:
        raise InvalidArgument("bindings", "it is no JSON") from None
    if not isinstance(found, dict) or not all(_NAME.match(k) for k in found):
        raise InvalidArgument("bindings", "it must be an object whose names are letters, digits and _")
    return {k: term(v) for k, v in found.items()}


def bindings_json(bindings: Mapping[str, str]) -> str:
    """Terms by name as the text that ``parse_bindings`` reads; a blank node is refused, as it names nothing outside."""
    made = {}
    for name, t in bindings.items():
        found = _TERM.match(t)
        if not _NAME.match(name) or not found:
            raise InvalidArgument("bindings", f"?{name} is neither an IRI nor a literal")
        if found["iri"] is not None:
            made[name] = {"type": "uri", "value": found["iri"]}
        else:
            more = {"xml:lang": found["lang"], "datatype": found["kind"]}
            made[name] = {"type": "literal", "value": _ESCAPE.sub(_unescape, found["text"])} | {k: v for k, v in more.items() if v is not None}
    return json.dumps(made, ensure_ascii=False)


def substitute(solutions: DataFrame, bindings: Mapping[str, str]) -> DataFrame:
    """Solutions in which the bound variables have their values; a name that is not in scope is refused."""
    for name, value in bindings.items():
        if name not in solutions.columns:
            raise InvalidArgument("bindings", f"?{name} is not in scope; project it, or take it out of the bindings")
        solutions = solutions.where(F.col(name) == value)
    return solutions
