"""ASK, CONSTRUCT and DESCRIBE, and answers as text within bounds."""

from __future__ import annotations

import json
from collections.abc import Sequence
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument, OverBudget
from .datasets import Capability
from .paths import one_or_more
from .updates import instantiate

#: Rows and bytes of an answer by default, and what no grant can exceed.
ROWS, BYTES, MOST_ROWS, MOST_BYTES = 100_000, 16 << 20, 10_000_000, 1 << 30


def ask(solutions: DataFrame) -> bool:
    return not solutions.limit(1).isEmpty()


def construct(solutions: DataFrame, template: Sequence[Sequence[str]]) -> DataFrame:
    """s, p, o: the template's triples, each once."""
    return instantiate(solutions, template).select("s", "p", "o").distinct()


def describe(quads: DataFrame, resources: DataFrame) -> DataFrame:
    """s, p, o of the default graph about ``resources`` (column n), and about all blank nodes that these lead to
    through blank nodes.

    The blank nodes are those of the closure of the edges to blank nodes from the resources, by jumps: a list of n
    nodes takes about 2 log n rounds (``paths.one_or_more``).
    """
    default = quads.where("g IS NULL").select("s", "p", "o")
    asked = resources.select("n").distinct()
    reached = one_or_more(default.where(F.col("o").startswith("_:")).select("s", "o"), asked)
    every = asked.select(F.col("n").alias("s")).union(reached.select("o")).distinct()
    return default.join(every, "s", "left_semi").select("s", "p", "o").distinct()


def bounds(capability: Capability, max_rows: int | None = None, max_bytes: int | None = None) -> tuple[int, int]:
    """The bounds of an answer: grants raise them to the ceiling, arguments only lower them."""
    rows = MOST_ROWS if capability.root else min(MOST_ROWS, max([ROWS, *capability.numbers("answer:")]))
    size = MOST_BYTES if capability.root else min(MOST_BYTES, max([BYTES, *capability.numbers("answer:bytes:")]))
    for name, value in (("max_rows", max_rows), ("max_bytes", max_bytes)):
        if value is not None and (isinstance(value, bool) or not isinstance(value, int) or value <= 0):
            raise InvalidArgument(name, "it must be a positive whole number")
    return min(rows, max_rows or rows), min(size, max_bytes or size)


# ---------------------------------------------------------------- formats
def _parts(t: str) -> tuple[str, str, str, str]:
    """kind, text, language, datatype of a term."""
    if t[0] == "<" and t[1] != "<":
        return "uri", t[1:-1], "", ""
    if t[:2] == "_:":
        return "bnode", t[2:], "", ""
    if t[:3] == "<<(":
        return "triple", t, "", ""
    end = t.rindex('"')
    text = _plain(t[1:end])
    rest = t[end + 1 :]
    return "literal", text, rest[1:] if rest[:1] == "@" else "", rest[3:-1] if rest[:2] == "^^" else ""


def _plain(text: str) -> str:
    out, i = [], 0
    while i < len(text):
        if text[i] == "\\":
            out.append({"n": "\n", "r": "\r", "t": "\t"}.get(text[i + 1], text[i + 1]))
            i += 2
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def _levels(t: str) -> tuple[list[list[str]], str]:
    """Subject and predicate of each level of a triple term, outermost first, and what is innermost."""
    heads = []
    while t[:3] == "<<(":
        s, p, t = t[4:-4].split(" ", 2)
        heads.append([s, p])
    return heads, t


def _json_term(t: str) -> dict:
    heads, t = _levels(t)
    kind, text, lang, datatype = _parts(t)
    lang, _, way = lang.partition("--")
    made = {"type": kind, "value": text} | ({"xml:lang": lang} if lang else {}) | ({"its:dir": way} if way else {}) | ({"datatype": datatype} if datatype else {})
    for s, p in reversed(heads):
        made = {"type": "triple", "value": {"subject": _json_term(s), "predicate": _json_term(p), "object": made}}
    return made


def _xml_term(t: str) -> str:
    heads, t = _levels(t)
    kind, text, lang, datatype = _parts(t)
    lang, _, way = lang.partition("--")
    more = f' xml:lang="{lang}"' if lang else f' datatype="{escape(datatype)}"' if datatype else ""
    more += f' its:dir="{way}" xmlns:its="http://www.w3.org/2005/11/its"' if way else ""
    made = f"<{kind}{more}>{escape(text)}</{kind}>"
    for s, p in reversed(heads):
        made = f"<triple><subject>{_xml_term(s)}</subject><predicate>{_xml_term(p)}</predicate><object>{made}</object></triple>"
    return made


def _json(names, rows):
    yield '{"head":' + json.dumps({"vars": names}) + ',"results":{"bindings":['
    for i, row in enumerate(rows):
        cells = {}
        for n, t in zip(names, row):
            if t is not None:
                cells[n] = _json_term(t)
        yield ("," if i else "") + json.dumps(cells, ensure_ascii=False)
    yield "]}}"


def _xml(names, rows):
    yield '<?xml version="1.0"?><sparql xmlns="http://www.w3.org/2005/sparql-results#"><head>' + "".join(f'<variable name="{n}"/>' for n in names) + "</head><results>"
    for row in rows:
        cells = []
        for n, t in zip(names, row):
            if t is not None:
                cells.append(f'<binding name="{n}">{_xml_term(t)}</binding>')
        yield "<result>" + "".join(cells) + "</result>"
    yield "</results></sparql>"


def _csv(names, rows):
    yield ",".join(names) + "\r\n"
    for row in rows:
        texts = ["" if t is None else t if t[:2] == "_:" else _parts(t)[1] for t in row]
        yield ",".join('"' + x.replace('"', '""') + '"' if any(c in x for c in '",\r\n') else x for x in texts) + "\r\n"


def _tsv(names, rows):
    yield "\t".join("?" + n for n in names) + "\n"
    for row in rows:
        yield "\t".join(t or "" for t in row) + "\n"


def _ntriples(names, rows):
    for row in rows:
        yield " ".join(row) + " .\n"


def _turtle(names, rows):
    """Turtle with full IRIs: statements that follow each other and share subject, or subject and predicate, are one group."""
    last = None
    for s, p, o in rows:
        if last is None or last[0] != s:
            yield ("" if last is None else " .\n") + f"{s} {p} {o}"
        else:
            yield f", {o}" if last[1] == p else f" ;\n    {p} {o}"
        last = s, p
    if last is not None:
        yield " .\n"


SELECT_FORMATS = {"application/sparql-results+json": _json, "application/sparql-results+xml": _xml, "text/csv": _csv, "text/tab-separated-values": _tsv}
GRAPH_FORMATS = {"application/n-triples": _ntriples, "text/turtle": _turtle}


def serialize(df: DataFrame, as_: str, capability: Capability, max_rows: int | None = None, max_bytes: int | None = None, graph: bool = False) -> str:
    """The whole answer in a format, or a refusal that names the bound; rows arrive partition by partition.

    Answers are bounded, so they may pass the driver; whole tables are written with ``df.write``.
    """
    formats = GRAPH_FORMATS if graph else SELECT_FORMATS
    if as_ not in formats:
        raise InvalidArgument("as", f"{as_} is none of {', '.join(sorted(formats))}")
    rows, size = bounds(capability, max_rows, max_bytes)
    parts, used = [], 0

    def counted():
        for i, row in enumerate(df.limit(rows + 1).toLocalIterator()):
            if i >= rows:
                raise OverBudget(f"refused: the answer has more than {rows} rows")
            yield tuple(row)

    for part in formats[as_](df.columns, counted()):
        used += len(part.encode())
        if used > size:
            raise OverBudget(f"refused: the answer has more than {size} bytes")
        parts.append(part)
    return "".join(parts)


def serialize_ask(answer: bool, as_: str = "application/sparql-results+json") -> str:
    if as_ == "application/sparql-results+json":
        return json.dumps({"head": {}, "boolean": answer})
    if as_ == "application/sparql-results+xml":
        return f'<?xml version="1.0"?><sparql xmlns="http://www.w3.org/2005/sparql-results#"><head/><boolean>{str(answer).lower()}</boolean></sparql>'
    raise InvalidArgument("as", "an ASK is answered in JSON or XML")
