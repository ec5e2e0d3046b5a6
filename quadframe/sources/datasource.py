"""``spark.read.format("nquads")`` and ``df.write.format("nquads")``: a Python data source over byte ranges of N-Quads files.

``read_nquads`` is faster, as it stays in Spark's text scan and expressions; this is for ``format`` and for filters on g, s, p or o,
which lines are tested against before they become rows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNull, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.bindings import XSD
from ..functions.triples import DEPTH

SCHEMA = "g string, s string, p string, o string"
#: Bytes of a partition, and rows of an Arrow batch.
RANGE, ROWS = 64 << 20, 10_000

_IRI = r"<[^\x00-\x20<>\"{}|^`\\]*>"
_BLANK = r"_:\w(?:[\w.-]*[\w-])?"
_LITERAL = rf'"(?:[^"\\\n\r]|\\[tbnrf"\'\\]|\\u[0-9A-Fa-f]{{4}}|\\U[0-9A-Fa-f]{{8}})*"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*(?:--(?:ltr|rtl))?|\^\^{_IRI})?'
_HEAD = rf"<<\(\s*({_IRI}|{_BLANK})\s*({_IRI})\s*"
_OBJECT = rf"((?:<<\(\s*(?:{_IRI}|{_BLANK})\s*{_IRI}\s*)*)({_IRI}|{_BLANK}|{_LITERAL})((?:\s*\)>>)*)"
_LINE = re.compile(rf"\s*({_IRI}|{_BLANK})\s*({_IRI})\s*({_OBJECT})\s*({_IRI}|{_BLANK})?\s*\.\s*(?:#.*)?\Z")
_EMPTY = re.compile(r"\s*(#.*)?\Z")
_NUMERIC_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})")
_PARTS = re.compile(r'"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?\Z', re.S)
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t"}


def _number(text: str, point: bool) -> str:
    sign, digits = ("-" if text.startswith("-") else ""), text.lstrip("+-")
    before, _, after = digits.partition(".")
    before, after = before.lstrip("0") or "0", after.rstrip("0")
    sign = sign if before != "0" or after else ""
    return f"{sign}{before}.{after or '0'}" if point else f"{sign}{before}"


def canonical_term(term: str) -> str:
    """The canonical text of a term, as ``nquads.canonical`` makes it of a column."""
    m = _PARTS.match(term)
    if not m or (m[2] is None and m[3] is None and "\\" not in term):
        return term
    text, kind = re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], "\\" + e[1] if e[1] in "bf'" else e[1]), m[1], flags=re.S), m[3]
    quoted = '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'
    if m[2]:
        return f"{quoted}@{m[2].lower()}"
    if kind in (None, XSD + "string"):
        return quoted
    local = kind.removeprefix(XSD)
    if local == "integer" and re.fullmatch(r"[+-]?[0-9]+", text):
        text = _number(text, False)
    elif local == "decimal" and re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)", text):
        text = _number(text, True)
    elif local == "boolean" and text in ("0", "1"):
        text = "true" if text == "1" else "false"
    elif local == "dateTime" and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.0+(Z|[+-]\d\d:\d\d)?", text):
        text = re.sub(r"\.0+", "", text)
    else:
        return term
    return f'"{text}"^^<{kind}>'


def parse_line(line: str) -> tuple[str | None, str, str, str] | None:
    """(g, s, p, o) of a statement, None of a blank line or comment; anything else raises."""
    line = line.rstrip("\r\n")
    if _EMPTY.match(line):
        return None
    if "\\u" in line or "\\U" in line:
        line = _NUMERIC_ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)), line)
    m = _LINE.match(line)
    if not m:
        raise ValueError("a line is no N-Quads statement")
    levels = m[4].count("<<(")
    if levels != m[6].count(")>>"):
        raise ValueError("a line is no N-Quads statement")
    if levels > DEPTH:
        raise ValueError(f"refused: a triple term has more than {DEPTH} levels")
    return m[7], m[1], m[2], re.sub(_HEAD, r"<<( \1 \2 ", m[4]) + canonical_term(m[5]) + " )>>" * levels


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int | None


class NQuadsReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.wanted = path, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality, IN and IS NULL of one column are tested here; Spark keeps the others."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            values = {EqualTo: lambda f: {f.value}, EqualNullSafe: lambda f: {f.value}, In: lambda f: set(f.value), IsNull: lambda f: {None}}.get(type(f))
            if name is None or values is None or (isinstance(f, (EqualTo, In)) and None in values(f)):
                yield f
            else:
                self.wanted[name] = self.wanted.get(name, values(f)) & values(f)

    def partitions(self) -> list[InputPartition]:
        files, at = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        info = files.get_file_info(at)
        every = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(at, recursive=True))
        out = []
        for x in every:
            if x.type != fs.FileType.File or x.base_name.startswith(("_", ".")):
                continue
            packed = x.base_name.endswith((".gz", ".bz2", ".zst", ".lz4"))
            out += [Range(x.path, 0, None)] if packed else [Range(x.path, i, min(i + RANGE, x.size)) for i in range(0, x.size, RANGE)]
        return out

    def _lines(self, part: Range) -> Iterator[str]:
        """Lines that start inside the range."""
        files = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        if part.end is None:
            with files.open_input_stream(part.path) as f:
                tail = b""
                while block := f.read(1 << 20):
                    *lines, tail = (tail + block).split(b"\n")
                    yield from (x.decode() for x in lines)
                yield tail.decode()
            return
        with files.open_input_file(part.path) as f:
            f.seek(max(0, part.start - 1))
            at, tail, skip = f.tell(), b"", part.start > 0
            while at < part.end:
                block = f.read(1 << 20)
                *lines, tail = (tail + block).split(b"\n") if block else (tail,)
                if not block and not lines:
                    lines, tail = [tail], b""
                for x in lines:
                    # the line that a range starts in, even at its last character, belongs to the one before
                    if not skip and at < part.end:
                        yield x.decode()
                    skip, at = False, at + len(x) + 1
                if not block:
                    break

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        places, rows = {c: i for i, c in enumerate("gspo")}, []
        tests = [(places[c], v) for c, v in self.wanted.items()]
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*rows)], names=list("gspo"))
        for line in self._lines(partition):
            quad = parse_line(line)
            if quad and all(quad[i] in v for i, v in tests):
                rows.append(quad)
                if len(rows) == ROWS:
                    yield batch()
                    rows.clear()
        if rows:
            yield batch()


@dataclass
class Part(WriterCommitMessage):
    name: str


class NQuadsWriter(DataSourceWriter):
    """A file per task under a hidden name; the commit renames those of the tasks that count."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def _files(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator) -> Part:
        files, at = self._files()
        files.create_dir(at)
        name = f"part-{uuid.uuid4().hex}.nq"
        with files.open_output_stream(f"{at}/_{name}") as f:
            for r in iterator:
                f.write(f"{r.s} {r.p} {r.o}{' ' + r.g if r.g else ''} .\n".encode())
        return Part(name)

    def commit(self, messages: list[Part | None]) -> None:
        files, at = self._files()
        if self.overwrite:
            for x in files.get_file_info(fs.FileSelector(at, allow_not_found=True)):
                if x.type == fs.FileType.File and not x.base_name.startswith("_"):
                    files.delete_file(x.path)
        for m in messages:
            if m:
                files.move(f"{at}/_{m.name}", f"{at}/{m.name}")

    def abort(self, messages: list[Part | None]) -> None:
        files, at = self._files()
        for m in messages:
            if m:
                files.delete_file(f"{at}/_{m.name}")


class NQuads(DataSource):
    """format("nquads"): ``load`` or ``save`` takes the path.  A repeated statement is a repeated row; use distinct for a set."""

    @classmethod
    def name(cls) -> str:
        return "nquads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> NQuadsReader:
        return NQuadsReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> NQuadsWriter:
        return NQuadsWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make ``format("nquads")`` known to a session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NQuads)
