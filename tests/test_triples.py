"""Triple terms: made, taken apart, matched, loaded, written, and refused beyond 64 levels; literals with a direction."""

import json

import pytest
from pyspark.sql import functions as F

from quadframe.functions import terms as T
from quadframe.functions import triples
from quadframe.operators import patterns, results
from quadframe.operators.datasets import Capability
from quadframe.sources import nquads


def nested(levels, inner='"a )>> b"'):
    return "<<( <urn:s> <urn:p> " * levels + inner + " )>>" * levels


def test_parts_and_depth(spark):
    rows = [nested(1), nested(3), nested(64), '"<<( x )>>"', "<urn:a>", "_:b", None]
    df = spark.createDataFrame([(x,) for x in rows], "t string")
    t = F.col("t")
    found = df.select(triples.depth(t), triples.is_triple(t), triples.subject(t), triples.predicate(t), triples.object_(t)).collect()
    assert [r[0] for r in found] == [1, 3, 64, 0, 0, 0, None]
    assert [r[1] for r in found] == [True, True, True, False, False, False, None]
    assert [tuple(r[2:]) for r in found[:3]] == [("<urn:s>", "<urn:p>", x) for x in ('"a )>> b"', nested(2), nested(63))]
    assert all(tuple(r[2:]) == (None, None, None) for r in found[3:])
    same = df.where(triples.is_triple(t)).select(triples.triple(triples.subject(t), triples.predicate(t), triples.object_(t)).alias("u"), "t")
    assert same.where("u = t").count() == 3


def test_what_is_no_triple(spark):
    rows = [("<urn:s>", "<urn:p>", None), ('"s"', "<urn:p>", '"o"'), ("<urn:s>", "_:p", '"o"'), (nested(1), "<urn:p>", '"o"'), (None, "<urn:p>", '"o"'), ("_:s", "<urn:p>", '"o"')]
    df = spark.createDataFrame(rows, "s string, p string, o string")
    assert [r[0] for r in df.select(triples.triple(F.col("s"), F.col("p"), F.col("o"))).collect()] == [None] * 5 + ['<<( _:s <urn:p> "o" )>>']
    deep = spark.createDataFrame([(nested(64),)], "t string").select(triples.triple(F.lit("<urn:s>"), F.lit("<urn:p>"), F.col("t")))
    with pytest.raises(Exception, match="more than 64 levels"):
        deep.collect()


def test_load(spark):
    lines = ['<urn:a> <urn:says> <<(_:x<urn:p>  "01"^^<http://www.w3.org/2001/XMLSchema#integer>)>> <urn:g> .', f"_:x <urn:says> {nested(64)} .", '<urn:a> <urn:p> "x"@EN--rtl .']
    found = {r.s: (r.g, r.o) for r in nquads.parse_lines(spark.createDataFrame([(x,) for x in lines[:2]], "value string"), document="d").collect()}
    assert found == {"<urn:a>": ("<urn:g>", '<<( _:d_x <urn:p> "1"^^<http://www.w3.org/2001/XMLSchema#integer> )>>'), "_:d_x": (None, nested(64))}
    one = nquads.parse_lines(spark.createDataFrame([(lines[2],)], "value string")).select("o", T.lang(F.col("o")), T.datatype(F.col("o")), triples.langdir(F.col("o")), triples.has_langdir(F.col("o"))).first()
    assert tuple(one) == ('"x"@en--rtl', "en", T.RDF + "dirLangString", "rtl", True)
    for bad in (f"<urn:a> <urn:p> {nested(65)} .", f"<urn:a> <urn:p> {nested(200)} .", '<urn:a> <urn:p> <<( <urn:s> <urn:p> "x" .', "<urn:a> <urn:p> <urn:o> )>> .", "<<( <urn:s> <urn:p> <urn:o> )>> <urn:p> <urn:o> ."):
        with pytest.raises(Exception, match="64 levels|no N-Quads statement"):
            nquads.parse_lines(spark.createDataFrame([(bad,)], "value string")).collect()


def test_the_source_reads_lines_as_the_loader_does(spark):
    from quadframe.sources import datasource

    lines = ['<urn:a> <urn:p> <<(_:x<urn:p>  "01"^^<http://www.w3.org/2001/XMLSchema#integer>)>> <urn:g> .', f"_:x <urn:p> {nested(64)} .", '<urn:a> <urn:p> "x"@EN--rtl .', "<urn:a> <urn:p> <urn:b> ."]
    want = {tuple(r) for r in nquads.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert {datasource.parse_line(x) for x in lines} == want
    for bad in (f"<urn:a> <urn:p> {nested(65)} .", "<urn:a> <urn:p> <urn:o> )>> .", '<urn:a> <urn:p> <<( <urn:s> <urn:p> "x" .'):
        with pytest.raises(ValueError, match="64 levels|no N-Quads statement"):
            datasource.parse_line(bad)


def test_match_and_write(spark):
    rows = [("<urn:r1>", nested(2, "<urn:o>")), ("<urn:r2>", '<<( <urn:s> <urn:q> <urn:r2> )>>'), ("<urn:r3>", '"x"@en--ltr')]
    quads = spark.createDataFrame([(None, s, "<urn:says>", o) for s, o in rows], "g string, s string, p string, o string")
    found = patterns.match(quads, "?r", "<urn:says>", "?t")
    once = patterns.triple_term(found, "?t", "?s", "<urn:p>", "?u")
    assert [tuple(r) for r in patterns.triple_term(once, "?u", "?s", None, "?v").select("r", "v").collect()] == [("<urn:r1>", "<urn:o>")]
    assert [r.r for r in patterns.triple_term(found, "?t", None, None, "?r").collect()] == ["<urn:r2>"]
    text = results.serialize(found.where("r <> '<urn:r2>'").orderBy("r"), "application/sparql-results+json", Capability.of("root"))
    made = [x["t"] for x in json.loads(text)["results"]["bindings"]]
    inner = {"type": "triple", "value": {"subject": {"type": "uri", "value": "urn:s"}, "predicate": {"type": "uri", "value": "urn:p"}, "object": {"type": "uri", "value": "urn:o"}}}
    assert made[0]["value"]["object"] == inner and made[1] == {"type": "literal", "value": "x", "xml:lang": "en", "its:dir": "ltr"}
    xml = results.serialize(found.where("r = '<urn:r2>'"), "application/sparql-results+xml", Capability.of("root"))
    assert "<triple><subject><uri>urn:s</uri></subject><predicate><uri>urn:q</uri></predicate><object><uri>urn:r2</uri></object></triple>" in xml


def test_order_after_literals(spark):
    rows = [nested(1), '"a"', "<urn:a>", "_:b"]
    df = spark.createDataFrame([(x,) for x in rows], "t string")
    assert [r.t for r in df.orderBy(T.order_key(F.col("t"))).collect()] == rows[::-1]
