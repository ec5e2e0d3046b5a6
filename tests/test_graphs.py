"""Patterns, paths, datasets, updates, formats and budgets on small graphs."""

import gzip
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from quadframe.errors import Denied, InvalidArgument, OverBudget, Refused, Timeout
from quadframe.operators import budgets, datasets, paths, patterns, results, updates
from quadframe.operators import solutions as S
from quadframe.sources import nquads
from quadframe.streaming.loading import load_stream

QUADS = "g string, s string, p string, o string"
P, Q = "<urn:p>", "<urn:q>"


def quads(spark, *rows):
    return spark.createDataFrame([*rows], QUADS)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def node(i):
    return f"<urn:n{i}>"


@pytest.fixture(scope="module")
def ring(spark):
    edges = [(None, node(i), P, node(j)) for i in range(12) for j in {(i + 1) % 12, (7 * i + 3) % 12}]
    return quads(spark, *edges)


def test_bgp_against_nested_loops(spark):
    rng = random.Random(1)
    data = {(None, node(rng.randrange(6)), rng.choice([P, Q]), node(rng.randrange(6))) for _ in range(25)}
    df = quads(spark, *data)
    want = [(a[1], a[3], b[3]) for a in data for b in data for c in data if a[2] == P and b[2] == Q and c[2] == P and a[3] == b[1] and c[1] == b[3] and c[3] == a[1]]
    found = patterns.bgp(df, ("?x", P, "?y"), ("?y", Q, "?z"), ("?z", P, "?x")).select("x", "y", "z")
    assert rows(found) == sorted(want)


def test_unbound_variables(spark):
    a = S.values(spark, ["x", "y"], [("1", None), ("2", "b"), (None, "c")])
    b = S.values(spark, ["y", "z"], [("b", "B"), ("c", None)])
    assert rows(S.join(a, b, maybe=["y"])) == sorted([("1", "b", "B"), ("1", "c", None), ("2", "b", "B"), (None, "c", None)], key=str)
    assert rows(S.left_join(a, b, F.col("z") == "B", maybe=["y"])) == sorted([("1", "b", "B"), ("2", "b", "B"), (None, "c", None)], key=str)
    assert rows(S.minus(a, b, maybe=["y"])) == [("1", None)]
    assert rows(S.minus(a, S.values(spark, ["w"], [("1",)]))) == rows(a)
    assert rows(S.exists(a, S.values(spark, ["w"], [("1",)]), negated=True)) == []


def test_paths_against_plain_reachability(spark, ring):
    edges = paths.step(ring, P)
    direct = {(a, b) for a, b in rows(edges)}
    reach = set(direct)
    while more := {(a, d) for a, b in reach for c, d in direct if b == c} - reach:
        reach |= more
    assert set(rows(paths.one_or_more(edges))) == reach
    starts = spark.createDataFrame([(node(3),)], "n string")
    assert set(rows(paths.one_or_more(edges, starts))) == {x for x in reach if x[0] == node(3)}
    assert set(rows(paths.zero_or_more(edges, paths.nodes(ring)))) == reach | {(node(i), node(i)) for i in range(12)}


def test_scopes(spark):
    d = datasets.Dataset.of(quads(spark, ("<urn:a>", "<urn:s>", P, '"x"'), ("<urn:b>", "<urn:s>", P, '"x"'), (None, "<urn:s>", P, '"y"')))
    cap = datasets.Capability.of("read:graph:urn:a", "read:graph:urn:b")
    # a triple of two members matches twice, and nothing outside is seen
    assert rows(patterns.match(datasets.scoped(d, cap, "urn:b urn:a").default(), None, P, "?o")) == [('"x"',), ('"x"',)]
    for missing in (lambda: datasets.scoped(d, cap, "urn:a urn:c"), lambda: datasets.broad(d, cap), lambda: datasets.inside_only("urn:a", ["<urn:b>"])):
        with pytest.raises(Denied):
            missing()
    with pytest.raises(InvalidArgument):
        datasets.graph_set("urn:a,urn:b >")
    assert datasets.graph_set("urn:b\turn:a urn:b") == ("urn:a", "urn:b") and not cap.attenuated(["read:graph:urn:a"]).allows("read:graph:urn:b")
    assert rows(datasets.listed_graphs(d, datasets.Capability.of("read:graph:urn:b"))) == [("<urn:b>",)]


def test_updates(spark):
    d = datasets.Dataset.of(quads(spark, ("<urn:a>", "<urn:s>", P, '"x"'), (None, "<urn:s>", P, '"y"')))
    again = updates.insert_data(quads(spark, (None, "<urn:s>", P, '"y"'), (None, "<urn:s>", P, '"z"'), (None, "<urn:s>", P, '"z"')))(d)
    assert again.quads.count() == 3
    with_nothing = updates.modify(lambda x: patterns.match(x.default(), "?s", P, "?o").withColumn("nothing", F.lit(None).cast("string")), [("?s", P, "?o", None)], [("?o", P, "?s", None), ("?s", Q, "?o", None), ("?s", Q, "?nothing", None)])
    # a literal is no subject, an unbound variable makes no quad
    assert rows(with_nothing(d).quads) == sorted([("<urn:a>", "<urn:s>", P, '"x"'), (None, "<urn:s>", Q, '"y"')], key=str)
    moved = updates.chain(updates.move("<urn:a>", "<urn:c>"), updates.create("<urn:e>"), updates.copy("<urn:e>", "<urn:f>"))(d)
    assert rows(moved.graphs) == [("<urn:c>",), ("<urn:e>",), ("<urn:f>",)] and ("<urn:c>", "<urn:s>", P, '"x"') in rows(moved.quads)
    for bad in (updates.create("<urn:a>"), updates.drop("<urn:zz>"), updates.chain(updates.clear("ALL"), updates.move("<urn:zz>", "<urn:a>"))):
        with pytest.raises(Refused):
            bad(d)
    assert rows(updates.drop("<urn:zz>", silent=True)(d).quads) == rows(d.quads) and updates.clear("NAMED")(d).graphs.count() == 1


def test_confined_updates(spark):
    d = datasets.Dataset.of(quads(spark, ("<urn:a>", "<urn:s>", P, '"x"'), ("<urn:b>", "<urn:s>", P, '"y"')))
    writer = datasets.Capability.of("write:graph:urn:a")
    reader = datasets.Capability.of("write:graph:urn:a", "read:graph:urn:a")
    add = updates.insert_data(quads(spark, ("<urn:a>", "<urn:t>", P, '"n"')))
    after, receipt = updates.confined_update(d, add, reader, "urn:a")
    assert receipt.text == "updated urn:a: +1 -0 quads" and after.quads.count() == 3
    assert updates.confined_update(d, add, writer, "urn:a")[1].text == "updated urn:a"
    # CLEAR ALL is confined to the graph
    assert rows(updates.confined_update(d, updates.clear("ALL"), reader, "urn:a")[0].quads) == [("<urn:b>", "<urn:s>", P, '"y"')]
    with pytest.raises(Denied):
        updates.confined_update(d, updates.insert_data(quads(spark, ("<urn:b>", "<urn:t>", P, '"n"'))), reader, "urn:a")
    # a WHERE needs the read grant, whoever calls; CLEAR and DROP of another graph change nothing
    look = updates.modify(lambda x: patterns.match(x.named(), "?s", P, "?o"), [("?s", P, "?o", "<urn:a>")])
    for operation in (look, updates.chain(add, look)):
        with pytest.raises(Denied):
            updates.confined_update(d, operation, writer, "urn:a")
        with pytest.raises(Denied):
            updates.update(d, operation, datasets.Capability.of("write"))
    for operation in (updates.drop("<urn:b>"), updates.clear("<urn:b>"), updates.chain(updates.drop("<urn:b>"), updates.clear("<urn:zz>"))):
        assert updates.confined_update(d, operation, reader, "urn:a")[1].text == "updated urn:a: +0 -0 quads"
    for operation in (updates.drop("<urn:zz>"), updates.clear("<urn:zz>"), updates.create("<urn:a>")):
        assert rows(updates.update(d, operation, datasets.Capability.of("write"))[0].quads) == rows(d.quads)
        with pytest.raises(Refused):
            updates.update(d, operation, datasets.ROOT)
    with pytest.raises(OverBudget):
        updates.confined_update(d, add, reader, "urn:a", most=0)


def test_blank_nodes_of_a_template_are_fresh(spark):
    found = S.values(spark, ["x"], [("<urn:a>",), ("<urn:b>",), ("<urn:b>",)])
    made = rows(updates.instantiate(found, [("?x", P, "_:n"), ("_:n", Q, "?x"), ("_:n", Q, "_:m")]))
    nodes = {o for _, s, p, o in made if p == P}
    assert len(nodes) == 3 and {(s, o) for _, s, p, o in made if p == P} == {(o, s) for _, s, p, o in made if p == Q and o.startswith("<")}
    assert len({o for _, s, p, o in made if o.startswith("_:") and p == Q}) == 3


def test_long_paths(spark):
    edges = spark.createDataFrame([(node(i), node(i + 1)) for i in range(70)], "s string, o string")
    assert paths.one_or_more(edges).count() == 70 * 71 // 2
    assert paths.one_or_more(edges.limit(0)).collect() == []


TEXT = """# comment
<urn:s> <urn:p> "a\\tb \\u00e9 \\"q\\""@EN .
_:x <urn:p> "01"^^<http://www.w3.org/2001/XMLSchema#integer> <urn:g> .
<urn:s> <urn:p> "x"^^<http://www.w3.org/2001/XMLSchema#string> . # note

_:x <urn:q> _:y .
<urn:s> <urn:p> "x" .
<urn:s> <urn:p> "1e"^^<http://www.w3.org/2001/XMLSchema#integer> .
"""


def test_nquads(spark, tmp_path):
    (tmp_path / "in.nq").write_text(TEXT, encoding="utf-8")
    found = nquads.read_nquads(spark, str(tmp_path / "in.nq"), document="d1")
    integer = "^^<http://www.w3.org/2001/XMLSchema#integer>"
    want = [(None, "<urn:s>", P, '"a\\tb é \\"q\\""@en'), ("<urn:g>", "_:d1_x", P, f'"1"{integer}'), (None, "<urn:s>", P, '"x"'), (None, "_:d1_x", Q, "_:d1_y"), (None, "<urn:s>", P, f'"1e"{integer}')]
    assert rows(found) == sorted(want, key=str)
    nquads.dump(found, str(tmp_path / "out"))
    assert rows(nquads.read_nquads(spark, str(tmp_path / "out"))) == sorted(want, key=str)
    dumped = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "out").glob("part-*"))).splitlines()
    assert len(dumped) == 5 and dumped[-1].endswith("<urn:g> .") and dumped[:4] == sorted(dumped[:4])
    (tmp_path / "bad.nq").write_text("<urn:s> <urn:p> .\n")
    with pytest.raises(Exception, match="no N-Quads statement"):
        nquads.read_nquads(spark, str(tmp_path / "bad.nq")).collect()
    assert rows(nquads.read_nquads(spark, str(tmp_path / "in.nq"), graph="<urn:d>").where("g = '<urn:d>'").select("o"))[0] == ('"1e"' + integer,)


def test_stream_loads_each_file_once(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "table")
    source.mkdir()
    for text in ("<urn:a> <urn:p> <urn:b> .\n<urn:a> <urn:p> <urn:b> .\n", "<urn:a> <urn:p> <urn:b> .\n<urn:a> <urn:p> <urn:c> .\n"):
        (source / f"{time.time_ns()}.nt").write_text(text)
        load_stream(spark, str(source), target, str(tmp_path / "check")).awaitTermination()
    assert rows(spark.read.parquet(target).select("s", "p", "o")) == [("<urn:a>", P, "<urn:b>"), ("<urn:a>", P, "<urn:c>")]


def test_formats_and_bounds(spark):
    df = spark.createDataFrame([("<urn:a>", '"x,\\"y\\""@en'), (None, '"<1>"^^<urn:t>'), ("_:b", None)], "a string, b string").coalesce(1)
    root = datasets.ROOT
    found = json.loads(results.serialize(df, "application/sparql-results+json", root))
    assert found["results"]["bindings"] == [{"a": {"type": "uri", "value": "urn:a"}, "b": {"type": "literal", "value": 'x,"y"', "xml:lang": "en"}}, {"b": {"type": "literal", "value": "<1>", "datatype": "urn:t"}}, {"a": {"type": "bnode", "value": "b"}}]
    assert results.serialize(df, "text/csv", root) == 'a,b\r\nurn:a,"x,""y"""\r\n,<1>\r\n_:b,\r\n'
    assert results.serialize(df, "text/tab-separated-values", root).splitlines()[1] == '<urn:a>\t"x,\\"y\\""@en'
    assert "<literal>" not in results.serialize(df, "application/sparql-results+xml", root) and "&lt;1&gt;" in results.serialize(df, "application/sparql-results+xml", root)
    size = len(results.serialize(df, "text/csv", root, max_rows=3).encode())
    results.serialize(df, "text/csv", root, max_bytes=size)
    for more in ({"max_rows": 2}, {"max_bytes": size - 1}):
        with pytest.raises(OverBudget):
            results.serialize(df, "text/csv", root, **more)
    for bad in ({"max_rows": 0}, {"max_rows": True}, {"max_bytes": "9"}):
        with pytest.raises(InvalidArgument):
            results.serialize(df, "text/csv", root, **bad)
    with pytest.raises(InvalidArgument):
        results.serialize(df, "text/html", root)
    assert results.bounds(datasets.Capability.of("answer:200000"), max_rows=10**9) == (200_000, results.BYTES)


def test_time_budget(spark):
    assert budgets.within(spark, 60_000, lambda: spark.range(10).count()) == 10
    slow = spark.range(10**9).repartition(4).select(F.sha2(F.col("id").cast("string"), 512).alias("x")).groupBy("x").count()
    began = time.time()
    with pytest.raises(Timeout):
        budgets.within(spark, 1500, slow.count)
    assert time.time() - began < 30
    assert budgets.effective(datasets.Capability.of("budget:9000"), 20_000) == 9000 and budgets.effective(datasets.Capability(), 100) == 100
    with pytest.raises(InvalidArgument):
        budgets.effective(datasets.ROOT, -1)


def test_describe_follows_blank_nodes(spark):
    df = quads(spark, (None, "<urn:a>", P, "_:b"), (None, "_:b", Q, '"x"'), (None, "<urn:z>", P, '"no"'), ("<urn:g>", "<urn:a>", P, '"other graph"'))
    assert rows(results.describe(df, spark.createDataFrame([("<urn:a>",)], "n string"))) == sorted([("<urn:a>", P, "_:b"), ("_:b", Q, '"x"')])


def test_describe_follows_long_lists_and_cycles(spark):
    chain = [(None, f"_:l{i}", P, f"_:l{i + 1}") for i in range(7)] + [(None, "_:l7", P, "_:l2"), (None, "_:l7", Q, '"end"')]
    df = quads(spark, (None, "<urn:a>", P, "_:l0"), *chain, (None, "_:other", P, '"no"'))
    assert rows(results.describe(df, spark.createDataFrame([("<urn:a>",)], "n string"))) == sorted([("<urn:a>", P, "_:l0"), *(r[1:] for r in chain)], key=str)


def test_load_and_info(spark):
    d = datasets.Dataset.of(quads(spark, ("<urn:a>", "<urn:s>", P, '"x"')))
    more = quads(spark, ("<urn:a>", "<urn:s>", P, '"x"'), (None, "<urn:s>", P, '"y"'), (None, "<urn:s>", P, '"y"'))
    after, receipt = updates.load(d, more, datasets.Capability.of("write", "read"))
    assert receipt.text == "loaded application/n-quads: +1 quads" and after.quads.count() == 2
    assert updates.load(d, more, datasets.Capability.of("write"))[1].text == "loaded application/n-quads"
    assert datasets.info(after, datasets.ROOT) == "quads 2\ndefault 1\ngraphs 1\n"
    assert datasets.graph_info(after, datasets.Capability.of("read:graph:urn:a"), "urn:a") == "graph urn:a\nexists true\nquads 1\n"
    with pytest.raises(Denied):
        datasets.graph_info(after, datasets.Capability.of("read"), "urn:a")
    with pytest.raises(Denied):
        updates.load(d, more, datasets.Capability.of("read"))


def test_joins_on_unbound_variables_by_plain_versions(spark):
    left = [(x, y, f"{x}{y}") for x in (None, "1", "2") for y in (None, "1", "3")]
    right = [(x, y, f"{x}{y}") for x in (None, "1", "3") for y in (None, "1", "2")]
    a = spark.createDataFrame(left, "x string, y string, p string")
    b = spark.createDataFrame(right, "x string, y string, q string")

    def fits(r, s):
        return all(u is None or v is None or u == v for u, v in zip(r[:2], s[:2]))

    def overlaps(r, s):
        return any(u is not None and v is not None for u, v in zip(r[:2], s[:2]))

    met = {(r[0] or s[0], r[1] or s[1], r[2], s[2]) for r in left for s in right if fits(r, s)}
    found = [tuple(r) for r in S.join(a, b, ["x", "y"]).select("x", "y", "p", "q").collect()]
    assert len(found) == len(met) and set(found) == met
    few = right[4:6]
    kept = {r for r in left if not any(fits(r, s) and overlaps(r, s) for s in few)}
    assert {tuple(r) for r in S.minus(a, spark.createDataFrame(few, b.schema), ["x", "y"]).collect()} == kept
    for some in (right, few, []):
        other = spark.createDataFrame(some, b.schema)
        for condition, holds in ((None, lambda r, s: True), (F.col("q") != "NoneNone", lambda r, s: s[2] != "NoneNone")):
            hit = [(r, [s for s in some if fits(r, s) and holds(r, s)]) for r in left]
            optional = [(r[0] or s[0], r[1] or s[1], r[2], s[2]) for r, found in hit for s in found] + [(*r, None) for r, found in hit if not found]
            assert rows(S.left_join(a, other, condition, ["x", "y"]).select("x", "y", "p", "q")) == sorted(optional, key=str)
            for negated in (False, True):
                assert rows(S.exists(a, other, condition, negated, ["x", "y"])) == sorted((r for r, found in hit if bool(found) != negated), key=str)
        assert rows(S.mark_exists(a, other, "e", ["x", "y"])) == sorted(((*r, any(fits(r, s) for s in some)) for r in left), key=str)


def test_optional_on_unbound_variables_has_no_nested_loop(spark):
    a = spark.createDataFrame([("1", None, "p")], "x string, y string, p string")
    b = spark.createDataFrame([("1", "2", "q")], "x string, y string, q string")
    for df in (S.left_join(a, b, F.col("p") != F.col("q"), ["y"]), S.exists(a, b, maybe=["y"]), S.mark_exists(a, b, "e", ["y"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_lateral_group(spark):
    left = S.values(spark, ["x", "n"], [("a", "1"), ("a", "2"), ("b", "1"), (None, "1")])
    right = spark.createDataFrame([("a", 1), ("a", 5), ("c", 7)], "x string, v int")
    found = S.lateral_group(left, right, {"n2": F.lit(0)}, n2=F.count("*"), top=F.max("v"))
    assert rows(found) == sorted([("a", "1", 2, 5), ("a", "2", 2, 5), ("b", "1", 0, None), (None, "1", 0, None)], key=str)


def test_turtle_reads_back(spark):
    triples = [("<urn:a>", P, '"x"'), ("<urn:a>", P, '"y"@en'), ("<urn:a>", Q, "_:b"), ("_:b", P, '"z"')]
    df = spark.createDataFrame(triples, "s string, p string, o string").coalesce(1)
    text = results.serialize(df, "text/turtle", datasets.ROOT, graph=True)
    assert text == f'<urn:a> {P} "x", "y"@en ;\n    {Q} _:b .\n_:b {P} "z" .\n'
    assert results.serialize(df.limit(0), "text/turtle", datasets.ROOT, graph=True) == ""


def test_load_bounds(spark, tmp_path):
    line = f'<urn:a> {P} "{"x" * 1000}" .\n'
    (tmp_path / "plain.nt").write_text(line)
    with gzip.open(tmp_path / "packed.nt.gz", "wt") as f:
        f.write(line * 2000)
    plain, packed = str(tmp_path / "plain.nt"), str(tmp_path / "packed.nt.gz")
    assert nquads.text_bytes(spark, plain) == (len(line), len(line))
    assert nquads.read_nquads(spark, plain, max_bytes=len(line), max_ratio=1).count() == 1
    assert nquads.read_nquads(spark, packed, max_bytes=len(line) * 2000).count() == 1
    for path, bounds in ((plain, {"max_bytes": len(line) - 1}), (packed, {"max_bytes": len(line)}), (packed, {"max_ratio": 50})):
        with pytest.raises(OverBudget):
            nquads.read_nquads(spark, path, **bounds)
