"""Paths against plain searches: chains, rings, dense graphs, components."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quadframe.operators import paths as P


def graph(spark, edges):
    return spark.createDataFrame([(str(a), str(b)) for a, b in edges], "s string, o string")


def plain_closure(edges):
    after: dict = {}
    for a, b in edges:
        after.setdefault(str(a), set()).add(str(b))
    out = set()
    for a in after:
        todo, seen = list(after[a]), set(after[a])
        while todo:
            for c in after.get(todo.pop(), ()):
                if c not in seen:
                    seen.add(c)
                    todo.append(c)
        out |= {(a, b) for b in seen}
    return out


def random_edges(n, m, seed):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


@pytest.mark.parametrize("edges", [random_edges(30, 25, 1), random_edges(25, 60, 2), [(i, (i + 1) % 9) for i in range(9)] + [(3, 20), (20, 21), (21, 20), (30, 30)], [(1, 2)]])
def test_closures_by_hand(spark, edges):
    want, df = plain_closure(edges), graph(spark, edges)
    pairs = lambda d: sorted(map(tuple, d.collect()))
    assert pairs(P.one_or_more(df)) == sorted(want) == pairs(P.one_or_more(df, cycles=True))
    some = sorted({str(a) for a, _ in edges})[:5]
    bound = spark.createDataFrame([(x,) for x in [*some, some[0], "none"]], "n string")
    assert pairs(P.one_or_more(df, bound)) == sorted(p for p in want if p[0] in some)
    assert pairs(P.one_or_more(df, ends=bound)) == sorted(p for p in want if p[1] in some)
    assert pairs(P.one_or_more(df, bound, bound)) == sorted(p for p in want if p[0] in some and p[1] in some)
    of = {r.n: r.component for r in P.components(df).collect()}
    names = {str(x) for e in edges for x in e}
    assert set(of) == names
    for a in names:
        for b in names:
            assert (of[a] == of[b]) == (a == b or ((a, b) in want and (b, a) in want))


def test_empty_graphs(spark):
    none = graph(spark, [(1, 2)]).limit(0)
    bound = spark.createDataFrame([("1",)], "n string")
    assert P.one_or_more(none).collect() == P.one_or_more(none, bound).collect() == P.one_or_more(none, cycles=True).collect() == P.components(none).collect() == []


def test_a_long_chain_takes_few_rounds(spark):
    df = graph(spark, [(i, i + 1) for i in range(500)])
    levels, whole = P.jumps(df)
    assert whole and len(levels) == 9
    began = time.time()
    found = P.one_or_more(df, spark.createDataFrame([("17",)], "n string"))
    assert found.count() == 483 and found.agg(F.max(F.col("o").cast("int"))).first()[0] == 500
    assert time.time() - began < 60


def test_a_large_ring_is_one_component(spark):
    n = 2_000
    df = spark.range(n).select(F.col("id").cast("string").alias("s"), ((F.col("id") + 1) % n).cast("string").alias("o"))
    of, pairs = P.reach(df)
    assert of.select("component").distinct().count() == 1 and pairs.count() == 1 and of.count() == n


def test_jumps_of_a_dense_graph_end(spark):
    df = graph(spark, {(a, b) for a in range(40) for b in range(40) if a != b})
    levels, whole = P.jumps(df)
    assert len(levels) == 1 and not whole


def test_many_rings_take_few_tables(spark, monkeypatch):
    """The rounds follow the largest ring, not the number of all nodes."""
    made, write = [], P.written
    monkeypatch.setattr(P, "written", lambda df, label, *more: made.append(label) or write(df, label, *more))
    sizes = [1 + i % 9 for i in range(600)]
    df = graph(spark, [(f"{i} {j}", f"{i} {(j + 1) % n}") for i, n in enumerate(sizes) for j in range(n)])
    found = P.components(df).groupBy("component").agg(F.count("*").alias("n"), F.min(F.split("n", " ")[0]).alias("a"), F.max(F.split("n", " ")[0]).alias("b")).collect()
    assert sorted((int(r.a), r.n) for r in found) == list(enumerate(sizes)) and all(r.a == r.b for r in found)
    assert len(made) < 40
    assert P.one_or_more(df, cycles=True).count() == sum(n * n for n in sizes)


@pytest.mark.parametrize("seed", [3, 4])
def test_rings_beside_other_graphs_by_hand(spark, seed):
    """Rings end as they are, what hangs on others or is no ring is searched; numbers that terms share are made anew."""
    rings = [(f"r{k}{i}", f"r{k}{(i + 1) % n}") for k, n in enumerate([1, 2, 5, 8, 3]) for i in range(n)]
    edges = [*rings, ("r20", "tail"), ("tail", "end"), ("lone", "lone"), ("x", "y"), ("y", "x"), ("x", "y"), *random_edges(12, 14, seed)]
    df, want = graph(spark, edges), plain_closure(edges)
    numbers = P._numbers
    P._numbers = lambda seed, *ends: [F.length(end).cast("long") for end in ends] if seed == 0 else numbers(seed, *ends)
    try:
        of = {r.n: r.component for r in P.components(df).collect()}
        assert sorted(map(tuple, P.one_or_more(df, cycles=True).collect())) == sorted(want)
    finally:
        P._numbers = numbers
    names = {str(x) for e in edges for x in e}
    assert set(of) == names and set(of.values()) <= names
    for a in names:
        for b in names:
            assert (of[a] == of[b]) == (a == b or ((a, b) in want and (b, a) in want))
