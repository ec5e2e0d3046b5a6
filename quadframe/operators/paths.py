"""Property paths over edges (s, o).  Steps, sequences and alternatives are bags; ``? + *`` are sets of pairs."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .solutions import union


def step(quads: DataFrame, predicate: str) -> DataFrame:
    return quads.where(F.col("p") == predicate).select("s", "o")


def inverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("o").alias("s"), F.col("s").alias("o"))


def sequence(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.withColumnRenamed("o", "__m").join(b.withColumnRenamed("s", "__m"), "__m").select("s", "o")


def alternative(*paths: DataFrame) -> DataFrame:
    return union(*paths)


def negated(quads: DataFrame, forward: Sequence[str] = (), backward: Sequence[str] = ()) -> DataFrame:
    """``!(p | ^q)``: edges of other predicates; the backward half only where it is named."""
    parts = []
    if forward or not backward:
        parts.append(quads.where(~F.col("p").isin(*forward)).select("s", "o"))
    if backward:
        parts.append(inverse(quads.where(~F.col("p").isin(*backward)).select("s", "o")))
    return union(*parts)


def nodes(quads: DataFrame) -> DataFrame:
    """All subjects and objects of the active graph."""
    return quads.select(F.col("s").alias("n")).union(quads.select("o")).distinct()


def _same(nodes_: DataFrame) -> DataFrame:
    return nodes_.select(F.col("n").alias("s"), F.col("n").alias("o"))


def zero_or_one(edges: DataFrame, nodes_: DataFrame) -> DataFrame:
    return union(edges, _same(nodes_)).distinct()


#: Jumps of a length are kept while there are at most so many for each edge.
GROWTH = 4


def jumps(edges: DataFrame, most: int | None = None) -> tuple[list[DataFrame], bool]:
    """Pairs that a walk of 1, 2, 4, ... edges joins, a table for each length, and whether these are all that there are.

    A chain, a tree towards its root or a ring has no more jumps of any length than edges, so a path of any length is a few jumps.  In a dense graph
    they would be very many and its paths are short: lengths end where the number of pairs, known from the degrees before they are made, is over GROWTH for each edge.
    No path without a repeated node has more than ``most`` nodes; that is all nodes, if nothing less is known.
    """
    most, size = most or nodes(edges.select("s", "o")).count(), edges.count()
    levels = [edges]
    while 1 << len(levels) <= most:
        last = levels[-1]
        ways = last.groupBy(F.col("o").alias("m")).count().join(last.groupBy(F.col("s").alias("m")).agg(F.count("*").alias("n")), "m")
        pairs = ways.agg(F.sum(F.col("count").cast("decimal(38,0)") * F.col("n"))).first()[0]
        if not pairs:
            return levels, True
        if pairs > GROWTH * size:
            return levels, False
        levels.append(written(sequence(last, last).distinct(), "jumps"))
    return levels, True


def _from(found: DataFrame, levels: list[DataFrame], whole: bool) -> DataFrame:
    """``found`` pairs (s, o) and all that edges lead on to, by the longest jumps first; one pass if the jumps are all that there are."""
    parts, fresh = [found], [found]
    while True:
        made = []
        for level in reversed(levels):
            new = written(sequence(union(*fresh, *made), level).distinct().join(union(*parts), ["s", "o"], "left_anti"), "paths")
            if not new.isEmpty():
                made.append(new)
                parts.append(new)
        if whole or not made:
            return union(*parts)
        fresh = made


def one_or_more(edges: DataFrame, starts: DataFrame | None = None, ends: DataFrame | None = None, cycles: bool = False) -> DataFrame:
    """Pairs connected by at least one edge; ``starts`` or ``ends`` (column n) bounds where paths begin or end.

    From bound ends, pairs are extended by jumps of 2^i edges, so the rounds grow with the logarithm of the longest path where the graph is made of chains,
    trees or rings, and with its hops where it is dense.  Without them a round joins the pairs that the last one found with all found so
    far, which doubles the length that is covered.  Each round writes only what it found.

    With ``cycles`` the closure is that of the strongly connected components, and pairs of nodes are made from it at the end; see ``reach``.
    """
    edges = written(edges.select("s", "o").distinct(), "edges")
    if starts is not None:
        first = written(edges.join(starts.select(F.col("n").alias("s")).distinct(), "s", "left_semi"), "paths")
        found = _from(first, *jumps(edges))
        return found if ends is None else found.join(ends.select(F.col("n").alias("o")).distinct(), "o", "left_semi").select("s", "o")
    if ends is not None:
        return inverse(one_or_more(inverse(edges), ends))
    if cycles:
        return expand(*reach(edges))
    parts, fresh = [edges], edges
    while True:
        known = union(*parts)
        fresh = written(sequence(fresh, known).distinct().join(known, ["s", "o"], "left_anti"), "paths")
        if fresh.isEmpty():
            return known
        parts.append(fresh)


def _numbers(seed: int, *ends: str) -> list[Column]:
    """64 bits of terms; see ``_numbered`` for terms that share them."""
    return [F.xxhash64(F.lit(seed), end) for end in ends]


def _parents(links: DataFrame) -> DataFrame:
    """v, p, over: the smallest of each node of (a, b) and its neighbours, and by how much more links leave it than enter it."""
    both = links.select(F.col("a").alias("v"), F.col("b").alias("w"), F.lit(1).alias("d")).union(links.select("b", "a", F.lit(-1)))
    return both.groupBy("v").agg(F.least("v", F.min("w")).alias("p"), F.sum("d").alias("over"))


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links (a, b) of numbers, the names (v, n) of these, and their ``_parents``.

    Rounds on numbers move far less than those on terms.  Two terms of one number are seen by the counts, and all are numbered anew.
    """
    edges = written(edges.select("s", "o").where("s IS NOT NULL AND o IS NOT NULL"), "edges")
    for seed in itertools.count():
        links = edges.select(*[x.alias(y) for x, y in zip(_numbers(seed, "s", "o"), "ab")])
        parents = written(_parents(links), "parents")
        ends = edges.select(F.col("s").alias("n")).union(edges.select("o")).select(_numbers(seed, "n")[0].alias("v"), "n")
        names = written(ends.repartition("v").distinct(), "names")
        if names.count() == parents.count():
            return links, names, parents


def _joined(links: DataFrame, parents: DataFrame) -> DataFrame:
    """v, c: the node that names the component of each, directions aside.

    A round takes every node to the parent of its parent and keeps the links between different ones; each component loses its largest node at least, and, as numbers are
    hashes, most of its nodes, so that the rounds grow with the logarithm of its size and their work falls by a factor.
    """
    steps, parents = [], parents.select("v", "p")
    while True:
        steps.append(written(parents.join(parents.select(F.col("v").alias("p"), F.col("p").alias("c")), "p").select("v", "c"), "step"))
        to = lambda end: steps[-1].select(F.col("v").alias(end), F.col("c").alias(f"c{end}"))
        links = written(links.where("a != b").join(to("a"), "a").join(to("b"), "b").where("ca != cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "joined")
        if links.isEmpty():
            break
        parents = written(_parents(links).select("v", "p"), "parents")
    labels = steps.pop()
    for step in reversed(steps):
        labels = written(step.join(labels.select(F.col("v").alias("c"), F.col("c").alias("up")), "c", "left").select("v", F.coalesce("up", "c").alias("c")), "labels")
    return labels


def _strong(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The names (v, n) of nodes, their strongly connected component (v, c), and pairs (s, o) of components that an edge joins, inside one or from one to another.

    A component, directions aside, of which every node is left as often as it is entered has a walk through all of its edges (Euler), so it is a strongly connected one: rings are
    done.  Only the others are searched.
    """
    links, names, parents = _numbered(edges)
    labels, uneven = _joined(links, parents), parents.where("over != 0").select("v")
    if uneven.isEmpty():
        return names, labels, labels.where("v = c").select(F.col("c").alias("s"), F.col("c").alias("o"))
    open_ = written(labels.join(uneven, "v", "left_semi").select("c").distinct(), "open")
    apart = written(labels.join(open_, "c", "left_semi").select("v", "c"), "apart")
    rest = written(links.distinct().join(apart.select(F.col("v").alias("a")), "a", "left_semi").toDF("s", "o"), "rest")
    found = _colored(rest, apart.groupBy("c").count().agg(F.max("count")).first()[0])
    of = lambda end: found.select(F.col("n").alias(end), F.col("component").alias(f"c{end}"))
    ends = rest.join(of("s"), "s").join(of("o"), "o").select("cs", "co").distinct()
    done = labels.join(open_, "c", "left_anti").select("v", "c")
    return names, written(done.union(found), "labels"), written(done.where("v = c").select("c", "c").union(ends).toDF("s", "o"), "ends")


def _colored(edges: DataFrame, most: int) -> DataFrame:
    """n, component of distinct edges, no path of which has more than ``most`` nodes.

    Forward-backward colouring: the largest priority (a hash, so that no order of names is a bad one) that reaches a node is its colour; the
    nodes of a colour that reach the node it comes from are that one's component, and the rest goes on with the edges inside colours.  Both searches run by jumps.
    """
    every, found = written(nodes(edges), "nodes"), []
    live = written(edges.where(F.col("s") != F.col("o")), "live")
    while not live.isEmpty():
        color = written(nodes(live).withColumn("c", F.struct(F.xxhash64("n").alias("h"), F.col("n").alias("root"))), "color")
        levels, whole = jumps(live, most)
        while True:
            before = color
            for level in reversed(levels):
                reached = level.join(color.select(F.col("n").alias("s"), "c"), "s").select(F.col("o").alias("n"), "c")
                color = written(color.union(reached).groupBy("n").agg(F.max("c").alias("c")), "color")
            if whole or color.exceptAll(before).isEmpty():
                break
        of = lambda end: color.select(F.col("n").alias(end), F.col("c.root").alias(f"c{end}"))
        inside = written(live.join(of("s"), "s").join(of("o"), "o").where("cs = co").select("s", "o"), "inside")
        roots = color.where("c.root = n").select(F.col("n").alias("s"), F.col("n").alias("o"))
        own = written(_from(written(roots, "roots"), *jumps(inverse(inside), most)) if not inside.isEmpty() else roots, "component")
        found.append(own.select(F.col("o").alias("n"), F.col("s").alias("component")))
        left = color.select("n").join(found[-1].select("n"), "n", "left_anti")
        live = written(inside.join(left.select(F.col("n").alias("s")), "s", "left_semi").join(left.select(F.col("n").alias("o")), "o", "left_semi"), "live")
    if not found:
        return every.withColumn("component", F.col("n"))
    return written(every.join(union(*found), "n", "left").withColumn("component", F.coalesce("component", "n")), "components")


def components(edges: DataFrame) -> DataFrame:
    """n, component: the strongly connected component of each node, named by one of its nodes."""
    names, labels, _ = _strong(edges)
    first = names.select(F.col("v").alias("c"), F.col("n").alias("component"))
    return written(names.join(labels, "v").select("n", "c").join(first, "c").select("n", "component"), "components")


def reach(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(n, component) of each node and (s, o) of components: which leads to which by at least one edge, itself where it has one inside.

    A ring of any size is one component and one pair; ``expand`` makes the pairs of nodes of it.  Components are numbers here.
    """
    names, labels, ends = _strong(edges)
    of = written(names.join(labels, "v").select("n", F.col("c").alias("component")), "components")
    return of, union(one_or_more(ends.where("s != o")), ends.where("s = o")).distinct()


def expand(of: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs of nodes of pairs of components."""
    named = lambda end: of.select(F.col("n").alias(f"n{end}"), F.col("component").alias(end))
    return pairs.join(named("s"), "s").join(named("o"), "o").select(F.col("ns").alias("s"), F.col("no").alias("o"))


def zero_or_more(edges: DataFrame, nodes_: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    own = nodes_ if starts is None else starts
    return union(one_or_more(edges, starts), _same(own)).distinct()
