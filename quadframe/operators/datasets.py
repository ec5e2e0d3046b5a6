"""Datasets, capabilities and the scope of a request."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Denied, InvalidArgument


@dataclass(frozen=True)
class Capability:
    """What a caller may do: everything (root), or a set of exact grants.

    Grants: ``read``, ``write``, ``read:graph:<iri>``, ``write:graph:<iri>``, ``budget:<ms>``,
    ``answer:<rows>`` and ``answer:bytes:<n>``.  A whole-dataset grant does not stand for a graph's.
    """

    grants: frozenset[str] = frozenset()
    root: bool = False

    @staticmethod
    def of(*grants: str) -> Capability:
        return Capability(frozenset(grants))

    def allows(self, grant: str) -> bool:
        return self.root or grant in self.grants

    def attenuated(self, keep: Iterable[str]) -> Capability:
        """Only ever fewer grants."""
        kept = frozenset(keep)
        return Capability(kept if self.root else self.grants & kept)

    def require(self, *grants: str) -> None:
        for grant in grants:
            if not self.allows(grant):
                raise Denied(f"refused: the grant {grant} is missing")

    def numbers(self, prefix: str) -> list[int]:
        return [int(g[len(prefix) :]) for g in self.grants if g.startswith(prefix) and g[len(prefix) :].isdigit()]


ROOT = Capability(root=True)


def graph_set(text: str) -> tuple[str, ...]:
    """A list of graph IRIs, split at ASCII white space alone, sorted, each once."""
    found = sorted({x for x in re.split(r"[ \t\n\f\r]+", text) if x})
    if not found:
        raise InvalidArgument("graph", "it names no graph")
    for x in found:
        if re.search(r'[\x00-\x20<>"{}|\\^`]', x) or not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", x):
            raise InvalidArgument("graph", "it holds something that is no absolute IRI")
    return tuple(found)


@dataclass(frozen=True)
class Dataset:
    """Quads (g, s, p, o) with the default graph's g null, and the registered graphs (g), which may be empty."""

    quads: DataFrame
    graphs: DataFrame

    @staticmethod
    def of(quads: DataFrame, graphs: DataFrame | None = None) -> Dataset:
        named = quads.where("g IS NOT NULL").select("g").distinct()
        return Dataset(quads, named if graphs is None else graphs.select("g").union(named).distinct())

    def default(self) -> DataFrame:
        return self.quads.where("g IS NULL")

    def named(self) -> DataFrame:
        return self.quads.where("g IS NOT NULL")

    def graph(self, iri: str) -> DataFrame:
        return self.quads.where(F.col("g") == iri)


def view(dataset: Dataset, default: Sequence[str] | None = None, named: Sequence[str] | None = None) -> Dataset:
    """FROM and FROM NAMED: the default graph is the union of the graphs of ``default``.

    A triple in two of them matches twice (a bag), as each member is a part of the active graph.
    """
    inside = dataset.quads.where(F.col("g").isin(*(default or ()))).withColumn("g", F.lit(None).cast("string"))
    kept = dataset.quads.where(F.col("g").isin(*(named or ())))
    return Dataset(inside.unionByName(kept), dataset.graphs.where(F.col("g").isin(*(named or ()))))


def broad(dataset: Dataset, capability: Capability) -> Dataset:
    capability.require("read")
    return dataset


def scoped(dataset: Dataset, capability: Capability, graphs: str) -> Dataset:
    """A read of exactly these graphs; every one needs its own grant."""
    members = graph_set(graphs)
    capability.require(*[f"read:graph:{x}" for x in members])
    terms = [f"<{x}>" for x in members]
    return view(dataset, terms, terms)


def inside_only(scope: str, named: Iterable[str]) -> None:
    """Refuse constants of GRAPH, WITH or USING that lie outside the scope; never answer with fewer rows instead."""
    members = set(graph_set(scope))
    for x in named:
        if x.strip("<>") not in members:
            raise Denied(f"refused: the graph {x} is outside the scope of this request")


def listed_graphs(dataset: Dataset, capability: Capability) -> DataFrame:
    """The named graphs that exist and the caller may read, sorted; graphs named by blank nodes are not listed."""
    iris = dataset.graphs.where(F.col("g").startswith("<"))
    if not capability.allows("read"):
        own = [f"<{g.removeprefix('read:graph:')}>" for g in capability.grants if g.startswith("read:graph:")]
        if not own:
            raise Denied("refused: the grant read is missing")
        iris = iris.where(F.col("g").isin(*own))
    return iris.select("g").distinct().orderBy("g")


def graph_counts(dataset: Dataset) -> DataFrame:
    """g, quads: of every registered graph, empty ones too; summed before the shuffle."""
    counts = dataset.named().groupBy("g").agg(F.count("*").alias("quads"))
    return dataset.graphs.select("g").distinct().join(counts, "g", "left").select("g", F.coalesce("quads", F.lit(0)).alias("quads"))


#: A prime; sums of hashes are taken modulo it.
PRIME = (1 << 61) - 1


def _lanes(quads: DataFrame) -> list[Column]:
    """Two numbers of 60 bits of each quad's MD5."""
    md5 = F.md5(F.concat_ws(" ", "s", "p", "o"))
    return [F.conv(F.substring(md5, at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 16)]


def fingerprint(dataset: Dataset) -> DataFrame:
    """g, quads, high, low: two states of a graph with equal rows here hold the same quads (up to hash collisions).

    high and low are sums of the quads' hashes modulo a prime: the order of quads means nothing, a quad that is there twice does not
    cancel out, and what an update adds or removes is added or taken off (``fingerprint_after``).
    """
    high, low = _lanes(dataset.quads)
    sums = [F.pmod(F.sum(x), F.lit(PRIME).cast("decimal(38,0)")).cast("long").alias(n) for x, n in ((high, "high"), (low, "low"))]
    return dataset.quads.groupBy("g").agg(F.count("*").alias("quads"), *sums)


def fingerprint_after(before: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The fingerprint once ``added`` quads, none of which was there, came and ``removed`` ones, all of which were, went.
    Only the changes are read, not the dataset; graphs without quads have no row."""
    parts = [before.select("g", "quads", "high", "low")]
    for quads, sign in ((added, 1), (removed, -1)):
        made = fingerprint(Dataset.of(quads))
        parts.append(made.select("g", *[(F.col(c) * sign).alias(c) for c in ("quads", "high", "low")]))
    total = [F.pmod(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(PRIME).cast("decimal(38,0)")).cast("long").alias(c) for c in ("high", "low")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("g").agg(F.sum("quads").alias("quads"), *total).where("quads > 0")


def changed_graphs(before: DataFrame, now: DataFrame) -> DataFrame:
    """g: the graphs whose fingerprint differs, or that only one of the two has."""
    sides = before.select("g", "quads", "high", "low", F.lit(1).alias("side")).unionByName(now.select("g", "quads", "high", "low", F.lit(2).alias("side")))
    same = F.max(F.struct("quads", "high", "low")) == F.min(F.struct("quads", "high", "low"))
    return sides.groupBy("g").agg((same & (F.countDistinct("side") == 2)).alias("same")).where(~F.col("same")).select("g")


def info(dataset: Dataset, capability: Capability) -> str:
    """What the whole dataset holds, in lines of text."""
    capability.require("read")
    row = dataset.quads.agg(F.count("*").alias("n"), F.count_if(F.col("g").isNull()).alias("default")).first()
    return f"quads {row.n}\ndefault {row.default}\ngraphs {dataset.graphs.select('g').distinct().count()}\n"


def graph_info(dataset: Dataset, capability: Capability, graph: str) -> str:
    """Whether one graph exists and how many quads it holds; only its own grant opens it, not the whole dataset's."""
    (iri,) = graph_set(graph)
    capability.require(f"read:graph:{iri}")
    exists = not dataset.graphs.where(F.col("g") == f"<{iri}>").isEmpty()
    return f"graph {iri}\nexists {str(exists).lower()}\nquads {dataset.graph(f'<{iri}>').count()}\n"
