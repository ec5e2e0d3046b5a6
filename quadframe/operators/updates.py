"""Updates as functions from a dataset to a dataset.

Nothing is changed in place: an operation composes DataFrames, a chain is a fold over them, and
whoever publishes the result does so as a whole.  Quads are a set.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Denied, OverBudget, Refused
from ..functions import terms as T
from ..scratch import written
from .datasets import Capability, Dataset, graph_set

QUAD = ("g", "s", "p", "o")
Operation = Callable[[Dataset], Dataset]
#: Quads that a confined update may copy, at most.
MAX_SCOPED_QUADS = 250_000


def _without(a: DataFrame, b: DataFrame) -> DataFrame:
    a, b = a.alias("a"), b.select(*QUAD).distinct().alias("b")
    on = F.col("a.g").eqNullSafe(F.col("b.g")) & (F.col("a.s") == F.col("b.s")) & (F.col("a.p") == F.col("b.p")) & (F.col("a.o") == F.col("b.o"))
    return a.join(b, on, "left_anti").select(*[F.col(f"a.{c}").alias(c) for c in QUAD])


def insert_data(quads: DataFrame) -> Operation:
    return _blind(lambda d: Dataset.of(d.quads.select(*QUAD).unionByName(_without(quads.select(*QUAD).distinct(), d.quads)), d.graphs))


def delete_data(quads: DataFrame) -> Operation:
    """The graphs of deleted quads stay registered."""
    return _blind(lambda d: Dataset(_without(d.quads, quads), d.graphs))


def instantiate(solutions: DataFrame, template: Sequence[Sequence[str | None]]) -> DataFrame:
    """The quads of a template (s, p, o, g) of terms and ?variables for every solution, each once.
    Where a variable is unbound, or a literal would be a subject or predicate, that quad is left out.
    A blank node of the template is a fresh one in each solution, the same in all its quads."""
    one = "__solution"
    if any(x and x.startswith("_:") for quad in template for x in quad):
        # written, so that a solution keeps its nodes however often it is read
        solutions = written(solutions.withColumn(one, F.uuid()), "solutions")
    fresh = lambda x: F.concat(F.lit("_:t"), F.sha1(F.concat_ws(" ", F.col(one), F.lit(x))))
    cell = lambda x: F.lit(None).cast("string") if x is None else F.col(x[1:]) if x[0] == "?" else fresh(x) if x.startswith("_:") else F.lit(x)
    made = [F.struct(cell(g).alias("g"), cell(s).alias("s"), cell(p).alias("p"), cell(o).alias("o"), F.lit(g is not None).alias("named")) for s, p, o, g in [(*x, None)[:4] for x in template]]
    quads = solutions.select(F.explode(F.array(*made)).alias("q")).select("q.*")
    fit = (T.is_iri(F.col("s")) | T.is_blank(F.col("s"))) & T.is_iri(F.col("p")) & F.col("o").isNotNull() & (~F.col("named") | T.is_iri(F.col("g")))
    return quads.where(fit).select(*QUAD).distinct()


def modify(where: Callable[[Dataset], DataFrame], delete: Sequence[Sequence[str | None]] = (), insert: Sequence[Sequence[str | None]] = ()) -> Operation:
    """DELETE and INSERT ... WHERE: the solutions are those of the state before; deletes come first."""

    def apply(d: Dataset) -> Dataset:
        solutions = where(d)
        out = delete_data(instantiate(solutions, delete))(d) if delete else d
        return insert_data(instantiate(solutions, insert))(out) if insert else out

    apply.reads = True
    return apply


def reads(operation: Operation) -> bool:
    """Whether an operation looks at what is there: a WHERE, the source of a copy, or anything that a caller's own function may do."""
    return getattr(operation, "reads", True)


def _blind(apply: Operation) -> Operation:
    """An operation whose effect tells nothing of what was there."""
    apply.reads = False
    return apply


def silenced(operation: Operation, kinds: Sequence[str]) -> Operation:
    """The operation with its CLEAR, DROP or CREATE made SILENT."""
    return operation.silenced(kinds) if hasattr(operation, "silenced") else operation


def _loud(apply: Operation, kind: str, quiet: Operation | None) -> Operation:
    _blind(apply)
    if quiet is not None:
        apply.silenced = lambda kinds: quiet if kind in kinds else apply
    return apply


def _target(target: str) -> Column:
    return {"DEFAULT": F.col("g").isNull(), "NAMED": F.col("g").isNotNull(), "ALL": F.lit(True)}.get(target, F.col("g").eqNullSafe(target))


def _must_exist(d: Dataset, target: str, silent: bool) -> None:
    if target not in ("DEFAULT", "NAMED", "ALL") and not silent and d.graphs.where(F.col("g") == target).isEmpty():
        raise Refused(f"refused: the graph {target} does not exist")


def clear(target: str, silent: bool = False) -> Operation:
    """CLEAR of a graph, DEFAULT, NAMED or ALL: registered graphs stay."""

    def apply(d: Dataset) -> Dataset:
        _must_exist(d, target, silent)
        return Dataset(d.quads.where(~_target(target)), d.graphs)

    return _loud(apply, "clear", None if silent else clear(target, True))


def drop(target: str, silent: bool = False) -> Operation:
    def apply(d: Dataset) -> Dataset:
        _must_exist(d, target, silent)
        return Dataset(d.quads.where(~_target(target)), d.graphs.where(~_target(target)))

    return _loud(apply, "drop", None if silent else drop(target, True))


def create(graph: str, silent: bool = False) -> Operation:
    def apply(d: Dataset) -> Dataset:
        if not silent and not d.graphs.where(F.col("g") == graph).isEmpty():
            raise Refused(f"refused: the graph {graph} exists")
        one = d.graphs.sparkSession.createDataFrame([(graph,)], "g string")
        return Dataset(d.quads, d.graphs.select("g").union(one).distinct())

    return _loud(apply, "create", None if silent else create(graph, True))


def _transfer(source: str, target: str, silent: bool, replace: bool, remove: bool) -> Operation:
    def apply(d: Dataset) -> Dataset:
        if source == target:
            return d
        _must_exist(d, source, silent)
        moved = d.quads.where(_target(source)).withColumn("g", F.lit(None if target == "DEFAULT" else target).cast("string"))
        out = Dataset(d.quads.where(~_target(target)), d.graphs) if replace else d
        out = insert_data(moved)(out)
        # the destination is registered even where the source is empty
        out = out if target == "DEFAULT" else create(target, silent=True)(out)
        return drop(source, silent=True)(out) if remove else out

    # onto itself it does nothing and reads nothing
    apply.reads = source != target
    return apply


def copy(source: str, target: str, silent: bool = False) -> Operation:
    return _transfer(source, target, silent, True, False)


def move(source: str, target: str, silent: bool = False) -> Operation:
    return _transfer(source, target, silent, True, True)


def add(source: str, target: str, silent: bool = False) -> Operation:
    return _transfer(source, target, silent, False, False)


def chain(*operations: Operation) -> Operation:
    """``;``: each operation sees what those before it did; a refusal of one applies none."""

    def apply(d: Dataset) -> Dataset:
        for operation in operations:
            d = operation(d)
        return d

    apply.reads = any(map(reads, operations))
    apply.silenced = lambda kinds: chain(*[silenced(x, kinds) for x in operations])
    return apply


@dataclass(frozen=True)
class Receipt:
    text: str
    added: int | None = None
    removed: int | None = None


def update(d: Dataset, operation: Operation, capability: Capability) -> tuple[Dataset, Receipt]:
    """An update of the whole dataset; one that reads needs the read grant too.

    For a caller without it CLEAR, DROP and CREATE are SILENT: a refusal would tell whether a graph exists.
    """
    capability.require("write", *(["read"] if reads(operation) else []))
    if not capability.allows("read"):
        operation = silenced(operation, ("clear", "drop", "create"))
    return operation(d), Receipt("updated")


def confined_update(d: Dataset, operation: Operation, capability: Capability, graph: str, most: int = MAX_SCOPED_QUADS) -> tuple[Dataset, Receipt]:
    """An update that may change one graph and see no other.

    It runs on that graph alone; an effect on any other graph, quads or registration, refuses the whole.  CLEAR and DROP of
    another graph find nothing there and change nothing.  Counts are told only to who may read the graph, and for others CREATE is SILENT.
    """
    (iri,) = graph_set(graph)
    capability.require(f"write:graph:{iri}", *([f"read:graph:{iri}"] if reads(operation) else []))
    term, reader = f"<{iri}>", capability.allows(f"read:graph:{iri}")
    operation = silenced(operation, ("clear", "drop") if reader else ("clear", "drop", "create"))
    own = written(d.graph(term).select(*QUAD), "scope")
    if own.limit(most + 1).count() > most:
        raise OverBudget(f"refused: the graph holds more than {most} quads, the bound of a scoped update")
    before = Dataset(own, d.graphs.where(F.col("g") == term))
    after = operation(before)
    changed = written(after.quads.select(*QUAD), "scope")
    clean = changed.where(~F.col("g").eqNullSafe(term)).isEmpty() and after.graphs.where(F.col("g") != term).isEmpty()
    if not clean:
        raise Denied("refused: the update has effects outside its graph; nothing was applied")
    outcome = Dataset(d.quads.where(~F.col("g").eqNullSafe(term)).select(*QUAD).unionByName(changed), d.graphs.where(F.col("g") != term).select("g").union(after.graphs.select("g")).distinct())
    if not reader:
        return outcome, Receipt(f"updated {iri}")
    added, removed = _without(changed, own).count(), _without(own, changed).count()
    return outcome, Receipt(f"updated {iri}: +{added} -{removed} quads", added, removed)


def load(d: Dataset, quads: DataFrame, capability: Capability, media_type: str = "application/n-quads") -> tuple[Dataset, Receipt]:
    """Add the quads of a document; only a reader of the whole dataset is told how many were new."""
    capability.require("write")
    new = written(_without(quads.select(*QUAD).distinct(), d.quads), "load")
    out = Dataset.of(d.quads.select(*QUAD).unionByName(new), d.graphs)
    if not capability.allows("read"):
        return out, Receipt(f"loaded {media_type}")
    added = new.count()
    return out, Receipt(f"loaded {media_type}: +{added} quads", added, 0)
