"""Operators on solutions: joins that know about unbound variables, MINUS, EXISTS, UNION, ordering.

``maybe`` names the shared variables that a side may leave unbound.  All others are equi-joined;
an unbound variable is compatible with anything.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in b.columns]


def _apart(b: DataFrame, names: Iterable[str]) -> DataFrame:
    return reduce(lambda df, c: df.withColumnRenamed(c, f"__{c}"), names, b)


def _equal(names: Iterable[str]) -> Column:
    return _both(F.col(c) == F.col(f"__{c}") for c in names)


def _cases(names: Sequence[str], maybe: Iterable[str]) -> list[tuple[list[str], list[str], list[str]]]:
    """Disjoint ways to be compatible: the variables that both sides bind alike, that the left side leaves unbound, and that only the right side does."""
    loose = [c for c in names if c in maybe]
    fixed = [c for c in names if c not in maybe]
    return [(fixed + [c for c, w in zip(loose, way) if w == 0], *([c for c, w in zip(loose, way) if w == k] for k in (1, 2))) for way in product(range(3), repeat=len(loose))]


def _both(parts: Iterable[Column]) -> Column:
    return reduce(lambda x, y: x & y, parts, F.lit(True))


def _merged(df: DataFrame, a: DataFrame, b: DataFrame, names: Sequence[str], maybe: Iterable[str]) -> DataFrame:
    own = [F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) if c in names and c in maybe else F.col(c) for c in a.columns]
    return df.select(*own, *[c for c in b.columns if c not in names])


def _met(a: DataFrame, b: DataFrame, names: Sequence[str], maybe: Iterable[str]) -> DataFrame:
    """Compatible rows side by side, ``b``'s shared variables under ``__`` names; see ``join``."""
    loose = [c for c in names if c in maybe]

    def faced(df: DataFrame, at: str, own: str, other: str) -> DataFrame:
        bound = reduce(lambda x, y: x + y, [F.when(F.col(f"{at}{c}").isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(loose)])
        ways = df.withColumn(own, bound).withColumn(other, F.explode(F.array(*map(F.lit, range(1 << len(loose))))))
        return ways.withColumns({f"{own}_{c}": F.when(F.col(own).bitwiseAND(F.col(other)).bitwiseAND(1 << i) != 0, F.col(f"{at}{c}")) for i, c in enumerate(loose)})

    left = faced(a, "", "__a", "__of_b")
    right = faced(_apart(b, names), "__", "__b", "__of_a")
    on = [F.col("__a") == F.col("__of_a"), F.col("__b") == F.col("__of_b"), *(F.col(c) == F.col(f"__{c}") for c in names if c not in maybe)]
    return left.join(right, _both([*on, *(F.col(f"__a_{c}").eqNullSafe(F.col(f"__b_{c}")) for c in loose)]))


def _told_apart(a: DataFrame, b: DataFrame, names: Sequence[str], maybe: Iterable[str], condition: Column | None) -> tuple[list[DataFrame], DataFrame]:
    """Rows of ``a`` with a compatible row in ``b``, in parts, and those without one.

    One equi-join per case of ``_cases``, on what the cases before it left over.  Where a row binds none of the
    variables, any row of ``b`` is compatible: one stands for all, and only a ``condition`` needs each of them.
    """
    right = _apart(b.select(*names).distinct() if condition is None else b, names)
    hits = []
    for same, left_free, right_free in _cases(names, maybe):
        other = right.where(_both(F.col(f"__{c}").isNull() for c in right_free))
        if condition is None:
            other = other.select(*[f"__{c}" for c in same]).distinct() if same else other.select(F.lit(True).alias("__any")).limit(1)
        on = _both([*(F.col(c) == F.col(f"__{c}") for c in same), *(F.col(c).isNull() for c in left_free), *([] if condition is None else [condition])])
        hits.append(a.join(other, on, "left_semi"))
        a = a.join(other, on, "left_anti")
    return hits, a


def join(a: DataFrame, b: DataFrame, maybe: Iterable[str] = ()) -> DataFrame:
    """Compatible solutions merged.

    With ``maybe``, one equi-join: each row comes once for every set of those k variables that the other side may bind
    (2^k times), and meets the rows that bind just that set on the variables that both bind.
    """
    names, maybe = shared(a, b), set(maybe)
    if not maybe & set(names):
        return a.join(b, names) if names else a.crossJoin(b)
    return _merged(_met(a, b, names, maybe), a, b, names, maybe)


def left_join(a: DataFrame, b: DataFrame, condition: Column | None = None, maybe: Iterable[str] = ()) -> DataFrame:
    """OPTIONAL: ``condition`` sees both sides and decides about the match, not about the row.

    With ``maybe``, the rows of ``join`` and, beside them, those of ``a`` that no equi-join of a case meets.
    """
    names, maybe = shared(a, b), set(maybe)
    if not maybe & set(names):
        on = _equal(names)
        return _merged(a.join(_apart(b, names), on if condition is None else on & condition, "left"), a, b, names, maybe)
    met = _met(a, b, names, maybe)
    alone = _told_apart(a, b, names, maybe, condition)[1]
    return union(_merged(met if condition is None else met.where(condition), a, b, names, maybe), alone)


def minus(a: DataFrame, b: DataFrame, maybe: Iterable[str] = ()) -> DataFrame:
    """Solutions of ``a`` without a compatible one in ``b`` that shares a bound variable; without shared variables, ``a``."""
    names = shared(a, b)
    if not names:
        return a
    right = _apart(b.select(*names).distinct(), names)
    for same, left_free, right_free in _cases(names, set(maybe)):
        if same:
            other = right.where(_both(F.col(f"__{c}").isNull() for c in right_free))
            a = a.join(other, _both([*(F.col(c) == F.col(f"__{c}") for c in same), *(F.col(c).isNull() for c in left_free)]), "left_anti")
    return a


def exists(a: DataFrame, b: DataFrame, condition: Column | None = None, negated: bool = False, maybe: Iterable[str] = ()) -> DataFrame:
    """FILTER (NOT) EXISTS: ``condition`` may compare outer variables with ``b``'s own."""
    names, maybe = shared(a, b), set(maybe)
    if maybe & set(names):
        hits, rest = _told_apart(a, b, names, maybe, condition)
        return rest if negated else union(*hits)
    if not names and condition is None:
        b = b.limit(1)
    on = _equal(names)
    return a.join(_apart(b, names), on if condition is None else on & condition, "left_anti" if negated else "left_semi")


def mark_exists(a: DataFrame, b: DataFrame, name: str, maybe: Iterable[str] = ()) -> DataFrame:
    """EXISTS as a value, for BIND, ORDER BY or aggregates."""
    names, maybe = shared(a, b), set(maybe)
    if maybe & set(names):
        hits, rest = _told_apart(a, b, names, maybe, None)
        return union(union(*hits).withColumn(name, F.lit(True)), rest.withColumn(name, F.lit(False)))
    marked = b.select(*names).distinct().withColumn("__found", F.lit(True))
    return a.join(marked, names, "left").withColumn(name, F.coalesce("__found", F.lit(False))).select(*a.columns, name)


def union(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def values(spark: SparkSession, names: Sequence[str], rows: Sequence[Sequence], kinds: Sequence[str] | None = None) -> DataFrame:
    """VALUES: an inline table, None being UNDEF."""
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds or ["string"] * len(names)))
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def bind(df: DataFrame, name: str, value: Column) -> DataFrame:
    """BIND: an error leaves the variable unbound and keeps the row."""
    if name in df.columns:
        raise ValueError(f"?{name} is bound already")
    return df.withColumn(name, value)


def where(df: DataFrame, condition: Column) -> DataFrame:
    """FILTER: false and error both drop the row."""
    return df.where(condition)


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def reduced(df: DataFrame) -> DataFrame:
    """REDUCED may drop duplicates; it keeps them."""
    return df


def project(df: DataFrame, *names: str) -> DataFrame:
    """SELECT: a name that no pattern binds is a column of nulls."""
    return df.select(*[F.col(n) if n in df.columns else F.lit(None).cast(T.StringType()).alias(n) for n in names])


def slice_(df: DataFrame, order: Sequence[Column], offset: int = 0, limit: int | None = None) -> DataFrame:
    """ORDER BY, OFFSET and LIMIT; with a limit Spark keeps only that many rows per task."""
    df = df.orderBy(*order)
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def lateral_top(left: DataFrame, right: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """LATERAL with ORDER BY and LIMIT: for each distinct seed of ``left`` its first ``limit`` of ``right``.

    The seeds prune ``right``; Spark keeps ``limit`` rows per seed in each task before it shuffles.
    """
    seeds = shared(left, right)
    pruned = right.join(left.select(*seeds).distinct(), seeds, "left_semi")
    ranked = pruned.withColumn("__n", F.row_number().over(Window.partitionBy(*seeds).orderBy(*order)))
    return join(left, ranked.where(F.col("__n") <= limit).drop("__n"))


def lateral_group(left: DataFrame, right: DataFrame, empty: Mapping[str, Column] | None = None, **made: Column) -> DataFrame:
    """LATERAL with aggregates: each solution of ``left`` with those of the solutions of ``right`` that fit it.

    ``empty`` are the values over none, such as 0 for a count; others are unbound there.  The aggregation is by seeds,
    partly in each task, so that a seed that repeats in ``left`` is aggregated once.
    """
    seeds, empty = shared(left, right), empty or {}
    pruned = right.join(left.select(*seeds).distinct(), seeds, "left_semi")
    found = pruned.groupBy(*seeds).agg(*[c.alias(n) for n, c in made.items()]).withColumn("__met", F.lit(True))
    full = left.join(found, seeds, "left")
    return full.select(*left.columns, *[F.when(F.col("__met"), F.col(n)).otherwise(empty.get(n, F.lit(None))).alias(n) for n in made])
