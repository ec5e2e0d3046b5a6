"""SPARQL's aggregates as Spark aggregates: an error among the values makes SUM and AVG unbound, COUNT skips it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exact
from ..functions import terms as T
from ..functions.terms import order_key


def _no_error(value: Column, result: Column, empty: Column) -> Column:
    return F.when(F.count(F.lit(1)) == F.count(value), F.coalesce(result, empty))


def count_all() -> Column:
    return F.count(F.lit(1))


def count(value: Column, distinct: bool = False) -> Column:
    return F.countDistinct(value) if distinct else F.count(value)


def count_distinct_solutions(*names: str) -> Column:
    """COUNT(DISTINCT *): unbound variables count as a value of their own."""
    return F.countDistinct(F.struct(*names))


def sum_(value: Column, distinct: bool = False) -> Column:
    return _no_error(value, F.sum_distinct(value) if distinct else F.sum(value), F.lit(0))


def avg(value: Column, distinct: bool = False) -> Column:
    made = F.sum_distinct(value) / F.countDistinct(value) if distinct else F.avg(value)
    return _no_error(value, made, F.lit(0))


def _typed(term: Column, whole: Column, point: Column, real: Column) -> Column:
    """By the highest numeric type among the terms; unbound if one of them is no number; 0 for none."""
    rank = F.max(T.numeric_rank(term))
    made = F.when(rank == 0, whole).when(rank == 1, point).otherwise(T.double(real))
    return F.when(F.count(F.lit(1)) == 0, T.integer(F.lit(0))).when(F.count(F.lit(1)) == F.count(T.numeric_rank(term)), made)


def sum_term(term: Column) -> Column:
    """SUM over terms: integers stay integers, decimals exact, anything with a double is a double.

    Exact sums take numbers of up to 120 digits on each side of the point; with a longer one they are unbound, never short of a value.
    """
    made = exact.total(T.exact_text(term))
    return _typed(term, T.integer_text(made), T.decimal_text(made), F.sum(T.number(term)))


def avg_term(term: Column) -> Column:
    """AVG over terms: of integers and decimals a decimal of 18 places, within ``sum_term``'s digits."""
    mean = T.decimal_text(exact.divide(exact.total(T.exact_text(term)), F.count(F.lit(1)).cast("string")))
    return _typed(term, mean, mean, F.avg(T.number(term)))


def min_(value: Column) -> Column:
    return F.min(value)


def max_(value: Column) -> Column:
    return F.max(value)


def min_term(term: Column) -> Column:
    """MIN over terms of mixed kinds, in ORDER BY's order."""
    return F.min_by(term, F.when(term.isNotNull(), order_key(term)))


def max_term(term: Column) -> Column:
    return F.max_by(term, F.when(term.isNotNull(), order_key(term)))


def sample(value: Column) -> Column:
    """SAMPLE: any value; the least, so that reruns agree."""
    return F.min(value)


def group_concat(text: Column, separator: str = " ", distinct: bool = False) -> Column:
    """GROUP_CONCAT in ascending order of the texts, which SPARQL leaves open."""
    made = F.array_join(F.array_sort((F.collect_set if distinct else F.collect_list)(text)), separator)
    return _no_error(text, made, F.lit(""))


def group(df: DataFrame, by: list[str], having: Column | None = None, **made: Column) -> DataFrame:
    """GROUP BY with HAVING; without keys one row, also for no solutions."""
    out = df.groupBy(*by).agg(*[c.alias(n) for n, c in made.items()])
    return out if having is None else out.where(having)
