"""Joins on a range: FILTER(?low <= ?x && ?x < ?high) over two patterns, without comparing every row with every other.

Values are cut at common quantiles of both sides.  A point lies in one bucket, an interval is sent to each bucket that it reaches into,
and both meet by an equi-join on the bucket with the exact test inside.  An interval that covers a whole bucket needs no test
there: its pairs are rows of the result anyway.

Where only the number of partners is asked for, ``count_between`` makes no pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

#: Buckets that a range join cuts values into, for each shuffle partition.
PER_PARTITION = 8


def _cuts(points: DataFrame, value: Column, buckets: int) -> list[float]:
    """Ascending values at about equal shares of the points; the driver gets as many as there are buckets."""
    shares = [i / buckets for i in range(1, buckets)]
    found = points.select(value.cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")).agg(F.percentile_approx("v", shares, 20 * buckets).alias("cuts")).first().cuts
    return sorted(set(found or []))


def _bucket(value: Column, cuts: Sequence[float]) -> Column:
    """The number of cuts that are at most ``value``: rises with the value, equal values share a bucket.

    Doubles next to two exact numbers never swap them, so buckets of doubles hold for numbers of any type.
    """
    return F.array_size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= value.cast("double"))) if cuts else F.lit(0)


def join_between(points: DataFrame, intervals: DataFrame, value: Column, low: Column | None, high: Column | None, condition: Column | None = None, on: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Rows of both sides with ``low <= value <= high``, where a bound that is None is open, and ``condition``, which sees both.

    ``value`` is a column of ``points``, the bounds are columns of ``intervals``, both numbers; ``condition`` may be the strict or exact test,
    for which the closed one in doubles is a necessary condition.  ``on`` names columns that both sides share and that are equal; the
    other names must differ.  A row whose value is null or NaN, or with a bound that is, meets none.

    Buckets hold about equal numbers of points, so a value of very many points is one bucket of many; Spark's adaptive join splits such a one.
    An interval is copied to each bucket that it reaches into, which is as many rows as it has buckets of partners.
    """
    spark = points.sparkSession
    n = buckets or PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = _cuts(points, value, n)
    real = lambda c: c.isNotNull() & ~F.isnan(c.cast("double"))
    held = points.where(real(value)).withColumns({"__value": value, "__bucket": _bucket(value, cuts)})
    first = F.lit(0) if low is None else _bucket(low, cuts)
    last = F.lit(len(cuts)) if high is None else _bucket(high, cuts)
    kept = intervals
    for bound in (low, high):
        kept = kept if bound is None else kept.where(real(bound))
    bounds = {name: bound for name, bound in (("__low", low), ("__high", high)) if bound is not None}
    sent = kept.withColumns({**bounds, "__first": first, "__last": last}).where(F.col("__first") <= F.col("__last")).withColumn("__bucket", F.explode(F.sequence("__first", "__last"))).drop("__first", "__last")
    tests = [F.col("__low") <= F.col("__value")] * (low is not None) + [F.col("__value") <= F.col("__high")] * (high is not None)
    met = held.join(sent, ["__bucket", *on])
    for test in tests:
        met = met.where(test)
    met = met.drop("__bucket", "__value", *bounds)
    return met if condition is None else met.where(condition)


def count_between(points: DataFrame, intervals: DataFrame, value: Column, low: Column | None, high: Column | None, count: str = "count") -> DataFrame:
    """The rows of ``intervals`` with ``low <= value <= high`` for some of ``points``, and in ``count`` for how many: ``join_between`` without its pairs.

    Distinct values and bounds are sorted together, a low bound before its equals and a high one after them; the sum of points so far tells how many are below or up to
    each, and their difference is the number.  So the work grows with rows of both sides, not with pairs.  Value and bounds are numbers of one type; nulls and NaN
    meet none.  The driver gets one number for each range of the sort.
    """
    real = lambda c: c.isNotNull() & ~F.isnan(c.cast("double"))
    values = written(points.where(real(value)).groupBy(value.alias("x")).agg(F.count("*").alias("c")), "values")
    least, most, total = values.agg(F.min("x"), F.max("x"), F.coalesce(F.sum("c"), F.lit(0))).first()
    bounds = {name: bound for name, bound in (("__low", low), ("__high", high)) if bound is not None}
    kept = intervals.withColumns(bounds) if bounds else intervals
    for name in bounds:
        kept = kept.where(real(F.col(name)))
    # most intervals may reach no point at all
    kept = kept.where(F.lit(total > 0))
    if total and low is not None:
        kept = kept.where(F.col("__low") <= F.lit(most))
    if total and high is not None:
        kept = kept.where(F.col("__high") >= F.lit(least))
    kept = written(kept, "intervals")
    ordered = values.select("x", F.lit(1).alias("kind"), "c")
    for name in bounds:
        ordered = ordered.union(kept.select(F.col(name), F.lit(0 if name == "__low" else 2), F.lit(0).cast("long")).distinct())
    at, part = F.col("at"), F.shiftright("at", 33).alias("part")
    ordered = written(ordered.orderBy("x", "kind").withColumn("at", F.monotonically_increasing_id()), "ordered")
    sums = sorted(map(tuple, ordered.groupBy(part).agg(F.sum("c")).collect()))
    before = itertools.accumulate((n for _, n in sums), initial=0)
    starts = points.sparkSession.createDataFrame([(p, n) for (p, _), n in zip(sums, before)], "part long, before long")
    so_far = F.sum("c").over(Window.partitionBy("part").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    told = ordered.withColumn("part", part).withColumn("sum", so_far).where("kind != 1").join(F.broadcast(starts), "part").select("x", "kind", (F.col("sum") + F.col("before")).alias("sum"))
    told, ends = written(told, "told"), {}
    for name in bounds:
        kept = kept.join(told.where(F.col("kind") == (0 if name == "__low" else 2)).select(F.col("x").alias(name), F.col("sum").alias(f"{name}_sum")), name)
        ends[name] = F.col(f"{name}_sum")
    found = ends.get("__high", F.lit(total)) - ends.get("__low", F.lit(0))
    return kept.withColumn("__count", found.cast("long")).where("__count > 0").select(*intervals.columns, F.col("__count").alias(count))


def join_near(a: DataFrame, b: DataFrame, left: Column, right: Column, below: float, above: float, condition: Column | None = None, on: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Rows whose values are near: ``right - below <= left <= right + above``; see ``join_between``."""
    return join_between(a, b, left, right - F.lit(below), right + F.lit(above), condition, on, buckets)
