"""Range joins against a plain double loop, and their plans."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quadframe.functions import terms as T
from quadframe.operators import ranges
from quadframe.plans import graph  # noqa: F401  (it registers range_join)
from quadframe.plans.registry import QUERIES

C = F.col


def tables(spark, seed=1, hot=0):
    rng = random.Random(seed)
    points = [(i, rng.choice([None, float("nan"), 5.0, rng.uniform(-50, 50), float(rng.randint(-9, 9))])) for i in range(150)] + [(1000 + i, 7.0) for i in range(hot)]
    spans = [(i, rng.choice([None, rng.uniform(-60, 50)]), rng.choice([None, rng.uniform(-50, 60)])) for i in range(80)]
    return points, spans, spark.createDataFrame(points, "p int, x double"), spark.createDataFrame(spans, "i int, lo double, hi double")


@pytest.mark.parametrize("buckets", [1, 7, 64])
def test_between_by_hand(spark, buckets):
    points, spans, a, b = tables(spark)
    found = ranges.join_between(a, b, C("x"), C("lo"), C("hi"), buckets=buckets).select("p", "i").collect()
    assert sorted(map(tuple, found)) == sorted((p, i) for p, x in points for i, lo, hi in spans if None not in (x, lo, hi) and lo <= x <= hi)
    found = ranges.join_between(a, b, C("x"), C("lo"), None, C("x") != C("lo"), buckets=buckets).select("p", "i").collect()
    assert sorted(map(tuple, found)) == sorted((p, i) for p, x in points for i, lo, _ in spans if None not in (x, lo) and lo < x)


def test_no_product_in_the_plan(spark):
    _, _, a, b = tables(spark)
    plan = ranges.join_between(a, b, C("x"), C("lo"), C("hi"))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_equal_columns_and_empty_sides(spark):
    _, _, a, b = tables(spark)
    a, b = a.withColumn("k", C("p") % 3), b.withColumn("k", C("i") % 3)
    found = ranges.join_between(a, b, C("x"), C("lo"), C("hi"), on=["k"]).select("p", "i").collect()
    want = ranges.join_between(a.drop("k"), b.drop("k"), C("x"), C("lo"), C("hi"), C("p") % 3 == C("i") % 3).select("p", "i").collect()
    assert sorted(found) == sorted(want) and found
    assert ranges.join_between(a.limit(0), b, C("x"), C("lo"), C("hi"), on=["k"]).collect() == [] and ranges.join_between(a, b.limit(0), C("x"), C("lo"), C("hi"), on=["k"]).collect() == []


def test_terms_beyond_doubles(spark):
    """The doubles of the numbers are equal; the exact test decides."""
    n = 2**53
    a = spark.createDataFrame([(str(n + i),) for i in range(4)], "x string").select(T.typed(C("x"), "integer").alias("x"))
    b = spark.createDataFrame([(str(n + i),) for i in range(4)], "y string").select(T.typed(C("y"), "integer").alias("y"))
    found = ranges.join_between(a, b, T.number(C("x")), None, T.number(C("y")), T.less(C("x"), C("y"))).count()
    assert found == 6


def test_near(spark):
    a, b = (spark.createDataFrame([(i, float(i)) for i in range(60)], f"{n}k int, {n} double") for n in "ab")
    found = ranges.join_near(a, b, C("a"), C("b"), 2, 1, C("ak") != C("bk")).select("ak", "bk").collect()
    assert sorted(map(tuple, found)) == [(i, j) for i in range(60) for j in range(60) if i != j and j - 2 <= i <= j + 1]


def test_counts_by_hand(spark):
    points, spans, a, b = tables(spark, seed=5, hot=20)
    points, a = [*points, (2000, -0.0), (2001, 0.0)], a.union(spark.createDataFrame([(2000, -0.0), (2001, 0.0)], a.schema))
    spans, b = [*spans, (0, 0.0, 0.0), (81, -0.0, 5.0), (82, 5.0, 5.0), (82, 5.0, 5.0), (83, 5.0, 4.0)], b.union(spark.createDataFrame([(0, 0.0, 0.0), (81, -0.0, 5.0), (82, 5.0, 5.0), (82, 5.0, 5.0), (83, 5.0, 4.0)], b.schema))
    for low, high in ((True, True), (True, False), (False, True), (False, False)):
        holds = lambda x, lo, hi: not (x is None or low and lo is None or high and hi is None) and x == x and (not low or lo <= x) and (not high or x <= hi)  # noqa: B023, E731
        want = [(i, sum(holds(x, lo, hi) for _, x in points)) for i, lo, hi in spans]
        found = ranges.count_between(a, b, C("x"), C("lo") if low else None, C("hi") if high else None, "points")
        assert found.columns == [*b.columns, "points"]
        assert sorted(map(tuple, found.select("i", "points").collect())) == sorted(x for x in want if x[1])
    assert ranges.count_between(a.limit(0), b, C("x"), C("lo"), C("hi")).collect() == [] == ranges.count_between(a, b.limit(0), C("x"), C("lo"), C("hi")).collect()


def test_many_parts_of_one_price_are_counted_without_pairs(spark, tmp_path):
    """A billion pairs and more, which are not made."""
    n, m = 60_000, 25_000
    spark.range(n).select(C("id").alias("p_partkey"), F.lit(900.0).alias("p_retailprice")).write.parquet(str(tmp_path / "part.parquet"))
    lines = spark.range(m).select(C("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.when(C("id") % 5 == 0, 1.0).otherwise(1800.0).alias("l_extendedprice"), F.lit(2.0).alias("l_quantity"))
    lines.union(lines.where("l_orderkey = 1")).write.parquet(str(tmp_path / "lineitem.parquet"))
    began = time.time()
    found = QUERIES["range_join"](spark, str(tmp_path))
    rows = found.groupBy("parts").count().collect()
    assert sorted((r.parts, r["count"]) for r in rows) == [(n, m * 4 // 5 - 1), (2 * n, 1)] and time.time() - began < 60
