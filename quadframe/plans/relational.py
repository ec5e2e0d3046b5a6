"""Patterns, joins, filters, aggregates and ordering over tables seen as RDF, with native values."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import solutions as S
from ..sources.tables import Tables
from .registry import query

C = F.col


def day(text: str):
    return F.lit(datetime.datetime.fromisoformat(text))


@query("SELECT l_returnflag AS flag, l_linestatus AS status, sum(l_quantity) AS sum_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def bgp_star(t: Tables) -> DataFrame:
    items = t.star("lineitem", flag="l_returnflag", status="l_linestatus", q="l_quantity", d="l_shipdate")
    return A.group(S.where(items, C("d") <= day("1998-09-02")), ["flag", "status"], sum_qty=A.sum_(C("q")), n=A.count_all())


@query("SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def bgp_join2(t: Tables) -> DataFrame:
    return S.project(S.join(t.star("nation", nation="n_name", r="n_regionkey"), t.star("region", r="r_regionkey", region="r_name")), "nation", "region")


@query("SELECT r_name AS region, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def bgp_chain4(t: Tables) -> DataFrame:
    found = S.join(t.star("orders", c="o_custkey"), t.star("customer", c="c_custkey", n="c_nationkey"))
    found = S.join(S.join(found, t.star("nation", n="n_nationkey", r="n_regionkey")), t.star("region", r="r_regionkey", region="r_name"))
    return A.group(found, ["region"], orders=A.count_all())


@query("SELECT p_partkey AS part, p_size AS size FROM part WHERE p_size * 2 > 60 AND p_retailprice < 1500.5")
def filter_numeric(t: Tables) -> DataFrame:
    return S.project(S.where(t.star("part", part="p_partkey", size="p_size", price="p_retailprice"), (C("size") * 2 > 60) & (C("price") < 1500.5)), "part", "size")


@query("SELECT p_partkey AS part, upper(p_name) AS upper_name, length(p_name) AS n FROM part WHERE contains(p_type, 'A') OR starts_with(p_brand, 'Brand#1')")
def filter_string_fns(t: Tables) -> DataFrame:
    found = S.where(t.star("part", part="p_partkey", name="p_name", type="p_type", brand="p_brand"), C("type").contains("A") | C("brand").startswith("Brand#1"))
    return S.project(S.bind(S.bind(found, "upper_name", F.upper("name")), "n", F.length("name").cast("long")), "part", "upper_name", "n")


@query("SELECT c_custkey AS customer FROM customer WHERE regexp_matches(c_name, '[13579]$')")
def filter_regex(t: Tables) -> DataFrame:
    return S.project(S.where(t.star("customer", customer="c_custkey", name="c_name"), C("name").rlike("[13579]$")), "customer")


@query("SELECT o_orderkey AS o, o_orderstatus AS status FROM orders WHERE o_orderstatus IN ('F', 'P')")
def filter_in(t: Tables) -> DataFrame:
    return S.where(t.star("orders", o="o_orderkey", status="o_orderstatus"), C("status").isin("F", "P"))


@query("SELECT o_orderkey AS o FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def filter_not_in(t: Tables) -> DataFrame:
    return S.project(S.where(t.star("orders", o="o_orderkey", p="o_orderpriority"), ~C("p").isin("1-URGENT", "2-HIGH")), "o")


@query("SELECT doc_id AS d, quality AS q FROM documents LEFT JOIN labels USING (doc_id) WHERE NOT (quality = 1) OR lang = 'fr'")
def filter_3vl(t: Tables) -> DataFrame:
    both = S.left_join(t.star("documents", d="doc_id", lang="lang"), t.star("labels", d="doc_id", q="quality"))
    return S.project(S.where(both, ~(C("q") == 1) | (C("lang") == "fr")), "d", "q")


@query("SELECT doc_id AS d, quality AS q, toxic AS x FROM documents LEFT JOIN labels USING (doc_id)")
def optional(t: Tables) -> DataFrame:
    return S.left_join(t.star("documents", d="doc_id"), t.star("labels", d="doc_id", q="quality", x="toxic"))


@query("SELECT d.doc_id AS d, quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND quality = 1 AND d.n_chars > 1000")
def optional_filter(t: Tables) -> DataFrame:
    docs, labels = t.star("documents", d="doc_id", n="n_chars"), t.star("labels", d="doc_id", q="quality")
    return S.project(S.left_join(docs, labels, (C("q") == 1) & (C("n") > 1000)), "d", "q")


@query("SELECT x.doc_id AS d, quality AS q, v.m FROM (SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)) x JOIN (VALUES (0, 'low'), (1, 'high')) v(q, m) ON quality IS NULL OR quality = v.q")
def optional_unbound_join(t: Tables) -> DataFrame:
    names = S.values(t.spark, ["q", "m"], [(0, "low"), (1, "high")], ["int", "string"])
    both = S.left_join(t.star("documents", d="doc_id"), t.star("labels", d="doc_id", q="quality"))
    # an unbound ?q is compatible with each value, and keeps null here to be told from a match
    marked = both.withColumn("kept", C("q"))
    return S.join(marked, names, maybe=["q"]).select("d", C("kept").alias("q"), "m")


_GRADES = "(SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)) x"
_MARKS = "(VALUES (0, 'low'), (2, 'high'), (NULL, 'any')) v(q, m)"


def _graded(t: Tables) -> tuple[DataFrame, DataFrame]:
    docs = S.left_join(t.star("documents", d="doc_id"), t.star("labels", d="doc_id", q="quality"))
    return docs, S.values(t.spark, ["q", "m"], [(0, "low"), (2, "high"), (None, "any")], ["int", "string"])


@query(f"SELECT doc_id AS d, coalesce(quality, v.q) AS q, m FROM {_GRADES} LEFT JOIN {_MARKS} ON (quality IS NULL OR v.q IS NULL OR quality = v.q) AND (m <> 'any' OR doc_id % 3 = 0)")
def optional_on_unbound(t: Tables) -> DataFrame:
    docs, marks = _graded(t)
    return S.left_join(docs, marks, (C("m") != "any") | (C("d") % 3 == 0), ["q"])


@query(f"SELECT doc_id AS d, quality AS q FROM {_GRADES} WHERE NOT EXISTS (SELECT 1 FROM {_MARKS} WHERE m <> 'any' AND (quality IS NULL OR v.q IS NULL OR quality = v.q))")
def not_exists_on_unbound(t: Tables) -> DataFrame:
    docs, marks = _graded(t)
    return S.exists(docs, marks.where(C("m") != "any"), negated=True, maybe=["q"])


@query(f"SELECT doc_id AS d, quality AS q, EXISTS (SELECT 1 FROM {_MARKS} WHERE m = 'low' AND (quality IS NULL OR quality = v.q)) AS low FROM {_GRADES}")
def exists_on_unbound_as_value(t: Tables) -> DataFrame:
    docs, marks = _graded(t)
    return S.mark_exists(docs, marks.where(C("m") == "low").select("q"), "low", ["q"])


@query("SELECT c_custkey AS c, c_mktsegment AS m, count(o_orderkey) AS orders, max(o_totalprice) AS most FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'O' GROUP BY 1, 2")
def lateral_aggregates(t: Tables) -> DataFrame:
    own = t.star("orders", c="o_custkey", price="o_totalprice", status="o_orderstatus").where(C("status") == "O").select("c", "price")
    return S.lateral_group(t.star("customer", c="c_custkey", m="c_mktsegment"), own, {"orders": F.lit(0)}, orders=F.count("*"), most=F.max("price"))


@query("SELECT c_nationkey AS n FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union(t: Tables) -> DataFrame:
    return S.union(t.star("customer", n="c_nationkey"), t.star("supplier", n="s_nationkey"))


@query("SELECT r_name AS region, NULL AS nation FROM region UNION ALL SELECT NULL, n_name FROM nation")
def union_missing_vars(t: Tables) -> DataFrame:
    return S.union(t.star("region", region="r_name"), t.star("nation", nation="n_name"))


@query("SELECT doc_id AS d FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def minus(t: Tables) -> DataFrame:
    clean = S.where(t.star("labels", d="doc_id", x="toxic"), C("x") == 0)
    return S.minus(t.star("documents", d="doc_id"), S.project(clean, "d"))


@query("SELECT r_name AS region FROM region")
def minus_nothing_shared(t: Tables) -> DataFrame:
    return S.minus(t.star("region", region="r_name"), t.star("nation", nation="n_name"))


@query("SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 20)")
def exists(t: Tables) -> DataFrame:
    orders = t.star("orders", c="o_custkey", price="o_totalprice")
    return S.project(S.exists(t.star("customer", c="c_custkey", b="c_acctbal"), orders, C("price") > C("b") * 20), "c")


@query("SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def not_exists(t: Tables) -> DataFrame:
    return S.exists(t.star("customer", c="c_custkey"), t.star("orders", c="o_custkey"), negated=True)


@query("SELECT doc_id AS d, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS labelled FROM documents d")
def exists_as_value(t: Tables) -> DataFrame:
    return S.mark_exists(t.star("documents", d="doc_id"), t.star("labels", d="doc_id"), "labelled")


@query("SELECT c_custkey AS c, m AS segment FROM customer JOIN (VALUES ('BUILDING'), ('MACHINERY')) v(m) ON c_mktsegment = m")
def values_join(t: Tables) -> DataFrame:
    return S.join(t.star("customer", c="c_custkey", segment="c_mktsegment"), S.values(t.spark, ["segment"], [("BUILDING",), ("MACHINERY",)])).select("c", "segment")


@query("SELECT o_orderkey AS o, s AS status, p AS priority FROM (SELECT o_orderkey, o_orderstatus AS s, o_orderpriority AS p FROM orders) JOIN (VALUES ('F', NULL), (NULL, '1-URGENT')) v(a, b) ON (a IS NULL OR a = s) AND (b IS NULL OR b = p)")
def values_undef(t: Tables) -> DataFrame:
    rows = S.values(t.spark, ["status", "priority"], [("F", None), (None, "1-URGENT")])
    return S.join(t.star("orders", o="o_orderkey", status="o_orderstatus", priority="o_orderpriority"), rows, maybe=["status", "priority"])


@query("SELECT l_orderkey AS o, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity > 45")
def bind_arith(t: Tables) -> DataFrame:
    found = S.where(t.star("lineitem", o="l_orderkey", e="l_extendedprice", d="l_discount", q="l_quantity"), C("q") > 45)
    return S.project(S.bind(found, "net", C("e") * (1 - C("d"))), "o", "net")


@query("SELECT p_partkey AS part, CASE WHEN p_size - 10 <> 0 THEN 100 / (p_size - 10) END AS ratio FROM part")
def bind_error_unbound(t: Tables) -> DataFrame:
    return S.project(S.bind(t.star("part", part="p_partkey", size="p_size"), "ratio", F.try_divide(F.lit(100), C("size") - 10)), "part", "ratio")


@query("SELECT doc_id AS d, CASE WHEN coalesce(quality, -1) > 0 THEN 'good' WHEN quality IS NULL THEN 'unknown' ELSE 'bad' END AS verdict FROM documents LEFT JOIN labels USING (doc_id)")
def if_coalesce(t: Tables) -> DataFrame:
    both = S.left_join(t.star("documents", d="doc_id"), t.star("labels", d="doc_id", q="quality"))
    return S.project(S.bind(both, "verdict", F.when(F.coalesce("q", F.lit(-1)) > 0, "good").when(C("q").isNull(), "unknown").otherwise("bad")), "d", "verdict")


@query("SELECT c_name AS name, o.o AS o FROM (SELECT o_orderkey AS o, o_custkey AS c FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10) o JOIN customer ON c = c_custkey")
def subselect_topk(t: Tables) -> DataFrame:
    top = S.slice_(t.star("orders", o="o_orderkey", c="o_custkey", price="o_totalprice"), [C("price").desc(), C("o")], limit=10)
    return S.project(S.join(S.project(top, "o", "c"), t.star("customer", c="c_custkey", name="c_name")), "name", "o")


@query("SELECT c, o FROM (SELECT c_custkey AS c, o_orderkey AS o, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING') WHERE n <= 2")
def lateral_topk(t: Tables) -> DataFrame:
    left = S.project(S.where(t.star("customer", c="c_custkey", m="c_mktsegment"), C("m") == "BUILDING"), "c")
    right = t.star("orders", c="o_custkey", o="o_orderkey", price="o_totalprice")
    return S.project(S.lateral_top(left, right, [C("price").desc(), C("o")], 2), "c", "o")


@query("SELECT DISTINCT c_nationkey AS n, c_mktsegment AS m FROM customer")
def distinct(t: Tables) -> DataFrame:
    return S.distinct(t.star("customer", n="c_nationkey", m="c_mktsegment"))


@query("SELECT o_orderkey AS o, o_totalprice AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def order_limit(t: Tables) -> DataFrame:
    return S.slice_(t.star("orders", o="o_orderkey", price="o_totalprice"), [C("price").desc(), C("o")], limit=25)


@query("SELECT p_partkey AS part FROM part ORDER BY p_retailprice, p_partkey LIMIT 20 OFFSET 15")
def order_offset(t: Tables) -> DataFrame:
    return S.project(S.slice_(t.star("part", part="p_partkey", price="p_retailprice"), [C("price"), C("part")], offset=15, limit=20), "part")


@query("SELECT event_type AS type, count(*) AS n FROM events GROUP BY 1")
def group_count(t: Tables) -> DataFrame:
    return A.group(t.star("events", type="event_type"), ["type"], n=A.count_all())


@query("SELECT p_brand AS brand, sum(p_size) AS total, avg(CAST(p_size AS DOUBLE)) AS mean, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part GROUP BY 1")
def group_sum_avg_min_max(t: Tables) -> DataFrame:
    parts = t.star("part", brand="p_brand", size="p_size", price="p_retailprice")
    return A.group(parts, ["brand"], total=A.sum_(C("size")), mean=A.avg(C("size")), low=A.min_(C("price")), high=A.max_(C("price")))


@query("SELECT lang, CASE WHEN count(*) = count(quality) THEN sum(quality) END AS total, count(quality) AS labelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def group_error_unbound(t: Tables) -> DataFrame:
    both = S.left_join(t.star("documents", d="doc_id", lang="lang"), t.star("labels", d="doc_id", q="quality"))
    return A.group(both, ["lang"], total=A.sum_(C("q")), labelled=A.count(C("q")))


@query("SELECT user_id AS u, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 60")
def group_having(t: Tables) -> DataFrame:
    return A.group(t.star("events", u="user_id"), ["u"], C("n") > 60, n=A.count_all())


@query("SELECT event_type AS type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def count_distinct(t: Tables) -> DataFrame:
    return A.group(t.star("events", type="event_type", u="user_id"), ["type"], users=A.count(C("u"), distinct=True))


@query("SELECT r_name AS region, string_agg(n_name, '|' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def group_concat(t: Tables) -> DataFrame:
    both = S.join(t.star("nation", nation="n_name", r="n_regionkey"), t.star("region", r="r_regionkey", region="r_name"))
    return A.group(both, ["region"], nations=A.group_concat(C("nation"), "|"))


@query("SELECT 0 AS n, 0 AS total, CAST(NULL AS INT) AS low, '' AS names")
def agg_empty_group(t: Tables) -> DataFrame:
    none = S.where(t.star("nation", k="n_nationkey", name="n_name"), C("k") < 0)
    return A.group(none, [], n=A.count_all(), total=A.sum_(C("k")), low=A.min_(C("k")), names=A.group_concat(C("name")))


# ---------------------------------------------------------------- analytic queries
@query(
    """SELECT l_returnflag AS flag, l_linestatus AS status, sum(l_quantity) AS sum_qty, sum(l_extendedprice) AS sum_base, sum(l_extendedprice * (1 - l_discount)) AS sum_disc,
sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS sum_charge, avg(l_quantity) AS avg_qty, avg(l_extendedprice) AS avg_price, avg(l_discount) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"""
)
def q1(t: Tables) -> DataFrame:
    x = t.star("lineitem", flag="l_returnflag", status="l_linestatus", q="l_quantity", e="l_extendedprice", d="l_discount", tax="l_tax", day="l_shipdate")
    net = C("e") * (1 - C("d"))
    return A.group(
        S.where(x, C("day") <= day("1998-09-02")), ["flag", "status"], sum_qty=A.sum_(C("q")), sum_base=A.sum_(C("e")), sum_disc=A.sum_(net), sum_charge=A.sum_(net * (1 + C("tax"))),
        avg_qty=A.avg(C("q")), avg_price=A.avg(C("e")), avg_disc=A.avg(C("d")), n=A.count_all(),
    )


@query(
    """SELECT o_orderkey AS o, sum(l_extendedprice * (1 - l_discount)) AS revenue, o_orderdate AS day FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15' GROUP BY 1, 3 ORDER BY revenue DESC, day, o LIMIT 10"""
)
def q3(t: Tables) -> DataFrame:
    customers = S.project(S.where(t.star("customer", c="c_custkey", m="c_mktsegment"), C("m") == "BUILDING"), "c")
    orders = S.where(t.star("orders", o="o_orderkey", c="o_custkey", day="o_orderdate"), C("day") < day("1998-03-15"))
    items = S.where(t.star("lineitem", o="l_orderkey", e="l_extendedprice", d="l_discount", ship="l_shipdate"), C("ship") > day("1998-03-15"))
    found = A.group(S.join(S.join(orders, customers), items), ["o", "day"], revenue=A.sum_(C("e") * (1 - C("d"))))
    return S.slice_(found, [C("revenue").desc(), C("day"), C("o")], limit=10)


@query(
    """SELECT n_name AS nation, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1"""
)
def q5(t: Tables) -> DataFrame:
    region = S.project(S.where(t.star("region", r="r_regionkey", name="r_name"), C("name") == "ASIA"), "r")
    nation = S.join(t.star("nation", n="n_nationkey", nation="n_name", r="n_regionkey"), region)
    found = S.join(S.join(t.star("customer", c="c_custkey", n="c_nationkey"), nation), t.star("orders", o="o_orderkey", c="o_custkey"))
    found = S.join(S.join(found, t.star("lineitem", o="l_orderkey", s="l_suppkey", e="l_extendedprice", d="l_discount")), t.star("supplier", s="s_suppkey", n="s_nationkey"))
    return A.group(found, ["nation"], revenue=A.sum_(C("e") * (1 - C("d"))))


@query("SELECT sum(l_extendedprice * l_discount) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def q6(t: Tables) -> DataFrame:
    x = t.star("lineitem", e="l_extendedprice", d="l_discount", q="l_quantity", day="l_shipdate")
    kept = S.where(x, (C("day") >= day("1996-01-01")) & (C("day") < day("1997-01-01")) & C("d").between(0.05, 0.07) & (C("q") < 24))
    return A.group(kept, [], revenue=A.sum_(C("e") * C("d")))


@query(
    """SELECT c_custkey AS c, c_name AS name, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE l_returnflag = 'R' AND o_orderdate >= TIMESTAMP '1996-10-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1, 2 ORDER BY revenue DESC, c LIMIT 20"""
)
def q10(t: Tables) -> DataFrame:
    orders = S.where(t.star("orders", o="o_orderkey", c="o_custkey", day="o_orderdate"), (C("day") >= day("1996-10-01")) & (C("day") < day("1997-01-01")))
    items = S.where(t.star("lineitem", o="l_orderkey", e="l_extendedprice", d="l_discount", flag="l_returnflag"), C("flag") == "R")
    found = S.join(S.join(orders, items), t.star("customer", c="c_custkey", name="c_name"))
    return S.slice_(A.group(found, ["c", "name"], revenue=A.sum_(C("e") * (1 - C("d")))), [C("revenue").desc(), C("c")], limit=20)


@query(
    """SELECT l_linestatus AS status, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS high, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 1 END) AS low
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' GROUP BY 1"""
)
def q12(t: Tables) -> DataFrame:
    items = S.where(t.star("lineitem", o="l_orderkey", status="l_linestatus", day="l_shipdate"), (C("day") >= day("1996-01-01")) & (C("day") < day("1997-01-01")))
    urgent = F.when(C("p").isin("1-URGENT", "2-HIGH"), 1).otherwise(0)
    return A.group(S.join(items, t.star("orders", o="o_orderkey", p="o_orderpriority")), ["status"], high=A.sum_(urgent), low=A.sum_(1 - urgent))


@query(
    """SELECT 100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)) AS share
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1995-09-01' AND l_shipdate < TIMESTAMP '1995-10-01'"""
)
def q14(t: Tables) -> DataFrame:
    items = S.where(t.star("lineitem", p="l_partkey", e="l_extendedprice", d="l_discount", day="l_shipdate"), (C("day") >= day("1995-09-01")) & (C("day") < day("1995-10-01")))
    net = C("e") * (1 - C("d"))
    return A.group(S.join(items, t.star("part", p="p_partkey", type="p_type")), [], share=100.0 * F.sum(F.when(C("type").startswith("PROMO"), net).otherwise(0.0)) / F.sum(net))
