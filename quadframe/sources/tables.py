"""Ordinary tables seen as RDF: a row is a subject, a column a predicate, a table a named graph.

``star`` reads several columns of a table in one scan, where quads would take a join per column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T

#: Columns that name a row of each table; lineitem has none, so a digest of the whole row stands in.
KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",),
    "orders": ("o_orderkey",), "events": ("event_id",), "documents": ("doc_id",), "labels": ("doc_id",), "embeddings": ("vec_id",),
    "pages": ("page_id",), "benchmark": ("item_id",), "conversations": ("conv_id", "turn"), "lineitem": (),
}
#: Columns that point to a row of another table.
LINKS = {
    "n_regionkey": "region", "c_nationkey": "nation", "s_nationkey": "nation", "o_custkey": "customer", "l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier",
}
BASE = "urn:tpch:"


def predicate(column: str) -> str:
    return f"<{BASE}{column}>"


def graph_of(table: str) -> str:
    return f"<{BASE}graph:{table}>"


def row_iri(table: str, *key: Column) -> Column:
    return F.concat(F.lit(f"<{BASE}{table}:"), F.concat_ws(".", *[k.cast("string") for k in key]), F.lit(">"))


def value_term(value: Column, kind: str) -> Column:
    if kind in ("int", "bigint", "smallint", "tinyint"):
        return T.integer(value)
    return {"double": T.double, "float": T.double, "boolean": T.boolean, "timestamp": T.date_time, "timestamp_ntz": T.date_time}.get(kind, T.string)(value)


class Tables:
    """The tables of a folder of Parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}.parquet")

    def star(self, table: str, **columns: str) -> DataFrame:
        """Solutions of one subject: each variable a column of ``table``, all bound, from one scan.
        Values stay native, keys stay numbers, so that joins are on numbers."""
        rows = self.read(table).select(*[F.col(c).alias(v) for v, c in columns.items()])
        return rows.where(reduce(lambda a, b: a & b, [F.col(v).isNotNull() for v in columns]))

    def subject(self, table: str, df: DataFrame) -> Column:
        keys = [F.col(c) for c in KEYS[table]] or [F.substring(F.sha1(F.to_json(F.struct(*df.columns))), 1, 16)]
        return row_iri(table, *keys)

    def quads(self, *tables: str) -> DataFrame:
        """g, s, p, o of whole tables, one row per value that is not null, one scan per table; lists are no RDF values."""
        parts = []
        for table in tables:
            df = self.read(table)
            cells = []
            for name, kind in df.dtypes:
                if kind.startswith("array"):
                    continue
                target = row_iri(LINKS[name], F.col(name)) if name in LINKS else value_term(F.col(name), kind)
                cells.append(F.struct(F.lit(predicate(name)).alias("p"), target.alias("o")))
            rows = df.select(self.subject(table, df).alias("s"), F.explode(F.array(*cells)).alias("c"))
            parts.append(rows.select(F.lit(graph_of(table)).alias("g"), "s", "c.p", "c.o").where("o IS NOT NULL"))
        return reduce(DataFrame.unionByName, parts)
