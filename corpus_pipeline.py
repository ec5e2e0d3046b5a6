"""A training corpus from ``documents``: five stages, each one operator on all that the stage before it kept.

In every stage a null text is an empty one, rows that share a doc_id or have none are documents of their own, columns beyond those of
documents are passed on whatever their names, an empty table gives an empty one, and a very long text is a document like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadframe.llm import language_id, line_templates, mixing, ngram_join, packing
from quadframe.llm.queries import vocabulary
from quadframe.llm.shared import scratch_path, written

#: A row's own number inside a stage: doc_id may be null or repeated.
ROW = "__row"
#: A document that owes this share of its words to one earlier document may be a copy, which the near-duplicate stage takes out as a whole.
COPIES = 0.75


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ROW, written, so that a row keeps its number however often it is read."""
    return written(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language classifier rejects go.  It learns from three of four folds of the input."""
    learned = language_id.train(docs.where(~language_id.in_fold(F.col("doc_id"))))
    return language_id.identify(docs, learned).where(~F.col("rejected")).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, but in the first document that has them and in copies that the next stage takes out; all templates
    that have a segment of a line are tried.  n_chars follows the text."""
    kept = line_templates.drop_recurring_lines(docs, copies=COPIES, every=True, linked=ngram_join.likeness_links)
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked rows one with the smallest doc_id stays; null is the largest, so a row without
    doc_id stays where no linked one has any."""
    rows = numbered(docs)
    found = ngram_join.link_documents(rows.select(ROW, "text"), key=ROW).select(ROW, "component_id")
    named = found.join(rows.select(ROW, "doc_id"), ROW)
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)).alias("first"))
    return rows.join(first.select(F.col(f"first.{ROW}").alias(ROW)), ROW, "left_semi").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes its words, to the nearest whole number; one without words is never taken.
    Rows that share a doc_id, or have none, are documents of their own."""
    rows = numbered(docs)
    taken = mixing.mix_sources(rows, row=ROW).where("size > 0").select(ROW, F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("copies")).where("copies > 0")
    return rows.join(taken, ROW).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids; a document that the mix took twice is packed twice."""
    return packing.pack_tokens(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language identification", language),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("source mix", mix),
    ("packing", pack),
]

#: Compression sizes and token ids cannot be had in SQL; tests/llm compares the stages with plain versions of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents`` of ``sf_dir``, each written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = scratch_path(spark, f"stage{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
