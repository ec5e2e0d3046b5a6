"""One query per operator, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import code_books, fingerprints, language_id, line_templates, link_filter, media_columns, mixing, ngram_join, packing, revisits, stable_projection, token_store, weighted_lloyd
from .shared import scratch_path


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; another folder can be given to the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_store.write_store(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"))
    return token_store.checked_documents(spark, path)


def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_templates.drop_recurring_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", "n_lines", "n_dropped")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = language_id.in_fold(F.col("doc_id"))
    learned = language_id.train(docs.where(~held_out))
    found = language_id.identify(docs.select("doc_id", "text"), learned)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op5_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _header_lines(revisits.resolve_revisits(revisits.site_records(table(spark, sf_dir, "pages"))))


def revisits_of_own_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a log in which each revisit directly follows its page's own response."""
    return _header_lines(revisits.resolve_revisits(revisits.captures(table(spark, sf_dir, "pages"))))


def _header_lines(found: DataFrame) -> DataFrame:
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda x: F.concat(x["key"], F.lit(": "), x["value"]))
    return found.withColumn("headers", F.array_join(lines, "\n"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media_columns.stored_text_media(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op8_link_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_filter.judge_urls(table(spark, sf_dir, "pages"))


def link_propagation_of_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where each page links to the next one, so that hosts beside the rules' are judged by links."""
    return link_filter.judge_urls(link_filter.chained_pages(table(spark, sf_dir, "pages")))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(table(spark, sf_dir, "documents"))


def op11_weighted_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_lloyd.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_stable_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stable_projection.nearest(table(spark, sf_dir, "embeddings"))


def op13_yinyang_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_books.compress(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_order_minhash": op1_order_minhash,
    "op2_token_store": op2_token_store,
    "op3_line_templates": op3_line_templates,
    "op4_language_id": op4_language_id,
    "op5_revisit_resolution": op5_revisit_resolution,
    "revisits_of_own_pages": revisits_of_own_pages,
    "op6_media_columns": op6_media_columns,
    "op7_source_mix": op7_source_mix,
    "op8_link_propagation": op8_link_propagation,
    "link_propagation_of_chain": link_propagation_of_chain,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_ngram_join": op10_ngram_join,
    "op11_weighted_lloyd": op11_weighted_lloyd,
    "op12_stable_projection": op12_stable_projection,
    "op13_yinyang_codes": op13_yinyang_codes,
}

ORACLE: dict[str, str] = {
    "op3_line_templates": line_templates.oracle(),
    "op5_revisit_resolution": revisits.site_oracle(),
    "revisits_of_own_pages": revisits.oracle(),
    "op8_link_propagation": link_filter.oracle(),
    "link_propagation_of_chain": link_filter.oracle(source=link_filter.CHAINED),
    "op11_weighted_lloyd": weighted_lloyd.oracle(),
    "op13_yinyang_codes": code_books.oracle(),
}
