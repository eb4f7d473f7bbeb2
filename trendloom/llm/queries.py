"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trendloom.llm import embedding_lsh, html_text, language_id, line_dedup, lookup_clusters, media, mixing, projected_neighbours, quality, simhash, suffix_pieces, token_counts, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(table(spark, sf_dir, "documents"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every text, decodes the ids and says whether the text came back."""
    return suffix_pieces.encode_checked(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).selectExpr("row.doc_id AS doc_id", "n_lines", "n_removed", "new_text AS text")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op9_embedding_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_lsh.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_lookup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup_clusters.cluster(table(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation that fits no long is null; the operator's own column holds it."""
    out = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", out["deviation"].try_cast("long"))


def op13_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projected_neighbours.nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_html_text, op2_language_id, op3_media_columns, op4_sentencepiece, op5_token_counts,
    op6_quality, op7_line_dedup, op8_mixing, op9_embedding_lsh, op10_simhash,
    op11_lookup_clusters, op12_whitening, op13_projected_neighbours)}
ORACLES = {"op8_mixing": mixing.MIX_SQL}
