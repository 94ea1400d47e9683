"""Corpus profile tables: names, counts per source, totals, top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedup import _checkpoint
from .quantile import quantiles


def name_source_list(corpus: DataFrame) -> DataFrame:
    """(algo_name, source_name), 'Unknown' when missing, input order kept by design_idx."""
    return corpus.select(
        "design_idx",
        F.coalesce("algo_name", F.lit("Unknown")).alias("algo_name"),
        F.coalesce("source_name", F.lit("Unknown")).alias("source_name"))


def count_per_source(corpus: DataFrame) -> DataFrame:
    return (corpus.groupBy(F.coalesce("source_name", F.lit("Unknown")).alias("source_name"))
            .agg(F.count(F.lit(1)).alias("n_designs")).orderBy("source_name"))


def corpus_totals(corpus: DataFrame) -> DataFrame:
    return corpus.agg(
        F.count_distinct(F.coalesce("source_name", F.lit("Unknown"))).alias("n_sources"),
        F.count(F.lit(1)).alias("n_designs"))


def first_duplicates(links: DataFrame, n: int = 10) -> DataFrame:
    """The report's first n duplicate links, ordered by (original, duplicate)."""
    return links.orderBy("original_index", "duplicate_index").limit(n)


def extension_top(corpus: DataFrame, n: int = 5) -> DataFrame:
    """Most frequent file extensions; ties keep the extension seen first."""
    from ..functions.structural import file_extension
    files = corpus.select("design_idx", F.posexplode("files").alias("pos", "f"))
    ext = files.select(file_extension(F.col("f.file_name")).alias("extension"),
                       F.struct("design_idx", "pos").alias("seen")).where(F.col("extension").isNotNull())
    counts = ext.groupBy("extension").agg(F.count(F.lit(1)).alias("n_files"), F.min("seen").alias("first_seen"))
    return counts.orderBy(F.desc("n_files"), "first_seen").limit(n).select("extension", "n_files")


def size_buckets(sizes: DataFrame, selected: DataFrame) -> DataFrame:
    """Quartile bucket (1-4) by ``size`` with exact cut points; counts overall and in the selection."""
    sizes = _checkpoint(sizes)
    q1, q2, q3 = quantiles(sizes, ["size"], [0.25, 0.5, 0.75])["size"] or (0.0, 0.0, 0.0)
    b = (F.when(F.col("size") <= q1, 1).when(F.col("size") <= q2, 2)
         .when(F.col("size") <= q3, 3).otherwise(4))
    flagged = sizes.join(selected.select("design_idx", F.lit(1).alias("sel")), "design_idx", "left")
    out = flagged.groupBy(b.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n_all"), F.count("sel").alias("n_selected"))
    return out.withColumn("share_selected", F.col("n_selected") / F.col("n_all"))
