"""Driver tables and corpus adapters.

The engine's input contract is one row per design:
``design_idx bigint, algo_name string, source_name string,
files array<struct<file_name string, file_content string>>``.
Adapters read only the columns they need so the Parquet scan prunes the rest.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import code_corpus as CC

FILE_STRUCT = "struct<file_name:string,file_content:string>"


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """Round-robin the rows over all cores when the scan yields fewer splits than cores.

    Text work is CPU-bound per row; a small file with one row group would run
    in one task. Large inputs already have more splits than cores and are
    left untouched (no extra shuffle at scale).
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def documents_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as single-file designs (no file name)."""
    docs = spread(read_table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return docs.select(
        F.col("doc_id").alias("design_idx"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("algo_name"),
        F.col("source").alias("source_name"),
        F.array(F.struct(F.lit(None).cast("string").alias("file_name"),
                         F.col("text").alias("file_content"))).alias("files"),
    )


def code_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The C++/HLS corpus derived row by row from ``part`` (see ``code_corpus``)."""
    part = spread(read_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size"))
    return part.select(
        F.col("p_partkey").alias("design_idx"),
        F.expr(CC.ALGO_NAME_SQL).alias("algo_name"),
        F.expr(CC.SOURCE_NAME_SQL).alias("source_name"),
        F.expr(CC.spark_files_sql()).cast(f"array<{FILE_STRUCT}>").alias("files"),
    )


def curation_list_from_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curation list (algo_name, source_name): every 10th design plus three absent pairs."""
    part = read_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand")
    listed = part.where(F.col("p_partkey") % 10 == 0).select(
        F.expr(CC.ALGO_NAME_SQL).alias("algo_name"), F.col("p_brand").alias("source_name"))
    absent = spark.createDataFrame(
        [("missing_kernel_a", "Brand#0"), ("missing_kernel_b", "Brand#99"),
         ("missing_kernel_c", "nowhere")], "algo_name string, source_name string")
    return listed.unionByName(absent)


def keyed_corpus_from_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed corpus ``algo_name -> value`` as rows ``(key, source, is_struct)``.

    Value kinds by key: struct with a source (the right brand, or a wrong one
    for every other 10th key), struct without source, or a scalar.
    """
    part = read_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand")
    kind = F.col("p_partkey") % 3
    source = (F.when(kind == 0, F.when(F.col("p_partkey") % 20 == 10, F.lit("Brand#0"))
                     .otherwise(F.col("p_brand"))))
    return part.select(F.expr(CC.ALGO_NAME_SQL).alias("key"), source.alias("source"),
                       (kind != 2).alias("is_struct"))


def embedding_points(spark: SparkSession, sf_dir: str, skewed: bool = False,
                     normalise: bool = False) -> DataFrame:
    """``embeddings`` as points ``(id, cluster, features array<double>)``.

    ``cluster`` is the given ``label``, or with ``skewed`` the bit length of
    ``vec_id + 1`` minus one (clusters of 1, 2, 4, 8, ... rows), which gives
    the trim and fill cases of the quota rules.
    """
    e = spread(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
    cluster = (F.length(F.bin(F.col("vec_id") + 1)) - 1).cast("int") if skewed else F.col("label")
    feats = F.col("embedding").cast("array<double>")
    if normalise:  # unit length: Euclidean distance then orders like cosine distance
        from ..functions.shingles import let
        norm = F.sqrt(F.aggregate(feats, F.lit(0.0), lambda a, x: a + x * x))
        feats = let(F.struct(feats.alias("f"), norm.alias("n")),
                    lambda s: F.when(s["n"] > 0, F.transform(s["f"], lambda x: x / s["n"])).otherwise(s["f"]))
    return e.select(F.col("vec_id").alias("id"), cluster.alias("cluster"), feats.alias("features"))
