"""Curation filter: keep designs listed by (algo_name, source_name) pairs.

The list is joined with ``left_semi`` / ``left_anti``; Spark broadcasts it
only when its measured size is under ``spark.sql.autoBroadcastJoinThreshold``
(no forced hint: the list is user input of unproven size).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# FIXED VALUES: key names tried in order, the first present wins
NAME_KEYS = ("name", "algo_name", "algorithm", "kernel_name", "design_name")
SOURCE_KEYS = ("source", "source_name", "dataset", "benchmark")


def resolve_keys(df: DataFrame) -> DataFrame:
    """Add ``_name``/``_source`` from the first present key column (absent and null both count as missing)."""
    names = [F.col(c) for c in NAME_KEYS if c in df.columns]
    sources = [F.col(c) for c in SOURCE_KEYS if c in df.columns]
    name = F.coalesce(*names) if names else F.lit(None).cast("string")
    source = F.coalesce(*sources) if sources else F.lit(None).cast("string")
    return df.withColumn("_name", name).withColumn("_source", source)


def normalise_list(sel: DataFrame) -> DataFrame:
    return sel.select("algo_name", "source_name").where(
        F.col("algo_name").isNotNull() & F.col("source_name").isNotNull()).distinct()


def _usable(df: DataFrame) -> DataFrame:
    return df.where((F.coalesce(F.col("_name"), F.lit("")) != "") & (F.coalesce(F.col("_source"), F.lit("")) != ""))


def keep_listed(corpus: DataFrame, sel: DataFrame) -> DataFrame:
    """Designs whose pair is listed (all copies kept); missing/empty name or source -> removed."""
    c = _usable(resolve_keys(corpus))
    pairs = normalise_list(sel).withColumnRenamed("algo_name", "_name").withColumnRenamed("source_name", "_source")
    return c.join(pairs, ["_name", "_source"], "left_semi").drop("_name", "_source")


def missing_pairs(corpus: DataFrame, sel: DataFrame) -> DataFrame:
    """Listed pairs with no design."""
    found = _usable(resolve_keys(corpus)).select(
        F.col("_name").alias("algo_name"), F.col("_source").alias("source_name"))
    return normalise_list(sel).join(found, ["algo_name", "source_name"], "left_anti")


def decision_audit(corpus: DataFrame, sel: DataFrame) -> DataFrame:
    """Each design labelled kept / pair not listed / no source / no name."""
    c = resolve_keys(corpus)
    pairs = normalise_list(sel).select(F.col("algo_name").alias("_name"), F.col("source_name").alias("_source"),
                                       F.lit(True).alias("_listed"))
    has_name = F.coalesce(F.col("_name"), F.lit("")) != ""
    has_src = F.coalesce(F.col("_source"), F.lit("")) != ""
    return (c.join(pairs, ["_name", "_source"], "left")
            .withColumn("decision",
                        F.when(has_name & has_src & F.col("_listed"), "kept")
                        .when(has_name & has_src, "pair not listed")
                        .when(has_name, "no source").otherwise("no name"))
            .drop("_name", "_source", "_listed"))


def check_counts(kept: DataFrame, sel: DataFrame) -> DataFrame:
    """(filtered_count, listed_count, counts_match) - the expected-vs-matched warning."""
    k = kept.agg(F.count(F.lit(1)).alias("filtered_count"))
    n = normalise_list(sel).agg(F.count(F.lit(1)).alias("listed_count"))
    tagged = (k.select(F.col("filtered_count").alias("v"), F.lit("k").alias("t"))
              .unionByName(n.select(F.col("listed_count").alias("v"), F.lit("n").alias("t"))))
    out = tagged.agg(F.max(F.when(F.col("t") == "k", F.col("v"))).alias("filtered_count"),
                     F.max(F.when(F.col("t") == "n", F.col("v"))).alias("listed_count"))
    return out.withColumn("counts_match", F.col("filtered_count") == F.col("listed_count"))


def sources_per_name(sel: DataFrame) -> DataFrame:
    """For each listed name its sorted sources."""
    return (normalise_list(sel).groupBy("algo_name")
            .agg(F.array_join(F.sort_array(F.collect_set("source_name")), ",").alias("sources")))


def keyed_filter(keyed: DataFrame, sel: DataFrame) -> DataFrame:
    """Keyed corpus rows ``(key, source, is_struct)``: key listed and (no source, scalar, or pair listed)."""
    pairs = normalise_list(sel)
    names = pairs.select(F.col("algo_name").alias("key")).distinct()
    listed = keyed.join(names, "key", "left_semi")
    with_pair = listed.join(
        pairs.select(F.col("algo_name").alias("key"), F.col("source_name").alias("source"),
                     F.lit(True).alias("_pair")), ["key", "source"], "left")
    no_source = F.coalesce(F.col("source"), F.lit("")) == ""
    keep = (~F.col("is_struct")) | no_source | F.col("_pair").isNotNull()
    return with_pair.where(keep).drop("_pair")
