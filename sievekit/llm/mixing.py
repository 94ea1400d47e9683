"""Operator 10 [native]: mix sources to target weights.

Each document gets a hash-random key; documents are range-sorted by (source,
key); prefix sums of the token counts are made from sums per (range, source)
and a running sum inside each; every source is cut at its exact budget, whole
epochs first. Only DataFrame functions are used.

Defined cases: a null text has size 0; null is a source of its own, after all
others; documents of size 0 take 0; repeated rows are documents of their own;
an empty table gives an empty result; the result columns are built from the
named input columns only, so further columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, n_words, partitions, read_table

#: Weights of the sources in code-point order, null last, repeating.
CYCLE = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"


def _with_prefix(scratch: Scratch, df: DataFrame, name: str, group: list[str], order: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """Range-sort by group and order; (rows with ``before_in``, offsets per group and range with ``offset``).

    The sum before a row is offset + before_in. A last random sort column
    splits ties over ranges, so that no run of equal rows meets in one task.
    """
    n = partitions(scratch.spark)
    rows = scratch.write(
        df.repartitionByRange(n, *group, *order, F.rand(3)).withColumn("_pid", F.spark_partition_id()), name)
    inner = Window.partitionBy(*group, "_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*group, "_pid").agg(F.sum(value).alias("_sum"))
    outer = (Window.partitionBy(*group) if group else Window.partitionBy()).orderBy("_pid") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("_sum").over(outer), F.lit(0))).drop("_sum")
    return rows.withColumn("before_in", F.coalesce(F.sum(value).over(inner), F.lit(0))), offsets


def source_targets(scratch: Scratch, sized: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS,
                   cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """(_skey, source_size, target) of every source; the driver gets four sums per round, no source rows."""
    sources = sized.groupBy("_skey").agg(F.sum("size").alias("source_size"))
    ranked, offsets = _with_prefix(scratch, sources.withColumn("_one", F.lit(1)), "ranked", [], ["_skey"], "_one")
    rank = (F.col("offset") + F.col("before_in")) % len(cycle)
    weight = F.element_at(F.array(*map(F.lit, cycle)), (rank + 1).cast("int"))
    sources = scratch.write(ranked.join(offsets, "_pid").select("_skey", "source_size", weight.alias("weight")), "sources")
    cap, w = F.col("source_size") * max_epochs, F.col("weight")
    share_of_one, capped = 0.0, -1
    while True:  # reshare what capped sources cannot take; the share of one weight unit only rises
        over = w * F.lit(share_of_one) > cap
        row = sources.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, cap)).alias("cap"),
                          F.sum(F.when(~over, w)).alias("free"), F.count(F.when(over, 1)).alias("n")).first()
        if not row.free or row.n == capped:
            break
        capped, share_of_one = row.n, (share * row.all - (row.cap or 0)) / row.free
    return sources.select("_skey", "source_size", F.least(cap.cast("double"), w * F.lit(share_of_one)).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                share: float = SHARE, max_epochs: int = MAX_EPOCHS, carry: bool = False) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, copies.

    ``taken`` cuts the last document of a source inside; ``copies`` is the
    number of whole documents nearest to that, for writing the mix out.
    ``carry`` adds the input row as the struct column ``row``.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    ident = F.col(id_col)
    sized = docs.select(
        ident.alias("doc_id"), n_words(text_col).alias("size"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("~null")).alias("_skey"),
        F.md5(F.concat(F.coalesce(ident.cast("string"), F.lit("")), F.lit(f":{SEED}"))).alias("_key"),
        *([F.struct(*docs.columns).alias("row"), F.xxhash64(*docs.columns).alias("_tie")] if carry else []))
    rows, offsets = _with_prefix(scratch, sized, "docs", ["_skey"], ["_key", "doc_id", "size", *["_tie"] * carry], "size")
    targets = source_targets(scratch, rows, share, max_epochs)
    # what a source needs comes with the offset of a range, so that no join key holds a whole source
    offsets = scratch.write(offsets.join(targets, "_skey"), "offsets")
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    room = budget - epochs * F.col("source_size") - F.col("offset") - F.col("before_in")
    part = F.greatest(F.least(room, F.col("size")), F.lit(0))
    return rows.join(offsets, ["_skey", "_pid"]).select(
        "doc_id", "size", "source_size", "target",
        (epochs * F.col("size") + part).cast("long").alias("taken"),
        (epochs + F.when((F.col("size") > 0) & (part * 2 >= F.col("size")), 1).otherwise(0)).cast("long").alias("copies"),
        *["row"] * carry)


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def mixing_sql(documents: str = "documents") -> str:
    """DuckDB SQL of the same mix, with the closed form of the resharing."""
    cases = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(CYCLE))
    return f"""
WITH sized AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '{WORD_SQL}')), 0) AS size,
         coalesce('=' || source, '~null') AS skey,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{SEED}') AS k FROM {documents}),
src AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY skey),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY skey) - 1) % {len(CYCLE)} {cases} END AS w FROM src),
tot AS (SELECT CAST({SHARE} AS DOUBLE) * sum(source_size) AS all_share, sum(w) AS all_w FROM weighed),
steps AS (
  SELECT skey, source_size, w, row_number() OVER o AS i,
         coalesce(CAST(sum({MAX_EPOCHS} * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS caps,
         coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ws
  FROM weighed WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / w, skey)),
share AS (
  SELECT arg_min((all_share - caps) / (all_w - ws), i) AS unit FROM steps, tot
  WHERE (all_share - caps) / (all_w - ws) * w <= {MAX_EPOCHS} * source_size),
target AS (SELECT skey, source_size, least(CAST({MAX_EPOCHS} * source_size AS DOUBLE), w * unit) AS target FROM weighed, share),
run AS (SELECT *, coalesce(CAST(sum(size) OVER (PARTITION BY skey ORDER BY k, doc_id, size
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before FROM sized),
cut AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS e FROM run JOIN target USING (skey)),
part AS (SELECT *, greatest(least(CAST(floor(target) AS BIGINT) - e * source_size - before, size), 0) AS p FROM cut)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(e * size + p AS BIGINT) AS taken,
       CAST(e + CASE WHEN size > 0 AND p * 2 >= size THEN 1 ELSE 0 END AS BIGINT) AS copies FROM part
"""


WORD_SQL = r"[^\x20\x09-\x0D]+"
OP10_SQL = mixing_sql()
