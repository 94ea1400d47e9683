"""Corpus and curation-list readers, result writers.

* JSON corpus: JSON Lines (with an explicit ``design_idx``), or one JSON array
  per file, whose elements are numbered over all files; both are splittable.
* Bare-string files (``source_code: array<string>``) are normalised to the
  struct form with a null file name.
* Outputs are partitioned Parquet / JSON Lines / CSV written by executors, or
  Parquet files in one order with a manifest (``write_in_order``).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.curate import SOURCE_KEYS
from ..operators.dedup import _checkpoint
from .json_array import read_elements

FILE = T.StructType([T.StructField("file_name", T.StringType()), T.StructField("file_content", T.StringType())])
DESIGN_SCHEMA = T.StructType([
    T.StructField("design_idx", T.LongType()),
    T.StructField("algo_name", T.StringType()),
    T.StructField("source_name", T.StringType()),
    T.StructField("source_code", T.ArrayType(FILE)),
])


class EmptyInput(ValueError):
    """Raised by the load guard when an input has no rows."""


def load_guard(df: DataFrame, what: str = "input") -> DataFrame:
    if df.isEmpty():
        raise EmptyInput(f"{what} has no rows")
    return df


def read_design_array(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of designs, one array per file (a file, a folder or a glob); see ``read_designs_and_rejects``."""
    return read_designs_and_rejects(spark, path)[0]


def read_designs_and_rejects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(designs, rejects) of JSON arrays.

    Each element is a row of its own; a file is split over tasks wherever it is
    large (``sources.json_array``). ``design_idx`` numbers all elements in the
    order of paths and positions. Keys other than the known ones are carried
    through as variants (those named like a column made here get the prefix
    ``input_``). Rejects (``design_idx``, ``reason``, ``path``, ``offset`` in
    bytes) end no run: elements that are no JSON, or no object, or whose
    ``source_code`` is no list, the last element of an array that is cut off,
    and files that hold no array (these without a ``design_idx``).
    """
    load_guard(spark.read.text(path), path)
    elements, files = read_elements(spark, path)
    sizes = elements.groupBy("path").agg((F.max("element") + 1).alias("n"))
    before = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy(F.lit(0)).orderBy("path").rowsBetween(Window.unboundedPreceding, -1))
    placed = files.join(sizes, "path", "left").select(
        "path", "ends", F.coalesce(before, F.lit(0)).alias("_before"), (F.coalesce("n", F.lit(0)) - 1).alias("_last"))
    parsed = _checkpoint(elements.join(placed, "path").select(
        (F.col("_before") + F.col("element")).alias("_idx"), "path", "offset", (~F.col("ends") & (F.col("element") == F.col("_last"))).alias("_cut"),
        F.try_parse_json("text").alias("_v")))
    files_bad = files.where("not is_array").select(F.lit(None).cast("long").alias("design_idx"), F.lit("the file is no JSON array").alias("reason"),
                                                   "path", F.lit(0).cast("long").alias("offset"))
    load_guard(parsed.select("_idx").unionByName(files_bad.select(F.col("design_idx").alias("_idx"))), path)
    code = F.expr("try_variant_get(_v, '$.source_code', 'variant')")
    judged = parsed.withColumn("_code", code).withColumn("_parts", F.expr("try_variant_get(_code, '$', 'array<variant>')"))
    reason = (F.when(F.col("_cut"), "the element is cut off").when(F.col("_v").isNull(), "the element is no JSON")
              .when(~F.expr("schema_of_variant(_v)").startswith("OBJECT"), "the element is no object")
              .when(F.col("_code").isNotNull() & ~F.expr("is_variant_null(_code)") & F.col("_parts").isNull(), "source_code is no list"))
    judged = judged.withColumn("_reason", reason)
    good = judged.where("_reason is null")
    keys = good.select(F.explode(F.map_keys(F.expr("cast(_v as map<string, variant>)"))).alias("k")).distinct()
    # the attributes of the corpus: few, whatever its size
    extra = sorted(r.k for r in keys.collect() if r.k not in ("algo_name", "source_name", "source_code"))
    names = {c: f"input_{c}" if c in ("design_idx", "files") else c for c in extra}
    fields = F.expr("cast(_v as map<string, variant>)")
    designs = good.select(
        F.col("_idx").alias("design_idx"), *(F.expr(f"try_variant_get(_v, '$.{c}', 'string')").alias(c) for c in ("algo_name", "source_name")),
        F.transform("_parts", _file_struct).alias("files"), *(F.element_at(fields, F.lit(c)).alias(names[c]) for c in extra))
    rejects = judged.where("_reason is not null").select(F.col("_idx").alias("design_idx"), F.col("_reason").alias("reason"), "path", "offset").unionByName(files_bad)
    return designs, rejects


def _file_struct(f):
    """Variant file -> struct: an object gives its fields, a string is the content."""
    name = F.call_function("try_variant_get", f, F.lit("$.file_name"), F.lit("string"))
    content_obj = F.call_function("try_variant_get", f, F.lit("$.file_content"), F.lit("string"))
    content_str = F.call_function("try_variant_get", f, F.lit("$"), F.lit("string"))
    return F.struct(name.alias("file_name"),
                    F.coalesce(content_obj, F.when(name.isNull(), content_str)).alias("file_content"))


def read_design_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines corpus written by ``write_designs`` (keeps ``design_idx`` and further keys); splittable."""
    load_guard(spark.read.text(path), path)
    known = {f.name for f in DESIGN_SCHEMA}
    found = spark.read.option("mode", "FAILFAST").option("primitivesAsString", True).json(path).schema
    schema = T.StructType([*DESIGN_SCHEMA, *(f for f in found if f.name not in known)])
    return spark.read.option("mode", "FAILFAST").schema(schema).json(path).withColumnRenamed("source_code", "files")


def read_keyed_json(spark: SparkSession, path: str) -> DataFrame:
    """Keyed JSON objects ``{name: value}`` to rows ``(key, source, is_struct)``.

    A value that is an object gives its source by the first of SOURCE_KEYS that
    it has; other values have none. Each file is one object in one value.
    """
    whole = spark.read.option("multiLine", True).option("mode", "FAILFAST").option("singleVariantColumn", "v").json(path)
    pairs = whole.select(F.explode(F.expr("cast(v as map<string, variant>)")).alias("key", "value"))
    is_struct = F.expr("schema_of_variant(value)").startswith("OBJECT")
    source = F.coalesce(*(F.expr(f"try_variant_get(value, '$.{k}', 'string')") for k in SOURCE_KEYS))
    return pairs.select("key", F.when(is_struct, source).alias("source"), is_struct.alias("is_struct"))


def read_curation_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header ``algo_name,source_name``."""
    return (spark.read.option("header", True).schema("algo_name string, source_name string").csv(path))


def write_designs(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Kept/selected designs, same fields as the input, sorted by ``design_idx`` within the output."""
    out = df.withColumnRenamed("files", "source_code") if "files" in df.columns else df
    out.sortWithinPartitions("design_idx").write.mode("overwrite").format(fmt).save(path)


MANIFEST = "manifest"


def write_in_order(df: DataFrame, path: str, *order: str, files: int | None = None) -> None:
    """Rows in one order over all files: ``path/rows`` (Parquet, files numbered in that order) and ``path/manifest``.

    Rows are range-partitioned by ``order`` (which should be unique) and sorted within a file, so no task sorts the
    whole; the manifest has a row a file: name, place of its first row, rows.
    """
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    where = os.path.join(path, "rows")
    df.repartitionByRange(n, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(where)
    held = df.sparkSession.read.parquet(where).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n_rows"))
    before = F.sum("n_rows").over(Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    (held.select("file", F.coalesce(before, F.lit(0)).alias("first"), "n_rows")
     .coalesce(1).write.mode("overwrite").json(os.path.join(path, MANIFEST)))


def read_in_order(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``write_in_order`` with ``position``, their place in the order (from 0): file by file from the manifest."""
    manifest = spark.read.schema("file string, first long, n_rows long").json(os.path.join(path, MANIFEST))
    rows = spark.read.parquet(os.path.join(path, "rows"))
    placed = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_nth"))
    return placed.join(manifest, placed["_file"] == manifest["file"]).select(*rows.columns, (F.col("first") + F.col("_nth")).alias("position"))


def write_name_source_csv(df: DataFrame, path: str) -> None:
    """Header + one (algo_name, source_name) row per design, 'Unknown' for missing values."""
    (df.select(F.coalesce("algo_name", F.lit("Unknown")).alias("algo_name"),
               F.coalesce("source_name", F.lit("Unknown")).alias("source_name"), "design_idx")
     .sortWithinPartitions("design_idx").drop("design_idx")
     .write.mode("overwrite").option("header", True).csv(path))


def write_dedup_report(spark: SparkSession, path: str, params: dict, result, corpus: DataFrame) -> None:
    """Full run report as four tables: params (1 row), metrics (1 row), duplicates, kept rows."""
    spark.createDataFrame([tuple(str(v) for v in params.values())],
                          ", ".join(f"{k} string" for k in params)).write.mode("overwrite").json(
        os.path.join(path, "params"))
    result.stats().write.mode("overwrite").json(os.path.join(path, "metrics"))
    result.links.write.mode("overwrite").parquet(os.path.join(path, "duplicates"))
    write_designs(corpus.join(result.kept, "design_idx", "left_semi"), os.path.join(path, "kept"))
