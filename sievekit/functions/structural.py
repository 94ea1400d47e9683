"""Structural feature vector of a design, computed row-locally over its file array.

Counts are summed over files with ``aggregate`` on the ``files`` array, so
the 23 features need no explode and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

# FIXED VALUES: order of the enhanced (23) and basic (11) vectors
ENHANCED_FEATURES = (
    "file_count", "log_total_lines", "avg_lines_per_file", "code_density",
    "log_function_count", "log_loop_count", "include_count", "pragma_count",
    "class_count", "template_count", "nested_loop_count", "conditional_count",
    "pointer_usage", "array_usage", "hls_directive_count", "ap_type_count",
    "complexity_ratio", "hls_ratio", "file_type_count", "ext_cpp", "ext_h",
    "ext_c", "ext_hpp",
)
BASIC_FEATURES = (
    "file_count", "total_lines", "avg_lines_per_file", "code_density",
    "function_count", "loop_count", "include_count", "file_type_count",
    "ext_cpp", "ext_h", "ext_c",
)


def _content(f: Column) -> Column:
    return F.coalesce(f["file_content"], F.lit(""))


def file_extension(name: Column) -> Column:
    """Lower-cased text after the last '.', null when the name has no '.'."""
    return F.when(name.contains("."), F.lower(F.element_at(F.split(name, r"\."), -1)))


def _sum_over_files(files: Column, per_file) -> Column:
    return F.aggregate(F.transform(files, per_file), F.lit(0).cast("bigint"),
                       lambda acc, x: acc + x)


def _match_counter(pattern: str):
    # one-argument lambdas only: Spark passes (element, index) to two-argument ones
    # (?U): \\w, \\b and \\s in their Unicode sense
    return lambda f: F.regexp_count(_content(f), F.lit("(?U)" + pattern))


def _equals(value: str):
    return lambda x: x == value


def counters(files: Column) -> dict[str, Column]:
    """Raw per-design counters (sums over files)."""
    c = {
        "file_count": F.size(files).cast("bigint"),
        "total_lines": _sum_over_files(
            files, lambda f: F.length(_content(f)) - F.length(F.replace(_content(f), F.lit("\n"), F.lit(""))) + 1),
        "total_chars": _sum_over_files(files, lambda f: F.length(_content(f))),
    }
    for name, pat in K.STRUCTURAL_PATTERNS:
        c[name] = _sum_over_files(files, _match_counter(pat))
    exts = F.filter(F.transform(files, lambda f: file_extension(f["file_name"])), lambda e: e.isNotNull())
    c["file_type_count"] = F.size(F.array_distinct(exts)).cast("bigint")
    for e in ("cpp", "h", "c", "hpp"):
        c["ext_" + e] = F.size(F.filter(exts, _equals(e))).cast("bigint")
    return c


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def enhanced_columns() -> list[Column]:
    """The 23 features as named doubles, from the ``_``-prefixed raw counters."""
    lines = F.col("_total_lines")
    vals = {
        "file_count": F.col("_file_count"),
        "log_total_lines": F.log1p(lines),
        "avg_lines_per_file": _ratio(lines, F.col("_file_count")),
        "code_density": _ratio(F.col("_total_chars"), lines),
        "log_function_count": F.log1p(F.col("_function_count")),
        "log_loop_count": F.log1p(F.col("_loop_count")),
        "complexity_ratio": _ratio(F.col("_nested_loop_count") + F.col("_conditional_count"), lines),
        "hls_ratio": _ratio(F.col("_hls_directive_count"), lines),
    }
    return [vals.get(n, F.col("_" + n)).cast("double").alias(n) for n in ENHANCED_FEATURES]


def basic_columns() -> list[Column]:
    """The 11 basic features (no log transform)."""
    lines = F.col("_total_lines")
    vals = {
        "file_count": F.col("_file_count"), "total_lines": lines,
        "avg_lines_per_file": _ratio(lines, F.col("_file_count")),
        "code_density": _ratio(F.col("_total_chars"), lines),
    }
    return [vals.get(n, F.col("_" + n)).cast("double").alias(n) for n in BASIC_FEATURES]


def with_structural(df, files_col: str = "files", basic: bool = False):
    """Add the 23 (or 11 basic) structural feature columns to ``df``.

    The raw counters are computed in one projection over the file array;
    the features are derived from them in the next.
    """
    c = counters(F.col(files_col))
    staged = df.select("*", *[v.alias("_" + k) for k, v in c.items()])
    cols = basic_columns() if basic else enhanced_columns()
    return staged.select(*df.columns, *cols)
