"""A C++/HLS code corpus derived from ``part``, one design per part row.

The file texts are plain SQL expressions built only from ``||``, ``repeat``,
``replace``, ``lower``, ``%``, ``CASE`` and ``chr(10)``, so that Spark and the
DuckDB oracle produce byte-identical strings from the same row. Rows with the
same ``p_size`` and ``p_type`` share the body except for one constant and the
comments (equal after masking); odd keys add one identifier; keys divisible by
97 have no files at all.
"""

from __future__ import annotations

NL = "chr(10)"
K = "CAST(p_partkey AS STRING)"
T = "lower(p_type)"


def _cat(*parts: str) -> str:
    return "(" + " || ".join(parts) + ")"


ALGO_NAME_SQL = _cat("replace(p_name, ' ', '_')", "'_'", K)
SOURCE_NAME_SQL = "p_brand"
IS_EMPTY_SQL = "(p_partkey % 97 = 0)"
HAS_FILE2_SQL = "(p_size % 3 < 2)"

FILE1_NAME_SQL = "(CASE WHEN p_partkey % 5 = 0 THEN 'kernel.c' ELSE 'kernel.cpp' END)"

_NESTED_LOOP = _cat(
    "'  for (int i = 0; i < 64; i++) {'", NL,
    "'    for (int j = 0; j < 8; j++) {'", NL,
    "'      out[j] += in_'", T, "'[i] * j;'", NL,
    "'    }'", NL, "'  }'", NL)
_FLAT_LOOP = _cat(
    "'  for (int i = 0; i < 64; i++) {'", NL,
    "'    out[i] = *in_'", T, "' + i;'", NL, "'  }'", NL)
_BRANCHES = (
    "(CASE p_size % 5"
    " WHEN 1 THEN " + _cat("'  if (out[0] > 0) { out[0] = 1; }'", NL) +
    " WHEN 2 THEN " + _cat("'  switch (out[1]) { case 1: break; default: break; }'", NL) +
    " WHEN 3 THEN " + _cat("'  if (out[0] > 0) { out[0] = 1; }'", NL,
                           "'  switch (out[1]) { case 1: out[1] = 0; break; default: break; }'", NL) +
    " WHEN 4 THEN " + _cat("'  while (out[3] > 0) { out[3]--; }'", NL) +
    " ELSE '' END)")

FILE1_CONTENT_SQL = _cat(
    "'#include <ap_int.h>'", NL, "'#include <hls_stream.h>'", NL,
    "'// kernel '", K, "' for '", "p_name", NL,
    "repeat(" + _cat("'#pragma HLS PIPELINE II=1'", NL) + ", p_size % 3)",
    "(CASE WHEN p_size % 2 = 0 THEN " + _cat("'ap_int<8> acc_'", T, "' = '", K, "';'")
    + " ELSE " + _cat("'float acc_'", T, "' = '", K, "'.5;'") + " END)", NL,
    "'void '", T, "'_kernel(int *in_'", T, "', int out[64]) {'", NL,
    "repeat(CASE WHEN p_size % 2 = 0 THEN " + _NESTED_LOOP + " ELSE " + _FLAT_LOOP
    + " END, p_size % 4 + 1)",
    _BRANCHES,
    "(CASE WHEN p_partkey % 2 = 1 THEN "
    + _cat("'  int tmp_v'", "CAST(p_partkey % 4 AS STRING)", "' = out[2];'", NL) + " ELSE '' END)",
    "'  /* block '", K, "' */'", NL,
    "'  const char *msg = \"kernel '", "p_name", "'\";'", NL,
    "'  char c = ''x'';'", NL,
    "'}'", NL)

FILE2_NAME_SQL = "(CASE WHEN p_size % 3 = 0 THEN 'kernel.h' ELSE 'kernel.hpp' END)"
FILE2_CONTENT_SQL = (
    "(CASE WHEN p_size % 3 = 0 THEN "
    + _cat("'template <typename T>'", NL, "'T '", T, "'_max(T a, T b) { return a > b ? a : b; }'", NL)
    + " ELSE "
    + _cat("'class '", T, "'_engine {'", NL, "'public:'", NL,
           "'  int run(int x) { return x * 2; }'", NL, "'};'", NL)
    + " END)")


def spark_files_sql() -> str:
    """Spark SQL expression of the ``files`` array (empty for the 1-in-97 rows)."""
    f1 = f"named_struct('file_name', {FILE1_NAME_SQL}, 'file_content', {FILE1_CONTENT_SQL})"
    f2 = (f"CASE WHEN {HAS_FILE2_SQL} THEN named_struct('file_name', {FILE2_NAME_SQL}, "
          f"'file_content', {FILE2_CONTENT_SQL}) END")
    return f"filter(array({f1}, {f2}), f -> f IS NOT NULL AND NOT {IS_EMPTY_SQL})"


def oracle_files_sql(table: str = "part") -> str:
    """DuckDB: long form ``(design_idx, file_pos, file_name, file_content)``."""
    return (
        f"SELECT p_partkey AS design_idx, 1 AS file_pos, {FILE1_NAME_SQL} AS file_name, "
        f"{FILE1_CONTENT_SQL} AS file_content FROM {table} WHERE NOT {IS_EMPTY_SQL} "
        f"UNION ALL "
        f"SELECT p_partkey AS design_idx, 2 AS file_pos, {FILE2_NAME_SQL} AS file_name, "
        f"{FILE2_CONTENT_SQL} AS file_content FROM {table} "
        f"WHERE NOT {IS_EMPTY_SQL} AND {HAS_FILE2_SQL}")


def oracle_designs_sql(table: str = "part") -> str:
    return (f"SELECT p_partkey AS design_idx, {ALGO_NAME_SQL} AS algo_name, "
            f"{SOURCE_NAME_SQL} AS source_name FROM {table}")
