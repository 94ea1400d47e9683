"""Code complexity proxies (optional tier): cyclomatic proxy, Halstead counts,
and a third token profile that abstracts identifiers and literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .text import file_contents, raw_tokens, strip_comments

# FIXED VALUE: decision points of the cyclomatic proxy (if, for, case, &&, ||)
DECISION_RE = r"\b(if|for|case)\b|&&|\|\|"
WORD_RE = "^[" + K.WORD_CLASS + "]+$"


def cyclomatic(files: Column) -> Column:
    """1 + decision points over all files (comments removed)."""
    counts = F.transform(file_contents(files), lambda c: F.regexp_count(strip_comments(c), F.lit(DECISION_RE)))
    return F.aggregate(counts, F.lit(1).cast("bigint"), lambda acc, x: acc + x)


def _code_tokens(files: Column) -> Column:
    return F.flatten(F.transform(file_contents(files), lambda c: raw_tokens(strip_comments(c))))


def is_operator(t: Column) -> Column:
    """Symbols and C++ keywords are operators; identifiers and numbers are operands."""
    return (~t.rlike(WORD_RE)) | F.lower(t).isin(list(K.LEXICAL_CPP_KEYWORDS))


def halstead(files: Column) -> dict[str, Column]:
    toks = _code_tokens(files)
    ops = F.filter(toks, is_operator)
    opd = F.filter(toks, lambda t: ~is_operator(t))
    return {
        "distinct_operators": F.size(F.array_distinct(ops)),
        "distinct_operands": F.size(F.array_distinct(opd)),
        "total_operators": F.size(ops),
        "total_operands": F.size(opd),
    }


def abstract_tokens(files: Column) -> Column:
    """Identifiers -> IDENTIFIER, numbers and string/char literals -> LITERAL, keywords and symbols kept."""
    def per_file(c: Column) -> Column:
        c = strip_comments(c)
        c = F.regexp_replace(c, K.DQUOTE_RE, " LITERAL ")
        c = F.regexp_replace(c, K.SQUOTE_RE, " LITERAL ")
        def norm(t: Column) -> Column:
            lt = F.lower(t)
            return (F.when(t == "LITERAL", F.lit("LITERAL"))
                    .when(lt.rlike(K.DIGITS_RE), F.lit("LITERAL"))
                    .when(lt.isin(list(K.LEXICAL_CPP_KEYWORDS)), lt)
                    .when(t.rlike(WORD_RE), F.lit("IDENTIFIER"))
                    .otherwise(t))
        return F.transform(raw_tokens(c), norm)
    return F.flatten(F.transform(file_contents(files), per_file))
