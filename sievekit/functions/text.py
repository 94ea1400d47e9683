"""Text profiles as Spark Column expressions (no UDF).

Two profiles exist:

* lexical  - used for near-duplicate shingling: strip comments, blank out
  string/char literals, tokenise, lower-case, map digits and keywords.
* semantic - used for TF-IDF: strip comments, name literals, mask numbers,
  drop punctuation and non-alphabetic identifiers, prefix keywords.

All regular expressions are portable between the JVM regex engine and RE2
(the DuckDB oracle), see ``constants``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def file_contents(files: Column) -> Column:
    """``array<struct<file_name,file_content>>`` -> ``array<string>`` ('' for null)."""
    return F.transform(files, lambda f: F.coalesce(f["file_content"], F.lit("")))


def strip_comments(text: Column) -> Column:
    """Line comments first, then block comments (order matters, see quirks Q2/Q3)."""
    text = F.regexp_replace(text, K.LINE_COMMENT_RE, "")
    return F.regexp_replace(text, K.BLOCK_COMMENT_RE, "")


def raw_tokens(text: Column) -> Column:
    """Words (letters/digits/_) or single non-blank symbols, in order."""
    return F.regexp_extract_all(text, F.lit(K.TOKEN_RE), 0)


def lower_tokens(text: Column) -> Column:
    """Tokens lower-cased one by one, in a pass of their own: the rules below look at each several times."""
    return F.transform(raw_tokens(text), F.lower)


def _lexical_token(t: Column, hls_aware: bool, fix_case: bool) -> Column:
    """What a lower-cased token becomes."""
    hls = [w.lower() for w in K.LEXICAL_HLS_KEYWORDS] if fix_case else list(K.LEXICAL_HLS_KEYWORDS)
    out = F.when(t.rlike(K.DIGITS_RE), F.lit("<NUM>"))
    if hls_aware:
        out = out.when(t.isin(hls), F.concat(F.lit("HLS_"), F.upper(t)))
    return out.when(t.isin(list(K.LEXICAL_CPP_KEYWORDS)), F.concat(F.lit("CPP_"), F.upper(t))).otherwise(t)


def lexical_tokens_of_text(text: Column, hls_aware: bool = True, fix_case: bool = False) -> Column:
    """Token list of one file in the lexical profile."""
    text = strip_comments(text)
    text = F.regexp_replace(text, K.DQUOTE_RE, '""')
    text = F.regexp_replace(text, K.SQUOTE_RE, "''")
    return F.transform(lower_tokens(text), lambda t: _lexical_token(t, hls_aware, fix_case))


def lexical_tokens(files: Column, hls_aware: bool = True, fix_case: bool = False) -> Column:
    """Tokens of all files of a design, concatenated in file order."""
    return F.flatten(F.transform(
        file_contents(files), lambda c: lexical_tokens_of_text(c, hls_aware, fix_case)))


def _semantic_token(t: Column) -> Column:
    """What a lower-cased token becomes; null if it is dropped."""
    return (
        F.when((F.length(t) == 1) & t.isin(list(K.SEMANTIC_DROPPED_PUNCT)), F.lit(None))
        # a whole word made of digits is what the number mask turns into NUM
        .when(t.rlike(K.DIGITS_RE) | (t == "num"), F.lit("NUM"))
        .when(t == "float", F.lit("FLOAT"))
        .when(t == "string", F.lit("STRING"))
        .when(t == "char", F.lit("CHAR"))
        .when(t.isin(list(K.SEMANTIC_HLS_KEYWORDS)), F.concat(F.lit("HLS_"), F.upper(t)))
        .when(t.isin(list(K.SEMANTIC_CPP_KEYWORDS)), F.concat(F.lit("CPP_"), F.upper(t)))
        .when(t.isin(list(K.SEMANTIC_ALGORITHM_KEYWORDS)), F.concat(F.lit("ALG_"), F.upper(t)))
        .when(t.rlike(K.ALPHA_RE) & (F.length(t) > 1), t)
    )


def semantic_tokens_of_text(text: Column) -> Column:
    """Token list of one file in the semantic profile (nulls removed)."""
    text = strip_comments(text)
    text = F.regexp_replace(text, K.DQUOTE_RE, '"STRING"')
    text = F.regexp_replace(text, K.SQUOTE_RE, "'CHAR'")
    toks = F.transform(lower_tokens(text), _semantic_token)
    return F.filter(toks, lambda t: t.isNotNull())


def semantic_tokens(files: Column) -> Column:
    """Semantic tokens of all files in file order (what the space-joined text holds)."""
    return F.flatten(F.transform(file_contents(files), semantic_tokens_of_text))


def semantic_files(files: Column) -> Column:
    """Semantic tokens of each file, in file order."""
    return F.transform(file_contents(files), semantic_tokens_of_text)


def semantic_text(per_file: Column) -> Column:
    """Space-joined semantic text of ``semantic_files``, per file then over files (empty files leave blanks)."""
    return F.array_join(F.transform(per_file, lambda t: F.array_join(t, " ")), " ")
