"""DuckDB SQL that recomputes each registered query from the raw tables.

The SQL is written independently of the Spark plans: brute-force joins, a
recursive walk for first-wins dedup, long-form arrays. Regexes are the same
portable patterns (RE2 accepts them), lambdas use DuckDB's ``lambda x: ...``.
"""

from __future__ import annotations

from ..functions import constants as K
from ..sources import code_corpus as CC


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def _in(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def strip_comments(x: str) -> str:
    x = f"regexp_replace({x}, {q(K.LINE_COMMENT_RE)}, '', 'g')"
    return f"regexp_replace({x}, {q(K.BLOCK_COMMENT_RE)}, '', 'g')"


def lexical_tokens(x: str, hls_aware: bool = True) -> str:
    x = strip_comments(x)
    x = f"regexp_replace({x}, {q(K.DQUOTE_RE)}, {q(chr(34) * 2)}, 'g')"
    x = f"regexp_replace({x}, {q(K.SQUOTE_RE)}, {q(chr(39) * 2)}, 'g')"
    case = f"CASE WHEN regexp_matches(lower(t), {q(K.DIGITS_RE)}) THEN '<NUM>' "
    if hls_aware:
        case += f"WHEN lower(t) IN {_in(K.LEXICAL_HLS_KEYWORDS)} THEN 'HLS_' || upper(lower(t)) "
    case += f"WHEN lower(t) IN {_in(K.LEXICAL_CPP_KEYWORDS)} THEN 'CPP_' || upper(lower(t)) ELSE lower(t) END"
    return f"list_transform(regexp_extract_all({x}, {q(K.TOKEN_RE)}), lambda t: {case})"


def semantic_tokens(x: str) -> str:
    x = strip_comments(x)
    x = f"regexp_replace({x}, {q(K.DQUOTE_RE)}, {q(chr(34) + 'STRING' + chr(34))}, 'g')"
    x = f"regexp_replace({x}, {q(K.SQUOTE_RE)}, {q(chr(39) + 'CHAR' + chr(39))}, 'g')"
    t = "lower(t)"
    case = (
        f"CASE WHEN length({t}) = 1 AND {t} IN {_in(K.SEMANTIC_DROPPED_PUNCT)} THEN NULL "
        f"WHEN regexp_matches({t}, {q(K.DIGITS_RE)}) OR {t} = 'num' THEN 'NUM' "
        f"WHEN {t} = 'float' THEN 'FLOAT' WHEN {t} = 'string' THEN 'STRING' WHEN {t} = 'char' THEN 'CHAR' "
        f"WHEN {t} IN {_in(K.SEMANTIC_HLS_KEYWORDS)} THEN 'HLS_' || upper({t}) "
        f"WHEN {t} IN {_in(K.SEMANTIC_CPP_KEYWORDS)} THEN 'CPP_' || upper({t}) "
        f"WHEN {t} IN {_in(K.SEMANTIC_ALGORITHM_KEYWORDS)} THEN 'ALG_' || upper({t}) "
        f"WHEN regexp_matches({t}, {q(K.ALPHA_RE)}) AND length({t}) > 1 THEN {t} ELSE NULL END")
    return (f"list_filter(list_transform(regexp_extract_all({x}, {q(K.TOKEN_RE)}), lambda t: {case}), "
            f"lambda t: t IS NOT NULL)")


def shingle_list(toks: str, k: int = 5) -> str:
    return (f"CASE WHEN len({toks}) >= {k} THEN list_distinct(list_transform(range(1, len({toks}) - {k} + 2), "
            f"lambda i: array_to_string(list_slice({toks}, i, i + {k - 1}), ' '))) ELSE [] END")


def hash31(s: str) -> str:
    return f"(('0x' || substr(md5({s}), 1, 8))::BIGINT % 2147483647)"


# ---- corpora ------------------------------------------------------------

DOC_FILES = "SELECT doc_id AS design_idx, 1 AS file_pos, NULL::VARCHAR AS file_name, text AS file_content FROM documents"
DOC_DESIGNS = "SELECT doc_id AS design_idx, 'doc_' || CAST(doc_id AS VARCHAR) AS algo_name, source AS source_name FROM documents"
CODE_FILES = CC.oracle_files_sql("part")
CODE_DESIGNS = CC.oracle_designs_sql("part")


def corpus_ctes(corpus: str) -> str:
    files, designs = (DOC_FILES, DOC_DESIGNS) if corpus == "documents" else (CODE_FILES, CODE_DESIGNS)
    return f"designs AS ({designs}), files AS ({files})"


def lexical_ctes(corpus: str, k: int = 5) -> str:
    """designs, files, toks(design_idx, toks), sh(design_idx, s) distinct, sets(design_idx, n, set_key)."""
    return corpus_ctes(corpus) + f""",
ftoks AS (SELECT design_idx, file_pos, {lexical_tokens('file_content')} AS t FROM files),
toks AS (SELECT d.design_idx, coalesce(flatten(list(f.t ORDER BY f.file_pos) FILTER (WHERE f.t IS NOT NULL)), []) AS toks
         FROM designs d LEFT JOIN ftoks f USING (design_idx) GROUP BY d.design_idx),
shl AS (SELECT design_idx, {shingle_list('toks', k)} AS shl FROM toks),
sh AS (SELECT design_idx, unnest(shl) AS s FROM shl),
sets AS (SELECT design_idx, count(*) AS n, md5(string_agg(s, chr(1) ORDER BY s)) AS set_key FROM sh GROUP BY design_idx)"""


def exact_pairs_ctes(corpus: str, threshold: float, k: int = 5) -> str:
    """... reps(rep, set_key), edges(i, j, sim) among representatives of equal sets."""
    return lexical_ctes(corpus, k) + f""",
reps AS (SELECT set_key, min(design_idx) AS rep FROM sets GROUP BY set_key),
members AS (SELECT s.design_idx AS id, r.rep FROM sets s JOIN reps r USING (set_key)),
rsh AS (SELECT sh.design_idx, sh.s FROM sh JOIN reps r ON sh.design_idx = r.rep),
rn AS (SELECT design_idx, count(*) AS n FROM rsh GROUP BY design_idx),
ov AS (SELECT a.design_idx AS i, b.design_idx AS j, count(*) AS overlap
       FROM rsh a JOIN rsh b ON a.s = b.s AND a.design_idx < b.design_idx GROUP BY 1, 2),
edges AS (SELECT ov.i, ov.j, ov.overlap, ov.overlap / (na.n + nb.n - ov.overlap) AS sim
          FROM ov JOIN rn na ON na.design_idx = ov.i JOIN rn nb ON nb.design_idx = ov.j
          WHERE ov.overlap / (na.n + nb.n - ov.overlap) >= {threshold})"""


def first_wins_ctes() -> str:
    """Sequential greedy walk over nodes with edges (needs ``edges(i, j, sim)``, ``members``, ``sets``)."""
    return """,
nodes AS (SELECT node, row_number() OVER (ORDER BY node) AS rn
          FROM (SELECT i AS node FROM edges UNION SELECT j FROM edges)),
walk AS (SELECT 0::BIGINT AS rn, []::BIGINT[] AS kept
         UNION ALL
         SELECT w.rn + 1,
                CASE WHEN EXISTS (SELECT 1 FROM edges e WHERE e.j = n.node AND list_contains(w.kept, e.i))
                     THEN w.kept ELSE list_append(w.kept, n.node) END
         FROM walk w JOIN nodes n ON n.rn = w.rn + 1),
kept_nodes AS (SELECT unnest(kept) AS node FROM walk WHERE rn = (SELECT count(*) FROM nodes)),
rep_links AS (SELECT e.j AS duplicate_index, arg_min(e.i, e.i) AS original_index, arg_min(e.sim, e.i) AS similarity
              FROM edges e JOIN kept_nodes k ON k.node = e.i
              WHERE e.j NOT IN (SELECT node FROM kept_nodes) GROUP BY e.j),
links AS (SELECT duplicate_index, original_index, similarity FROM rep_links
          UNION ALL
          SELECT m.id, coalesce(l.original_index, m.rep), coalesce(l.similarity, 1.0)
          FROM members m LEFT JOIN rep_links l ON l.duplicate_index = m.rep WHERE m.id <> m.rep),
kept AS (SELECT design_idx FROM sets WHERE design_idx NOT IN (SELECT duplicate_index FROM links))"""


def with_recursive(body: str) -> str:
    return "WITH RECURSIVE " + body
