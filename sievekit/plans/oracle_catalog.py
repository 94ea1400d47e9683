"""DuckDB oracle SQL per registered query (same column names as the Spark side)."""

from __future__ import annotations

from . import oracle as O
from .catalog import DEDUP_THRESHOLD, K_SHINGLE

SQL: dict[str, str] = {}

SQL["name_source_list"] = f"""WITH {O.corpus_ctes('code')}
SELECT design_idx, coalesce(algo_name, 'Unknown') AS algo_name, coalesce(source_name, 'Unknown') AS source_name
FROM designs"""

SQL["count_per_source"] = f"""WITH {O.corpus_ctes('code')}
SELECT coalesce(source_name, 'Unknown') AS source_name, count(*)::BIGINT AS n_designs
FROM designs GROUP BY 1 ORDER BY 1"""

SQL["corpus_totals"] = f"""WITH {O.corpus_ctes('code')}
SELECT count(DISTINCT coalesce(source_name, 'Unknown'))::BIGINT AS n_sources, count(*)::BIGINT AS n_designs FROM designs"""

SQL["tokens_lexical"] = f"""WITH {O.lexical_ctes('documents', K_SHINGLE)}
SELECT design_idx, len(toks)::INTEGER AS n_tokens, md5(array_to_string(toks, ' ')) AS tokens_md5 FROM toks"""

SQL["shingles"] = f"""WITH {O.lexical_ctes('documents', K_SHINGLE)}
SELECT design_idx, len(shl)::INTEGER AS n_shingles,
       coalesce(list_sum(list_transform(shl, lambda s: {O.hash31('s')})), 0)::BIGINT AS shingle_checksum
FROM shl"""

SQL["valid_designs"] = f"""WITH {O.lexical_ctes('documents', K_SHINGLE)}
SELECT design_idx FROM sets"""

_EXACT_DOCS = O.exact_pairs_ctes("documents", DEDUP_THRESHOLD, K_SHINGLE)
_EXACT_CODE = O.exact_pairs_ctes("code", DEDUP_THRESHOLD, K_SHINGLE)

SQL["similar_pairs_exact"] = f"""WITH {_EXACT_DOCS}
SELECT i, j, overlap::INTEGER AS overlap, round(sim, 6) AS jaccard FROM edges"""

SQL["dedup_exact_kept"] = O.with_recursive(_EXACT_DOCS + O.first_wins_ctes()) + """
SELECT design_idx FROM kept"""

SQL["dedup_exact_links"] = O.with_recursive(_EXACT_DOCS + O.first_wins_ctes()) + """
SELECT duplicate_index, original_index, round(similarity, 6) AS similarity FROM links"""

SQL["dedup_stats"] = O.with_recursive(_EXACT_DOCS + O.first_wins_ctes()) + """
SELECT (SELECT count(*) FROM designs)::BIGINT AS original_count,
       (SELECT count(*) FROM sets)::BIGINT AS valid_count,
       (SELECT count(*) FROM kept)::BIGINT AS deduplicated_count,
       (SELECT count(*) FROM links)::BIGINT AS duplicate_count,
       'Exact' AS processing_mode,
       round((1 - (SELECT count(*) FROM kept) / (SELECT count(*) FROM designs)) * 100, 6) AS dedup_rate_pct"""

SQL["first10_duplicates"] = O.with_recursive(_EXACT_DOCS + O.first_wins_ctes()) + """
SELECT duplicate_index, original_index, round(similarity, 6) AS similarity FROM links
ORDER BY original_index, duplicate_index LIMIT 10"""

SQL["dedup_code_kept"] = O.with_recursive(_EXACT_CODE + O.first_wins_ctes()) + """
SELECT design_idx FROM kept"""

SQL["dedup_code_links"] = O.with_recursive(_EXACT_CODE + O.first_wins_ctes()) + """
SELECT duplicate_index, original_index, round(similarity, 6) AS similarity FROM links"""

# ---- semantic profile -------------------------------------------------------

def _semantic(corpus: str) -> str:
    return f"""WITH {O.corpus_ctes(corpus)},
ft AS (SELECT design_idx, file_pos, {O.semantic_tokens('file_content')} AS t FROM files)
SELECT d.design_idx, coalesce(sum(len(ft.t)), 0)::INTEGER AS n_tokens,
       md5(coalesce(string_agg(array_to_string(ft.t, ' '), ' ' ORDER BY ft.file_pos), '')) AS text_md5
FROM designs d LEFT JOIN ft USING (design_idx) GROUP BY d.design_idx"""


SQL["tokens_semantic"] = _semantic("code")
SQL["tokens_semantic_documents"] = _semantic("documents")

# ---- structural -------------------------------------------------------------
from ..functions import constants as _K  # noqa: E402

_count_cols = ",\n".join(
    f"       sum(len(regexp_extract_all(file_content, {O.q(p)})))::BIGINT AS {n}"
    for n, p in _K.STRUCTURAL_PATTERNS)
_STRUCT_BASE = f"""WITH {O.corpus_ctes('code')},
fx AS (SELECT *, CASE WHEN contains(file_name, '.') THEN lower(string_split(file_name, '.')[-1]) END AS ext FROM files),
per AS (SELECT design_idx, count(*)::BIGINT AS file_count,
       sum(length(file_content) - length(replace(file_content, chr(10), '')) + 1)::BIGINT AS total_lines,
       sum(length(file_content))::BIGINT AS total_chars,
{_count_cols},
       count(DISTINCT ext)::BIGINT AS file_type_count,
       count(*) FILTER (WHERE ext = 'cpp')::BIGINT AS ext_cpp, count(*) FILTER (WHERE ext = 'h')::BIGINT AS ext_h,
       count(*) FILTER (WHERE ext = 'c')::BIGINT AS ext_c, count(*) FILTER (WHERE ext = 'hpp')::BIGINT AS ext_hpp
FROM fx GROUP BY design_idx),
c AS (SELECT d.design_idx, {', '.join(f'coalesce(p.{n}, 0) AS {n}' for n in ['file_count', 'total_lines', 'total_chars'] + [n for n, _ in _K.STRUCTURAL_PATTERNS] + ['file_type_count', 'ext_cpp', 'ext_h', 'ext_c', 'ext_hpp'])}
      FROM designs d LEFT JOIN per p USING (design_idx))"""


def _r(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"


def _div(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0.0 END"


SQL["structural_features"] = _STRUCT_BASE + f"""
SELECT design_idx, {_r('file_count')} AS file_count, {_r('ln(1 + total_lines)')} AS log_total_lines,
  {_r(_div('total_lines', 'file_count'))} AS avg_lines_per_file, {_r(_div('total_chars', 'total_lines'))} AS code_density,
  {_r('ln(1 + function_count)')} AS log_function_count, {_r('ln(1 + loop_count)')} AS log_loop_count,
  {_r('include_count')} AS include_count, {_r('pragma_count')} AS pragma_count, {_r('class_count')} AS class_count,
  {_r('template_count')} AS template_count, {_r('nested_loop_count')} AS nested_loop_count,
  {_r('conditional_count')} AS conditional_count, {_r('pointer_usage')} AS pointer_usage,
  {_r('array_usage')} AS array_usage, {_r('hls_directive_count')} AS hls_directive_count,
  {_r('ap_type_count')} AS ap_type_count,
  {_r(_div('nested_loop_count + conditional_count', 'total_lines'))} AS complexity_ratio,
  {_r(_div('hls_directive_count', 'total_lines'))} AS hls_ratio,
  {_r('file_type_count')} AS file_type_count, {_r('ext_cpp')} AS ext_cpp, {_r('ext_h')} AS ext_h,
  {_r('ext_c')} AS ext_c, {_r('ext_hpp')} AS ext_hpp
FROM c"""

SQL["structural_basic"] = _STRUCT_BASE + f"""
SELECT design_idx, {_r('file_count')} AS file_count, {_r('total_lines')} AS total_lines,
  {_r(_div('total_lines', 'file_count'))} AS avg_lines_per_file, {_r(_div('total_chars', 'total_lines'))} AS code_density,
  {_r('function_count')} AS function_count, {_r('loop_count')} AS loop_count, {_r('include_count')} AS include_count,
  {_r('file_type_count')} AS file_type_count, {_r('ext_cpp')} AS ext_cpp, {_r('ext_h')} AS ext_h, {_r('ext_c')} AS ext_c
FROM c"""

SQL["extension_top5"] = f"""WITH {O.corpus_ctes('code')},
fx AS (SELECT design_idx, file_pos, CASE WHEN contains(file_name, '.') THEN lower(string_split(file_name, '.')[-1]) END AS ext FROM files)
SELECT ext AS extension, count(*)::BIGINT AS n_files FROM fx WHERE ext IS NOT NULL
GROUP BY ext ORDER BY count(*) DESC, min(design_idx * 10 + file_pos) LIMIT 5"""

# ---- curation -----------------------------------------------------------------
from ..sources import code_corpus as _CC  # noqa: E402

_CUR = f"""WITH {O.corpus_ctes('code')},
sel AS (SELECT DISTINCT algo_name, source_name FROM (
          SELECT {_CC.ALGO_NAME_SQL} AS algo_name, p_brand AS source_name FROM part WHERE p_partkey % 10 = 0
          UNION ALL SELECT * FROM (VALUES ('missing_kernel_a', 'Brand#0'), ('missing_kernel_b', 'Brand#99'),
                                          ('missing_kernel_c', 'nowhere')) v(algo_name, source_name))
        WHERE algo_name IS NOT NULL AND source_name IS NOT NULL),
usable AS (SELECT * FROM designs WHERE coalesce(algo_name, '') <> '' AND coalesce(source_name, '') <> '')"""

SQL["curated_semi"] = _CUR + """
SELECT design_idx, algo_name, source_name FROM usable u
WHERE EXISTS (SELECT 1 FROM sel s WHERE s.algo_name = u.algo_name AND s.source_name = u.source_name)"""

SQL["curated_missing"] = _CUR + """
SELECT algo_name, source_name FROM sel
EXCEPT SELECT algo_name, source_name FROM usable"""

SQL["curated_audit"] = _CUR + """
SELECT CASE WHEN coalesce(d.algo_name, '') <> '' AND coalesce(d.source_name, '') <> '' AND s.algo_name IS NOT NULL THEN 'kept'
            WHEN coalesce(d.algo_name, '') <> '' AND coalesce(d.source_name, '') <> '' THEN 'pair not listed'
            WHEN coalesce(d.algo_name, '') <> '' THEN 'no source' ELSE 'no name' END AS decision,
       count(*)::BIGINT AS n_designs
FROM designs d LEFT JOIN sel s ON s.algo_name = d.algo_name AND s.source_name = d.source_name
GROUP BY 1"""

SQL["curated_check"] = _CUR + """,
k AS (SELECT count(*) AS n FROM usable u WHERE EXISTS (SELECT 1 FROM sel s WHERE s.algo_name = u.algo_name AND s.source_name = u.source_name))
SELECT (SELECT n FROM k)::BIGINT AS filtered_count, (SELECT count(*) FROM sel)::BIGINT AS listed_count,
       (SELECT n FROM k) = (SELECT count(*) FROM sel) AS counts_match"""

SQL["sources_per_name"] = _CUR + """
SELECT algo_name, string_agg(DISTINCT source_name, ',' ORDER BY source_name) AS sources FROM sel GROUP BY algo_name"""

SQL["curated_keyed"] = _CUR + f""",
keyed AS (SELECT {_CC.ALGO_NAME_SQL} AS key,
                 CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 20 = 10 THEN 'Brand#0' ELSE p_brand END END AS source,
                 p_partkey % 3 <> 2 AS is_struct FROM part)
SELECT key, source, is_struct FROM keyed k
WHERE k.key IN (SELECT algo_name FROM sel)
  AND (NOT k.is_struct OR k.source IS NULL
       OR EXISTS (SELECT 1 FROM sel s WHERE s.algo_name = k.key AND s.source_name = k.source))"""

# ---- MinHash / LSH ----------------------------------------------------------------
from ..operators import minhash as _MH  # noqa: E402
from .catalog import LSH_THRESHOLD, NUM_PERM  # noqa: E402

_A, _B = _MH.permutations(NUM_PERM)
_SIG = O.lexical_ctes("documents", K_SHINGLE) + f""",
perms AS (SELECT unnest(range(1, {NUM_PERM + 1})) AS p, unnest({list(_A)}::BIGINT[]) AS a, unnest({list(_B)}::BIGINT[]) AS b),
hs AS (SELECT DISTINCT design_idx, {O.hash31('s')} AS h FROM sh),
sigl AS (SELECT design_idx, p, min((a * h + b) % 2147483647) AS v FROM hs CROSS JOIN perms GROUP BY design_idx, p),
sig AS (SELECT design_idx, list(v ORDER BY p) AS sig FROM sigl GROUP BY design_idx)"""

SQL["minhash_signature"] = "WITH " + _SIG + """
SELECT design_idx, array_to_string(sig, ',') AS sig FROM sig"""

_MH_EDGES = _SIG + f""",
sets2 AS (SELECT design_idx, array_to_string(sig, ',') AS set_key FROM sig),
reps AS (SELECT set_key, min(design_idx) AS rep FROM sets2 GROUP BY set_key),
members AS (SELECT s.design_idx AS id, r.rep FROM sets2 s JOIN reps r USING (set_key)),
rsig AS (SELECT l.* FROM sigl l JOIN reps r ON l.design_idx = r.rep),
edges AS (SELECT a.design_idx AS i, b.design_idx AS j, count(*) / {float(NUM_PERM)} AS sim
          FROM rsig a JOIN rsig b ON a.p = b.p AND a.v = b.v AND a.design_idx < b.design_idx
          GROUP BY 1, 2 HAVING count(*) / {float(NUM_PERM)} >= {DEDUP_THRESHOLD})"""

SQL["similar_pairs_minhash"] = "WITH " + _MH_EDGES + """
SELECT i, j, round(sim, 6) AS similarity FROM edges"""

SQL["dedup_minhash_kept"] = O.with_recursive(_MH_EDGES + O.first_wins_ctes()) + """
SELECT design_idx FROM kept"""

SQL["dedup_minhash_links"] = O.with_recursive(_MH_EDGES + O.first_wins_ctes()) + """
SELECT duplicate_index, original_index, round(similarity, 6) AS similarity FROM links"""

_LB, _LR = _MH.optimal_bands(LSH_THRESHOLD, NUM_PERM)
_LSH = _SIG + f""",
bm AS (SELECT design_idx AS node, b - 1 AS band, array_to_string(list_slice(sig, (b - 1) * {_LR} + 1, b * {_LR}), ',') AS key
       FROM sig CROSS JOIN (SELECT unnest(range(1, {_LB + 1})) AS b)),
multi AS (SELECT band, key, min(node) AS first_member, count(*) AS n_members FROM bm GROUP BY band, key HAVING count(*) > 1),
m AS (SELECT bm.node, bm.band, bm.key FROM bm JOIN multi USING (band, key)),
nodes AS (SELECT node, row_number() OVER (ORDER BY node) AS rn FROM (SELECT DISTINCT node FROM m)),
walk AS (SELECT 0::BIGINT AS rn, []::BIGINT[] AS kept
         UNION ALL
         SELECT w.rn + 1,
                CASE WHEN EXISTS (SELECT 1 FROM m m1 JOIN m m2 ON m1.band = m2.band AND m1.key = m2.key
                                  WHERE m1.node = n.node AND list_contains(w.kept, m2.node))
                     THEN w.kept ELSE list_append(w.kept, n.node) END
         FROM walk w JOIN nodes n ON n.rn = w.rn + 1),
kept_nodes AS (SELECT unnest(kept) AS node FROM walk WHERE rn = (SELECT count(*) FROM nodes)),
links AS (SELECT m1.node AS duplicate_index, 'design_' || CAST(min(m2.node) AS VARCHAR) AS similar_to,
                 'LSH_match' AS estimated_similarity
          FROM m m1 JOIN m m2 ON m1.band = m2.band AND m1.key = m2.key
          WHERE m2.node IN (SELECT node FROM kept_nodes) AND m1.node NOT IN (SELECT node FROM kept_nodes)
          GROUP BY m1.node),
kept AS (SELECT design_idx FROM sig WHERE design_idx NOT IN (SELECT duplicate_index FROM links))"""

SQL["lsh_buckets"] = "WITH " + _LSH.split(",\nm AS")[0] + """
SELECT band::INTEGER AS band, first_member, n_members::BIGINT AS n_members FROM multi"""

SQL["dedup_lsh_kept"] = O.with_recursive(_LSH) + """
SELECT design_idx FROM kept"""

SQL["dedup_lsh_links"] = O.with_recursive(_LSH) + """
SELECT duplicate_index, similar_to, estimated_similarity FROM links"""

SQL["dedup_lsh_stats"] = O.with_recursive(_LSH) + """
SELECT (SELECT count(*) FROM designs)::BIGINT AS original_count, NULL::BIGINT AS valid_count,
       (SELECT count(*) FROM kept)::BIGINT AS deduplicated_count,
       (SELECT count(*) FROM links)::BIGINT AS duplicate_count, 'LSH' AS processing_mode,
       round((1 - (SELECT count(*) FROM kept) / (SELECT count(*) FROM designs)) * 100, 6) AS dedup_rate_pct"""

# ---- TF-IDF / scaling ---------------------------------------------------------


def _tfidf(corpus: str, max_features: int = 200) -> str:
    return f"""{O.corpus_ctes(corpus)},
ft AS (SELECT design_idx, file_pos, {O.semantic_tokens('file_content')} AS t FROM files),
dt AS (SELECT d.design_idx, list_transform(coalesce(flatten(list(ft.t ORDER BY ft.file_pos) FILTER (WHERE ft.t IS NOT NULL)), []), lambda x: lower(x)) AS toks
       FROM designs d LEFT JOIN ft USING (design_idx) GROUP BY d.design_idx),
grams AS (SELECT design_idx, unnest(list_concat(
            list_transform(range(1, len(toks) + 1), lambda i: toks[i]),
            list_transform(range(1, greatest(len(toks) - 1, 0) + 1), lambda i: toks[i] || ' ' || toks[i + 1]),
            list_transform(range(1, greatest(len(toks) - 2, 0) + 1), lambda i: toks[i] || ' ' || toks[i + 1] || ' ' || toks[i + 2]))) AS term
          FROM dt),
tf AS (SELECT design_idx, term, count(*) AS tf FROM grams GROUP BY 1, 2),
nd AS (SELECT count(*) AS n FROM designs),
st AS (SELECT term, count(*) AS df, sum(tf) AS sum_tf FROM tf GROUP BY term),
vocab0 AS (SELECT * FROM st WHERE df >= 2 AND df <= 0.95 * (SELECT n FROM nd) ORDER BY sum_tf DESC, term LIMIT {max_features}),
vocab AS (SELECT term, df, sum_tf, (row_number() OVER (ORDER BY term) - 1) AS dim,
                 ln((1 + (SELECT n FROM nd)) / (1 + df)) + 1 AS idf FROM vocab0),
tfraw AS (SELECT tf.design_idx, tf.term, v.dim, (1 + ln(tf.tf)) * v.idf AS raw FROM tf JOIN vocab v USING (term)),
wts AS (SELECT design_idx, term, dim, raw / sqrt(sum(raw * raw) OVER (PARTITION BY design_idx)) AS weight FROM tfraw)"""


SQL["tfidf_vocabulary"] = "WITH " + _tfidf("code") + """
SELECT term, dim::INTEGER AS dim, df::BIGINT AS df, sum_tf::BIGINT AS sum_tf, round(idf, 6) AS idf FROM vocab"""

SQL["tfidf_weights"] = "WITH " + _tfidf("code") + """
SELECT design_idx, term, round(weight, 6) AS weight FROM wts"""

SQL["tfidf_sparsity"] = "WITH " + _tfidf("code") + """
SELECT (SELECT n FROM nd)::BIGINT AS n_rows, (SELECT count(*) FROM vocab)::BIGINT AS n_cols,
       (SELECT count(*) FROM wts)::BIGINT AS nnz,
       round(1 - (SELECT count(*) FROM wts) / ((SELECT n FROM nd) * (SELECT count(*) FROM vocab)), 6) AS sparsity"""

SQL["tfidf_vocabulary_documents"] = "WITH " + _tfidf("documents") + """
SELECT term, dim::INTEGER AS dim, df::BIGINT AS df, sum_tf::BIGINT AS sum_tf, round(idf, 6) AS idf FROM vocab"""

_FEATS = [n for n in __import__("sievekit.functions.structural", fromlist=["x"]).ENHANCED_FEATURES]
_RAW_EXPR = {
    "file_count": "file_count", "log_total_lines": "ln(1 + total_lines)",
    "avg_lines_per_file": _div("total_lines", "file_count"), "code_density": _div("total_chars", "total_lines"),
    "log_function_count": "ln(1 + function_count)", "log_loop_count": "ln(1 + loop_count)",
    "complexity_ratio": _div("nested_loop_count + conditional_count", "total_lines"),
    "hls_ratio": _div("hls_directive_count", "total_lines"),
}
_RAW = _STRUCT_BASE + ",\nraw AS (SELECT design_idx, " + ", ".join(
    f"CAST({_RAW_EXPR.get(n, n)} AS DOUBLE) AS {n}" for n in _FEATS) + " FROM c),\n"
_RAW += "q AS (SELECT " + ", ".join(f"quantile_cont({n}, [0.25, 0.5, 0.75]) AS {n}" for n in _FEATS) + " FROM raw),\n"
_RAW += "rs AS (SELECT design_idx, " + ", ".join(
    f"(raw.{n} - q.{n}[2]) / CASE WHEN q.{n}[3] - q.{n}[1] = 0 THEN 1 ELSE q.{n}[3] - q.{n}[1] END AS {n}"
    for n in _FEATS) + " FROM raw, q),\n"
_RAW += "ma AS (SELECT " + ", ".join(f"coalesce(nullif(max(abs({n})), 0), 1) AS {n}" for n in _FEATS) + " FROM rs),\n"
_RAW += "ms AS (SELECT design_idx, " + ", ".join(f"rs.{n} / ma.{n} AS {n}" for n in _FEATS) + " FROM rs, ma)"

SQL["robust_scaled"] = _RAW + "\nSELECT design_idx, " + ", ".join(f"round({n}, 6) AS {n}" for n in _FEATS) + " FROM rs"
SQL["maxabs_scaled"] = _RAW + "\nSELECT design_idx, " + ", ".join(f"round({n}, 6) AS {n}" for n in _FEATS) + " FROM ms"

SQL["combined_features"] = _RAW + ",\n" + _tfidf("code").split(",\n", 1)[1] + f""",
wmax AS (SELECT dim, max(abs(weight)) AS m FROM wts GROUP BY dim),
sl AS (SELECT design_idx, (d.i - 1) AS dim, d.v AS value
       FROM ms, LATERAL (SELECT unnest(range(1, {len(_FEATS) + 1})) AS i, unnest([{', '.join('ms.' + n for n in _FEATS)}]) AS v) d),
tl AS (SELECT w.design_idx, w.dim + {len(_FEATS)} AS dim, w.weight / coalesce(nullif(m.m, 0), 1) AS value FROM wts w JOIN wmax m USING (dim))
SELECT design_idx, dim::INTEGER AS dim, round(value, 6) AS value FROM (SELECT * FROM sl UNION ALL SELECT * FROM tl) WHERE value <> 0"""

# ---- selection on embeddings ---------------------------------------------------


def _pts(skewed: bool, normalise: bool = False, one_cluster: bool = False) -> str:
    cl = "(length(bin(vec_id + 1)) - 1)::INTEGER" if skewed else "label"
    cl = "0" if one_cluster else cl
    f = "CAST(embedding AS DOUBLE[])"
    if normalise:
        f = f"list_transform({f}, lambda x: x / sqrt(list_sum(list_transform({f}, lambda y: y * y))))"
    return f"pts AS (SELECT vec_id AS id, {cl} AS cluster, {f} AS f FROM embeddings)"


def _quota_sql(skewed: bool, lo: int, hi: int, adjust: bool = True, normalise: bool = False) -> str:
    t = (lo + hi) // 2
    s = _pts(skewed, normalise) + f""",
sizes AS (SELECT cluster, count(*) AS size FROM pts GROUP BY cluster),
base AS (SELECT cluster, size, least(greatest(1, floor(size::DOUBLE / (SELECT sum(size) FROM sizes)::DOUBLE * {float(t)})),
                                 least(size, greatest(1, least(5, size // 2))))::INTEGER AS quota FROM sizes)"""
    if not adjust:
        return s + ",\nfinal AS (SELECT * FROM base)"
    return s + f""",
units_t AS (SELECT cluster, unnest(range(2, quota + 1)) AS u FROM base),
trim AS (SELECT cluster, count(*) AS minus FROM (SELECT cluster, row_number() OVER (ORDER BY u DESC, cluster) AS rn FROM units_t)
         WHERE rn <= greatest((SELECT sum(quota) FROM base) - {hi}, 0) GROUP BY cluster),
trimmed AS (SELECT b.cluster, b.size, (b.quota - coalesce(t.minus, 0))::INTEGER AS quota FROM base b LEFT JOIN trim t USING (cluster)),
units_f AS (SELECT cluster, quota, unnest(range(quota + 1, least(5, size) + 1)) AS u FROM trimmed),
fill AS (SELECT cluster, count(*) AS plus FROM (SELECT cluster, row_number() OVER (ORDER BY quota DESC, cluster, u) AS rn FROM units_f)
         WHERE rn <= greatest({lo} - (SELECT sum(quota) FROM trimmed), 0) GROUP BY cluster),
final AS (SELECT b.cluster, b.size, (b.quota + coalesce(f.plus, 0))::INTEGER AS quota FROM trimmed b LEFT JOIN fill f USING (cluster))"""


_CENT = """cent AS (SELECT cluster, list(m ORDER BY d) AS centre FROM (
           SELECT cluster, d, avg(x) AS m FROM (SELECT cluster, unnest(f) AS x, unnest(range(1, len(f) + 1)) AS d FROM {src})
           GROUP BY cluster, d) GROUP BY cluster)"""

SQL["cluster_sizes"] = "WITH " + _pts(False) + "\nSELECT cluster, count(*)::BIGINT AS size FROM pts GROUP BY cluster ORDER BY cluster"
SQL["quota_base"] = "WITH " + _quota_sql(False, 80, 120, adjust=False) + "\nSELECT cluster, size::BIGINT AS size, quota FROM final"
SQL["quota_trimmed"] = "WITH " + _quota_sql(True, 10, 11) + "\nSELECT cluster, size::BIGINT AS size, quota FROM final"
SQL["quota_filled"] = "WITH " + _quota_sql(True, 30, 34) + "\nSELECT cluster, size::BIGINT AS size, quota FROM final"

SQL["cluster_center_member"] = "WITH " + _pts(False) + ",\n" + _CENT.format(src="pts") + """
SELECT cluster, id, round(dist, 6) AS dist FROM (
  SELECT p.cluster, p.id, list_distance(p.f, c.centre) AS dist,
         row_number() OVER (PARTITION BY p.cluster ORDER BY round(list_distance(p.f, c.centre), 9), p.id) AS rn
  FROM pts p JOIN cent c USING (cluster)) WHERE rn = 1"""


def _selection_sql(skewed: bool, lo: int, hi: int, normalise: bool = False, head: str | None = None,
                   rounds: int = 5) -> str:
    s = (head or _quota_sql(skewed, lo, hi, normalise=normalise)) + """,
takeall AS (SELECT p.id, p.cluster, row_number() OVER (PARTITION BY p.cluster ORDER BY p.id) AS pick_rank
            FROM pts p JOIN final q USING (cluster) WHERE q.quota >= q.size),
rest AS (SELECT p.id, p.cluster, p.f, q.quota FROM pts p JOIN final q USING (cluster) WHERE q.quota < q.size AND q.quota > 0),
""" + _CENT.format(src="rest") + """,
picks1 AS (SELECT cluster, id, 1 AS pick_rank FROM (
  SELECT r.cluster, r.id, row_number() OVER (PARTITION BY r.cluster ORDER BY round(list_distance(r.f, c.centre), 9), r.id) AS rn
  FROM rest r JOIN cent c USING (cluster)) WHERE rn = 1)"""
    for k in range(2, rounds + 1):
        s += f""",
md{k} AS (SELECT r.cluster, r.id, min(round(list_distance(r.f, pf.f), 9)) AS md
          FROM rest r JOIN picks{k - 1} pk ON pk.cluster = r.cluster JOIN rest pf ON pf.id = pk.id
          WHERE r.quota >= {k} AND r.id NOT IN (SELECT id FROM picks{k - 1}) GROUP BY r.cluster, r.id),
picks{k} AS (SELECT * FROM picks{k - 1} UNION ALL
             SELECT cluster, id, {k} FROM (SELECT cluster, id, row_number() OVER (PARTITION BY cluster ORDER BY md DESC, id) AS rn FROM md{k}) WHERE rn = 1)"""
    s += f",\nsel AS (SELECT id, cluster, pick_rank FROM takeall UNION ALL SELECT id, cluster, pick_rank FROM picks{rounds})"
    return s


SQL["farthest_points"] = "WITH " + _selection_sql(False, 80, 120) + "\nSELECT id, cluster, pick_rank::INTEGER AS pick_rank FROM sel"
SQL["representatives"] = "WITH " + _selection_sql(True, 30, 34) + "\nSELECT id, cluster, pick_rank::INTEGER AS pick_rank FROM sel"
SQL["selection_analysis"] = "WITH " + _selection_sql(True, 30, 34) + """
SELECT (SELECT count(*) FROM sel)::BIGINT AS selected_count, (SELECT count(DISTINCT cluster) FROM pts)::BIGINT AS total_clusters,
       (SELECT count(DISTINCT cluster) FROM sel)::BIGINT AS covered_clusters,
       round((SELECT count(DISTINCT cluster) FROM sel) / (SELECT count(DISTINCT cluster) FROM pts), 6) AS coverage_ratio,
       (SELECT count(*) FROM sel) BETWEEN 30 AND 34 AS target_met"""

SQL["silhouette_sq_euclidean"] = "WITH " + _pts(False) + """,
pd AS (SELECT a.id, a.cluster AS ca, b.cluster AS cb,
              list_sum(list_transform(range(1, len(a.f) + 1), lambda k: (a.f[k] - b.f[k]) * (a.f[k] - b.f[k]))) AS d
       FROM pts a JOIN pts b ON a.id <> b.id),
sz AS (SELECT cluster, count(*) AS n FROM pts GROUP BY cluster),
per AS (SELECT id, ca, cb, sum(d) AS sd FROM pd GROUP BY id, ca, cb),
ab AS (SELECT p.id, max(CASE WHEN p.ca = p.cb THEN p.sd / (s.n - 1) END) AS a,
              min(CASE WHEN p.ca <> p.cb THEN p.sd / s.n END) AS b,
              max(CASE WHEN p.ca = p.cb THEN s.n END) AS own_n
       FROM per p JOIN sz s ON s.cluster = p.cb GROUP BY p.id)
SELECT round(avg(CASE WHEN coalesce(own_n, 1) <= 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette
FROM pts LEFT JOIN ab USING (id)"""

SQL["assign_nearest"] = "WITH " + _pts(False) + ",\n" + _CENT.format(src="pts") + """
SELECT id, cluster FROM (
  SELECT p.id, c.cluster, row_number() OVER (PARTITION BY p.id ORDER BY list_distance(p.f, c.centre), c.cluster) AS rn
  FROM pts p CROSS JOIN cent c) WHERE rn = 1"""

# the stream walks the same LSH graph in the same (index) order
SQL["dedup_incremental"] = SQL["dedup_lsh_kept"]

# ---- optional tier ---------------------------------------------------------------
from ..functions import complexity as _CX  # noqa: E402

SQL["char_shingles"] = f"""WITH {O.corpus_ctes('documents')},
cs AS (SELECT DISTINCT design_idx, substr(file_content, i, 5) AS s
       FROM files, LATERAL (SELECT unnest(range(1, length(file_content) - 3)) AS i)),
agg AS (SELECT design_idx, count(*) AS n, sum({O.hash31('s')}) AS h FROM cs GROUP BY design_idx)
SELECT d.design_idx, coalesce(n, 0)::INTEGER AS n_shingles, coalesce(h, 0)::BIGINT AS shingle_checksum
FROM designs d LEFT JOIN agg USING (design_idx)"""

_ABS_CASE = (f"CASE WHEN t = 'LITERAL' THEN 'LITERAL' WHEN regexp_matches(lower(t), {O.q(_K.DIGITS_RE)}) THEN 'LITERAL' "
             f"WHEN lower(t) IN {O._in(_K.LEXICAL_CPP_KEYWORDS)} THEN lower(t) "
             f"WHEN regexp_matches(t, {O.q(_CX.WORD_RE)}) THEN 'IDENTIFIER' ELSE t END")
_ABS_TEXT = (f"regexp_replace(regexp_replace({O.strip_comments('file_content')}, {O.q(_K.DQUOTE_RE)}, ' LITERAL ', 'g'), "
             f"{O.q(_K.SQUOTE_RE)}, ' LITERAL ', 'g')")
SQL["normalised_shingles"] = f"""WITH {O.corpus_ctes('code')},
ft AS (SELECT design_idx, file_pos, list_transform(regexp_extract_all({_ABS_TEXT}, {O.q(_K.TOKEN_RE)}), lambda t: {_ABS_CASE}) AS t FROM files),
toks AS (SELECT d.design_idx, coalesce(flatten(list(ft.t ORDER BY ft.file_pos) FILTER (WHERE ft.t IS NOT NULL)), []) AS toks
         FROM designs d LEFT JOIN ft USING (design_idx) GROUP BY d.design_idx),
shl AS (SELECT design_idx, len(toks) AS n_tokens, {O.shingle_list('toks', 5)} AS shl FROM toks)
SELECT design_idx, n_tokens::INTEGER AS n_tokens, len(shl)::INTEGER AS n_shingles,
       coalesce(list_sum(list_transform(shl, lambda s: {O.hash31('s')})), 0)::BIGINT AS shingle_checksum FROM shl"""

SQL["cyclomatic"] = f"""WITH {O.corpus_ctes('code')},
pf AS (SELECT design_idx, sum(len(regexp_extract_all({O.strip_comments('file_content')}, {O.q(_CX.DECISION_RE)}))) AS n FROM files GROUP BY design_idx)
SELECT d.design_idx, (1 + coalesce(pf.n, 0))::BIGINT AS cyclomatic FROM designs d LEFT JOIN pf USING (design_idx)"""

_IS_OP = f"(NOT regexp_matches(t, {O.q(_CX.WORD_RE)}) OR lower(t) IN {O._in(_K.LEXICAL_CPP_KEYWORDS)})"
SQL["halstead"] = f"""WITH {O.corpus_ctes('code')},
tk AS (SELECT design_idx, unnest(regexp_extract_all({O.strip_comments('file_content')}, {O.q(_K.TOKEN_RE)})) AS t FROM files),
agg AS (SELECT design_idx, count(DISTINCT t) FILTER (WHERE {_IS_OP}) AS d_op, count(DISTINCT t) FILTER (WHERE NOT {_IS_OP}) AS d_od,
               count(*) FILTER (WHERE {_IS_OP}) AS t_op, count(*) FILTER (WHERE NOT {_IS_OP}) AS t_od FROM tk GROUP BY design_idx)
SELECT d.design_idx, coalesce(d_op, 0)::INTEGER AS distinct_operators, coalesce(d_od, 0)::INTEGER AS distinct_operands,
       coalesce(t_op, 0)::INTEGER AS total_operators, coalesce(t_od, 0)::INTEGER AS total_operands
FROM designs d LEFT JOIN agg USING (design_idx)"""

SQL["size_profile"] = _CUR + """,
sz AS (SELECT d.design_idx, coalesce(sum(length(f.file_content)), 0)::DOUBLE AS size
       FROM designs d LEFT JOIN files f USING (design_idx) GROUP BY d.design_idx),
chosen AS (""" + SQL["curated_semi"][len(_CUR):] + """),
qq AS (SELECT quantile_cont(size, [0.25, 0.5, 0.75]) AS q FROM sz),
bk AS (SELECT sz.design_idx, CASE WHEN size <= q[1] THEN 1 WHEN size <= q[2] THEN 2 WHEN size <= q[3] THEN 3 ELSE 4 END AS bucket,
              sz.design_idx IN (SELECT design_idx FROM chosen) AS s FROM sz, qq)
SELECT bucket, count(*)::BIGINT AS n_all, count(*) FILTER (WHERE s)::BIGINT AS n_selected,
       round(count(*) FILTER (WHERE s) / count(*), 6) AS share_selected FROM bk GROUP BY bucket"""

SQL["cosine_farthest"] = "WITH " + _selection_sql(False, 80, 120, normalise=True) + \
    "\nSELECT id, cluster, pick_rank::INTEGER AS pick_rank FROM sel"
_GLOBAL_HEAD = _pts(False, one_cluster=True) + """,
final AS (SELECT 0 AS cluster, count(*) AS size, 10 AS quota FROM pts)"""
SQL["global_farthest"] = "WITH " + _selection_sql(False, 0, 0, head=_GLOBAL_HEAD, rounds=10) + \
    "\nSELECT id, cluster, pick_rank::INTEGER AS pick_rank FROM sel"

# ---- read back, single modes, choices --------------------------------------------

SQL["designs_json_roundtrip"] = f"""WITH {O.corpus_ctes('code')}
SELECT d.design_idx, any_value(d.algo_name) AS algo_name, any_value(d.source_name) AS source_name,
       count(f.design_idx)::INTEGER AS n_files,
       md5(coalesce(string_agg(concat_ws(':', f.file_name, f.file_content), '|' ORDER BY f.file_pos), '')) AS files_md5
FROM designs d LEFT JOIN files f USING (design_idx) GROUP BY d.design_idx"""

SQL["names_csv_roundtrip"] = f"""WITH {O.corpus_ctes('code')}
SELECT coalesce(algo_name, 'Unknown') AS algo_name, coalesce(source_name, 'Unknown') AS source_name, count(*)::BIGINT AS n_rows
FROM designs GROUP BY ALL"""

SQL["dedup_report_roundtrip"] = O.with_recursive(_EXACT_CODE + O.first_wins_ctes()) + """
SELECT (SELECT count(*) FROM designs)::BIGINT AS original_count, (SELECT count(*) FROM sets)::BIGINT AS valid_count,
       (SELECT count(*) FROM kept)::BIGINT AS deduplicated_count, (SELECT count(*) FROM links)::BIGINT AS duplicate_count,
       (SELECT count(*) FROM kept)::BIGINT AS kept_rows"""

SQL["curated_fallback"] = SQL["curated_semi"]

SQL["features_structural_only"] = _RAW + f"""
SELECT design_idx, d.i::INTEGER AS dim, round(d.v, 6) AS value
FROM rs, LATERAL (SELECT unnest(range(0, {len(_FEATS)})) AS i, unnest([{', '.join('rs.' + n for n in _FEATS)}]) AS v) d WHERE d.v <> 0"""

SQL["features_semantic_only"] = "WITH " + _tfidf("code") + """
SELECT design_idx, dim::INTEGER AS dim, round(weight, 6) AS value FROM wts WHERE weight <> 0"""

SQL["selection_ratio"] = "WITH " + _selection_sql(True, 30, 34) + """
SELECT (SELECT count(*) FROM pts)::BIGINT AS input_count, (SELECT count(*) FROM sel)::BIGINT AS selected_count,
       round((SELECT count(*) FROM sel) / (SELECT count(*) FROM pts) * 100, 6) AS selection_ratio_pct,
       round(100 - (SELECT count(*) FROM sel) / (SELECT count(*) FROM pts) * 100, 6) AS reduction_pct"""

SQL["picks_per_cluster"] = "WITH " + _selection_sql(True, 30, 34) + """
SELECT cluster, count(*)::BIGINT AS n_picks FROM sel GROUP BY cluster"""


# ---- clustering, projection and the end-to-end flow ------------------------------
from . import oracle_cluster as OC  # noqa: E402

_STRUCT_CTES = _RAW.split(",\nfx AS", 1)
_KEPT = OC.kept_code(_EXACT_CODE)


def _vectors(mode: str) -> str:
    return OC.vectors(mode, "fx AS" + _STRUCT_CTES[1], "ft AS" + _tfidf("code").split(",\nft AS", 1)[1], _FEATS, ("kdesigns", "kfiles"))


_SWEEP = O.with_recursive(_KEPT + ",\n" + _vectors("combined") + "," + OC.sweep())
SQL["kmeans_labels"] = _SWEEP + """
SELECT id AS design_idx, cluster::INTEGER AS cluster FROM labels JOIN chosen USING (k)"""
SQL["best_k"] = _SWEEP + """
SELECT k::INTEGER AS k, round(silhouette, 6) AS silhouette, round(cost, 6) AS cost FROM fits WHERE swept"""
SQL["best_k_choice"] = _SWEEP + """
SELECT k::INTEGER AS k, round(silhouette, 6) AS silhouette FROM chosen"""


def _one_mode(mode: str) -> str:
    return f"""SELECT '{mode}' AS mode, * FROM ({O.with_recursive(_KEPT + ',' + chr(10) + _vectors(mode) + ',' + OC.sweep())}
SELECT k::INTEGER AS k, round(silhouette, 6) AS silhouette, (SELECT count(*) FROM vec)::BIGINT AS n_rows,
       (SELECT max(len(f)) FROM vec)::INTEGER AS n_dims FROM chosen)"""


SQL["mode_comparison"] = "\nUNION ALL\n".join(_one_mode(m) for m in OC.MODES)

_CODE_HEAD = _quota_sql(False, 80, 120).replace(_pts(False), "pts AS (SELECT id, cluster::INTEGER AS cluster, f FROM labels JOIN chosen USING (k) JOIN vec USING (id))")
SQL["pipeline_end_to_end"] = _SWEEP + ",\n" + _selection_sql(False, 80, 120, head=_CODE_HEAD) + """
SELECT sel.id AS design_idx, sel.cluster, sel.pick_rank::INTEGER AS pick_rank, d.algo_name, d.source_name FROM sel JOIN designs d ON d.design_idx = sel.id"""

SQL["pca_points"] = "WITH RECURSIVE " + _selection_sql(False, 80, 120) + "," + OC.pca("pts") + """
SELECT p.id AS design_idx, round(pc1, 6) AS pc1, round(pc2, 6) AS pc2, p.cluster, p.id IN (SELECT id FROM sel) AS selected FROM pcs JOIN pts p USING (id)"""

# ---- reports, mode switch, fallback, array files -------------------------------------
SQL["dedup_modes"] = f"""SELECT 'Exact' AS mode, design_idx FROM ({SQL['dedup_minhash_kept']})
UNION ALL SELECT 'LSH' AS mode, design_idx FROM ({SQL['dedup_lsh_kept']})"""


def _report(lines: list[str]) -> str:
    """Rows (line, text) of SELECTs of (place, part, text), in order."""
    return "SELECT (row_number() OVER (ORDER BY place, part) - 1)::INTEGER AS line, text FROM (" + "\nUNION ALL ".join(
        x if x.startswith("SELECT") else f"SELECT {n} AS place, 0::BIGINT AS part, {x} AS text" for n, x in enumerate(lines)) + ")"


_N_KEPT, _N_ALL, _N_DUP = "(SELECT count(*) FROM kept)", "(SELECT count(*) FROM designs)", "(SELECT count(*) FROM links)"
SQL["dedup_summary"] = O.with_recursive(_EXACT_DOCS + O.first_wins_ctes()) + ",\nlinks10 AS (SELECT *, row_number() OVER (ORDER BY original_index, duplicate_index) AS part FROM links)\n" + _report([
    "'# Near-duplicate removal'", "''", f"'- similarity threshold: {DEDUP_THRESHOLD}'", "'- mode: Exact'",
    f"'- input designs: ' || {_N_ALL}", "'- valid designs: ' || (SELECT count(*) FROM sets)", f"'- kept: ' || {_N_KEPT}", f"'- duplicates: ' || {_N_DUP}",
    f"'- removal rate: ' || printf('%.1f', round((1 - {_N_KEPT} / {_N_ALL}) * 100, 6)) || '%'", "''",
    f"SELECT 10 AS place, 0::BIGINT AS part, CASE WHEN {_N_DUP} = 0 THEN 'No duplicates found.' ELSE '| duplicate | original | similarity |' END AS text",
    f"SELECT 11, 0, '|---|---|---|' WHERE {_N_DUP} > 0",
    "SELECT 12, part, printf('| %d | %d | %.3f |', duplicate_index, original_index, similarity) FROM links10 WHERE part <= 10",
    f"SELECT 13, 0, '' WHERE {_N_DUP} > 10", f"SELECT 14, 0, printf('(first 10 of %d duplicates)', {_N_DUP}) WHERE {_N_DUP} > 10"])

_N_SEL, _N_VEC, _COV, _TOT = "(SELECT count(*) FROM sel)", "(SELECT count(*) FROM vec)", "(SELECT count(DISTINCT cluster) FROM sel)", "(SELECT count(DISTINCT cluster) FROM pts)"
SQL["selection_summary"] = _SWEEP + ",\n" + _selection_sql(False, 80, 120, head=_CODE_HEAD) + """,
exts AS (SELECT lower(string_split(file_name, '.')[-1]) AS ext, count(*) AS n, min((design_idx, file_pos)) AS seen
         FROM kfiles WHERE contains(file_name, '.') AND design_idx IN (SELECT id FROM sel) GROUP BY 1)
""" + _report([
    "'# Clustering-based selection'", "''", "'- target range: 80-120'", f"'- structural dimensions: {len(_FEATS)}'",
    f"'- input designs: ' || {_N_VEC}", f"'- selected designs: ' || {_N_SEL}", f"printf('- selection ratio: %.2f%%', {_N_SEL} / {_N_VEC} * 100)",
    f"printf('- reduction: %.1f%%', 100 - {_N_SEL} / {_N_VEC} * 100)", "'- optimal k: ' || (SELECT k FROM chosen)",
    "printf('- silhouette: %.4f', (SELECT silhouette FROM chosen))",
    f"printf('- clusters covered: %d of %d (%.2f%%)', {_COV}, {_TOT}, round({_COV} / {_TOT}, 6) * 100)",
    f"'- target met: ' || CASE WHEN {_N_SEL} BETWEEN 80 AND 120 THEN 'True' ELSE 'False' END", "''", "'## Picks per cluster'",
    "SELECT 14 AS place, cluster::BIGINT AS part, printf('cluster %d: %d', cluster, count(*)) AS text FROM sel GROUP BY cluster", "''", "'## File types'",
    "SELECT 17, row_number() OVER (ORDER BY n DESC, seen), ext || ': ' || n FROM exts QUALIFY row_number() OVER (ORDER BY n DESC, seen) <= 5"])

_ONE_WORD = ("SELECT p_partkey AS design_idx, 1 AS file_pos, 'one.c' AS file_name, "
             "'w' || translate(p_partkey::VARCHAR, '0123456789', 'abcdefghij') AS file_content FROM part")
SQL["features_fallback"] = _RAW.replace(f"files AS ({O.CODE_FILES})", f"files AS ({_ONE_WORD})") + f"""
SELECT design_idx, 'structural_only' AS mode, d.i::INTEGER AS dim, round(d.v, 6) AS value
FROM rs, LATERAL (SELECT unnest(range(0, {len(_FEATS)})) AS i, unnest([{', '.join('rs.' + n for n in _FEATS)}]) AS v) d WHERE d.v <> 0"""

SQL["designs_array_roundtrip"] = f"""WITH {O.corpus_ctes('code')}
SELECT 'design' AS kind, algo_name, source_name, md5(coalesce(string_agg(concat_ws(':', file_name, file_content), '|' ORDER BY file_pos), '')) AS files_md5
FROM designs LEFT JOIN files USING (design_idx) WHERE design_idx % 10 <> 0 GROUP BY design_idx, algo_name, source_name
UNION ALL SELECT 'reject', 'source_code is no list', NULL, NULL FROM designs WHERE design_idx % 10 = 0
UNION ALL SELECT 'reject', 'the element is cut off', NULL, NULL"""
SQL["kept_in_order"] = O.with_recursive(_EXACT_CODE + O.first_wins_ctes()) + """
SELECT row_number() OVER (ORDER BY design_idx) - 1 AS position, design_idx, algo_name, source_name FROM designs SEMI JOIN kept USING (design_idx)"""
SQL["picks_in_order"] = "WITH " + _selection_sql(True, 30, 34) + """
SELECT row_number() OVER (ORDER BY cluster, pick_rank) - 1 AS position, id, cluster, pick_rank::INTEGER AS pick_rank FROM sel"""
SQL["similar_classes"] = O.with_recursive(_EXACT_DOCS) + """,
twoway AS (SELECT i AS a, j AS b FROM edges UNION ALL SELECT j, i FROM edges),
reach AS (SELECT a, b FROM twoway UNION SELECT r.a, n.b FROM reach r JOIN twoway n ON n.a = r.b),
class AS (SELECT a, least(a, min(b)) AS class FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n_links FROM twoway GROUP BY a)
SELECT m.id AS design_idx, coalesce(class, m.rep) AS class, coalesce(n_links, 0)::BIGINT AS n_links
FROM members m LEFT JOIN class c ON c.a = m.rep LEFT JOIN degree d ON d.a = m.rep"""
