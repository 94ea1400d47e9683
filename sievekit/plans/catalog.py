"""Query catalogue: every registered query as ``(spark, sf_dir) -> DataFrame``.

Names follow SURVEY section 7.4. Each query reads the driver tables (or data
Spark derives from them) in full. Computed columns carry the same aliases as
the oracle SQL in ``oracle_catalog``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shingles import portable_hash31, shingles
from ..functions.text import lexical_tokens
from ..operators import profile as P
from ..sources import tables as TB
from . import dedup_stage as DS

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# parameters of the published dedup run
DEDUP_THRESHOLD = 0.8
LSH_THRESHOLD = 0.8
K_SHINGLE = 5


def query(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


# ---- sources and profile (O9, O41, O42) -----------------------------------

@query("name_source_list")
def name_source_list(spark, sf):
    return P.name_source_list(TB.code_corpus(spark, sf))


@query("count_per_source")
def count_per_source(spark, sf):
    return P.count_per_source(TB.code_corpus(spark, sf))


@query("corpus_totals")
def corpus_totals(spark, sf):
    return P.corpus_totals(TB.code_corpus(spark, sf))


# ---- lexical profile (O10-O20) ---------------------------------------------

@query("tokens_lexical")
def tokens_lexical(spark, sf):
    c = TB.documents_corpus(spark, sf)
    toks = lexical_tokens(F.col("files"))
    return c.select("design_idx", F.size(toks).alias("n_tokens"),
                    F.md5(F.array_join(toks, " ")).alias("tokens_md5"))


@query("shingles")
def shingles_query(spark, sf):
    c = TB.documents_corpus(spark, sf)
    sh = shingles(lexical_tokens(F.col("files")), K_SHINGLE)
    return c.select("design_idx", sh.alias("sh")).select(
        "design_idx", F.size("sh").alias("n_shingles"),
        F.aggregate(F.transform("sh", portable_hash31), F.lit(0).cast("bigint"),
                    lambda acc, x: acc + x).alias("shingle_checksum"))


@query("valid_designs")
def valid_designs(spark, sf):
    sets = DS.shingle_sets(TB.documents_corpus(spark, sf), K_SHINGLE)
    return sets.where(F.size("shingles") > 0).select("design_idx")


# ---- exact similarity join + first-wins dedup (O30a, O34, O35, O40, O72) ---

def _exact(spark, sf, corpus="documents"):
    c = TB.documents_corpus(spark, sf) if corpus == "documents" else TB.code_corpus(spark, sf)
    return DS.exact_dedup(c, DEDUP_THRESHOLD, K_SHINGLE)


@query("similar_pairs_exact")
def similar_pairs_exact(spark, sf):
    pairs = DS.exact_pairs(TB.documents_corpus(spark, sf), DEDUP_THRESHOLD, K_SHINGLE)
    return pairs.select("i", "j", "overlap", F.round("jaccard", 6).alias("jaccard"))


@query("dedup_exact_kept")
def dedup_exact_kept(spark, sf):
    return _exact(spark, sf).kept


@query("dedup_exact_links")
def dedup_exact_links(spark, sf):
    links = _exact(spark, sf).links
    return links.select("duplicate_index", "original_index", F.round("similarity", 6).alias("similarity"))


@query("dedup_stats")
def dedup_stats(spark, sf):
    return _exact(spark, sf).stats()


@query("first10_duplicates")
def first10_duplicates(spark, sf):
    return P.first_duplicates(dedup_exact_links(spark, sf), 10)


@query("dedup_code_kept")
def dedup_code_kept(spark, sf):
    return _exact(spark, sf, "code").kept


@query("dedup_code_links")
def dedup_code_links(spark, sf):
    links = _exact(spark, sf, "code").links
    return links.select("duplicate_index", "original_index", F.round("similarity", 6).alias("similarity"))


# ---- semantic profile (O21-O26) --------------------------------------------

def _semantic(c):
    """Tokens are made once a row, for their number and for the text."""
    from ..functions.text import semantic_files, semantic_text
    return c.select("design_idx", semantic_files(F.col("files")).alias("t")).select(
        "design_idx", F.size(F.flatten("t")).alias("n_tokens"), F.md5(semantic_text(F.col("t"))).alias("text_md5"))


@query("tokens_semantic")
def tokens_semantic(spark, sf):
    return _semantic(TB.code_corpus(spark, sf))


@query("tokens_semantic_documents")
def tokens_semantic_documents(spark, sf):
    return _semantic(TB.documents_corpus(spark, sf))


# ---- structural features (O27-O29, O43) -----------------------------------

@query("structural_features")
def structural_features(spark, sf):
    from ..functions.structural import ENHANCED_FEATURES, with_structural
    df = with_structural(TB.code_corpus(spark, sf).select("design_idx", "files"))
    return df.select("design_idx", *[F.round(n, 6).alias(n) for n in ENHANCED_FEATURES])


@query("structural_basic")
def structural_basic(spark, sf):
    from ..functions.structural import BASIC_FEATURES, with_structural
    df = with_structural(TB.code_corpus(spark, sf).select("design_idx", "files"), basic=True)
    return df.select("design_idx", *[F.round(n, 6).alias(n) for n in BASIC_FEATURES])


@query("extension_top5")
def extension_top5(spark, sf):
    return P.extension_top(TB.code_corpus(spark, sf), 5)


# ---- curation (O33a-O33f, O45, O77, O78) ----------------------------------

def _curation(spark, sf):
    return TB.code_corpus(spark, sf).drop("files"), TB.curation_list_from_part(spark, sf)


@query("curated_semi")
def curated_semi(spark, sf):
    from ..operators.curate import keep_listed
    corpus, sel = _curation(spark, sf)
    return keep_listed(corpus, sel).select("design_idx", "algo_name", "source_name")


@query("curated_missing")
def curated_missing(spark, sf):
    from ..operators.curate import missing_pairs
    corpus, sel = _curation(spark, sf)
    return missing_pairs(corpus, sel)


@query("curated_audit")
def curated_audit(spark, sf):
    from ..operators.curate import decision_audit
    corpus, sel = _curation(spark, sf)
    return decision_audit(corpus, sel).groupBy("decision").agg(F.count(F.lit(1)).alias("n_designs"))


@query("curated_check")
def curated_check(spark, sf):
    from ..operators.curate import check_counts, keep_listed
    corpus, sel = _curation(spark, sf)
    return check_counts(keep_listed(corpus, sel), sel)


@query("sources_per_name")
def sources_per_name(spark, sf):
    from ..operators.curate import sources_per_name as spn
    _, sel = _curation(spark, sf)
    return spn(sel)


@query("curated_keyed")
def curated_keyed(spark, sf):
    from ..operators.curate import keyed_filter
    _, sel = _curation(spark, sf)
    return keyed_filter(TB.keyed_corpus_from_part(spark, sf), sel).select("key", "source", "is_struct")


# ---- MinHash and LSH (O31, O30b, O32, O32b, O36) ---------------------------

NUM_PERM = 128


def _signatures(spark, sf):
    sigs = DS.signature_table(TB.documents_corpus(spark, sf), K_SHINGLE, NUM_PERM)
    return sigs.where(F.col("sig").isNotNull())


@query("minhash_signature")
def minhash_signature(spark, sf):
    return _signatures(spark, sf).select(
        F.col("id").alias("design_idx"), F.array_join(F.col("sig").cast("array<string>"), ",").alias("sig"))


@query("similar_pairs_minhash")
def similar_pairs_minhash(spark, sf):
    from ..operators import minhash as MH
    from ..operators.simjoin import collapse_equal_sets
    reps, _ = collapse_equal_sets(_signatures(spark, sf), set_col="sig")
    pairs = MH.signature_self_join(reps.withColumnRenamed("set", "sig"), DEDUP_THRESHOLD, NUM_PERM)
    return pairs.select("i", "j", F.round("similarity", 6).alias("similarity"))


def _minhash(spark, sf):
    return DS.minhash_dedup(TB.documents_corpus(spark, sf), DEDUP_THRESHOLD, K_SHINGLE, NUM_PERM)


@query("dedup_minhash_kept")
def dedup_minhash_kept(spark, sf):
    return _minhash(spark, sf).kept


@query("dedup_minhash_links")
def dedup_minhash_links(spark, sf):
    links = _minhash(spark, sf).links
    return links.select("duplicate_index", "original_index", F.round("similarity", 6).alias("similarity"))


@query("lsh_buckets")
def lsh_buckets(spark, sf):
    """Buckets with at least two designs: (band, smallest member, size)."""
    from ..operators import minhash as MH
    b, r = MH.optimal_bands(LSH_THRESHOLD, NUM_PERM)
    keys = MH.band_keys(_signatures(spark, sf), "sig", MH.lsh_bands(b, r))
    return (keys.groupBy("band", "band_key")
            .agg(F.min("id").alias("first_member"), F.count(F.lit(1)).alias("n_members"))
            .where(F.col("n_members") > 1).select("band", "first_member", "n_members"))


def _lsh(spark, sf):
    return DS.lsh_dedup(TB.documents_corpus(spark, sf), LSH_THRESHOLD, K_SHINGLE, NUM_PERM)


@query("dedup_lsh_kept")
def dedup_lsh_kept(spark, sf):
    return _lsh(spark, sf).kept


@query("dedup_lsh_links")
def dedup_lsh_links(spark, sf):
    return _lsh(spark, sf).links


@query("dedup_lsh_stats")
def dedup_lsh_stats(spark, sf):
    return _lsh(spark, sf).stats()


# ---- TF-IDF, scaling, combined vectors (O46-O54, O59) ----------------------

@query("tfidf_vocabulary")
def tfidf_vocabulary(spark, sf):
    from .features import tfidf_model
    v = tfidf_model(TB.code_corpus(spark, sf)).vocabulary
    return v.select("term", "dim", "df", "sum_tf", F.round("idf", 6).alias("idf"))


@query("tfidf_weights")
def tfidf_weights(spark, sf):
    from .features import tfidf_model
    w = tfidf_model(TB.code_corpus(spark, sf)).weights
    return w.select("design_idx", "term", F.round("weight", 6).alias("weight"))


@query("tfidf_sparsity")
def tfidf_sparsity(spark, sf):
    from ..operators.tfidf import sparsity
    from .features import tfidf_model
    m = tfidf_model(TB.code_corpus(spark, sf))
    s = sparsity(m.weights, m.n_docs, m.vocabulary.count())
    return s.select("n_rows", "n_cols", "nnz", F.round("sparsity", 6).alias("sparsity"))


@query("tfidf_vocabulary_documents")
def tfidf_vocabulary_documents(spark, sf):
    from .features import tfidf_model
    v = tfidf_model(TB.documents_corpus(spark, sf)).vocabulary
    return v.select("term", "dim", "df", "sum_tf", F.round("idf", 6).alias("idf"))


@query("robust_scaled")
def robust_scaled(spark, sf):
    from ..functions.structural import ENHANCED_FEATURES
    from .features import structural_scaled
    s = structural_scaled(TB.code_corpus(spark, sf))
    return s.select("design_idx", *[F.round(c, 6).alias(c) for c in ENHANCED_FEATURES])


@query("maxabs_scaled")
def maxabs_scaled(spark, sf):
    from ..functions.structural import ENHANCED_FEATURES
    from ..operators.scaling import maxabs_scale
    from .features import structural_scaled
    s = maxabs_scale(structural_scaled(TB.code_corpus(spark, sf)), list(ENHANCED_FEATURES))
    return s.select("design_idx", *[F.round(c, 6).alias(c) for c in ENHANCED_FEATURES])


@query("combined_features")
def combined_features(spark, sf):
    from .features import design_features
    fs = design_features(TB.code_corpus(spark, sf), "combined")
    return fs.long.select("design_idx", F.col("dim").cast("int").alias("dim"), F.round("value", 6).alias("value"))


# ---- representative selection on given labels (O44, O55b, O56, O62-O70) ----

def _points(spark, sf, skewed=False, normalise=False):
    return TB.embedding_points(spark, sf, skewed, normalise)


@query("cluster_sizes")
def cluster_sizes_q(spark, sf):
    from ..operators.select import cluster_sizes
    return cluster_sizes(_points(spark, sf)).orderBy("cluster")


def _quota(spark, sf, skewed, lo, hi, adjust=True):
    from ..operators import select as SEL
    sizes = SEL.cluster_sizes(_points(spark, sf, skewed))
    q = SEL.base_quotas(sizes, lo, hi)
    return SEL.adjust_quotas(q, lo, hi) if adjust else q


@query("quota_base")
def quota_base(spark, sf):
    return _quota(spark, sf, False, 80, 120, adjust=False)


@query("quota_trimmed")
def quota_trimmed(spark, sf):
    return _quota(spark, sf, True, 10, 11)


@query("quota_filled")
def quota_filled(spark, sf):
    return _quota(spark, sf, True, 30, 34)


@query("cluster_center_member")
def cluster_center_member(spark, sf):
    from ..operators.select import centre_members
    return centre_members(_points(spark, sf)).select("cluster", "id", F.round("dist", 6).alias("dist"))


def _select(spark, sf, skewed, lo, hi):
    from ..operators import select as SEL
    pts = _points(spark, sf, skewed)
    q = SEL.quotas(pts, lo, hi)
    return pts, SEL.select_representatives(pts, q)


@query("farthest_points")
def farthest_points(spark, sf):
    return _select(spark, sf, False, 80, 120)[1]


@query("representatives")
def representatives(spark, sf):
    return _select(spark, sf, True, 30, 34)[1]


@query("selection_analysis")
def selection_analysis_q(spark, sf):
    from ..operators.select import selection_analysis
    pts, picks = _select(spark, sf, True, 30, 34)
    return selection_analysis(picks, pts, 30, 34)


@query("silhouette_sq_euclidean")
def silhouette_q(spark, sf):
    from ..operators.select import silhouette_sq_euclidean
    return silhouette_sq_euclidean(_points(spark, sf)).select(F.round("silhouette", 6).alias("silhouette"))


@query("assign_nearest")
def assign_nearest_q(spark, sf):
    from ..operators.select import assign_nearest, centres
    pts = _points(spark, sf)
    return assign_nearest(pts, centres(pts))


# ---- clustering and the end-to-end flow

def _kept_code(spark, sf):
    code = TB.code_corpus(spark, sf)
    res = DS.exact_dedup(code, DEDUP_THRESHOLD, K_SHINGLE)
    return DS.kept_designs(code, res)


def _kept_vectors(spark, sf):
    from ..operators.dedup import _checkpoint
    from .features import design_features
    return _checkpoint(design_features(_kept_code(spark, sf), "combined").vectors)


@query("kmeans_labels")
def kmeans_labels(spark, sf):
    from ..operators import cluster as CL
    return CL.cluster(_kept_vectors(spark, sf))[0]


@query("best_k")
def best_k_q(spark, sf):
    """The sweep: every k of the range with the silhouette and cost of its best restart."""
    from ..operators import cluster as CL
    return CL.cluster(_kept_vectors(spark, sf))[3].select("k", F.round("silhouette", 6).alias("silhouette"), F.round("cost", 6).alias("cost"))


@query("best_k_choice")
def best_k_choice(spark, sf):
    """The k that the sweep chooses: first highest silhouette."""
    from ..operators import cluster as CL
    from ..operators.select import first_best
    return first_best(CL.cluster(_kept_vectors(spark, sf))[3]).select("k", F.round("silhouette", 6).alias("silhouette"))


@query("mode_comparison")
def mode_comparison(spark, sf):
    from .select_stage import compare_modes
    return compare_modes(_kept_code(spark, sf)).withColumn("silhouette", F.round("silhouette", 6))


@query("pca_points")
def pca_points_q(spark, sf):
    """Chart table: 2-D PCA coordinates, given cluster and selection flag."""
    from ..operators import cluster as CL
    pts = _points(spark, sf)
    _, picks = _select(spark, sf, False, 80, 120)
    coords, _ = CL.pca_points(pts.select(F.col("id").alias("design_idx"), "features"))
    flags = picks.select(F.col("id").alias("design_idx"), F.lit(True).alias("selected"))
    return (coords.join(pts.select(F.col("id").alias("design_idx"), "cluster"), "design_idx")
            .join(flags, "design_idx", "left")
            .select("design_idx", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"), "cluster",
                    F.coalesce("selected", F.lit(False)).alias("selected")))


@query("pipeline_end_to_end")
def pipeline_end_to_end(spark, sf):
    """Dedup -> combined features -> best-k K-Means -> quotas -> representatives, with names."""
    from .select_stage import run_selection
    kept = _kept_code(spark, sf)
    sel = run_selection(kept, 80, 120)
    return (sel.selected.join(kept.select("design_idx", "algo_name", "source_name"), "design_idx")
            .orderBy("cluster", "pick_rank"))


# ---- incremental dedup on a stream (O38) -----------------------------------

@query("dedup_incremental")
def dedup_incremental(spark, sf):
    """``documents`` streamed in four id-ordered micro-batches through the LSH index sink."""
    from ..streaming.incremental import run_incremental
    sink = run_incremental(spark, TB.documents_corpus(spark, sf), n_batches=4, lsh_threshold=LSH_THRESHOLD)
    return sink.kept(spark)


# ---- optional tier (E1-E5, E7, E8) ------------------------------------------

@query("char_shingles")
def char_shingles(spark, sf):
    """Distinct character 5-grams of whole documents."""
    from ..operators.charshingles import char_shingle_sums
    c = TB.documents_corpus(spark, sf)
    text = F.array_join(F.transform("files", lambda f: F.coalesce(f["file_content"], F.lit(""))), "")
    return char_shingle_sums(c.select("design_idx", text.alias("text")), 5)


@query("normalised_shingles")
def normalised_shingles(spark, sf):
    """5-shingles over identifier/literal-abstracted tokens of the code corpus."""
    from ..functions.complexity import abstract_tokens
    c = TB.code_corpus(spark, sf)
    toks = abstract_tokens(F.col("files"))
    sh = shingles(toks, K_SHINGLE)
    return c.select("design_idx", F.size(toks).alias("n_tokens"), sh.alias("sh")).select(
        "design_idx", "n_tokens", F.size("sh").alias("n_shingles"),
        F.aggregate(F.transform("sh", portable_hash31), F.lit(0).cast("bigint"),
                    lambda acc, x: acc + x).alias("shingle_checksum"))


@query("cyclomatic")
def cyclomatic_q(spark, sf):
    from ..functions.complexity import cyclomatic
    return TB.code_corpus(spark, sf).select("design_idx", cyclomatic(F.col("files")).alias("cyclomatic"))


@query("halstead")
def halstead_q(spark, sf):
    from ..functions.complexity import halstead
    h = halstead(F.col("files"))
    return TB.code_corpus(spark, sf).select("design_idx", *[v.alias(k) for k, v in h.items()])


@query("size_profile")
def size_profile(spark, sf):
    """Code-length quartile bucket of every code design and of the curated selection."""
    from ..operators.curate import keep_listed
    from ..operators.profile import size_buckets
    code = TB.code_corpus(spark, sf)
    length = F.aggregate("files", F.lit(0).cast("bigint"), lambda a, f: a + F.length(F.coalesce(f["file_content"], F.lit(""))))
    sizes = code.select("design_idx", length.cast("double").alias("size"))
    sel = keep_listed(code.drop("files"), TB.curation_list_from_part(spark, sf)).select("design_idx")
    return size_buckets(sizes, sel).select("bucket", "n_all", "n_selected",
                                           F.round("share_selected", 6).alias("share_selected"))


@query("cosine_farthest")
def cosine_farthest(spark, sf):
    """E5: quotas + centre + farthest points on unit-length embeddings (cosine geometry)."""
    from ..operators import select as SEL
    pts = _points(spark, sf, False, normalise=True)
    return SEL.select_representatives(pts, SEL.quotas(pts, 80, 120))


@query("global_farthest")
def global_farthest(spark, sf):
    """10 farthest-point picks over the whole embedding table, from the member nearest the mean."""
    from ..operators import select as SEL
    pts = _points(spark, sf).withColumn("cluster", F.lit(0))
    q = pts.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).withColumn("quota", F.lit(10))
    return SEL.select_representatives(pts, q)


# ---- sources and sinks: what was written is read back (O1-O6) ---------------

def _written(spark, name: str) -> str:
    import uuid

    from ..session import drop_at_exit, scratch_path
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    drop_at_exit(spark, path)
    return path


@query("designs_json_roundtrip")
def designs_json_roundtrip(spark, sf):
    """The code corpus written as JSON Lines and read back."""
    from ..sources import io as IO
    path = _written(spark, "designs")
    IO.write_designs(TB.code_corpus(spark, sf), path, "json")
    text = F.array_join(F.transform("files", lambda f: F.concat_ws(":", f["file_name"], f["file_content"])), "|")
    return IO.read_design_lines(spark, path).select(
        "design_idx", "algo_name", "source_name", F.size("files").cast("int").alias("n_files"), F.md5(text).alias("files_md5"))


@query("names_csv_roundtrip")
def names_csv_roundtrip(spark, sf):
    """Names and sources of the code corpus written as CSV and read back; rows per pair."""
    from ..sources import io as IO
    path = _written(spark, "names")
    IO.write_name_source_csv(TB.code_corpus(spark, sf), path)
    return IO.read_curation_csv(spark, path).groupBy("algo_name", "source_name").agg(F.count(F.lit(1)).alias("n_rows"))


@query("dedup_report_roundtrip")
def dedup_report_roundtrip(spark, sf):
    """The full run report of the code corpus, its metrics read back."""
    from ..sources import io as IO
    code = TB.code_corpus(spark, sf)
    path = _written(spark, "report")
    IO.write_dedup_report(spark, path, {"similarity_threshold": DEDUP_THRESHOLD}, DS.exact_dedup(code, DEDUP_THRESHOLD, K_SHINGLE), code)
    kept = spark.read.parquet(path + "/kept").agg(F.count(F.lit(1)).alias("kept_rows"))
    metrics = spark.read.schema("original_count bigint, valid_count bigint, deduplicated_count bigint, duplicate_count bigint").json(path + "/metrics")
    return metrics.withColumn("one", F.lit(1)).join(kept.withColumn("one", F.lit(1)), "one").drop("one")


@query("curated_fallback")
def curated_fallback(spark, sf):
    """Curation of a corpus whose key columns have other names."""
    from ..operators.curate import keep_listed
    corpus, sel = _curation(spark, sf)
    other = corpus.withColumnsRenamed({"algo_name": "kernel_name", "source_name": "benchmark"})
    return keep_listed(other, sel).select("design_idx", F.col("kernel_name").alias("algo_name"), F.col("benchmark").alias("source_name"))


# ---- single feature modes, choice of k, report of a selection ---------------

@query("features_structural_only")
def features_structural_only(spark, sf):
    from .features import design_features
    fs = design_features(TB.code_corpus(spark, sf), "structural_only")
    return fs.long.select("design_idx", F.col("dim").cast("int").alias("dim"), F.round("value", 6).alias("value"))


@query("features_semantic_only")
def features_semantic_only(spark, sf):
    from .features import design_features
    fs = design_features(TB.code_corpus(spark, sf), "semantic_only")
    return fs.long.select("design_idx", F.col("dim").cast("int").alias("dim"), F.round("value", 6).alias("value"))


@query("selection_ratio")
def selection_ratio(spark, sf):
    from ..operators.select import selection_metrics
    pts, picks = _select(spark, sf, True, 30, 34)
    return selection_metrics(picks, pts)


@query("picks_per_cluster")
def picks_per_cluster(spark, sf):
    _, picks = _select(spark, sf, True, 30, 34)
    return picks.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_picks"))


# ---- reports, mode switch, fallback, array files (O7, O8, O39, O50, O1, O37) ----

def _lines(spark, text: str) -> DataFrame:
    """A report as rows of its lines: a page or so, made from bounded results."""
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line int, text string")


@query("dedup_summary")
def dedup_summary_q(spark, sf):
    from .report import dedup_summary
    return _lines(spark, dedup_summary(_exact(spark, sf), DEDUP_THRESHOLD))


@query("selection_summary")
def selection_summary(spark, sf):
    from .report import clustering_summary
    from .select_stage import run_selection
    kept = _kept_code(spark, sf)
    return _lines(spark, clustering_summary(run_selection(kept, 80, 120), kept, kept.count(), 80, 120))


@query("dedup_modes")
def dedup_modes(spark, sf):
    """The mode switch as a user calls it, both ways."""
    docs = TB.documents_corpus(spark, sf)
    made = DS.signature_table(docs, K_SHINGLE, NUM_PERM)
    out = None
    for lsh in (False, True):
        res = DS.deduplicate(docs, DEDUP_THRESHOLD, enable_lsh=lsh, lsh_threshold=LSH_THRESHOLD, k=K_SHINGLE, num_perm=NUM_PERM, made=made)
        rows = res.kept.select(F.lit(res.mode).alias("mode"), "design_idx")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("features_fallback")
def features_fallback(spark, sf):
    """Combined features of a corpus of which no term is in two designs: the structural ones alone."""
    from .features import design_features
    word = F.concat(F.lit("w"), F.translate(F.col("design_idx").cast("string"), "0123456789", "abcdefghij"))
    file = F.struct(F.lit("one.c").alias("file_name"), word.alias("file_content"))
    corpus = TB.code_corpus(spark, sf).select("design_idx", "algo_name", "source_name", F.array(file).alias("files"))
    fs = design_features(corpus, "combined")
    return fs.long.select("design_idx", F.lit(fs.mode).alias("mode"), F.col("dim").cast("int").alias("dim"), F.round("value", 6).alias("value"))


@query("designs_array_roundtrip")
def designs_array_roundtrip(spark, sf):
    """The code corpus as JSON array files, some elements' files no list, and a file whose one element is cut off, read back.

    ``kind`` tells designs from rejects (without numbers, as these follow the names of the files).
    """
    from ..sources import io as IO
    code = TB.code_corpus(spark, sf)
    path = _written(spark, "arrays")
    element = F.to_json(F.struct("algo_name", "source_name", F.col("files").alias("source_code")))
    bad = F.to_json(F.struct("algo_name", "source_name", F.lit("no list").alias("source_code")))
    rows = code.select((F.col("design_idx") % 8).alias("file"), F.when(F.col("design_idx") % 10 == 0, bad).otherwise(element).alias("e"), "design_idx")
    arrays = rows.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("design_idx", "e"))).alias("e")).select(
        F.concat(F.lit("["), F.array_join("e.e", ",\n"), F.lit("]")).alias("value"))
    broken = arrays.limit(1).select(F.lit("[{\"algo_name\": \"cut off").alias("value"))
    for k, df in enumerate((arrays.repartition(8, "value"), broken)):
        df.write.mode("append").option("maxRecordsPerFile", 1).text(path)
    designs, rejects = IO.read_designs_and_rejects(spark, path)
    text = F.array_join(F.transform("files", lambda f: F.concat_ws(":", f["file_name"], f["file_content"])), "|")
    return designs.select(F.lit("design").alias("kind"), "algo_name", "source_name", F.md5(text).alias("files_md5")).unionByName(
        rejects.select(F.lit("reject").alias("kind"), F.col("reason").alias("algo_name"), F.lit(None).cast("string").alias("source_name"),
                       F.lit(None).cast("string").alias("files_md5")))


@query("kept_in_order")
def kept_in_order(spark, sf):
    """The kept code designs written in input order over many files and read back with their places."""
    from ..sources import io as IO
    path = _written(spark, "ordered")
    IO.write_in_order(_kept_code(spark, sf).drop("files"), path, "design_idx", files=7)
    return IO.read_in_order(spark, path).select("position", "design_idx", "algo_name", "source_name")


@query("picks_in_order")
def picks_in_order(spark, sf):
    """The representatives written by cluster and pick order and read back with their places."""
    from ..sources import io as IO
    path = _written(spark, "picks")
    IO.write_in_order(_select(spark, sf, True, 30, 34)[1], path, "cluster", "pick_rank", files=4)
    return IO.read_in_order(spark, path).select("position", "id", "cluster", "pick_rank")


@query("similar_classes")
def similar_classes_q(spark, sf):
    """Similar documents as class rows with exact numbers of links, in place of pairs."""
    return DS.exact_classes(TB.documents_corpus(spark, sf), DEDUP_THRESHOLD, K_SHINGLE)
