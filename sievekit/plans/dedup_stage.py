"""Near-duplicate removal stage: corpus -> kept designs, duplicate links, statistics.

Plan: read only ``design_idx`` and ``files`` -> lexical tokens -> k-shingles
(row-local) -> collapse byte-equal shingle sets -> pair finder (exact Jaccard
prefix join, or MinHash signature join) -> first-wins rounds -> links. The
payload columns are fetched at the very end by a semi-join on ``design_idx``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shingles import shingles
from ..functions.text import lexical_tokens
from ..operators import dedup as D
from ..operators import minhash as MH
from ..operators.simjoin import collapse_equal_sets
from ..operators.tokensets import PackedSets, TokenSets, token_sets


# FIXED VALUES: names in the result tables
MODE_EXACT, MODE_LSH = "Exact", "LSH"
LSH_PREFIX, LSH_SIMILARITY = "design_", "LSH_match"


@dataclass
class DedupResult:
    valid: DataFrame        # (design_idx) designs with at least one shingle
    links: DataFrame        # (duplicate_index, original_index, similarity)
    kept: DataFrame         # (design_idx) kept designs
    mode: str
    original: DataFrame     # (design_idx) all input designs

    def stats(self) -> DataFrame:
        return dedup_stats(self)


def shingle_sets(corpus: DataFrame, k: int = 5, hls_aware: bool = True) -> DataFrame:
    """(design_idx, shingles array<string>) with the lexical profile."""
    return corpus.select("design_idx", shingles(lexical_tokens(F.col("files"), hls_aware), k).alias("shingles"))


def window_sets(corpus: DataFrame, k: int = 5, hls_aware: bool = True) -> TokenSets:
    """Sets of k-token windows of all designs, from tokens written once to the checkpoint directory.

    Text processing is the costly, row-local part; every later step (pair finding, links, kept set) reads compact
    tokens instead of texts, and filters on the result cannot be pushed back into (and so duplicate) the tokeniser.
    """
    return token_sets(corpus.select(F.col("design_idx").alias("id"), lexical_tokens(F.col("files"), hls_aware).alias("tokens")), k)


def hashed_shingle_sets(corpus: DataFrame, k: int = 5, hls_aware: bool = True) -> DataFrame:
    """(id, set array<bigint>) of the designs with a window."""
    return window_sets(corpus, k, hls_aware).rows().select("id", "set")


def exact_components(sets: TokenSets, threshold: float, giant_cells: int = D.GIANT_CELLS) -> tuple[PackedSets, DataFrame, DataFrame]:
    """(docs, shared postings, groups) of ``candidate_components`` for the representatives of equal sets; docs hold the sets of groups alone, packed."""
    pre = D.shared_postings(sets.prefixes(threshold))
    groups = D.posting_components(pre, pre.select("id", "n").distinct(), threshold, giant_cells)
    return sets.of_representatives(groups), pre.drop("p", "first"), groups


def exact_pairs(corpus: DataFrame, threshold: float, k: int = 5, hls_aware: bool = True) -> DataFrame:
    """(i, j, overlap, jaccard) of the similar pairs i < j of representatives of equal sets."""
    return D.component_pairs(*exact_components(window_sets(corpus, k, hls_aware), threshold), threshold)


def exact_classes(corpus: DataFrame, threshold: float, k: int = 5, hls_aware: bool = True) -> DataFrame:
    """(design_idx, class, n_links) of every design with a window: classes and links of the representatives of equal sets."""
    sets = window_sets(corpus, k, hls_aware)
    found = D.with_alone(sets.representatives().select(F.col("rep").alias("id")), D.component_classes(*exact_components(sets, threshold), threshold))
    return sets.members().join(found.withColumnRenamed("id", "rep"), "rep").select(F.col("id").alias("design_idx"), "class", "n_links")


def signature_table(corpus: DataFrame, k: int = 5, num_perm: int = 128,
                    hls_aware: bool = True) -> DataFrame:
    """(id, sig array<bigint>) written once; ``sig`` is null for designs without shingles.

    Tokens, shingles and hashes are one row-local JVM expression, signatures an Arrow kernel on them: one pass.
    """
    return D._checkpoint(MH.signatures(shingle_sets(corpus, k, hls_aware).select(
        F.col("design_idx").alias("id"), MH.shingle_hashes31(F.col("shingles")).alias("hashes")), num_perm))


def _resolve(corpus: DataFrame, valid: DataFrame, members: DataFrame, rep_links: DataFrame) -> DedupResult:
    links = D._checkpoint(D.expand_collapsed_links(members, rep_links))
    v = valid.select(F.col("id").alias("design_idx"))
    kept = v.join(links.select(F.col("duplicate_index").alias("design_idx")), "design_idx", "left_anti")
    return DedupResult(v, links, kept, MODE_EXACT, corpus.select("design_idx"))


def exact_dedup(corpus: DataFrame, threshold: float = 0.85, k: int = 5, hls_aware: bool = True) -> DedupResult:
    """Exact mode with exact Jaccard of shingle sets as the similarity.

    Equal sets are collapsed, the rest is walked component by component from
    prefix posting lists; no table of similar pairs is made.
    """
    sets = window_sets(corpus, k, hls_aware)
    rep_links = D.component_links(*exact_components(sets, threshold), threshold)
    return _resolve(corpus, sets.valid, sets.members(), rep_links)


def minhash_dedup(corpus: DataFrame, threshold: float = 0.85, k: int = 5,
                  num_perm: int = 128, hls_aware: bool = True, made: DataFrame | None = None) -> DedupResult:
    """Exact mode with the MinHash estimate (equal positions / num_perm) as the similarity.

    Candidates share one of the pigeonhole bands (lossless for the estimate);
    the walk is that of ``exact_dedup`` with bands as posting lists. ``made``: the corpus's ``signature_table``, if there.
    """
    sigs = (signature_table(corpus, k, num_perm, hls_aware) if made is None else made).where(F.col("sig").isNotNull())
    reps, members = collapse_equal_sets(sigs, set_col="sig")
    reps = D._checkpoint(reps)
    postings = MH.band_postings(reps, MH.pigeonhole_bands(threshold, num_perm), sig_col="set")
    _, rep_links = D.first_wins(reps, threshold, prefix=postings,
                                verify=MH.signature_verifier(num_perm), use_length=False, similarity=D.equal_places)
    return _resolve(corpus, sigs.select("id"), members, rep_links)


def lsh_dedup(corpus: DataFrame, lsh_threshold: float = 0.8, k: int = 5,
              num_perm: int = 128, hls_aware: bool = True,
              bands: tuple[int, int] | None = None, made: DataFrame | None = None) -> DedupResult:
    """LSH mode: a design is a duplicate when it shares a band with a kept design.

    No similarity verification (as in the original LSH mode); ``similar_to``
    is the smallest kept design sharing a band, written ``design_{i}``. ``made``: the corpus's ``signature_table``, if there.
    """
    b, r = bands or MH.optimal_bands(lsh_threshold, num_perm)
    sigs = (signature_table(corpus, k, num_perm, hls_aware) if made is None else made).where(F.col("sig").isNotNull())
    valid = sigs.select("id")
    keys = MH.band_keys(sigs, "sig", MH.lsh_bands(b, r))
    members = keys.select(F.col("id").alias("node"), F.struct("band", "band_key").alias("bucket"))
    state = D.first_wins_buckets(members)
    links = D._checkpoint(state.where(F.col("state") == D.DUP).select(
        F.col("node").alias("duplicate_index"),
        F.concat(F.lit(LSH_PREFIX), F.col("similar_to").cast("string")).alias("similar_to"),
        F.lit(LSH_SIMILARITY).alias("estimated_similarity")))
    v = valid.select(F.col("id").alias("design_idx"))
    kept = v.join(links.select(F.col("duplicate_index").alias("design_idx")), "design_idx", "left_anti")
    return DedupResult(v, links, kept, MODE_LSH, corpus.select("design_idx"))


def dedup_stats(res: DedupResult) -> DataFrame:
    """One row: original, valid (Exact only), kept, duplicate counts, mode, rate (null if empty).

    The four counts come from one aggregate over a tagged union of the id
    columns, so the statistics cost one pass and no join.
    """
    tagged = (res.original.select(F.lit("o").alias("t"))
              .unionByName(res.valid.select(F.lit("v").alias("t")))
              .unionByName(res.kept.select(F.lit("k").alias("t")))
              .unionByName(res.links.select(F.lit("d").alias("t"))))
    out = tagged.agg(*[F.count_if(F.col("t") == tag).alias(name) for tag, name in
                       (("o", "original_count"), ("v", "valid_count"),
                        ("k", "deduplicated_count"), ("d", "duplicate_count"))])
    valid_col = F.col("valid_count") if res.mode == MODE_EXACT else F.lit(None).cast("bigint")
    return out.select(
        "original_count", valid_col.alias("valid_count"), "deduplicated_count", "duplicate_count",
        F.lit(res.mode).alias("processing_mode"),
        F.when(F.col("original_count") > 0,
               F.round((1 - F.col("deduplicated_count") / F.col("original_count")) * 100, 6))
        .alias("dedup_rate_pct"))


def kept_designs(corpus: DataFrame, res: DedupResult) -> DataFrame:
    """The input rows (all columns) of kept designs; writers sort them."""
    return corpus.join(res.kept, "design_idx", "left_semi")


def deduplicate(corpus: DataFrame, similarity_threshold: float = 0.85, enable_lsh: bool = False,
                lsh_threshold: float = 0.8, k: int = 5, num_perm: int = 128, hls_aware: bool = True,
                similarity: str = "minhash", made: DataFrame | None = None) -> DedupResult:
    """Mode switch: LSH mode, or exact mode with ``similarity`` = 'minhash' (the estimate) or 'exact' (Jaccard).

    ``made``: the corpus's ``signature_table`` of the same ``k``, ``num_perm`` and ``hls_aware``, for several modes over one corpus.
    """
    if enable_lsh:
        return lsh_dedup(corpus, lsh_threshold, k, num_perm, hls_aware, made=made)
    if similarity == "minhash":
        return minhash_dedup(corpus, similarity_threshold, k, num_perm, hls_aware, made)
    return exact_dedup(corpus, similarity_threshold, k, hls_aware)
