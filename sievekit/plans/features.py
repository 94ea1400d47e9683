"""Feature stage: structural vector (robust-scaled), TF-IDF, combined + max-abs.

Modes: ``structural_only``, ``semantic_only``, ``combined``. Lazy plans mean
an unused side is never computed. Output: ``(design_idx, features
array<double>)`` with the 23 structural dimensions first (fixed order) and
the vocabulary terms after them in alphabetical order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.structural import ENHANCED_FEATURES, with_structural
from ..functions.text import semantic_tokens
from ..operators import scaling as S
from ..operators import tfidf as TF
from ..operators.dedup import _checkpoint

MODES = ("structural_only", "semantic_only", "combined")


@dataclass
class FeatureSet:
    vectors: DataFrame          # (design_idx, features array<double>)
    long: DataFrame             # (design_idx, dim, value) non-zero entries
    n_dims: int
    mode: str
    vocabulary: DataFrame | None


def structural_scaled(corpus: DataFrame) -> DataFrame:
    """(design_idx, 23 robust-scaled structural columns), checkpointed."""
    raw = _checkpoint(with_structural(corpus.select("design_idx", "files")).drop("files"))
    return S.apply_robust(raw, S.fit_robust(raw, list(ENHANCED_FEATURES)), ["design_idx"])


def tfidf_model(corpus: DataFrame, max_features: int = 200) -> TF.TfidfModel:
    docs = corpus.select("design_idx", semantic_tokens(F.col("files")).alias("tokens"))
    return TF.fit_transform(docs, "tokens", max_features)


def design_features(corpus: DataFrame, mode: str = "combined", structural_weight: float = 1.0,
                    max_features: int = 200) -> FeatureSet:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    n_struct = len(ENHANCED_FEATURES)
    struct = None
    if mode != "semantic_only":
        struct = structural_scaled(corpus)
    model = None
    if mode != "structural_only":
        model = tfidf_model(corpus, max_features)
        n_vocab = model.vocabulary.count()
        if n_vocab == 0:  # empty vocabulary: structural features only
            model, mode = None, "structural_only"
            struct = struct if struct is not None else structural_scaled(corpus)
    ids = corpus.select("design_idx")
    parts, long_parts, dims = [], [], 0
    if struct is not None:
        w = float(structural_weight)
        scols = [(F.col(c) * F.lit(w)).alias(c) for c in ENHANCED_FEATURES]
        struct = struct.select("design_idx", *scols)
        if mode == "combined":
            struct = S.maxabs_scale(struct, list(ENHANCED_FEATURES))
        parts.append(("s", struct.select("design_idx", F.array(*ENHANCED_FEATURES).alias("s"))))
        long_parts.append(struct.select("design_idx", F.posexplode(F.array(*ENHANCED_FEATURES)).alias("dim", "value")))
        dims += n_struct
    if model is not None:
        wts = model.weights
        if mode == "combined":
            div = {r["dim"]: r["m"] for r in wts.groupBy("dim").agg(F.max(F.abs("weight")).alias("m")).collect()}
            # bounded: at most max_features rows
            div_arr = F.array(*[F.lit(float(div.get(i) or 1.0)) for i in range(n_vocab)])
            wts = wts.withColumn("weight", F.col("weight") / F.element_at(div_arr, F.col("dim") + 1))
        off = dims
        sem = wts.groupBy("design_idx").agg(F.map_from_entries(F.collect_list(F.struct("dim", "weight"))).alias("m"))
        sem = ids.join(sem, "design_idx", "left").select(
            "design_idx", F.transform(F.sequence(F.lit(0), F.lit(n_vocab - 1)),
                                      lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("t"))
        parts.append(("t", sem))
        long_parts.append(wts.select("design_idx", (F.col("dim") + off).alias("dim"), F.col("weight").alias("value")))
        dims += n_vocab
    vec = ids
    for name, p in parts:
        vec = vec.join(p, "design_idx", "left")
    vec = vec.select("design_idx", F.concat(*[F.col(n) for n, _ in parts]).alias("features"))
    long = long_parts[0]
    for lp in long_parts[1:]:
        long = long.unionByName(lp)
    long = long.where(F.col("value") != 0)
    return FeatureSet(vec, long, dims, mode, model.vocabulary if model else None)
