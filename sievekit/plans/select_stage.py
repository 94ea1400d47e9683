"""Selection stage: designs -> features -> K-Means (best k) -> quotas -> representatives."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cluster as CL
from ..operators import select as SEL
from ..operators.dedup import _checkpoint, release
from .features import MODES, design_features


@dataclass
class SelectionResult:
    selected: DataFrame      # (design_idx, cluster, pick_rank)
    labels: DataFrame        # (design_idx, cluster)
    k: int
    silhouette: float
    sweep: DataFrame
    analysis: DataFrame


def run_selection(corpus: DataFrame, target_min: int = 80, target_max: int = 120,
                  mode: str = "combined", n_init: int = CL.N_INIT, k_step: int = 1) -> SelectionResult:
    vectors = _checkpoint(design_features(corpus, mode).vectors)
    labels, k, score, sweep = CL.cluster(vectors, n_init, k_step)
    pts = (vectors.join(labels, "design_idx")
           .select(F.col("design_idx").alias("id"), "cluster", "features"))
    q = SEL.quotas(pts, target_min, target_max)
    picks = SEL.select_representatives(pts, q)
    analysis = (SEL.selection_analysis(picks, pts, target_min, target_max)
                .join(SEL.selection_metrics(picks, pts), "selected_count")
                .select("*", F.lit(k).alias("optimal_k"), F.lit(float(score)).alias("silhouette_score")))
    selected = picks.select(F.col("id").alias("design_idx"), "cluster", "pick_rank")
    return SelectionResult(selected, labels, k, score, sweep, analysis)


def compare_modes(corpus: DataFrame, n_init: int = CL.N_INIT, k_step: int = 1) -> DataFrame:
    """(mode, k, silhouette, n_rows, n_dims) for the three feature modes; best = first highest score."""
    rows = []
    for mode in ("structural_only", "semantic_only", "combined"):
        fs = design_features(corpus, mode)
        vectors = _checkpoint(fs.vectors)
        _, k, score, _ = CL.cluster(vectors, n_init, k_step)
        rows.append((mode, k, float(score), vectors.count(), fs.n_dims))
        release(vectors)
    return corpus.sparkSession.createDataFrame(rows, "mode string, k int, silhouette double, n_rows long, n_dims int")


def best_mode(scores: DataFrame) -> str:
    """The mode of highest silhouette in the table of ``compare_modes``; the first in MODES order on a tie."""
    return max(sorted(scores.collect(), key=lambda r: MODES.index(r["mode"])), key=lambda r: r["silhouette"])["mode"]


def run_best_selection(corpus: DataFrame, target_min: int = 80, target_max: int = 120, n_init: int = CL.N_INIT,
                       k_step: int = 1) -> SelectionResult:
    """Compare the feature modes, then select with the best one."""
    mode = best_mode(compare_modes(corpus, n_init, k_step))
    return run_selection(corpus, target_min, target_max, mode, n_init, k_step)
