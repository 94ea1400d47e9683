"""Readable summaries (O7, O8) built from small, bounded result rows.

Only one-row metrics, the first 10 links, per-cluster counts (one row per
cluster) and the top-5 extensions reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.profile import first_duplicates


def dedup_summary(result, threshold: float, lsh: bool = False) -> str:
    st = result.stats().first()
    lines = ["# Near-duplicate removal", "", f"- similarity threshold: {threshold}",
             f"- mode: {st['processing_mode']}", f"- input designs: {st['original_count']}"]
    if st["valid_count"] is not None:
        lines.append(f"- valid designs: {st['valid_count']}")
    rate = "n/a" if st["dedup_rate_pct"] is None else f"{st['dedup_rate_pct']:.1f}%"
    lines += [f"- kept: {st['deduplicated_count']}", f"- duplicates: {st['duplicate_count']}",
              f"- removal rate: {rate}", ""]
    if st["duplicate_count"] == 0:
        return "\n".join(lines + ["No duplicates found."])
    if lsh:
        top = result.links.orderBy("duplicate_index").limit(10).collect()
        lines += ["| duplicate | similar to | match |", "|---|---|---|"]
        lines += [f"| {r['duplicate_index']} | {r['similar_to']} | LSH |" for r in top]
    else:
        top = first_duplicates(result.links, 10).collect()
        lines += ["| duplicate | original | similarity |", "|---|---|---|"]
        lines += [f"| {r['duplicate_index']} | {r['original_index']} | {r['similarity']:.3f} |" for r in top]
    if st["duplicate_count"] > 10:
        lines.append(f"\n(first 10 of {st['duplicate_count']} duplicates)")
    return "\n".join(lines)


def clustering_summary(sel, corpus: DataFrame, n_input: int, target_min: int, target_max: int,
                       n_struct_dims: int = 23) -> str:
    a = sel.analysis.first()
    per = sel.selected.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).orderBy("cluster").collect()
    from ..operators.profile import extension_top
    ext = extension_top(corpus.join(sel.selected.select("design_idx"), "design_idx", "left_semi"), 5).collect()
    ratio = a["selected_count"] / n_input * 100 if n_input else 0.0
    lines = ["# Clustering-based selection", "", f"- target range: {target_min}-{target_max}",
             f"- structural dimensions: {n_struct_dims}",
             f"- input designs: {n_input}", f"- selected designs: {a['selected_count']}",
             f"- selection ratio: {ratio:.2f}%", f"- reduction: {100 - ratio:.1f}%",
             f"- optimal k: {a['optimal_k']}", f"- silhouette: {a['silhouette_score']:.4f}",
             f"- clusters covered: {a['covered_clusters']} of {a['total_clusters']} ({a['coverage_ratio']:.2%})",
             f"- target met: {a['target_met']}", "", "## Picks per cluster"]
    lines += [f"cluster {r['cluster']}: {r['n']}" for r in per]
    lines += ["", "## File types"] + [f"{r['extension']}: {r['n_files']}" for r in ext]
    return "\n".join(lines)
