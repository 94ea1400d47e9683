"""Representative selection: per-cluster quotas, centre member, farthest-point sampling.

Inputs: ``points(id, cluster, features array<double>)``.

* Quotas work on the per-cluster table (one row per cluster): proportional
  share of ``T = (min+max)//2`` capped by ``min(size, max(1, min(cap, size//2)))``,
  then trimmed to ``target_max`` / filled to ``target_min`` in unit form:
  each quota is exploded into units and ranked once (equal to the greedy
  one-at-a-time loops).
* Picks: take-all clusters keep every member; others start at the member
  nearest to the mean (lowest id on a tie) and add farthest points (largest
  distance to the picks so far, lowest id on a tie) for at most ``cap-1``
  rounds, all clusters at once. Per-cluster argmin/argmax are partial
  aggregations (``min``/``max`` of a struct), so a cluster holding a third of
  all rows never lands in one task.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dedup import _checkpoint

CAP = 5  # FIXED VALUE: most picks per cluster
#: Rows up to which a table of clusters is sent to all tasks; larger ones are joined by cluster.
SMALL_TABLE_ROWS = 20_000
#: Clusters that a point meets in one row.
BLOCK_CLUSTERS = 2_000


def sq_dist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(sq_dist(a, b))


def compared(dist: Column) -> Column:
    """A distance as it is compared: rounded, so that equal distances tie however they were added up."""
    return F.round(dist, 9)


def cluster_sizes(points: DataFrame) -> DataFrame:
    return points.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


def base_quotas(sizes: DataFrame, target_min: int, target_max: int, cap: int = CAP) -> DataFrame:
    """(cluster, size, quota) before trimming/filling."""
    t = (target_min + target_max) // 2
    total = F.sum("size").over(Window.partitionBy(F.lit(0)))
    base = F.greatest(F.lit(1), F.floor(F.col("size").cast("double") / total.cast("double") * F.lit(float(t))))
    most = F.least(F.col("size"), F.greatest(F.lit(1), F.least(F.lit(cap), F.floor(F.col("size") / 2))))
    return sizes.select("cluster", "size", F.least(base, most).cast("int").alias("quota"))


def adjust_quotas(q: DataFrame, target_min: int, target_max: int, cap: int = CAP) -> DataFrame:
    """Trim to target_max (largest quota first, never below 1) or fill to target_min
    (largest current quota below min(cap, size) first); ties go to the lower cluster id."""
    q = _checkpoint(q)
    total = q.agg(F.sum("quota")).first()[0] or 0
    if total > target_max:
        excess = total - target_max
        units = q.select("cluster", F.explode(F.sequence(F.lit(2), F.greatest(F.col("quota"), F.lit(2)))).alias("u"),
                         "quota").where(F.col("u") <= F.col("quota"))
        w = Window.orderBy(F.desc("u"), "cluster")
        removed = (units.withColumn("r", F.row_number().over(w)).where(F.col("r") <= excess)
                   .groupBy("cluster").agg(F.count(F.lit(1)).alias("minus")))
        return (q.join(removed, "cluster", "left")
                .select("cluster", "size", (F.col("quota") - F.coalesce("minus", F.lit(0))).cast("int").alias("quota")))
    if total < target_min:
        need = target_min - total
        room = F.least(F.lit(cap), F.col("size"))
        units = (q.where(F.col("quota") < room)
                 .select("cluster", "quota", F.explode(F.sequence(F.col("quota") + 1, room)).alias("u")))
        w = Window.orderBy(F.desc("quota"), "cluster", "u")
        added = (units.withColumn("r", F.row_number().over(w)).where(F.col("r") <= need)
                 .groupBy("cluster").agg(F.count(F.lit(1)).alias("plus")))
        return (q.join(added, "cluster", "left")
                .select("cluster", "size", (F.col("quota") + F.coalesce("plus", F.lit(0))).cast("int").alias("quota")))
    return q


def quotas(points: DataFrame, target_min: int = 80, target_max: int = 120, cap: int = CAP) -> DataFrame:
    return adjust_quotas(base_quotas(cluster_sizes(points), target_min, target_max, cap),
                         target_min, target_max, cap)


def centres(points: DataFrame) -> DataFrame:
    """(cluster, centre array<double>): per-dimension mean, partially aggregated as whole vectors."""
    return points.groupBy("cluster").agg(
        vector_to_array(Summarizer.mean(array_to_vector("features"))).alias("centre"))


def join_per_cluster(points: DataFrame, per_cluster: DataFrame) -> DataFrame:
    """Join a table of one row per cluster; sent to all tasks only after its rows were counted."""
    small = per_cluster.count() <= SMALL_TABLE_ROWS
    return points.join(F.broadcast(per_cluster) if small else per_cluster, "cluster")


def centre_members(points: DataFrame) -> DataFrame:
    """(cluster, id, dist): the member nearest to its cluster mean, lowest id on a tie."""
    d = join_per_cluster(points, _checkpoint(centres(points))).select(
        "cluster", "id", euclid(F.col("features"), F.col("centre")).alias("dist"))
    best = d.groupBy("cluster").agg(F.min(F.struct(compared(F.col("dist")).alias("by"), "id", "dist")).alias("b"))
    return best.select("cluster", F.col("b.id").alias("id"), F.col("b.dist").alias("dist"))


def select_representatives(points: DataFrame, q: DataFrame) -> DataFrame:
    """(id, cluster, pick_rank) ordered by cluster, then pick order.

    A round reads the points once: the picks of a cluster so far (at most its
    quota) come to the rows as one array, and the distance to the nearest of
    them is found in the row. Points are never shuffled or written again.
    """
    q = _checkpoint(q)
    pts = join_per_cluster(points, q.select("cluster", "quota", "size"))
    take_all = (pts.where(F.col("quota") >= F.col("size"))
                .withColumn("pick_rank", F.row_number().over(Window.partitionBy("cluster").orderBy("id")))
                .select("id", "cluster", "pick_rank"))
    rest = _checkpoint(pts.where((F.col("quota") < F.col("size")) & (F.col("quota") > 0))
                       .select("id", "cluster", "quota", "features"))
    first = centre_members(rest.select("id", "cluster", "features")).select("cluster", "id")
    picks = _checkpoint(rest.join(first, ["cluster", "id"]).select("cluster", "id", F.lit(1).alias("pick_rank"), "features"))
    max_q = rest.agg(F.max("quota")).first()[0] or 0
    for r in range(2, int(max_q) + 1):
        held = picks.groupBy("cluster").agg(F.collect_list("features").alias("pf"), F.collect_list("id").alias("pid"))
        near = F.array_min(F.transform("pf", lambda p: euclid(F.col("features"), p)))
        cand = (join_per_cluster(rest.where(F.col("quota") >= r), held)
                .where(~F.array_contains("pid", F.col("id")))
                .select("cluster", "id", compared(near).alias("min_dist")))
        best = cand.groupBy("cluster").agg(F.max(F.struct("min_dist", (-F.col("id")).alias("neg"))).alias("b"))
        new = best.select("cluster", (-F.col("b.neg")).alias("id"))
        more = rest.join(new, ["cluster", "id"]).select("cluster", "id", F.lit(r).alias("pick_rank"), "features")
        picks = _checkpoint(picks.unionByName(more))
    return take_all.unionByName(picks.select("id", "cluster", "pick_rank"))


def selection_analysis(picks: DataFrame, points: DataFrame, target_min: int, target_max: int) -> DataFrame:
    """selected_count, total_clusters, covered_clusters, coverage_ratio, target_met (one row)."""
    tagged = (points.select(F.col("cluster"), F.lit(0).alias("sel"))
              .unionByName(picks.select("cluster", F.lit(1).alias("sel"))))
    return tagged.agg(
        F.sum("sel").alias("selected_count"),
        F.count_distinct("cluster").alias("total_clusters"),
        F.count_distinct(F.when(F.col("sel") == 1, F.col("cluster"))).alias("covered_clusters"),
    ).select(
        F.coalesce("selected_count", F.lit(0)).cast("bigint").alias("selected_count"), "total_clusters", "covered_clusters",
        F.when(F.col("total_clusters") > 0, F.round(F.col("covered_clusters") / F.col("total_clusters"), 6))
        .otherwise(F.lit(0.0)).alias("coverage_ratio"),
        F.coalesce("selected_count", F.lit(0)).between(target_min, target_max).alias("target_met"))


def meet_clusters(points: DataFrame, per_cluster: DataFrame) -> DataFrame:
    """Each point with arrays ``cs`` of all rows of a table of clusters, in blocks of bounded size.

    There is one block (and one row a point) unless there are more clusters than ``BLOCK_CLUSTERS``.
    """
    table = _checkpoint(per_cluster)
    n = table.count()
    blocks = max(1, -(-n // BLOCK_CLUSTERS))
    cs = (table.withColumn("blk", F.pmod(F.xxhash64("c"), F.lit(blocks)).cast("int"))
          .groupBy("blk").agg(F.collect_list(F.struct(*table.columns)).alias("cs")))
    return points.withColumn("blk", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(
        F.broadcast(cs) if n <= SMALL_TABLE_ROWS else cs, "blk")


def silhouette_sq_euclidean(points: DataFrame) -> DataFrame:
    """Mean silhouette with squared Euclidean distance, in closed form.

    For cluster C: mean_j |x - x_j|^2 = |x|^2 - 2 x.mu_C + mean_C |x_j|^2, so
    only (count, mean vector, mean squared norm) per cluster is needed: O(n k),
    never a pair of points. Own-cluster mean is rescaled by |C|/(|C|-1) (the
    point itself contributes 0); singletons, points of distance 0 to both
    clusters, and data with one cluster score 0.
    """
    norm = F.aggregate(F.col("features"), F.lit(0.0), lambda a, v: a + v * v)
    stats = points.groupBy(F.col("cluster").alias("c")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg(norm).alias("q"),
        vector_to_array(Summarizer.mean(array_to_vector("features"))).alias("mu"))

    def mean_d(c: Column) -> Column:
        dot = F.aggregate(F.zip_with(F.col("features"), c["mu"], lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
        return F.col("xx") - 2.0 * dot + c["q"]

    per = meet_clusters(points.select("id", "cluster", "features", norm.alias("xx")), stats).select(
        "id", "cluster", F.transform("cs", lambda c: F.struct(c["c"].alias("c"), c["n"].alias("n"), mean_d(c).alias("m"))).alias("ds"))
    own = F.filter("ds", lambda t: t["c"] == F.col("cluster"))
    others = F.array_min(F.transform(F.filter("ds", lambda t: t["c"] != F.col("cluster")), lambda t: t["m"]))
    by_point = per.select("id", F.get(own, F.lit(0)).alias("own"), others.alias("b")).groupBy("id").agg(
        F.max("own.n").alias("n"), F.max("own.m").alias("m"), F.min("b").alias("b"))
    a = F.when(F.col("n") > 1, F.col("m") * F.col("n") / (F.col("n") - 1))
    top = F.greatest(a, F.col("b"))
    s = F.when((top > 0) & F.col("b").isNotNull() & a.isNotNull(), (F.col("b") - a) / top).otherwise(F.lit(0.0))
    return by_point.select(s.alias("s")).agg(F.coalesce(F.avg("s"), F.lit(0.0)).alias("silhouette"))


def assign_nearest(points: DataFrame, centres_df: DataFrame) -> DataFrame:
    """(id, cluster) of the nearest centre (lowest cluster id on a tie)."""
    near = F.array_min(F.transform("cs", lambda c: F.struct(sq_dist(F.col("features"), c["centre"]).alias("d"), c["c"].alias("c"))))
    met = meet_clusters(points.select("id", "features"), centres_df.select(F.col("cluster").alias("c"), "centre"))
    return (met.select("id", near.alias("b")).groupBy("id").agg(F.min("b").alias("b"))
            .select("id", F.col("b.c").alias("cluster")))


def first_best(scores: DataFrame) -> DataFrame:
    """The row of highest ``silhouette`` in ``scores(k, silhouette)``, lowest k on a tie."""
    return scores.orderBy(F.desc(F.round("silhouette", 9)), "k").limit(1)


def selection_metrics(picks: DataFrame, points: DataFrame) -> DataFrame:
    """input_count, selected_count, selection_ratio_pct, reduction_pct (one row; ratios are 0 and 100 without input)."""
    tagged = points.select(F.lit(0).alias("sel")).unionByName(picks.select(F.lit(1).alias("sel")))
    ratio = F.when(F.col("input_count") > 0, F.col("selected_count") / F.col("input_count") * 100).otherwise(F.lit(0.0))
    return tagged.agg(F.count_if(F.col("sel") == 0).alias("input_count"), F.count_if(F.col("sel") == 1).alias("selected_count")).select(
        "input_count", "selected_count", F.round(ratio, 6).alias("selection_ratio_pct"), F.round(100 - ratio, 6).alias("reduction_pct"))
