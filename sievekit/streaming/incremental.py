"""Incremental LSH dedup: each micro-batch is checked against an index of kept designs.

A design is a duplicate when one of its LSH bands equals a band of a design
kept earlier (in the index) or earlier in its own batch (first-wins rounds
over bucket membership, no pairs). Only kept designs enter the index.

Exactly-once effect on top of the at-least-once ``foreachBatch`` contract:
the index and the result tables are written under ``batch_id=N`` with
overwrite, and a batch reads only index partitions ``batch_id < N``; a
replayed batch therefore rewrites the same rows. All state lives in the
shared checkpoint folder (``spark.checkpoint.dir``).
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup as D
from ..operators import minhash as MH
from ..plans.dedup_stage import signature_table
from ..session import scratch_path
from ..sources.tables import spread

#: Bytes of a row group of a landed range. Files split at row groups, so that a range, which may lie in a few files of
#: the input, is worked on by all cores and not by as many as wrote it.
LANDING_GROUP_BYTES = 2 << 20


class IncrementalDedup:
    """``foreachBatch`` sink holding the paths of the band index and the results."""

    def __init__(self, base: str, lsh_threshold: float = 0.8, k: int = 5, num_perm: int = 128,
                 hls_aware: bool = True):
        self.base = base
        self.index_dir = os.path.join(base, "index")
        self.kept_dir = os.path.join(base, "kept")
        self.links_dir = os.path.join(base, "links")
        self.k, self.num_perm, self.hls_aware = k, num_perm, hls_aware
        self.bands = MH.lsh_bands(*MH.optimal_bands(lsh_threshold, num_perm))

    def _index(self, spark: SparkSession, batch_id: int) -> DataFrame | None:
        if batch_id == 0:  # nothing indexed yet
            return None
        # a later batch without an index has lost it: the read fails, so that no duplicate is kept unseen
        idx = spark.read.parquet(self.index_dir)
        return idx.where(F.col("batch_id") < batch_id).select("bucket", F.col("node").alias("kept_node"))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        sigs = signature_table(spread(batch), self.k, self.num_perm, self.hls_aware)
        valid = sigs.where(F.col("sig").isNotNull())
        members = D._checkpoint(MH.band_keys(valid, "sig", self.bands).select(
            F.col("id").alias("node"), F.struct("band", "band_key").alias("bucket")))
        index = self._index(spark, batch_id)
        if index is not None:
            vs_index = (members.join(index, "bucket").groupBy("node")
                        .agg(F.min("kept_node").alias("similar_to")))
        else:
            vs_index = spark.createDataFrame([], "node long, similar_to long")
        vs_index = D._checkpoint(vs_index)
        open_members = members.join(vs_index.select("node"), "node", "left_anti")
        state = D.first_wins_buckets(open_members)
        in_batch = state.where(F.col("state") == D.DUP).select("node", "similar_to")
        dups = vs_index.unionByName(in_batch)
        links = dups.select(F.col("node").alias("duplicate_index"),
                            F.concat(F.lit("design_"), F.col("similar_to").cast("string")).alias("similar_to"),
                            F.lit("LSH_match").alias("estimated_similarity"))
        kept = valid.select(F.col("id").alias("design_idx")).join(
            dups.select(F.col("node").alias("design_idx")), "design_idx", "left_anti")
        part = f"batch_id={batch_id}"
        kept.write.mode("overwrite").parquet(os.path.join(self.kept_dir, part))
        links.write.mode("overwrite").parquet(os.path.join(self.links_dir, part))
        (members.join(kept.select(F.col("design_idx").alias("node")), "node", "left_semi")
         .write.mode("overwrite").parquet(os.path.join(self.index_dir, part)))

    def kept(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.kept_dir).select("design_idx")

    def links(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.links_dir).select("duplicate_index", "similar_to", "estimated_similarity")


def id_ranges(corpus: DataFrame, n_parts: int) -> list[tuple[int, int]]:
    """``n_parts`` half-open ``design_idx`` ranges covering the corpus, ascending."""
    bounds = corpus.agg(F.min("design_idx"), F.max("design_idx")).first()
    lo, hi = int(bounds[0]), int(bounds[1])
    step = max(1, -(-(hi - lo + 1) // n_parts))
    return [(lo + i * step, lo + (i + 1) * step) for i in range(n_parts)]


def run_incremental(spark: SparkSession, corpus: DataFrame, n_batches: int = 4,
                    lsh_threshold: float = 0.8, base: str | None = None) -> IncrementalDedup:
    """Land ``corpus`` in ``design_idx`` ranges and drain each landing with the stream.

    Each range is written into the landing folder, then the query runs with
    ``availableNow`` and picks up exactly the new file(s) as one micro-batch,
    so batches arrive in index order. The stream checkpoint keeps the
    processed-file log across runs.
    """
    base = base or scratch_path(spark, f"incremental-{uuid.uuid4().hex}")
    landing = os.path.join(base, "landing")
    sink = IncrementalDedup(base, lsh_threshold)
    schema = corpus.schema
    for i, (a, b) in enumerate(id_ranges(corpus, n_batches)):
        (corpus.where((F.col("design_idx") >= a) & (F.col("design_idx") < b))
         .write.mode("overwrite").option("parquet.block.size", LANDING_GROUP_BYTES).parquet(os.path.join(landing, f"range-{i:05d}")))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(landing)
        q = (stream.writeStream.foreachBatch(sink)
             .option("checkpointLocation", os.path.join(base, "stream-checkpoint"))
             .trigger(availableNow=True).start())
        q.awaitTermination()
    return sink
