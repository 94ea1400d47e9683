"""Incremental dedup over micro-batches equals the one-pass LSH walk."""

import random

from pyspark.sql import functions as F

from sievekit.plans import dedup_stage as DS
from sievekit.sources import tables as TB
from sievekit.streaming import incremental as INC
from sievekit.streaming.incremental import run_incremental
from helpers import SF001, corpus_df


def test_incremental_equals_batch_walk(spark):
    docs = TB.documents_corpus(spark, SF001)
    batch = {r[0] for r in DS.lsh_dedup(docs, 0.8).kept.collect()}
    sink = run_incremental(spark, docs, n_batches=3, lsh_threshold=0.8)
    assert {r[0] for r in sink.kept(spark).collect()} == batch


def test_landed_range_is_worked_on_by_all_cores(spark, monkeypatch):
    """Rows of a range that lie in one partition of the input are dealt over several tasks of the batch."""
    draw = random.Random(7)
    rows = [(i, [f"{draw.randbytes(20_000).hex()} of row {i} and row {i + 1}"]) for i in range(400)]
    seen, made = [], INC.signature_table

    def signature_table(batch, *args):
        seen.append([r["count"] for r in batch.groupBy(F.spark_partition_id()).count().collect()])
        return made(batch, *args)

    monkeypatch.setattr(INC, "signature_table", signature_table)
    sink = run_incremental(spark, corpus_df(spark, rows).coalesce(1), n_batches=1)
    assert sum(seen[0]) == 400 and max(seen[0]) <= 200
    assert sink.kept(spark).count() + sink.links(spark).count() == 400
