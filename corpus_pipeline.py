"""A training-data pipeline of five operators over the documents table.

Every stage takes (spark, docs, sf_dir) and returns documents; the last one
returns their token ids. A stage works on all rows that its predecessor kept.
Documents keep their columns, whatever further ones there are; rows that repeat
are documents of their own until the near-duplicate stage keeps one of each
group; null and empty texts go where a stage says so; an empty table stays one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.llm import bpe_codec, lsh_forest, mixing, quality, suffix_dedup
from sievekit.llm.common import Scratch, read_table

TOKENIZER = "byte_bpe_50k.json"


#: A repeated passage: over 50 words. The shortest ones of real words take 200 bytes and more (texts that repeat one
#: word are the quality stage's); runs of fewer words stay.
PASSAGE_BYTES, PASSAGE_WORDS = 200, 50


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores as set it apart from the columns of ``docs``."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the isolation forest keep; each row goes through with its own verdict."""
    judged = quality.judge_quality(docs, read_table(spark, sf_dir, "labels"), carry=True)
    return judged.where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the n-gram Jaccard join: the one of least doc_id, then of least key.

    Documents without words have no class and all stay.
    """
    classes = lsh_forest.near_duplicates(docs)
    n1, n2 = free_names(docs, "_k1", "_k2")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")
    one = (classes.where("class is not null").groupBy("class").agg(F.min(first).alias("one"))
           .select(F.col("one.k1").alias(n1), F.col("one.k2").alias(n2)))
    k1, k2 = suffix_dedup.document_key("doc_id", "text")
    keyed = docs.withColumns({n1: k1, n2: k2})
    kept = keyed.join(one, [n1, n2], "left_semi").dropDuplicates([n1, n2]).select(*docs.columns)
    wordless = docs.where(mixing.n_words("text") == 0)
    return kept.unionByName(wordless)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat; n_chars follows the text; a text that loses all its words goes.

    A passage is a run of bytes that PASSAGE_BYTES-byte strings cover which also start elsewhere, of PASSAGE_WORDS
    words or more. A character that a cut splits is dropped with it.
    """
    n1, n2, left = free_names(docs, "_k1", "_k2", "_kept")
    k1, k2 = suffix_dedup.document_key("doc_id", "text")
    cut = suffix_dedup.repeated_passages(docs, length=PASSAGE_BYTES, characters=True, min_words=PASSAGE_WORDS).select(
        F.col("k1").alias(n1), F.col("k2").alias(n2), F.col("kept").alias(left))
    whole = docs.withColumns({n1: k1, n2: k2}).join(cut, [n1, n2], "left")
    untouched = F.col(left).isNull()
    text = F.when(untouched, F.col("text")).otherwise(F.col(left).cast("string"))
    return (whole.withColumn("text", text)
            .withColumn("n_chars", F.when(untouched, F.col("n_chars")).otherwise(F.length("text")).cast("long"))
            .where(untouched | (mixing.n_words("text") > 0)).select(*docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in whole copies."""
    mixed = mixing.mix_sources(docs, carry=True)
    return (mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .select("row.*"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of the ids and of the text that they decode to."""
    import public_tokenizers

    spec = bpe_codec.tokenizer_text(public_tokenizers.path(TOKENIZER))
    return bpe_codec.round_trip(docs, spec).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        F.sha2("listed", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", passage_dedup),
          ("mixing sources to target weights", mix), ("BPE encoding and decoding", encode)]

#: No stage but the mix can be told in SQL; tests compare with brute-force versions of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs, last = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if last:
            scratch.drop(last)
        last = name.replace(" ", "-")
    return docs
