"""What several test modules share."""

from pyspark.sql import functions as F

SF001 = "/root/testdata/sf0.001"


def corpus_df(spark, rows):
    """rows: list of (design_idx, [file texts]) -> corpus DataFrame."""
    data = [(i, [(None, t) for t in texts]) for i, texts in rows]
    df = spark.createDataFrame(
        data, "design_idx bigint, files array<struct<file_name:string,file_content:string>>")
    return df.withColumn("algo_name", F.concat(F.lit("d"), F.col("design_idx").cast("string"))) \
             .withColumn("source_name", F.lit("s"))
