"""Rows of one id, or of none, do not lie in one bucket."""
from pyspark.sql import functions as F

from hopline.llm import mixing


def test_rows_of_one_id_lie_in_many_buckets(spark):
    frame = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"),
        F.lit("a").alias("source"))
    placed = mixing.layout(frame, "doc_id", "text", "source")
    assert placed.groupBy("bucket").count().agg(F.max("count")).first()[0] < 50
    starts = sorted((r["start"], r["size"]) for r in placed.select("start", "size").collect())
    assert starts == [(2 * i, 2) for i in range(2000)]
