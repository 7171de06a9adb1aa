"""No group of a hot shard grows with the shard: visitors are split, too."""
import random

from pyspark.sql import functions as F

from hopline.llm import simhash


def test_groups_of_a_hot_shard_are_bounded(spark, monkeypatch):
    rng = random.Random(4)
    prints = list({rng.getrandbits(40) << 23 for _ in range(2000)})  # the lowest two blocks are 0 for all
    frame = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    dealt = []
    monkeypatch.setattr(type(frame), "mapInPandas", lambda rows, *_: (dealt.append(rows), frame.selectExpr("fp a", "fp b"))[1])
    simhash.linked(frame, 4, 16)
    groups = dealt[0].groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("visits")).cast("int")).alias("members"))
    biggest = groups.agg(F.max("n"), F.max("members")).first()
    assert biggest[0] <= 10 * 16 and biggest[1] <= 3 * 16
    hot = dealt[0].groupBy("shard").agg(F.countDistinct("fp").alias("n")).agg(F.max("n")).first()[0]
    assert hot == len(prints)
