"""The encoding stage decodes what it encodes."""
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from hopline.llm import bpe


def test_ids_that_decode_to_another_text_end_the_run(spark, monkeypatch, odd_docs):
    assert C.encode(spark, odd_docs, "").count() == odd_docs.count()

    def damaged(docs, path, pattern, text_col="text", out_col="coded"):
        return docs.withColumn(out_col, F.struct(F.lit(b"1234").alias("ids"), F.lit(b"another").alias("decoded")))

    monkeypatch.setattr(bpe, "round_trip", damaged)
    with pytest.raises(Exception, match="do not decode"):
        C.encode(spark, odd_docs, "").collect()
