"""Batches by length: values and order do not depend on them; documents and queries are encoded apart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators.search import Encoder


def lengths(mark):
    def encode(texts):
        assert len(texts) <= 8 and [len(t) for t in texts] == sorted((len(t) for t in texts), reverse=True)
        return np.array([[len(t), sum(map(ord, t)) % 1000, mark] for t in texts])

    return encode


@pytest.mark.parametrize(("window", "batch"), [(1, 1), (16, 8), (1000, 5)])
def test_order_and_values(spark, window, batch):
    encoder = Encoder("m", 3, lengths(1), lengths(2), window, batch)
    texts = [None if i % 11 == 5 else "x" * (i * 37 % 50) + str(i) for i in range(200)] + [""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    for column, mark in ((encoder.document("text"), 1), (encoder.query("text"), 2)):
        got = {r.id: r.v for r in rows.select("id", column.alias("v")).collect()}
        assert got == {i: None if t is None else [float(len(t)), float(sum(map(ord, t)) % 1000), float(mark)] for i, t in enumerate(texts)}


def test_another_dimension_is_an_error(spark):
    encoder = Encoder("m", 4, lengths(1), lengths(2), batch=8)
    with pytest.raises(Exception, match="of dimension 4"):
        spark.createDataFrame([("a",)], "text string").select(encoder.document(F.col("text"))).collect()
