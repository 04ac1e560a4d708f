"""Retrieval queries leave rows, n-grams and blocks of queries to the tasks and the shared folder."""

import pytest
from pyspark import SparkContext

from kalamos.plans import catalogue

QUERIES = ["tfidf_1nn", "retrieval_variants", "tfidf_self_nn", "tfidf_within_words", "retrieval_baseline_scores"]


@pytest.mark.parametrize("name", QUERIES)
def test_nothing_that_grows_goes_through_the_driver(spark, monkeypatch, name):
    def refuse(*_, **__):
        raise AssertionError("rows on the driver")

    monkeypatch.setattr(SparkContext, "broadcast", refuse)
    monkeypatch.setattr(type(spark.range(1)), "toPandas", refuse)
    assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").count()
