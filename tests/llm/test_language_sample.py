"""Copies in the language sample."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.llm import lang_id


def test_copies_take_one_place_of_the_sample(spark):
    texts = [f"text number {'abcdefghij'[i % 10]} {'klmnopqrst'[i // 10]}" for i in range(40)]
    once = spark.createDataFrame([(t, "xx") for t in texts], "text string, lang string")
    first = once.orderBy(F.xxhash64("text")).first()["text"]
    many = once.union(spark.createDataFrame([(first, "xx")] * 50, once.schema))
    assert lang_id.fit(many, sample_rows=20).dictionaries == lang_id.fit(once, sample_rows=20).dictionaries
    assert sum(d.count(b"text") for d in lang_id.fit(many, sample_rows=20).dictionaries["xx"]) == 20
