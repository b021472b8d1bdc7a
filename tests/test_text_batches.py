"""Texts reach Python in batches of bounded bytes."""

import random
import re

import pandas as pd
from pyspark.sql import functions as F

from tidemill.operators import text as K
from tidemill.plans import retrieval


def test_long_texts_come_few_at_a_time(spark):
    docs = spark.range(0, 40, 1, 1).select(F.col("id").cast("string").alias("id"), F.lit("t").alias("title"), F.repeat(F.lit("word "), 200_000).alias("body"))
    assert "chunk_id" in K.chunks(docs).columns
    size = F.pandas_udf(lambda x: pd.Series([len(x)] * len(x)), "long")
    assert docs.select(size("body").alias("n")).agg(F.max("n")).first()[0] <= 1 + K.BATCH_BYTES // 1_000_000


def test_heads_are_found_wherever_they_stand(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "b", "aa", "ba"]) for _ in range(rng.choice([0, 2, 3, 9, 30]))) for _ in range(60)] + [None, "A.b AA"]
    asked = [*texts[:25], "a b aa", "b b", "x a b"]
    corpus = spark.createDataFrame(list(enumerate(texts)), "cid int, text string")
    questions = spark.createDataFrame(list(enumerate(asked)), "qid int, text string")
    split = lambda x: re.findall("[a-z0-9]+", (x or "").lower())
    holds = lambda t, h: len(h) == 3 and any(t[i : i + 3] == h for i in range(len(t) - 2))
    want = {(q, c) for q, a in enumerate(asked) for c, x in enumerate(texts) if holds(split(x), split(a)[:3])}
    for most in (100, 4):
        assert {(r.qid, r.cid) for r in K.holding(corpus, questions, 3, most).collect()} == want


def test_expected_documents_write_out_no_runs(spark):
    """Heads are broadcast and looked up by a token; every run of eight tokens was joined to a string and exploded."""
    plan = retrieval._expected(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "array_join" not in plan and "posexplode" in plan and "BroadcastHashJoin" in plan
