"""Exact largest overlaps against a search of all pairs, and what they cost."""

import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import matching as M

SCHEMA_A, SCHEMA_H = "b string, asked array<string>", "b string, held array<string>, least long"


def plain(asked, held, most):
    out = set()
    for b, words in asked:
        found = sorted((-len(set(words) & set(h)), least, h) for c, h, least in held if c == b and set(words) & set(h))
        out |= {(b, tuple(words), tuple(h), -n, least) for n, least, h in found[:most]}
    return out


@pytest.mark.parametrize("words", [4, 12, 60])
def test_largest_overlaps(spark, words):
    rng = random.Random(words)
    word = lambda: f"w{int(rng.random() ** 3 * words)}"  # noqa: E731, few very common
    some = lambda: tuple(sorted({word() for _ in range(rng.randint(1, 6))}))
    asked = sorted({(rng.choice("xy"), some()) for _ in range(60)}) + [("z", ("w1",)), ("x", ("none",))]
    held = [(b, h, i) for i, (b, h) in enumerate(sorted({(rng.choice("xy"), some()) for _ in range(400)}, key=lambda _: rng.random()))]
    got = M.largest_overlaps(spark.createDataFrame(asked, SCHEMA_A), spark.createDataFrame(held, SCHEMA_H), 5)
    assert {(r.b, tuple(r.asked), tuple(r.held), r.overlap, r.least) for r in got.collect()} == plain(asked, held, 5)


def test_common_words_cost_no_pairs(spark, monkeypatch):
    """Titles of one brand with two words that all of them have: the rows that meet grow with the titles, not with their square."""
    met, meet = [], M._meet
    monkeypatch.setattr(M, "_meet", lambda words, sets: met.append(meet(words, sets)) or met[-1])
    sizes = []
    for n in (500, 2000):
        i = F.col("id")
        words = F.array_sort(F.array(F.lit("soap"), F.lit("pack"), F.concat(F.lit("a"), i % (n // 4)), F.concat(F.lit("b"), i % (n // 5)), F.concat(F.lit("c"), i)))
        rows = spark.range(n).select(F.lit("x").alias("b"), words.alias("w"), i)
        asked, held = rows.select("b", F.col("w").alias("asked")), rows.select("b", F.col("w").alias("held"), F.col("id").alias("least"))
        met.clear()
        out = M.largest_overlaps(asked, held, 3)
        assert out.count() == 3 * n
        sizes.append(sum(df.count() for df in met))
    assert sizes[1] < 6 * sizes[0]


def test_no_scan_task_meets_all_parts(spark, monkeypatch, tmp_path):
    """Titles of one small file are dealt by rows, so their tasks don't grow with the table."""
    from tidemill.plans import matching
    from tidemill.sources import folders

    monkeypatch.setattr(folders, "ROWS_A_TASK", 100)
    spark.createDataFrame([(i, f"name {i}", "b", 1, 2.0) for i in range(1000)], "p_partkey long, p_name string, p_brand string, p_size int, p_retailprice double").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    rows = matching.titles(spark, str(tmp_path))
    sizes = [n for n in rows.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect() if n]
    assert sum(sizes) == 1000 and max(sizes) < 250
