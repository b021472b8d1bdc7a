"""Vector search over cells against all pairs."""

import numpy as np
import pytest

from tidemill.operators import cells as C


def plain(rows, queries, k):
    out = []
    for q, v, wanted in queries:
        if v is None:
            continue
        scored = [(-round(float(np.dot(v, x)), 6), i) for i, x, c in rows if x is not None and (wanted is None or c == wanted)]
        out += [(q, i, -s, r + 1) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("piece", [20_000, 7])
def test_search_equals_all_pairs_and_skips_lists(spark, monkeypatch, piece):
    monkeypatch.setattr(C, "PIECE", piece)
    monkeypatch.setattr(C, "STRIP", 4)
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(8, 6)) * 5
    rows = [(i, (middles[i % 8] + rng.normal(size=6) * 0.1).round(3).tolist(), ["a", "b", None][i % 3]) for i in range(400)]
    rows += [(400 + i, rows[5][1], "a") for i in range(12)] + [(500, None, "a")]  # ties, a null
    queries = [(i, rows[i][1], [None, "a", "b", "none"][i % 4]) for i in range(0, 60)] + [(99, None, None), (100, [0.0] * 6, None)]
    index = C.build_cells(spark.createDataFrame(rows, "vec_id long, vector array<double>, category string"), 16, 20)
    found, met = C.search(index, spark.createDataFrame(queries, "qid long, vector array<double>, category string"), 5)
    assert sorted((r.qid, r.vec_id, r.score, r["rank"]) for r in found.select("qid", "vec_id", "score", "rank").collect()) == plain(rows, queries, 5)
    seen = {r.qid: (r.met, r.lists) for r in met.collect()}
    assert sum(m for m, _ in seen.values()) < 0.6 * sum(n for _, n in seen.values())


def test_search_of_empty_tables(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, vector array<double>")
    asked = rows.withColumnRenamed("vec_id", "qid")
    assert C.search(C.build_cells(rows.limit(0)), asked, 3)[0].count() == 0
    assert C.search(C.build_cells(rows), asked.limit(0), 3)[0].count() == 0
    assert C.search(C.build_cells(rows), asked, 3)[0].count() == 1
