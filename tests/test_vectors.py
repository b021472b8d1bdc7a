"""Vector queries against their SQL on tables made for it."""

import duckdb
import numpy as np
import pytest

from tidemill.plans import registry

QUERIES = ["vector_top_k", "vector_filtered"]


def both(spark, path, name, vectors):
    """A query's rows and those of its SQL over an embeddings table of floats."""
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet/*.parquet'")
    got = registry.queries()[name](spark, str(path)).select("qid", "vec_id", "score", "rank").collect()
    return sorted(map(tuple, got)), sorted(con.execute(f"SELECT qid, vec_id, score, rank FROM ({registry.oracle_sql()[name]})").fetchall())


@pytest.mark.parametrize("name", QUERIES)
def test_lengths_of_float_vectors_are_summed_in_doubles(spark, tmp_path, name):
    got, want = both(spark, tmp_path, name, np.random.default_rng(7).normal(size=(2000, 8)).astype(np.float32))
    assert len(want) == 100 and got == want


@pytest.mark.parametrize("name", QUERIES)
def test_halves_of_the_sixth_place_go_away_from_zero(spark, tmp_path, name):
    """Vectors of 256 signs have lengths of 16, so scores are whole 128ths, exact in any order of summing."""
    got, want = both(spark, tmp_path, name, np.random.default_rng(7).choice([-1.0, 1.0], (300, 256)))
    assert len(want) == 15 and got == want
