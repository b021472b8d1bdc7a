from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import SCHEMA, awkward_rows

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_drop_what_they_should(spark):
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == first.columns, name
        docs = docs.checkpoint()
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[0] < first.count()
    whole = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert {i: r.decoded for i, r in whole.items()} == texts


def test_stages_on_awkward_rows_and_empty_tables(spark, tmp_path):
    """Null, empty, repeated and very long texts, null ids, and columns whose names the stages use themselves."""
    docs = spark.createDataFrame(awkward_rows(), SCHEMA)
    docs = docs.withColumns({c: F.lit(7) for c in ("_d", "_v", "_dropped", "_spans0", "_items0", "component_id", "kept", "score", "n_words", "b")})
    folder = str(tmp_path)
    passage = awkward_rows()[10][1].split(" ")[150:200]
    spark.createDataFrame([(1, " ".join(passage)), (2, None), (None, "x")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, int(i not in (13, 15)), 0) for i in range(1, 17)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        none = stage(spark, docs.limit(0), folder)
        assert none.count() == 0 and none.columns == out.columns, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
            assert out.where("doc_id is null").count() == 1, name
            assert out.where("doc_id = 5 and text is null").count() == 1, name
        else:
            assert out.count() == docs.count() and {r.decoded for r in out.collect()} == {r.text or "" for r in docs.collect()}
    kept = {name: {(r.doc_id, r.text) for r in stage(spark, docs, folder).collect()} for name, stage in corpus_pipeline.STAGES[:-1]}
    before = {(r.doc_id, r.text) for r in docs.collect()}
    assert kept["minhash_dedup"] == {(i, t) for i, t in before if i not in (2, 3, 8)}
    assert {i for i, _ in before - kept["line_dedup"]} == {2, 3, 10} - ({2} if (2, awkward_rows()[1][1]) in kept["line_dedup"] else set())
    assert {i for i, _ in before - kept["decontamination"]} == {11, 12}
