"""The registered queries of the subpackage on whole small tables: SQL where there is any, else plain versions."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tests.llm.test_operators import WORD, awkward_rows, plain_counts, plain_passages, reachable, shingles
from tidemill.llm import byte_bpe, queries

SF = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
AWKWARD_URLS = [None, "", "nothing", "http://A.Example.ORG/es/x?y", "https://example.org/en/1/2#z", "http://spam-farm.example.com/", "http://x.casino-win.example.net?u", "ftp://shop.com/fr/", "http://shop.com/de/1", "http://org", "://example.org/es/", "http://notexample.org/es/", "http://q.net/a\nb", "http://a?b://c/d"]


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """Tables of awkward rows with single ids, and of none."""
    made = {}
    for name in ("some", "none"):
        folder = made[name] = str(tmp_path_factory.mktemp(name))
        rows = [r[:5] for r in awkward_rows() if r[0] is not None][:-1]
        tables = {
            "documents": (rows, "doc_id long, text string, lang string, source string, n_chars long"),
            "labels": ([(i, i % 2, (i + 1) % 2) for i in range(1, 17)], "doc_id long, quality int, toxic int"),
            "benchmark": ([(1, rows[10][1][900:1400]), (2, "TWO words"), (3, None), (4, "")], "item_id long, text string"),
            "pages": ([(i, u, "h") for i, u in enumerate(AWKWARD_URLS)], "page_id long, url string, html string"),
        }
        for table, (data, schema) in tables.items():
            spark.createDataFrame(data if name == "some" else [], schema).write.parquet(f"{folder}/{table}.parquet")
    return made


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
@pytest.mark.parametrize("tables", ["sf0.001", "some", "none"])
def test_query_equals_its_sql(spark, awkward, name, tables):
    folder = awkward.get(tables, SF)
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{'/*.parquet' if tables in awkward else ''}'")
    rel = con.execute(queries.oracle_sql()[name])
    columns = [x[0] for x in rel.description]
    got = queries.queries()[name](spark, folder)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, rel.fetchall()))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_on_awkward_and_empty_tables(spark, awkward, name):
    rows = queries.queries()[name](spark, awkward["some"]).collect()
    want = len(AWKWARD_URLS) if name.startswith("op10") else 5 if name.startswith("op2") else 16
    assert len(rows) == want or name.startswith(("op12", "op13"))  # a row a word or phrase
    assert queries.queries()[name](spark, awkward["none"]).count() == 0


def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def by_id(spark, name):
    return {r.doc_id: r for r in queries.queries()[name](spark, SF).collect()}


def test_op1_equals_plain_components(spark):
    sets = {i: shingles(t, 4) for i, t in texts(spark).items()}
    want = reachable(sets)
    got = by_id(spark, "op1_minhash_dedup")
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_op2_equals_plain_passages(spark):
    want = plain_passages({i: WORD.findall(t.translate(UPPER)) for i, t in texts(spark).items()})
    got = by_id(spark, "op2_suffix_dedup")
    inside = lambda spans: {p for s in spans for p in range(s["from"], s["to"])}
    assert {i: (inside(r.spans), inside(r.drops)) for i, r in got.items()} == {i: x for i, x in want.items() if x[0]}


def test_op3_op4_and_op6_follow_their_labels(spark):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    toxic, lang, good = by_id(spark, "op3_toxicity"), by_id(spark, "op4_language_id"), by_id(spark, "op6_quality_classifier")
    assert set(toxic) == set(lang) == set(good) == set(docs)
    for i in docs:
        crc = zlib.crc32(str(i).encode())
        assert toxic[i].held_out == (crc % 5 == 0) and lang[i].held_out == (crc % 4 == 2)
        assert toxic[i].predicted == int(toxic[i].score >= 0.5) and 0 <= toxic[i].score <= 1 and 0 <= lang[i].score <= 1
        assert (lang[i].lang_pred == "und") == (not re.search(r"[^\W\d_]", docs[i].text or ""))
    known = [i for i in docs if docs[i].lang and lang[i].held_out and lang[i].lang_pred != "und"]
    assert np.mean([lang[i].lang_pred == docs[i].lang for i in known]) > 0.9
    assert np.mean([good[i].kept == bool(labels[i].quality) for i in labels if i in docs and labels[i].quality is not None]) > 0.9


def test_op5_counts_equal_plain_ones(spark):
    whole = texts(spark)
    for i, r in by_id(spark, "op5_quality_rules").items():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_counts(whole[i])


def test_op8_equals_the_public_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = byte_bpe.vocabulary(f.read(), public_tokenizers.PATTERN).ranks
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = texts(spark)
    for i, r in by_id(spark, "op8_byte_bpe").items():
        ids = np.array(plain.encode_ordinary(whole[i]), dtype="<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(whole[i].encode()).hexdigest())
