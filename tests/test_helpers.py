"""Parsers, helpers, lake writes and streams on literal rows."""

import datetime as dt
import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.functions import parse as P
from tidemill.functions import scoring as S
from tidemill.operators import corpus as B
from tidemill.operators import evaluate as E
from tidemill.operators import matching as M
from tidemill.operators import ranking as R
from tidemill.operators import reports as O
from tidemill.operators import text as K
from tidemill.operators import train as T
from tidemill.plans import streams
from tidemill.sources import lake as L
from tidemill.streaming import jobs as X


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "title,pack",
    [("Soap Pack of 3", 3), ("Soap 6-Pack", 6), ("12 pk", 12), ("24 ct box", 24), ("100 Count", 100), ("Soap", None), ("Pack of 0, 4 pack", 4), (None, None)],
)
def test_pack_count(spark, title, pack):
    assert one(spark, P.pack_count(F.col("t").cast("string")), t=title) == pack


@pytest.mark.parametrize(
    "title,size",
    [("Oil 16.9 Fl. Oz", (16.9, "fl_oz")), ("5 lbs bag", (5.0, "lb")), ("1 liter", (1.0, "l")), ("2kg", (2.0, "kg")), ("12 ounces", (12.0, "oz")), ("none", (None, None))],
)
def test_size(spark, title, size):
    value, unit = P.size(F.col("t"))
    assert tuple(one(spark, F.struct(value.alias("a"), unit.alias("b")), t=title)) == size


def test_core_title_and_prices(spark):
    assert one(spark, P.core_title(F.col("t"), F.lit("a+b")), t="A+B Soap, 2-pack - 5 oz | bar") == "Soap bar"
    for text, want in [("$1,299.99 (Reg. $1,500)", (1299.99, 1500.0)), ("now $5 then $7", (5.0, 7.0)), ("was 9.50", (None, 9.5)), ("", (None, None))]:
        a, b = P.prices(F.col("t"))
        assert tuple(one(spark, F.struct(a.alias("a"), b.alias("b")), t=text)) == want
    assert one(spark, P.retailer(F.col("t"), ["Club", "Sam's Club", "Cluc"]), t="at sam's club") == "Sam's Club"
    assert one(spark, P.retailer(F.col("t"), ["abcd", "bcde"]), t="abcde") == "abcd"


def test_redaction(spark):
    for text, want in [
        ("url?api_key=abc123&x=1", "url?api_key=***&x=1"),
        ("f(token=token)", "f(token=token)"),
        ("sorted(key=lambda x: 1)", "sorted(key=lambda x: 1)"),
        ("key=key-live-123", "key=***"),
    ]:
        assert one(spark, P.redacted(F.col("t")), t=text) == want
    assert one(spark, P.secret_kind(F.col("t")), t="eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12) == "signed token"


def test_small_parsers(spark):
    assert one(spark, P.invented_ids(F.col("t"), F.array(F.lit("B000000001"))), t="B000000001 and B0ABCDEFGH") == ["B0ABCDEFGH"]
    assert one(spark, P.last_block(F.col("t")), t="## a\n- x\n## b\n- y\n- z") == "b\n- y\n- z"
    assert one(spark, P.bullets(F.col("t")), t="b\n- y\n* z ") == ["y", "z"]
    assert one(spark, P.slug(F.col("t")), t="  Hello, World! ") == "hello-world"
    for entry in ('["a b", "c"]', '{"transcript": [{"text": "a b"}, {"text": "c"}]}', '{"segments": [{"text": "a"}, {"text": "b  c"}]}'):
        assert one(spark, P.transcript_text(F.col("t")), t=entry) == "a b c"
    assert one(spark, P.graded(F.col("t"), [["roi", "profit"], ["never"]]), t="Good ROI") == [True, False]
    assert one(spark, S.restriction_hint(F.col("t"), F.lit(None).cast("string")), t="Jellycat tire spray") == "hazmat/flammable, prohibited"
    assert one(spark, S.is_avoided(F.col("t")), t="Nike-Golf") and not one(spark, S.is_avoided(F.col("t")), t="Nikeish")
    assert one(spark, S.is_friendly(F.col("t")), t="lego duplo") and not one(spark, S.is_friendly(F.col("t")), t="legolas")


def test_ordered_adjustments_clamp_and_round(spark):
    made = F.array(*[F.struct(F.lit("x").alias("name"), F.lit(p).alias("points")) for p in (5.0, 5.0, -15.0)])
    assert one(spark, S.adjusted(F.lit(98.0), made), t=1) == 85.0
    assert one(spark, S.adjusted(F.lit(3.0), made), t=1) == 0.0


def test_sections():
    text = "intro\n# A\none\n## B\ntwo\n# C\n\n## D\nthree"
    got = [(s["headings"], s["body"]) for s in K.split_sections(text)]
    assert got == [([], "intro"), (["A"], "one"), (["A", "B"], "two"), (["C", "D"], "three")]
    assert K.split_sections("plain") == [{"headings": [], "body": "plain"}] and K.split_sections(None) == []


def test_chunks_overlap(spark):
    body = " ".join(f"w{i}" for i in range(1200))
    rows = K.chunks(spark.createDataFrame([("d", "T", body), ("e", "U", "few words"), ("f", "V", "# H\nx y")], "id string, title string, body string")).collect()
    by = {r.chunk_id: r for r in rows}
    assert [by[f"d::{i}"].text.split()[0] for i in range(3)] == ["w0", "w525", "w1050"]
    assert by["d::0"].tokens == 780 and by["e::0"].text == "few words" and by["f::0"].citation == "V > H"


def test_pages_and_feeds(spark):
    block = json.dumps([{"@type": "Product", "name": "A", "brand": {"name": "X"}, "offers": [{"price": "1,299.5"}]}, {"@type": "Thing"}, {"@type": ["Product"], "name": "B", "offers": {"price": "no"}}])
    pages = spark.createDataFrame([(f'<script type="application/ld+json">{block}</script><script type="application/ld+json">bad</script>',), (None,)], "html string")
    assert [[tuple(p) for p in r.p] for r in pages.select(K.page_products("html").alias("p")).collect()] == [[("A", 1299.5, "X")], []]
    rss = "<rss><channel><item><title> T </title><link>u</link></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>E</title><link href="v"/></entry></feed>'
    feeds = spark.createDataFrame([(rss,), (atom,), ("<bad",)], "x string")
    assert [[tuple(i) for i in r.i] for r in feeds.select(K.feed_items("x").alias("i")).collect()] == [[("T", "u")], [("E", "v")], []]


def plain_bm25(texts: list[list[str]], query: list[str]) -> list[float]:
    """Plain scores of a few texts, for tests."""
    n, mean = len(texts), sum(map(len, texts)) / len(texts)
    df = {t: sum(t in x for x in texts) for x in texts for t in x}
    idf = {t: math.log((n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
    floor = K.IDF_FLOOR * sum(idf.values()) / len(idf)
    weigh = lambda t, x: (idf[t] if idf[t] >= 0 else floor) * x.count(t) * (K.K1 + 1) / (x.count(t) + K.K1 * (1 - K.B_LENGTH + K.B_LENGTH * len(x) / mean))
    return [sum(weigh(t, x) for t in query if t in x) for x in texts]


def test_bm25_equals_the_plain_form(spark):
    texts = ["a b a c", "b c d", "a d d e f", "c c c"]
    corpus = spark.createDataFrame(list(enumerate(texts)), "cid int, text string")
    got = {r.cid: r.score for r in K.bm25(corpus, spark.createDataFrame([(1, "a d")], "qid int, text string"), 9).collect()}
    want = plain_bm25([t.split() for t in texts], ["a", "d"])
    assert all(abs(got.get(i, 0.0) - w) < 1e-4 for i, w in enumerate(want))


def test_diverse_answers(spark):
    s = "the seller offers rose quickly in every warm month"
    rows = [(1, "c1", s, 0.9, 1), (1, "c1", s + " again", 0.8, 2), (1, "c2", "prices fell below the cost of goods", 0.7, 3), (1, "c1", "returns were rare last winter season", 0.6, 4), (1, "c1", "storage charges apply after half years", 0.5, 5)]
    frame = spark.createDataFrame(rows, "qid int, citation string, sentence string, score double, cid int")
    got = K.diverse(frame).orderBy("point").collect()
    assert [r.score for r in got] == [0.9, 0.7, 0.6]


def test_match_confidence(spark):
    def conf(by_code, brand, pack, size, sim, sane):
        b = lambda v: F.lit(v).cast("boolean")
        return one(spark, M.confidence(b(by_code), b(brand), b(pack), b(size), F.lit(sim), b(sane)), t=1)

    assert conf(True, True, True, None, 0.2, True) == 0.95
    assert conf(False, True, True, True, 1.0, True) == 0.85
    assert conf(True, True, False, None, 1.0, True) == 0.1
    assert conf(False, None, True, None, 0.5, False) == pytest.approx(0.7 * (0.275 + 0.45 * 0.62), abs=2e-3)


def test_source_health_is_terminal(spark):
    events = [("u", 1, 403, True), ("u", 2, 200, True), ("u", 3, 403, True), ("u", 4, 403, True), ("u", 5, 200, True), ("v", 1, 403, False), ("v", 2, 403, False)]
    frame = spark.createDataFrame(events, "url string, seq long, code int, fallback boolean")
    assert {(r.url, r.refused, r.state) for r in M.source_health(frame).collect()} == {("u", 0, "retired"), ("v", 2, "failing")}


def test_health_stream_equals_the_batch(spark, tmp_path):
    rows = [(f"u{i % 5}", i, [403, 200, 500][i * 7 % 3], i % 2 == 0) for i in range(60)]
    frame = spark.createDataFrame(rows, "url string, seq long, code int, fallback boolean")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    got = {tuple(r) for r in X.run_to_files(spark, X.health_states(stream), "health", "update").collect()}
    assert got == {tuple(r) for r in M.source_health(frame).collect()}


def raw(values, start=0):
    return [("s", "e", "p", start + i, v, None) for i, v in enumerate(values)]


def lake_rows(spark, rows):
    frame = spark.createDataFrame(rows, "source string, entity_id string, endpoint string, fetched_at long, payload string, content_hash string")
    return frame.withColumn("content_hash", F.coalesce("content_hash", F.sha2("payload", 256)))


def test_repeats_are_dropped_but_returns_kept(spark):
    kept = L.suppress_repeats(lake_rows(spark, raw("AABBA")))
    assert sorted(r.fetched_at for r in kept.collect()) == [0, 2, 4]
    assert L.suppress_repeats(lake_rows(spark, raw("AB", 9)), L.manifest_of(kept)).count() == 1


def test_inbox_stream_drains_once(spark, tmp_path):
    good = lake_rows(spark, raw("AAB"))
    good.unionByName(lake_rows(spark, [("s", "e", "p", 9, "C", "wrong")])).coalesce(1).write.parquet(str(tmp_path / "in"))
    paths = [str(tmp_path / x) for x in ("lake", "bad", "state")]
    for _ in range(2):  # a second run finds nothing new
        stream = spark.readStream.schema(good.schema).parquet(str(tmp_path / "in"))
        X.drain_inbox(stream, *paths).awaitTermination()
    assert spark.read.parquet(paths[0]).count() == 2 and spark.read.parquet(paths[1]).count() == 1


def test_upserts_are_idempotent(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "k int, v string, t int")
    once = L.upsert(old, new, ["k"], "t")
    assert {tuple(r) for r in once.collect()} == {(1, "a", 1), (2, "c", 2), (3, "d", 2)}
    assert once.exceptAll(L.upsert(once, new, ["k"], "t")).count() == 0
    assert {tuple(r) for r in L.insert_new(old, new, ["k"], "t").collect()} == {(1, "a", 1), (2, "b", 1), (3, "d", 2)}
    stream_in = spark.createDataFrame([(1, "x", dt.date(2024, 1, 2)), (1, "y", dt.date(2024, 1, 5))], "k int, v string, seen date")
    stream_in.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(stream_in.schema).parquet(str(tmp_path / "in"))
    X.upsert_sightings(stream, str(tmp_path / "out"), ["k"], str(tmp_path / "state")).awaitTermination()
    row = spark.read.parquet(str(tmp_path / "out" / "version=0")).first()
    assert (row.first_seen, row.last_seen, row.v) == (dt.date(2024, 1, 2), dt.date(2024, 1, 5), "y")


def test_lake_round_trip(spark, tmp_path):
    rows = lake_rows(spark, raw("AB")).withColumn("fetched_at", F.timestamp_seconds(F.col("fetched_at") + 1_700_000_000))
    L.write_lake(rows, str(tmp_path / "lake"))
    back = L.read_lake(spark, str(tmp_path / "lake"), "s", "2023-11-14")
    assert back.count() == 2 and "date" in back.columns
    (tmp_path / "ledger.jsonl").write_text('{"id": "a", "kind": "k"}\n\nbad\n{"id": "b", "kind": "k"}\n')
    assert L.read_ledger(spark, str(tmp_path / "ledger.jsonl"), "id string, kind string").count() == 2
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("---\ncategory: special\n---\n# Head\ntext")
    (tmp_path / "docs" / "b.txt").write_text("plain")
    found = {r.category for r in L.read_corpus(spark, str(tmp_path / "docs"), [("/docs/", "guides", "note")]).collect()}
    assert found == {"special", "guides"}


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "k int, v string")
    same, other = a.orderBy(F.desc("k")), a.distinct()
    first = B.fingerprint(a, ["k", "v"]).first()
    assert first == B.fingerprint(same, ["k", "v"]).first() and first.content != B.fingerprint(other, ["k", "v"]).first().content


def test_table_drift_and_memory(spark):
    a, b = spark.range(5), spark.range(1, 7)
    assert tuple(L.table_drift(a, b).first()) == (1, 2)
    rows = spark.createDataFrame([(True, True, True)] * 15 + [(True, False, False)], "disagrees boolean, memory_used boolean, hit boolean")
    assert {(r.memory_used, r.enough) for r in O.memory_split(rows).collect()} == {(True, True), (False, False)}


def test_stored_responses(spark):
    doc = json.dumps({"sku": "1", "upc": "2", "name": "N", "salePrice": 7.5, "regularPrice": 10, "url": "u"})
    got = one(spark, P.api_deal(F.col("t"), P.DEAL_FIELDS["store"]), t=doc)
    assert (got.sku, got.price_current, got.price_original, got.discount_pct) == ("1", 7.5, 10.0, 25.0)
    points = one(spark, P.history_points(F.array(F.lit(5), F.lit(-1), F.lit(7)), F.array(F.lit(1704240000), F.lit(1704067200), F.lit(1))), t=1)
    assert [(p.day.isoformat(), p.value) for p in points] == [("2024-01-01", None), ("2024-01-03", 5.0)]


def test_common_words_find_candidates(spark):
    """Words that thousands of a brand's items have still give the best items, as a plain search does."""
    names = ["red box", "red box big", "box", "big red", "other thing"]
    deal = [(1, None, ("b", "red box")), (2, None, ("B", "big box red new")), (3, None, ("", "red box")), (4, "u7", ("b", "red")), (5, None, ("b", "red box"))]
    item = [(i, [f"u{i}"], ("B" if i % 2 else "c", names[i // 2 % 5])) for i in range(9000)]
    deals = spark.createDataFrame(deal, "deal_id long, upc string, attrs struct<brand:string,core_title:string>")
    items = spark.createDataFrame(item, "item long, upcs array<string>, item_attrs struct<brand:string,core_title:string>")
    want = {(4, 7, True, 99)}
    for d, _, (brand, title) in [x for x in deal if x[0] != 4]:
        overlap = [(-len(set(title.split()) & set(t.split())), i) for i, _, (b, t) in item if not brand or b.lower() == brand.lower()]
        want |= {(d, i, False, -n) for n, i in sorted(x for x in overlap if x[0])[:5]}
    assert {tuple(r) for r in M.candidates(deals, items).select("deal_id", "item", "by_code", "overlap").collect()} == want


def test_streams_leave_their_rows_in_files(spark, tmp_path):
    """Rows of all batches come from files that executors wrote, not from the driver."""
    for k in range(3):
        spark.range(k * 5, k * 5 + 5, 1, 1).selectExpr("id", "timestamp_seconds(id * 86400) AS at", "id % 2 AS kind").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, at timestamp, kind long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = X.run_to_files(spark, stream, "files_all")
    assert sorted(r.id for r in rows.collect()) == list(range(15)) and len(rows.inputFiles()) >= 3
    counts = X.run_to_files(spark, X.windowed_counts(stream, "at", "kind"), "files_counts", "complete")
    assert counts.count() == 15 and counts.agg(F.sum("n")).first()[0] == 15
    assert X.run_to_files(spark, X.distinct_sightings(stream, ["kind"], "at", "60 days"), "files_first").count() == 2
    for name in ("stream_first_sightings", "stream_health"):
        assert streams.QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles(), name


def test_bootstrap_makes_500_replicates(spark):
    rows = spark.range(400).selectExpr("id % 40 AS c", "id % 7 / 7 AS a", "id % 11 / 11 AS b", "id % 3 = 0 AS y")
    got = E.bootstrap_gap(rows, "a", "b", "y", "c").first()
    assert got.resamples == 500 and got.low < got.high


def test_caps_keep_rows_without_a_group_and_fill_the_limit(spark):
    rows = [(i, [None, "a", "b"][min(i % 7, 2)], i % 5) for i in range(3000)]
    frame = spark.createDataFrame(rows, "id long, g string, t int")
    hashed = lambda r: (int(hashlib.sha256(f"{r[2]}|{r[0]}".encode()).hexdigest()[:8], 16), r[2], r[0])
    for limit in (1, 7, 400, 430, 5000):
        got = B.cap_groups(frame, "g", limit, ["t", "id"])
        want = [r for g in (None, "a", "b") for r in sorted((r for r in rows if r[1] == g), key=hashed)[:limit]]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_split_by_time_keeps_rows_without_a_day(spark):
    day = lambda k: None if k % 3 == 0 else dt.date(2024, 1, 1 + k % 4)
    got = B.split_by_time(spark.createDataFrame([(k, day(k)) for k in range(30)], "id long, day date"), "day", "id").collect()
    dated = sorted((r.day, r.id) for r in got if r.day)
    assert len(got) == 30 and {r.id for r in got if r.fold == "validation"} == {i for _, i in dated[-6:]}
    assert B.split_by_time(spark.createDataFrame([(1, None)], "id long, day date"), "day", "id").first().fold == "train"


def test_positions_and_running_sums_by_group(spark):
    rows = [(i, [None, "a"][i % 2], float((i * 37) % 101)) for i in range(500)]
    frame = spark.createDataFrame(rows, "id long, g string, x double")
    got = {r.id: r.p for r in R.positions(frame, "id", ["g"], "p").collect()}
    assert got == {i: 1 + sum(j < i for j, g, _ in rows if g == own) for i, own, _ in rows}
    sums = R.running(frame.groupBy("g", "x").agg(F.count("*").alias("n")), "x", ["n"], ["g"]).collect()
    assert all(r.n_before == sum(x < r.x for _, g, x in rows if g == r.g) for r in sums)


def test_exact_quantiles(spark):
    values = [float(x) for x in np.random.default_rng(1).integers(0, 40, 333)] + [None]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    assert np.allclose(E.exact_quantiles(frame, "v", 10), np.quantile(values[:-1], [i / 10 for i in range(11)]))
    assert E.exact_quantiles(frame.limit(0), "v", 10) == [] and E.psi(frame.limit(0), frame, ["v"]).count() == 0


def test_answer_rules(spark):
    sentence = "The offers rose quickly in every warm month of the year"
    raw = f"{sentence}. - A list item about offers needs no full stop here at all\n- Offers that end on a word which should go on to\nOffers cost $5 in every warm month of the year. {sentence} of the"
    rows = K.sentences(spark.createDataFrame([(1, "which offers", "c", "src", 0.5, raw)], "qid int, question string, cid string, citation string, relevance double, text string")).collect()
    assert {r.sentence[:10] for r in rows} == {"The offers", "A list ite", "Offers cos"} and all(r.score > 0.6 for r in rows)
    listed = K.sentences(spark.createDataFrame([(1, "which offers", "c", "src", 0.5, "- A list item about offers needs no full stop here at all")], "qid int, question string, cid string, citation string, relevance double, text string")).collect()
    assert [r.sentence[:6] for r in listed] == ["A list"]
    ranked = spark.createDataFrame([(1, 0.8, 0.5), (2, 0.6, 0.1), (3, 0.6, 0.1)], "qid int, similarity double, coverage double")
    points = spark.createDataFrame([(2, "x")], "qid int, sentence string")
    assert {r.qid: r.strength for r in K.answer_strength(ranked, points).collect()} == {1: "strong", 2: "moderate", 3: "limited"}


def test_webhooks_are_masked(spark):
    hook = "https://discord.com/api/webhooks/123/abc_D-e"
    assert one(spark, P.redacted(F.col("t")), t=f"see {hook} now") == "see *** now" and one(spark, P.secret_kind(F.col("t")), t=hook.replace(".com", "app.com")) == "webhook"
    assert one(spark, P.secret_kind(F.col("t")), t="https://other.com/api/webhooks/123/abc") is None


def test_best_vectors_in_blocks_and_batches(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = rng.integers(-3, 4, (500, 4)).astype(float)
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "vec_id long, vector array<double>").repartition(3)
    queries = frame.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "qid")
    want = {(q, i, k + 1) for q in range(0, 500, 50) for k, i in enumerate(np.lexsort((np.arange(500), -(v @ v[q])))[:6])}
    for block, cells in ((K.BLOCK_BYTES, K.SCORE_CELLS), (96, 100)):
        monkeypatch.setattr(K, "BLOCK_BYTES", block)
        monkeypatch.setattr(K, "SCORE_CELLS", cells)
        assert {(r.qid, r.vec_id, r["rank"]) for r in K.vector_top_k(frame, queries, 6).collect()} == want
    assert K.vector_top_k(frame, queries.limit(0), 6).count() == 0


def test_quantile_line_and_trees_learn(spark):
    rng = np.random.default_rng(3)
    rows = [(float(x), float(2 * x + e), bool(x > 0.5)) for x, e in zip(rng.random(600), rng.normal(0, 0.1, 600), strict=True)]
    frame = spark.createDataFrame(rows, "x double, y double, good boolean")
    model = T.fit_classifier(frame, ["x"], "good", trees=True)
    held = E.auc(T.probabilities(model, frame, ["x"]), "probability", "good", []).first()
    assert held.auc > 0.95
    *slope, constant = T.quantile_line(frame, ["x"], "y", 0.2)
    assert abs(np.mean([y < slope[0] * x + constant for x, y, _ in rows]) - 0.2) < 0.08 and abs(slope[0] - 2) < 0.3
