"""Queries over chunks, retrieval, trends and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.rounding import sql_rounded as r
from tidemill.operators import text as K
from tidemill.operators import trends as T
from tidemill.operators.cells import build_cells, search
from tidemill.plans.tables import HISTORY_SQL, ITEMS_SQL, history, items, read
from tidemill.sources.folders import saved


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").where("text is not null")
    return d.select(F.col("doc_id").cast("string").alias("id"), F.concat_ws(" ", "lang", "source").alias("title"), F.col("text").alias("body"))


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.chunks(corpus(spark, sf_dir), with_sections=False)
    return rows.select("chunk_id", "document_id", "chunk_index", "tokens", "citation", F.sha2(F.regexp_replace(F.trim("text"), r"\s+", " "), 256).alias("content"))


def chunk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.chunks(corpus(spark, sf_dir))
    return rows.groupBy(F.col("citation").alias("category")).agg(F.countDistinct("document_id").alias("documents"), F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"))


def document_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("---\ntitle: T"), F.col("doc_id").cast("string"), F.lit("\n---\n"), F.col("text"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("# H"), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text"))).otherwise(F.col("text"))
    files = d.select(F.concat(F.lit("/data/"), F.col("source"), F.lit("/f"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), text.alias("text"))
    return K.documents(files).select("id", "title", "content_hash", F.length("body").alias("n"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").where("text is not null").select(F.col("item_id").alias("qid"), "text")


def bm25_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("cid"), "text")
    return K.bm25(docs, questions(spark, sf_dir), 5)


def question_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of the questions, each with a word of a concept, and what goes with it."""
    asked = F.concat_ws(" ", "text", F.element_at(F.array(*map(F.lit, K.CONCEPTS)), (F.length("text") % len(K.CONCEPTS) + 1).cast("int")))
    return questions(spark, sf_dir).select("qid", F.array_join(F.array_sort(K.expanded(K.terms(asked))), " ").alias("terms"))


def _expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a question's first eight words, with their language."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("cid"), "text", F.col("lang").alias("category"))
    return K.holding(docs, questions(spark, sf_dir), 8).select("qid", "cid", "category").distinct()


def retrieval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and reciprocal rank of BM25, where documents that hold a question's first eight words are expected."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("cid"), "text")
    expected = _expected(spark, sf_dir).select("qid", "cid", F.lit("all").alias("category"))
    return K.retrieval_quality(K.bm25(docs, questions(spark, sf_dir), 10), expected, 5, ["category"])


def retrieval_by_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 beside its reranked results, by language and in all."""
    found = saved(_found(spark, sf_dir))
    ranked = found.select(F.lit("bm25").alias("system"), "qid", "cid", "rank").unionByName(K.rerank(found, 3, BONUSES).select(F.lit("reranked").alias("system"), "qid", "cid", "rank"))
    return K.compare_systems(ranked, _expected(spark, sf_dir), ["bm25", "reranked"], 2)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings").select("vec_id", K.normalised(F.col("embedding")).alias("vector"))
    return K.vector_top_k(v, v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "vector"), 5).select("qid", "vec_id", F.col("score").alias("score"), "rank")


def vector_label_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    found = vectors(spark, sf_dir).where("qid <> vec_id").join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("qid"), F.col("label").alias("own")), "qid")
    return found.groupBy("own").agg(F.count("*").alias("n"), F.count_if(F.col("own") == F.col("label")).alias("same"))


def _by_cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every hundredth vector as a query; every second of them asks for vectors of its own label only."""
    v = read(spark, sf_dir, "embeddings").select("vec_id", K.normalised(F.col("embedding")).alias("vector"), F.col("label").cast("string").alias("category"))
    own = F.when(F.col("vec_id") % 200 == 0, F.col("category")).alias("category")
    return search(build_cells(v), v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "vector", own), 5)


def vector_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_cells(spark, sf_dir)[0].select("qid", "vec_id", "score", "rank")


def vector_lists_met(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lists of vectors the queries met, and how many there are."""
    met = _by_cells(spark, sf_dir)[1]
    return met.groupBy((F.col("qid") % 200 == 0).alias("filtered")).agg(F.count("*").alias("queries"), F.sum("met").alias("met"), F.sum("lists").alias("lists"))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("cid"), "text", F.concat_ws("/", "source", "lang").alias("citation"))
    asked = questions(spark, sf_dir).withColumnRenamed("text", "question")
    return bm25_ranks(spark, sf_dir).join(docs, "cid").join(asked, "qid").withColumn("similarity", F.col("score") / 100)


BONUSES = [("src1/", 0.18), ("src2", 0.07), ("/de", -0.08)]


def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.rerank(_found(spark, sf_dir), 3, BONUSES).select("qid", "cid", "coverage", "relevance", "rank")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.diverse(K.sentences(K.rerank(_found(spark, sf_dir), 3, BONUSES)))


def answer_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each question is answered, counted."""
    ranked = K.rerank(_found(spark, sf_dir), 3, BONUSES)
    return K.answer_strength(ranked, K.diverse(K.sentences(ranked))).groupBy("strength").agg(F.count("*").alias("n"), F.sum("points").alias("points"))


def gated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", F.col("source").alias("citation"), F.array(F.lit("the"), F.lit("and")).alias("required"), F.array(F.lit("src1")).alias("cites"))
    return K.answer_gate(rows).groupBy("passed").agg(F.count("*").alias("n"))


def embed_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.sha2("text", 256).alias("content_hash"))
    stored = rows.where("chunk_id % 3 > 0").select("chunk_id", F.when(F.col("chunk_id") % 7 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"))
    return K.to_embed(rows, stored)


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    week = F.to_date(F.date_trunc("week", "o_orderdate"))
    return read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("term"), week.alias("week_start")).agg(F.count("*").cast("double").alias("interest"))


def trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("term"), F.to_date("o_orderdate").alias("as_of"))
    return T.trend_as_of(weekly(spark, sf_dir), probes)


def trend_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("category"), F.to_date("o_orderdate").alias("as_of"), F.lit(-1.0).alias("ratio"))
    out = T.attach(rows, trends(spark, sf_dir), "category", "trend")
    filled = T.backfill(rows, out.select("o_orderkey", F.col("trend_ratio").alias("ratio")), ["o_orderkey"], ["ratio"])
    return filled.join(out.select("o_orderkey", "trend_slope", "trend_stale"), "o_orderkey").select("o_orderkey", "ratio", "trend_slope", "trend_stale")


def snapshot_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = history(spark, sf_dir).select("item", "day", F.col("sales_rank").alias("rank"), "price", (F.col("price") - F.col("offers")).alias("buybox"), F.col("sales_rank").alias("reviews"), "offers")
    return T.snapshot_features(daily, F.lit("1998-06-30").cast("date"))


def category_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).join(history(spark, sf_dir).groupBy("item").agg(F.max("sales_rank").alias("rank")), "item")
    return T.category_percentile(rows, "category", "rank").select("item", "category", "percentile")


def listing_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("upc"), F.col("p_retailprice").alias("price"))
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("upc"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    return T.listing_comparison(p, lines).select("upc", "listings", "ratio")


def storefronts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("seller"), F.date_trunc("month", "l_shipdate").cast("date").alias("day"), F.col("l_partkey").alias("item"))
    return T.storefront(rows, 5).select("seller", "day", "n_items", F.array_join("items", ",").alias("items"))


QUERIES = {
    "document_table": document_table, "chunk_rows": chunk_rows, "chunk_totals": chunk_totals, "bm25_ranks": bm25_ranks, "question_terms": question_terms,
    "retrieval_quality": retrieval_quality, "retrieval_by_system": retrieval_by_system, "vector_top_k": vectors, "vector_filtered": vector_filtered, "vector_lists_met": vector_lists_met, "vector_label_recall": vector_label_recall, "reranked": reranked, "answers": answers,
    "answer_strengths": answer_strengths, "gated_answers": gated_answers, "embed_backlog": embed_backlog, "trends": trends, "trend_attached": trend_attached, "snapshot_features": snapshot_features,
    "category_percentiles": category_percentiles, "listing_comparisons": listing_comparisons, "storefronts": storefronts,
}
_WORDS = "list_filter(regexp_split_to_array(trim(text, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)), '\\s+'), lambda w: w <> '')"
_TOKENS = "regexp_extract_all(lower(text), '([a-z0-9]+)', 1)"
_BM25 = f"""tok AS (SELECT doc_id AS cid, len(t) AS size, unnest(t) AS token FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)),
  tf AS (SELECT token, cid, count(*) AS tf, any_value(size) AS size FROM tok GROUP BY 1, 2), st AS (SELECT count(*) AS n, avg(len({_TOKENS})) AS mean FROM documents),
  df AS (SELECT token, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, st GROUP BY token, n), fl AS (SELECT 0.25 * avg(idf) AS f FROM df),
  q AS (SELECT item_id AS qid, unnest({_TOKENS}) AS token FROM benchmark),
  sc AS (SELECT qid, cid, {r("sum(CASE WHEN idf < 0 THEN f ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean)))", 5)} AS score FROM q JOIN tf USING (token) JOIN df USING (token), fl, st GROUP BY 1, 2),
  rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) AS rank FROM sc)"""
_STOP = "['" + "', '".join(K.STOPWORDS) + "']"
_TERMS = lambda c: f"list_filter(list_distinct(regexp_extract_all(lower({c}), '([a-z0-9]+)', 1)), lambda x: length(x) > 2 AND NOT list_contains({_STOP}, x))"
_VEC = f"""v AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y)))) AS e FROM embeddings),
  s AS (SELECT q.vec_id AS qid, c.vec_id, c.label, q.label AS own, CAST(round(CAST(list_inner_product(q.e, c.e) AS DOUBLE), 6) AS DOUBLE) AS score FROM v q, v c WHERE q.vec_id % 100 = 0),
  k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s)"""
_TREND = f"""wk AS (SELECT o_orderpriority AS term, CAST(date_trunc('week', o_orderdate) AS DATE) AS d, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY 1, 2),
  pr AS (SELECT DISTINCT o_orderpriority AS term, CAST(o_orderdate AS DATE) AS as_of FROM orders),
  j AS (SELECT p.term, p.as_of, w.d, w.v, max(w.d) OVER (PARTITION BY p.term, p.as_of) AS ld, row_number() OVER (PARTITION BY p.term, p.as_of ORDER BY w.d DESC) AS rn FROM pr p JOIN wk w ON w.term = p.term AND w.d + 7 <= p.as_of),
  g AS (SELECT term, as_of, any_value(ld) AS ld, max(v) FILTER (WHERE rn = 1) AS lv, avg(v) FILTER (WHERE ld - d <= 90) AS a90, max(v) FILTER (WHERE rn = 4) AS v4, max(v) FILTER (WHERE rn = 3) AS v3, max(v) FILTER (WHERE rn = 2) AS v2, count(*) AS n,
    count(*) FILTER (WHERE week(d) = week(ld) AND year(d) <> year(ld)) AS m, avg(v) FILTER (WHERE week(d) = week(ld) AND year(d) <> year(ld)) AS mu, stddev_pop(v) FILTER (WHERE week(d) = week(ld) AND year(d) <> year(ld)) AS sd FROM j GROUP BY 1, 2),
  tr AS (SELECT p.term, p.as_of, {r("lv / a90", 3)} AS ratio, {r("CASE WHEN n >= 4 THEN (lv - v4) / 3 WHEN n = 3 THEN (lv - v3) / 2 WHEN n = 2 THEN lv - v2 END", 3)} AS slope,
    {r("CASE WHEN m >= 2 THEN CASE WHEN sd > 1e-5 THEN (lv - mu) / sd ELSE 0 END END", 3)} AS seasonal_z, {r("lv / a90", 3)} > 2.0 AS spike, coalesce(p.as_of - ld > 14, true) AS stale FROM pr p LEFT JOIN g USING (term, as_of))"""
SQL = {
    "document_table": """WITH f AS (SELECT '/data/' || source || '/f' || doc_id || '.md' AS path, doc_id, text AS t, CASE doc_id % 3 WHEN 0 THEN '---' || chr(10) || 'title: T' || doc_id || chr(10) || '---' || chr(10) || text WHEN 1 THEN '# H' || doc_id || chr(10) || text ELSE text END AS text FROM documents)
      SELECT 'doc_' || substr(sha256(path), 1, 10) AS id, CASE doc_id % 3 WHEN 0 THEN 'T' || doc_id WHEN 1 THEN 'H' || doc_id ELSE 'f' || doc_id END AS title, substr(sha256(text), 1, 16) AS content_hash, CAST(CASE WHEN doc_id % 3 = 0 THEN 1 + length(t) ELSE length(text) END AS INTEGER) AS n
      FROM f WHERE trim(CASE WHEN doc_id % 3 = 0 THEN chr(10) || t ELSE text END) <> ''""",
    "chunk_rows": f"""WITH w AS (SELECT doc_id, lang, source, text, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
      c AS (SELECT doc_id, lang, source, w, unnest(range(0, CASE WHEN len(w) <= 600 THEN least(len(w), 1) ELSE len(w) END, 525)) AS i FROM w)
      SELECT doc_id || '::' || (i // 525) AS chunk_id, CAST(doc_id AS VARCHAR) AS document_id, CAST(i // 525 AS INTEGER) AS chunk_index, CAST(greatest(1, round(CAST(len(w[i + 1:i + 600]) * 1.3 AS DECIMAL(18,6)), 0)) AS INTEGER) AS tokens,
        lang || ' ' || source AS citation, sha256(array_to_string(w[i + 1:i + 600], ' ')) AS content FROM c""",
    "chunk_totals": f"""WITH w AS (SELECT doc_id, lang || ' ' || source AS category, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
      c AS (SELECT doc_id, category, w, unnest(range(0, CASE WHEN len(w) <= 600 THEN least(len(w), 1) ELSE len(w) END, 525)) AS i FROM w)
      SELECT category, count(DISTINCT doc_id) AS documents, count(*) AS chunks, CAST(sum(greatest(1, round(CAST(len(w[i + 1:i + 600]) * 1.3 AS DECIMAL(18,6)), 0))) AS BIGINT) AS tokens FROM c GROUP BY 1""",
    "bm25_ranks": f"WITH {_BM25} SELECT qid, cid, score, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 5",
    "question_terms": f"""WITH q AS (SELECT item_id AS qid, text || ' ' || ([{", ".join(f"'{c}'" for c in K.CONCEPTS)}])[length(text) % {len(K.CONCEPTS)} + 1] AS x FROM benchmark), t AS (SELECT qid, {_TERMS("x")} AS t FROM q)
      SELECT qid, array_to_string(list_sort(list_distinct(flatten([t, {", ".join(f"CASE WHEN list_contains(t, '{c}') THEN {more} ELSE [] END" for c, more in K.CONCEPTS.items())}]))), ' ') AS terms FROM t""",
    "retrieval_quality": f"""WITH {_BM25}, w AS (SELECT doc_id AS cid, {_TOKENS} AS t FROM documents), h AS (SELECT cid, t, unnest(range(1, len(t) - 6)) AS i FROM w),
      e AS (SELECT DISTINCT qid, cid FROM (SELECT item_id AS qid, array_to_string(({_TOKENS})[1:8], ' ') AS head FROM benchmark) JOIN h ON head = array_to_string(t[i:i + 7], ' ')),
      b AS (SELECT e.qid, min(rank) FILTER (WHERE rank <= 10) AS rank FROM e LEFT JOIN rk USING (qid, cid) GROUP BY 1)
      SELECT 'all' AS category, count(*) AS n, {r("avg(CASE WHEN rank <= 5 THEN 1 ELSE 0 END)", 4)} AS recall, {r("avg(coalesce(1 / rank, 0))", 4)} AS mrr FROM b""",
    "vector_top_k": f"WITH {_VEC} SELECT qid, vec_id, score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5",
    "vector_filtered": f"""WITH {_VEC.replace("WHERE q.vec_id % 100 = 0", "WHERE q.vec_id % 100 = 0 AND (q.vec_id % 200 <> 0 OR q.label = c.label)")}
      SELECT qid, vec_id, score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5""",
    "vector_label_recall": f"WITH {_VEC} SELECT own, count(*) AS n, count(*) FILTER (WHERE own = label) AS same FROM k WHERE rank <= 5 AND qid <> vec_id GROUP BY 1",
    "reranked": rf"""WITH {_BM25}, f AS (SELECT qid, cid, score / 100 AS similarity, d.text AS text, source || '/' || lang AS citation, b.text AS question FROM rk JOIN documents d ON d.doc_id = cid JOIN benchmark b ON b.item_id = qid WHERE rank <= 5),
      p AS (SELECT *, substr(regexp_replace(lower(text), '\W+', '', 'g'), 1, 260) AS fp FROM f), fq AS (SELECT *, row_number() OVER (PARTITION BY qid, fp ORDER BY similarity DESC, cid) AS rn FROM p WHERE fp <> ''),
      t AS (SELECT *, {_TERMS("question")} AS a, {_TERMS("text")} AS b FROM fq WHERE rn = 1), c AS (SELECT *, {r("len(list_intersect(a, b)) / greatest(1, least(len(a), 8))", 4)} AS coverage FROM t),
      z AS (SELECT *, {r("similarity + coverage * 0.16 + CASE WHEN contains(citation, 'src1/') THEN 0.18 WHEN contains(citation, 'src2') THEN 0.07 WHEN contains(citation, '/de') THEN -0.08 ELSE 0.02 END", 4)} AS relevance FROM c),
      k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY relevance DESC, cid) AS k FROM z) SELECT qid, cid, coverage, relevance, CAST(k AS INTEGER) AS rank FROM k WHERE k <= 3""",
    "gated_answers": "SELECT contains(lower(text), 'the') AND contains(lower(text), 'and') AND contains(lower(source), 'src1') AS passed, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "embed_backlog": "SELECT doc_id AS chunk_id, sha256(text) AS content_hash FROM documents WHERE doc_id % 3 = 0 OR doc_id % 7 = 0",
    "trends": f"WITH {_TREND} SELECT * FROM tr",
    "trend_attached": f"""WITH {_TREND} SELECT o_orderkey, coalesce(ratio, -1) AS ratio, slope AS trend_slope, coalesce(stale, true) AS trend_stale FROM orders LEFT JOIN tr ON term = o_orderpriority AND as_of = CAST(o_orderdate AS DATE)""",
    "snapshot_features": f"""WITH {HISTORY_SQL}, d AS (SELECT *, price - offers AS buybox FROM history WHERE day BETWEEN DATE '1998-05-31' AND DATE '1998-06-30')
      SELECT item, {r("avg(sales_rank)", 3)} AS rank_mean, {r("stddev_samp(sales_rank)", 3)} AS rank_std, {r("regr_slope(sales_rank, day - DATE '1970-01-01')", 4)} AS rank_slope, {r("greatest(0, 1 - stddev_samp(price) / nullif(avg(price), 0))", 4)} AS price_resilience,
        arg_max(sales_rank, day) - arg_min(sales_rank, day) AS review_velocity, arg_max(offers, day) - arg_min(offers, day) AS offer_acceleration, {r("arg_max(struct_pack(v := price), day).v - arg_max(struct_pack(v := buybox), day).v", 2)} AS buybox_gap FROM d GROUP BY 1""",
    "category_percentiles": f"WITH {HISTORY_SQL}, {ITEMS_SQL}, m AS (SELECT item, category, max(sales_rank) AS rank FROM items JOIN history USING (item) GROUP BY 1, 2) SELECT item, category, {r('(SELECT count(*) FROM m b WHERE b.category = a.category AND b.rank > a.rank) / (SELECT count(*) FROM m b WHERE b.category = a.category)', 4)} AS percentile FROM m a",
    "listing_comparisons": f"""WITH l AS (SELECT l_partkey AS upc, count(*) AS listings, quantile_cont(l_extendedprice / l_quantity, 0.5) AS med FROM lineitem GROUP BY 1)
      SELECT p_partkey AS upc, listings, {r("med / p_retailprice", 3)} AS ratio FROM part LEFT JOIN l ON upc = p_partkey""",
    "storefronts": """WITH s AS (SELECT DISTINCT l_suppkey AS seller, CAST(date_trunc('month', l_shipdate) AS DATE) AS day, l_partkey AS item FROM lineitem)
      SELECT seller, day, CAST(count(*) AS INTEGER) AS n_items, array_to_string(list_sort(list(item))[1:5], ',') AS items FROM s GROUP BY 1, 2""",
}
SQL["retrieval_by_system"] = f"""WITH {_BM25}, w AS (SELECT doc_id AS cid, lang, {_TOKENS} AS t FROM documents), h AS (SELECT cid, lang, t, unnest(range(1, len(t) - 6)) AS i FROM w),
  e AS (SELECT DISTINCT qid, cid, lang FROM (SELECT item_id AS qid, array_to_string(({_TOKENS})[1:8], ' ') AS head FROM benchmark) JOIN h ON head = array_to_string(t[i:i + 7], ' ')),
  found AS (SELECT 'bm25' AS system, qid, cid, rank FROM rk WHERE rank <= 5 UNION ALL SELECT 'reranked', qid, cid, rank FROM ({SQL["reranked"]})),
  c AS (SELECT qid, cid, unnest([lang, 'all']) AS category FROM e), names AS (SELECT unnest(['bm25', 'reranked']) AS system),
  b AS (SELECT system, category, qid, min(rank) AS rank FROM c CROSS JOIN names LEFT JOIN found USING (system, qid, cid) GROUP BY 1, 2, 3),
  quality AS (SELECT system, category, count(*) AS n, {r("avg(CASE WHEN rank <= 2 THEN 1 ELSE 0 END)", 4)} AS recall, {r("avg(coalesce(1 / rank, 0))", 4)} AS mrr FROM b GROUP BY 1, 2)
  SELECT *, recall < max(recall) OVER (PARTITION BY category) AS beaten FROM quality"""
