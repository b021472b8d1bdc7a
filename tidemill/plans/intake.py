"""Queries that write raw rows, ledgers and text files and read them back, and that parse stored documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import parse as P
from tidemill.functions.rounding import sql_rounded as r
from tidemill.operators import corpus as B
from tidemill.operators import matching as M
from tidemill.operators import text as K
from tidemill.operators import trends as T
from tidemill.plans.tables import read
from tidemill.sources import lake as L
from tidemill.sources.folders import shared_folder
from tidemill.plans.streams import event_batches
from tidemill.streaming import jobs as X
from tidemill.streaming.state import drain_inbox_by_key


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw rows of a lake, some with a broken hash, some repeated."""
    payload = F.concat_ws(":", F.col("event_type"), (F.col("user_id") % 7).cast("string"), F.floor(F.col("value")).cast("string"))
    e = read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("source"), F.col("user_id").cast("string").alias("entity_id"), F.col("event_type").alias("endpoint"), payload.alias("payload"), F.col("ts").alias("fetched_at"))
    return e.withColumn("content_hash", F.when(F.col("event_id") % 10 == 0, "broken").otherwise(F.sha2("payload", 256)))


def lake_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written to a partitioned lake, and those of one source since a day read back."""
    root = shared_folder(spark, "lake")
    L.write_lake(_raw(spark, sf_dir), root)
    rows = L.read_lake(spark, root, "s1", "2024-01-10")
    return rows.groupBy("source", F.col("date").alias("day")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


def inbox_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inbox drained as a stream: what is stored and what is set aside, by source."""
    inbox, root = shared_folder(spark, "inbox"), shared_folder(spark, "drained")
    _raw(spark, sf_dir).write.parquet(inbox)
    stream = spark.readStream.schema(spark.read.parquet(inbox).schema).parquet(inbox)
    X.drain_inbox(stream, f"{root}/lake", f"{root}/held", f"{root}/checkpoint").awaitTermination()
    count = lambda folder, name: spark.read.parquet(f"{root}/{folder}").groupBy("source").agg(F.count("*").alias(name), F.countDistinct("entity_id", "endpoint", "payload").alias(f"{name}_distinct"))
    return count("lake", "stored").join(count("held", "held"), "source").select("source", "held", "held_distinct", "stored_distinct", (F.col("stored") >= F.col("stored_distinct")).alias("whole"))


def inbox_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same inbox drained in several micro-batches, with each key's last hash as state."""
    root, raw = shared_folder(spark, "drained"), _raw(spark, sf_dir)
    stream = event_batches(spark, sf_dir, raw.withColumn("at", F.col("fetched_at").cast("timestamp"))).drop("at")
    drain_inbox_by_key(stream, f"{root}/lake", f"{root}/held", f"{root}/checkpoint").awaitTermination()
    count = lambda folder, name: spark.read.parquet(f"{root}/{folder}").groupBy("source").agg(F.count("*").alias(name), F.countDistinct("entity_id", "endpoint", "payload").alias(f"{name}_distinct"))
    return count("lake", "stored").join(count("held", "held"), "source").select("source", "held", "held_distinct", "stored_distinct", (F.col("stored") >= F.col("stored_distinct")).alias("whole"))


def ledger_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions written as JSON lines, some of them broken, and read back as labels."""
    folder = shared_folder(spark, "ledger")
    k = F.col("o_orderkey")
    decision = F.element_at(F.array(*map(F.lit, ["buy", "pass", "defer", " Buy "])), (k % 4 + 1).cast("int"))
    row = F.struct(F.when(k % 5 > 0, F.concat(F.lit("i"), (F.col("o_custkey") % 97).cast("string"))).alias("item"), F.col("o_orderpriority").alias("name"), k.alias("at"), decision.alias("decision"))
    line = F.when(k % 11 == 0, "").when(k % 13 == 0, '{"item": "x", ').otherwise(F.to_json(row))
    read(spark, sf_dir, "orders").select(line.alias("value")).write.text(folder)
    return B.ledger_labels(L.read_ledger(spark, folder, "item string, name string, at long, decision string"))


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as files by source and read back with categories by path."""
    folder = shared_folder(spark, "files")
    read(spark, sf_dir, "documents").where("text is not null").select("text", "source").write.partitionBy("source").text(folder)
    rows = L.read_corpus(spark, folder, [("src1", "first", "note"), ("src1/x", "none", "none"), ("src2", "second", "note")])
    # lines of a file are in any order, so the sizes are compared
    return rows.groupBy("category", "source_type").agg(F.sum(F.length("text")).alias("n_chars"))


def page_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    price = F.when(k % 5 == 0, F.lit('"n/a"')).otherwise(F.concat(F.lit('"'), F.format_number(F.col("p_retailprice"), 2), F.lit('"')))
    node = F.concat(F.lit('{"@type":'), F.when(k % 3 == 0, F.lit('["Thing","Product"]')).when(k % 3 == 1, F.lit('"Product"')).otherwise(F.lit('"Offer"')), F.lit(',"name":"'), F.col("p_name"), F.lit('","brand":{"name":"'), F.col("p_brand"), F.lit('"},"offers":[{"price":'), price, F.lit("}]}"))
    html = F.concat(F.lit('<html><script type="application/ld+json">{"broken"</script><script type="application/ld+json">{"@graph":['), node, F.lit("]}</script></html>"))
    rows = read(spark, sf_dir, "part").select(k.alias("id"), F.explode(K.page_products(html)).alias("p"))
    return rows.select("id", "p.name", "p.price", "p.brand")


def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rss = F.concat(F.lit("<rss><channel><item><title> "), F.col("p_name"), F.lit(" </title><link>http://x/"), k.cast("string"), F.lit("</link></item><item><title>more</title></item></channel></rss>"))
    atom = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>'), F.col("p_name"), F.lit('</title><link href="http://y/'), k.cast("string"), F.lit('"/></entry></feed>'))
    xml = F.when(k % 3 == 0, rss).when(k % 3 == 1, atom).otherwise(F.lit("<rss><channel>"))
    rows = read(spark, sf_dir, "part").select(k.alias("id"), F.posexplode(K.feed_items(xml)).alias("at", "i"))
    return rows.select("id", "at", "i.title", "i.link")


def api_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored documents of two kinds as deals."""
    k = F.col("p_partkey")
    now, before = F.floor(F.col("p_retailprice")).cast("long"), F.when(k % 4 > 0, F.floor(F.col("p_retailprice")).cast("long") + k % 90)
    store = F.to_json(F.struct(k.cast("string").alias("sku"), F.col("p_brand").alias("upc"), F.col("p_name").alias("name"), now.alias("salePrice"), before.alias("regularPrice")))
    daily = F.to_json(F.struct(k.cast("string").alias("OfferId"), F.col("p_brand").alias("Upc"), F.col("p_name").alias("Title"), now.alias("SalePrice"), before.alias("ListPrice")))
    deal = F.when(k % 2 == 0, P.api_deal(store, P.DEAL_FIELDS["store"])).otherwise(P.api_deal(daily, P.DEAL_FIELDS["daily"]))
    return read(spark, sf_dir, "part").select(deal.alias("d")).select("d.sku", "d.upc", "d.title_raw", "d.price_current", "d.price_original", "d.discount_pct")


def series_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as parallel arrays of values and times, and as points again."""
    rows = read(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 9 == 0, -1.0).when(F.col("o_orderkey") % 7 == 0, F.lit("NaN").cast("double")).otherwise(F.floor(F.col("o_totalprice")).cast("double")).alias("v"), (F.unix_date(F.to_date("o_orderdate")) + 7305).cast("long").alias("d"), "o_orderkey")
    both = F.array_sort(F.collect_list(F.struct("o_orderkey", "v", "d")))
    arrays = rows.groupBy("o_custkey").agg(both.alias("x"))
    points = P.history_points(F.transform("x", lambda p: p["v"]), F.transform("x", lambda p: p["d"] * 86400))
    return arrays.select("o_custkey", F.explode(points).alias("p")).select("o_custkey", "p.day", "p.value").groupBy("o_custkey").agg(F.count("*").alias("points"), F.count("value").alias("known"), F.sum("value").alias("total"), F.min("day").alias("first_day"))


def stray_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that a text names and its group doesn't have."""
    ident = lambda c: F.concat(F.lit("B0"), F.lpad(c.cast("string"), 8, "0"))
    k = F.col("o_orderkey")
    text = F.concat(F.lit("see "), ident(k), F.lit(", "), ident(k % 10), F.lit(" and XB0"), ident(k))
    rows = read(spark, sf_dir, "orders").select(k, P.invented_ids(text, F.array(ident(k % 10), ident(F.lit(5)))).alias("ids"))
    return rows.select("o_orderkey", F.array_join("ids", ",").alias("ids"))


def last_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last block of an append-only log and its bullets."""
    k = F.col("p_partkey")
    log = F.concat(F.lit("# log\n## one\n- old\n## two of "), k.cast("string"), F.lit("\n- "), F.col("p_name"), F.lit("\ntext\n  * "), F.col("p_brand"), F.lit(" \n"))
    rows = read(spark, sf_dir, "part").select(k.alias("id"), P.last_block(log).alias("b"))
    return rows.select("id", F.split("b", "\n")[0].alias("head"), F.array_join(P.bullets(F.col("b")), "|").alias("bullets"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored transcripts of three shapes as text."""
    k = F.col("p_partkey")
    words = F.array(F.col("p_name"), F.concat(F.lit(" "), F.col("p_brand")))
    parts = F.transform(words, lambda w: F.struct(w.alias("text")))
    entry = F.when(k % 3 == 0, F.to_json(words)).when(k % 3 == 1, F.to_json(F.struct(parts.alias("transcript")))).otherwise(F.to_json(F.struct(parts.alias("segments"))))
    return read(spark, sf_dir, "part").select(k.alias("id"), P.transcript_text(entry).alias("text"))


def closed_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("term"), F.when(k % 5 > 0, k % 100).alias("interest"), F.when(k % 3 > 0, k % 3 == 1).alias("partial"))
    return T.closed_weeks(rows).groupBy("term").agg(F.count("*").alias("n"), F.sum("interest").alias("interest"))


def neutral_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column that only live rows have, in a corpus of one tier and of two."""
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(F.when(k % 4 == 0, "gold").otherwise("backtest").alias("tier"), (k % 10).alias("live"), k.alias("id"))
    both = B.neutralise_mixed(rows, ["live"]).withColumn("rows", F.lit("mixed"))
    one = B.neutralise_mixed(rows.where("tier = 'gold'"), ["live"]).withColumn("rows", F.lit("gold"))
    return both.unionByName(one).groupBy("rows", "tier").agg(F.count("*").alias("n"), F.count("live").alias("known"), F.sum("live").alias("total"))


def deal_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads that begin with a matched deal; several deals may name an item."""
    k = F.col("p_partkey")
    deals = read(spark, sf_dir, "part").select(k.alias("deal_id"), F.floor(k / 3).cast("long").alias("item"), F.when(k % 11 > 0, F.col("p_retailprice") / 10).alias("price"), (k % 13 / 10).alias("stack"))
    matches = deals.select("deal_id", "item", (F.col("deal_id") % 100 / 100).alias("confidence"), F.when(F.col("deal_id") % 5 == 0, "approved").otherwise("open").alias("review"))
    items = deals.select("item").distinct()
    i = F.col("item")
    scored = items.select("item", (i % 100).alias("score"), F.when(i % 2 == 0, "BUY").otherwise("REVIEW").alias("verdict"), F.when(i % 6 == 0, "gated").alias("hard_reject"), (i % 60 + 50).cast("double").alias("net"))
    return M.new_leads(matches, deals, items.where(i % 4 > 0), scored)


QUERIES = {
    "lake_round_trip": lake_round_trip, "inbox_stream": inbox_stream, "inbox_by_key": inbox_by_key, "ledger_labels": ledger_labels, "text_files": text_files, "page_products": page_products,
    "feed_items": feed_items, "api_deals": api_deals, "series_points": series_points, "stray_ids": stray_ids, "last_proposals": last_proposals,
    "transcripts": transcripts, "closed_weeks": closed_weeks, "neutral_columns": neutral_columns, "deal_leads": deal_leads,
}
_RAW = """raw AS (SELECT event_id, 's' || (user_id % 3) AS source, user_id, event_type, event_type || ':' || (user_id % 7) || ':' || CAST(floor(value) AS BIGINT) AS payload, CAST(ts AS DATE) AS day FROM events)"""
SQL = {
    "lake_round_trip": f"WITH {_RAW} SELECT source, day, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM raw WHERE source = 's1' AND day >= DATE '2024-01-10' GROUP BY 1, 2",
    "inbox_stream": f"""WITH {_RAW} SELECT source, count(*) FILTER (WHERE event_id % 10 = 0) AS held, count(DISTINCT (user_id, event_type, payload)) FILTER (WHERE event_id % 10 = 0) AS held_distinct,
      count(DISTINCT (user_id, event_type, payload)) FILTER (WHERE event_id % 10 > 0) AS stored_distinct, true AS whole FROM raw GROUP BY 1""",
    "ledger_labels": """WITH l AS (SELECT CASE WHEN o_orderkey % 5 > 0 THEN 'I' || (o_custkey % 97) ELSE lower(o_orderpriority) END AS key, o_orderkey AS t, o_orderkey % 4 <> 1 AS label FROM orders WHERE o_orderkey % 11 > 0 AND o_orderkey % 13 > 0 AND o_orderkey % 4 <> 2)
      SELECT key, max(t) AS "at", arg_max(label, t) AS label FROM l GROUP BY 1""",
    "text_files": """SELECT CASE WHEN contains(source, 'src1') THEN 'first' WHEN contains(source, 'src2') THEN 'second' ELSE 'other' END AS category, CASE WHEN contains(source, 'src1') OR contains(source, 'src2') THEN 'note' ELSE 'text' END AS source_type,
      CAST(sum(length(text) + 1) AS BIGINT) AS n_chars FROM documents WHERE text IS NOT NULL GROUP BY 1, 2""",
    "page_products": "SELECT p_partkey AS id, p_name AS name, CAST(round(CAST(p_retailprice AS DECIMAL(18,2)), 2) AS DOUBLE) AS price, p_brand AS brand FROM part WHERE p_partkey % 3 < 2 AND p_partkey % 5 > 0",
    "feed_items": """SELECT p_partkey AS id, 0 AS "at", p_name AS title, CASE p_partkey % 3 WHEN 0 THEN 'http://x/' ELSE 'http://y/' END || p_partkey AS link FROM part WHERE p_partkey % 3 < 2
      UNION ALL SELECT p_partkey, 1, 'more', NULL FROM part WHERE p_partkey % 3 = 0""",
    "api_deals": f"""WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS sku, p_brand AS upc, p_name AS title_raw, floor(p_retailprice) AS c, CASE WHEN p_partkey % 4 > 0 THEN floor(p_retailprice) + p_partkey % 90 END AS o FROM part)
      SELECT sku, upc, title_raw, CAST(c AS DOUBLE) AS price_current, CAST(o AS DOUBLE) AS price_original, {r("(1 - c / o) * 100", 1)} AS discount_pct FROM p""",
    "series_points": """SELECT o_custkey, count(*) AS points, count(*) FILTER (WHERE o_orderkey % 9 > 0 AND o_orderkey % 7 > 0) AS known, CAST(sum(floor(o_totalprice)) FILTER (WHERE o_orderkey % 9 > 0 AND o_orderkey % 7 > 0) AS DOUBLE) AS total,
      min(CAST(o_orderdate AS DATE) + 7305) AS first_day FROM orders GROUP BY 1""",
    "stray_ids": """SELECT o_orderkey, CASE WHEN o_orderkey < 10 OR o_orderkey = 5 THEN '' ELSE 'B0' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') END AS ids FROM orders""",
    "last_proposals": "SELECT p_partkey AS id, 'two of ' || p_partkey AS head, p_name || '|' || p_brand AS bullets FROM part",
    "transcripts": r"SELECT p_partkey AS id, trim(regexp_replace(p_name || ' ' || p_brand, '\s+', ' ', 'g')) AS text FROM part",
    "closed_weeks": "SELECT o_orderpriority AS term, count(*) AS n, CAST(sum(o_orderkey % 100) AS BIGINT) AS interest FROM orders WHERE o_orderkey % 5 > 0 AND o_orderkey % 3 <> 1 GROUP BY 1",
    "neutral_columns": """SELECT 'mixed' AS rows, CASE WHEN o_orderkey % 4 = 0 THEN 'gold' ELSE 'backtest' END AS tier, count(*) AS n, 0::BIGINT AS known, NULL::BIGINT AS total FROM orders GROUP BY 2
      UNION ALL SELECT 'gold', 'gold', count(*), count(*), CAST(sum(o_orderkey % 10) AS BIGINT) FROM orders WHERE o_orderkey % 4 = 0""",
    "deal_leads": f"""WITH d AS (SELECT p_partkey AS k, p_partkey // 3 AS item, CASE WHEN p_partkey % 11 > 0 THEN {r("p_retailprice / 10 * (1 - greatest(0, least(p_partkey % 13 / 10, 0.95)))", 2)} END AS cost FROM part WHERE p_partkey % 100 / 100 >= 0.90 OR p_partkey % 5 = 0),
      b AS (SELECT item, min(cost) AS cost, arg_min(k, struct_pack(a := coalesce(cost, -1), b := k)) AS k, count(*) AS deals FROM d WHERE item % 4 = 0 GROUP BY 1),
      s AS (SELECT *, CASE WHEN item % 6 = 0 THEN 'rejected' WHEN cost IS NULL THEN 'no price' ELSE 'new' END AS status FROM b), c AS (SELECT item, k AS deal_id, deals, item % 100 AS score, CASE WHEN item % 2 = 0 THEN 'BUY' ELSE 'REVIEW' END AS verdict, status, CASE WHEN status = 'new' THEN cost END AS cost, item % 60 + 50 AS net FROM s)
      SELECT item, deal_id, deals, score, verdict, status, cost, {r("net - cost", 2)} AS profit, {r("(net - cost) / cost", 3)} AS roi FROM c""",
}
SQL["inbox_by_key"] = SQL["inbox_stream"]
