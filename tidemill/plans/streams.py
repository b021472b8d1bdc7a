"""Streaming queries over the events table, run over what is there; batch SQL gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.sources.folders import shared_folder
from tidemill.streaming import jobs as X
from tidemill.streaming import state as S


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream, with a zoned time stamp."""
    folder, name = sf_dir, "events.parquet"
    schema = spark.read.parquet(f"{folder}/{name}").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return stream.withColumn("at", F.col("ts").cast("timestamp"))


def _run(spark: SparkSession, df: DataFrame, mode: str) -> DataFrame:
    return X.run_to_files(spark, df, "s" + uuid.uuid4().hex, mode)


def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.windowed_counts(events(spark, sf_dir), "at", "event_type")
    return _run(spark, out, "complete").select(F.to_date("start").alias("day"), "event_type", "n")


def weekly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.windowed_counts(events(spark, sf_dir), "at", "event_type", "7 days", "1 day")
    return _run(spark, out, "complete").select(F.to_date("end").alias("until"), "event_type", "n")


def first_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, X.distinct_sightings(events(spark, sf_dir).select("user_id", "event_type", "at"), ["user_id", "event_type"], "at", "60 days"), "append").select("user_id", "event_type")


def health_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("event_type") == "error", 403).when(F.col("event_type") == "purchase", 200).otherwise(500)
    rows = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("url"), F.col("event_id").alias("seq"), code.alias("code"), (F.col("user_id") % 2 == 0).alias("fallback"))
    return _run(spark, X.health_states(rows), "update")


def hint_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("at", (F.col("user_id") % 10).alias("brand"), F.col("event_type").alias("store"), F.lit(1.0).alias("weight"))
    return _run(spark, X.fresh_hints(rows, "at"), "complete").select(F.to_date("until").alias("until"), "brand", "store", "strength")


def claim_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    claims = rows.where("event_type = 'signup'").select(F.col("user_id").alias("item"), F.col("at").alias("made_at"), F.lit(100.0).alias("threshold"))
    snaps = rows.where("event_type = 'purchase'").select(F.col("user_id").alias("snap_item"), F.col("at").alias("seen_at"), "value")
    found = _run(spark, X.matured_claims(claims, snaps), "append")
    return found.groupBy("hit").agg(F.count("*").alias("n"), F.countDistinct("item").alias("items"))


#: Micro-batches that the events are cut into, and rows a file.
BATCHES, ROWS_A_FILE = 4, 1_000_000


def event_batches(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """The events, or rows with their time ``at``, as files in order of time, and a stream that takes a quarter of them
    in each micro-batch."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("at", F.col("ts").cast("timestamp")) if rows is None else rows
    folder, micros = shared_folder(spark, "events"), F.unix_micros("at")
    edges = rows.select(micros.cast("double").alias("m")).approxQuantile("m", [i / BATCHES for i in range(1, BATCHES)], 0.01)
    edges = [-float("inf"), *sorted(edges), float("inf")]
    files = max(1, rows.count() // BATCHES // ROWS_A_FILE)
    for lo, hi in zip(edges, edges[1:], strict=False):  # a job each, since a file stream goes by the files' age
        rows.where((micros > lo) & (micros <= hi)).repartition(files).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


def health_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("event_type") == "error", 403).when(F.col("event_type") == "purchase", 200).otherwise(500)
    rows = event_batches(spark, sf_dir).select(F.col("user_id").cast("string").alias("url"), F.col("event_id").alias("seq"), code.alias("code"), (F.col("user_id") % 2 == 0).alias("fallback"))
    last = _run(spark, S.source_states(rows), "update").groupBy("url").agg(F.max_by(F.struct("refused", "state"), "seq").alias("x"))
    return last.select("url", "x.refused", "x.state")


def live_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many hints of the same brand and store, and what weight, are younger than three days at each hint."""
    rows = event_batches(spark, sf_dir).select(F.col("event_id").alias("id"), "at", (F.col("user_id") % 10).alias("brand"), F.col("event_type").alias("store"), F.round(F.col("value") * 100).cast("long").alias("weight"))
    return _run(spark, S.live_hints(rows, "at"), "append").select("id", "live", "strength")


def upsert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last sighting of each user and event type, upserted batch by batch."""
    root = shared_folder(spark, "sightings")
    rows = event_batches(spark, sf_dir).select("user_id", "event_type", F.col("at").alias("seen"))
    X.upsert_sightings(rows, f"{root}/rows", ["user_id", "event_type"], f"{root}/state").awaitTermination()
    found = spark.read.parquet(f"{root}/rows")
    newest = found.agg(F.max("version")).first()[0]
    return found.where(F.col("version") == newest).select("user_id", "event_type", F.to_date("first_seen").alias("first_day"), F.to_date("last_seen").alias("last_day"))


QUERIES = {
    "stream_health_states": health_by_state,
    "stream_live_hints": live_hints,
    "stream_upserts": upsert_stream,
    "stream_daily_counts": daily_counts,
    "stream_weekly_counts": weekly_counts,
    "stream_first_sightings": first_sightings,
    "stream_health": health_stream,
    "stream_hints": hint_stream,
    "stream_claims": claim_stream,
}
_HEALTH = """WITH e AS (SELECT user_id, event_id, event_type, count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events),
      c AS (SELECT user_id, g, count(*) FILTER (WHERE event_type = 'error') AS n FROM e GROUP BY 1, 2)
      SELECT CAST(user_id AS VARCHAR) AS url, CAST(arg_max(n, g) AS BIGINT) AS refused, CASE WHEN max(n) >= 2 AND user_id % 2 = 0 THEN 'retired' WHEN arg_max(n, g) > 0 THEN 'failing' ELSE 'ok' END AS state FROM c GROUP BY user_id"""
SQL = {
    "stream_health_states": _HEALTH,
    "stream_live_hints": """SELECT event_id AS id, count(*) OVER w AS live, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS BIGINT) AS strength FROM events
      WINDOW w AS (PARTITION BY user_id % 10, event_type ORDER BY ts RANGE BETWEEN INTERVAL '71 hours 59 minutes 59.999999 seconds' PRECEDING AND CURRENT ROW)""",
    "stream_upserts": "SELECT user_id, event_type, CAST(min(ts) AS DATE) AS first_day, CAST(max(ts) AS DATE) AS last_day FROM events GROUP BY 1, 2",
    "stream_daily_counts": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_weekly_counts": "SELECT CAST(ts AS DATE) + CAST(k AS INTEGER) AS until, event_type, count(*) AS n FROM events, (SELECT unnest(range(1, 8)) AS k) GROUP BY 1, 2",
    "stream_first_sightings": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_health": _HEALTH,
    "stream_hints": "SELECT CAST(ts AS DATE) + CAST(k AS INTEGER) AS until, user_id % 10 AS brand, event_type AS store, CAST(count(*) AS DOUBLE) AS strength FROM events, (SELECT unnest(range(1, 4)) AS k) GROUP BY 1, 2, 3",
    "stream_claims": """SELECT b.value >= 100 AS hit, count(*) AS n, count(DISTINCT a.user_id) AS items FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts + INTERVAL 14 DAY AND b.ts < a.ts + INTERVAL 21 DAY
      WHERE a.event_type = 'signup' AND b.event_type = 'purchase' GROUP BY 1""",
}
